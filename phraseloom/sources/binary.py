"""Readers of the binary corpus, vocabulary, alignment and suffix-array files (all little-endian).

Headers are read on the driver, a few bytes per file.  The body is read by tasks that each open the file at their own
byte range, so one file may be larger than any task's memory.  Paths are local, ``file:``, or of a file system that Arrow knows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from phraseloom.operators.vocab import with_eos_alias
from phraseloom.schemas import ALIGNMENT, MAGIC_V2, MAGIC_V3, SENTENCES, VOCAB

#: Sentences, or entries of an array, that one task's row range holds.
RANGE = 200_000
_POSITION = np.dtype([("sid", "<u4"), ("off", "u1")])


def _open(path: str):
    """A plain path is of a file system that every task sees mounted, such as the local one of a single machine."""
    where, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return where.open_input_file(name)


def _bytes(path: str, at: int, n: int) -> bytes:
    with _open(path) as f:
        return f.read_at(n, at)


def file_size(path: str) -> int:
    with _open(path) as f:
        return f.size()


def _ranges(spark: SparkSession, n: int, step: int = RANGE) -> DataFrame:
    """``a, b`` bounds of row ranges, one per task."""
    parts = max(1, -(-n // step))
    return spark.range(0, parts, 1, parts).select((F.col("id") * step).alias("a"), F.least(F.lit(n).cast("bigint"), (F.col("id") + 1) * step).alias("b")).where("a < b")


def read_vocab(spark: SparkSession, path: str, alias: bool = True) -> tuple[DataFrame, int]:
    """``vid, surface, is_alias`` of a vocabulary file and the id at which new words go on.

    With ``alias``, id 1 reads as the end of sentence whatever word the file has there; that word stays as an alias, and
    the file's own unknown-word id is ignored.
    """
    size, _unk = struct.unpack("<II", _bytes(path, 0, 8))
    strings = 8 + 8 * size
    end = file_size(path)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch.a, batch.b):
                entries = np.frombuffer(_bytes(path, 8 + 8 * int(a), 8 * int(b - a)), "<u4").reshape(-1, 2)
                low = int(entries[:, 0].min())
                with _open(path) as f:
                    # The last string of the range ends at a NUL somewhere behind its start.
                    need = int(entries[:, 0].max()) - low
                    block = f.read_at(min(need + (1 << 16), end - strings - low), strings + low)
                    while block.find(b"\0", need) < 0 and strings + low + len(block) < end:
                        block += f.read_at(1 << 16, strings + low + len(block))
                words = [block[o - low : block.index(b"\0", o - low)].decode("utf-8", "replace") for o in entries[:, 0].tolist()]
                yield pd.DataFrame({"vid": entries[:, 1].astype(np.int64), "surface": words, "is_alias": False})

    df = _ranges(spark, size).mapInPandas(rows, VOCAB)
    return (with_eos_alias(df) if alias else df), size


def _header(path: str) -> tuple[int, int, int, int]:
    magic, start, size, total = struct.unpack("<QQII", _bytes(path, 0, 24))
    return magic, start, size, total


def _layout(path: str, index_path: str | None) -> tuple[str, int, int]:
    """Index file, where its entries begin, and the number of sentences; fails on an unknown magic number."""
    magic, start, size, _total = _header(path)
    if magic == MAGIC_V2:
        return path, start, size
    if magic == MAGIC_V3:
        if index_path is None:
            raise ValueError("a version 3 track needs its sentence index file")
        index_magic, index_size = struct.unpack("<QI", _bytes(index_path, 0, 12))
        if index_magic != MAGIC_V3:
            raise RuntimeError("unknown version magic in the sentence index")
        return index_path, 16, index_size
    raise RuntimeError("unknown version magic")


def _bounds(index: tuple[str, int, int], a: int, b: int) -> np.ndarray:
    return np.frombuffer(_bytes(index[0], index[1] + 4 * a, 4 * (b - a + 1)), "<u4").astype(np.int64)


def read_corpus(spark: SparkSession, path: str, index_path: str | None = None) -> DataFrame:
    """``sid, toks`` of a version 2 corpus file, or of a version 3 track with its sentence index."""
    index = _layout(path, index_path)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch.a, batch.b):
                at = _bounds(index, int(a), int(b))
                vids = np.frombuffer(_bytes(path, 24 + 4 * int(at[0]), 4 * int(at[-1] - at[0])), "<u4")
                if len(vids) and vids.max() >= 1 << 31:
                    raise ValueError("token id above 2^31 - 1")
                toks = np.split(vids.astype(np.int32), at[1:-1] - at[0])
                yield pd.DataFrame({"sid": np.arange(a, b), "toks": toks})

    return _ranges(spark, index[2]).mapInPandas(rows, SENTENCES)


def read_alignment(spark: SparkSession, path: str, index_path: str | None = None) -> DataFrame:
    """``sid, links`` of an alignment file: two bytes a link, index entries count bytes."""
    index, arrow = _layout(path, index_path), to_arrow_schema(ALIGNMENT)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                at = _bounds(index, a, b)
                pairs = np.frombuffer(_bytes(path, 24 + int(at[0]), int(at[-1] - at[0])), "u1").reshape(-1, 2)
                links = pa.StructArray.from_arrays([pa.array(pairs[:, c].astype(np.int32)) for c in (0, 1)], fields=list(arrow.field("links").type.value_type))
                lists = pa.ListArray.from_arrays(pa.array(((at - at[0]) // 2).astype(np.int32)), links)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), lists], schema=arrow)

    return _ranges(spark, index[2]).mapInArrow(rows, ALIGNMENT)


def _read_positions(spark: SparkSession, path: str, at: int, n: int) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch.a, batch.b):
                x = np.frombuffer(_bytes(path, at + 5 * int(a), 5 * int(b - a)), _POSITION)
                yield pd.DataFrame({"rank": np.arange(a, b), "sid": x["sid"].astype(np.int64), "off": x["off"].astype(np.int32)})

    return _ranges(spark, n).mapInPandas(rows, "rank bigint, sid bigint, off int")


def read_suffix_array(spark: SparkSession, path: str) -> DataFrame:
    """``rank, sid, off`` of a version 2 suffix-array file; the index block behind the entries is ignored."""
    magic, index_start, _size = struct.unpack("<QQI", _bytes(path, 0, 20))
    if magic != MAGIC_V2:
        raise RuntimeError("unknown version magic")
    return _read_positions(spark, path, 20, (index_start - 20) // 5)


def read_leaf(spark: SparkSession, path: str) -> DataFrame:
    """``rank, sid, off`` of a headerless leaf array."""
    return _read_positions(spark, path, 0, file_size(path) // 5)


def read_node(spark: SparkSession, path: str) -> DataFrame:
    """A leaf kept as Parquet; a directory that is missing is an empty node."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.read.parquet(path)
    return spark.createDataFrame([], "rank bigint, sid bigint, off int")
