"""Writers of the binary corpus, vocabulary, alignment and suffix-array files, the counterpart of the readers.

Such a file is one sequence of bytes, so one task writes it, streaming its rows in order; it holds a batch of rows and,
for sentences, four bytes per sentence for the index behind them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseloom.schemas import MAGIC_V2, MAGIC_V3
from phraseloom.sources.text import folder_of


def _created(path: str):
    where, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    where.create_dir(folder_of(name), recursive=True)
    return where.open_output_stream(name)


def _in_one_task(rows: DataFrame, order: list[str], write) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write(b for b in batches if b.num_rows)
        yield from ()

    rows.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "done boolean").count()


def _flat(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return col.flatten(), np.asarray(col.value_lengths().fill_null(0))


def _sequences(rows: DataFrame, path: str, index_path: str | None, values: str, encode, unit: int, count) -> None:
    """``sid, values`` with sids from 0 without gaps; ``unit`` is what an index entry counts per value."""
    n, total, low, high = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(values)), F.lit(0)), F.min("sid"), F.max("sid")).first()
    if n and (low, high) != (0, n - 1):
        raise ValueError("sentence ids must be 0 to n - 1")
    start = 0 if index_path else 24 + count * total

    def write(batches: Iterator[pa.RecordBatch]) -> None:
        sizes = [np.zeros(1, np.int64)]
        with _created(path) as f:
            f.write(struct.pack("<QQII", MAGIC_V3 if index_path else MAGIC_V2, start, n, total))
            for b in batches:
                flat, size = _flat(b.column(values))
                f.write(encode(flat))
                sizes.append(size.astype(np.int64))
            entries = (np.cumsum(np.concatenate(sizes)) * unit).astype("<u4").tobytes()
            if not index_path:
                f.write(entries)
        if index_path:
            with _created(index_path) as f:
                f.write(struct.pack("<QIxxxx", MAGIC_V3, n) + entries)

    _in_one_task(rows.select("sid", values), ["sid"], write)


def write_corpus(sents: DataFrame, path: str, index_path: str | None = None) -> None:
    """``sid, toks`` as a version 2 file, or with ``index_path`` as a version 3 track and its sentence index."""
    _sequences(sents, path, index_path, "toks", lambda flat: np.asarray(flat).astype("<u4").tobytes(), 1, 4)


def write_alignment(aligned: DataFrame, path: str) -> None:
    """``sid, links`` with offsets of at most 255 as a version 2 file; index entries count bytes."""

    def encode(flat: pa.Array) -> bytes:
        pairs = np.stack([np.asarray(flat.field(c)) for c in ("src", "trg")], axis=1)
        if len(pairs) and not (0 <= pairs.min() and pairs.max() <= 255):
            raise ValueError("link offset outside one byte")
        return pairs.astype("u1").tobytes()

    _sequences(aligned, path, None, "links", encode, 2, 2)


def write_vocab(vocab: DataFrame, path: str, unk: int = 1) -> None:
    """``vid, surface`` in id order; the strings follow the entries."""
    n = vocab.count()

    def write(batches: Iterator[pa.RecordBatch]) -> None:
        entries, words, at = [], [], 0
        for b in batches:
            for vid, word in zip(b.column("vid").to_pylist(), b.column("surface").to_pylist()):
                raw = word.encode() + b"\0"
                entries.append(struct.pack("<II", at, vid))
                words.append(raw)
                at += len(raw)
        with _created(path) as f:
            f.write(struct.pack("<II", n, unk) + b"".join(entries) + b"".join(words))

    _in_one_task(vocab.select("vid", "surface"), ["vid", "surface"], write)


def write_suffix_array(sa: DataFrame, path: str, header: bool = True) -> None:
    """``rank, sid, off`` with offsets of at most 255; without ``header`` as a leaf array."""
    n = sa.count()

    def write(batches: Iterator[pa.RecordBatch]) -> None:
        with _created(path) as f:
            if header:
                f.write(struct.pack("<QQI", MAGIC_V2, 20 + 5 * n, 1))
            for b in batches:
                x = np.zeros(b.num_rows, np.dtype([("sid", "<u4"), ("off", "u1")]))
                x["sid"], off = np.asarray(b.column("sid")), np.asarray(b.column("off"))
                if off.max() > 255:
                    raise ValueError("offset outside one byte")
                x["off"] = off
                f.write(x.tobytes())

    _in_one_task(sa.select("rank", "sid", "off"), ["rank"], write)
