"""Cut oversized token sequences at natural boundaries by agglomerative merging.

A sequence above the limit is first cut into atoms after every mark or paragraph token.  Atoms too long for a piece
are cut hard.  Adjacent pieces then sit in a heap by the strength of the boundary between them, and the weakest
boundary is merged away first while both sides and the overlap fit the limit.  Each piece but the first also repeats
the last ``overlap`` tokens before it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

LIMIT = 255
OVERLAP = 16
# The strength of the boundary after a mark; a hard cut has none.
STRENGTH = {
    "<p>": 4, ".": 3, "?": 3, "!": 3, "…": 3, "。": 3, "．": 3, "？": 3, "！": 3, "؟": 3, "।": 3, ";": 2, ":": 2, "；": 2, "：": 2, "؛": 2, ",": 1, "，": 1, "、": 1, "،": 1,
}


def boundary_vids(vocab: DataFrame, marks: dict[str, int] = STRENGTH) -> dict[str, dict[int, int]]:
    """Strength by vid for each side.  Marks are a short list, so is the result; alias rows count like others."""
    rows = vocab.where(F.col("surface").isin(list(marks)) & F.col("side").isNotNull() & F.col("vid").isNotNull())
    out: dict[str, dict[int, int]] = {}
    for r in rows.select("side", "vid", "surface").distinct().collect():
        side = out.setdefault(r.side, {})
        side[r.vid] = max(side.get(r.vid, 0), marks[r.surface])
    return out


def split_points(toks: list[int | None], strength: dict[int, int], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """``(end, strength of the boundary there)`` of each piece; the last end is the sequence's, with strength 0.

    A piece runs from the end before it, less the overlap, to its own end, and is never longer than ``limit``.
    """
    n = len(toks)
    if n <= limit:
        return [(n, 0)]
    room = limit - overlap
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    ends: list[int] = []
    power: list[int] = []
    at = 0
    for k, tok in enumerate(toks):
        mark = strength.get(tok, 0)
        if mark and k + 1 < n:
            while k + 1 - at > room:
                at += room
                ends.append(at)
                power.append(0)
            at = k + 1
            ends.append(at)
            power.append(mark)
    while n - at > room:
        at += room
        ends.append(at)
        power.append(0)
    ends.append(n)
    power.append(0)

    left = list(range(-1, len(ends) - 1))
    right = list(range(1, len(ends) + 1))
    starts = [0, *ends[:-1]]
    alive = [True] * len(ends)

    def entry(k: int) -> tuple[int, int, int, int]:
        size = ends[right[k]] - starts[k]
        return power[k], size, k, right[k]

    heap = [entry(k) for k in range(len(ends) - 1)]
    heapq.heapify(heap)
    while heap:
        mark, size, k, r = heapq.heappop(heap)
        if not alive[k] or right[k] != r or r >= len(ends) or size != ends[r] - starts[k] or power[k] != mark:
            continue
        if size + (overlap if starts[k] else 0) > limit:
            continue
        alive[r] = False  # its boundary becomes that of the merged piece
        ends[k], power[k], right[k] = ends[r], power[r], right[r]
        if right[k] < len(ends):
            left[right[k]] = k
            heapq.heappush(heap, entry(k))
        if left[k] >= 0:
            heapq.heappush(heap, entry(left[k]))
    return [(ends[k], power[k]) for k in range(len(ends)) if alive[k]]


def split_sequences(corpus: DataFrame, vocab: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, strength: dict[str, int] = STRENGTH) -> DataFrame:
    """Pieces of every sequence above the limit: ``side, sid, piece, start, end, new_from, natural, toks``.

    ``strength`` gives the marks after which a cut is natural, and how strong the boundary is; a boundary of less is given
    up first.  ``start`` is the first token of the piece, ``new_from`` where it stops repeating the piece before; ``natural`` tells
    whether the piece ends at a mark, a paragraph token or the sequence's end.  Rows of one (side, sid) are one
    sequence: the oversized rows are filtered at the scan, before the one shuffle that removes repeats.  Null or short
    ``toks`` and null sides or sids give no pieces, null tokens are no marks.  Extra columns are ignored.
    """
    long = corpus.where(F.col("side").isNotNull() & F.col("sid").isNotNull() & (F.size("toks") > limit)).groupBy("side", "sid").agg(F.max("toks").alias("toks"))
    out = T.StructType(
        [
            T.StructField("side", T.StringType()), T.StructField("sid", T.LongType()),
            *[T.StructField(c, T.LongType()) for c in ("piece", "start", "end", "new_from")],
            T.StructField("natural", T.BooleanType()), T.StructField("toks", T.ArrayType(T.IntegerType())),
        ]
    )
    arrow = to_arrow_schema(out)
    marks = boundary_vids(vocab, strength)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pydict()
                side, sid, toks = row["side"][0], row["sid"][0], row["toks"][0]
                cuts = split_points(toks, marks.get(side, {}), limit, overlap)
                froms = [0, *[e for e, _ in cuts[:-1]]]
                rows = [
                    (side, sid, p, max(0, f - overlap), e, f, bool(mark) or e == len(toks), toks[max(0, f - overlap) : e])
                    for p, (f, (e, mark)) in enumerate(zip(froms, cuts))
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return long.select("side", F.col("sid").cast("bigint").alias("sid"), "toks").mapInArrow(run, out)


def segment_sizes(corpus: DataFrame, vocab: DataFrame, headers: DataFrame, magics: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Per (side, segment): sentences, pieces after splitting, and the header's ``idx_size``.

    A sentence belongs to the segment of its earliest row that names one; sentences without a segment don't count, those
    without toks count as one piece, as in a header.  The header is the latest 'six' one with a known magic and a size.
    """
    known = corpus.where("side is not null and sid is not null")
    first = F.min(F.when(F.col("segment_id").isNotNull(), F.struct("ingested_at", "segment_id"))).alias("seg")
    home = known.groupBy("side", "sid").agg(first).select("side", "sid", F.col("seg.segment_id").alias("segment_id")).where("segment_id is not null")
    pieces = split_sequences(corpus, vocab, limit, overlap).groupBy("side", "sid").agg(F.count(F.lit(1)).alias("n"))
    sizes = home.join(pieces, ["side", "sid"], "left").groupBy("side", "segment_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.coalesce("n", F.lit(1))).alias("n_pieces"))
    good = headers.where((F.col("file_kind") == "six") & F.col("version_magic").isin(magics) & F.col("idx_size").isNotNull())
    latest = good.groupBy("side", "segment_id").agg(F.max_by("idx_size", F.struct("written_at", "idx_size")).alias("idx_size"))
    return sizes.join(latest, ["side", "segment_id"], "left").withColumn("differs", F.col("idx_size") != F.col("n_sentences"))
