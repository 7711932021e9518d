"""Long exact spans shared between sequences: seeds, star-shaped joins, collinear chains.

1. Minimiser seeds: of every ``length`` consecutive tokens, the least hash of a ``k``-mer is a seed, so two sequences
   that share such a stretch share a seed.  Seeds that stand in one sequence only are dropped by a map-side combined
   aggregate.
2. The windows around the remaining seeds are hashed whole.  For the shared positions each hash keeps its least and its
   greatest occurrence; a window is joined to one of them, never to all others, so a stretch in a third of all sequences
   costs one row a copy.  For the passages equal texts become one class and all classes with a ``k``-mer meet, in tiles:
   there every ``k``-mer is a match, as a passage may have edits closer to each other than ``length``.
3. The matches of two sequences are merged along diagonals and chained in order with gap costs through a Fenwick tree.
   The chains' segments are the exact spans; a chain as a whole is a fuzzy passage, which :func:`passages` aligns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from phraseloom.llm.vectors import inside, mixed, rolling, token_lists
from phraseloom.session import materialize, shuffle_partitions

LENGTH = 25
SEED = 13
GAP_COST = 0.25
TILE = 512
#: Multiplier of the second hash of a window; with one of its own, both agree by chance once in about 2^128 pairs.
SECOND = 0x9E3779B97F4A7C15

_SEEDS = T.StructType([T.StructField("sid", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("h", T.LongType())])
_WINDOWS = T.StructType([T.StructField(c, T.LongType()) for c in ("sid", "h", "h2")] + [T.StructField("off", T.IntegerType())])
_CHAINED = T.StructType([T.StructField(c, T.LongType()) for c in ("sid", "other", "chain", "start", "end", "other_start", "other_end")])


def _minimisers(flat: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat places of the seeds and their hashes."""
    seeds = rolling(mixed(flat), k) | np.uint64(1)
    spread = length - k + 1
    n = len(flat) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = seeds[:n].copy()
    for j in range(1, spread):
        np.minimum(least, seeds[j : j + n], out=least)
    broken = np.cumsum(np.concatenate([[0], flat < 0]))
    least[~inside(bounds, length) | (broken[length:] != broken[:-length])] = 0
    over = np.zeros(len(seeds), np.uint64)
    for j in range(spread):
        np.maximum(over[j : j + n], least, out=over[j : j + n])
    at = np.flatnonzero(over == seeds)
    return at, seeds[at]


def _seeded(length: int, k: int):
    arrow = to_arrow_schema(_SEEDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = token_lists(batch.column("toks"))
            at, h = _minimisers(flat, bounds, length, k)
            row = np.searchsorted(bounds, at, "right") - 1
            sid = batch.column("sid").to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array((at - bounds[row]).astype(np.int32)), pa.array(h.view(np.int64))], schema=arrow)

    return run


def _windowed(length: int, k: int):
    arrow = to_arrow_schema(_WINDOWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = token_lists(batch.column("toks"))
            pos, own = token_lists(batch.column("places"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(own))
            place = pos + bounds[row]
            n = len(flat) - length + 1
            if n <= 0:
                continue
            mark = np.zeros(n + 1, np.int64)  # a window that holds a seed begins at most length - k before it
            np.add.at(mark, np.clip(place - (length - k), 0, n), 1)
            np.add.at(mark, np.clip(place + 1, 0, n), -1)
            broken = np.cumsum(np.concatenate([[0], flat < 0]))
            at = np.flatnonzero((np.cumsum(mark)[:-1] > 0) & inside(bounds, length) & (broken[length:] == broken[:-length]))
            h, h2 = rolling(mixed(flat, 1), length)[at], rolling(mixed(flat, 2), length, SECOND)[at]
            of = np.searchsorted(bounds, at, "right") - 1
            sid = batch.column("sid").to_numpy(zero_copy_only=False)[of]
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(h.view(np.int64)), pa.array(h2.view(np.int64)), pa.array((at - bounds[of]).astype(np.int32))], schema=arrow)

    return run


def _all_windows(k: int):
    arrow = to_arrow_schema(_WINDOWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = token_lists(batch.column("toks"))
            if len(flat) < k:
                continue
            broken = np.cumsum(np.concatenate([[0], flat < 0]))
            at = np.flatnonzero(inside(bounds, k) & (broken[k:] == broken[:-k]))
            h, h2 = rolling(mixed(flat, 1), k)[at], rolling(mixed(flat, 2), k, SECOND)[at]
            of = np.searchsorted(bounds, at, "right") - 1
            sid = batch.column("sid").to_numpy(zero_copy_only=False)[of]
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(h.view(np.int64)), pa.array(h2.view(np.int64)), pa.array((at - bounds[of]).astype(np.int32))], schema=arrow)

    return run


class Fenwick:
    """Prefix maxima: the best (value, item) at or below a rank."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def raise_to(self, rank: int, value: float, item: int) -> None:
        k = rank + 1
        while k < len(self.best):
            if value > self.best[k][0]:
                self.best[k] = (value, item)
            k += k & -k

    def upto(self, rank: int) -> tuple[float, int]:
        k, best = rank + 1, (float("-inf"), -1)
        while k > 0:
            if self.best[k][0] > best[0]:
                best = self.best[k]
            k -= k & -k
        return best


def diagonals(matches: list[tuple[int, int]], length: int) -> list[tuple[int, int, int]]:
    """Merge window matches (x, y) that follow or overlap each other on a diagonal: (x, y, tokens)."""
    out: list[list[int]] = []
    for x, y in sorted(set(matches), key=lambda m: (m[0] - m[1], m[0])):
        if out and out[-1][0] - out[-1][1] == x - y and x <= out[-1][0] + out[-1][2]:
            out[-1][2] = x + length - out[-1][0]
        else:
            out.append([x, y, length])
    return [tuple(s) for s in out]


def chain(segments: list[tuple[int, int, int]], gap_cost: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """Order segments into collinear chains; every segment is in one.

    A segment follows the one with the best score less ``gap_cost`` per skipped token on either side; a chain goes on
    only while that is worth more than beginning anew.
    """
    if len(segments) < 2:
        return [[s] for s in segments]
    segs = sorted(segments)
    ends = sorted({y + n for _, y, n in segs})
    rank = {e: k for k, e in enumerate(ends)}
    tree = Fenwick(len(ends))
    leaving = sorted(range(len(segs)), key=lambda i: segs[i][0] + segs[i][2])
    score, before, done = [0.0] * len(segs), [-1] * len(segs), 0
    for j, (x, y, n) in enumerate(segs):
        while done < len(leaving) and segs[leaving[done]][0] + segs[leaving[done]][2] <= x:
            i = leaving[done]
            a, b, m = segs[i]
            tree.raise_to(rank[b + m], score[i] + gap_cost * (a + m + b + m), i)
            done += 1
        score[j] = n
        low = int(np.searchsorted(ends, y, "right")) - 1
        value, i = tree.upto(low) if low >= 0 else (float("-inf"), -1)
        if i >= 0 and value - gap_cost * (x + y) > 0:
            score[j], before[j] = n + value - gap_cost * (x + y), i
    used, chains = [False] * len(segs), []
    for j in sorted(range(len(segs)), key=lambda i: (-score[i], i)):
        line = []
        while j >= 0 and not used[j]:
            used[j] = True
            line.append(segs[j])
            j = before[j]
        if line:
            chains.append(line[::-1])
    return chains


def _held(line: list[tuple[int, int, int]]) -> int:
    """Tokens that a chain matches exactly."""
    return sum(n for _, _, n in line)


def _chained(length: int, gap_cost: float, least: int):
    arrow = to_arrow_schema(_CHAINED)

    def rows(pair: tuple[int, int], matches: list[tuple[int, int]]) -> list[tuple]:
        out = []
        for c, line in enumerate(chain(diagonals(matches, length), gap_cost)):
            if _held(line) >= least:
                out += [(*pair, c, x, x + n, y, y + n) for x, y, n in line]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, matches = None, []
        for batch in batches:
            sid, other, off, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "other", "off", "other_off"))
            if not len(sid):
                continue
            cuts = [0, *(np.flatnonzero((np.diff(sid) != 0) | (np.diff(other) != 0)) + 1).tolist(), len(sid)]
            done = []
            for a, b in zip(cuts, cuts[1:]):
                now = (int(sid[a]), int(other[a]))
                if now != pair:
                    if matches:
                        done += rows(pair, matches)
                    pair, matches = now, []
                matches += zip(off[a:b].tolist(), at[a:b].tolist())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], schema=arrow)
        if matches and (done := rows(pair, matches)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], schema=arrow)

    return run


def _seeded_windows(rows: DataFrame, length: int, k: int) -> DataFrame:
    """``sid, h, h2, off`` of the windows around seeds that stand in two sequences."""
    seeds = rows.mapInArrow(_seeded(length, k), _SEEDS)
    twice = seeds.groupBy("h").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("h")
    places = seeds.join(twice, "h").groupBy("sid").agg(F.collect_set("pos").alias("places"))
    return materialize(rows.join(places, "sid").select("sid", "toks", "places").mapInArrow(_windowed(length, k), _WINDOWS))


def _in_chains(matches: DataFrame, length: int, gap_cost: float, least: int = 0) -> DataFrame:
    ordered = matches.repartition(shuffle_partitions(matches.sparkSession), "sid", "other").sortWithinPartitions("sid", "other", "off")
    return ordered.mapInArrow(_chained(length, gap_cost, least), _CHAINED)


def matched_chains(seqs: DataFrame, id_col: str, toks_col: str, length: int = LENGTH, k: int = SEED, gap_cost: float = GAP_COST) -> DataFrame:
    """Chained exact segments ``sid, other, chain, start, end, other_start, other_end`` between different sequences.

    Every window of ``length`` tokens that stands in two sequences lies in at least one segment of each of them.  Null
    or short lists and windows with a null token match nothing; repeated rows of an id count once; ids that are null
    are left out.
    """
    rows = seqs.where(F.col(id_col).isNotNull() & (F.size(toks_col) >= length)).select(F.col(id_col).cast("bigint").alias("sid"), F.col(toks_col).cast("array<int>").alias("toks"))
    windows = _seeded_windows(rows, length, k)
    at = F.struct("sid", "off")
    shared = windows.groupBy("h", "h2").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where("lo.sid <> hi.sid")
    other = F.when(F.col("sid") != F.col("lo.sid"), F.col("lo")).otherwise(F.col("hi"))
    matches = windows.join(shared, ["h", "h2"]).withColumn("o", other).select("sid", F.col("o.sid").alias("other"), "off", F.col("o.off").alias("other_off"))
    return _in_chains(matches, length, gap_cost)


def _copied(k: int, gap_cost: float, least: int):
    arrow = to_arrow_schema(_CHAINED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = token_lists(batch.column("toks"))
            out = []
            for pair, a, b in zip(zip(batch.column("sid").to_pylist(), batch.column("other").to_pylist()), bounds, bounds[1:]):
                edges = np.flatnonzero(np.diff(np.concatenate([[0], (flat[a:b] >= 0).astype(np.int8), [0]]))).tolist()
                whole = [(x, x, y - x) for x, y in zip(edges[::2], edges[1::2]) if y - x >= k]
                out += [(*pair, c, x, x + n, y, y + n) for c, line in enumerate(chain(whole, gap_cost)) if _held(line) >= least for x, y, n in line]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=arrow)

    return run


def pair_chains(seqs: DataFrame, id_col: str, toks_col: str, length: int = LENGTH, k: int = SEED, gap_cost: float = GAP_COST, tile: int = TILE) -> DataFrame:
    """Chains of the shared ``k``-mers of every two different texts, where a chain matches at least ``length`` tokens.

    The tokens need not stand together: edits may lie ``k`` + 1 tokens apart.  Columns as in :func:`matched_chains`.
    Equal texts are one class, named by its least id.  Classes meet in pairs, ``other`` the lesser; a further copy meets
    only its class, along the diagonal, so n copies cost n - 1 rows and say who belongs to the class.  A ``k``-mer in very
    many texts is joined in tiles of about ``tile`` by ``tile`` occurrences: no task has all of its pairs.  Two texts that
    repeat one m and n times have m * n matches.
    """
    tokens = F.max(F.col(toks_col).cast("array<int>")).alias("toks")
    rows = seqs.where(F.col(id_col).isNotNull() & F.col(toks_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("sid")).agg(tokens).where(F.size("toks") >= length)
    rows = materialize(rows)
    members = materialize(rows.join(rows.groupBy("toks").agg(F.min("sid").alias("other")), "toks").select("sid", "other", "toks"))
    windows = members.where("sid = other").select("sid", "toks").mapInArrow(_all_windows(k), _WINDOWS)
    shared = windows.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi")
    shared = shared.select("h", "h2", F.ceil(F.col("n") / tile).alias("tiles"))
    held = materialize(windows.join(shared, ["h", "h2"]).withColumn("tile", F.pmod(F.xxhash64("sid", "off"), "tiles")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))
    left = held.select("h", "h2", "sid", "off", F.col("tile").alias("row"), every.alias("col"))
    right = held.select("h", "h2", F.col("sid").alias("other"), F.col("off").alias("other_off"), every.alias("row"), F.col("tile").alias("col"))
    matches = left.join(right, ["h", "h2", "row", "col"]).where("sid > other").select("sid", "other", "off", "other_off")
    copies = members.where("sid <> other").mapInArrow(_copied(k, gap_cost, length), _CHAINED)
    return _in_chains(matches, k, gap_cost, length).unionByName(copies)


def shared_runs(chains: DataFrame) -> DataFrame:
    """Longest runs of shared positions: ``sid, run_start, run_end``."""
    before = Window.partitionBy("sid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("sid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(1))
    runs = chains.select("sid", "start", "end").distinct().withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(upto))
    return runs.groupBy("sid", "run").agg(F.min("start").alias("run_start"), F.max("end").alias("run_end")).drop("run")


def shared_share(seqs: DataFrame, id_col: str, toks_col: str, runs: DataFrame) -> DataFrame:
    """``sid, n_tokens, n_shared, share`` of every sequence with tokens; share is null for an empty one."""
    sizes = seqs.where(F.col(id_col).isNotNull() & F.col(toks_col).isNotNull()).groupBy(F.col(id_col).alias("sid")).agg(F.max(F.size(toks_col)).cast("bigint").alias("n_tokens"))
    held = runs.groupBy("sid").agg(F.sum(F.col("run_end") - F.col("run_start")).alias("n_shared"))
    out = sizes.join(held, "sid", "left").select("sid", "n_tokens", F.coalesce("n_shared", F.lit(0).cast("bigint")).alias("n_shared"))
    return out.withColumn("share", F.when(F.col("n_tokens") > 0, F.col("n_shared") / F.col("n_tokens")))


def edit_distance(a: list, b: list) -> int:
    """Insertions, deletions and replacements between two short lists."""
    if not a or not b:
        return len(a) + len(b)
    row = np.arange(len(b) + 1)
    right = np.array([hash(x) for x in b])
    steps = np.arange(len(b) + 1)
    for i, x in enumerate(a):
        best = np.minimum(row[1:] + 1, row[:-1] + (right != hash(x)))
        row = np.minimum.accumulate(np.concatenate([[i + 1], best]) - steps) + steps
    return int(row[-1])


_PASSAGES = T.StructType([T.StructField(c, T.LongType()) for c in ("sid", "other", "start", "end", "other_start", "other_end", "n_exact", "n_edits")] + [T.StructField("copy", T.BooleanType())])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(_PASSAGES)
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            r = {c: v[0] for c, v in batch.slice(k, 1).to_pydict().items()}
            line = sorted((s["start"], s["end"], s["other_start"], s["other_end"]) for s in r["line"])
            edits = sum(edit_distance(r["toks"][e:s], r["other_toks"][oe:os]) for (_, e, _, oe), (s, _, os, _) in zip(line, line[1:]))
            out.append((r["sid"], r["other"], line[0][0], line[-1][1], line[0][2], line[-1][3], sum(e - s for s, e, _, _ in line), edits, r["toks"] == r["other_toks"]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)


def passages(chains: DataFrame, seqs: DataFrame, id_col: str, toks_col: str) -> DataFrame:
    """Fuzzy passages: each chain with the tokens it matches exactly and the edits that align its gaps.

    ``copy`` marks two equal texts; of :func:`pair_chains`, these rows are the members of the class ``other``.
    The rows of a sequence that many others match are spread by AQE's skew join; the lists are joined once per chain.
    """
    key = ["sid", "other", "chain"]
    lines = chains.groupBy(*key).agg(F.collect_list(F.struct("start", "end", "other_start", "other_end")).alias("line"))
    toks = seqs.where(F.col(id_col).isNotNull() & F.col(toks_col).isNotNull()).groupBy(F.col(id_col).alias("sid")).agg(F.max(toks_col).alias("toks"))
    pairs = lines.join(toks, "sid").join(toks.select(F.col("sid").alias("other"), F.col("toks").alias("other_toks")), "other")
    return pairs.mapInArrow(_aligned, _PASSAGES)
