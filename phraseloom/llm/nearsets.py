"""Near-duplicate token sets: pigeonhole blocks over set fingerprints, Hamming checks, exact verification.

A set's fingerprint is its indicator over the vocabulary.  Two sets of sizes a and b with Jaccard similarity of at
least p / q differ in at most (a + b)(q - p) / (q + p) places, so if the vocabulary is split into one block more than that,
one block of both is equal.  Signatures are hashes of a block's members; sets meet where a signature is equal, and the
Hamming distance of 128-bit foldings, which never exceeds the true one, leaves few pairs for the exact check.

Equal sets are one class from the start.  A signature that more than ``WIDE`` classes share (an empty block, a block of function words)
is not paired: its members are split again by blocks of a fresh partition of the vocabulary, which is as lossless
as the first, level by level; what is still together after ``LEVELS`` is compared tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from phraseloom.llm.vectors import mixed, token_lists
from phraseloom.session import materialize, shuffle_partitions

SIMILARITY = 0.8
LEAST = 12
WIDE = 512
LEVELS = 5
TILE = 2048

_SIGS = T.StructType([T.StructField("sig", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("top", T.IntegerType()), T.StructField("f0", T.LongType()), T.StructField("f1", T.LongType())])
_MET = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("sig", T.LongType()), T.StructField("top", T.IntegerType())])


def size_bands(least: int, most: int) -> list[tuple[int, int]]:
    """Bands [low, top] for the smaller set of a pair; a band's top is about a fifth above its low end."""
    out, low = [], max(1, least)
    while low <= most:
        top = max(low, low * 6 // 5)
        out.append((low, top))
        low = top + 1
    return out


def blocks_for(top: int, sim: Fraction) -> int:
    """Blocks that leave one equal, for pairs whose smaller set has at most ``top`` members."""
    p, q = sim.numerator, sim.denominator
    return (top + top * q // p) * (q - p) // (q + p) + 1


def _folded(flat: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Parity of each of 128 bit places over a row's members."""
    bit = (mixed(flat, 11) >> np.uint64(57)).astype(np.int64)
    odd = (np.bincount(row * 128 + bit, minlength=rows * 128) & 1).astype(np.uint8).reshape(rows, 128)
    packed = np.packbits(odd, axis=1).view(np.int64)
    return packed[:, 0], packed[:, 1]


def _signed(flat: np.ndarray, row: np.ndarray, rows: int, m: int, level: int, base: np.ndarray) -> np.ndarray:
    """rows x m signatures: a hash of each block's members, the block and what the rows already agree on."""
    block = (mixed(flat, 100 + level) % np.uint64(m)).astype(np.int64)
    sums = np.zeros(rows * m, np.uint64)
    np.add.at(sums, row * m + block, mixed(flat, 200 + level))
    return mixed(mixed(sums.reshape(rows, m) + base[:, None], 300) + np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 301)


def _picked(flat: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of the chosen rows and their place among them."""
    sizes = np.diff(bounds)[rows]
    first = np.repeat(bounds[:-1][rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return flat[np.arange(sizes.sum()) + first], np.repeat(np.arange(len(rows)), sizes)


def _signatures(sim: Fraction, least: int, level: int):
    """Signature rows of classes (level 0) or of hot members, which bring ``sig`` and ``top``."""
    arrow = to_arrow_schema(_SIGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, bounds = token_lists(batch.column("vids"))
            n = np.diff(bounds)
            rep = batch.column("rep").to_numpy(zero_copy_only=False)
            f0, f1 = _folded(flat, np.repeat(np.arange(len(n)), n), len(n))
            if level:
                tops, base = batch.column("top").to_numpy(zero_copy_only=False), batch.column("sig").to_numpy(zero_copy_only=False).view(np.uint64)
                groups = [(int(t), np.flatnonzero(tops == t)) for t in np.unique(tops)]
            else:
                bands = size_bands(least, int(n.max()))
                groups = [(top, np.flatnonzero((n >= low) & (n * sim.numerator <= top * sim.denominator))) for low, top in bands]
                base = None
            for top, rows in groups:
                m = blocks_for(top, sim)
                for k in range(0, len(rows), max(1, 1_000_000 // m)):
                    part = rows[k : k + max(1, 1_000_000 // m)]
                    members, row = _picked(flat, bounds, part)
                    seed = base[part] if level else np.full(len(part), top, np.uint64)
                    sig = _signed(members, row, len(part), m, level, seed)
                    each = np.repeat(part, m)
                    cols = [sig.reshape(-1).view(np.int64), rep[each], n[each].astype(np.int32), np.full(len(each), top, np.int32), f0[each], f1[each]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=arrow)

    return run


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64)).astype(np.int64)


def _meet(sim: Fraction, wide: int | None):
    """Rows in signature order -> close pairs (b set), and members of signatures shared by more than ``wide`` (b null)."""
    arrow = to_arrow_schema(_MET)
    p, q = sim.numerator, sim.denominator
    names = ("sig", "rep", "n", "top", "f0", "f1")

    def pairs(c: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sig, rep, n, top, f0, f1 = c
        live, shift = np.arange(len(sig)), 1
        while True:
            live = live[live + shift < len(sig)]
            live = live[sig[live] == sig[live + shift]]
            if not len(live):
                return
            other = live + shift
            small, big = np.minimum(n[live], n[other]).astype(np.int64), np.maximum(n[live], n[other]).astype(np.int64)
            ok = (small <= top[live]) & (big * p <= small * q) & (rep[live] != rep[other])
            i, j = live[ok], other[ok]
            near = (_bits(f0[i] ^ f0[j]) + _bits(f1[i] ^ f1[j])) * (q + p) <= (small[ok] + big[ok]) * (q - p)
            i, j = i[near], j[near]
            yield np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
            shift += 1

    def out(c: list[np.ndarray], hot: np.ndarray) -> pa.RecordBatch:
        cold = [x[~hot] for x in c]
        met = list(pairs(cold))
        a = np.concatenate([x for x, _ in met]) if met else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in met]) if met else np.zeros(0, np.int64)
        if len(a):
            a, b = np.unique(np.stack([a, b]), axis=1)
        none = pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())
        h = [x[hot] for x in c]
        cols = [(pa.array(a), pa.array(h[1])), (pa.array(b), pa.nulls(len(h[0]), pa.int64())), (none[0], pa.array(h[0])), (none[1], pa.array(h[3]))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in cols], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        burning = None  # the signature of a wide group whose first rows have left
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [batch.column(x).to_numpy(zero_copy_only=False) for x in names]
            if held is not None:
                c = [np.concatenate([x, y]) for x, y in zip(held, c)]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(c[0])) + 1, [len(c[0])]])
            size = np.repeat(np.diff(cuts), np.diff(cuts))
            hot = (size > wide) if wide else np.zeros(len(size), bool)
            if burning is not None:
                hot |= c[0] == burning
            burning = int(c[0][-1]) if hot[-1] else None
            keep = len(c[0]) if hot[-1] else int(cuts[-2])  # an unfinished small group waits for the next batch
            held = [x[keep:] for x in c]
            if keep:
                yield out([x[:keep] for x in c], hot[:keep])
        if held is not None and len(held[0]):
            yield out(held, np.zeros(len(held[0]), bool) if burning is None else held[0] == burning)

    return run


def set_classes(rows: DataFrame, id_col: str, toks_col: str, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets ``rep, vids, n`` and their members ``sid, rep``; ``rep`` is a class's least id.

    Null tokens are no members of a set; sets below ``least`` members, null lists and null ids are left out.
    """
    sets = rows.where(F.col(id_col).isNotNull() & (F.size(toks_col) >= least)).select(F.col(id_col).cast("bigint").alias("sid"), F.array_sort(F.array_distinct(F.array_compact(F.col(toks_col).cast("array<int>")))).alias("vids"))
    sets = sets.where(F.size("vids") >= least).withColumns({"h": F.xxhash64("vids"), "h2": F.xxhash64(F.lit(1), F.col("vids"))})
    classes = materialize(sets.groupBy("h", "h2").agg(F.min("sid").alias("rep"), F.first("vids").alias("vids")))
    members = sets.select("sid", "h", "h2").distinct().join(classes.select("h", "h2", "rep"), ["h", "h2"]).select("sid", "rep")
    return classes.select("rep", "vids", F.size("vids").alias("n")), members


def close_classes(classes: DataFrame, similarity: float = SIMILARITY, least: int = LEAST, wide: int = WIDE, levels: int = LEVELS) -> DataFrame:
    """All pairs ``a < b`` of classes whose sets have at least the similarity."""
    sim = Fraction(similarity).limit_denominator(1000)
    tasks = shuffle_partitions(classes.sparkSession)
    rows = classes.select("rep", "vids")
    found = None
    for level in range(levels):
        sigs = rows.mapInArrow(_signatures(sim, least, level), _SIGS)
        met = materialize(sigs.repartition(tasks, "sig").sortWithinPartitions("sig", "rep").mapInArrow(_meet(sim, wide), _MET))
        pairs = met.where("b is not null").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        hot = met.where("b is null").select(F.col("a").alias("rep"), "sig", "top")
        if hot.isEmpty():
            break
        rows = classes.select("rep", "vids").join(hot, "rep")
    else:
        found = found.unionByName(_tiled(rows, sim, tasks))
    p, q = sim.numerator, sim.denominator
    sides = [classes.select(F.col("rep").alias(x), F.col("vids").alias(f"v{x}")) for x in "ab"]
    full = found.distinct().join(sides[0], "a").join(sides[1], "b")
    both = F.size(F.array_intersect("va", "vb"))
    return full.where(both * (p + q) >= (F.size("va") + F.size("vb")) * p).select("a", "b")


def _tiled(rows: DataFrame, sim: Fraction, tasks: int) -> DataFrame:
    """Pairs within groups that no level took apart: each group is cut into slices, each pair of slices is one tile."""
    arrow = to_arrow_schema(_SIGS)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = token_lists(batch.column("vids"))
            n = np.diff(bounds)
            f0, f1 = _folded(flat, np.repeat(np.arange(len(n)), n), len(n))
            yield pa.RecordBatch.from_arrays([batch.column("sig"), batch.column("rep"), pa.array(n.astype(np.int32)), batch.column("top"), pa.array(f0), pa.array(f1)], schema=arrow)

    flat = materialize(rows.select("sig", "rep", "top", "vids").mapInArrow(plain, _SIGS))
    sizes = flat.groupBy("sig").count().select("sig", F.ceil(F.col("count") / (TILE // 2)).cast("int").alias("k"))
    mine = F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")
    cut = flat.join(sizes, "sig").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    tile = F.xxhash64("sig", F.least("mine", "other"), F.greatest("mine", "other"))
    tiles = cut.select(tile.alias("sig"), "rep", "n", "top", "f0", "f1")
    met = tiles.repartition(tasks, "sig").sortWithinPartitions("sig", "rep").mapInArrow(_meet(sim, None), _MET)
    return met.where("b is not null").select("a", "b")


def close_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs ``sid_a < sid_b`` of members of one class or of linked classes: the links spelled out for each copy."""
    left = members.select(F.col("sid").alias("x"), F.col("rep").alias("a"))
    right = members.select(F.col("sid").alias("y"), F.col("rep").alias("b"))
    same = left.join(right.withColumnRenamed("b", "a"), "a").where("x < y")
    cross = links.join(left, "a").join(right, "b")
    pairs = same.select("x", "y").unionByName(cross.select("x", "y"))
    return pairs.select(F.least("x", "y").alias("sid_a"), F.greatest("x", "y").alias("sid_b"))


def components(links: DataFrame) -> DataFrame:
    """``node, root``: every node of the links with the least node of its component, by alternating stars.

    Each round is a map-side combined minimum and a join per star; the edges are written out, so lineage stays short.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u")
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def near_groups(rows: DataFrame, id_col: str, toks_col: str, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """``sid, class_id, group_id, n_links`` of every row with at least ``least`` distinct tokens.

    ``class_id`` is the least id with the same set, ``group_id`` the least id reachable over close pairs, ``n_links`` the number of other
    classes that the class is close to.  Copies share a class and are never paired; repeated rows of an id count once.
    """
    classes, members = set_classes(rows, id_col, toks_col, least)
    links = materialize(close_classes(classes, similarity, least))
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    roots = components(links).withColumnRenamed("node", "rep")
    known = ends.join(roots, "rep")
    out = members.join(known, "rep", "left")
    return out.select("sid", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n_links"))
