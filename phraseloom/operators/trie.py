"""Shape of the hybrid trie: which prefixes are internal nodes and which are suffix-array leaves.

The shape depends on insertion order, but has a closed form.  A node p splits when it holds S = max + 1 members and at
least one that came after its parent's split, so if members are numbered by insertion, (sid, off), p splits at its first
member that is at least its S-th and lies behind the parent's split; with no such member, or if p ends in the end of
sentence, it is a leaf.  The root splits at member S, or, preloaded with n positions, at member max(S, n + 1).

A split lies at most one of those members further along than the parent's, counted from the later of the S-th and the
first behind the root's split.  So a short list of members per large node decides all depths.  Node sizes come from one
pass over the sorted array, in which every node is one run of rows: runs that are small and touch no border are final
and leave at once, and nothing else is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from phraseloom.functions.columns import with_eos
from phraseloom.operators.ordered import ranked, running_total
from phraseloom.operators.phrases import Batch, hits
from phraseloom.operators.suffix import PREFIX, VS
from phraseloom.schemas import EOS_VID, MAX_LEAF
from phraseloom.session import materialize

#: Sentences of one block of the insertion order; a node's members are found block by block.
BLOCK = 4096

_FOUND = T.StructType(
    [
        T.StructField("base", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("path", T.ArrayType(T.IntegerType())),
        *[T.StructField(c, T.LongType()) for c in ("begin", "n", "blk", "early")],
    ]
)


def _nodes(large: int, split: tuple[int, int]):
    """Sorted rows ``base, rank, sid, off, v0..`` -> runs of equal prefixes.

    One row per run whose parent is large or touches a border of the rows seen together (``blk`` null), and for runs
    that are so themselves one row per block of sentences, with the number of members up to the root's ``split``.
    """
    arrow = to_arrow_schema(_FOUND)

    def piece(base: int, rank: np.ndarray, blk: np.ndarray, early: np.ndarray, v: np.ndarray) -> Iterator[list]:
        n = len(rank)
        fresh = np.zeros(n, bool)
        fresh[0] = True
        wide = np.ones(n, bool)  # rows whose run at the depth above is large or touches a border
        for d in range(1, PREFIX + 1):
            col = v[:, d - 1]
            fresh[1:] |= col[1:] != col[:-1]
            start = np.flatnonzero(fresh)
            size = np.diff(np.append(start, n))
            real = wide[start] & (col[start] > 0)
            at = start[real]
            yield [np.full(len(at), base), np.full(len(at), d, np.int32), v[at, :d], rank[at], size[real], None, None]
            big = (size >= large) | (start == 0) | (start + size == n)
            go = big & real & (col[start] != EOS_VID)
            wide = np.repeat(go, size)
            rows = np.flatnonzero(wide)
            if not len(rows):
                return
            run = np.repeat(np.arange(len(start)), size)[rows]
            pair, back = np.unique(np.stack([run, blk[rows]]), axis=1, return_inverse=True)
            back = back.reshape(-1)
            first = start[pair[0]]
            yield [np.full(len(first), base), np.full(len(first), d, np.int32), v[first, :d], rank[first], np.bincount(back), pair[1], np.bincount(back, early[rows]).astype(np.int64)]

    def record(c: list) -> pa.RecordBatch:
        paths = c[2]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(paths) + 1, dtype=np.int32) * paths.shape[1]), pa.array(paths.reshape(-1), pa.int32()))
        none = pa.nulls(len(paths), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1]), lists, *[none if x is None else pa.array(x, pa.int64()) for x in c[3:]]], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            base, rank, sid, off = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("base", "rank", "sid", "off"))
            v = np.stack([batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in VS], axis=1)
            early = (sid < split[0]) | ((sid == split[0]) & (off <= split[1]))
            cuts = [0, *(np.flatnonzero((np.diff(rank) != 1) | (np.diff(base) != 0)) + 1).tolist(), len(rank)]
            for a, b in zip(cuts, cuts[1:]):
                for cols in piece(int(base[a]), rank[a:b], sid[a:b] // BLOCK, early[a:b], v[a:b]):
                    if len(cols[0]):
                        yield record(cols)

    return run


def member_at(sents: DataFrame, k: int) -> tuple[int, int]:
    """``(sid, off)`` of the ``k``-th position, from 1, in insertion order."""
    blocks = sents.groupBy(F.floor(F.col("sid") / BLOCK).alias("blk")).agg(F.sum(F.size("toks")).cast("bigint").alias("m"))
    row = running_total(blocks, "blk", "m").where((F.col("cum_before") < k) & (F.col("cum_before") + F.col("m") >= k)).first()
    left = k - row.cum_before
    for r in sents.where(F.floor(F.col("sid") / BLOCK) == row.blk).select("sid", F.size("toks").alias("m")).orderBy("sid").collect():  # at most BLOCK
        if left <= r.m:
            return r.sid, left - 1
        left -= r.m
    raise ValueError("the array has more positions than its sentences")


def _candidates(found: DataFrame, rows: DataFrame, large: int, deep: int) -> DataFrame:
    """``base, path, depth, n, begin, list`` of large nodes, with the members in order that may be the split."""
    key = ["base", "path"]
    nodes = found.where("blk is null").groupBy(*key, "depth").agg(F.sum("n").alias("n"), F.min("begin").alias("begin"))
    heavy = nodes.where((F.col("n") >= large) & (F.element_at("path", -1) != EOS_VID))
    held = found.where("blk is not null").groupBy(*key, "blk").agg(F.sum("n").alias("m"), F.sum("early").alias("e")).join(heavy, key)
    by = Window.partitionBy(*key)
    held = held.withColumns({"before": F.coalesce(F.sum("m").over(by.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")), "low": F.greatest(F.lit(large).cast("bigint"), F.sum("e").over(by) + 1)})
    held = held.withColumn("high", F.col("low") + F.lit(deep) + F.col("depth") + 2)
    # Mostly one block a node, at most as many as the few members spread over.
    near = held.where((F.col("before") <= F.col("high")) & (F.col("before") + F.col("m") >= F.col("low")))
    here = rows.select("base", "rank", "sid", "off", F.floor(F.col("sid") / BLOCK).alias("blk"))
    inside = (F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("begin") + F.col("n"))
    met = here.join(near.select(*key, "blk", "begin", "n", "before", "low", "high"), ["base", "blk"]).where(inside)
    place = F.col("before") + F.row_number().over(Window.partitionBy(*key, "blk").orderBy("sid", "off"))
    some = met.withColumn("place", place).where("place between low and high").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("sid", "off"))).alias("list"))
    return heavy.join(some, key).select(*key, "depth", "list")


def trie_nodes(sa: DataFrame, sents: DataFrame, n: int, max_leaf: int = MAX_LEAF, preloaded: int = 0, max_depth: int | None = None) -> DataFrame:
    """``path, depth, n, is_leaf`` of every node, from a sorted array of ``n`` positions and its sentences.

    Eight depths at a time; only the members of nodes that go deeper read more tokens.  ``preloaded`` is the number of
    positions the root began with.
    """
    spark, large = sa.sparkSession, max_leaf + 1
    first = max(large, preloaded + 1 if preloaded else 0)
    split = n >= first and (max_depth is None or max_depth > 0)
    out = spark.createDataFrame([([], 0, n, n < first)], "path array<int>, depth int, n bigint, is_leaf boolean")
    if not split:
        return out
    at = member_at(sents, first)
    bases = spark.createDataFrame([(0, [], at)], "base bigint, above array<int>, t struct<sid:bigint,off:int>")
    rows, deep = sa.select(F.lit(0).cast("bigint").alias("base"), "rank", "sid", "off", *VS), 0
    while True:
        found = materialize(rows.mapInArrow(_nodes(large, at), _FOUND))
        lists = materialize(_candidates(found, rows, large, deep))
        level = bases.select("base", F.array().cast("array<int>").alias("path"), "t")
        internal = level
        for d in range(1, (lists.agg(F.max("depth")).first()[0] or 0) + 1):
            up = level.select("base", F.col("path").alias("up"), F.col("t").alias("above"))
            mine = lists.where(F.col("depth") == d).withColumn("up", F.slice("path", 1, d - 1)).join(up, ["base", "up"])
            level = mine.withColumn("t", F.expr("get(filter(list, x -> x > above), 0)")).where("t is not null").select("base", "path", "t")
            internal = internal.unionByName(level)
        internal = materialize(internal)
        nodes = found.where("blk is null").groupBy("base", "path", "depth").agg(F.sum("n").alias("n"))
        parent = internal.select("base", F.col("path").alias("up"))
        below = nodes.withColumn("up", F.slice("path", F.lit(1), F.col("depth") - 1)).join(parent, ["base", "up"]).join(internal.select("base", "path", F.lit(False).alias("is_leaf")), ["base", "path"], "left")
        full = below.join(bases.select("base", "above"), "base").select(F.concat("above", "path").alias("path"), (F.col("depth") + deep).alias("depth"), "n", F.coalesce("is_leaf", F.lit(True)).alias("is_leaf"))
        out = out.unionByName(full if max_depth is None else full.where(F.col("depth") <= max_depth))
        deep += PREFIX
        last = internal.where(F.size("path") == PREFIX)
        if (max_depth is not None and deep >= max_depth) or last.isEmpty():
            return out
        named = last.join(bases.select("base", F.col("above").alias("a")), "base").select("base", "path", F.concat("a", "path").alias("above"), "t", F.monotonically_increasing_id().alias("next"))
        named = materialize(named)
        kids = named.select("base", "next", *[F.get("path", F.lit(d)).alias(v) for d, v in enumerate(VS)])
        more = rows.join(kids, ["base", *VS]).select(F.col("next").alias("base"), "rank", "sid", "off").join(sents.select("sid", "toks"), "sid")
        more = more.withColumn("full", with_eos(F.col("toks"))).select("base", "rank", "sid", "off", *[F.get("full", F.col("off") + deep + d).alias(v) for d, v in enumerate(VS)])
        rows = materialize(more.repartitionByRange("rank").sortWithinPartitions("rank"))
        bases = named.select(F.col("next").alias("base"), "above", "t")


def leaf_of(sa: DataFrame, sents: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rank, sid, off, path`` with the leaf that holds each position."""
    leaves = nodes.where("is_leaf")
    if not leaves.where("depth = 0").isEmpty():
        return sa.select("rank", "sid", "off", F.array().cast("array<int>").alias("path"))
    met = hits(sa, Batch.of(leaves.select(F.col("path").alias("q"))), sents, ["rank", "sid", "off"])
    return met.select("rank", "sid", "off", F.col("q").alias("path"))


def dump_lines(sa: DataFrame, sents: DataFrame, nodes: DataFrame, surfaces: DataFrame) -> DataFrame:
    """``line_no, line``: the trie as indented text, children by id, leaves in array order."""
    # The words, marks and the indent of two spaces a level are the dump's format.
    deep = F.size("path") * 2
    pad = F.repeat(F.lit(" "), deep)
    title = F.concat(pad, F.lit("TreeNode size="), F.col("n").cast("string"), F.lit(" is_leaf="), F.col("is_leaf").cast("string"))
    heads = nodes.select("path", F.lit(1).alias("part"), F.lit(-1).cast("bigint").alias("rank"), title.alias("line"))
    named = nodes.where(F.size("path") > 0).withColumn("vid", F.element_at("path", -1).cast("bigint")).join(surfaces.select("vid", "surface"), "vid", "left")
    label = F.concat(F.repeat(F.lit(" "), (F.size("path") - 1) * 2), F.lit("* '"), F.coalesce("surface", F.lit("")), F.lit("' vid="), F.col("vid").cast("string"))
    names = named.select("path", F.lit(0).alias("part"), F.lit(-1).cast("bigint").alias("rank"), label.alias("line"))
    entry = F.concat(pad, F.lit("* [sid="), F.col("sid").cast("string"), F.lit(" offset="), F.col("off").cast("string"), F.lit("]"))
    entries = leaf_of(sa, sents, nodes).select("path", F.lit(2).alias("part"), "rank", entry.alias("line"))
    return ranked(heads.unionByName(names).unionByName(entries), ["path", "part", "rank"], "line_no").select("line_no", "line")
