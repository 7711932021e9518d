"""Occurrences and records of every distinct term, counted in burst tries that are merged across workers.

Each batch of rows becomes one row per record with its distinct terms and places, so the one shuffle moves a row per
record, not per token; a record that holds a large share of all rows is cut into slices by a hash of the term, and since
a (record, term) pair lies in one slice, counts add up.  Each task streams its records in order, so repeated positions
fall out, and counts into a burst trie: terms are bytes, a container of term tails bursts into a node when it grows, and what
leaves the task is one compact subtree per container.  Prefixes that hold many terms over all workers become routes of
their own, of any length; matching subtrees meet on their route and are merged there.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from phraseloom.session import materialize, shuffle_partitions

BURST = 1024
#: Terms that a task's trie holds before its subtrees leave; bounds a worker's memory whatever the vocabulary.
HELD = 300_000
#: Records from this many rows on, if they are a large share too, are cut into slices by term.
HEAVY_ROWS = 1_000_000
SLICES = 64
ROUTE_TERMS = 50_000
MAX_ROUTES = 4096


def int_key(v: int) -> bytes:
    """Bytes of an integer, in its order: a length byte and the significant bytes."""
    if v < 0:
        return b"\x00" + (v + (1 << 63)).to_bytes(8, "big")
    size = (v.bit_length() + 7) // 8
    return bytes([size + 1]) + v.to_bytes(size, "big")


def key_int(b: bytes) -> int:
    return int.from_bytes(b[1:], "big") - ((1 << 63) if b[0] == 0 else 0)


class BurstTrie:
    """Counters by key; a node is a dict from byte to child, a container a dict from tail to [occurrences, records]."""

    def __init__(self, burst: int = BURST) -> None:
        self.burst = burst
        self.root: _Container | _Node = _Container()
        self.size = 0

    def add(self, key: bytes, occ: int, rec: int) -> None:
        self.graft(b"", ((key, occ, rec),))

    def graft(self, prefix: bytes, entries) -> None:
        """Merge a subtree's entries below its prefix: the path is walked once, containers take the tails."""
        parent, at, spot = None, 0, self.root
        while isinstance(spot, _Node) and at < len(prefix):
            parent, byte = spot, prefix[at]
            spot = spot.children.get(byte)
            at += 1
            if spot is None:
                spot = parent.children[byte] = _Container()
        rest = prefix[at:]
        if isinstance(spot, _Node):
            for tail, occ, rec in entries:
                self._down(spot, rest + tail, occ, rec)
            return
        for tail, occ, rec in entries:
            self._put(spot, rest + tail, occ, rec)
        if len(spot.tails) > self.burst:
            self._replace(parent, prefix[at - 1] if parent else 0, self._burst(spot))

    def _put(self, box: _Container, tail: bytes, occ: int, rec: int) -> None:
        counter = box.tails.get(tail)
        if counter is None:
            box.tails[tail] = [occ, rec]
            self.size += 1
        else:
            counter[0] += occ
            counter[1] += rec

    def _down(self, node: _Node, key: bytes, occ: int, rec: int) -> None:
        at = 0
        while True:
            if at == len(key):
                if node.own is None:
                    node.own = [0, 0]
                    self.size += 1
                node.own[0] += occ
                node.own[1] += rec
                return
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Container()
            if isinstance(child, _Container):
                self._put(child, key[at + 1 :], occ, rec)
                if len(child.tails) > self.burst:
                    node.children[key[at]] = self._burst(child)
                return
            node, at = child, at + 1

    def _replace(self, parent: _Node | None, byte: int, node: _Node) -> None:
        if parent is None:
            self.root = node
        else:
            parent.children[byte] = node

    def _burst(self, box: _Container) -> _Node:
        node = _Node()
        for tail, counter in box.tails.items():
            if not tail:
                node.own = counter
            else:
                child = node.children.setdefault(tail[0], _Container())
                child.tails[tail[1:]] = counter
        for byte, child in node.children.items():
            if len(child.tails) > self.burst:
                node.children[byte] = self._burst(child)
        return node

    def subtrees(self) -> Iterator[tuple[bytes, list[bytes], list[int], list[int]]]:
        """Each container with its prefix: tails, occurrences, records."""
        stack: list[tuple[bytes, _Container | _Node]] = [(b"", self.root)]
        while stack:
            prefix, spot = stack.pop()
            if isinstance(spot, _Container):
                if spot.tails:
                    counts = list(spot.tails.values())
                    yield prefix, list(spot.tails), [c[0] for c in counts], [c[1] for c in counts]
                continue
            if spot.own is not None:
                yield prefix, [b""], [spot.own[0]], [spot.own[1]]
            stack += [(prefix + bytes([b]), child) for b, child in spot.children.items()]


class _Container:
    __slots__ = ("tails",)

    def __init__(self) -> None:
        self.tails: dict[bytes, list[int]] = {}


class _Node:
    __slots__ = ("children", "own")

    def __init__(self) -> None:
        self.children: dict[int, _Container | _Node] = {}
        self.own: list[int] | None = None


_SUBTREE = T.StructType([T.StructField("prefix", T.BinaryType()), T.StructField("tails", T.ArrayType(T.BinaryType())), T.StructField("occ", T.ArrayType(T.LongType())), T.StructField("rec", T.ArrayType(T.LongType()))])
_ROUTED = T.StructType([T.StructField("route", T.IntegerType()), *_SUBTREE.fields])


def _codes(col: pa.Array) -> tuple[np.ndarray, list | None]:
    """A column as integers: its own values, or codes of a dictionary that comes along."""
    if pa.types.is_integer(col.type):
        return col.cast(pa.int64()).to_numpy(zero_copy_only=False), None
    coded = col.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _steps(*cols: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before; true for the first row."""
    out = np.zeros(len(cols[0]), bool)
    out[:1] = True
    for c in cols:
        out[1:] |= c[1:] != c[:-1]
    return out


def _gathered(schema: pa.Schema):
    """Rows of a batch -> one row per (record, slice) with its distinct terms and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c) for c in ("record", "slice", "term", "place")}
            record, part, term, place = (_codes(c)[0] for c in cols.values())
            order = np.lexsort((place, term, part, record))
            record, part, term, place = (x[order] for x in (record, part, term, place))
            fresh = _steps(record, part, term, place)
            order, record, part = order[fresh], record[fresh], part[fresh]
            first = np.flatnonzero(_steps(record, part))
            bounds = pa.array(np.append(first, len(order)).astype(np.int32))
            rows, heads = pa.array(order), pa.array(order[first])
            out = [cols["record"].take(heads), cols["slice"].take(heads), *[pa.ListArray.from_arrays(bounds, cols[c].take(rows)) for c in ("term", "place")]]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, schema)], schema=schema)

    return run


def _counted(batches: Iterator[pa.RecordBatch], numeric: bool, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in (record, slice) order -> subtrees.  The last group of a batch waits for the next, as it may go on there."""
    trie, held = BurstTrie(), None

    def count(batch: pa.RecordBatch) -> None:
        sizes = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
        group = np.repeat(np.cumsum(_steps(_codes(batch.column("record"))[0], _codes(batch.column("slice"))[0])), sizes)
        term, words = _codes(batch.column("terms").flatten())
        place = _codes(batch.column("places").flatten())[0]
        order = np.lexsort((place, group, term))
        term, group, place = term[order], group[order], place[order]
        first = np.flatnonzero(_steps(term))
        if len(first):
            occ = np.add.reduceat(_steps(term, group, place).astype(np.int64), first).tolist()
            rec = np.add.reduceat(_steps(term, group).astype(np.int64), first).tolist()
            for t, o, r in zip(term[first].tolist(), occ, rec):
                trie.add(int_key(t) if numeric else words[t].encode(), o, r)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        new = _steps(_codes(batch.column("record"))[0], _codes(batch.column("slice"))[0])
        cut = int(np.flatnonzero(new)[-1])
        held = batch.slice(cut)
        if cut:
            count(batch.slice(0, cut))
        if trie.size >= HELD:
            yield from _sent(trie, arrow)
            trie = BurstTrie()
    if held is not None:
        count(held)
    yield from _sent(trie, arrow)


def _sent(trie: BurstTrie, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = list(trie.subtrees())
    for k in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 256]), arrow)], schema=arrow)


def choose_routes(weights: dict[bytes, int], target: int = ROUTE_TERMS, most: int = MAX_ROUTES) -> dict[bytes, int]:
    """Prefixes of at most two bytes, split where more than ``target`` terms lie below; at most ``most`` + 256 of them."""
    total: dict[bytes, int] = {}
    for p, n in weights.items():
        for k in range(len(p) + 1):
            total[p[:k]] = total.get(p[:k], 0) + n
    routes, work = {b""}, [b""]
    while work and len(routes) < most:
        work.sort(key=lambda p: total.get(p, 0))
        p = work.pop()
        if total.get(p, 0) <= target or len(p) == 2:
            continue
        below = [q for q in total if len(q) == len(p) + 1 and q.startswith(p)]
        routes.update(below)
        work += below
    return {p: k for k, p in enumerate(sorted(routes))}


def deeper_routes(trees: DataFrame, routes: dict[bytes, int], weights: dict[bytes, int], target: int = ROUTE_TERMS, most: int = MAX_ROUTES, step: int = 2) -> dict[bytes, int]:
    """Routes below those that are still too heavy, ``step`` bytes further each time, until none is or ``most`` are made.

    Only prefixes that carry a fair part of a route's terms come to the driver, the heaviest first and at most ``most``;
    terms below the others stay on the route above.
    """
    heavy, depth = [p for p, n in weights.items() if len(p) == step and n > target], step
    whole = F.explode(F.transform("tails", lambda t: F.concat(F.col("prefix"), t))).alias("term")
    while heavy and len(routes) < most:
        above = F.substring("term", 1, depth)
        known = trees.sparkSession.createDataFrame([(bytearray(p),) for p in heavy], "above binary")
        heads = trees.select(whole).select(above.alias("above"), F.substring("term", 1, depth + step).alias("head")).where(F.length("head") > depth)
        counts = heads.join(F.broadcast(known), "above").groupBy("head").count().where(F.col("count") > target // 16)
        found = {bytes(r.head): r["count"] for r in counts.orderBy(F.desc("count"), "head").limit(most - len(routes)).collect()}
        for p in sorted(found):
            routes[p] = len(routes)
        depth += step
        heavy = [p for p, n in found.items() if len(p) == depth and n > target]
    return routes


def _route(batches: Iterator[pa.RecordBatch], routes: dict[bytes, int], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    longest = max(map(len, routes))
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pydict()
            prefix, parts = row["prefix"][0], {}
            for tail, o, r in zip(row["tails"][0], row["occ"][0], row["rec"][0]):
                head = (prefix + tail)[:longest]
                while head not in routes:
                    head = head[:-1]
                parts.setdefault(routes[head], []).append((tail, o, r))
            out += [(route, prefix, *map(list, zip(*p))) for route, p in parts.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)


def _merged(batches: Iterator[pa.RecordBatch], numeric: bool, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    trie = BurstTrie()
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pydict()
            trie.graft(row["prefix"][0], zip(row["tails"][0], row["occ"][0], row["rec"][0]))
    for prefix, tails, occ, rec in trie.subtrees():
        keys = [prefix + t for t in tails]
        terms = [key_int(k) for k in keys] if numeric else [k.decode() for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(terms, arrow.field(0).type), pa.array(occ, pa.int64()), pa.array(rec, pa.int64())], schema=arrow)


def term_counts(df: DataFrame, term: str, record: str, place: str, rare_below: int = 3, common_share: float = 0.2, route_terms: int = ROUTE_TERMS) -> DataFrame:
    """``term, n_occ, n_records, mark`` for every term: 'rare' in fewer than ``rare_below`` records, 'common' in more than
    ``common_share`` of all, else null; 'rare' goes before 'common'.

    ``term`` is a string or an integer column.  Rows with a null term, record or place count nothing; a repeated
    (record, place, term) counts once.  The share is of the records that hold any term.  No rows give no rows; other columns are
    ignored, whatever their names.
    """
    spark = df.sparkSession
    kind = df.schema[term].dataType
    numeric = not isinstance(kind, T.StringType)
    tasks = shuffle_partitions(spark)
    rows = df.select(df[term].alias("term"), df[record].alias("record"), df[place].alias("place")).dropna()
    sub, routed = to_arrow_schema(_SUBTREE), to_arrow_schema(_ROUTED)
    out = T.StructType([T.StructField(term, T.LongType() if numeric else T.StringType()), T.StructField("n_occ", T.LongType()), T.StructField("n_records", T.LongType())])
    final = to_arrow_schema(out)

    per = materialize(rows.groupBy("record").count())
    n_rows, total = per.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    # Fewer than 4 * tasks records can hold that share of the rows.
    heavy = [r.record for r in per.where(F.col("count") > max(HEAVY_ROWS, n_rows / (4 * tasks))).select("record").collect()]
    part = F.when(F.col("record").isin(heavy), F.pmod(F.xxhash64("term"), F.lit(SLICES)).cast("int")).otherwise(F.lit(0)) if heavy else F.lit(0)
    gathered = T.StructType([T.StructField("record", rows.schema["record"].dataType), T.StructField("slice", T.IntegerType()), T.StructField("terms", T.ArrayType(rows.schema["term"].dataType)), T.StructField("places", T.ArrayType(rows.schema["place"].dataType))])
    packed = rows.withColumn("slice", part).mapInArrow(_gathered(to_arrow_schema(gathered)), gathered)
    ordered = packed.repartition(tasks, "record", "slice").sortWithinPartitions("record", "slice")
    trees = materialize(ordered.mapInArrow(lambda b: _counted(b, numeric, sub), _SUBTREE))
    heads = trees.select(F.explode(F.transform("tails", lambda t: F.substring(F.concat(F.col("prefix"), t), 1, 2))).alias("head"))
    # At most 65,793 heads of up to two bytes exist.
    weights = {bytes(r.head): r["count"] for r in heads.groupBy("head").count().collect()}
    routes = deeper_routes(trees, choose_routes(weights, route_terms), weights, route_terms)
    merged = trees.mapInArrow(lambda b: _route(b, routes, routed), _ROUTED).repartition(tasks, "route").mapInArrow(lambda b: _merged(b, numeric, final), out)
    part = Fraction(common_share).limit_denominator(10_000)
    mark = F.when(F.col("n_records") < rare_below, F.lit("rare")).when(F.col("n_records") * part.denominator > part.numerator * total, F.lit("common"))
    return merged.withColumn("mark", mark)
