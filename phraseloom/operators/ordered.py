"""Exact global ranks without a single partition, and ordered-map look-ups over keyed counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from phraseloom.session import materialize, shuffle_partitions


def ranked(df: DataFrame, order: list[str], name: str = "rank", start: int = 0, partitions: int | None = None) -> DataFrame:
    """Rows with their 0-based place in the total order of ``order`` (plus ``start``).

    Range partitions are sorted and written once; a row's rank is its place in its partition plus the sizes of the
    partitions before, of which there are as many as partitions.  Without ties over ``order`` the result is unique;
    put a unique column last, which also lets equal keys spread over partitions.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    written = materialize(placed)
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in written.groupBy(part.alias("p")).count().collect()}
    offsets, total = [], start
    for p in range(max(sizes, default=0) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    return written.withColumn(name, F.get(F.lit(offsets), part.cast("int")) + row).drop("__at")


def _runs(keys: list[str], levels: list[int], arrow: pa.Schema):
    """Rows in key order -> the same rows with their place, where the run of equal keys began, and whether it has others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last, began = TaskContext.get().partitionId(), 0, None, [0] * len(levels)
        held: pa.RecordBatch | None = None

        def out(batch: pa.RecordBatch, n: int, end: bool = False) -> pa.RecordBatch:
            nonlocal at, last, began
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            place = np.arange(at, at + batch.num_rows)
            starts, fresh, upto = [], np.zeros(batch.num_rows, bool), 0
            for k, level in enumerate(levels):
                for c, before in zip(cols[upto:level], (last or [None] * len(keys))[upto:level]):
                    fresh[1:] |= c[1:] != c[:-1]
                    fresh[0] |= before is None or c[0] != before
                upto = level
                starts.append(np.maximum.accumulate(np.where(fresh, place, began[k])))
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            at, last, began = at + n, [c[n - 1] for c in cols], [int(s[n - 1]) for s in starts]
            extra = [np.full(n, part, np.int32), place[:n], *[s[:n] for s in starts], tied[:n], np.full(n, end)]
            return pa.RecordBatch.from_arrays([*batch.slice(0, n).columns, *map(pa.array, extra)], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if batch.num_rows > 1:  # the last row waits for its neighbour
                yield out(batch, batch.num_rows - 1)
            held = batch.slice(batch.num_rows - 1)
        if held is not None:
            yield out(held, 1, True)

    return run


def tied_ranks(df: DataFrame, keys: list[str], tail: list[str], levels: list[int] | None = None, partitions: int | None = None) -> tuple[DataFrame, int]:
    """Rows in the total order of ``keys`` and ``tail`` with ``rank``, ``first_L..`` and ``tied``, and their number.

    ``first_L`` is the rank of the first row with the same leading ``L`` keys (``levels``, by default all keys) and
    ``tied`` tells whether another row has the same keys.  Keys are integers without nulls.  One range shuffle: the
    rows' runs are marked as the sorted partitions are written, and runs that cross a border are joined up from one
    head and foot per partition.  ``tail`` makes the order unique, so a run of any length spreads over partitions.
    """
    levels = levels or [len(keys)]
    n = partitions or shuffle_partitions(df.sparkSession)
    marks = [T.StructField("__part", T.IntegerType()), T.StructField("__row", T.LongType()), *[T.StructField(f"__f{v}", T.LongType()) for v in levels], T.StructField("__tied", T.BooleanType()), T.StructField("__end", T.BooleanType())]
    schema = T.StructType([*df.schema.fields, *marks])
    placed = df.repartitionByRange(n, *keys, *tail).sortWithinPartitions(*keys, *tail)
    written = materialize(placed.mapInArrow(_runs(keys, levels, to_arrow_schema(schema)), schema))
    heads, feet = {}, {}
    for r in written.where("__row = 0 or __end").select("__part", "__row", "__end", *[f"__f{v}" for v in levels], *keys).collect():
        if r["__row"] == 0:
            heads[r["__part"]] = [r[k] for k in keys]
        if r["__end"]:
            feet[r["__part"]] = ([r[k] for k in keys], r["__row"] + 1, {v: r[f"__f{v}"] for v in levels})
    size = max(heads, default=0) + 1
    offset, carry = [0] * size, {v: [0] * size for v in levels}
    goes_on, came_on, last_run = [False] * size, [False] * size, [0] * size
    total, before = 0, None
    for p in sorted(heads):
        offset[p], foot = total, feet[before] if before is not None else None
        for v in levels:
            carry[v][p] = total
            if foot and heads[p][:v] == foot[0][:v]:
                carry[v][p] = carry[v][before] if foot[2][v] == 0 else offset[before] + foot[2][v]
        came_on[p] = foot is not None and heads[p] == foot[0]
        if came_on[p]:
            goes_on[before] = True
        last_run[p] = feet[p][2][levels[-1]]
        total, before = total + feet[p][1], p

    def of(values: list):
        return F.get(F.lit(values), F.col("__part"))

    full = F.col(f"__f{levels[-1]}")
    first = {f"first_{v}": F.when(F.col(f"__f{v}") == 0, of(carry[v])).otherwise(of(offset) + F.col(f"__f{v}")).cast("bigint") for v in levels}
    tied = F.col("__tied") | ((full == 0) & of(came_on)) | ((full == of(last_run)) & of(goes_on))
    out = written.withColumns({"rank": (of(offset) + F.col("__row")).cast("bigint"), **first, "tied": tied})
    return out.select(*df.columns, "rank", *first, "tied"), total


def running_total(df: DataFrame, key: str, value: str, name: str = "cum_before", partitions: int | None = None) -> DataFrame:
    """Rows with the sum of ``value`` over all smaller ``key``s (keys are distinct), without a single partition.

    As in :func:`ranked`: sorted range partitions are written once, and the partitions' sums are added up beforehand.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    placed = df.repartitionByRange(n, key).withColumn("__part", F.spark_partition_id())
    written = materialize(placed)
    sums = {r[0]: r[1] for r in written.groupBy("__part").agg(F.sum(value)).collect()}
    offsets, total = [], 0
    for p in range(max(sums, default=0) + 1):
        offsets.append(total)
        total += sums.get(p) or 0
    before = Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum(value).over(before), F.lit(0).cast("bigint"))
    return written.withColumn(name, here + F.get(F.lit(offsets), F.col("__part")).cast("bigint")).drop("__part")


def children_sums(counts: DataFrame, parent: list[str], key: str, count: str) -> DataFrame:
    """Counts per child with ``cum_before``: the sum over the parent's children with smaller keys."""
    before = Window.partitionBy(*parent).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("cum_before", F.coalesce(F.sum(count).over(before), F.lit(0).cast("bigint")))


def key_at(sums: DataFrame, places: DataFrame, parent: list[str], count: str) -> DataFrame:
    """The child that holds the ``k``-th member of its parent, and the place within it: ``parent.., k, <child>.., rest``."""
    both = places.join(sums, parent)
    return both.where((F.col("k") >= F.col("cum_before")) & (F.col("k") < F.col("cum_before") + F.col(count))).withColumn("rest", F.col("k") - F.col("cum_before"))


class OrderedMap:
    """A map from key to count with order statistics, held as a DataFrame ``key, n``."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def put(self, key, n: int = 0) -> OrderedMap:
        """Insert a key or replace its count."""
        row = self.df.sparkSession.createDataFrame([(key, n)], self.df.schema)
        return OrderedMap(self.df.where(F.col("key") != key).unionByName(row))

    def add(self, key, n: int) -> OrderedMap:
        """Add to a key's count, inserting the key where it is new."""
        row = self.df.sparkSession.createDataFrame([(key, n)], self.df.schema)
        return OrderedMap(self.df.unionByName(row).groupBy("key").agg(F.sum("n").alias("n")).select(*self.df.columns))

    def contains(self, key) -> bool:
        return not self.df.where(F.col("key") == key).isEmpty()

    def find(self, key) -> int | None:
        row = self.df.where(F.col("key") == key).first()
        return row.n if row else None

    def count(self) -> int:
        return self.df.count()

    def empty(self) -> bool:
        return self.df.isEmpty()

    def size(self) -> int:
        """The sum of all counts."""
        return self.df.agg(F.sum("n")).first()[0] or 0

    def walk(self) -> DataFrame:
        """Keys ascending."""
        return self.df.orderBy("key")

    def at(self, k: int):
        """The key that holds the ``k``-th unit in key order, and the place within it."""
        sums = running_total(self.df, "key", "n")
        row = sums.where((F.col("cum_before") <= k) & (F.col("cum_before") + F.col("n") > k)).first()
        return (row.key, k - row.cum_before) if row else None
