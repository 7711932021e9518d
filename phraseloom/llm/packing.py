"""Fill fixed-capacity containers with texts: a grouping genetic algorithm on islands with elite migration.

Sizes are token counts of a public tokenizer.  A text above the capacity is cut into full pieces, each a container of
its own, and a remainder that is packed like any other item.  Items are spread over shards of bounded size by hash;
each shard is evolved by several islands, which start from different solutions and exchange their best ones along a
ring between epochs, until the shard has as few containers as its tokens need or an epoch helps no island.  Selection
prefers fewer containers, then fuller full ones, so the room left over gathers in few containers of a shard.  All that are
not full are opened again, and their items packed over all shards by a further level of the same kind, which starts from
what it got among others, until one shard is left.
"""

from __future__ import annotations

import base64
import gc
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from phraseloom.session import materialize, scratch

TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
CAPACITY = 2048
SHARD_ITEMS = 4096
#: ``EPOCHS`` is the least number of epochs, so that islands meet; ``GENERATIONS`` are those of one epoch.
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 2, 16, 8


@lru_cache(maxsize=2)
def _encoder(path: str):
    """A tiktoken encoder from a rank file; the splitting pattern is that of the files' package."""
    import importlib.util

    import tiktoken

    spec = importlib.util.spec_from_file_location("tokenizer_files", os.path.join(os.path.dirname(path), "__init__.py"))
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = f"{TOKENIZERS}/{TOKENIZER}") -> DataFrame:
    """``id_col, n_tokens`` of every row; a null or empty text has 0 tokens."""
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("n_tokens", T.LongType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encode = _encoder(tokenizer).encode_ordinary
            n = [len(encode(t)) if t else 0 for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(arrow.field(0).type), pa.array(n, pa.int64())], schema=arrow)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).mapInArrow(run, out).withColumnRenamed("id", id_col)


class Packing:
    """One solution: containers as item lists, with their loads; it stays as it is once its cost is known."""

    __slots__ = ("bins", "loads", "_cost")

    def __init__(self, bins: list[list[int]], loads: list[int]) -> None:
        self.bins, self.loads, self._cost = bins, loads, None

    def cost(self, capacity: int) -> tuple[int, int]:
        """Fewer containers first, then fuller full ones; whole numbers, so that equal fillings are equal in any order."""
        if self._cost is None:
            self._cost = len(self.bins), -sum(map(mul, self.loads, self.loads))
        return self._cost

    def assignment(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int32)
        for b, items in enumerate(self.bins):
            out[items] = b
        return out


def best_fit(items: list[int], sizes: list[int], capacity: int, start: Packing | None = None) -> Packing:
    """Put each item, in the order given, where least room is left over."""
    bins = start.bins if start else []
    loads = start.loads if start else []
    # Room and container as one number, and one above all; full containers are left out, as every item has a size.
    w = (len(bins) + len(items)).bit_length()
    mask, end = (1 << w) - 1, capacity + 1 << w
    room = sorted([(capacity - load << w) + b for b, load in enumerate(loads) if load < capacity])
    room.append(end)
    for i in items:
        size = sizes[i]
        k = bisect_left(room, size << w)
        x = room[k]
        if x < end:
            del room[k]
            b = x & mask
            bins[b].append(i)
            loads[b] += size
        else:
            b = len(bins)
            x = (capacity << w) + b
            bins.append([i])
            loads.append(size)
        x -= size << w
        if x > mask:
            insort(room, x)
    return Packing(bins, loads)


def from_assignment(at: np.ndarray, sizes: list[int]) -> Packing:
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    bins = [p.tolist() for p in np.split(order, cuts)] if len(at) else []
    return Packing(bins, [sum(sizes[i] for i in b) for b in bins])


def exchange(p: Packing, free: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Swap one item of each container with room for the free item that fills it most; the items free then, largest first."""
    n = len(sizes)
    left = sorted([sizes[i] * n + i for i in free])
    for b in sorted((b for b, load in enumerate(p.loads) if load < capacity), key=lambda b: -p.loads[b]):
        room, gain, best = capacity - p.loads[b], 0, (0, 0)
        for at, i in enumerate(p.bins[b]):
            k = bisect_left(left, (sizes[i] + room + 1) * n) - 1
            if k >= 0 and left[k] // n - sizes[i] > gain:
                gain, best = left[k] // n - sizes[i], (at, k)
                if gain == room:
                    break
        if gain:
            at, k = best
            i, p.bins[b][at] = p.bins[b][at], left.pop(k) % n
            p.loads[b] += gain
            insort(left, sizes[i] * n + i)
    return [x % n for x in reversed(left)]


def _cost_of(at: np.ndarray, sizes: list[int]) -> tuple[int, int]:
    """:meth:`Packing.cost` of an assignment."""
    loads = [int(x) for x in np.bincount(at, weights=sizes) if x]
    return len(loads), -sum(map(mul, loads, loads))


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Inject well-filled containers of ``b`` into ``a``; what they displace is exchanged and put back by best fit."""
    by_fill = sorted(range(len(b.bins)), key=b.loads.__getitem__, reverse=True)
    good = by_fill[: max(1, len(by_fill) // 2)]
    take = rng.choice(len(good), size=max(1, len(good) // 4), replace=False)
    injected = [b.bins[good[k]] for k in take]
    owned = set().union(*injected)
    bins, loads, displaced = [items[:] for items in injected], [b.loads[good[k]] for k in take], []
    for items, load in zip(a.bins, a.loads):
        if owned.isdisjoint(items):
            bins.append(items[:])
            loads.append(load)
        else:
            displaced += items
    child = Packing(bins, loads)
    return best_fit(exchange(child, [*set(displaced) - owned], sizes, capacity), sizes, capacity, child)


def mutate(p: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Empty some of the least filled containers and some others, one to a twentieth of all each; their items are
    exchanged and put back by best fit."""
    by_fill = sorted(range(len(p.bins)), key=p.loads.__getitem__)
    low, other = (round(max(1, len(by_fill) // 20) ** x) for x in rng.random(2))
    gone = {*by_fill[:low], *rng.choice(len(by_fill), size=other, replace=False).tolist()}
    free = [i for k in gone for i in p.bins[k]]
    kept = [k for k in range(len(p.bins)) if k not in gone]
    child = Packing([p.bins[k][:] for k in kept], [p.loads[k] for k in kept])
    return best_fit(exchange(child, free, sizes, capacity), sizes, capacity, child)


def starts(sizes: list[int], capacity: int, rng: np.random.Generator, population: int) -> list[Packing]:
    """Different solutions: best fit by falling size, and best fit by falling size blurred more and more."""
    down = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    pool = [best_fit(down, sizes, capacity)]
    while len(pool) < population:
        blur = np.array(sizes) * rng.uniform(1 - 0.2 * len(pool), 1.0, len(sizes))
        pool.append(best_fit(np.argsort(-blur, kind="stable").tolist(), sizes, capacity))
    return pool


def evolve(sizes: list[int], capacity: int, known: list[np.ndarray], seed: tuple[int, ...], generations: int = GENERATIONS, population: int = POPULATION) -> tuple[list[Packing], int]:
    """One epoch of an island: its solutions, best first, and the generations that it ran.  It starts from the ``known``
    solutions, and different ones of its own if they are fewer than the population.

    Solutions that have the fewest containers possible go on to be improved, as their rest is packed with other shards';
    only one whose containers are all full but one can't be.
    """
    rng = np.random.default_rng(list(seed))
    pool = [from_assignment(at, sizes) for at in known]
    if len(pool) < population:
        pool += starts(sizes, capacity, rng, population - len(pool))
    for done in range(generations):
        best = min(pool, key=lambda p: p.cost(capacity))
        if sum(load < capacity for load in best.loads) <= 1:
            return sorted(pool, key=lambda p: p.cost(capacity)), done
        young = []
        for _ in range(population):
            a, b = rng.choice(len(pool), size=2, replace=False) if len(pool) > 1 else (0, 0)
            child = crossover(pool[a], pool[b], sizes, capacity, rng)
            young.append(mutate(child, sizes, capacity, rng) if rng.random() < 0.5 else child)
        pool = sorted(pool + young, key=lambda p: p.cost(capacity))[:population]
    return pool, generations


_STATE = "shard bigint, island int, sizes array<int>, pool array<array<int>>, n_bins int, fill double, n_fit int, generations int, ended boolean, gained boolean"


def _epoch(capacity: int, epoch: int):
    arrow = to_arrow_schema(T._parse_datatype_string(_STATE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pydict()
                sizes = row["sizes"][0]
                known = [np.array(p, np.int32) for p in row["pool"][0] or []]
                if not epoch and row["was"][0][0] is not None:
                    known = [np.unique(row["was"][0], return_inverse=True)[1]]
                before = min((_cost_of(at, sizes) for at in known), default=None)
                # Solutions are lists without cycles; the collector would only walk through them.
                gc.disable()
                try:
                    pool, ran = evolve(sizes, capacity, known, (row["shard"][0], row["island"][0], epoch))
                finally:
                    gc.enable()
                bins, fill = pool[0].cost(capacity)
                got = [p.assignment(len(sizes)).tolist() for p in pool]
                fit = row["n_fit"][0]
                if not epoch and not row["island"][0]:
                    fit = len(best_fit(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sizes, capacity).bins)
                least = bins == -(-sum(sizes) // capacity)
                yield pa.RecordBatch.from_pydict({"shard": row["shard"], "island": row["island"], "sizes": [sizes], "pool": [got], "n_bins": [bins], "fill": [-float(fill)], "n_fit": [fit], "generations": [(row["generations"][0] or 0) + ran], "ended": [least], "gained": [before is None or (bins, fill) < before]}, schema=arrow)

    return run


def _evolved(members: DataFrame, shards: int, capacity: int, islands: int, epochs: int) -> DataFrame:
    """``shard, bins, n_bins, n_fit, generations``: the best solution of each shard's islands.

    A shard's islands go on, after ``epochs``, until one has as few containers as the tokens need or none has gained in an
    epoch.
    """
    spark = members.sparkSession
    none = [F.lit(None).cast("array<array<int>>").alias("pool"), F.lit(None).cast("int").alias("n_fit"), F.lit(0).alias("generations")]
    of_items = [F.expr("transform(members, m -> m.size)").alias("sizes"), F.expr("transform(members, m -> m.was)").alias("was")]
    state = members.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), *of_items, *none)
    best = F.max_by(F.col("pool")[0], F.struct(-F.col("n_bins"), "fill", -F.col("island")))
    of_shard = Window.partitionBy("shard")
    ring = of_shard.orderBy("island")
    all_of = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    elite = F.coalesce(F.lag(F.col("pool")[0]).over(ring), F.last(F.col("pool")[0]).over(all_of))
    done, epoch, left = None, 0, shards
    with scratch(spark):
        while left:
            tasks = min(left * islands, 4 * spark.sparkContext.defaultParallelism * max(1, left // 4096 + 1))
            state = materialize(state.repartition(tasks, "shard", "island").mapInArrow(_epoch(capacity, epoch), _STATE))
            epoch += 1
            if epoch >= epochs:
                over = F.max("ended") | ~F.max("gained")
                told = state.groupBy("shard").agg(best.alias("bins"), F.min("n_bins").alias("n_bins"), F.min("n_fit").alias("n_fit"), F.sum("generations").alias("generations"), over.alias("over"))
                done = told.where("over") if done is None else done.unionByName(told.where("over"))
                left = told.where("not over").count()
                state = state.withColumn("over", F.max("ended").over(of_shard) | ~F.max("gained").over(of_shard)).where("not over")
            state = state.withColumn("elite", elite).select("shard", "island", "sizes", F.concat(F.array("elite"), "pool").alias("pool"), "n_fit", "generations")
        return materialize(done.drop("over"), keep=True)


def pack_levels(counts: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`pack`, and ``level, n_shards, n_fit, n_evolved, generations`` of each level: containers by best fit
    alone, containers after the generations that all islands ran, both before the level's part-filled ones are opened again."""
    spark = counts.sparkSession
    held = counts.select(F.col(id_col).alias("id"), F.col("n_tokens").alias("n")).groupBy("id", "n").agg(F.count(F.lit(1)).alias("m"))
    apart = F.when(F.col("id").isNull(), F.col("m")).otherwise(F.lit(1).cast("bigint"))
    items = materialize(held.select("id", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), apart)).alias("item")))
    whole = F.floor(F.col("n") / capacity).cast("bigint")
    sized = items.where("n > 0")
    full = sized.where(whole > 0).select("id", "n", "item", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("piece"))
    full = full.select("id", "piece", (F.col("piece") * capacity).alias("tok_start"), ((F.col("piece") + 1) * capacity).alias("tok_end"), F.when(F.col("id").isNull(), F.concat_ws("-", F.lit("unnamed"), "n", "item", "piece")).otherwise(F.concat_ws("-", F.lit("full"), F.col("id").cast("string"), F.col("n").cast("string"), F.col("piece").cast("string"))).alias("container"))
    out = full.unionByName(items.where("n = 0 or n is null").select("id", *[F.lit(0).cast("bigint").alias(c) for c in ("piece", "tok_start", "tok_end")], F.lit(None).cast("string").alias("container")))
    rest = sized.select("id", "n", "item", whole.alias("piece"), (F.col("n") % capacity).cast("int").alias("size"), F.lit(None).cast("string").alias("was")).where("size > 0")
    spread = F.when(F.col("id").isNull(), F.xxhash64("n", "item")).otherwise(F.xxhash64("id", "n"))
    level, levels = 0, []
    left, before = sized.count(), None
    while True:
        shards = max(1, -(-left // shard_items))
        # Opened containers go whole to a shard, so that it never does worse than what it got.
        placed = rest.withColumn("shard", F.pmod(F.xxhash64(F.xxhash64("was") if level else spread, F.lit(level)), F.lit(shards)))
        # A shard holds about shard_items items, as (id, n, item) is distinct; sorting makes the order independent of the shuffle.
        members = materialize(placed.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("size", "id", "n", "piece", "item", "was"))).alias("members")))
        best = _evolved(members, shards, capacity, islands, epochs)
        levels.append(best.select(F.lit(level).alias("level"), "n_fit", "n_bins", "generations"))
        one = members.join(best.select("shard", "bins"), "shard").select("shard", F.posexplode("members").alias("k", "m"), "bins")
        one = materialize(one.select("shard", "m.*", F.element_at("bins", F.col("k") + 1).alias("bin")))
        load = one.groupBy("shard", "bin").agg((F.sum("size") < capacity).alias("open"))
        marked = one.join(load, ["shard", "bin"])
        was = F.concat_ws("-", F.col("shard").cast("string"), F.col("bin").cast("string")).alias("was")
        again = materialize(marked.where("open").select("id", "n", "item", "piece", "size", was)) if shards > 1 else None
        n_again = again.count() if again is not None else 0
        # A level that opens nearly all that it got would not end: it is the last one.
        last = again is None or (before is not None and n_again > left // 2) or n_again == 0
        kept = marked if last else marked.where("not open")
        name = F.concat_ws("-", *([F.lit(f"level{level}")] if level else []), F.col("shard").cast("string"), F.col("bin").cast("string"))
        out = out.unionByName(kept.select("id", "piece", (F.col("piece") * capacity).alias("tok_start"), F.col("n").alias("tok_end"), name.alias("container")))
        if last:
            break
        rest, before, left, level = again, left, n_again, level + 1
    stats = levels[0]
    for x in levels[1:]:
        stats = stats.unionByName(x)
    total = [F.count(F.lit(1)).alias("n_shards"), *[F.sum(a).cast("bigint").alias(b) for a, b in (("n_fit", "n_fit"), ("n_bins", "n_evolved"), ("generations", "generations"))]]
    return out.withColumnRenamed("id", id_col), stats.groupBy("level").agg(*total)


def pack(counts: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``id_col, piece, tok_start, tok_end, container`` from ``id_col, n_tokens``.

    Every item lies whole in one container unless it exceeds ``capacity``; then all its pieces but the last fill a
    container.  Rows that repeat an id and size are one item; an id with several sizes is one item per size.  Items
    without tokens need no room: their ``container`` is null.  Every row without an id is an item.  Extra columns are ignored; an empty table
    gives no rows.
    """
    return pack_levels(counts, id_col, capacity, shard_items, islands, epochs)[0]
