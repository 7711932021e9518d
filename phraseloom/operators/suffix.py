"""Suffix order over token positions.

A position is sorted by its first :data:`PREFIX` tokens, packed two to a long integer.  Positions that share them, and have
more tokens to come, are sorted on by the places of the positions 8, 16 .. 120 tokens further, then by those 128 and
more tokens away, and so on: each round looks sixteen times as far with a key of sixteen numbers, so no suffix is
ever written out and a copied text of any length costs a few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from phraseloom.functions.columns import with_eos
from phraseloom.operators.corpus import valid
from phraseloom.operators.ordered import tied_ranks
from phraseloom.schemas import EOS_VID
from phraseloom.session import materialize, scratch, shuffle_partitions

#: Leading tokens that an array keeps as columns ``v0 ..``; filters on them reach the Parquet scan.
PREFIX = 8
#: How many places a round looks up; each round sees this many times as far as the one before.
STRIDE = 16
#: Tied rows, or sentences that have some, that are broadcast (some 100 MB in a worker); more are shuffled.
BROADCAST_ROWS = 2_000_000
#: Positions of the sentences with tied rows that one task takes, some 30 MB; more are sorted in rounds over all tasks.
LOCAL_ROWS = 1_000_000
VS = [f"v{d}" for d in range(PREFIX)]
KEYS = [f"k{d}" for d in range(PREFIX // 2)]
_BITS, _LOW = 31, (1 << 31) - 1
#: Ranks whose neighbours one window finds.
_BLOCK = 1 << 16


def keyed(sents: DataFrame) -> DataFrame:
    """``sid, off, k0..``: every token's place with the eight tokens from there on, the end of sentence after the last.

    Two tokens share one number, zero stands behind the end.  Sentences of any length are taken whole.
    """
    padded = F.concat("toks", F.array(F.lit(EOS_VID), *[F.lit(0)] * (PREFIX - 1)))
    rows = valid(sents).select("sid", "toks").select("sid", padded.alias("p"), F.posexplode("toks").alias("off", "first"))

    def token(d: int) -> Column:
        return F.get("p", F.col("off") + d).cast("bigint")

    return rows.select("sid", "off", *[F.shiftleft(token(2 * j), _BITS).bitwiseOR(token(2 * j + 1)).alias(k) for j, k in enumerate(KEYS)])


def tokens_of_keys() -> dict[str, Column]:
    """``v0..`` from ``k0..``; null behind the end of sentence."""
    out = {}
    for j, k in enumerate(KEYS):
        out[VS[2 * j]] = F.nullif(F.shiftright(k, _BITS), F.lit(0)).cast("int")
        out[VS[2 * j + 1]] = F.nullif(F.col(k).bitwiseAND(F.lit(_LOW)), F.lit(0)).cast("int")
    return out


def keys_of_tokens() -> list[Column]:
    """``k0..`` from ``v0..``."""
    v = [F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in VS]
    return [F.shiftleft(v[2 * j], _BITS).bitwiseOR(v[2 * j + 1]).alias(k) for j, k in enumerate(KEYS)]


def heads(sents: DataFrame) -> DataFrame:
    """``sid, off, v0..`` of every position, in no order."""
    return keyed(sents).select("sid", "off", *[c.alias(v) for v, c in tokens_of_keys().items()])


def _ahead(width: int, arrow: pa.Schema):
    """Rows ``sid, off, g, open`` in order -> the open ones with the places ``width``, 2 ``width`` .. further; behind the end -1."""

    def out(sid: np.ndarray, off: np.ndarray, g: np.ndarray, is_open: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(is_open)
        ends = np.searchsorted(sid, sid[at], "right")
        cols = [np.where(at + width * j < ends, g[np.minimum(at + width * j, len(g) - 1)], -1) for j in range(1, STRIDE)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (sid[at], off[at], g[at], *cols)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "off", "g", "open")]
            # The last sentence may go on in the next batch.
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut or (held and held[0][0][0] != cols[0][0]):
                yield out(*(np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols])))
                held = []
            held.append([c[cut:] for c in cols])
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    return run


def _at_once(arrow: pa.Schema):
    """All rows ``sid, off, g, open`` in order -> ``rank, sid, off`` of the open ones, seeing twice as far each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "off", "g", "open")] for b in batches if b.num_rows]
        if not held:
            return
        sid, off, g, is_open = (np.concatenate(x) for x in zip(*held))
        slot = at = np.flatnonzero(is_open)
        width, g = PREFIX, g.copy()
        while len(at):
            ahead = np.where(at + width < np.searchsorted(sid, sid[at], "right"), g[np.minimum(at + width, len(g) - 1)], -1)
            order = np.lexsort((at, ahead, g[at]))
            at, ahead, place = at[order], ahead[order], np.arange(len(at))
            group = g[at]
            new_group = np.append(True, group[1:] != group[:-1])
            new = new_group | np.append(True, ahead[1:] != ahead[:-1])
            base = group - np.maximum.accumulate(np.where(new_group, place, 0))
            more = ~(new & np.append(new[1:], True)) & (ahead >= 0)
            g[at] = base + np.where(more, np.maximum.accumulate(np.where(new, place, 0)), place)
            at, width = np.sort(at[more]), 2 * width
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (g[slot], sid[slot], off[slot])], schema=arrow)

    return run


def _resolved(rows: DataFrame, n: int, held: int, local_rows: int) -> DataFrame:
    """``rank, sid, off`` of the rows that are ``open``: those that share ``PREFIX`` tokens with others and go on.

    ``rows`` are ``sid, off, g, open``: all places of the sentences with an open one, ``g`` being the rank, or for open
    rows their group's first.  ``n`` is the number of open rows (or more), ``held`` that of all.  Up to ``local_rows`` rows one task does it; the rounds
    over all tasks give the same.
    """
    order, width = ["sid", "off"], PREFIX
    if held <= local_rows:
        schema = T.StructType([T.StructField("rank", T.LongType()), T.StructField("sid", T.LongType()), T.StructField("off", T.IntegerType())])
        return rows.repartition(1).sortWithinPartitions(*order).mapInArrow(_at_once(to_arrow_schema(schema)), schema)
    state = rows.withColumn("slot", F.col("open"))
    hs, most = [f"h{j}" for j in range(1, STRIDE)], shuffle_partitions(rows.sparkSession)
    schema = T.StructType([T.StructField("sid", T.LongType()), T.StructField("off", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("g", *hs)]])
    while n:
        whole = state.select(*order, "g", "open").repartition(most, "sid").sortWithinPartitions(*order)
        left = materialize(whole.mapInArrow(_ahead(width, to_arrow_schema(schema)), schema))
        tasks = max(1, min(most, n // 10_000))
        now, _ = tied_ranks(left, ["g", *hs], order, [1, STRIDE], tasks)
        # A group's rows are contiguous among the open ones as they are among all.
        base, more = F.col("g") - F.col("first_1"), F.col("tied") & (F.col(hs[-1]) >= 0)
        fresh = now.select(*order, (base + F.when(more, F.col(f"first_{STRIDE}")).otherwise(F.col("rank"))).alias("g"), more.alias("open"), F.lit(True).alias("slot"))
        state = state.where("not open").unionByName(fresh)
        n, width = fresh.where("open").count(), width * STRIDE
    return state.where("slot").select(F.col("g").alias("rank"), *order)


def in_files(rows: DataFrame, n: int) -> DataFrame:
    """Rows with ranks 0 to ``n`` - 1 in rank order, in partitions of equal size: the bounds are known, nothing is sampled."""
    parts = max(1, min(shuffle_partitions(rows.sparkSession), n))
    return rows.repartitionById(parts, F.floor(F.col("rank") * parts / F.lit(max(n, 1))).cast("int")).sortWithinPartitions("rank")


def suffix_array(rows: DataFrame, local_rows: int = LOCAL_ROWS) -> tuple[DataFrame, int]:
    """``rank, sid, off, v0..`` written in rank order, and the number of positions: ascending token order, shorter first,
    ties in order of insertion (sid, off).

    ``rows`` come from :func:`keyed`, or from arrays by :func:`rekeyed`.  One range shuffle sorts all rows by eight tokens;
    the rest moves only rows that are still tied, and what they resolve to goes into their group's slots of the sorted
    files.  The intermediate tables are removed.
    """
    spark, order = rows.sparkSession, ["sid", "off"]
    with scratch(spark):
        now, n = tied_ranks(rows.select(*order, *KEYS), KEYS, order)
        open_ = F.col("tied") & (F.col(KEYS[-1]).bitwiseAND(F.lit(_LOW)) > EOS_VID)
        now = now.withColumn("open", open_)
        tokens = [c.alias(v) for v, c in tokens_of_keys().items()]
        g = F.when(F.col("open"), F.col(f"first_{len(KEYS)}")).otherwise(F.col("rank"))
        places, m = now.select(*order, g.alias("g"), "open"), n
        if n > local_rows:
            some = now.where("open").groupBy("sid").count()
            m, sids = some.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
            if not m:
                return materialize(now.select("rank", *order, *tokens), keep=True), n
            some = some.select("sid")
            places = materialize(places.join(F.broadcast(some) if sids <= BROADCAST_ROWS else some, "sid", "left_semi"))
        found = _resolved(places, m, n if n <= local_rows else places.count(), local_rows).select("rank", F.col("sid").alias("s"), F.col("off").alias("o"))
        closed = now.select("rank", *[F.when(~F.col("open"), F.col(c)).alias(c) for c in order], *KEYS)
        full = closed.join(F.broadcast(found) if m <= BROADCAST_ROWS else found, "rank", "left")
        if m > BROADCAST_ROWS:
            full = in_files(full, n)
        return materialize(full.select("rank", F.coalesce("sid", "s").alias("sid"), F.coalesce("off", "o").alias("off"), *tokens), keep=True), n


def rekeyed(runs: list[DataFrame]) -> DataFrame:
    """Sorted runs as rows to sort: their stored tokens are the keys, sentences are not read."""
    parts = [r.select("sid", "off", *keys_of_tokens()) for r in runs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def neighbours(sa: DataFrame) -> DataFrame:
    """``rank, prev_sid, prev_off, next_sid, next_off``.

    Each block of ranks comes together once, with the last position of the block before and the first of the one behind;
    the window runs within a block.
    """
    block = F.floor(F.col("rank") / _BLOCK)
    at = sa.select("rank", "sid", "off")
    edges = F.when(F.col("rank") % _BLOCK == 0, F.array(block - 1, block)).when(F.col("rank") % _BLOCK == _BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))
    rows = at.withColumn("b", F.explode(edges))
    w = Window.partitionBy("b").orderBy("rank")
    cols = {f"{name}_{c}": f(c).over(w) for name, f in (("prev", F.lag), ("next", F.lead)) for c in ("sid", "off")}
    return rows.withColumns(cols).where(F.col("b") == block).select("rank", *cols)


def at_ranks(sa: DataFrame, ranks: DataFrame) -> DataFrame:
    """Random access: ``ranks`` (column ``rank``) with the position there; a rank outside the array has none."""
    return ranks.join(sa.select("rank", "sid", "off"), "rank")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions that two indexes do not share: ``sid, off, v0.., only_in``; none if they are equal.

    As sets: arrays that order copies of a suffix differently are equal.
    """
    cols = ["sid", "off", *VS]
    x, y = a.select(*cols), b.select(*cols)
    return x.exceptAll(y).withColumn("only_in", F.lit("first")).unionByName(y.exceptAll(x).withColumn("only_in", F.lit("second")))


def suffix_text() -> Column:
    """The tokens of a sentence from ``off`` on and its end; for rows with ``toks`` and ``off``."""
    return F.slice(with_eos(F.col("toks")), F.col("off") + 1, F.size("toks") + 1)
