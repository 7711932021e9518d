"""Per-key results when a few keys hold most of the rows: two-stage salted aggregation."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseloom.session import materialize

SALTS = 64


def salted_counts(df: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """``key, n_rows`` of every key, null included, in one read: stage one counts per (key, salt), stage two adds up.

    The salt is the number of the task that reads the row, so it costs no partial row that plain partial counts would
    not make, and a heavy key's partials go to ``salts`` tasks, not to one.  Counts do not depend on it.
    """
    rows = df.select(F.col(key).alias("__key"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("__salt"))
    first = rows.groupBy("__key", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    return first.groupBy(F.col("__key").alias(key)).agg(F.sum("__n").alias("n_rows"))


def heavy_keys(df: DataFrame, key: str, share: float) -> list:
    """Non-null keys that hold at least ``share`` of all rows: at most ``1 / share``, which bounds what reaches the driver."""
    counts = materialize(salted_counts(df, key))
    n = counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    return [r[0] for r in counts.where(F.col(key).isNotNull() & (F.col("n_rows") >= share * n)).select(key).collect()] if n else []


def salted_aggregate(
    df: DataFrame,
    key: str,
    distinct: str | None = None,
    low: str | None = None,
    high: str | None = None,
    share: float = 0.005,
    salts: int = SALTS,
    heavy: list | None = None,
    salt_by: list[str] | None = None,
) -> DataFrame:
    """Per ``key``: ``n_rows``, ``n_distinct`` of ``distinct``, least ``low`` and greatest ``high``.

    Heavy keys (``share`` of all rows or more) are salted by a hash of their ``distinct`` value: stage one aggregates per
    (key, salt), where a value always gets the same salt, so distinct counts add up and a retried task repeats its result;
    stage two merges the partials.  No task sees more of a heavy key than about ``1 / salts`` of its distinct values.  Without ``distinct`` the salt comes from the
    columns ``salt_by`` (all, if not given).

    Null keys are left out; null values count as rows but not as distinct values, lows or highs.  Repeated rows count
    each.  An empty table gives no rows.  Columns called ``salt`` or ``n`` in the input do no harm.
    """
    heavy = heavy_keys(df, key, share) if heavy is None else heavy
    cols = {"__d": distinct, "__lo": low, "__hi": high}
    seen = F.col(distinct) if distinct else F.struct(*(salt_by or df.columns))
    hash_ = F.pmod(F.xxhash64(seen), F.lit(salts)).cast("int")
    salt = F.when(F.col(key).isin(heavy), hash_).otherwise(F.lit(0)) if heavy else F.lit(0)
    some = df.where(F.col(key).isNotNull())
    ends = [F.min("__lo").alias("__lo")] * bool(low) + [F.max("__hi").alias("__hi")] * bool(high)
    rows = some.select(F.col(key).alias("__key"), salt.alias("__salt"), *[F.col(c).alias(n) for n, c in cols.items() if c])
    if distinct:
        # The salt follows from key and value, so it is made behind the shuffle of their pairs and isn't moved.
        pairs = rows.drop("__salt").groupBy("__key", "__d").agg(F.count(F.lit(1)).alias("__n"), *ends)
        again = F.when(F.col("__key").isin(heavy), F.pmod(F.xxhash64("__d"), F.lit(salts)).cast("int")).otherwise(F.lit(0)) if heavy else F.lit(0)
        first = pairs.withColumn("__salt", again).groupBy("__key", "__salt").agg(F.sum("__n").alias("__n"), F.count("__d").alias("__d"), *ends)
    else:
        first = rows.groupBy("__key", "__salt").agg(F.count(F.lit(1)).alias("__n"), *ends)
    out = [F.sum("__n").alias("n_rows")]
    out += [F.sum("__d").alias("n_distinct")] * bool(distinct)
    out += [F.min("__lo").alias("lowest")] * bool(low) + [F.max("__hi").alias("highest")] * bool(high)
    return first.groupBy(F.col("__key").alias(key)).agg(*out)


def hot_keys(df: DataFrame, key: str, share: float, salts: int = SALTS) -> DataFrame:
    """Keys with at least ``share`` of all rows (null keys count in the total): ``key, n_rows``.

    The table is read once: the salted counts, a row a key, give the total too.
    """
    counts = materialize(salted_counts(df, key, salts))
    total = counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    part = Fraction(share).limit_denominator(10_000)
    return counts.where(F.col(key).isNotNull() & (F.col("n_rows") * part.denominator >= part.numerator * total))
