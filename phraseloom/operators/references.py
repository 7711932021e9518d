"""References to records that do not exist: run-compressed parent keys, as-of matched by the referring side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phraseloom.session import materialize

#: Keys of one block are compressed together.  A block bounds what one task sorts: parents and references are distinct
#: per key by then, so it holds at most twice this many rows, however skewed the references are.
BLOCK = 1 << 16
INVALID_LINK = 255


def _block(key: str) -> Column:
    return F.floor(F.col(key) / F.lit(BLOCK))


def key_runs(parents: DataFrame, group: list[str], key: str, state: str | None = None, unique: bool = False) -> DataFrame:
    """Compress distinct integer ``key``s into contiguous runs: ``group.., blk, run_start, run_end[, state]``.

    Runs end at block borders and, with ``state``, where the state changes.  Null keys make no run; repeated keys count
    once (``unique``: there are none); no rows give no runs.
    """
    cols = [*group, key] + [state] * (state is not None)
    keys = parents.where(F.col(key).isNotNull()).select(*cols)
    keys = (keys if unique else keys.distinct()).withColumn("blk", _block(key))
    by = Window.partitionBy(*group, "blk").orderBy(key)
    fresh = F.coalesce(F.lag(key).over(by) != F.col(key) - 1, F.lit(True))
    if state:
        fresh = fresh | ~F.lag(state).over(by).eqNullSafe(F.col(state))
    marked = keys.withColumn("__new", fresh.cast("int"))
    runs = marked.withColumn("__run", F.sum("__new").over(by))
    out = runs.groupBy(*group, "blk", "__run").agg(
        F.min(key).alias("run_start"), F.max(key).alias("run_end"), *([F.first(state).alias(state)] if state else [])
    )
    return out.drop("__run")


def asof_match(refs: DataFrame, runs: DataFrame, group: list[str], key: str, carry: list[str], state: str | None = None) -> DataFrame:
    """Match every reference to the last run that starts at or before it.

    ``refs`` must be distinct on ``group + key``.  Returns ``group.., key, carry.., run_start, run_end[, state], found``
    where ``found`` is whether the key lies within that run.
    """
    extra = [state] if state else []
    left = refs.select(*group, key, *carry, _block(key).alias("blk"), F.lit(1).alias("__kind"), F.lit(None).cast("struct<run_start:bigint,run_end:bigint" + (f",{state}:boolean" if state else "") + ">").alias("__run"))
    nothing = [F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in carry]
    right = runs.select(*group, F.col("run_start").alias(key), *nothing, "blk", F.lit(0).alias("__kind"), F.struct(F.col("run_start").cast("bigint").alias("run_start"), F.col("run_end").cast("bigint").alias("run_end"), *extra).alias("__run"))
    by = Window.partitionBy(*group, "blk").orderBy(key, "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("__at", F.last("__run", ignorenulls=True).over(by))
    return (
        both.where("__kind = 1")
        .select(*group, key, *carry, "__at.*")
        .withColumn("found", F.coalesce(F.col("run_end") >= F.col(key), F.lit(False)))
    )


def sentence_parents(corpus: DataFrame) -> DataFrame:
    """One row per (side, sid): earliest arrival, whether any row deletes it, its token count (null: no toks)."""
    return (
        corpus.where("side is not null and sid is not null")
        .groupBy("side", "sid")
        .agg(
            F.min("ingested_at").alias("arrived"),
            F.max(F.col("deleted_at").isNotNull()).alias("deleted"),
            F.max(F.when(F.col("toks").isNotNull(), F.size("toks"))).alias("n_tok"),
        )
    )


def referenced_state(keys: DataFrame, parents: DataFrame) -> DataFrame:
    """State of each distinct referenced (side, sid): ``found, deleted, arrived, n_tok``."""
    runs = key_runs(parents, ["side"], "sid", "deleted", unique=True)
    at = asof_match(keys, runs, ["side"], "sid", ["first_ref"], "deleted")
    known = parents.select("side", "sid", "arrived", "n_tok").withColumn("found", F.lit(True))
    # Whether a key is found is the runs' word; arrival and length are looked up for found keys only.
    return at.select("side", "sid", "first_ref", "found", F.when(F.col("found"), F.col("deleted")).alias("deleted")).join(known, ["side", "sid", "found"], "left")


def _reason(at: str) -> Column:
    return (
        F.when(~F.col("found"), F.lit("missing"))
        .when(F.col("deleted"), F.lit("deleted"))
        .when(F.col("arrived") > F.col(at), F.lit("later"))
    )


def orphan_references(corpus: DataFrame, alignment: DataFrame, sampled_positions: DataFrame, salts: int = 16) -> DataFrame:
    """Orphan references of alignments, their links and samples, one distinct row each.

    Parents' keys are compressed into runs (:func:`key_runs`), references are reduced to distinct keys with their
    earliest use and as-of matched to the preceding run (:func:`asof_match`); beyond its end a key is missing.  Link
    offsets are matched the same way: a sentence's offsets are the one run ``0 .. n_tok - 1``.

    Hot keys: references are pre-aggregated per key before any shuffle, and suspect keys meet their samples in a join
    salted ``salts`` ways on both sides.  Nulls: a null ``sid`` refers to nothing; a referring record without a time is never
    'later' and has a null period; null links and null offsets refer to nothing.  Empty tables give no rows.  Extra
    columns are ignored.  Parents and the state of the referenced keys are written once, as several branches read them.
    """
    parents = materialize(sentence_parents(corpus.select("side", "sid", "ingested_at", "deleted_at", "toks")))
    aligned = (
        alignment.where("sid is not null")
        .groupBy("sid")
        .agg(F.min("ingested_at").alias("at"), F.max("links").alias("links"))
    )
    sides = F.array(F.lit("src"), F.lit("trg"))
    align_refs = aligned.select("sid", "at", F.explode(sides).alias("side"))
    samples = sampled_positions.where("sid is not null").select("sample_id", "sid", F.col("sampled_at").alias("at"))
    keys = (
        align_refs.select("side", "sid", "at")
        .unionByName(samples.select(F.lit("src").alias("side"), "sid", "at"))
        .groupBy("side", "sid")
        .agg(F.min("at").alias("first_ref"))
    )
    state = materialize(referenced_state(keys, parents))

    period = F.date_format("at", "yyyy-MM").alias("period")
    tail = ["reason", period]
    # One row per sid with both sides' states: the alignments are grouped by sid already, so their links don't move again.
    parts = [F.first(F.when(F.col("side") == s, F.struct("side", "found", "deleted", "arrived", "n_tok")), ignorenulls=True).alias(s) for s in ("src", "trg")]
    wide = state.groupBy("sid").agg(*parts)
    both = aligned.join(wide, "sid").select("sid", "at", "links", F.explode(F.array("src", "trg")).alias("s"))
    both = both.select("sid", "at", "links", "s.*").withColumn("reason", _reason("at"))
    of_alignments = both.where("reason is not null").select(
        F.lit("alignment").alias("ref_table"), F.lit("sid").alias("ref_field"), F.col("sid").alias("ref_key"), F.lit(-1).cast("bigint").alias("elem"), "side", *tail
    )
    links = both.where("reason is null and n_tok is not null and links is not null").select("sid", "at", "side", "n_tok", F.posexplode("links").alias("elem", "link"))
    place = F.when(F.col("side") == "src", F.col("link.src")).otherwise(F.col("link.trg"))
    void = (F.col("link.src") == INVALID_LINK) & (F.col("link.trg") == INVALID_LINK)
    of_links = links.where(~F.coalesce(void, F.lit(False)) & (place >= F.col("n_tok"))).select(
        F.lit("alignment").alias("ref_table"), F.col("side").alias("ref_field"), F.col("sid").alias("ref_key"), F.col("elem").cast("bigint").alias("elem"), "side", F.lit("missing").alias("reason"), period
    )
    suspects = state.where("side = 'src' and (not found or deleted or arrived > first_ref)")
    suspects = suspects.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = samples.withColumn("salt", F.pmod(F.xxhash64("sample_id", "at"), F.lit(salts)).cast("int"))
    of_samples = (
        salted.join(suspects, ["sid", "salt"])
        .withColumn("reason", _reason("at"))
        .where("reason is not null")
        .select(F.lit("sampled_positions").alias("ref_table"), F.lit("sid").alias("ref_field"), F.col("sample_id").alias("ref_key"), F.lit(-1).cast("bigint").alias("elem"), "side", *tail)
    )
    return of_alignments.unionByName(of_links).unionByName(of_samples).distinct()
