"""Uniform occurrences and random phrases, reproducible by arithmetic on the keys instead of a generator's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseloom.operators.phrases import Batch, bounds, hits
from phraseloom.operators.suffix import VS
from phraseloom.session import shuffle_partitions

# Fixed values of the mixing steps, shared with the SQL twins: all words have 31 bits.
STEP, OFFSET, WRAP, SHIFT = 1103515245, 12345, 2147483648, 15
#: Start values of the two words of a draw.
SALTS = (7, 104729)
MAX_PHRASE = 5
#: Positions of a run that is broadcast to the draws, some 100 MB in a worker; a larger one is shuffled by rank.
BROADCAST_ROWS = 2_000_000


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(WRAP - 1))


def _mixed(x: Column) -> Column:
    return _low(x.bitwiseXOR(F.shiftright(x, SHIFT)) * STEP + OFFSET)


def words(a: Column) -> tuple[Column, Column]:
    """Two words of 31 bits from a key."""
    return tuple(_mixed(_low(_low(a.cast("bigint")) + salt)) for salt in SALTS)


def drawn(of: tuple[Column, Column], b: Column, n: Column) -> Column:
    """A number below ``n`` from a key's :func:`words` and a second key."""
    high, low = (_mixed(_mixed(_low(w + _low(b.cast("bigint"))))) for w in of)
    return (high * WRAP + low) % n


def draw(a: Column, b: Column, n: Column) -> Column:
    """A number below ``n`` (up to 2^62) from two keys; equal keys always give the same one, on a retry too.

    Two words of 31 bits make the number, so every rank of a span of any size can be drawn.
    """
    return drawn(words(a), b, n)


def placed(run: DataFrame, n: int, draws: DataFrame) -> DataFrame:
    """``draws`` with the position at their ``rank``: a small array goes to the draws, with a large one both move by rank.

    Ranks are unique, so the array's partitions are even whatever is drawn.
    """
    at = run.select("rank", "sid", "off")
    return draws.join(F.broadcast(at) if n <= BROADCAST_ROWS else at.hint("shuffle_hash"), "rank")


def sample_occurrences(runs: list[tuple[DataFrame, int]], phrases: DataFrame, sents: DataFrame, most: int = 1000) -> DataFrame:
    """``phrase_id, i, sid, off``: min(most, occurrences) draws with replacement per phrase, over all sorted runs.

    Only the ranks drawn meet the arrays; nothing is made per occurrence.  A draw among a phrase's occurrences falls to
    the run whose share it hits, so runs need not be merged first.
    """
    wanted = phrases.select("phrase_id", F.col("q").cast("array<int>").alias("q"))
    batch, spans = Batch.of(phrases), None
    for r, (run, _) in enumerate(runs):
        part = bounds(run, batch, sents).select("q", F.col("begin").alias(f"b{r}"), (F.col("end") - F.col("begin")).alias(f"n{r}"))
        spans = part if spans is None else spans.join(part, "q", "full")
    sizes = [F.coalesce(f"n{r}", F.lit(0).cast("bigint")).alias(f"n{r}") for r in range(len(runs))]
    spans = wanted.join(spans, "q").select("phrase_id", *sizes, *[f"b{r}" for r in range(len(runs))])
    total = sum((F.col(f"n{r}") for r in range(1, len(runs))), F.col("n0"))
    w0, w1 = words(F.col("phrase_id"))
    # A few rows become many draws here, so they are spread over all tasks first.
    spans = spans.select("*", total.alias("n"), w0.alias("w0"), w1.alias("w1")).repartition(shuffle_partitions(phrases.sparkSession), "phrase_id")
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(most).cast("bigint"), F.col("n"))))
    draws = spans.select("*", each.alias("i")).withColumn("at", drawn((F.col("w0"), F.col("w1")), F.col("i"), F.col("n")))
    out, before = None, F.lit(0).cast("bigint")
    for r, (run, n) in enumerate(runs):
        mine = draws.where((F.col("at") >= before) & (F.col("at") < before + F.col(f"n{r}"))) if len(runs) > 1 else draws
        got = placed(run, n, mine.select("phrase_id", "i", (F.col(f"b{r}") + F.col("at") - before).alias("rank"))).select("phrase_id", "i", "sid", "off")
        out, before = got if out is None else out.unionByName(got), before + F.col(f"n{r}")
    return out


def random_phrases(sa: DataFrame, total: int, n: int, max_phrase: int = MAX_PHRASE) -> DataFrame:
    """``qid, q``: ``n`` phrases of 1 to ``max_phrase`` (at most 8) tokens from uniform positions of an array of ``total``;
    they never reach the end of sentence."""
    if max_phrase > len(VS):
        raise ValueError(f"an array keeps {len(VS)} tokens")
    head = F.array_compact(F.array(*VS[: max_phrase]))
    # The end of sentence is the last entry where the suffix is shorter than the columns.
    inside = F.size(F.filter(head, lambda v: v > 1))
    if not total:
        return sa.select(F.lit(0).cast("bigint").alias("qid"), head.alias("q")).limit(0)
    wanted = sa.sparkSession.range(n).select(F.col("id").alias("qid"), draw(F.col("id"), F.lit(1), F.lit(total).cast("bigint")).alias("rank"))
    hit = sa.select("rank", *VS[: max_phrase]).join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, "rank")
    size = F.lit(1) + draw(F.col("qid"), F.lit(2), inside.cast("bigint"))
    return hit.select("qid", F.slice(head, F.lit(1), size.cast("int")).alias("q"))


def valid_matches(sa: DataFrame, phrases: DataFrame, sents: DataFrame) -> DataFrame:
    """``phrase_id, n, outside``: each phrase's range and how many of its two neighbours outside share the prefix (none should)."""
    wanted = phrases.select("phrase_id", F.col("q").cast("array<int>").alias("q"))
    batch = Batch.of(phrases)
    spans = bounds(sa, batch, sents)
    edges = spans.select("q", F.explode(F.array(F.col("begin") - 1, F.col("end"))).alias("rank"))
    near = sa.join(F.broadcast(edges.select("rank").distinct()) if batch.small else edges.select("rank").distinct(), "rank")
    same = hits(near, batch, sents, ["rank"]).join(edges, ["q", "rank"]).groupBy("q").agg(F.count(F.lit(1)).alias("outside"))
    out = spans.join(same, "q", "left").join(wanted, "q")
    return out.select("phrase_id", (F.col("end") - F.col("begin")).alias("n"), F.coalesce("outside", F.lit(0).cast("bigint")).alias("outside"))
