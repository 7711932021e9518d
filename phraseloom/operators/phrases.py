"""Batches of phrases against sentences or a sorted array.

Every match is an equality of the first tokens, up to :data:`~phraseloom.operators.suffix.PREFIX` of them, and a longer
phrase is then checked in its sentences.  A batch of bounded size is broadcast; a larger one meets counts that were
combined before the shuffle.  Against an array, the least and greatest first token, or the few there are, are pushed
to the scan of the sorted files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phraseloom.functions.columns import with_eos
from phraseloom.operators.corpus import valid
from phraseloom.operators.suffix import PREFIX, VS, heads, suffix_text
from phraseloom.schemas import EOS_VID
from phraseloom.session import materialize

#: Tokens of a batch of phrases that is broadcast (some 40 MB in a worker); a larger one is shuffled.
SMALL_TOKENS = 2_000_000
#: Distinct first tokens that are named one by one in a pushed filter.
FEW = 1000


def distinct(phrases: DataFrame) -> DataFrame:
    """``q``: the distinct phrases that have tokens."""
    return phrases.where("q is not null").select(F.col("q").cast("array<int>").alias("q")).where("size(q) > 0").distinct()


@dataclass(frozen=True)
class Batch:
    """What the plan needs to know of a batch: sizes (above PREFIX as PREFIX + 1), whether it is small, first tokens."""

    q: DataFrame
    sizes: list[int]
    small: bool
    low: int
    high: int
    firsts: list[int] | None

    @classmethod
    def of(cls, phrases: DataFrame) -> Batch:
        q = materialize(distinct(phrases))  # read once per length
        size, first = F.least(F.size("q"), F.lit(PREFIX + 1)), F.col("q")[0]
        held, low, high, sizes, n = q.agg(F.sum(F.size("q")), F.min(first), F.max(first), F.collect_set(size), F.approx_count_distinct(first)).first()
        firsts = [r[0] for r in q.select(first).distinct().limit(FEW + 1).collect()] if held and n <= 2 * FEW else None
        return cls(q, sorted(sizes), (held or 0) <= SMALL_TOKENS, low, high, firsts if firsts is not None and len(firsts) <= FEW else None)

    def pruned(self, rows: DataFrame) -> DataFrame:
        """The rows whose first token some phrase has, as far as a scan can tell."""
        rows = rows.where(F.col("v0").between(self.low, self.high))
        return rows if self.firsts is None else rows.where(F.col("v0").isin([v for v in self.firsts if v is not None]))

    def of_size(self, n: int) -> DataFrame:
        """``q`` and its leading tokens ``v0..``; ``n`` above PREFIX stands for all longer ones."""
        some = self.q.where(F.size("q") == n if n <= PREFIX else F.size("q") > PREFIX)
        out = some.select("q", *[F.get("q", F.lit(d)).alias(VS[d]) for d in range(min(n, PREFIX))])
        return F.broadcast(out) if self.small else out


def _longer(met: DataFrame, sents: DataFrame) -> DataFrame:
    """Of rows ``q, sid, off, ..`` that agree in PREFIX tokens those that agree in all."""
    return met.join(sents.select("sid", "toks"), "sid").withColumn("text", suffix_text()).where(F.expr("slice(text, 1, size(q)) = q")).drop("text", "toks")


def hits(rows: DataFrame, batch: Batch, sents: DataFrame, keep: list[str]) -> DataFrame:
    """``q, keep..`` of every occurrence among ``rows`` (``v0.., sid, off`` and what ``keep`` names)."""
    rows, out = batch.pruned(rows) if batch.sizes else rows, None
    for n in batch.sizes:  # at most PREFIX + 1
        by = VS[: min(n, PREFIX)]
        wide = list(dict.fromkeys([*keep, "sid", "off"])) if n > PREFIX else keep
        met = rows.select(*wide, *by).join(batch.of_size(n), by)
        met = (_longer(met, sents) if n > PREFIX else met).select("q", *keep)
        out = met if out is None else out.unionByName(met)
    return out if out is not None else rows.select(F.array().cast("array<int>").alias("q"), *keep).limit(0)


def grams(sents: DataFrame, ns: list[int]) -> DataFrame:
    """``sid, off, q``: all windows of the given lengths; the last of a sentence may end in the end of sentence.

    One generated row per token with the longest window; slices of it are plain expressions, so the whole stays in
    generated code.
    """
    longest = max(ns)
    rows = valid(sents).select("sid", with_eos(F.col("toks")).alias("full"), F.posexplode("toks").alias("off", "first"))
    head = rows.select("sid", "off", F.expr(f"slice(full, off + 1, {longest})").alias("head"))
    if ns == [longest]:
        return head.where(F.size("head") == longest).select("sid", "off", F.col("head").alias("q"))
    each = F.array(*[F.when(F.size("head") >= n, F.slice("head", 1, n)) for n in ns])
    return head.select("sid", "off", F.explode(each).alias("q")).where("q is not null")


def matches(sents: DataFrame, phrases: DataFrame) -> DataFrame:
    """``phrase_id, sid, off`` of every occurrence.  An empty phrase matches nothing here; its span is the whole index."""
    wanted = phrases.select("phrase_id", F.col("q").cast("array<int>").alias("q"))
    batch = Batch.of(phrases)
    met = _in_sentences(sents, batch, ["sid", "off"])
    return met.join(wanted, "q").select("phrase_id", "sid", "off")


def _in_sentences(sents: DataFrame, batch: Batch, keep: list[str]) -> DataFrame:
    """``q, keep..`` of every occurrence: one pass for all phrases up to PREFIX tokens, another for the longer ones."""
    short = [n for n in batch.sizes if n <= PREFIX]
    out = None
    if short:
        q = batch.q.where(F.size("q") <= PREFIX)
        out = grams(sents, short).join(F.broadcast(q) if batch.small else q, "q").select("q", *keep)
    if len(short) < len(batch.sizes):
        long = hits(heads(sents), Batch(batch.q, batch.sizes[-1:], batch.small, batch.low, batch.high, batch.firsts), sents, keep)
        out = long if out is None else out.unionByName(long)
    return out if out is not None else sents.select(F.array().cast("array<int>").alias("q"), *[F.col("sid") if k == "sid" else F.lit(0).alias(k) for k in keep]).limit(0)


def phrase_counts(sents: DataFrame, phrases: DataFrame) -> DataFrame:
    """``phrase_id, n`` for every phrase, 0 where it does not occur; from the sentences, without an index.

    Windows are counted per distinct phrase before the ids come in, so a phrase under several ids is counted once.
    """
    wanted = phrases.select("phrase_id", F.col("q").cast("array<int>").alias("q"))
    counted = _in_sentences(sents, Batch.of(phrases), ["sid"]).groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counted, "q", "left").select("phrase_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def narrow_trace(sents: DataFrame, phrases: DataFrame) -> DataFrame:
    """``phrase_id, depth, n, span_depth``: each step of narrowing a span token by token.

    A step that finds nothing gives 0 and leaves the span as it was; later tokens are then tried from there.
    """
    base = phrases.select("phrase_id", F.col("q").cast("array<int>").alias("q"))
    longest = base.agg(F.max(F.size("q"))).first()[0] or 0
    state = base.withColumns({"cur": F.array().cast("array<int>"), "n": F.lit(0).cast("bigint")})
    out = None
    for d in range(1, longest + 1):
        live = state.where(F.size("q") >= d).withColumn("next", F.concat("cur", F.array(F.get("q", F.lit(d - 1)))))
        tried = live.select(F.col("next").alias("q"))
        counted = _in_sentences(sents, Batch.of(tried), ["sid"]).groupBy(F.col("q").alias("next")).agg(F.count(F.lit(1)).alias("hits"))
        step = live.join(counted, "next", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("bigint")))
        # Written out per step: the next one reads as many rows as there are phrases, not the sentences again.
        state = materialize(step.select("phrase_id", "q", F.when(F.col("hits") > 0, F.col("next")).otherwise(F.col("cur")).alias("cur"), F.col("hits").alias("n")))
        rows = state.select("phrase_id", F.lit(d).alias("depth"), "n", F.size("cur").alias("span_depth"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else base.select("phrase_id", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("span_depth")).limit(0)


def bounds(sa: DataFrame, batch: Batch, sents: DataFrame) -> DataFrame:
    """``q, begin, end``: the half-open range of ranks of each phrase that occurs; matches are contiguous."""
    if batch.small or not batch.sizes:
        return hits(sa, batch, sents, ["rank"]).groupBy("q").agg(F.min("rank").alias("begin"), (F.max("rank") + 1).alias("end"))
    # The sorted files combine to nearly one row per distinct prefix before they are shuffled.
    rows, out = batch.pruned(sa), None
    for n in batch.sizes:
        by = VS[: min(n, PREFIX)]
        if n > PREFIX:
            met = _longer(rows.select("rank", "sid", "off", *by).join(batch.of_size(n), by), sents).groupBy("q").agg(F.min("rank").alias("begin"), (F.max("rank") + 1).alias("end"))
        else:
            met = rows.groupBy(*by).agg(F.min("rank").alias("begin"), (F.max("rank") + 1).alias("end")).join(batch.of_size(n), by).select("q", "begin", "end")
        out = met if out is None else out.unionByName(met)
    return out


def ranges(sa: DataFrame, phrases: DataFrame, sents: DataFrame) -> DataFrame:
    """``phrase_id, begin, end``: the half-open rank range of each phrase that occurs."""
    wanted = phrases.select("phrase_id", F.col("q").cast("array<int>").alias("q"))
    return wanted.join(bounds(sa, Batch.of(phrases), sents), "q").select("phrase_id", "begin", "end")


def locate(sa: DataFrame, phrases: DataFrame, sents: DataFrame) -> DataFrame:
    """``phrase_id, k, rank, sid, off``: occurrences in suffix order.

    A phrase's matches are contiguous in rank, so ``k`` is the distance from its first rank and no window is needed,
    which a phrase with a tenth of all positions would overload.
    """
    wanted = phrases.select("phrase_id", F.col("q").cast("array<int>").alias("q"))
    batch = Batch.of(phrases)
    first = bounds(sa, batch, sents).join(wanted, "q").select("phrase_id", "q", "begin")
    met = hits(sa, batch, sents, ["rank", "sid", "off"]).join(F.broadcast(first) if batch.small else first, "q")
    return met.select("phrase_id", (F.col("rank") - F.col("begin")).alias("k"), "rank", "sid", "off")


def anchored(phrases: DataFrame) -> DataFrame:
    """The phrases with the end of sentence behind them."""
    return phrases.select("phrase_id", F.concat(F.col("q").cast("array<int>"), F.array(F.lit(EOS_VID))).alias("q"))


def ngram_counts(sents: DataFrame, n: int) -> DataFrame:
    """``q, n`` of every window of ``n`` tokens that begins at a token; the counts of all trie nodes at that depth."""
    return grams(sents, [n]).groupBy("q").agg(F.count(F.lit(1)).alias("n"))


def top_ngrams(sents: DataFrame, n: int, k: int) -> DataFrame:
    """The ``k`` most frequent, ties by tokens: a partial top-k per task and a merge, no full sort."""
    return ngram_counts(sents, n).orderBy(F.desc("n"), "q").limit(k)


def next_tokens(sents: DataFrame, phrases: DataFrame) -> DataFrame:
    """``phrase_id, vid, n, cum_before``: what follows each phrase, with partial sums in id order."""
    wanted = phrases.select("phrase_id", F.col("q").cast("array<int>").alias("q"))
    batch = Batch.of(phrases)
    short, counted = [n for n in batch.sizes if n <= PREFIX], None
    if short:
        q = batch.q.where(F.size("q") <= PREFIX)
        longer = grams(sents, [n + 1 for n in short]).select(F.expr("slice(q, 1, size(q) - 1)").alias("q"), F.element_at("q", -1).alias("vid"))
        counted = longer.join(F.broadcast(q) if batch.small else q, "q")
    if len(short) < len(batch.sizes):
        at = hits(heads(sents), Batch(batch.q, batch.sizes[-1:], batch.small, batch.low, batch.high, batch.firsts), sents, ["sid", "off"])
        after = F.get(suffix_text(), F.size("q"))
        rows = at.join(sents.select("sid", "toks"), "sid").select("q", after.alias("vid")).where("vid is not null")
        counted = rows if counted is None else counted.unionByName(rows)
    if counted is None:
        return wanted.select("phrase_id", F.lit(0).alias("vid"), *[F.lit(0).cast("bigint").alias(c) for c in ("n", "cum_before")]).limit(0)
    counted = counted.groupBy("q", "vid").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("phrase_id").orderBy("vid").rowsBetween(Window.unboundedPreceding, -1)
    out = wanted.join(counted, "q").select("phrase_id", "vid", "n")
    return out.withColumn("cum_before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")))


def prefix_rollup(sents: DataFrame, depth: int = 3) -> DataFrame:
    """``depth, n_nodes, n_positions`` of the full trie down to ``depth``."""
    counted = grams(sents, list(range(1, depth + 1))).groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(F.size("q").alias("depth")).agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("n").alias("n_positions"))
