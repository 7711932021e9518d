"""The phrase index and its cursor, as immutable values over written tables.

An index is one or more sorted runs (:func:`~phraseloom.operators.suffix.suffix_array`), each a table ``rank, sid, off,
v0..`` in rank order.  Counts and samples read every run; whatever needs a rank over all of them reads one merged run.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.functions.columns import token_at
from phraseloom.operators import phrases as P
from phraseloom.operators.corpus import Corpus, fitted, require_known
from phraseloom.operators.sampling import draw, placed, random_phrases, sample_occurrences
from phraseloom.operators.suffix import PREFIX, VS, differences, heads, in_files, keyed, rekeyed, suffix_array
from phraseloom.operators.trie import dump_lines, trie_nodes
from phraseloom.schemas import MAX_LEAF, MAX_LEN
from phraseloom.session import materialize

if TYPE_CHECKING:
    from phraseloom.operators.incremental import Store

#: A run is merged with a later one that is at least this fraction of it, so each position is sorted a logarithmic number of times.
FANOUT = 4


@dataclass(frozen=True)
class Run:
    """A sorted array and its number of positions."""

    sa: DataFrame
    n: int


def _key() -> Column:
    """A node's path as text."""
    return F.concat_ws(" ", F.transform("path", lambda v: v.cast("string")))


def to_merge(sizes: list[int], fanout: int = FANOUT) -> int:
    """How many of the last runs to merge: back to the first one that is much larger than all behind it."""
    k, held = len(sizes) - 1, sizes[-1] if sizes else 0
    while k > 0 and sizes[k - 1] < fanout * held:
        k -= 1
        held += sizes[k]
    return len(sizes) - k if sizes else 0


def merged(runs: list[Run]) -> Run:
    """One run of several: their stored tokens are sorted together, sentences are not read."""
    return runs[0] if len(runs) == 1 else Run(*suffix_array(rekeyed([r.sa for r in runs])))


class TokenIndex:
    """Sorted runs over sentences ``sid, toks``."""

    def __init__(self, sents: DataFrame, runs: list[Run], corpus: Corpus | None = None, max_leaf: int = MAX_LEAF, preloaded: int = 0) -> None:
        self.sents, self.runs, self.corpus, self.max_leaf, self.preloaded = sents, runs, corpus, max_leaf, preloaded
        self._one = runs[0] if len(runs) == 1 else None

    @classmethod
    def build(cls, corpus: Corpus | DataFrame, max_leaf: int = MAX_LEAF, on_long: str = "whole", max_len: int = MAX_LEN) -> TokenIndex:
        """Sort all positions.  Sentences of any length are taken whole; ``on_long='error'`` refuses those above ``max_len``.

        Null tokens and reserved ids (0 and 1) fail.
        """
        sents = corpus.sents if isinstance(corpus, Corpus) else corpus
        return cls(sents, [Run(*suffix_array(keyed(fitted(sents, on_long, max_len))))], corpus if isinstance(corpus, Corpus) else None, max_leaf)

    @classmethod
    def load(cls, sents: DataFrame, array: DataFrame, max_leaf: int = MAX_LEAF) -> TokenIndex:
        """An index over an imported array ``rank, sid, off``; its root starts as one leaf of all positions.

        Fails if an entry matches no position of the sentences, or if ranks or positions are missing or repeated.
        """
        at = heads(sents).withColumn("known", F.lit(1).cast("bigint"))
        both = materialize(array.select("rank", "sid", "off").withColumn("listed", F.lit(1).cast("bigint")).join(at, ["sid", "off"], "full"))
        one = F.lit(1).cast("bigint")
        got = both.agg(F.count("listed").alias("n"), F.count("known").alias("m"), F.count(F.when(F.col("listed").isNotNull() & F.col("known").isNotNull(), one)).alias("both"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count_distinct("rank").alias("ranks")).first()
        if not got.n == got.m == got.both == got.ranks or (got.n and (got.low, got.high) != (0, got.n - 1)):
            raise ValueError(f"the array does not fit its sentences: {got.n} entries, {got.m} positions, {got.both} in both, {got.ranks} ranks")
        sa = materialize(in_files(both.select("rank", "sid", "off", *VS), got.n))
        return cls(sents, [Run(sa, got.n)], None, max_leaf, got.n)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TokenIndex:
        """An index that :meth:`save` or a :class:`~phraseloom.operators.incremental.Store` has written."""
        from phraseloom.operators.incremental import Store

        return Store(spark, path).index()

    def save(self, path: str) -> Store:
        """Write sentences and runs as a store, to be read with :meth:`open` or grown by batches."""
        from phraseloom.operators.incremental import Store

        store = Store(self.sents.sparkSession, path)
        store.put(self)
        return store

    @property
    def n(self) -> int:
        """Positions in all runs."""
        return sum(r.n for r in self.runs)

    def one(self) -> Run:
        """One run over everything; several are merged at the first use and kept for this value."""
        if self._one is None:
            self._one = merged(self.runs)
        return self._one

    @property
    def sa(self) -> DataFrame:
        return self.one().sa

    def span(self) -> Span:
        return Span(self, (), 0, self.n)

    def add(self, sents: DataFrame, vocab: DataFrame | None = None) -> TokenIndex:
        """The index with more sentences, whose sids follow the present ones: a new run, the present ones stay as they are.

        With a vocabulary (that of the corpus, if there is one) unknown ids fail before anything is written.
        """
        vocab = vocab if vocab is not None else self.corpus.vocab.df if self.corpus else None
        if vocab is not None:
            require_known(sents, vocab)
        new = Run(*suffix_array(keyed(sents)))
        return TokenIndex(self.sents.unionByName(sents.select("sid", "toks")), [*self.runs, new] if new.n else self.runs, self.corpus, self.max_leaf, self.preloaded)

    def compact(self, fanout: int = FANOUT) -> TokenIndex:
        """Merge the last runs as far as their sizes ask for it; a large ``fanout`` merges all."""
        k = to_merge([r.n for r in self.runs], fanout)
        runs = [*self.runs[:-k], merged(self.runs[-k:])] if k > 1 else self.runs
        return TokenIndex(self.sents, runs, self.corpus, self.max_leaf, self.preloaded)

    def merge(self, other: TokenIndex) -> TokenIndex:
        """One run over both indexes; among equal suffixes earlier sids come first."""
        return TokenIndex(self.sents.unionByName(other.sents), [merged([*self.runs, *other.runs])], self.corpus, self.max_leaf, self.preloaded)

    def equals(self, other: TokenIndex) -> bool:
        return differences(self.sa, other.sa).isEmpty()

    def trie(self, max_leaf: int | None = None) -> DataFrame:
        return trie_nodes(self.sa, self.sents, self.n, max_leaf or self.max_leaf, preloaded=self.preloaded)

    def dump(self, surfaces: DataFrame, max_leaf: int | None = None) -> DataFrame:
        return dump_lines(self.sa, self.sents, self.trie(max_leaf), surfaces)

    def counts(self, phrases: DataFrame) -> DataFrame:
        """``phrase_id, n`` of every phrase from the sorted runs; 0 where it does not occur, and for an empty one."""
        wanted = phrases.select("phrase_id", F.col("q").cast("array<int>").alias("q"))
        batch, parts = P.Batch.of(phrases), None
        for r in self.runs:
            part = P.bounds(r.sa, batch, self.sents).select("q", (F.col("end") - F.col("begin")).alias("n"))
            parts = part if parts is None else parts.unionByName(part)
        total = parts.groupBy("q").agg(F.sum("n").alias("n"))
        return wanted.join(total, "q", "left").select("phrase_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))

    def ranges(self, phrases: DataFrame) -> DataFrame:
        return P.ranges(self.sa, phrases, self.sents)

    def locate(self, phrases: DataFrame) -> DataFrame:
        return P.locate(self.sa, phrases, self.sents)

    def sample(self, phrases: DataFrame, most: int = 1000) -> DataFrame:
        return sample_occurrences([(r.sa, r.n) for r in self.runs], phrases, self.sents, most)

    def random_phrases(self, n: int) -> DataFrame:
        return random_phrases(self.sa, self.n, n)


@dataclass(frozen=True)
class Span:
    """All positions that begin with a sequence: a range of ranks.  Narrowing returns a new span; a miss the same one and 0."""

    index: TokenIndex
    sequence: tuple[int, ...]
    low: int
    n: int

    @property
    def rows(self) -> DataFrame:
        """The array's rows of this span; the rank range and the tokens are pushed to the scan."""
        out = self.index.sa
        for d, vid in enumerate(self.sequence[:PREFIX]):
            out = out.where(F.col(VS[d]) == vid)
        return out.where((F.col("rank") >= self.low) & (F.col("rank") < self.low + self.n))

    def _after(self) -> tuple[DataFrame, Column]:
        """The rows and the token that follows the sequence in each."""
        d = len(self.sequence)
        if d < PREFIX:
            return self.rows, F.col(VS[d])
        return self.rows.join(self.index.sents.select("sid", "toks"), "sid"), token_at(F.col("toks"), F.col("off") + d)

    def narrow(self, vid: int) -> tuple[Span, int]:
        rows, token = self._after()
        n, low = rows.where(token == vid).agg(F.count(F.lit(1)), F.min("rank")).first()
        return (replace(self, sequence=(*self.sequence, vid), low=low, n=n), n) if n else (self, 0)

    def size(self) -> int:
        return self.n

    def depth(self) -> int:
        return len(self.sequence)

    def bounds(self) -> tuple[int, int]:
        """Half-open range of ranks."""
        return self.low, self.low + self.n

    def at(self, k: int) -> tuple[int, int]:
        if not 0 <= k < self.n:
            raise IndexError(k)
        return self.at_unchecked(k)

    def at_unchecked(self, k: int) -> tuple[int, int] | None:
        """The position ``k`` places after the span's first, even if outside the span."""
        row = self.index.sa.where(F.col("rank") == self.low + k).select("sid", "off").first()
        return (row.sid, row.off) if row else None

    def positions(self) -> DataFrame:
        return self.rows.select("rank", "sid", "off").orderBy("rank")

    def sample(self, most: int = 1000, seed: int = 0) -> DataFrame:
        """``i, sid, off``: min(most, size) draws with replacement; the root span draws from all positions."""
        run = self.index.one()
        ranks = run.sa.sparkSession.range(1, min(most, self.n) + 1).select(F.col("id").alias("i"), (F.lit(self.low).cast("bigint") + draw(F.lit(seed), F.col("id"), F.lit(max(self.n, 1)).cast("bigint"))).alias("rank"))
        return placed(run.sa, run.n, ranks).select("i", "sid", "off")

    def next_tokens(self) -> DataFrame:
        rows, token = self._after()
        return rows.where(token.isNotNull()).groupBy(token.alias("vid")).agg(F.count(F.lit(1)).alias("n"))

    def tree_path(self, trie: DataFrame) -> list[tuple[int, ...]]:
        """Trie nodes on the way to this span, root first."""
        texts = [" ".join(map(str, self.sequence[:d])) for d in range(len(self.sequence) + 1)]
        rows = trie.where(_key().isin(texts)).select("path").collect()
        return sorted((tuple(r.path) for r in rows), key=len)

    def tree_depth(self, trie: DataFrame) -> int:
        return len(self.tree_path(trie)) - 1

    def in_array(self, trie: DataFrame) -> bool:
        """Whether the span has reached a suffix-array leaf."""
        last = " ".join(map(str, self.tree_path(trie)[-1]))
        return trie.where(_key() == last).first().is_leaf
