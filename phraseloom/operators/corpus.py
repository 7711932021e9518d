"""Sentences of token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.functions.columns import token_at
from phraseloom.operators.ordered import ranked
from phraseloom.operators.vocab import Vocab, lookup, surfaces
from phraseloom.schemas import EOS_VID, MAX_LEN, SENTENCES
from phraseloom.session import materialize
from phraseloom.sources.text import read_text, reject_eos, tokens_of, word_rows


def sentences(deliveries: DataFrame, side: str) -> DataFrame:
    """``sid, toks`` of one side from delivered rows: repeats of a sid are one sentence, null ``toks`` none."""
    rows = deliveries.where((F.col("side") == side) & F.col("toks").isNotNull() & F.col("sid").isNotNull())
    return rows.groupBy("sid").agg(F.max("toks").alias("toks"))


def valid(sents: DataFrame) -> DataFrame:
    """``sid, toks`` of the sentences; fails on a null token and on ids below 2.

    0 is the invalid id and 1 the end of sentence, which is implied after the last token and never stored.  Everything that
    counts or indexes tokens goes through here, so counts and array cannot disagree.  Null ``sid`` or ``toks`` is no
    sentence, an empty one has no position.
    """
    bad = F.exists("toks", lambda t: t.isNull() | (t <= EOS_VID))
    fail = F.raise_error(F.concat(F.lit("null token or reserved id in sentence "), F.col("sid").cast("string")))
    toks = F.when(bad, fail.cast("array<int>")).otherwise(F.col("toks").cast("array<int>"))
    return sents.where("sid is not null and toks is not null").select(F.col("sid").cast("bigint").alias("sid"), toks.alias("toks"))


def fitted(sents: DataFrame, on_long: str = "whole", max_len: int = MAX_LEN) -> DataFrame:
    """The sentences under a policy for more than ``max_len`` tokens: take them 'whole', or fail with 'error'.

    To cut them instead, make shorter sentences first: ``Corpus.from_text(..., on_long='chunk')`` or :func:`chunks`.
    """
    if on_long == "whole":
        return sents
    if on_long != "error":
        raise ValueError(f"on_long must be 'whole' or 'error' here, not {on_long!r}")
    fail = F.raise_error(F.concat(F.lit("sentence too long: "), F.col("sid").cast("string")))
    return sents.withColumn("toks", F.when(F.size("toks") > max_len, fail.cast("array<int>")).otherwise(F.col("toks")))


def chunks(sents: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """``sid, base, toks`` with at most ``max_len`` tokens a row; ``base`` is where the row begins in its sentence.

    An empty sentence stays one empty row.  Indexed as sentences, the pieces each have an end of their own, and no
    phrase is found across a cut.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size("toks") - 1, F.lit(0)), F.lit(max_len))
    return sents.select("sid", F.explode(starts).alias("base"), "toks").select("sid", "base", F.slice("toks", F.col("base") + 1, max_len).alias("toks"))


def encode(words: DataFrame, vocab: DataFrame, key: list[str], place: str) -> DataFrame:
    """``key.., toks`` of word rows; unknown words fail before anything is appended."""
    ids = lookup(words, vocab, strict=True)
    toks = F.transform(F.sort_array(F.collect_list(F.struct(place, "vid"))), lambda x: x["vid"].cast("int"))
    return ids.groupBy(*key).agg(toks.alias("toks"))


def _numbered(coded: DataFrame, order: list[str], on_long: str, max_len: int) -> DataFrame:
    """``sid, toks`` numbered from 0; under 'chunk' each piece of at most ``max_len`` tokens is a sentence of its own."""
    if on_long == "chunk":
        pieces = F.explode(F.sequence(F.lit(0), F.greatest(F.size("toks") - 1, F.lit(0)), F.lit(max_len)))
        coded = coded.select(*order, "toks", pieces.alias("base")).withColumn("toks", F.slice("toks", F.col("base") + 1, max_len))
        return ranked(coded, [*order, "base"], "sid").select("sid", "toks")
    return fitted(ranked(coded, order, "sid").select("sid", "toks"), on_long, max_len)


def from_text(docs: DataFrame, id_col: str, text_col: str, on_long: str = "whole", max_len: int = MAX_LEN) -> tuple[Vocab, DataFrame]:
    """Vocabulary and sentences of texts: each line one sentence, ids by (document, line) order from 0.

    ``on_long`` says what a line of more than ``max_len`` tokens becomes: one sentence ('whole'), several ('chunk'), or
    a failure ('error').
    """
    words = reject_eos(word_rows(docs, id_col, text_col))
    vocab = Vocab.build(words, ["id", "line_no", "tok_no"])
    coded = encode(words, vocab.df, ["id", "line_no"], "tok_no")
    return vocab, _numbered(coded, ["id", "line_no"], on_long, max_len)


def from_text_file(spark: SparkSession, path: str, nlines: int | None = None, on_long: str = "whole", max_len: int = MAX_LEN) -> tuple[Vocab, DataFrame]:
    """Vocabulary and sentences of a text file, or of its first ``nlines`` lines; sentences keep the file's order."""
    lines = read_text(spark, path, nlines).select(F.monotonically_increasing_id().alias("id"), F.col("line"))
    lines = materialize(lines)  # the numbers hold for one reading only
    words = lines.select("id", F.lit(0).alias("line_no"), F.posexplode(tokens_of(F.col("line"))).alias("tok_no", "word"))
    words = reject_eos(words)
    vocab = Vocab.build(words, ["id", "line_no", "tok_no"])
    return vocab, _numbered(encode(words, vocab.df, ["id"], "tok_no"), ["id"], on_long, max_len)


def require_known(batch: DataFrame, vocab: DataFrame) -> None:
    """Fail on a token of ``batch`` that the vocabulary lacks, before anything is written."""
    vids = batch.select(F.explode(F.col("toks").cast("array<bigint>")).alias("vid")).distinct()
    unknown = vids.join(vocab.select("vid").distinct(), "vid", "left_anti").first()
    if unknown is not None:
        raise KeyError(f"unknown id {unknown.vid}")


def append(sents: DataFrame, batch: DataFrame, order: list[str], vocab: DataFrame | None = None) -> DataFrame:
    """``sents`` and the rows of ``batch`` behind them, numbered on in the batch's order.

    With ``vocab`` every id of the batch is checked first; an unknown one fails and nothing is appended.
    """
    start = sents.agg(F.coalesce(F.max("sid") + 1, F.lit(0))).first()[0]
    if vocab is not None:
        require_known(batch, vocab)
    return sents.select("sid", "toks").unionByName(ranked(batch, order, "sid", start).select("sid", "toks"))


def tokens(sents: DataFrame) -> DataFrame:
    """``sid, off, vid``, one row per stored token."""
    return sents.select("sid", F.posexplode("toks").alias("off", "vid"))


def every_place(sents: DataFrame) -> DataFrame:
    """``sid, i, vid`` at each place of each sentence and at the implied end of sentence."""
    places = F.explode(F.sequence(F.lit(0), F.size("toks")))
    return sents.select("sid", "toks", places.alias("i")).select("sid", "i", token_at(F.col("toks"), F.col("i")).alias("vid"))


def surface_text(sents: DataFrame, vocab: DataFrame, key: list[str] | None = None) -> DataFrame:
    """``key.., text``: each sentence as space-joined words; an empty sentence is an empty text."""
    key = key or ["sid"]
    rows = sents.select(*key, F.posexplode("toks").alias("__at", "vid")).withColumn("vid", F.col("vid").cast("bigint"))
    words = surfaces(rows, vocab).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__at", "surface"))).alias("w"))
    text = F.array_join(F.transform("w", lambda x: x["surface"]), " ")
    empty = sents.where(F.size("toks") == 0).select(*key, F.lit("").alias("text"))
    return words.select(*key, text.alias("text")).unionByName(empty)


def stats(sents: DataFrame) -> DataFrame:
    return sents.agg(F.count(F.lit(1)).alias("n_sentences"), F.coalesce(F.sum(F.size("toks")), F.lit(0)).cast("bigint").alias("n_tokens"))


class Corpus:
    """Sentences and their vocabulary as an immutable value."""

    def __init__(self, sents: DataFrame, vocab: Vocab) -> None:
        self.sents, self.vocab = sents, vocab

    @classmethod
    def empty(cls, spark: SparkSession) -> Corpus:
        return cls(spark.createDataFrame([], SENTENCES), Vocab.empty(spark))

    @classmethod
    def from_text(cls, docs: DataFrame, id_col: str, text_col: str, on_long: str = "whole", max_len: int = MAX_LEN) -> Corpus:
        vocab, sents = from_text(docs, id_col, text_col, on_long, max_len)
        return cls(sents, vocab)

    def append(self, batch: DataFrame, order: list[str]) -> Corpus:
        return Corpus(append(self.sents, batch, order, self.vocab.df), self.vocab)

    def add_words(self, words: list[str]) -> Corpus:
        """Intern the words of one sentence and append it."""
        spark = self.sents.sparkSession
        rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "tok_no int, word string")
        vocab = self.vocab.extend(rows, ["tok_no"])
        coded = encode(rows.withColumn("k", F.lit(0)), vocab.df, ["k"], "tok_no")
        return Corpus(append(self.sents, coded, ["k"]), vocab)

    def sentence(self, sid: int) -> DataFrame:
        return self.sents.where(F.col("sid") == sid)

    def surface(self, sids: list[int] | None = None) -> DataFrame:
        rows = self.sents if sids is None else self.sents.where(F.col("sid").isin(sids))
        return surface_text(rows, self.vocab.df)

    def stats(self) -> DataFrame:
        return stats(self.sents)

    def size(self) -> int:
        return self.sents.count()
