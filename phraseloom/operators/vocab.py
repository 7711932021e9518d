"""The dictionary between words and integer ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.operators.ordered import ranked
from phraseloom.schemas import EOS, EOS_VID, VOCAB


def empty_vocab(spark: SparkSession) -> DataFrame:
    """A new vocabulary: the end of sentence has id 1."""
    return spark.createDataFrame([(EOS_VID, EOS, False)], VOCAB)


def _place(words: DataFrame, order: list[str]) -> Column:
    """The order's columns as one sortable value.

    A wide decimal can be updated in a hash aggregate's buffer; a struct would make Spark sort every word first.
    """
    kinds = [words.schema[c].dataType.typeName() for c in order]
    if kinds == ["long", "integer", "integer"]:
        low = F.shiftleft(F.col(order[1]).cast("bigint"), 31) + F.col(order[2])
        return (F.col(order[0]).cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)")).cast("decimal(38,0)") + low.cast("decimal(19,0)")
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def first_places(words: DataFrame, order: list[str]) -> DataFrame:
    """``word, place`` of each distinct word at its first place; the aggregate combines before its shuffle."""
    return words.where("word is not null").groupBy("word").agg(F.min(_place(words, order)).alias("place"))


def build_vocab(words: DataFrame, order: list[str]) -> DataFrame:
    """``vid, surface, is_alias`` in order of first appearance: the end of sentence is 1, the first word 2."""
    fresh = ranked(first_places(words.where(F.col("word") != EOS), order), ["place"], "vid", EOS_VID + 1)
    new = fresh.select(F.col("vid").cast("bigint").alias("vid"), F.col("word").alias("surface"), F.lit(False).alias("is_alias"))
    return empty_vocab(words.sparkSession).unionByName(new)


def extend_vocab(vocab: DataFrame, words: DataFrame, order: list[str], next_vid: int | None = None) -> DataFrame:
    """Rows for words that ``vocab`` lacks, numbered on from its greatest id (or ``next_vid``) by first appearance."""
    start = next_vid if next_vid is not None else (vocab.agg(F.max("vid")).first()[0] or 0) + 1
    known = vocab.select(F.col("surface").alias("word")).distinct()
    fresh = ranked(first_places(words, order).join(known, "word", "left_anti"), ["place"], "vid", start)
    return fresh.select(F.col("vid").cast("bigint").alias("vid"), F.col("word").alias("surface"), F.lit(False).alias("is_alias"))


def with_eos_alias(loaded: DataFrame) -> DataFrame:
    """A loaded vocabulary, as it is used: id 1 reads as the end of sentence, and its stored word stays as an alias."""
    eos = loaded.sparkSession.createDataFrame([(EOS_VID, EOS, False)], VOCAB)
    plain = loaded.select("vid", "surface", (F.col("vid") <= EOS_VID).alias("is_alias"))
    return eos.unionByName(plain.where(F.col("surface") != EOS))


def dictionary(vocab: DataFrame) -> DataFrame:
    """Distinct ``vid, surface, is_alias`` rows; repeats fall together and a null flag means no alias."""
    flag = F.coalesce("is_alias", F.lit(False))
    return vocab.where("vid is not null and surface is not null").groupBy("vid", "surface").agg(F.min(flag).alias("is_alias"))


def lookup(words: DataFrame, vocab: DataFrame, strict: bool = False) -> DataFrame:
    """``words`` with ``vid``; a missing word has a null id, or fails if ``strict``.

    Spark broadcasts the dictionary where its size allows and shuffles otherwise.
    """
    ids = vocab.groupBy(F.col("surface").alias("word")).agg(F.min("vid").alias("vid"))
    out = words.join(ids, "word", "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("unknown word: "), F.col("word"))).cast("bigint")
        out = out.withColumn("vid", F.coalesce("vid", missing))
    return out


def surfaces(rows: DataFrame, vocab: DataFrame, strict: bool = False) -> DataFrame:
    """``rows`` with the ``surface`` of their ``vid``; aliases are not read back."""
    words = dictionary(vocab).where("not is_alias").groupBy("vid").agg(F.min("surface").alias("surface"))
    out = rows.join(words, "vid", "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("unknown id: "), F.col("vid").cast("string"))).cast("string")
        out = out.withColumn("surface", F.coalesce("surface", missing))
    return out


class Vocab:
    """A vocabulary as an immutable value."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @classmethod
    def empty(cls, spark: SparkSession) -> Vocab:
        return cls(empty_vocab(spark))

    @classmethod
    def build(cls, words: DataFrame, order: list[str]) -> Vocab:
        return cls(build_vocab(words, order))

    def lookup(self, words: DataFrame, strict: bool = True) -> DataFrame:
        return lookup(words, self.df, strict)

    def surface(self, vids: DataFrame, strict: bool = True) -> DataFrame:
        return surfaces(vids, self.df, strict)

    def extend(self, words: DataFrame, order: list[str]) -> Vocab:
        """Look up or insert: a vocabulary that also has all of ``words``."""
        return Vocab(self.df.unionByName(extend_vocab(self.df, words, order)))

    def at(self, word: str) -> int:
        row = self.df.where(F.col("surface") == word).first()
        if row is None:
            raise KeyError(word)
        return row.vid

    def word(self, vid: int) -> str:
        row = self.df.where((F.col("vid") == vid) & ~F.coalesce("is_alias", F.lit(False))).first()
        if row is None:
            raise KeyError(vid)
        return row.surface

    def size(self) -> int:
        """One past the greatest id."""
        return (self.df.agg(F.max("vid")).first()[0] or 0) + 1

    def words(self) -> DataFrame:
        """Ids from 1 on, ascending."""
        return self.df.where((F.col("vid") >= EOS_VID) & ~F.coalesce("is_alias", F.lit(False))).orderBy("vid")
