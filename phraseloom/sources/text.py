"""Text as sentences: lines end at a line feed only, tokens are split at single spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.schemas import EOS


def lines_of(text: Column) -> Column:
    """Lines of a text held in a column.  A line feed at the end begins no further line; an empty text has no line."""
    parts = F.split(text, "\n", -1)
    whole = F.when(text.endswith("\n") | (text == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(text.isNotNull(), whole)


def tokens_of(line: Column) -> Column:
    """Tokens of a line: doubled and edge spaces give empty tokens, an empty line has one empty token; tabs stay."""
    return F.split(line, " ", -1)


def read_text(spark: SparkSession, path: str, nlines: int | None = None) -> DataFrame:
    """``path, line`` of text files, broken at line feeds only; ``nlines`` keeps the first lines of one file.

    Without ``nlines`` a file is read in splits.  With it, the file's order counts, so lines are taken in scan order.
    """
    df = spark.read.option("lineSep", "\n").text(path)
    return df.limit(nlines).select(F.col("value").alias("line")) if nlines is not None else df.select(F.col("value").alias("line"))


def word_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, tok_no, word`` of texts in a table; null texts have no rows."""
    lines = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(lines_of(F.col(text_col))).alias("line_no", "line"))
    return lines.select("id", "line_no", F.posexplode(tokens_of(F.col("line"))).alias("tok_no", "word"))


def reject_eos(words: DataFrame) -> DataFrame:
    """Fail on a literal end-of-sentence word: it is implied, never written."""
    return words.withColumn("word", F.when(F.col("word") == EOS, F.raise_error(F.lit("the end of sentence must not be a word"))).otherwise(F.col("word")))


def folder_of(path: str) -> str:
    return path.rsplit("/", 1)[0] if "/" in path else "."
