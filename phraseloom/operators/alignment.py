"""Word-alignment links between the sentences of two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseloom.schemas import INVALID_LINK


def alignments(deliveries: DataFrame) -> DataFrame:
    """``sid, links``: repeats of a sid are one record, null links none."""
    return deliveries.where("sid is not null and links is not null").groupBy("sid").agg(F.max("links").alias("links"))


def links(aligned: DataFrame) -> DataFrame:
    """``sid, i, src, trg`` of every valid link; the invalid one is no link."""
    rows = aligned.select("sid", F.posexplode("links").alias("i", "link")).select("sid", "i", "link.src", "link.trg")
    return rows.where(~F.coalesce((F.col("src") == INVALID_LINK[0]) & (F.col("trg") == INVALID_LINK[1]), F.lit(False)))


def aligned_tokens(aligned: DataFrame, src: DataFrame, trg: DataFrame) -> DataFrame:
    """``sid, i, src_vid, trg_vid``: each link resolved to the tokens it joins; links that leave their sentence are left out."""
    both = aligned.join(src.select("sid", F.col("toks").alias("s")), "sid").join(trg.select("sid", F.col("toks").alias("t")), "sid")
    rows = both.select("sid", "s", "t", F.posexplode("links").alias("i", "link"))
    inside = (F.col("link.src") < F.size("s")) & (F.col("link.trg") < F.size("t"))
    return rows.where(inside).select("sid", "i", F.get("s", F.col("link.src")).alias("src_vid"), F.get("t", F.col("link.trg")).alias("trg_vid"))
