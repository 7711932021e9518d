"""Queries on dangling references (p4) and on skewed keys (p5), each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.operators.references import orphan_references
from phraseloom.operators.skew import hot_keys, salted_aggregate

HOT_SHARE = 0.03


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(*(table(spark, sf_dir, n) for n in ("corpus", "alignment", "sampled_positions")))


def p4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, field, side, reason and month."""
    by = ["ref_table", "ref_field", "side", "reason", "period"]
    return p4_found(spark, sf_dir).groupBy(*by).agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("ref_key").alias("n_records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, key in (("tokens", "vid"), ("sampled_positions", "sid")):
        hot = hot_keys(table(spark, sf_dir, name), key, HOT_SHARE)
        parts.append(hot.select(F.lit(f"{name}.{key}").alias("field"), F.col(key).cast("bigint").alias("hot_key")))
    return parts[0].unionByName(parts[1])


def p5_vid_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = salted_aggregate(table(spark, sf_dir, "tokens"), "vid", distinct="sid", low="ingested_at", high="ingested_at")
    return out.select(F.col("vid").cast("bigint").alias("vid"), "n_rows", F.col("n_distinct").alias("n_sids"), F.col("lowest").alias("first_at"), F.col("highest").alias("last_at"))


def p5_sid_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = salted_aggregate(table(spark, sf_dir, "sampled_positions"), "sid", distinct="sample_id", low="tok_offset", high="tok_offset")
    return out.select("sid", "n_rows", F.col("n_distinct").alias("n_samples"), F.col("lowest").cast("bigint").alias("low_offset"), F.col("highest").cast("bigint").alias("high_offset"))


QUERIES = {f.__name__: f for f in (p4_found, p4_summary, p5_found, p5_vid_stats, p5_sid_stats)}

_P4 = """
with parent as (
  select side, sid, min(ingested_at) as arrived, bool_or(deleted_at is not null) as deleted, max(len(toks)) as n_tok
  from corpus where side is not null and sid is not null group by side, sid),
al as (select sid, min(ingested_at) as seen_at, max(links) as links from alignment where sid is not null group by sid),
als as (select al.*, s.side from al, (values ('src'), ('trg')) s(side)),
judged as (
  select a.sid, a.seen_at, a.links, a.side, p.n_tok,
    case when p.sid is null then 'missing' when p.deleted then 'deleted' when p.arrived > a.seen_at then 'later' end as reason
  from als a left join parent p on p.sid = a.sid and p.side = a.side),
link as (
  select sid, seen_at, side, n_tok, unnest(links) as link, unnest(range(len(links))) as elem
  from judged where reason is null and n_tok is not null and links is not null),
found as (
  select 'alignment' as ref_table, 'sid' as ref_field, sid as ref_key, cast(-1 as bigint) as elem, side, reason, strftime(seen_at, '%Y-%m') as period
  from judged where reason is not null
  union all
  select 'alignment', side, sid, cast(elem as bigint), side, 'missing', strftime(seen_at, '%Y-%m') from link
  where not coalesce(link.src = 255 and link.trg = 255, false) and case when side = 'src' then link.src else link.trg end >= n_tok
  union all
  select 'sampled_positions', 'sid', s.sample_id, cast(-1 as bigint), 'src',
    case when p.sid is null then 'missing' when p.deleted then 'deleted' else 'later' end, strftime(s.sampled_at, '%Y-%m')
  from sampled_positions s left join parent p on p.sid = s.sid and p.side = 'src'
  where s.sid is not null and (p.sid is null or p.deleted or p.arrived > s.sampled_at))
"""

SQL = {
    "p4_found": _P4 + "select distinct * from found",
    "p4_summary": _P4
    + """select ref_table, ref_field, side, reason, period, count(*) as n_orphans, count(distinct ref_key) as n_records
from (select distinct * from found) group by all""",
    "p5_found": f"""
select 'tokens.vid' as field, cast(vid as bigint) as hot_key from tokens where vid is not null
group by vid having count(*) >= {HOT_SHARE} * (select count(*) from tokens)
union all
select 'sampled_positions.sid', sid from sampled_positions where sid is not null
group by sid having count(*) >= {HOT_SHARE} * (select count(*) from sampled_positions)""",
    "p5_vid_stats": """
select cast(vid as bigint) as vid, count(*) as n_rows, count(distinct sid) as n_sids, min(ingested_at) as first_at, max(ingested_at) as last_at
from tokens where vid is not null group by vid""",
    "p5_sid_stats": """
select sid, count(*) as n_rows, count(distinct sample_id) as n_samples, cast(min(tok_offset) as bigint) as low_offset, cast(max(tok_offset) as bigint) as high_offset
from sampled_positions where sid is not null group by sid""",
}
