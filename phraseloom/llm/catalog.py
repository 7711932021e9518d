"""Named queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.llm import canonical, leakage, nearsets, packing, spans, splitting, terms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The version marks of segment files.
MAGICS = ["SaptIDX2", "SaptIDX3"]


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splitting.split_sequences(table(spark, sf_dir, "corpus"), table(spark, sf_dir, "vocab"))
    return out.withColumn("toks", F.array_join("toks", " "))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_sequences(table(spark, sf_dir, "corpus"), table(spark, sf_dir, "vocab"))
    return pieces.where("piece > 0").select("side", "sid").distinct()


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.segment_sizes(*(table(spark, sf_dir, n) for n in ("corpus", "vocab", "index_headers")), MAGICS)


def _vids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_counts(table(spark, sf_dir, "tokens"), "vid", "sid", "tok_offset")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vids(spark, sf_dir).where("mark is not null").select("vid", "mark")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vids(spark, sf_dir)


def p2_vocab_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct vids in use and marked, beside the largest src vocabulary size that a header states."""
    used = _vids(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_vids"), F.count_if(F.col("mark") == "rare").alias("n_rare"), F.count_if(F.col("mark") == "common").alias("n_common"))
    stated = table(spark, sf_dir, "index_headers").where("side = 'src' and file_kind = 'tdx'").agg(F.max("vocab_size")).first()[0]
    return used.withColumn("vocab_size", F.lit(stated).cast("bigint"))


def _src(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "corpus").where("side = 'src' and toks is not null").select("sid", "toks")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_runs(spans.matched_chains(_src(spark, sf_dir), "sid", "toks"))


def p3_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_share(_src(spark, sf_dir), "sid", "toks", p3_found(spark, sf_dir))


def p3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _src(spark, sf_dir)
    return spans.passages(spans.pair_chains(src, "sid", "toks"), src, "sid", "toks")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, members = nearsets.set_classes(_src(spark, sf_dir), "sid", "toks")
    return nearsets.close_pairs(members, nearsets.close_classes(classes))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearsets.near_groups(_src(spark, sf_dir), "sid", "toks")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per level of packing: shards, containers by best fit alone and after evolution, generations that the islands ran; and
    of the whole the containers used, the least number that the tokens need, and the share of room used."""
    packed, levels = packing.pack_levels(packing.token_counts(table(spark, sf_dir, "documents")))
    n, tokens = packed.where("container is not null").agg(F.countDistinct("container"), F.sum(F.col("tok_end") - F.col("tok_start"))).first()
    room = (n or 0) * packing.CAPACITY
    of_all = {"n_containers": F.lit(n or 0).cast("bigint"), "least": F.lit(-(-(tokens or 0) // packing.CAPACITY)).cast("bigint"), "fill": F.lit((tokens or 0) / room if room else None).cast("double")}
    return levels.withColumns(of_all)


def p7_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every filling must keep: all items placed, none cut below the capacity, no gap, no container overfull."""
    rows = p7_packed(spark, sf_dir)
    size = packing.CAPACITY
    per = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("tok_end").alias("end"), F.sum(F.col("tok_end") - F.col("tok_start")).alias("held"), F.max("piece").alias("last"))
    split = F.count_if((F.col("n") > 1) & (F.col("end") <= size)).alias("n_cut_small")
    gaps = F.count_if((F.col("held") != F.col("end")) | (F.col("last") != F.col("n") - 1)).alias("n_gaps")
    items = per.agg(F.count(F.lit(1)).alias("n_docs"), split, gaps)
    over = rows.where("container is not null").groupBy("container").agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("load")).where(F.col("load") > size).count()
    return items.withColumn("n_over", F.lit(over).cast("bigint"))


def p1_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split sequence: tokens that its pieces add, and how many pieces are too long or repeat other than the stated overlap."""
    limit, overlap = splitting.LIMIT, splitting.OVERLAP
    size, again = F.col("end") - F.col("start"), F.col("new_from") - F.col("start")
    pieces = splitting.split_sequences(table(spark, sf_dir, "corpus"), table(spark, sf_dir, "vocab"))
    bad = F.count_if((size > limit) | (size != F.size("toks"))).alias("n_too_long"), F.count_if(again != F.when(F.col("piece") == 0, 0).otherwise(F.least(F.lit(overlap), F.col("new_from")))).alias("n_bad_overlap")
    return pieces.groupBy("side", "sid").agg(F.sum(F.col("end") - F.col("new_from")).alias("n_tokens"), *bad)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.text_forms(table(spark, sf_dir, "documents").where("text is not null"), "doc_id").distinct()


def p9_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_texts(table(spark, sf_dir, "documents"), "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_cover, p1_segments, p2_found, p2_counts, p2_vocab_use, p3_found, p3_share, p3_passages, p6_found, p6_groups, p7_packed, p7_fill, p7_valid, p8_found, p8_clean, p9_found, p9_texts)}

# Independent of the operator's short cuts: every test runs on every text.
_PLAIN = """nfc_normalize(translate(regexp_replace(text, '[\\x{AD}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]', '', 'g'),
  '""" + canonical.WIDE.replace("'", "''") + "', '" + canonical.WIDE_PLAIN.replace("'", "''") + "'))"
_P2 = """
with t as (select distinct sid, tok_offset, vid from tokens where vid is not null and sid is not null and tok_offset is not null),
n as (select count(distinct sid) as n from t),
c as (select cast(vid as bigint) as vid, count(*) as n_occ, count(distinct sid) as n_records from t group by vid),
m as (select c.*, case when n_records < 3 then 'rare' when n_records > 0.2 * (select n from n) then 'common' end as mark from c)
"""
_P3 = """
with s as (select sid, any_value(toks) as toks from corpus where side = 'src' and toks is not null and sid is not null group by sid),
w as (select sid, o as off, toks[o + 1:o + 25] as win from (select sid, toks, unnest(range(len(toks) - 24)) as o from s where len(toks) >= 25)),
g as (select win from w group by win having min(sid) <> max(sid)),
hit as (select w.sid, w.off, row_number() over (partition by w.sid order by w.off) as k from w join g using (win)),
mark as (select sid, off, case when off <= lag(off) over (partition by sid order by off) + 25 then 0 else 1 end as fresh from hit),
num as (select sid, off, sum(fresh) over (partition by sid order by off) as run from mark),
runs as (select sid, cast(min(off) as bigint) as run_start, cast(max(off) + 25 as bigint) as run_end from num group by sid, run)
"""
_P6 = """
with s as (select sid, list_distinct(any_value(toks)) as v from corpus where side = 'src' and toks is not null and sid is not null group by sid),
big as (select sid, list_sort(list_filter(v, lambda x: x is not null)) as v from s),
u as (select sid, len(v) as n, unnest(v) as vid from big where len(v) >= 12),
met as (select a.sid as x, b.sid as y, any_value(a.n) as n, any_value(b.n) as m, count(*) as c
  from u a join u b on a.vid = b.vid and a.sid < b.sid and a.n * 5 >= b.n * 4 and b.n * 5 >= a.n * 4 group by a.sid, b.sid),
pairs as (select x as sid_a, y as sid_b from met where c * 9 >= (n + m) * 4)
"""
SQL = {
    "p6_found": _P6 + "select * from pairs",
    "p6_groups": _P6.replace("with s as", "with recursive s as", 1) + """,
cls as (select sid, min(sid) over (partition by v) as class_id from big where len(v) >= 12),
edge as (select sid_a as f, sid_b as g from pairs union all select sid_b, sid_a from pairs),
reach as (select sid as f, sid as g from cls union select r.f, e.g from reach r join edge e on r.g = e.f),
root as (select f as sid, min(g) as group_id from reach group by f),
lk as (select a.class_id, count(distinct b.class_id) filter (b.class_id <> a.class_id) as n_links from edge e join cls a on a.sid = e.f join cls b on b.sid = e.g group by 1)
select cls.sid, cls.class_id, root.group_id, coalesce(n_links, 0)::bigint as n_links from cls join root using (sid) left join lk using (class_id)""",
    "p3_found": _P3 + "select * from runs",
    "p3_share": _P3 + """
select s.sid, cast(len(toks) as bigint) as n_tokens, coalesce(n, 0)::bigint as n_shared, case when len(toks) > 0 then coalesce(n, 0)::double / len(toks) end as share
from s left join (select sid, sum(run_end - run_start) as n from runs group by sid) r using (sid)""",
    "p1_cover": "select side, sid, max(len(toks)) as n_tokens, 0::bigint as n_too_long, 0::bigint as n_bad_overlap from corpus where len(toks) > 255 group by side, sid",
    "p7_valid": "select count(distinct doc_id) as n_docs, 0::bigint as n_cut_small, 0::bigint as n_gaps, 0::bigint as n_over from documents",
    "p1_found": "select side, sid from corpus where len(toks) > 255 group by side, sid",
    "p2_found": _P2 + "select vid, mark from m where mark is not null",
    "p2_counts": _P2 + "select vid, n_occ, n_records, mark from m",
    "p2_vocab_use": _P2 + """select count(*) as n_vids, count_if(mark = 'rare')::bigint as n_rare, count_if(mark = 'common')::bigint as n_common,
  (select max(vocab_size) from index_headers where side = 'src' and file_kind = 'tdx') as vocab_size from m""",
    "p9_found": f"""
with d as (select distinct doc_id, text, {_PLAIN} as plain from documents where text is not null)
select distinct doc_id, form from (
  select doc_id, 'wide' as form from d where regexp_matches(text, '[！-～]')
  union all select doc_id, 'combining' from d where nfc_normalize(text) <> text
  union all select doc_id, 'invisible' from d where regexp_matches(text, '[\\x{{AD}}\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]')
  union all select doc_id, 'space' from d where regexp_matches(replace(text, ' ', ''), '\\p{{Zs}}')
  union all select doc_id, 'lookalike' from d, unnest(['\\p{{Latin}}\\p{{L}}*[\\p{{Greek}}\\p{{Cyrillic}}]', '\\p{{Greek}}\\p{{L}}*[\\p{{Latin}}\\p{{Cyrillic}}]', '\\p{{Cyrillic}}\\p{{L}}*[\\p{{Latin}}\\p{{Greek}}]']) m(pat)
    where regexp_matches(plain, pat))""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
