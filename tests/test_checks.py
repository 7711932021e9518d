from collections import Counter
from datetime import datetime, timedelta

import pytest

from phraseloom.operators.references import asof_match, key_runs, orphan_references
from phraseloom.operators.skew import heavy_keys, hot_keys, salted_aggregate

T0 = datetime(2024, 1, 31, 23)
DAY = timedelta(days=1)
CORPUS = "side string, sid bigint, toks array<int>, segment_id bigint, ingested_at timestamp, deleted_at timestamp, at timestamp, found boolean, blk int"
ALIGN = "sid bigint, links array<struct<src:int,trg:int>>, ingested_at timestamp, side string, n_tok int"
SAMPLES = "sample_id bigint, phrase_id bigint, sid bigint, tok_offset int, sampled_at timestamp, reason string, salt int"


def test_runs_and_asof(spark):
    keys = [0, 1, 2, 5, 5, 7, 65535, 65536, None]
    df = spark.createDataFrame([("g", k) for k in keys], "g string, k bigint")
    runs = key_runs(df, ["g"], "k")
    assert sorted((r.run_start, r.run_end) for r in runs.collect()) == [(0, 2), (5, 5), (7, 7), (65535, 65535), (65536, 65536)]
    refs = spark.createDataFrame([("g", k) for k in (0, 2, 3, 4, 5, 6, 8, 65536, 65537, 200000)] + [("h", 0)], "g string, k bigint")
    got = {(r.g, r.k): r.found for r in asof_match(refs, runs, ["g"], "k", []).collect()}
    assert got == {("g", k): k in keys for k in (0, 2, 3, 4, 5, 6, 8, 65536, 65537, 200000)} | {("h", 0): False}


def test_orphans(spark):
    n = (None, None, None)
    corpus = [
        ("src", 1, [2, 3], 0, T0, None, *n), ("src", 1, [2, 3], 0, T0 - DAY, None, *n), ("trg", 1, [2], 0, T0, None, *n),
        ("src", 2, [4], 0, T0, T0, *n), ("trg", 2, [4], 0, T0, None, *n),
        ("src", 3, None, 0, T0 + DAY, None, *n), ("trg", 3, [5], 0, T0 - DAY, None, *n),
        (None, 9, [1], 0, T0, None, *n), ("src", None, [1], 0, T0, None, *n),
    ]
    align = [
        (1, [(0, 0), (2, 0), (255, 255), (1, 1), (None, 0)], T0, "x", 1), (1, [(0, 0), (2, 0), (255, 255), (1, 1), (None, 0)], T0 + DAY, "x", 1),
        (2, [(0, 0)], T0, "x", 1), (3, [(9, 7)], T0, "x", 1), (4, None, T0, "x", 1), (None, [(0, 0)], T0, "x", 1), (5, [], None, "x", 1),
    ]
    samples = [(10, 1, 1, 0, T0, "x", 1), (11, 1, 2, 0, T0, "x", 1), (11, 1, 2, 0, T0, "x", 1), (12, 1, 3, 0, T0, "x", 1), (13, 1, None, 0, T0, "x", 1), (14, None, 99, 0, T0, "x", 1), (15, 1, 3, 0, T0 + 2 * DAY, "x", 1), (16, 1, 3, 0, None, "x", 1)]
    df = orphan_references(spark.createDataFrame(corpus, CORPUS), spark.createDataFrame(align, ALIGN), spark.createDataFrame(samples, SAMPLES))
    m = "2024-01"
    assert sorted(tuple(r)[:7] for r in df.where("ref_table = 'alignment'").collect() if r.period) == sorted(
        [
            ("alignment", "src", 1, 1, "src", "missing", m), ("alignment", "trg", 1, 3, "trg", "missing", m), ("alignment", "sid", 2, -1, "src", "deleted", m),
            ("alignment", "sid", 3, -1, "src", "later", m), ("alignment", "trg", 3, 0, "trg", "missing", m), ("alignment", "sid", 4, -1, "src", "missing", m), ("alignment", "sid", 4, -1, "trg", "missing", m),
        ]
    )
    assert sorted((r.ref_key, r.side, r.reason) for r in df.where("period is null").collect()) == [(5, "src", "missing"), (5, "trg", "missing")]
    assert sorted((r.ref_key, r.reason) for r in df.where("ref_table = 'sampled_positions'").collect()) == [(11, "deleted"), (12, "later"), (14, "missing")]


@pytest.mark.parametrize("empty", [0, 1, 2])
def test_orphans_of_empty_tables(spark, empty):
    tables = [
        spark.createDataFrame([("src", 1, [2], 0, T0, None, None, None, None)], CORPUS), spark.createDataFrame([(1, [(0, 0)], T0, "x", 1)], ALIGN), spark.createDataFrame([(10, 1, 1, 0, T0, "x", 1)], SAMPLES),
    ]
    tables[empty] = tables[empty].limit(0)
    got = {(r.ref_table, r.side) for r in orphan_references(*tables).collect()}
    assert got == ({("alignment", "src"), ("alignment", "trg"), ("sampled_positions", "src")} if empty == 0 else {("alignment", "trg")} if empty == 2 else set())


def test_salted_aggregate(spark):
    rows = [(7 if i % 3 else i, i % 50 if i % 11 else None, i) for i in range(900)] + [(None, 1, 1)] + [(7, 3, 3)] * 5
    df = spark.createDataFrame(rows, "k int, d int, salt int").withColumnRenamed("salt", "n")
    assert heavy_keys(df, "k", 0.1) == [7] and heavy_keys(df.limit(0), "k", 0.1) == []
    for share in (0.1, 1.1):
        got = {r.k: (r.n_rows, r.n_distinct, r.lowest, r.highest) for r in salted_aggregate(df, "k", "d", "n", "n", share=share, salts=4).collect()}
        want = {}
        for k in {r[0] for r in rows} - {None}:
            mine = [r for r in rows if r[0] == k]
            want[k] = (len(mine), len({r[1] for r in mine} - {None}), min(r[2] for r in mine), max(r[2] for r in mine))
        assert got == want
    counts = Counter(r[0] for r in rows)
    assert {r.k: r.n_rows for r in salted_aggregate(df, "k").collect()} == {k: n for k, n in counts.items() if k is not None}


def test_hot_keys(spark):
    rows = [(1,)] * 3 + [(2,)] * 2 + [(None,)] * 95
    df = spark.createDataFrame(rows, "k int")
    assert [(r.k, r.n_rows) for r in hot_keys(df, "k", 0.03).collect()] == [(1, 3)]
    assert hot_keys(df.limit(0), "k", 0.03).count() == 0 and salted_aggregate(df.limit(0), "k", "k").count() == 0
