import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from phraseloom.operators import corpus as C
from phraseloom.operators import phrases as P
from phraseloom.operators import sampling as S
from phraseloom.operators import suffix as X
from phraseloom.operators.index import TokenIndex, to_merge
from phraseloom.operators.ordered import OrderedMap, children_sums, key_at, ranked, running_total
from phraseloom.schemas import SENTENCES
from tests import simulator as sim

WORDS = {1: "</s>", 2: "bit", 3: "cat", 4: "dog", 5: "mat", 6: "on", 7: "the"}
SENTS = {0: [7, 4, 2, 7, 3, 6, 7, 5], 1: [7, 4, 2], 2: [7]}


def frame(spark, sents):
    return spark.createDataFrame(list(sents.items()), SENTENCES)


def order(sa):
    return [(r.sid, r.off) for r in sa.orderBy("rank").collect()]


def phrases(spark, qs):
    return spark.createDataFrame(list(enumerate(qs)), "phrase_id bigint, q array<int>")


@pytest.fixture(scope="module")
def index(spark):
    return TokenIndex.build(frame(spark, SENTS))


def test_one_sentence(spark):
    ix = TokenIndex.build(frame(spark, {0: SENTS[0]}))
    assert [o for _, o in order(ix.sa)] == [2, 4, 1, 7, 5, 3, 0, 6]
    assert ix.span().size() == 8


def test_three_sentences(index):
    assert order(index.sa) == [(1, 2), (0, 2), (0, 4), (1, 1), (0, 1), (0, 7), (0, 5), (2, 0), (0, 3), (1, 0), (0, 0), (0, 6)]


def test_narrowing(spark):
    ix = TokenIndex.build(frame(spark, {0: SENTS[0]}))
    assert ix.span().narrow(2)[1] == 1
    span, n = ix.span().narrow(7)
    assert n == 3
    missed, n = ix.span().narrow(2)[0].narrow(4)
    assert n == 0 and missed.size() == 1 and missed.depth() == 1
    span, n = span.narrow(3)
    assert n == 1 and span.sequence == (7, 3) and span.at(0) == (0, 3) and span.bounds() == (5, 6)
    with pytest.raises(IndexError):
        span.at(1)
    assert span.at_unchecked(1) == (0, 0) and span.at_unchecked(-1) == (0, 5)


def test_span_on_trie(index):
    trie = index.trie(4)
    the, _ = index.span().narrow(7)
    assert the.tree_depth(trie) == 1 and not the.in_array(trie)
    dog, n = the.narrow(4)
    assert n == 2 and dog.in_array(trie) and dog.tree_path(trie) == [(), (7,), (7, 4)]
    assert {r.vid: r.n for r in the.next_tokens().collect()} == {1: 1, 3: 1, 4: 2, 5: 1}
    assert dog.sample(10).count() == 2 and order(dog.positions()) == [(1, 0), (0, 0)]


@pytest.mark.parametrize("sids, leaf", [((0, 1), 7), ((0, 1, 2), 4)])
def test_dump(spark, sids, leaf):
    sents = {s: SENTS[s] for s in sids}
    words = spark.createDataFrame(list(WORDS.items()), "vid bigint, surface string")
    lines = [r.line for r in TokenIndex.build(frame(spark, sents)).dump(words, leaf).orderBy("line_no").collect()]
    assert lines == list(sim.dump(sim.build(sents, leaf), WORDS))


def test_shape_and_order_follow_insertion(spark):
    rng = random.Random(5)
    for trial in range(2):
        sents = {s: [rng.choice([2, 2, 2, 3, 4]) for _ in range(rng.randint(0, 9))] for s in range(12)}
        for leaf in (1, 3):
            root = sim.build(sents, leaf)
            ix = TokenIndex.build(frame(spark, sents), leaf)
            assert order(ix.sa) == list(sim.flat(root))
            assert sorted((tuple(r.path), r.n, r.is_leaf) for r in ix.trie().collect()) == sorted(sim.shape(root))


def test_shape_of_a_preloaded_root(spark):
    rng = random.Random(6)
    sents = {s: [rng.choice([2, 2, 3]) for _ in range(rng.randint(1, 8))] for s in range(10)}
    root = sim.build(sents, 3, preload=range(5))
    first = frame(spark, {s: t for s, t in sents.items() if s < 5})
    array = TokenIndex.build(first).sa.select("rank", "sid", "off")
    ix = TokenIndex.load(first, array, 3).add(frame(spark, {s: t for s, t in sents.items() if s >= 5}))
    assert order(ix.sa) == list(sim.flat(root))
    assert sorted((tuple(r.path), r.n, r.is_leaf) for r in ix.trie().collect()) == sorted(sim.shape(root))


def test_end_of_sentence_leaves_never_split(spark):
    sents = {s: [2] for s in range(40)}
    ix = TokenIndex.build(frame(spark, sents), 3)
    assert sorted((tuple(r.path), r.n, r.is_leaf) for r in ix.trie().collect()) == [((), 40, False), ((2,), 40, False), ((2, 1), 40, True)]


def test_batches_do_not_matter(spark, index):
    a = TokenIndex.build(frame(spark, {0: SENTS[0]}))
    grown = a.add(frame(spark, {1: SENTS[1]})).add(frame(spark, {2: SENTS[2]}))
    merged = a.merge(TokenIndex.build(frame(spark, {s: SENTS[s] for s in (1, 2)})))
    assert order(grown.sa) == order(index.sa) == order(merged.sa)
    assert grown.equals(index) and not grown.equals(a)


def brute(sents, q):
    return [(s, o) for s, t in sents.items() for o in range(len(t)) if (t + [1])[o : o + len(q)] == q]


def test_phrases_against_brute_force(spark):
    rng = random.Random(7)
    sents = {s: [rng.choice([2, 3, 4]) for _ in range(rng.randint(0, 8))] for s in range(20)}
    qs = [[rng.choice([2, 3, 4]) for _ in range(n)] for n in (1, 1, 2, 2, 3, 3, 4)] + [[2, 1], [1], [9], [], [2, 9, 3], [2] * 12]
    ph, df = phrases(spark, qs), frame(spark, sents)
    want = [brute(sents, q) if q else [] for q in qs]
    assert {r.phrase_id: r.n for r in P.phrase_counts(df, ph).collect()} == {i: len(w) for i, w in enumerate(want)}
    hits = {}
    for r in P.matches(df, ph).collect():
        hits.setdefault(r.phrase_id, set()).add((r.sid, r.off))
    assert hits == {i: set(w) for i, w in enumerate(want) if w}
    ix = TokenIndex.build(df)
    sa = ix.sa
    assert {r.phrase_id: r.n for r in ix.counts(ph).collect()} == {i: len(w) for i, w in enumerate(want)}
    ranks = {p: k for k, p in enumerate(order(sa))}
    for r in ix.ranges(ph).collect():
        assert sorted(ranks[p] for p in want[r.phrase_id]) == list(range(r.begin, r.end))
    located = {}
    for r in ix.locate(ph).orderBy("phrase_id", "k").collect():
        located.setdefault(r.phrase_id, []).append((r.sid, r.off))
    assert located == {i: sorted(w, key=ranks.get) for i, w in enumerate(want) if w}
    for r in S.valid_matches(sa, ph, df).collect():
        assert r.n == len(want[r.phrase_id]) and r.outside == 0


def test_narrow_trace_keeps_the_span_on_a_miss(spark):
    rows = P.narrow_trace(frame(spark, SENTS), phrases(spark, [[7, 9, 4], [2, 7], []])).orderBy("phrase_id", "depth").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 5, 1), (0, 2, 0, 1), (0, 3, 2, 2), (1, 1, 2, 1), (1, 2, 1, 2)]


def test_order_of_long_copies(spark):
    rng = random.Random(11)
    base = [rng.choice([2, 3]) for _ in range(200)]
    sents = {s: base[rng.randrange(100) :] + [rng.choice([2, 3, 4]) for _ in range(rng.randrange(3))] for s in range(12)} | {50: [2] * 400, 51: [2] * 400, 52: [], 54: [3]}
    want = sorted(((s, o) for s, t in sents.items() for o in range(len(t))), key=lambda p: (sents[p[0]][p[1] :], p))
    for local_rows in (0, 1_000_000):  # in rounds over all tasks, and in one task
        sa, n = X.suffix_array(X.keyed(frame(spark, sents)), local_rows)
        assert n == len(want) and order(sa) == want and [r.rank for r in sa.select("rank").orderBy("rank").collect()] == list(range(n))


def test_long_sentences_are_whole(spark):
    sents = {0: [5] * 254 + [8, 9] + [5] * 100, 1: [8, 9]}
    df = frame(spark, sents)
    qs = [[8, 9], [8, 1], [9, 1], [5] * 254 + [8], [5] * 300, sents[0], [5, 1]]
    want = {i: len(brute(sents, q)) for i, q in enumerate(qs)}
    ph, ix = phrases(spark, qs), TokenIndex.build(df)
    assert {r.phrase_id: r.n for r in P.phrase_counts(df, ph).collect()} == want
    assert {r.phrase_id: r.n for r in ix.counts(ph).collect()} == want
    assert {i: ix.locate(ph).where(f"phrase_id = {i}").count() for i in want} == want
    with pytest.raises(PySparkException):
        TokenIndex.build(df, on_long="error").span()
    cut = C.Corpus.from_text(spark.createDataFrame([(0, " ".join("a" * 300))], "i int, t string"), "i", "t", on_long="chunk")
    assert [len(r.toks) for r in cut.sents.orderBy("sid").collect()] == [255, 45]


@pytest.mark.parametrize("bad", [[8, None], [8, 0], [1, 8]])
def test_bad_tokens_fail_everywhere(spark, bad):
    df, ph = frame(spark, {0: [8, 9], 1: bad}), phrases(spark, [[8]])
    for job in (lambda: P.phrase_counts(df, ph).collect(), lambda: TokenIndex.build(df), lambda: TokenIndex.build(frame(spark, SENTS)).add(df), lambda: P.ngram_counts(df, 1).collect()):
        with pytest.raises(PySparkException):
            job()


def test_counts_agree_with_located_rows(spark):
    rng = random.Random(12)
    sents = {s: [rng.choice([2, 3, 4]) for _ in range(rng.choice([0, 1, 3, 20, 300]))] for s in range(25)}
    qs = [t[o : o + n] for s, t in sents.items() if t for n in (1, 2, 9, 40) for o in [rng.randrange(len(t))]] + [[2, 3] * 8]
    ix = TokenIndex.build(frame(spark, {s: t for s, t in sents.items() if s < 12})).add(frame(spark, {s: t for s, t in sents.items() if s >= 12}))
    ph = phrases(spark, qs)
    assert len(ix.runs) == 2
    counts = {r.phrase_id: r.n for r in ix.counts(ph).collect()}
    located = {r.phrase_id: r["count"] for r in ix.locate(ph).groupBy("phrase_id").count().collect()}
    assert counts == {i: len(brute(sents, q)) for i, q in enumerate(qs)} and {i: n for i, n in counts.items() if n} == located
    some = phrases(spark, [q for q in qs if len(q) <= 2])
    for r in ix.sample(some, 7).collect():
        q = [q for q in qs if len(q) <= 2][r.phrase_id]
        assert (sents[r.sid] + [1])[r.off : r.off + len(q)] == q
    # A large batch is not broadcast and combines before its shuffle; the result is the same.
    import dataclasses

    large = dataclasses.replace(P.Batch.of(ph), small=False)
    assert sorted(map(tuple, P.bounds(ix.sa, large, ix.sents).select("begin", "end").collect())) == sorted(map(tuple, P.bounds(ix.sa, P.Batch.of(ph), ix.sents).select("begin", "end").collect()))


def test_the_stored_index_is_pruned(spark, index, tmp_path):
    index.save(str(tmp_path / "ix"))
    kept = TokenIndex.open(spark, str(tmp_path / "ix"))
    assert kept.equals(index) and kept.n == 12 and kept.max_leaf == index.max_leaf
    span, n = kept.span().narrow(7)
    assert n == 5 and span.narrow(4)[1] == 2 and span.bounds() == (7, 12)
    plan = span.rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(v0,7)" in plan and "GreaterThanOrEqual(rank,7)" in plan
    batch = P.Batch.of(phrases(spark, [[7, 4], [2]]))
    plan = P.hits(kept.sa, batch, kept.sents, ["rank"])._jdf.queryExecution().executedPlan().toString()
    assert "In(v0, [2,7])" in plan.replace("[7,2]", "[2,7]")


def test_deep_narrowing(spark):
    ix = TokenIndex.build(frame(spark, {0: list(range(2, 30)), 1: list(range(2, 20)) + [99]}))
    span = ix.span()
    for v in range(2, 19):
        span, n = span.narrow(v)
        assert n == 2
    assert span.narrow(50) == (span, 0) and {r.vid for r in span.next_tokens().collect()} == {19}
    span, _ = span.narrow(19)
    assert {r.vid: r.n for r in span.next_tokens().collect()} == {20: 1, 99: 1} and span.narrow(99)[0].at(0) == (1, 0)


def test_append_leaves_old_positions_alone(spark, index, monkeypatch):
    seen = []
    whole = X.suffix_array
    monkeypatch.setattr("phraseloom.operators.index.suffix_array", lambda rows, *a: seen.append(rows.count()) or whole(rows, *a))
    grown = index.add(frame(spark, {5: [7, 4]}))
    assert seen == [2] and [r.n for r in grown.runs] == [12, 2]
    assert [r.n for r in grown.compact().runs] == [12, 2] and [r.n for r in grown.compact(100).runs] == [14]
    assert to_merge([200, 20, 10, 5]) == 3 and to_merge([100, 1]) == 1 and to_merge([]) == 0
    with pytest.raises(KeyError):
        index.add(frame(spark, {6: [44]}), spark.createDataFrame([(7,)], "vid bigint"))


def test_an_array_that_does_not_fit_is_refused(spark):
    df = frame(spark, {0: [7, 4]})
    good = [(0, 0, 1), (1, 0, 0)]
    schema = "rank bigint, sid bigint, off int"
    assert TokenIndex.load(df, spark.createDataFrame(good, schema)).n == 2
    for bad in (good[:1], [(0, 0, 1), (1, 9, 0)], [(0, 0, 1), (0, 0, 0)], [*good, (2, 0, 2)], [(0, 0, 1), (2, 0, 0)]):
        with pytest.raises(ValueError):
            TokenIndex.load(df, spark.createDataFrame(bad, schema))


def test_deep_trie(spark):
    sents = {s: [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5, 6, 7, 8, 9, 3, s % 3 + 2, 4] for s in range(9)}
    for leaf in (3,):
        root = sim.build(sents, leaf)
        got = TokenIndex.build(frame(spark, sents), leaf).trie()
        assert sorted((tuple(r.path), r.n, r.is_leaf) for r in got.collect()) == sorted(sim.shape(root))


def test_end_anchored(spark):
    df = frame(spark, SENTS)
    got = P.phrase_counts(df, P.anchored(phrases(spark, [[5], [7], [4]])))
    assert {r.phrase_id: r.n for r in got.collect()} == {0: 1, 1: 1, 2: 0}


def test_empty_index(spark):
    df = spark.createDataFrame([], SENTENCES)
    ix = TokenIndex.build(df)
    ph = phrases(spark, [[2], [1]])
    assert ix.span().size() == 0 and ix.span().narrow(2)[1] == 0
    assert {r.n for r in ix.counts(ph).collect()} == {0}
    assert ix.locate(ph).count() == 0 and ix.random_phrases(5).count() == 0
    assert P.next_tokens(df, ph).count() == 0 and ix.sample(ph).count() == 0 and ix.trie().count() == 1


def test_next_tokens_and_rollup(spark):
    df = frame(spark, SENTS)
    rows = P.next_tokens(df, phrases(spark, [[7]])).orderBy("vid").collect()
    assert [(r.vid, r.n, r.cum_before) for r in rows] == [(1, 1, 0), (3, 1, 1), (4, 2, 2), (5, 1, 4)]
    roll = {r.depth: (r.n_nodes, r.n_positions) for r in P.prefix_rollup(df, 2).collect()}
    assert roll[1] == (6, 12) and roll[2][1] == 12
    assert [(r.q, r.n) for r in P.top_ngrams(df, 2, 2).collect()] == [([4, 2], 2), ([7, 4], 2)]


def test_sampling_is_uniform_over_the_span_and_repeatable(spark, index):
    ph = phrases(spark, [[7], [2], [9]])
    a = sorted(map(tuple, index.sample(ph, 3).collect()))
    assert a == sorted(map(tuple, index.sample(ph, 3).collect()))
    assert [x[0] for x in a] == [0, 0, 0, 1, 1]
    for pid, _, sid, off in a:
        assert SENTS[sid][off] == [7, 2][pid]
    for r in index.random_phrases(30).collect():
        assert 1 <= len(r.q) <= 5 and brute(SENTS, r.q)
    drawn = [(r.sid, r.off) for r in index.span().sample(500).collect()]
    assert len(drawn) == 12 and set(drawn) <= {(s, o) for s, t in SENTS.items() for o in range(len(t))}


@pytest.mark.parametrize("n", [7, 1 << 40, (1 << 62) - 1])
def test_draws_reach_every_part_of_any_span(spark, n):
    x = [r.x for r in spark.range(4000).select(S.draw(F.lit(5), F.col("id"), F.lit(n).cast("bigint")).alias("x")).collect()]
    tenths = [sum(1 for v in x if k * n / 7 <= v < (k + 1) * n / 7) for k in range(7)]
    assert all(0 <= v < n for v in x) and all(450 < t < 700 for t in tenths)
    big = spark.range(1).select(S.draw(F.lit((1 << 62) + 11), F.lit(-3), F.lit(n).cast("bigint")).alias("x")).first().x
    assert 0 <= big < n


def test_ranked_and_running_total(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([1, 1, 1, 2])) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, k int")
    got = [(r.k, r.i) for r in ranked(df, ["k", "i"], start=5).orderBy("rank").collect()]
    assert got == sorted((k, i) for i, k in rows)
    assert [r[0] for r in ranked(df, ["k", "i"], start=5).select("rank").orderBy("rank").collect()] == list(range(5, 305))
    sums = {r.i: r.cum_before for r in running_total(df, "i", "k").collect()}
    assert sums == {i: sum(k for j, k in rows if j < i) for i, _ in rows}
    assert ranked(df.limit(0), ["i"]).count() == 0 and running_total(df.limit(0), "i", "k").count() == 0


@pytest.mark.parametrize("keys", [[2, 1, 4, 3, 7], [2], [], [4, 2, 6, 1, 3]])
def test_ordered_map(spark, keys):
    m = OrderedMap(spark.createDataFrame([(k, k) for k in keys], "key int, n bigint"))
    assert [r.key for r in m.walk().collect()] == sorted(keys)
    assert m.size() == sum(keys) and m.count() == len(keys) and m.empty() == (not keys)
    if keys:
        assert m.contains(keys[0]) and m.find(keys[0]) == keys[0] and not m.contains(99) and m.find(99) is None
        units = [(k, j) for k in sorted(keys) for j in range(k)]
        assert [m.at(i) for i in (0, len(units) - 1)] == [units[0], units[-1]] and m.at(len(units)) is None
        assert m.add(keys[0], 5).find(keys[0]) == keys[0] + 5 and m.add(50, 1).size() == m.size() + 1 and m.put(keys[0], 1).find(keys[0]) == 1


def test_key_at(spark):
    counts = spark.createDataFrame([(0, 5, 2), (0, 7, 3), (1, 1, 1)], "p int, v int, n bigint")
    places = spark.createDataFrame([(0, 0), (0, 2), (0, 4), (0, 5), (1, 0)], "p int, k bigint")
    got = key_at(children_sums(counts, ["p"], "v", "n"), places, ["p"], "n")
    assert sorted((r.p, r.k, r.v, r.rest) for r in got.collect()) == [(0, 0, 5, 0), (0, 2, 7, 0), (0, 4, 7, 2), (1, 0, 1, 0)]
