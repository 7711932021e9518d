"""Splitting, counting, shared spans and near-duplicate sets against brute force."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phraseloom.llm import nearsets, spans, splitting, terms

MARKS = {1: 1, 2: 3, 3: 4}


def naive_split(toks, limit, overlap):
    """Merge the weakest boundary that fits, by looking at all of them each time."""
    room, n = limit - overlap, len(toks)
    if n <= limit:
        return [(n, 0)]
    ends, at = [], 0
    for k in range(n):
        if (MARKS.get(toks[k], 0) and k + 1 < n) or k + 1 - at == room or k + 1 == n:
            # A hard cut is made only where the atom goes on.
            mark = MARKS.get(toks[k], 0) if k + 1 < n else 0
            ends.append((k + 1, mark))
            at = k + 1
    while True:
        best = None
        for i in range(len(ends) - 1):
            start = ends[i - 1][0] if i else 0
            size = ends[i + 1][0] - start
            if size + (overlap if start else 0) <= limit:
                best = min(best or (9, 0, 0, 0), (ends[i][1], size, i, 0))
        if best is None:
            return ends
        del ends[best[2]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([1, 2, 3, 9, 9, 9, None]), max_size=60), st.integers(4, 12), st.integers(0, 3))
def test_split_against_naive(toks, limit, overlap):
    got = splitting.split_points(toks, MARKS, limit, overlap)
    assert got == naive_split(toks, limit, overlap)
    ends = [e for e, _ in got]
    assert ends == sorted(set(ends)) and ends[-1] == len(toks)
    starts = [0, *[max(0, e - overlap) for e in ends[:-1]]]
    assert all(e - s <= limit for s, e in zip(starts, ends))


def test_split_refuses_an_overlap_as_long_as_the_limit():
    with pytest.raises(ValueError):
        splitting.split_points([9] * 10, {}, 4, 4)


VOCAB = "side string, vid bigint, surface string, is_alias boolean"
CORPUS = "side string, sid bigint, toks array<int>, segment_id bigint, ingested_at timestamp, piece int, n int"


def test_split_table(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    vocab = spark.createDataFrame([("src", 2, ".", None), ("src", 2, ".", None), ("src", 3, "<p>", False), ("src", None, ",", False), (None, 4, ",", False), ("trg", 9, ".", False)], VOCAB)
    long = [9, 9, 9, 9, 2, 9, 9, 9, 3, None, 9]
    rows = [("src", 1, long, None, t, 1, 1), ("src", 1, long, 5, t, 1, 1), ("src", 2, [9] * 6, 5, t, 1, 1), ("trg", 1, long, 5, t, 1, 1), ("src", 3, None, 5, t, 1, 1), ("src", 4, [], 5, t, 1, 1)]
    corpus = spark.createDataFrame(rows, CORPUS)
    got = splitting.split_sequences(corpus, vocab, 6, 1)
    src = [(r.piece, r.start, r.end, r.new_from, r.natural, r.toks) for r in got.where("side = 'src'").orderBy("piece").collect()]
    assert src == [(0, 0, 5, 0, True, long[:5]), (1, 4, 9, 5, True, long[4:9]), (2, 8, 11, 9, True, long[8:])]
    assert splitting.split_sequences(corpus.limit(0), vocab, 6, 1).count() == 0
    assert splitting.split_sequences(corpus, vocab.limit(0), 6, 1).where("side = 'src' and natural").count() == 1
    headers = spark.createDataFrame([("six", "src", 5, "M", 4, t), ("six", "src", 5, "bad", 9, t), ("six", "trg", 5, "M", None, t)], "file_kind string, side string, segment_id bigint, version_magic string, idx_size bigint, written_at timestamp")
    sizes = {r.side: (r.n_sentences, r.n_pieces, r.idx_size, r.differs) for r in splitting.segment_sizes(corpus, vocab, headers, ["M"], 6, 1).collect()}
    assert sizes["src"] == (4, 6, 4, False) and sizes["trg"][0] == 1 and sizes["trg"][2] is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=4), st.integers(1, 3), st.integers(1, 3)), max_size=80), st.integers(1, 5))
def test_burst_trie(adds, burst):
    trie, want = terms.BurstTrie(burst), defaultdict(lambda: [0, 0])
    for k, o, r in adds:
        trie.add(k, o, r)
        want[k][0] += o
        want[k][1] += r
    merged = terms.BurstTrie(burst + 1)
    for _ in range(2):
        for prefix, tails, occ, rec in trie.subtrees():
            merged.graft(prefix, zip(tails, occ, rec))
    got = {p + t: [o, r] for p, ts, os, rs in merged.subtrees() for t, o, r in zip(ts, os, rs)}
    assert got == {k: [2 * o, 2 * r] for k, (o, r) in want.items()} and merged.size == trie.size == len(want)


@given(st.lists(st.integers(-(1 << 62), 1 << 62), min_size=2, max_size=2))
def test_int_keys_keep_order(v):
    a, b = v
    assert terms.key_int(terms.int_key(a)) == a
    if a >= 0 and b >= 0:
        assert (a < b) == (terms.int_key(a) < terms.int_key(b))


def test_routes_of_any_length(spark):
    words = [f"internationalisation{x:03d}" for x in range(400)] + ["in", "zebra"]
    df = spark.createDataFrame([(w, i % 7, i) for i, w in enumerate(words * 2)], "t string, rec int, pos int")
    got = {r.t: (r.n_occ, r.n_records) for r in terms.term_counts(df, "t", "rec", "pos", route_terms=50).collect()}
    assert got == {w: (2, len({i % 7 for i in (k, k + len(words))})) for k, w in enumerate(words)}
    trees = spark.createDataFrame([(b"", [w.encode() for w in words], [1] * len(words), [1] * len(words))], terms._SUBTREE)
    weights = {b"in": 401, b"ze": 1}
    routes = terms.deeper_routes(trees, terms.choose_routes(weights, 50), weights, 50)
    assert max(map(len, routes)) >= 20 and len(set(routes.values())) == len(routes)


def test_routes_split_where_terms_are_many():
    routes = terms.choose_routes({b"aa": 10, b"ab": 10, b"b": 1, b"a": 1, b"": 1}, target=11)
    assert set(routes) == {b"", b"a", b"b", b"aa", b"ab"}
    assert set(terms.choose_routes({b"a": 5})) == {b""} and terms.choose_routes({}) == {b"": 0}


@pytest.mark.parametrize("text, heavy", [(False, 10**6), (True, 10**6), (True, 5), (False, 5)])
def test_term_counts(spark, monkeypatch, text, heavy):
    monkeypatch.setattr(terms, "HEAVY_ROWS", heavy)
    rng = random.Random(3)
    rows = [(rng.randrange(12), rng.randrange(30), rng.choice([0, 1, 1, 1, 2, 300, 70000, None])) for _ in range(400)]
    rows += rows[:50] + [(None, 1, 5), (1, None, 5)] + [(7, 0, 1)] * 200
    rows = [(r, p, None if v is None else f"wörd{v}" if text else v, 1, 2) for r, p, v in rows]
    df = spark.createDataFrame(rows, f"rec int, pos int, t {'string' if text else 'int'}, term int, record int")
    seen = {(r, p, v) for r, p, v, *_ in rows if None not in (r, p, v)}
    n = len({r for r, _, _ in seen})
    want = {}
    for v in {v for _, _, v in seen}:
        recs = {r for r, _, x in seen if x == v}
        want[v] = (sum(x == v for _, _, x in seen), len(recs), "rare" if len(recs) < 3 else "common" if len(recs) > 0.2 * n else None)
    got = {r.t: (r.n_occ, r.n_records, r["mark"]) for r in terms.term_counts(df, "t", "rec", "pos").collect()}
    assert got == want
    assert terms.term_counts(df.limit(0), "t", "rec", "pos").count() == 0


def brute_runs(seqs, length):
    where = defaultdict(set)
    for s, t in seqs.items():
        for o in range(len(t) - length + 1):
            if None not in t[o : o + length]:
                where[tuple(t[o : o + length])].add(s)
    out = set()
    for s, t in seqs.items():
        hit = [False] * (len(t) + 1)
        for o in range(len(t) - length + 1):
            if len(where.get(tuple(t[o : o + length]), ())) > 1:
                hit[o : o + length] = [True] * length
        start = None
        for i, h in enumerate(hit):
            if h and start is None:
                start = i
            if not h and start is not None:
                out.add((s, start, i))
                start = None
    return out


def test_shared_runs(spark):
    rng = random.Random(4)
    seqs = {}
    base = [rng.randrange(2, 40) for _ in range(60)]
    for s in range(14):
        t = list(base[rng.randrange(20) : rng.randrange(30, 60)])
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice([None, 3, 99])
        seqs[s] = t
    seqs |= {20: [5] * 30, 21: [5] * 3, 22: [5, 6] * 15 + [5, 6] * 15, 23: [], 24: seqs[0], 25: [77, *[5] * 12]}
    rows = [(s, t, 1, 1) for s, t in seqs.items()] + [(0, seqs[0], 1, 1), (None, seqs[0], 1, 1), (30, None, 1, 1)]
    df = spark.createDataFrame(rows, "s bigint, toks array<int>, h int, places int")
    chains = spans.matched_chains(df, "s", "toks", length=8, k=4)
    runs = spans.shared_runs(chains)
    want = brute_runs(seqs, 8)
    assert {tuple(r) for r in runs.collect()} == want and len(want) > 5
    share = {r.sid: r for r in spans.shared_share(df, "s", "toks", runs).collect()}
    assert set(share) == set(seqs) and share[23].share is None and share[21].n_shared == 0
    assert share[24].n_shared == sum(e - b for s, b, e in want if s == 24)
    for p in spans.passages(chains, df, "s", "toks").collect():
        assert p.n_exact >= 8 and p.n_edits >= 0 and p.end - p.start >= p.n_exact
    assert spans.matched_chains(df.limit(0), "s", "toks").count() == 0


def brute_passages(seqs, length, k, gap_cost):
    """Chains of all pairs of different texts, and of each further copy with the first of its class."""
    first, out = {}, set()
    for s in sorted(seqs):
        first.setdefault(tuple(seqs[s]), s)
    for a, t in seqs.items():
        for b, u in seqs.items():
            if a <= b or first[tuple(u)] != b or (first[tuple(t)] != a and first[tuple(t)] != b):
                continue
            copy = t == u
            hits = [(x, y) for x in range(len(t) - k + 1) for y in range(len(u) - k + 1) if t[x : x + k] == u[y : y + k] and None not in t[x : x + k] and (not copy or x == y)]
            for line in spans.chain(spans.diagonals(hits, k), gap_cost):
                gaps = [(t[x + n : x2], u[y + n : y2]) for (x, y, n), (x2, y2, _) in zip(line, line[1:])]
                (x, y, _), (x2, y2, n), exact = line[0], line[-1], sum(n for *_, n in line)
                if exact >= length:
                    out.add((a, b, x, x2 + n, y, y2 + n, exact, sum(spans.edit_distance(*g) for g in gaps), copy))
    return out


@pytest.mark.parametrize("tile", [512, 2])
def test_passages_of_all_pairs(spark, tile):
    rng = random.Random(8)
    half = [[rng.randrange(2, 400) for _ in range(12)] for _ in range(2)]
    # 10 and 11 share both halves with an edit between them; 1 and 2 hold one half each.
    seqs = {1: [500, *half[0]], 2: [*half[1], 501], 10: [*half[0], 502, *half[1], 503], 11: [504, *half[0], 505, *half[1]]}
    base = [rng.randrange(2, 40) for _ in range(60)]
    for s in range(20, 36):
        t = list(base[rng.randrange(20) : rng.randrange(30, 60)])
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice([None, 3, 99])
        seqs[s] = t
    seqs |= {40: seqs[10], 41: seqs[10], 42: seqs[20], 43: [5] * 14, 44: [5] * 11, 45: [], 46: half[0][:7], 47: half[0][:7]}
    # No 8 tokens in a row are the same in 60 and 61, as every sixth is changed.
    seqs |= {60: [600 + i for i in range(48)], 61: [700 if i % 6 == 5 else 600 + i for i in range(48)]}
    rows = [(s, t, 1) for s, t in seqs.items()] + [(20, seqs[20], 1), (None, seqs[20], 1), (50, None, 1)]
    df = spark.createDataFrame(rows, "s bigint, toks array<int>, tile int")
    got = [tuple(r) for r in spans.passages(spans.pair_chains(df, "s", "toks", length=8, k=4, tile=tile), df, "s", "toks").collect()]
    assert set(got) == brute_passages(seqs, 8, 4, spans.GAP_COST) and len(got) == len(set(got))
    assert {r for r in got if r[:2] == (11, 10)} == {(11, 10, 1, 26, 0, 25, 24, 1, False)}
    assert {r for r in got if r[0] == 61} == {(61, 60, 0, 47, 0, 47, 40, 7, False)}
    assert {r[:2] for r in got if r[-1]} >= {(40, 10), (41, 10), (42, 20)} and not {r[0] for r in got if not r[-1]} & {40, 41, 42}
    assert spans.pair_chains(df.limit(0), "s", "toks").count() == 0


def test_chaining():
    a, b, c = (0, 100, 10), (15, 112, 10), (30, 5, 10)
    assert spans.chain([a, b, c], 0.25) == [[a, b], [c]]
    assert sorted(len(x) for x in spans.chain([a, b, c], 10)) == [1, 1, 1]
    assert spans.chain([]) == [] and spans.chain([a]) == [[a]]
    assert spans.diagonals([(0, 5), (1, 6), (9, 14), (3, 5)], 4) == [(0, 5, 5), (9, 14, 4), (3, 5, 4)]
    segs = [(x, x + 3, 2) for x in range(0, 60, 3)]
    assert spans.chain(segs, 0.1) == [segs]


@given(st.lists(st.integers(0, 3), max_size=7), st.lists(st.integers(0, 3), max_size=7))
def test_edit_distance(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    assert spans.edit_distance(a, b) == d[-1][-1]


def near_table(rng, n):
    rows = {}
    for s in range(n):
        if rows and rng.random() < 0.6:
            t = list(rng.choice(list(rows.values())))
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.randrange(2, 300)
            rng.shuffle(t)
        else:
            t = [rng.randrange(2, 60) for _ in range(rng.choice([8, 14, 20, 40, 90]))]
        rows[s] = t
    return rows


@pytest.mark.parametrize("wide, levels", [(64, 5), (2, 4), (2, 1)])
def test_near_sets(spark, wide, levels):
    rows = near_table(random.Random(wide * 10 + levels), 160)
    rows[500] = rows[0] + [None, None]
    data = [(s, t, 1, 1) for s, t in rows.items()] + [(0, rows[0], 1, 1), (None, rows[0], 1, 1), (600, None, 1, 1), (601, [], 1, 1)]
    df = spark.createDataFrame(data, "s bigint, toks array<int>, rep int, n int")
    classes, members = nearsets.set_classes(df, "s", "toks", 5)
    links = nearsets.close_classes(classes, 0.8, 5, wide, levels)
    got = [tuple(r) for r in nearsets.close_pairs(members, links).collect()]
    sets = {s: {x for x in t if x is not None} for s, t in rows.items()}
    big = [s for s in sorted(sets) if len(sets[s]) >= 5]
    want = {(a, b) for i, a in enumerate(big) for b in big[i + 1 :] if Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= Fraction(4, 5)}
    assert set(got) == want and len(got) == len(want) and len(want) > 30


def test_near_groups(spark):
    rows = near_table(random.Random(9), 120)
    df = spark.createDataFrame(list(rows.items()), "s bigint, toks array<int>")
    sets = {s: set(t) for s, t in rows.items() if len(set(t)) >= 5}
    root = {s: s for s in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = defaultdict(set)
    cls = {s: min(o for o in sets if sets[o] == sets[s]) for s in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
                if cls[a] != cls[b]:
                    links[cls[a]].add(cls[b])
                    links[cls[b]].add(cls[a])
    got = {r.sid: (r.class_id, r.group_id, r.n_links) for r in nearsets.near_groups(df, "s", "toks", 0.8, 5).collect()}
    assert got == {s: (cls[s], find(s), len(links[cls[s]])) for s in sets}
    assert nearsets.near_groups(df.limit(0), "s", "toks").count() == 0


def test_components_of_a_long_path(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([*zip(order, order[1:]), (100, 101)], "a bigint, b bigint")
    got = {r.node: r.root for r in nearsets.components(df).collect()}
    assert got == {i: 0 for i in range(n)} | {100: 100, 101: 100}


def test_blocks_are_enough():
    sim = Fraction(4, 5)
    for low, top in nearsets.size_bands(1, 200):
        for a in range(low, top + 1):
            for b in range(a, a * 5 // 4 + 1):
                # The most places in which sets of these sizes may differ and still be similar enough.
                assert nearsets.blocks_for(top, sim) > (a + b) // 9
