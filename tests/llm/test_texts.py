"""Packing, leaks and the canonical form against brute force."""

import random
import re
import unicodedata
from collections import defaultdict
from pathlib import Path

import pytest

from phraseloom.llm import canonical, leakage, packing


@pytest.fixture(scope="module")
def canon():
    return canonical.Canonicaliser()


@pytest.mark.parametrize(
    "text, want",
    [
        ("plain text", "plain text"), ("ｃａｔ １２！", "cat 12!"), ("éå", "éå"), ("a​b­c﻿⁠d‌‍", "abcd"), ("a b　c d", "a b c d"),
        ("thіs wоrd", "this word"), ("этoт", "этот"), ("οder", "oder"), ("ﬁne", "fine"), ("①②", "12"), ("слово и word", "слово и word"), ("", ""), (None, None),
        ("ｔh​іs", "this"), ("Ελλάδα", "Ελλάδα"), ("it's | don't", "it's | don't"), ("саt", "cat"),
    ],
)
def test_canonical(canon, text, want):
    assert canon.texts([text]) == [want]
    assert canon.texts([want]) == [want]


def script(ch):
    name = unicodedata.name(ch, "")
    return next((s for s in ("LATIN", "CYRILLIC", "GREEK") if name.startswith(s)), None)


def brute_forms(t):
    out = set()
    if any(0xFF01 <= ord(c) <= 0xFF5E for c in t):
        out.add("wide")
    if unicodedata.normalize("NFC", t) != t:
        out.add("combining")
    if any(c in canonical.INVISIBLE for c in t):
        out.add("invisible")
    if any(c != " " and unicodedata.category(c) == "Zs" for c in t):
        out.add("space")
    plain = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in t if c not in canonical.INVISIBLE)
    for w in re.findall(r"[^\W\d_]+", unicodedata.normalize("NFC", plain)):
        if len({script(c) for c in w} - {None}) > 1:
            out.add("lookalike")
    return out


def test_forms(spark):
    rng = random.Random(2)
    odd = "abcｘ！́̈é​­ 　аοяΩΩÅ 1_-한하µｶﬁ"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(12))) for _ in range(400)] + ["x" * 200_000 + " ", "", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i bigint, text string, form string")
    got = defaultdict(set)
    for r in canonical.text_forms(df, "i").collect():
        got[r.i].add(r.form)
    assert got == {i: f for i, t in enumerate(texts) if t and (f := brute_forms(t))}
    assert canonical.text_forms(df.limit(0), "i").count() == 0
    done = {r.i: (r.text, r.changed) for r in canonical.canonical_texts(df, "i").collect()}
    assert len(done) == len(texts) and done[len(texts) - 1] == (None, False) and done[len(texts) - 2] == ("", False)
    again = canonical.Canonicaliser().texts([done[i][0] for i in range(400)])
    assert again == [done[i][0] for i in range(400)]
    # Equal-looking writings meet; nothing that the operator tells apart is left.
    assert not any(brute_forms(t) - {"lookalike"} for t in again)


def disguise(rng, text):
    out = []
    for c in text:
        r = rng.random()
        out.append({"a": "а", "e": "е", "o": "ο"}.get(c, c) if r < 0.1 else chr(ord(c) + 0xFEE0) if r < 0.2 and c.isalnum() else c.upper() if r < 0.3 else c)
        if rng.random() < 0.05:
            out.append("​")
    return "".join(out).replace(" ", rng.choice([" ", " ", "\n", ", ", " -- "]))


def test_leaks(spark, monkeypatch):
    rng = random.Random(3)
    lexicon = ["".join(rng.choice("abcdefgo") for _ in range(rng.randrange(4, 7))) for _ in range(60)]
    say = lambda n: [rng.choice(lexicon) for _ in range(n)]
    items = {i: say(30) for i in range(8)} | {8: say(5)}
    docs, want = {}, set()
    for d in range(60):
        w, kind = say(rng.randrange(60)), rng.randrange(3)
        if kind:
            i, n = rng.randrange(8), rng.choice([12, 13, 20])
            at = rng.randrange(30 - n + 1)
            w += items[i][at : at + n]
        docs[d] = disguise(rng, " ".join(w + say(rng.randrange(5))))
    rows = [(d, t, 1) for d, t in docs.items()] + [(0, docs[0], 1), (90, None, 1), (91, "", 1), (None, " ".join(items[1]), 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, item int")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(9, None), (None, "x"), (0, " ".join(items[0]))], "item_id bigint, text string")
    grams = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 12):
            grams[tuple(w[k : k + 13])].add(i)
    canon = canonical.Canonicaliser()
    for d, t in docs.items():
        w = leakage.words_of(canon.texts([t])[0])
        for k in range(len(w) - 12):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 13]), ())}
    want.add((None, 1))
    get = lambda: {(r.doc_id, r.item_id) for r in leakage.leaked_items(df, it).collect()}
    assert get() == want and len(want) > 15
    cleaned = {r.doc_id: r for r in leakage.without_leaks(df, it).collect()}
    assert set(cleaned) == {d for d, _ in want}
    for r in cleaned.values():
        assert (r.action == "drop") == (r.n_leaked >= 0.5 * r.n_words) == (r.text is None)
    left = spark.createDataFrame([(d, r.text) for d, r in cleaned.items()], "doc_id bigint, text string")
    assert leakage.leaked_items(left, it).count() == 0
    monkeypatch.setattr(leakage, "SLICE_CHARS", 100)
    blocks = {(r.doc_id, r.item_id) for r in leakage.leaked_items(df, it, block_chars=300).collect()}
    assert blocks == want
    assert sorted(map(tuple, leakage.without_leaks(df, it, block_chars=300).collect()), key=str) == sorted(map(tuple, cleaned.values()), key=str)
    assert leakage.leaked_items(df.limit(0), it).count() == 0 and leakage.leaked_items(df, it.limit(0)).count() == 0


def test_cuts_that_bring_leaks_together(spark):
    a, b, c = ([f"{x}{i}" for i in range(13)] for x in "abc")
    it = spark.createDataFrame([(1, " ".join(a + b)), (2, " ".join(c))], "item_id bigint, text string")
    fill = [f"z{i}" for i in range(80)]
    texts = [a[:6] + c + a[6:] + fill, fill + a + ["x"] + fill, c[:12] + fill]
    df = spark.createDataFrame([(7, " ".join(t)) for t in texts] + [(7, " ".join(texts[0]))], "doc_id bigint, text string")
    got = leakage.without_leaks(df, it).collect()
    assert sorted((r.doc_id, r.n_leaked) for r in got) == [(7, 13), (7, 26)]  # two texts under one id, the third leaks nothing
    left = spark.createDataFrame([(r.doc_id, r.text) for r in got], "doc_id bigint, text string")
    assert leakage.leaked_items(left, it).count() == 0 and all(r.text.split() for r in got)


def test_words_compare_by_look_and_without_case():
    same = [("the", "ТНЕ"), ("the", "тhе"), ("bomb", "ВОМВ"), ("тот", "ТОТ"), ("тот", "Тот"), ("слово", "СЛОВО"), ("coco", "сосо"), ("λόγος", "ΛΌΓΟΣ")]
    assert all(leakage.words_of(a) == leakage.words_of(b) for a, b in same)
    assert leakage.words_of("van") != leakage.words_of("nan") and leakage.words_of("тир") != leakage.words_of("мир")


def nfkc_by_rule(t):
    """The form of texts of one script, without the SQL: ignorable characters go, compatibility forms and spaces are mapped."""
    t = "".join(c for c in t if not any(a <= ord(c) <= b for a, b in canonical.IGNORABLE))
    return unicodedata.normalize("NFC", "".join(" " if c in canonical.SPACES else canonical.COMPAT.get(c, c) for c in t))


def test_the_form_is_composed_and_its_own_form(spark, canon):
    rng = random.Random(9)
    odd = [chr(0x300), chr(0x301), chr(0x308), *"eEеЕіνΝaTТнﬁｅ ̇①ｶﾞ￡Ⅳ²𝐀ẛが゙か", "\u200e", "\ufe0f", "\u200b", "\u3000"] + [chr(rng.randrange(0xA0, 0xD7FF)) for _ in range(400)]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 9))) for _ in range(500)] + ["wе\u0301b"]
    once = canon.texts(texts)
    assert canon.texts(once) == once and all(unicodedata.normalize("NFC", t) == t for t in once)
    assert canon.texts(["①ｶﾞ￡Ⅳ²𝐀ﬁ\u00a0a\u200e\ufe0f", "Word™ ½", "wе\u0301b"]) == ["1ガ£IV2Afi a", "Word™ ½", "wéb"]
    latin = ["".join(c for c in t if script(c) in (None, "LATIN")) for t in texts]
    one = [t for t in latin if not canonical.MIXED or len({script(c) for c in nfkc_by_rule(t)} - {None}) < 2]
    assert len(one) > 150 and canon.texts(one) == [nfkc_by_rule(t) for t in one]
    df = spark.createDataFrame([(1, "ТНЕ end"), (2, "the ЕND"), (3, None)], "i int, text string")
    keys = {r.i: r.key for r in canonical.canonical_texts(df, "i").collect()}
    assert keys[1] == keys[2] == "the end" and keys[3] is None


def check_packing(rows, sizes, capacity):
    load, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        if r.container is not None:
            load[r.container] += r.tok_end - r.tok_start
        pieces[r.i].append(r)
    assert set(pieces) == set(sizes) and max(load.values(), default=0) <= capacity
    for i, n in sizes.items():
        got = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got)))
        assert (got[0].tok_start, got[-1].tok_end) == (0, n or 0)
        assert all(a.tok_end == b.tok_start for a, b in zip(got, got[1:]))
        assert len(got) == max(1, -(-(n or 0) // capacity)) and all((r.container is None) == (not n) for r in got)
    return len(load), sum(load.values())


def test_packing(spark):
    rng = random.Random(5)
    sizes = {i: rng.choice([0, 3, 20, 34, 35, 51, 99, 100, 101, 250]) for i in range(300)} | {500: 100_000, 501: None}
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes.items()] + [(0, sizes[0], "y")], "i bigint, n_tokens bigint, size string")
    rows = packing.pack(df, "i", capacity=100, shard_items=64, islands=2).collect()
    used, total = check_packing(rows, sizes, 100)
    again = packing.pack(df.repartition(3), "i", capacity=100, shard_items=64, islands=2).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert packing.pack(df.limit(0), "i").count() == 0
    assert used >= -(-total // 100)


def test_packing_keeps_items_without_an_id_apart(spark):
    rows = [(None, 60)] * 3 + [(None, 250)] * 2 + [(None, 0)] * 2 + [(1, 60), (1, 60), (2, 250)]
    got = [(r.i, r.tok_end - r.tok_start, r.container) for r in packing.pack(spark.createDataFrame(rows, "i bigint, n_tokens bigint"), "i", capacity=100).collect()]
    assert sorted(n for i, n, _ in got if i is None) == [0, 0, 50, 50, 60, 60, 60, 100, 100, 100, 100]
    assert sorted((i, n) for i, n, _ in got if i is not None) == [(1, 60), (2, 50), (2, 100), (2, 100)]
    load = defaultdict(int)
    for _, n, c in got:
        load[c] += n
    assert load.pop(None) == 0 and max(load.values()) <= 100


def test_without_leaks_keeps_texts_of_one_id_apart(spark):
    item = " ".join(f"leak{k}" for k in range(20))
    texts = [f"{item} a", f"b {item} " + " ".join(f"w{k}" for k in range(40)), f"c {item}"]
    rows = [(i, t) for i in (None, 7) for t in texts] * 2 + [(7, "nothing leaks")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    it = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = leakage.without_leaks(df, it)
    assert got.columns == ["doc_id", "n_words", "n_leaked", "action", "text"]
    want = [(21, 20, "drop"), (21, 20, "drop"), (61, 20, "cut")]
    for i in (None, 7):
        assert sorted((r.n_words, r.n_leaked, r.action) for r in got.collect() if r.doc_id == i) == want


def test_evolution_never_loses_to_best_fit_decreasing():
    rng = random.Random(6)
    better = 0
    for seed in range(6):
        sizes = [rng.randrange(20, 70) for _ in range(120)]
        down = sorted(range(len(sizes)), key=lambda i: -sizes[i])
        plain = packing.best_fit(down, sizes, 100)
        best = packing.evolve(sizes, 100, [], (seed,), generations=12, population=6)[0][0]
        assert sorted(i for b in best.bins for i in b) == list(range(120))
        assert best.loads == [sum(sizes[i] for i in b) for b in best.bins] and max(best.loads) <= 100
        assert best.cost(100) <= plain.cost(100)
        better += best.cost(100) < plain.cost(100)
        back = packing.from_assignment(best.assignment(120), sizes)
        assert sorted(map(sorted, back.bins)) == sorted(map(sorted, best.bins))
    assert better >= 3


@pytest.mark.skipif(not Path(packing.TOKENIZERS).exists(), reason="no tokenizer files here")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "two words"), (2, ""), (3, None), (4, "a" * 200_000)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    assert got[1] >= 2 and got[2] == got[3] == 0 and got[4] > 1000


def test_evolution_beats_best_fit(spark):
    """Sizes of 100 filled triples, made so that best fit by falling size needs more containers than there are triples."""
    rng = random.Random(8)
    sizes = []
    for _ in range(100):
        a, b = rng.randrange(26, 49), rng.randrange(26, 49)
        sizes += [a, b, 100 - a - b] if 100 - a - b > 0 else [a, 100 - a]
    least = -(-sum(sizes) // 100)
    fit = len(packing.best_fit(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sizes, 100).bins)
    pool, ran = packing.evolve(sizes, 100, [], (1, 2, 3), generations=12, population=8)
    assert ran > 0 and least <= len(pool[0].bins) < fit
    df = spark.createDataFrame(list(enumerate(sizes)), "i bigint, n_tokens bigint")
    rows, levels = packing.pack_levels(df, "i", capacity=100, shard_items=100, islands=2)
    used, _ = check_packing(rows.collect(), dict(enumerate(sizes)), 100)
    stats = {r.level: r for r in levels.collect()}
    assert stats[0].generations > 0 and len(stats) > 1 and used < stats[0].n_fit


def test_islands_go_on_until_nothing_is_gained(spark):
    rng = random.Random(9)
    sizes = [rng.randrange(80, 420) for _ in range(900)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i bigint, n_tokens bigint")
    rows, levels = packing.pack_levels(df, "i", capacity=1000, shard_items=300, islands=2)
    used, total = check_packing(rows.collect(), dict(enumerate(sizes)), 1000)
    first = {r.level: r for r in levels.collect()}[0]
    assert first.n_shards == 3 and first.n_evolved < first.n_fit and used == -(-total // 1000)
    # Items that leave room in every container: no shard gets better, so the least number of epochs is run, and one level more.
    df = spark.createDataFrame([(i, 60) for i in range(60)], "i bigint, n_tokens bigint")
    rows, levels = packing.pack_levels(df, "i", capacity=100, shard_items=20, islands=2)
    assert check_packing(rows.collect(), dict.fromkeys(range(60), 60), 100)[0] == 60
    assert [r.n_evolved for r in levels.orderBy("level").collect()] == [60, 60]


def test_a_level_never_needs_more_than_it_got():
    rng = random.Random(10)
    sizes = [rng.randrange(20, 60) for _ in range(90)]
    got = packing.evolve(sizes, 100, [], (1,), generations=12, population=6)[0][0]
    again = packing.evolve(sizes, 100, [got.assignment(90)], (2,), generations=1, population=4)[0]
    assert again[0].cost(100) <= got.cost(100) and len({tuple(p.loads) for p in again}) > 1
    free = list(range(10))
    p = packing.Packing([[10, 11], [12]], [sizes[10] + sizes[11], sizes[12]])
    left = packing.exchange(p, free, sizes, 120)
    assert sorted(left + p.bins[0] + p.bins[1]) == list(range(13)) and p.loads == [sum(sizes[i] for i in b) for b in p.bins]
