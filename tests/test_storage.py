import os
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException

from phraseloom.operators import alignment as A
from phraseloom.operators.incremental import Store
from phraseloom.operators.index import TokenIndex
from phraseloom.operators.vocab import Vocab
from phraseloom.schemas import ALIGNMENT, MAGIC_V2, MAGIC_V3, SENTENCES
from phraseloom.sources import binary as B
from phraseloom.sources import export as E
from phraseloom.streaming import ingest as I

WORDS = "apple and orange and pear and apple and orange".split()
IDS = {"apple": 2, "and": 3, "orange": 4, "pear": 5}
TOKS = [IDS[w] for w in WORDS]


def write_vocab(path, rows, unk=1):
    block, entries = b"", b""
    for vid, word in rows:
        entries += struct.pack("<II", len(block), vid)
        block += word.encode() + b"\0"
    path.write_bytes(struct.pack("<II", len(rows), unk) + entries + block)
    return str(path)


def index_entries(sizes):
    return np.concatenate([[0], np.cumsum(sizes)]).astype("<u4").tobytes()


def write_v2(path, sents, magic=MAGIC_V2):
    body = b"".join(np.array(s, "<u4").tobytes() for s in sents)
    path.write_bytes(struct.pack("<QQII", magic, 24 + len(body), len(sents), sum(map(len, sents))) + body + index_entries([len(s) for s in sents]))
    return str(path)


def write_v3(track, index, sents):
    body = b"".join(np.array(s, "<u4").tobytes() for s in sents)
    track.write_bytes(struct.pack("<QQII", MAGIC_V3, 0, len(sents), sum(map(len, sents))) + body)
    index.write_bytes(struct.pack("<QIxxxx", MAGIC_V3, len(sents)) + index_entries([len(s) for s in sents]))
    return str(track), str(index)


def write_links(path, sents):
    body = b"".join(bytes(x) for s in sents for x in s)
    path.write_bytes(struct.pack("<QQII", MAGIC_V2, 24 + len(body), len(sents), sum(map(len, sents))) + body + index_entries([2 * len(s) for s in sents]))
    return str(path)


def write_array(path, positions, magic=MAGIC_V2, header=True):
    body = b"".join(struct.pack("<IB", s, o) for s, o in positions)
    path.write_bytes((struct.pack("<QQI", magic, 20 + len(body), 1) if header else b"") + body + (b"\x01\x02\x03" if header else b""))
    return str(path)


@pytest.fixture(autouse=True)
def small_ranges(monkeypatch):
    monkeypatch.setattr(B, "RANGE", 2)
    monkeypatch.setattr(B._ranges, "__defaults__", (2,))


def test_vocab_file(spark, tmp_path):
    path = write_vocab(tmp_path / "v.tdx", [(0, "NULL"), (1, "UNK"), *((v, w) for w, v in IDS.items())])
    df, size = B.read_vocab(spark, path)
    v = Vocab(df)
    assert size == 6 and v.at("NULL") == 0 and v.at("UNK") == 1 and v.word(1) == "</s>" and v.at("</s>") == 1
    assert all(v.at(w) == i for w, i in IDS.items())
    with pytest.raises(KeyError):
        v.at("banana")


@pytest.mark.parametrize("sents", [[TOKS], [[2], [], [3, 4, 5], TOKS, []], []])
def test_corpus_files(spark, tmp_path, sents):
    want = list(enumerate(sents))
    assert [(r.sid, r.toks) for r in B.read_corpus(spark, write_v2(tmp_path / "c.mct", sents)).orderBy("sid").collect()] == want
    track, index = write_v3(tmp_path / "c.trk", tmp_path / "c.six", sents)
    assert [(r.sid, r.toks) for r in B.read_corpus(spark, track, index).orderBy("sid").collect()] == want


def test_bad_magic(spark, tmp_path):
    with pytest.raises(RuntimeError):
        B.read_corpus(spark, write_v2(tmp_path / "c.mct", [TOKS], magic=7))
    with pytest.raises(RuntimeError):
        B.read_suffix_array(spark, write_array(tmp_path / "i.sfa", [(0, 0)], magic=MAGIC_V3))


def test_alignment_file(spark, tmp_path):
    sents = [[(0, 0), (0, 1), (3, 4)], [], [(255, 255), (1, 2)]]
    df = B.read_alignment(spark, write_links(tmp_path / "a.mam", sents))
    assert [[tuple(x) for x in r.links] for r in df.orderBy("sid").collect()] == sents
    assert sorted(map(tuple, A.links(df).collect())) == [(0, 0, 0, 0), (0, 1, 0, 1), (0, 2, 3, 4), (2, 1, 1, 2)]


def test_aligned_tokens(spark):
    al = spark.createDataFrame([(0, [(0, 1), (5, 0)]), (1, None)], ALIGNMENT)
    src, trg = spark.createDataFrame([(0, [7, 8])], SENTENCES), spark.createDataFrame([(0, [4, 5])], SENTENCES)
    assert [tuple(r) for r in A.aligned_tokens(A.alignments(al), src, trg).collect()] == [(0, 0, 7, 5)]


def test_array_file_equals_the_built_index(spark, tmp_path):
    sents = spark.createDataFrame([(0, TOKS)], SENTENCES)
    built = TokenIndex.build(sents)
    order = [(r.sid, r.off) for r in built.sa.orderBy("rank").collect()]
    loaded = B.read_suffix_array(spark, write_array(tmp_path / "i.sfa", order))
    assert loaded.count() == 9 and TokenIndex.load(sents, loaded).equals(built)
    leaf = B.read_leaf(spark, write_array(tmp_path / "array", order, header=False))
    assert [(r.sid, r.off) for r in leaf.orderBy("rank").collect()] == order
    assert B.read_node(spark, str(tmp_path / "nowhere")).count() == 0
    grown = TokenIndex.load(sents, loaded).add(spark.createDataFrame([(1, [2, 5])], SENTENCES))
    assert grown.sa.count() == 11


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    batches = [[(0, [7, 4, 2])], [(0, [7]), (1, [7, 4])]]
    for k, rows in enumerate(batches):
        assert store.append(spark.createDataFrame(rows, "k int, toks array<int>"), ["k"], k)
        assert not store.append(spark.createDataFrame(rows, "k int, toks array<int>"), ["k"], k)  # a replay
    assert [(r.sid, r.toks) for r in store.sentences().orderBy("sid").collect()] == [(0, [7, 4, 2]), (1, [7]), (2, [7, 4])]
    ph = spark.createDataFrame([(0, [7]), (1, [7, 4]), (2, [9])], "phrase_id bigint, q array<int>")
    assert {r.phrase_id: r.n for r in store.counts(ph).collect()} == {0: 3, 1: 2, 2: 0}
    before = store.manifest()
    assert before["last_batch"] == {"": 1} and len(before["runs"]) == 1  # the second batch was as large as the first
    assert store.append(spark.createDataFrame([(5, [4])], "k int, toks array<int>"), ["k"], 2, fanout=1)
    assert [r["n"] for r in store.manifest()["runs"]] == [6, 1]
    assert {r.phrase_id: r.n for r in store.counts(ph).collect()} == {0: 3, 1: 2, 2: 0}
    store.compact()
    assert len(store.manifest()["runs"]) == 1 and len(store.vacuum()) >= 3
    whole = TokenIndex.build(store.sentences()).sa
    assert [(r.rank, r.sid, r.off) for r in store.merged().orderBy("rank").collect()] == [(r.rank, r.sid, r.off) for r in whole.orderBy("rank").collect()]
    version = store.manifest()["version"]
    for bad, vocab in (([0, 2], None), ([99], spark.createDataFrame([(7,)], "vid bigint"))):
        with pytest.raises((PySparkException, KeyError)):
            store.append(spark.createDataFrame([(0, bad)], "k int, toks array<int>"), ["k"], vocab=vocab)
    assert store.manifest()["version"] == version


def test_writers_and_readers(spark, tmp_path):
    rows = [(0, [2, 3]), (1, []), (2, [5, 4, 3])]
    sents = spark.createDataFrame(rows, SENTENCES)
    E.write_corpus(sents, str(tmp_path / "a/c.mct"))
    E.write_corpus(sents, str(tmp_path / "c.trk"), str(tmp_path / "c.six"))
    for df in (B.read_corpus(spark, str(tmp_path / "a/c.mct")), B.read_corpus(spark, str(tmp_path / "c.trk"), str(tmp_path / "c.six"))):
        assert [tuple(r) for r in df.orderBy("sid").collect()] == rows
    with pytest.raises(ValueError):
        E.write_corpus(sents.where("sid > 0"), str(tmp_path / "gap"))
    with pytest.raises(PySparkException):
        E.write_suffix_array(spark.createDataFrame([(0, 0, 256)], "rank bigint, sid bigint, off int"), str(tmp_path / "far"))


def test_lines_keep_the_order_of_files(spark, tmp_path):
    """A large file is read before a small one; times and names decide, not the scan."""
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("first line\n")
    (src / "b.txt").write_text("".join(f"w{i}\n" for i in range(3000)))
    for k, f in enumerate("ab"):
        os.utime(src / f"{f}.txt", (1_000_000 + k, 1_000_000 + k))
    store = Store(spark, str(tmp_path / "store"))
    I.ingest(I.text_stream(spark, str(src)), I.append_lines(store), str(tmp_path / "ckpt"), once=True).awaitTermination()
    words = {r.surface: r.vid for r in store.vocab().collect()}
    assert words["first"] == 2 and words["line"] == 3 and words["w0"] == 4 and words["w2999"] == 3003
    assert store.sentences().where("sid = 0").first().toks == [2, 3] and store.sentences().where("sid = 3000").first().toks == [3003]
    assert store.manifest()["version"] == 1  # vocabulary, sentences and run in one step


def test_repeated_keys_of_a_stream(spark, tmp_path):
    store, each = Store(spark, str(tmp_path / "store")), None
    each = I.append_sentences(store, ["k"], key="k")
    schema = "k int, toks array<int>"
    each(spark.createDataFrame([(1, [2]), (1, [2]), (2, [3]), (3, None)], schema), 0)
    for _ in range(2):  # the second is a replay
        each(spark.createDataFrame([(2, [3]), (4, [5])], schema), 1)
    assert [tuple(r) for r in store.sentences().orderBy("sid").collect()] == [(0, [2]), (1, [3]), (2, [5])]


def test_text_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    for k, text in enumerate(["the cat\nthe dog\n", "a cat\n"]):
        (src / f"{k}.txt").write_text(text)
        q = I.ingest(I.text_stream(spark, str(src)), I.append_lines(store), str(tmp_path / "ckpt"), once=True)
        q.awaitTermination()
    vocab = {r.surface: r.vid for r in store.vocab().collect()}
    assert vocab == {"</s>": 1, "the": 2, "cat": 3, "dog": 4, "a": 5}
    assert [(r.sid, r.toks) for r in store.sentences().orderBy("sid").collect()] == [(0, [2, 3]), (1, [2, 4]), (2, [5, 3])]


def test_table_stream(spark, tmp_path):
    spark.createDataFrame([(5, [3, 4]), (2, [2]), (9, None)], "k int, toks array<int>").write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    stream = I.table_stream(spark, str(tmp_path / "in"), "k int, toks array<int>")
    I.ingest(stream, I.append_sentences(store, ["k"]), str(tmp_path / "ckpt"), once=True).awaitTermination()
    assert [(r.sid, r.toks) for r in store.sentences().orderBy("sid").collect()] == [(0, [2]), (1, [3, 4])]
