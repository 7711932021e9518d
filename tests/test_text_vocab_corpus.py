import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from phraseloom.functions import columns as K
from phraseloom.operators import corpus as C
from phraseloom.operators import vocab as V
from phraseloom.schemas import SENTENCES
from phraseloom.sources.text import lines_of, read_text, tokens_of, word_rows


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "text, lines",
    [("a\nb", ["a", "b"]), ("a\nb\n", ["a", "b"]), ("", []), ("\n", [""]), ("a\n\nb", ["a", "", "b"]), ("a\r\nb\rc", ["a\r", "b\rc"]), (None, None)],
)
def test_lines(spark, text, lines):
    assert one(spark, text, lines_of(F.col("text"))) == lines


@pytest.mark.parametrize("line, toks", [("a  b ", ["a", "", "b", ""]), ("", [""]), ("a\tb c\r", ["a\tb", "c\r"]), (" a", ["", "a"])])
def test_tokens(spark, line, toks):
    assert one(spark, line, tokens_of(F.col("text"))) == toks


def test_read_text(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"one two\r\nthree\rfour\n\nlast")
    path = str(tmp_path / "t.txt")
    assert [r.line for r in read_text(spark, path).collect()] == ["one two\r", "three\rfour", "", "last"]
    assert read_text(spark, path, 2).count() == 2


def words(spark, texts):
    return word_rows(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t")


def test_vocab_in_order_of_first_place(spark):
    v = V.build_vocab(words(spark, ["b a b", None, "c a\nd"]), ["id", "line_no", "tok_no"])
    assert {r.surface: r.vid for r in v.collect()} == {"</s>": 1, "b": 2, "a": 3, "c": 4, "d": 5}


def test_vocab_insert_and_lookup(spark):
    v = V.Vocab.empty(spark).extend(words(spark, ["apple orange apple"]), ["id", "line_no", "tok_no"])
    assert v.at("apple") == 2 and v.at("orange") == 3 and v.word(3) == "orange" and v.size() == 4
    with pytest.raises(KeyError):
        v.at("banana")
    with pytest.raises(PySparkException):
        v.lookup(spark.createDataFrame([("banana",)], "word string")).collect()
    assert v.lookup(spark.createDataFrame([("banana",)], "word string"), strict=False).first().vid is None
    with pytest.raises(PySparkException):
        v.surface(spark.createDataFrame([(9,)], "vid bigint")).collect()
    again = v.extend(words(spark, ["pear apple fig"]), ["id", "line_no", "tok_no"])
    assert [r.surface for r in again.words().collect()] == ["</s>", "apple", "orange", "pear", "fig"]


def test_loaded_vocab_reads_id_1_as_end_of_sentence(spark):
    df = spark.createDataFrame([(0, "NULL", False), (1, "UNK", False), (2, "apple", False)], "vid bigint, surface string, is_alias boolean")
    v = V.Vocab(V.with_eos_alias(df))
    assert v.at("UNK") == 1 and v.at("</s>") == 1 and v.word(1) == "</s>" and v.at("NULL") == 0 and v.word(2) == "apple"


def test_corpus_round_trip(spark):
    c = C.Corpus.empty(spark)
    assert c.size() == 0
    c = c.add_words("orange apple and pear".split()).add_words(["apple"])
    assert {r.sid: r.text for r in c.surface().collect()} == {0: "orange apple and pear", 1: "apple"}
    assert tuple(c.stats().first()) == (2, 5)


def test_unknown_id_appends_nothing(spark):
    c = C.Corpus.empty(spark).add_words(["a", "b"])
    with pytest.raises(KeyError):
        c.append(spark.createDataFrame([(0, [2, 99])], "k int, toks array<int>"), ["k"])
    assert c.size() == 1
    more = c.append(spark.createDataFrame([(1, [3]), (0, [2, 3])], "k int, toks array<int>"), ["k"])
    assert [(r.sid, r.toks) for r in more.sents.orderBy("sid").collect()] == [(0, [2, 3]), (1, [2, 3]), (2, [3])]


def test_from_text(spark):
    docs = spark.createDataFrame([(1, "the cat\nthe dog"), (2, "cat")], "i int, t string")
    c = C.Corpus.from_text(docs, "i", "t")
    assert {r.sid: r.text for r in c.surface().collect()} == {0: "the cat", 1: "the dog", 2: "cat"}
    with pytest.raises(PySparkException):
        C.Corpus.from_text(spark.createDataFrame([(1, "a </s>")], "i int, t string"), "i", "t").stats().collect()


def test_token_at_reads_the_implied_end(spark):
    df = spark.createDataFrame([(i,) for i in (-1, 0, 1, 2, 3)], "i int").select(K.token_at(F.array(F.lit(7), F.lit(8)), F.col("i")).alias("v"))
    assert [r.v for r in df.collect()] == [None, 7, 8, 1, None]


@pytest.mark.parametrize("n, bases", [(0, [0]), (1, [0]), (255, [0]), (256, [0, 255]), (510, [0, 255]), (511, [0, 255, 510])])
def test_chunks(spark, n, bases):
    df = spark.createDataFrame([(0, list(range(2, n + 2)))], SENTENCES)
    assert [r.base for r in C.chunks(df).orderBy("base").collect()] == bases
    fits = C.fitted(df, "error")
    if n > 255:
        with pytest.raises(PySparkException):
            fits.collect()
    else:
        assert len(fits.first().toks) == n


def test_repeated_deliveries_are_one_sentence(spark):
    rows = [("src", 1, [2, 3]), ("src", 1, [2, 3]), ("src", 2, None), ("src", 3, []), ("trg", 1, [9]), (None, 1, [5])]
    got = C.sentences(spark.createDataFrame(rows, "side string, sid bigint, toks array<int>"), "src")
    assert {r.sid: r.toks for r in got.collect()} == {1: [2, 3], 3: []}


def test_column_helpers(spark):
    assert one(spark, "", K.child_path(F.lit(0x7A120))) == "0007a/0007a120"
    assert one(spark, "", K.child_path(F.lit(1))) == "00000/00000001"
    assert one(spark, "", K.nspaces(F.lit(3))) == "   "
    assert one(spark, "  x ", K.skip_spaces(F.col("text"))) == "x "
    assert one(spark, "", K.format_time(F.lit(1.5))) == "1.500000"
    assert K.benchmark_time(lambda: None, "nothing") >= 0 and K.usage()["rss_max_mb"] > 0


def test_from_text_file(spark, tmp_path):
    (tmp_path / "t.txt").write_text("the cat\n\nthe  dog\nlast")
    vocab, sents = C.from_text_file(spark, str(tmp_path / "t.txt"))
    assert {r.surface: r.vid for r in vocab.df.collect()} == {"</s>": 1, "the": 2, "cat": 3, "": 4, "dog": 5, "last": 6}
    assert [r.toks for r in sents.orderBy("sid").collect()] == [[2, 3], [4], [2, 4, 5], [6]]
    assert C.from_text_file(spark, str(tmp_path / "t.txt"), 2)[1].count() == 2


def test_every_place(spark):
    sents = spark.createDataFrame([(1, [5, 6, 7, 8, 9]), (2, [])], "sid bigint, toks array<int>")
    assert sorted(tuple(r) for r in C.every_place(sents).collect()) == [*((1, i, v) for i, v in enumerate([5, 6, 7, 8, 9, 1])), (2, 0, 1)]
