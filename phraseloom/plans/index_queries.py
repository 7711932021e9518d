"""Queries on vocabulary, corpus, suffix order, phrases and trie, each with its SQL twin."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.functions.columns import child_path, suffix_precedes, token_at, with_eos
from phraseloom.operators import alignment as A
from phraseloom.operators import corpus as C
from phraseloom.operators import phrases as P
from phraseloom.operators import sampling as S
from phraseloom.operators import suffix as X
from phraseloom.operators import vocab as V
from phraseloom.operators.incremental import Store, two_batches
from phraseloom.operators.index import Span, TokenIndex
from phraseloom.operators.ordered import OrderedMap, key_at, ranked, running_total
from phraseloom.schemas import MAX_LEN
from phraseloom.session import materialize, temporary
from phraseloom.sources import binary, export
from phraseloom.sources.text import lines_of, read_text, word_rows
from phraseloom.streaming import ingest

SAMPLES, RANDOM_PHRASES, TOP, SPANS, LEAF = 100, 1000, 20, 5, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sents(spark: SparkSession, sf_dir: str, side: str = "src") -> DataFrame:
    return C.sentences(table(spark, sf_dir, "corpus"), side)


def _vocab(spark: SparkSession, sf_dir: str, side: str = "src") -> DataFrame:
    return V.dictionary(table(spark, sf_dir, "vocab").where(F.col("side") == side).select("vid", "surface", "is_alias"))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "phrases").select("phrase_id", "q")


@lru_cache(maxsize=8)
def _stored(app: str, sf_dir: str, side: str) -> TokenIndex:
    spark = SparkSession.active()
    store = TokenIndex.build(materialize(_sents(spark, sf_dir, side))).save(temporary(spark, "index"))
    return store.index()


def stored_index(spark: SparkSession, sf_dir: str, side: str = "src") -> TokenIndex:
    """The index of a side: built and stored at its first use in a session, opened by every later query."""
    return _stored(spark.sparkContext.applicationId, sf_dir, side)


def _array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_index(spark, sf_dir).sa


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_rows(table(spark, sf_dir, "documents"), "doc_id", "text")


def _joined(q) -> F.Column:
    return F.array_join(F.transform(q, lambda v: v.cast("string")), " ")


def text_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.size(F.split("line", " ", -1)).cast("bigint").alias("n_words"), "line")


def vocab_build(spark, sf_dir):
    return V.build_vocab(_words(spark, sf_dir), ["id", "line_no", "tok_no"]).select("vid", "surface")


def vocab_lookup(spark, sf_dir):
    words = _words(spark, sf_dir).select("word").distinct()
    return V.lookup(words, _vocab(spark, sf_dir)).select("word", "vid")


def vocab_reverse(spark, sf_dir):
    vids = table(spark, sf_dir, "tokens").where("vid is not null").select(F.col("vid").cast("bigint").alias("vid")).distinct()
    return V.surfaces(vids, _vocab(spark, sf_dir)).select("vid", "surface")


def vocab_extend(spark, sf_dir):
    """Words of the documents that the src vocabulary lacks, numbered on from it by first appearance."""
    return V.extend_vocab(_vocab(spark, sf_dir), _words(spark, sf_dir), ["id", "line_no", "tok_no"]).select("vid", "surface")


def vocab_aliases(spark, sf_dir):
    out = V.with_eos_alias(_vocab(spark, sf_dir).where("surface <> '</s>'"))
    return out.groupBy("vid").agg(F.count(F.lit(1)).alias("n_words"), F.count_if("is_alias").alias("n_aliases"))


def corpus_stats(spark, sf_dir):
    parts = [C.stats(_sents(spark, sf_dir, s)).select(F.lit(s).alias("side"), "n_sentences", "n_tokens") for s in ("src", "trg")]
    return parts[0].unionByName(parts[1])


def sentence_fetch(spark, sf_dir):
    return C.tokens(_sents(spark, sf_dir)).select("sid", F.col("off").cast("bigint").alias("off"), F.col("vid").cast("bigint").alias("vid"))


def sentence_surface(spark, sf_dir):
    return C.surface_text(_sents(spark, sf_dir), _vocab(spark, sf_dir))


def token_at_places(spark, sf_dir):
    """The token at every place, the end of sentence among them."""
    return C.every_place(_sents(spark, sf_dir)).select("sid", F.col("i").cast("bigint").alias("i"), F.col("vid").cast("bigint").alias("vid"))


def suffix_array(spark, sf_dir):
    return _array(spark, sf_dir).select("rank", "sid", F.col("off").cast("bigint").alias("off"))


def suffix_array_trg(spark, sf_dir):
    """The same order over the target side."""
    return stored_index(spark, sf_dir, "trg").sa.select("rank", "sid", F.col("off").cast("bigint").alias("off"))


def suffix_neighbors(spark, sf_dir):
    out = X.neighbours(_array(spark, sf_dir))
    return out.select("rank", "prev_sid", F.col("prev_off").cast("bigint").alias("prev_off"), "next_sid", F.col("next_off").cast("bigint").alias("next_off"))


def random_access(spark, sf_dir):
    sa, n = _array(spark, sf_dir), stored_index(spark, sf_dir).n
    ranks = spark.range(RANDOM_PHRASES).select(S.draw(F.col("id"), F.lit(3), F.lit(max(1, n)).cast("bigint")).alias("rank")).distinct()
    return X.at_ranks(sa, ranks).select("rank", "sid", F.col("off").cast("bigint").alias("off"))


def phrase_count(spark, sf_dir):
    return P.phrase_counts(_sents(spark, sf_dir), _phrases(spark, sf_dir))


def phrase_narrow_trace(spark, sf_dir):
    out = P.narrow_trace(_sents(spark, sf_dir), _phrases(spark, sf_dir))
    return out.select("phrase_id", F.col("depth").cast("bigint").alias("depth"), "n", F.col("span_depth").cast("bigint").alias("span_depth"))


def phrase_locate(spark, sf_dir):
    return stored_index(spark, sf_dir).locate(_phrases(spark, sf_dir)).select("phrase_id", "k", "sid", F.col("off").cast("bigint").alias("off"))


def phrase_range(spark, sf_dir):
    return stored_index(spark, sf_dir).ranges(_phrases(spark, sf_dir)).select("phrase_id", F.col("begin").alias("first_rank"), F.col("end").alias("end_rank"))


def index_count(spark, sf_dir):
    """The counts of ``phrase_count``, read from the stored array instead of the sentences."""
    return stored_index(spark, sf_dir).counts(_phrases(spark, sf_dir))


def _top_spans(spark, sf_dir) -> list[tuple[str, list[Span]]]:
    """The spans of the five most frequent pairs of tokens, narrowed token by token from the root."""
    out = []
    for r in P.top_ngrams(_sents(spark, sf_dir), 2, SPANS).collect():
        span, steps = stored_index(spark, sf_dir).span(), []
        for vid in r.q:
            span, _ = span.narrow(vid)
            steps.append(span)
        out.append((" ".join(map(str, r.q)), steps))
    return out


def span_narrow(spark, sf_dir):
    """A cursor's size and rank range at each step."""
    rows = [(q, s.depth(), s.size(), *s.bounds()) for q, steps in _top_spans(spark, sf_dir) for s in steps]
    return spark.createDataFrame(rows, "vids string, depth bigint, n bigint, first_rank bigint, end_rank bigint")


def span_at(spark, sf_dir):
    """The first and the last position of a span, and those just outside of it."""
    rows = []
    for q, steps in _top_spans(spark, sf_dir):
        span = steps[-1]
        rows += [(q, k, *(span.at_unchecked(k) or (None, None))) for k in (-1, span.size())] + [(q, k, *span.at(k)) for k in sorted({0, span.size() - 1})]
    return spark.createDataFrame(rows, "vids string, k bigint, sid bigint, off bigint")


def span_next(spark, sf_dir):
    """What follows the most frequent pairs of tokens, from a cursor."""
    parts = [steps[-1].next_tokens().select(F.lit(q).alias("vids"), F.col("vid").cast("bigint").alias("vid"), "n") for q, steps in _top_spans(spark, sf_dir)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def phrase_eos(spark, sf_dir):
    return P.phrase_counts(_sents(spark, sf_dir), P.anchored(_phrases(spark, sf_dir)))


def _sampled(spark, sf_dir):
    rows = table(spark, sf_dir, "sampled_positions").where("sid is not null and tok_offset is not null and sample_id is not null").select("sample_id", "phrase_id", "sid", "tok_offset").distinct()
    return rows.join(_sents(spark, sf_dir), "sid").where(F.col("tok_offset") < F.size("toks"))


def position_surface(spark, sf_dir):
    """The word at each sampled position."""
    rows = _sampled(spark, sf_dir).select("sample_id", token_at(F.col("toks"), F.col("tok_offset")).cast("bigint").alias("vid"))
    return V.surfaces(rows, _vocab(spark, sf_dir)).select("sample_id", "surface")


def position_text(spark, sf_dir):
    """The words from each sampled position through the end of sentence."""
    rows = _sampled(spark, sf_dir).select("sample_id", F.expr("slice(toks, tok_offset + 1, size(toks))").alias("toks"))
    return C.surface_text(rows.withColumn("toks", with_eos(F.col("toks"))), _vocab(spark, sf_dir), ["sample_id"])


def position_add(spark, sf_dir):
    """The token at every number of places on from each sampled position, as far as the sentence goes and its end."""
    rows = _sampled(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("toks") - F.col("tok_offset"))))
    return rows.select("sample_id", F.col("k").cast("bigint").alias("k"), token_at(F.col("toks"), F.col("tok_offset") + F.col("k")).cast("bigint").alias("vid"))


def position_compare(spark, sf_dir):
    """Each sampled position against the start of its sentence: whether the start's suffix comes before."""
    rows = _sampled(spark, sf_dir)
    here, start = F.expr("slice(toks, tok_offset + 1, size(toks))"), F.col("toks")
    return rows.select("sample_id", suffix_precedes(here, start).alias("start_precedes"), (F.col("tok_offset") == 0).alias("same"))


def _ngrams(n):
    def query(spark, sf_dir):
        return P.ngram_counts(_sents(spark, sf_dir), n).select(_joined(F.col("q")).alias("vids"), "n")

    query.__name__ = f"ngram_counts_{n}"
    return query


def ngram_topk(spark, sf_dir):
    return P.top_ngrams(_sents(spark, sf_dir), 2, TOP).select(_joined(F.col("q")).alias("vids"), "n")


def next_token_dist(spark, sf_dir):
    out = P.next_tokens(_sents(spark, sf_dir), _phrases(spark, sf_dir))
    return out.select("phrase_id", F.col("vid").cast("bigint").alias("vid"), "n", "cum_before")


def root_children(spark, sf_dir):
    """Children of the root with their sizes and the partial sums that order statistics use."""
    counts = P.ngram_counts(_sents(spark, sf_dir), 1).select(F.col("q")[0].cast("bigint").alias("vid"), "n")
    return running_total(counts, "vid", "n").select("vid", "n", "cum_before")


def order_statistics(spark, sf_dir):
    """The root's child that holds the k-th position, and the place within it, for random k."""
    sums = running_total(P.ngram_counts(_sents(spark, sf_dir), 1).select(F.lit(0).alias("p"), F.col("q")[0].cast("bigint").alias("vid"), "n"), "vid", "n")
    k = S.draw(F.col("id"), F.lit(4), F.lit(max(1, stored_index(spark, sf_dir).n)).cast("bigint"))
    places = spark.range(RANDOM_PHRASES).select(F.lit(0).alias("p"), k.alias("k")).distinct()
    return key_at(sums, places, ["p"], "n").select("k", "vid", "rest")


def ordered_map(spark, sf_dir):
    """Tokens and their counts as an ordered map, walked in key order, after an addition to each key."""
    counts = P.ngram_counts(_sents(spark, sf_dir), 1).select(F.col("q")[0].cast("bigint").alias("key"), "n")
    twice = OrderedMap(counts.unionByName(counts).groupBy("key").agg(F.sum("n").alias("n")))
    return twice.add(0, 5).walk()


def prefix_rollup(spark, sf_dir):
    return P.prefix_rollup(_sents(spark, sf_dir), 3).select(F.col("depth").cast("bigint").alias("depth"), "n_nodes", "n_positions")


def sample_positions(spark, sf_dir):
    out = stored_index(spark, sf_dir).sample(_phrases(spark, sf_dir), SAMPLES)
    return out.select("phrase_id", "i", "sid", F.col("off").cast("bigint").alias("off"))


def sample_totals(spark, sf_dir):
    """Samples drawn and the sum of their offsets."""
    return sample_positions(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_samples"), F.sum("off").alias("sum_off"))


def query_generator(spark, sf_dir):
    return stored_index(spark, sf_dir).random_phrases(RANDOM_PHRASES).select("qid", _joined(F.col("q")).alias("vids"))


def query_positions_valid(spark, sf_dir):
    return S.valid_matches(_array(spark, sf_dir), _phrases(spark, sf_dir), stored_index(spark, sf_dir).sents)


def trie_shape(spark, sf_dir):
    out = stored_index(spark, sf_dir).trie(LEAF)
    return out.select(_joined(F.col("path")).alias("path"), F.col("depth").cast("bigint").alias("depth"), "n", "is_leaf")


def trie_dump(spark, sf_dir):
    out = stored_index(spark, sf_dir).dump(_vocab(spark, sf_dir).where("not is_alias"), LEAF)
    return out.select(F.col("line_no").cast("bigint").alias("line_no"), "line")


def _halves(spark, sf_dir):
    sents = _sents(spark, sf_dir)
    cut = sents.agg(F.coalesce(F.max("sid"), F.lit(0))).first()[0] // 2
    return two_batches(sents, cut)


def _grown(spark, sf_dir) -> TokenIndex:
    first, second = _halves(spark, sf_dir)
    return TokenIndex.build(first).add(second)


def index_append(spark, sf_dir):
    """The runs of an index that took the sentences in two batches; the second is sorted alone."""
    runs = [r.sa.select(F.lit(k).cast("bigint").alias("run"), "rank", "sid", F.col("off").cast("bigint").alias("off")) for k, r in enumerate(_grown(spark, sf_dir).runs)]
    return runs[0].unionByName(runs[1]) if len(runs) > 1 else runs[0]


def append_count(spark, sf_dir):
    """Phrase counts over both runs, nothing merged."""
    return _grown(spark, sf_dir).counts(_phrases(spark, sf_dir))


def index_merge(spark, sf_dir):
    first, second = _halves(spark, sf_dir)
    return TokenIndex.build(first).merge(TokenIndex.build(second)).sa.select("rank", "sid", F.col("off").cast("bigint").alias("off"))


def static_vs_dynamic(spark, sf_dir):
    """Each position's rank in the index built at once and in the one that grew by a batch and was merged."""
    static, grown = _array(spark, sf_dir), _grown(spark, sf_dir).sa
    both = static.select("sid", "off", "rank").join(grown.select("sid", "off", F.col("rank").alias("grown_rank")), ["sid", "off"], "full")
    return both.select("sid", F.col("off").cast("bigint").alias("off"), "rank", "grown_rank")


def corpus_append(spark, sf_dir):
    """The trg sentences numbered on behind the src sentences."""
    src = _sents(spark, sf_dir)
    trg = _sents(spark, sf_dir, "trg").select(F.col("sid").alias("k"), "toks")
    return C.append(src, trg, ["k"]).select("sid", F.size("toks").cast("bigint").alias("n_tokens"))


def _store(spark) -> Store:
    return Store(spark, temporary(spark, "store"))


def snapshot_phrase_count(spark, sf_dir):
    """Counts from a store that took the sentences in two batches, with the second sent twice."""
    store = _store(spark)
    first, second = _halves(spark, sf_dir)
    for batch_id, batch in ((0, first), (1, second), (1, second)):
        store.append(batch.withColumnRenamed("sid", "k"), ["k"], batch_id)
    return store.counts(_phrases(spark, sf_dir))


def stream_phrase_count(spark, sf_dir):
    """Counts after the corpus came in as a stream; repeated deliveries of a sid are one sentence."""
    store, path = _store(spark), f"{sf_dir}/corpus.parquet"
    stream = ingest.table_stream(spark, path, spark.read.parquet(path).schema)
    rows = stream.where("side = 'src' and toks is not null and sid is not null").select(F.col("sid").alias("k"), "toks")
    ingest.ingest(rows, ingest.append_sentences(store, ["k"], key="k"), f"{temporary(spark, 'progress')}", once=True).awaitTermination()
    return store.counts(_phrases(spark, sf_dir))


def _short(spark, sf_dir) -> DataFrame:
    """The sentences in pieces of at most 255 tokens, numbered from 0: what the files' one-byte offsets can hold."""
    pieces = C.chunks(_sents(spark, sf_dir))
    return materialize(ranked(pieces.where("size(toks) > 0"), ["sid", "base"], "k").select(F.col("k").cast("bigint").alias("sid"), "toks"))


def file_corpus(spark, sf_dir):
    """Sentences written to a version 2 file and to a version 3 pair of files, and read back from both."""
    folder, sents = temporary(spark, "files"), _short(spark, sf_dir)
    export.write_corpus(sents, f"{folder}/c.mct")
    export.write_corpus(sents, f"{folder}/c.trk", f"{folder}/c.six")
    parts = [C.tokens(df).select(F.lit(v).cast("bigint").alias("version"), "sid", F.col("off").cast("bigint").alias("off"), F.col("vid").cast("bigint").alias("vid")) for v, df in ((2, binary.read_corpus(spark, f"{folder}/c.mct")), (3, binary.read_corpus(spark, f"{folder}/c.trk", f"{folder}/c.six")))]
    return parts[0].unionByName(parts[1])


def file_vocab(spark, sf_dir):
    """The dictionary written to a file and read back; id 1 reads as the end of sentence, its stored word as an alias."""
    path = f"{temporary(spark, 'files')}/v.tdx"
    export.write_vocab(_vocab(spark, sf_dir), path)
    return binary.read_vocab(spark, path)[0].select("vid", "surface", "is_alias")


def file_alignment(spark, sf_dir):
    """Alignments written to a file, numbered from 0 by sid, and read back."""
    path = f"{temporary(spark, 'files')}/a.mam"
    held = materialize(ranked(A.alignments(table(spark, sf_dir, "alignment")), ["sid"], "k").select(F.col("k").cast("bigint").alias("sid"), "links"))
    export.write_alignment(held, path)
    return A.links(binary.read_alignment(spark, path)).select("sid", *[F.col(c).cast("bigint").alias(c) for c in ("i", "src", "trg")])


def file_suffix_array(spark, sf_dir):
    """An array written to a file, read back, checked against its sentences and loaded as an index."""
    path, sents = f"{temporary(spark, 'files')}/i.sfa", _short(spark, sf_dir)
    export.write_suffix_array(TokenIndex.build(sents).sa, path)
    return TokenIndex.load(sents, binary.read_suffix_array(spark, path)).sa.select("rank", "sid", F.col("off").cast("bigint").alias("off"))


def load_then_grow(spark, sf_dir):
    """Counts of an index that was loaded from a headerless leaf file and then took a second batch."""
    path, sents = f"{temporary(spark, 'files')}/array", _short(spark, sf_dir)
    cut = (sents.agg(F.max("sid")).first()[0] or 0) // 2
    first, second = two_batches(sents, cut)
    export.write_suffix_array(TokenIndex.build(first).sa, path, header=False)
    return TokenIndex.load(first, binary.read_leaf(spark, path)).add(second).counts(_phrases(spark, sf_dir))


def file_text(spark, sf_dir):
    """The documents' lines written to text files and read back, split at line feeds and single spaces only."""
    path = temporary(spark, "files")
    lines = table(spark, sf_dir, "documents").where("text is not null").select(F.explode(lines_of(F.col("text"))).alias("line"))
    lines.write.text(path, lineSep="\n")
    return read_text(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def vid_child_path(spark, sf_dir):
    return _vocab(spark, sf_dir).select("vid").distinct().select("vid", child_path(F.col("vid")).alias("path"))


def alignment_links(spark, sf_dir):
    out = A.links(A.alignments(table(spark, sf_dir, "alignment")))
    return out.select("sid", *[F.col(c).cast("bigint").alias(c) for c in ("i", "src", "trg")])


def aligned_tokens(spark, sf_dir):
    out = A.aligned_tokens(A.alignments(table(spark, sf_dir, "alignment")), _sents(spark, sf_dir), _sents(spark, sf_dir, "trg"))
    return out.select("sid", *[F.col(c).cast("bigint").alias(c) for c in ("i", "src_vid", "trg_vid")])


def events_phrase_count(spark, sf_dir):
    """Two-step sequences of event types per user, the end of a user's events included."""
    rows = table(spark, sf_dir, "events").where("user_id is not null and event_type is not null").select("user_id", "ts", "event_id", F.col("event_type").alias("word"))
    vocab = V.build_vocab(rows, ["word"])
    sents = V.lookup(rows, vocab).groupBy(F.col("user_id").alias("sid")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "vid"))), lambda x: x["vid"].cast("int")).alias("toks"))
    counts = P.ngram_counts(sents, 2).select("q", "n", F.posexplode("q").alias("k", "v")).select("q", "n", "k", F.col("v").cast("bigint").alias("vid"))
    words = V.surfaces(counts, vocab).groupBy("q", "n").agg(F.array_sort(F.collect_list(F.struct("k", "surface"))).alias("w"))
    return words.select(F.array_join(F.transform("w", lambda x: x["surface"]), " ").alias("words"), "n")


_ALL = (
    text_lines, vocab_build, vocab_lookup, vocab_reverse, vocab_extend, vocab_aliases, corpus_stats, corpus_append, sentence_fetch, sentence_surface, token_at_places,
    suffix_array, suffix_array_trg, suffix_neighbors, random_access, phrase_count, phrase_narrow_trace, phrase_locate, phrase_range, index_count, span_narrow, span_at, span_next, phrase_eos,
    position_surface, position_text, position_add, position_compare, _ngrams(1), _ngrams(2), _ngrams(3), ngram_topk, next_token_dist, root_children, order_statistics, ordered_map, prefix_rollup,
    sample_positions, sample_totals, query_generator, query_positions_valid, trie_shape, trie_dump, index_append, append_count, index_merge, static_vs_dynamic, snapshot_phrase_count,
    stream_phrase_count, file_corpus, file_vocab, file_alignment, file_suffix_array, load_then_grow, file_text, vid_child_path, alignment_links, aligned_tokens, events_phrase_count,
)
QUERIES = {f.__name__: f for f in _ALL}

_CORPUS = """
with sent as (select sid, max(toks) as toks from corpus where side = 'src' and toks is not null and sid is not null group by sid),
pos as (select sid, o as off, toks[o + 1:len(toks)] as suf from (select *, unnest(range(len(toks))) as o from sent)),
full_pos as (select sid, off, suf, list_append(suf, 1) as f from pos),
ph as (select phrase_id, q, len(q) as l from phrases),
"""
_SA = _CORPUS + "sa as (select row_number() over (order by suf, sid, off) - 1 as rank, sid, off, suf, list_append(suf, 1) as f from pos),\n"
_HITS = "hit as (select p.phrase_id, s.rank, s.sid, s.off from ph p join sa s on s.f[1:p.l] = p.q and len(s.f) >= p.l)\n"
_SPAN = _SA + _HITS[:-1] + ",\nspan as (select phrase_id, min(rank) as lo, max(rank) + 1 as hi from hit group by phrase_id)\n"
_WORDS = """
with line as (
  select doc_id, line, line_no from (
    select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from documents where text is not null)
  where not ((suffix(text, chr(10)) or text = '') and line_no = len(string_split(text, chr(10))) - 1)),
word as (select doc_id, line_no, unnest(string_split(line, ' ')) as word, unnest(range(len(string_split(line, ' ')))) as tok_no from line)
"""


_VOC = "select vid, surface, min(coalesce(is_alias, false)) as is_alias from vocab where side = '{side}' and vid is not null and surface is not null group by vid, surface"
_READ = "(select vid, min(surface) as surface from (" + _VOC.format(side="src") + ") where not is_alias group by vid)"


def _draw(a: str, b: str, n: str) -> str:
    def mixed(x: str) -> str:
        return f"((xor({x}, ({x}) >> {S.SHIFT}) * {S.STEP} + {S.OFFSET}) & {S.WRAP - 1})"

    def word(salt: int) -> str:
        first = mixed(f"(((({a})::bigint & {S.WRAP - 1}) + {salt}) & {S.WRAP - 1})")
        return mixed(mixed(f"(({first} + (({b})::bigint & {S.WRAP - 1})) & {S.WRAP - 1})"))

    return f"(({word(S.SALTS[0])} * {S.WRAP} + {word(S.SALTS[1])}) % ({n}))"


def _trie_ctes(max_leaf: int, depth: int = 24) -> str:
    """The nodes as ``trie(path, depth, n, is_leaf)``; deeper tries than ``depth`` do not occur in the tests' tables."""
    parts = [f"in0 as (select []::integer[] as path, {max_leaf + 1}::bigint as s where (select count(*) from pos) > {max_leaf})"]
    for d in range(depth):
        parts += [
            f"r{d} as (select i.path, i.s, f[{d + 1}] as v, row_number() over (partition by i.path order by p.sid, p.off) as rn from full_pos p join in{d} i on p.f[1:{d}] = i.path)",
            f"c{d} as (select list_append(path, v) as path, v, {d + 1} as depth, count(*) as n, greatest({max_leaf + 1}, count(*) filter (rn <= s) + 1) as s from r{d} group by path, v)",
            f"in{d + 1} as (select path, s from c{d} where v <> 1 and n >= s)",
        ]
    rows = " union all ".join(f"select path, depth, n, v = 1 or n < s as is_leaf from c{d}" for d in range(depth))
    root = f"select []::integer[] as path, 0 as depth, count(*) as n, count(*) <= {max_leaf} as is_leaf from pos"
    return ",\n".join(parts) + f",\ntrie as ({root} union all {rows})\n"


def _dump_sql(max_leaf: int, depth: int = 24) -> str:
    inside = " union all ".join(f"select t.path, s.rank, s.sid, s.off from sa s join trie t on t.is_leaf and t.depth = {d} and s.f[1:{d}] = t.path" for d in range(depth + 1))
    quote, pad = "chr(39)", "repeat('  ', len(path)"
    return _SA + _trie_ctes(max_leaf, depth) + f""", ent as ({inside}), named as (select t.*, coalesce(v.surface, '') as surface from trie t left join {_READ} v on v.vid = t.path[-1]),
lines as (
  select path, 1 as part, -1 as rank, {pad}) || 'TreeNode size=' || n || ' is_leaf=' || is_leaf as line from trie
  union all select path, 0, -1, {pad} - 1) || '* ' || {quote} || surface || {quote} || ' vid=' || path[-1] from named where len(path) > 0
  union all select path, 2, rank, {pad}) || '* [sid=' || sid || ' offset=' || off || ']' from ent)
select row_number() over (order by path, part, rank) - 1 as line_no, line from lines"""


def _grams(n: int) -> str:
    return f"select f[1:{n}] as q from full_pos where len(f) >= {n}"


_TRACE = """steps as (
  select phrase_id, q, 1 as depth, case when h.n is null then []::integer[] else q[1:1] end as cur, coalesce(h.n, 0) as n
  from ph left join cnt h on h.g = q[1:1] where l >= 1
  union all
  select s.phrase_id, s.q, s.depth + 1, case when h.n is null then s.cur else list_append(s.cur, s.q[s.depth + 1]) end, coalesce(h.n, 0)
  from steps s left join cnt h on h.g = list_append(s.cur, s.q[s.depth + 1]) where len(s.q) > s.depth)
"""
_SAMPLED = _CORPUS + """smp as (
  select d.sample_id, d.tok_offset as o, s.toks from (select distinct sample_id, phrase_id, sid, tok_offset from sampled_positions where sid is not null and tok_offset is not null and sample_id is not null) d
  join sent s using (sid) where d.tok_offset < len(s.toks))
"""
_SA_TRG = _SA.replace("side = 'src'", "side = 'trg'")
_TOP = _SA + f"""top as (select q from (select f[1:2] as q, count(*) as n from full_pos where len(f) >= 2 group by 1) order by n desc, q limit {SPANS}),
spans as (
  select t.q, d.d as depth, count(*) as n, min(s.rank) as lo, max(s.rank) + 1 as hi
  from top t, (values (1), (2)) d(d), sa s where s.f[1:d.d] = t.q[1:d.d] and len(s.f) >= d.d group by 1, 2)
"""
_SHORT = f"""
with whole as (select sid, max(toks) as toks from corpus where side = 'src' and toks is not null and sid is not null group by sid),
cut as (select sid as s, b, toks[b * {MAX_LEN} + 1:(b + 1) * {MAX_LEN}] as toks from (select sid, toks, unnest(range((len(toks) + {MAX_LEN} - 1) // {MAX_LEN})) as b from whole)),
sent as (select row_number() over (order by s, b) - 1 as sid, toks from cut),
"""

SQL = {
    "text_lines": _WORDS + "select doc_id, line_no, len(string_split(line, ' ')) as n_words, line from line",
    "vocab_build": _WORDS + """select 1::bigint as vid, '</s>' as surface union all
select row_number() over (order by first_place) + 1, word from (select word, min({'a': doc_id, 'b': line_no, 'c': tok_no}) as first_place from word where word <> '</s>' group by word)""",
    "vocab_lookup": _WORDS + f"select w.word, v.vid from (select distinct word from word) w left join (select surface, min(vid) as vid from ({_VOC.format(side='src')}) group by surface) v on v.surface = w.word",
    "vocab_reverse": f"select t.vid, v.surface from (select distinct vid::bigint as vid from tokens where vid is not null) t left join {_READ} v using (vid)",
    "vocab_extend": _WORDS + f""", s as ({_VOC.format(side="src")}), n as (
  select word, min({{'a': doc_id, 'b': line_no, 'c': tok_no}}) as first_place from word where word not in (select surface from s) group by word)
select (select max(vid) from s) + row_number() over (order by first_place) as vid, word as surface from n""",
    "vocab_aliases": f"""with v as ({_VOC.format(side="src")} having surface <> '</s>'), a as (select 1::bigint as vid, false as is_alias union all select vid, vid <= 1 from v)
select vid, count(*) as n_words, count_if(is_alias)::bigint as n_aliases from a group by vid""",
    "corpus_stats": """select side, count(*) as n_sentences, coalesce(sum(len(toks)), 0)::bigint as n_tokens
from (select side, sid, max(toks) as toks from corpus where toks is not null and sid is not null and side in ('src', 'trg') group by side, sid) group by side""",
    "corpus_append": """with s as (select side, sid, max(toks) as toks from corpus where toks is not null and sid is not null group by side, sid)
select sid, len(toks) as n_tokens from s where side = 'src' union all
select (select max(sid) from s where side = 'src') + row_number() over (order by sid), len(toks) from s where side = 'trg'""",
    "sentence_fetch": _CORPUS + "x as (select sid, unnest(toks)::bigint as vid, unnest(range(len(toks))) as off from sent) select sid, off, vid from x",
    "sentence_surface": _CORPUS + f"""w as (select sid, t.o, v.surface from (select sid, unnest(toks)::bigint as vid, unnest(range(len(toks))) as o from sent) t left join {_READ} v using (vid))
select sid, coalesce(string_agg(surface, ' ' order by o), '') as text from w group by sid union all select sid, '' from sent where len(toks) = 0""",
    "token_at_places": _CORPUS + """x as (select sid, toks, unnest(range(len(toks) + 1)) as i from sent)
select sid, i, case when i = len(toks) then 1 else toks[i + 1] end::bigint as vid from x""",
    "suffix_array": _SA[:-2] + " select rank, sid, off from sa",
    "suffix_neighbors": _SA[:-2] + " select rank, lag(sid) over w as prev_sid, lag(off) over w as prev_off, lead(sid) over w as next_sid, lead(off) over w as next_off from sa window w as (order by rank)",
    "random_access": _SA + f"d as (select distinct {_draw('g.id', '3', '(select count(*) from sa)')} as rank from range({RANDOM_PHRASES}) g(id)) select rank, sid, off from sa join d using (rank)",
    "phrase_count": _SA + _HITS + "select ph.phrase_id, count(hit.sid) as n from ph left join hit using (phrase_id) group by ph.phrase_id",
    "phrase_narrow_trace": (_CORPUS + "cnt as (" + " union all ".join(f"select q as g, count(*) as n from ({_grams(n)}) group by q" for n in range(1, 7)) + "),\n" + _TRACE).replace("with sent", "with recursive sent", 1)
    + "select phrase_id, depth::bigint as depth, n, len(cur) as span_depth from steps",
    "phrase_locate": _SA + _HITS + "select phrase_id, row_number() over (partition by phrase_id order by rank) - 1 as k, sid, off from hit",
    "phrase_range": _SPAN + "select phrase_id, lo as first_rank, hi as end_rank from span",
    "phrase_eos": _SA + "hit as (select p.phrase_id, s.sid from ph p join sa s on s.f = list_append(p.q, 1)) select ph.phrase_id, count(hit.sid) as n from ph left join hit using (phrase_id) group by ph.phrase_id",
    "position_surface": _SAMPLED + f"select sample_id, v.surface from smp left join {_READ} v on v.vid = toks[o + 1]",
    "position_text": _SAMPLED + f""", w as (select sample_id, t.k, v.surface from (
  select sample_id, unnest(x)::bigint as vid, unnest(range(len(x))) as k from (select sample_id, list_append(toks, 1)[o + 1:] as x from smp)) t left join {_READ} v using (vid))
select sample_id, string_agg(surface, ' ' order by k) as text from w group by sample_id""",
    "position_add": _SAMPLED + """, e as (select sample_id, o, list_append(toks, 1) as f from smp), x as (select sample_id, o, f, unnest(range(len(f) - o)) as k from e)
select sample_id, k, f[o + k + 1]::bigint as vid from x""",
    "position_compare": _SAMPLED + "select sample_id, toks < toks[o + 1:len(toks)] as start_precedes, o = 0 as same from smp",
    **{f"ngram_counts_{n}": _CORPUS + f"g as ({_grams(n)}) select array_to_string(q, ' ') as vids, count(*) as n from g group by q" for n in (1, 2, 3)},
    "ngram_topk": _CORPUS + f"g as ({_grams(2)}), c as (select q, count(*) as n from g group by q) select array_to_string(q, ' ') as vids, n from (select * from c order by n desc, q limit {TOP})",
    "next_token_dist": _CORPUS + """c as (select p.phrase_id, f[p.l + 1]::bigint as vid, count(*) as n from ph p join full_pos s on s.f[1:p.l] = p.q and len(s.f) > p.l group by 1, 2)
select phrase_id, vid, n, coalesce(sum(n) over (partition by phrase_id order by vid rows between unbounded preceding and 1 preceding), 0)::bigint as cum_before from c""",
    "root_children": _CORPUS + """c as (select f[1]::bigint as vid, count(*) as n from full_pos group by 1)
select vid, n, coalesce(sum(n) over (order by vid rows between unbounded preceding and 1 preceding), 0)::bigint as cum_before from c""",
    "prefix_rollup": _CORPUS + "g as (" + " union all ".join(_grams(n) for n in (1, 2, 3)) + "), c as (select q, count(*) as n from g group by q) select len(q) as depth, count(*) as n_nodes, sum(n)::bigint as n_positions from c group by len(q)",
    "sample_positions": _SPAN + f""", d as (select phrase_id, i, lo + {_draw("phrase_id", "i", "hi - lo")} as rank from (select *, unnest(range(1, least({SAMPLES}, hi - lo) + 1)) as i from span))
select phrase_id, i, sid, off from d join sa using (rank)""",
    "sample_totals": _SPAN + f""", d as (select lo + {_draw("phrase_id", "i", "hi - lo")} as rank from (select *, unnest(range(1, least({SAMPLES}, hi - lo) + 1)) as i from span))
select count(*) as n_samples, sum(off)::bigint as sum_off from d join sa using (rank)""",
    "query_generator": _SA + f"""d as (select g.id as qid, {_draw("g.id", "1", "(select count(*) from sa)")} as rank from range({RANDOM_PHRASES}) g(id))
select qid, array_to_string(suf[1:1 + {_draw("qid", "2", "least(5, len(suf))")}], ' ') as vids from d join sa using (rank)""",
    "query_positions_valid": _SPAN + """, near as (
  select p.phrase_id, count(*) as outside from span p join ph using (phrase_id) join sa s on s.rank = p.lo - 1 or s.rank = p.hi where s.f[1:ph.l] = ph.q and len(s.f) >= ph.l group by 1)
select phrase_id, hi - lo as n, coalesce(outside, 0)::bigint as outside from span left join near using (phrase_id)""",
    "trie_shape": _CORPUS + _trie_ctes(LEAF) + "select array_to_string(path, ' ') as path, depth::bigint as depth, n, is_leaf from trie",
    "trie_dump": _dump_sql(LEAF),
    "index_append": _CORPUS + """half as (select (max(sid) // 2) as cut from sent), r as (select *, case when sid < (select cut from half) then 0 else 1 end::bigint as run from pos)
select run, row_number() over (partition by run order by suf, sid, off) - 1 as rank, sid, off from r""",
    "index_merge": _SA[:-2] + " select rank, sid, off from sa",
    "static_vs_dynamic": _SA[:-2] + " select sid, off, rank, rank as grown_rank from sa",
    "vid_child_path": f"select distinct vid, lower(printf('%08X', vid))[1:5] || '/' || lower(printf('%08X', vid)) as path from ({_VOC.format(side='src')})",
    "alignment_links": """with a as (select sid, max(links) as links from alignment where sid is not null and links is not null group by sid),
l as (select sid, unnest(links) as link, unnest(range(len(links))) as i from a)
select sid, i, link.src::bigint as src, link.trg::bigint as trg from l where not coalesce(link.src = 255 and link.trg = 255, false)""",
    "aligned_tokens": """with a as (select sid, max(links) as links from alignment where sid is not null and links is not null group by sid),
s as (select side, sid, max(toks) as toks from corpus where toks is not null and sid is not null group by side, sid),
l as (select sid, unnest(links) as link, unnest(range(len(links))) as i from a)
select l.sid, i, x.toks[link.src + 1]::bigint as src_vid, y.toks[link.trg + 1]::bigint as trg_vid
from l join s x on x.sid = l.sid and x.side = 'src' join s y on y.sid = l.sid and y.side = 'trg' where link.src < len(x.toks) and link.trg < len(y.toks)""",
    "events_phrase_count": """with e as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as k from events where user_id is not null and event_type is not null),
g as (select event_type, coalesce(lead(event_type) over (partition by user_id order by k), '</s>') as after from e)
select event_type || ' ' || after as words, count(*) as n from g group by 1""",
}
SQL |= {
    "suffix_array_trg": _SA_TRG[:-2] + " select rank, sid, off from sa",
    "span_narrow": _TOP + "select array_to_string(q, ' ') as vids, depth::bigint as depth, n, lo as first_rank, hi as end_rank from spans",
    "span_at": _TOP + """, k as (select distinct q, lo, unnest([-1, 0, n - 1, n]) as k from spans where depth = 2)
select array_to_string(q, ' ') as vids, k, s.sid, s.off from k left join sa s on s.rank = k.lo + k.k""",
    "span_next": _TOP + """select array_to_string(q, ' ') as vids, s.f[3]::bigint as vid, count(*) as n
from spans join sa s on s.rank >= lo and s.rank < hi where depth = 2 and len(s.f) >= 3 group by 1, 2""",
    "order_statistics": _CORPUS + f"""c as (select f[1]::bigint as vid, count(*) as n from full_pos group by 1),
m as (select vid, n, coalesce(sum(n) over (order by vid rows between unbounded preceding and 1 preceding), 0)::bigint as before from c),
d as (select distinct {_draw("g.id", "4", "(select count(*) from pos)")} as k from range({RANDOM_PHRASES}) g(id))
select k, vid, k - before as rest from d join m on k >= before and k < before + n""",
    "ordered_map": _CORPUS + "c as (select f[1]::bigint as key, count(*) as n from full_pos group by 1) select key, 2 * n as n from c union all select 0, 5",
    "file_corpus": _SHORT + """x as (select sid, unnest(toks)::bigint as vid, unnest(range(len(toks))) as off from sent)
select v::bigint as version, sid, off, vid from x, (values (2), (3)) g(v)""",
    "file_vocab": f"""with v as ({_VOC.format(side="src")})
select vid, surface, vid <= 1 as is_alias from v where surface <> '</s>' union all select 1, '</s>', false""",
    "file_alignment": """with a as (select row_number() over (order by sid) - 1 as sid, links from (select sid, max(links) as links from alignment where sid is not null and links is not null group by sid)),
l as (select sid, unnest(links) as link, unnest(range(len(links))) as i from a)
select sid, i, link.src::bigint as src, link.trg::bigint as trg from l where not coalesce(link.src = 255 and link.trg = 255, false)""",
    "file_suffix_array": _SHORT + """pos as (select sid, o as off, toks[o + 1:] as suf from (select *, unnest(range(len(toks))) as o from sent))
select row_number() over (order by suf, sid, off) - 1 as rank, sid, off from pos""",
    "load_then_grow": _SHORT + """full_pos as (select sid, list_append(toks, 1)[o + 1:] as f from (select *, unnest(range(len(toks))) as o from sent)),
hit as (select p.phrase_id, s.sid from phrases p join full_pos s on s.f[1:len(p.q)] = p.q and len(s.f) >= len(p.q))
select p.phrase_id, count(hit.sid) as n from phrases p left join hit using (phrase_id) group by p.phrase_id""",
    "file_text": _WORDS + "select line, count(*) as n from line group by line",
}
for _name in ("index_count", "append_count", "snapshot_phrase_count", "stream_phrase_count"):
    SQL[_name] = SQL["phrase_count"]
