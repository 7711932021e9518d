"""Evaluation passages inside training text: a broadcast set of n-grams of words, scanned over every document.

Words are longest runs of letters or digits of the canonical form (:mod:`phraseloom.llm.canonical`), without case and
with look-alike letters folded, capitals by what they look like too.  The items' n-grams travel as sorted 64-bit window
hashes with the items' word ids; a hash hit is verified word for word.  The scan works on whole Arrow batches: words
become integer ids, window hashes come from shifted multiply-adds, and only windows of known words are looked up.

Items go out in blocks of bounded size, one broadcast each.  A document is read, formed and cut into words once; the
task takes one block after the other, holding one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from phraseloom.llm.canonical import FOLD, Canonicaliser

WORDS = 13
#: Characters of items that one broadcast block may hold: its n-grams, hashes and words stay below about 200 MB in a worker.
BLOCK_CHARS = 4_000_000
#: Characters of documents that a worker holds as words at a time.
SLICE_CHARS = 2_000_000

_WORD = re.compile(r"[^\W_]+")
_FOLD = str.maketrans(*FOLD)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _fold(word: str) -> str:
    return word if word.isascii() else word.translate(_FOLD)


def words_of(text: str) -> list[str]:
    """Comparable words of a canonical text."""
    return [_fold(w) for w in _WORD.findall(text.casefold())]


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive ids."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    x *= _BASE
    x ^= x >> np.uint64(31)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for j in range(n):
        out *= np.uint64(0x100000001B3)
        out += x[j : j + len(out)]
    return out


class ItemIndex:
    """The n-grams of one block of items."""

    def __init__(self, items: list[tuple[int, str]], n: int) -> None:
        self.n = n
        self.vocab: dict[str, int] = {}
        texts = Canonicaliser().texts([t for _, t in items])
        seqs = [[self.vocab.setdefault(w, len(self.vocab)) for w in words_of(t)] for t in texts]
        self.items = [i for i, _ in items]
        self.ids = np.array([w for s in seqs for w in s], np.int64)
        self.starts = np.cumsum([0, *map(len, seqs)])
        windows = window_hashes(self.ids, n)
        owner = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
        at = np.flatnonzero(owner[: len(windows)] == owner[n - 1 :]) if len(windows) else np.zeros(0, np.int64)
        order = np.argsort(windows[at], kind="stable")
        self.at = at[order]
        self.hashes = windows[at][order]
        self.owner = owner
        bits = max(16, int(np.ceil(np.log2(len(at) + 1))) + 4)
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self._slot(self.hashes)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * _BASE) >> self.shift).astype(np.int64)

    def encode(self, words: list[str]) -> np.ndarray:
        get = self.vocab.get
        ids = [get(w, -1) if w.isascii() else get(w.translate(_FOLD), -1) for w in words]
        return np.array(ids, np.int64)

    def scan(self, ids: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``ids`` where an n-gram of an item begins, and the item; windows lie within one of ``docs``."""
        n = self.n
        if len(ids) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        unknown = np.cumsum(np.concatenate([[0], ids < 0]))
        whole = (unknown[n:] == unknown[:-n]) & (docs[n - 1 :] == docs[: len(docs) - n + 1])
        h = window_hashes(ids, n)
        at = np.flatnonzero(whole)
        at = at[self.seen[self._slot(h[at])]]
        lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        place = np.repeat(at, hi - lo)
        if not len(place):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        run = np.arange(len(place)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        item_at = self.at[np.repeat(lo, hi - lo) + run]
        same = np.ones(len(place), bool)
        for j in range(n):
            same &= ids[place + j] == self.ids[item_at + j]
        return place[same], self.owner[item_at[same]]


def _slices(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[str]]]:
    part, own, held = [], [], 0
    for i, t in zip(ids, texts):
        if not t:
            continue
        part.append(t)
        own.append(i)
        held += len(t)
        if held >= SLICE_CHARS:
            yield own, part
            part, own, held = [], [], 0
    if part:
        yield own, part


def _scanned(sent: list, batches: Iterator[pa.RecordBatch], each) -> Iterator[pa.RecordBatch]:
    """``each(own, texts, words, sizes, hits)`` for slices of documents; ``hits`` are (index, document, place, item) per block."""
    canon = None
    for batch in batches:
        if not batch.num_rows:
            continue
        canon = canon or Canonicaliser()
        for own, texts in _slices(batch.column("id").to_pylist(), canon.canonical(batch.column("t")).to_pylist()):
            found = [_WORD.findall(t.casefold()) for t in texts]
            sizes = [len(w) for w in found]
            words = [w for ws in found for w in ws]
            docs = np.repeat(np.arange(len(texts)), sizes)
            hits = []
            for part in sent:
                ix = part.value
                place, item = ix.scan(ix.encode(words), docs)
                hits.append(([ix.items[i] for i in item.tolist()], docs[place], place))
                if len(sent) > 1:
                    part.unpersist_local()
            yield from each(own, texts, sizes, hits)


class _Sent:
    """A broadcast index that a worker reads from its file and drops again when another one is due."""

    def __init__(self, broadcast) -> None:
        self.broadcast = broadcast

    @property
    def value(self) -> ItemIndex:
        return self.broadcast.value

    def unpersist_local(self) -> None:
        if hasattr(self.broadcast, "_value"):
            del self.broadcast._value


def _sent(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, n: int, block_chars: int) -> list[_Sent]:
    return [_Sent(docs.sparkSession.sparkContext.broadcast(ix)) for ix in _blocks(items, id_col, text_col, n, block_chars)]


def _blocks(items: DataFrame, id_col: str, text_col: str, n: int, block_chars: int) -> Iterator[ItemIndex]:
    """Indexes over blocks of the items, made one after the other; a block's size is ``block_chars`` on average."""
    rows = items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).distinct()
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        yield ItemIndex([(r.i, r.t) for r in part.collect()], n)


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``id_col, item_id, n_windows, first_word, last_word``: documents with at least ``n`` consecutive words of an item.

    Null or empty texts and items leak nothing, items below ``n`` words neither; repeated rows of a document count once;
    without items or documents no rows come out.  Whole texts are scanned, once for all blocks of items.
    """
    kinds = docs.schema[id_col].dataType, items.schema[item_id].dataType
    out = T.StructType([T.StructField("id", kinds[0]), T.StructField("item", kinds[1]), *[T.StructField(c, T.LongType()) for c in ("n_windows", "first_word", "last_word")]])
    arrow = to_arrow_schema(out)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).where("t <> ''")
    sent = _sent(docs, items, item_id, item_text, n, block_chars)

    def each(own, texts, sizes, hits):
        first = np.cumsum([0, *sizes])
        for names, where, place in hits:
            if not len(place):
                continue
            code = {name: k for k, name in enumerate(dict.fromkeys(names))}
            pairs, back = np.unique(np.stack([where, np.array([code[x] for x in names])]), axis=1, return_inverse=True)
            off, back, known = place - first[where], back.reshape(-1), list(code)
            low, high = np.full(pairs.shape[1], np.iinfo(np.int64).max), np.zeros(pairs.shape[1], np.int64)
            np.minimum.at(low, back, off)
            np.maximum.at(high, back, off + n)
            windows = np.bincount(np.unique(np.stack([back, off]), axis=1)[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([own[d] for d in pairs[0]], arrow.field(0).type), pa.array([known[i] for i in pairs[1]], arrow.field(1).type), pa.array(windows), pa.array(low), pa.array(high)], schema=arrow
            )

    both = rows.mapInArrow(lambda b: _scanned(sent, b, each), out)
    return both.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_id)).agg(F.max("n_windows").alias("n_windows"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"))


def _leaks(sent: list, words: list[str], n: int) -> np.ndarray:
    """Which of one document's words lie in an ``n``-gram of any block."""
    hit = np.zeros(len(words) + 1, np.int64)
    for part in sent:
        place, _ = part.value.scan(part.value.encode(words), np.zeros(len(words), np.int64))
        off = np.unique(place)
        np.add.at(hit, off, 1)
        np.add.at(hit, off + n, -1)
        if len(sent) > 1:
            part.unpersist_local()
    return np.cumsum(hit)[:-1] > 0


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WORDS, drop_share: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``id_col, n_words, n_leaked, action, text`` of every document that leaks; rows that repeat an id and text are one.

    ``action`` is 'drop' (null text) where leaked words are at least ``drop_share`` of the words, else 'cut': the text is the
    canonical form without the leaked spans.  Where what is left and right of a cut makes a leaked passage again, that is
    cut too, until nothing leaks; ``n_leaked`` counts all words cut.  Spans are merged over all blocks of items before a cut.
    """
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("mark", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_leaked", T.LongType()), T.StructField("action", T.StringType()), T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(out)
    sent = _sent(docs, items, item_id, item_text, n, block_chars)

    def each(own, texts, sizes, hits):
        rows = []
        for d in sorted({int(x) for _, where, _ in hits for x in where}):
            text, cut = texts[d], 0
            while True:
                words = _WORD.findall(text.casefold())
                leaked = _leaks(sent, words, n)
                if not leaked.any():
                    break
                cut += int(leaked.sum())
                if cut >= drop_share * sizes[d]:
                    text = None
                    break
                text = _cut(text, leaked)
            rows.append((own[d]["id"], own[d]["mark"], sizes[d], cut, "drop" if text is None else "cut", text))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    rows = docs.select(F.struct(docs[id_col].alias("id"), F.sha2(docs[text_col], 256).alias("mark")).alias("id"), docs[text_col].alias("t")).where("t <> ''")
    return rows.mapInArrow(lambda b: _scanned(sent, b, each), out).dropDuplicates(["id", "mark"]).drop("mark").withColumnRenamed("id", id_col)


def _cut(text: str, leaked: np.ndarray) -> str:
    """The text without its leaked words and what stands between two leaked neighbours; a gap keeps words apart."""
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) != len(leaked):  # case folding changed the words' number; cut in the folded text, where they were counted
        text = text.casefold()
        spans = [m.span() for m in _WORD.finditer(text)]
    keep, at = [], 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], leaked.astype(np.int8), [0]])))
    for a, b in zip(edge[::2], edge[1::2]):
        keep.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join([*keep, text[at:]])
