"""Versioned snapshots of an index: sorted runs in Parquet and a manifest that names them.

A writer puts each new table into a directory of its own and then replaces the manifest once, so readers hold a
complete version at any time.  A batch is a run of its own; runs are merged as their sizes ask for it, so a position is
sorted a logarithmic number of times.  There is one writer at a time, as for the batches of a stream.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.operators.corpus import encode, require_known, valid
from phraseloom.operators.index import FANOUT, Run, TokenIndex, merged, to_merge
from phraseloom.operators.ordered import ranked
from phraseloom.operators.suffix import keyed, suffix_array
from phraseloom.operators.vocab import empty_vocab, extend_vocab
from phraseloom.schemas import MAX_LEAF, RUN, SENTENCES
from phraseloom.session import materialize, scratch


class Store:
    """A directory with ``_MANIFEST.json`` and one sub-directory per written table."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        fs, path = self._fs(), self._path("_MANIFEST.json")
        if not fs.exists(path):
            return {"version": 0, "sents": [], "runs": [], "vocab": [], "n_sents": 0, "next_vid": 2, "last_batch": {}, "max_leaf": MAX_LEAF, "preloaded": 0}
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Write beside the manifest, then put it in its place in one step where the file system can."""
        fs, new = self._fs(), self._path(f"_MANIFEST.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(manifest | {"version": manifest["version"] + 1}).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, self._path("_MANIFEST.json"), overwrite)

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def _read(self, names: list[str], schema) -> DataFrame:
        paths = [f"{self.root}/{n}" for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def sentences(self, manifest: dict | None = None) -> DataFrame:
        return self._read((manifest or self.manifest())["sents"], SENTENCES)

    def vocab(self, manifest: dict | None = None) -> DataFrame:
        known = empty_vocab(self.spark)
        return known.unionByName(self._read((manifest or self.manifest())["vocab"], known.schema))

    def runs(self, manifest: dict | None = None) -> list[Run]:
        return [Run(self._read([r["name"]], RUN), r["n"]) for r in (manifest or self.manifest())["runs"]]

    def index(self, manifest: dict | None = None) -> TokenIndex:
        """The snapshot as an index; later appends do not change it."""
        m = manifest or self.manifest()
        runs = self.runs(m) or [Run(self.spark.createDataFrame([], RUN), 0)]
        return TokenIndex(self.sentences(m), runs, None, m["max_leaf"], m["preloaded"])

    def put(self, index: TokenIndex) -> None:
        """Make an index the content of this store."""
        m = self.manifest() | {"max_leaf": index.max_leaf, "preloaded": index.preloaded}
        m["sents"] = [self._write(index.sents.select("sid", "toks"), "sents")]
        m["runs"] = [{"name": self._write(r.sa, "run"), "n": r.n} for r in index.runs]
        m["n_sents"] = self.sentences(m).agg(F.coalesce(F.max("sid") + 1, F.lit(0))).first()[0]
        self._publish(m)

    def _seen(self, m: dict, batch_id: int | None, stream: str) -> bool:
        """Batches of a stream come in order, so its last id tells which ones are in."""
        return batch_id is not None and batch_id <= m["last_batch"].get(stream, -1)

    def _append(self, m: dict, batch: DataFrame, order: list[str], batch_id: int | None, stream: str, fanout: int) -> None:
        with scratch(self.spark):
            fresh = valid(ranked(batch.select("toks", *order), order, "sid", m["n_sents"]))
            name = self._write(fresh, "sents")
            kept = self._read([name], SENTENCES)
            m["sents"] = [*m["sents"], name]
            m["n_sents"] += kept.count()
            sa, n = suffix_array(keyed(kept))
            runs = [*m["runs"], {"name": self._write(sa, "run"), "n": n}] if n else m["runs"]
            k = to_merge([r["n"] for r in runs], fanout)
            if k > 1:
                both = merged(self.runs({"runs": runs[-k:]}))
                runs = [*runs[:-k], {"name": self._write(both.sa, "run"), "n": both.n}]
            m["runs"] = runs
        if batch_id is not None:
            m["last_batch"] = m["last_batch"] | {stream: batch_id}
        self._publish(m)

    def append(self, batch: DataFrame, order: list[str], batch_id: int | None = None, stream: str = "", vocab: DataFrame | None = None, fanout: int = FANOUT) -> bool:
        """Append sentences (``toks`` and the order's columns) with a sorted run of their own; rows without toks are none.

        A batch id at or below the last one of its ``stream`` is skipped.  Null tokens, reserved ids and, with a ``vocab``
        or one of the store's own, unknown ids fail before the manifest names anything of the batch.
        """
        m = self.manifest()
        if self._seen(m, batch_id, stream):
            return False
        batch = batch.where("toks is not null")
        if vocab is None and m["vocab"]:
            vocab = self.vocab(m)
        if vocab is not None:
            require_known(batch, vocab)
        self._append(m, batch, order, batch_id, stream, fanout)
        return True

    def append_words(self, words: DataFrame, key: list[str], place: str, batch_id: int | None = None, stream: str = "", fanout: int = FANOUT) -> bool:
        """Append sentences given as word rows: new words are numbered on, then the sentences are encoded; one publish."""
        m = self.manifest()
        if self._seen(m, batch_id, stream):
            return False
        with scratch(self.spark):
            name = self._write(extend_vocab(self.vocab(m), words, [*key, place], m["next_vid"]), "vocab")
            m["vocab"] = [*m["vocab"], name]
            m["next_vid"] += self._read([name], empty_vocab(self.spark).schema).count()
            coded = materialize(encode(words, self.vocab(m), key, place))
            self._append(m, coded, key, batch_id, stream, fanout)
        return True

    def counts(self, phrases: DataFrame) -> DataFrame:
        """``phrase_id, n`` over all runs of the present snapshot."""
        return self.index().counts(phrases)

    def merged(self) -> DataFrame:
        """One ranked array over all runs."""
        return self.index().sa

    def compact(self, fanout: int | None = None) -> None:
        """Merge the last runs as far as their sizes ask for it; by default all."""
        m = self.manifest()
        k = len(m["runs"]) if fanout is None else to_merge([r["n"] for r in m["runs"]], fanout)
        if k > 1:
            with scratch(self.spark):
                both = merged(self.runs(m)[-k:])
                m["runs"] = [*m["runs"][:-k], {"name": self._write(both.sa, "run"), "n": both.n}]
            self._publish(m)

    def vacuum(self) -> list[str]:
        """Remove tables that the manifest no longer names; readers of older snapshots must be done."""
        m, fs = self.manifest(), self._fs()
        named = {*m["sents"], *m["vocab"], *(r["name"] for r in m["runs"])}
        gone = [f.getPath().getName() for f in fs.listStatus(self._path("")) if f.isDirectory()]
        gone = [n for n in gone if n.split("-")[0] in ("sents", "vocab", "run") and n not in named]
        for n in gone:
            fs.delete(self._path(n), True)
        return gone


def two_batches(sents: DataFrame, cut: int) -> tuple[DataFrame, DataFrame]:
    """Sentences below and from the sid ``cut`` on."""
    return sents.where(F.col("sid") < cut), sents.where(F.col("sid") >= cut)
