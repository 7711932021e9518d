"""Structured Streaming into a :class:`~phraseloom.operators.incremental.Store`.

``foreachBatch`` runs one batch after the other, which is the store's single writer; the batch id makes a replay a no-op.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phraseloom.operators.incremental import Store
from phraseloom.session import materialize, scratch
from phraseloom.sources.text import tokens_of

#: Where a line stands: the file's time and name, the split's place in it, and the line's place in the split.
LINE_ORDER = ["file_time", "file_path", "block_start", "line_no"]


def text_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Lines of text files as they arrive, broken at line feeds only, with the file and the split that they come from."""
    lines = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select("value", F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"))


def table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Rows of Parquet files as they arrive in a directory; the path of one file streams that file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target) and not files.getFileStatus(target).isDirectory():
        return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())
    return reader.parquet(path)


def append_lines(store: Store, name: str = "") -> Callable[[DataFrame, int], None]:
    """A batch function for a :func:`text_stream`: each line is one sentence, in the order of files (time, then path) and lines.

    Within a split of a file the scan keeps the lines' order, which a growing id records; across splits the file's
    metadata orders them, whatever order Spark reads them in.  The numbered lines are written once, as vocabulary and
    encoding both read them.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            lines = materialize(batch.withColumn("line_no", F.monotonically_increasing_id()))
            words = lines.select(*LINE_ORDER, F.posexplode(tokens_of(F.col("value"))).alias("tok_no", "word"))
            store.append_words(words, LINE_ORDER, "tok_no", batch_id, name)

    return run


def append_sentences(store: Store, order: list[str], name: str = "", key: str | None = None) -> Callable[[DataFrame, int], None]:
    """A batch function for a stream of encoded sentences.

    With ``key``, repeated deliveries of a key are one sentence: within a batch by an aggregate, over batches by an
    anti-join against the keys written before, so the stream itself holds no state that grows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where("toks is not null")
        if key is None:
            store.append(rows, order, batch_id, name)
            return
        spark, known = batch.sparkSession, f"{store.root}-keys"
        with scratch(spark):
            once = rows.groupBy(key).agg(F.max("toks").alias("toks"))
            target = spark._jvm.org.apache.hadoop.fs.Path(known)
            if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
                # A replay finds its own keys under its own number and takes them again.
                before = spark.read.parquet(known).where(F.col("batch") < batch_id)
                once = once.join(before.select(key), key, "left_anti")
            fresh = materialize(once)
            fresh.select(key).write.mode("overwrite").parquet(f"{known}/batch={batch_id}")
            store.append(fresh, order, batch_id, name)

    return run


def ingest(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start the stream; ``once`` takes what is there and stops."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
