"""Session helpers: a tuned local session and tables that survive the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and single-machine runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("phraseloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can reach.

    ``spark.checkpoint.dir`` of the session wins, then a folder set by ``setCheckpointDir``.  Only a local master, where
    one machine is the cluster, gets a temporary folder of its own.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return folder
    if folder := spark.sparkContext.getCheckpointDir():
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="phraseloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session is gone; the cluster's own clean-up has the folder
        pass


#: Paths written inside the open :func:`scratch` scopes, innermost last.
_SCOPES: list[list[str]] = []


def temporary(spark: SparkSession, prefix: str = "phraseloom", keep: bool = False) -> str:
    """A new path below :func:`shared_dir`, removed at the end of the innermost :func:`scratch` scope.

    Outside of a scope, and for ``keep`` outside of the innermost one, it goes with the scope around, or when the
    driver's Python ends.
    """
    path = f"{shared_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
    scopes = _SCOPES[:-1] if keep else _SCOPES
    if scopes:
        scopes[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`materialize` writes within go at the end, but for those it is told to keep.

    Only for code whose result is itself written: a lazy result would read files that are gone.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below :func:`shared_dir` and return a scan of it.

    Cuts the lineage: later stages read the files, not the executors that made them, so a lost executor costs only its
    running tasks.  :func:`temporary` says how long the files stay.
    """
    spark = df.sparkSession
    path = temporary(spark, keep=keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
