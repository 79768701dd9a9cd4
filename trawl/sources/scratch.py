"""Tables that operators write on their way, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Once a table stands, the shuffles behind it are needless; with this setting Spark removes their files at the end of a write.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.RLock()
_writers: dict[int, list] = {}
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one on a single machine, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get().rstrip("/")
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="trawl-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def place(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/trawl-{what}-{uuid.uuid4().hex}"
    with _lock:
        _made[path] = spark
    return path


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The setting is on while any thread of the session writes, and as before afterwards."""
    key = id(spark._jsparkSession)
    with _lock:
        state = _writers.setdefault(key, [0, None])
        if not state[0]:
            state[1] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        state[0] += 1
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                spark.conf.set(_CLEANUP, state[1])
                del _writers[key]


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it: lineage ends here, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = place(spark, what)
    with _cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that `stored` wrote and that nothing will read again."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path is not None:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    with _lock:
        _made.pop(path, None)


@atexit.register
def _clean() -> None:
    for path, spark in list(_made.items()):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return
