"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[str] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Spark's switch that removes a query's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one where it names none and all tasks run in this
    process's machine (a local master). A cluster without such a folder is an error: its executors would not see each other's files."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    if "own" not in _own:
        _own["own"] = tempfile.mkdtemp(prefix="reprise-")
    return f"file://{_own['own']}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/reprise-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove, spark)
    _written.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside goes at its end: nothing lazy that reads it may leave."""
    before = len(_written)
    yield
    for path in _written[before:]:
        remove(spark, path)
    del _written[before:]


def _remove(spark: SparkSession) -> None:
    try:
        for path in _written:
            remove(spark, path)
    except Exception:  # the JVM may be gone by then
        pass


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query inside go at its end, and not when the driver happens to collect its garbage."""
    was = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, was)


def materialize(df: DataFrame, name: str, release: bool = False, more: Iterable[DataFrame] = ()) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors.

    release: as `released`. more: what is written behind df's rows, one after another.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with released(spark) if release else nullcontext():
        for x in (df, *more):
            x.write.mode("append").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a materialized table that nothing reads any more."""
    path = _paths.pop(df, None)
    if path is not None:
        remove(df.sparkSession, path)
        _written.remove(path)
