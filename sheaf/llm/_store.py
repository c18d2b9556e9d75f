"""Tables written to cut lineage, in the folder that every executor shares."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_own = threading.local()  # a thread's scopes, innermost last
_results: dict[str, SparkSession] = {}  # tables behind results, which go when the driver ends


def _scopes() -> list[dict[str, SparkSession]]:
    if not hasattr(_own, "scopes"):
        _own.scopes = []
    return _own.scopes


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset: with executors in this process, as in tests, a folder of our own; else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), f"sheaf-{os.getpid()}")
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back: later plans start from the files, which outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sheaf_path = path
    (_scopes()[-1] if _scopes() else _results)[path] = spark
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables on which nothing depends any more.

    Shuffle files of the plans that made them go when the driver collects its garbage, so that is asked for.
    """
    for table in tables:
        path, spark = table._sheaf_path, table.sparkSession
        for scope in [*_scopes(), _results]:
            scope.pop(path, None)
        _delete(spark, path)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


@contextmanager
def scratch() -> Iterator:
    """Tables written inside go at its end, but for those given to the function it yields; they belong to the scope around, or stay till the driver ends."""
    scope: dict[str, SparkSession] = {}
    _scopes().append(scope)

    def keep(table: DataFrame) -> DataFrame:
        scope.pop(table._sheaf_path, None)
        (_scopes()[-2] if len(_scopes()) > 1 else _results)[table._sheaf_path] = table.sparkSession
        return table

    try:
        yield keep
    finally:
        _scopes().pop()
        for path, spark in scope.items():
            _delete(spark, path)
        for spark in list(scope.values())[:1]:
            spark._jvm.System.gc()


@atexit.register
def _leave() -> None:
    try:
        for path, spark in _results.items():
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
    except Py4JError:  # the JVM went first
        return
