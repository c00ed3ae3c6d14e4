"""Tables in the folder that driver and executors share, which end a plan's lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_SWEPT: set[str] = set()
#: Of each transient() that is open, the paths made in it.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, the folder given to setCheckpointDir(); where the master is local, as in tests, a local one. A cluster without either is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(f"{tempfile.gettempdir()}/lodestar-checkpoints")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, under this application's own name. What lies there goes when the driver's Python ends."""
    if spark.sparkContext.applicationId not in _SWEPT:
        _SWEPT.add(spark.sparkContext.applicationId)
        atexit.register(_sweep, spark)
    path = f"{shared_dir(spark)}/lodestar-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextlib.contextmanager
def transient(spark: SparkSession) -> Iterator[None]:
    """Deletes what was written inside on leaving. A table that is to stay is written after that, or by a path of its own."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            drop_scratch(spark, path)


def _sweep(spark: SparkSession) -> None:
    if SparkContext._active_spark_context is spark.sparkContext:
        with contextlib.suppress(Exception):  # the JVM may have ended first
            drop_scratch(spark)


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table: lost executors cost no recomputation of what came before."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str | None = None) -> None:
    """Deletes one scratch path, or all that this application wrote; frames read from there end with it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path or f"{shared_dir(spark)}/lodestar-{spark.sparkContext.applicationId}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether a frame has at most `max_rows` rows, found without counting beyond them."""
    return df.limit(max_rows + 1).count() <= max_rows
