"""An end of lineage for plans that use one result many times."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of what open steps() blocks have settled and do not keep, outermost first.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())
#: Lets a query's shuffle files go with the query, where they would wait until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="foliant-"))
    return sc.getCheckpointDir().rstrip("/")


def settled(df: DataFrame, keep: bool = False) -> DataFrame:
    """df computed once and written as Parquet to the cluster's checkpoint folder, so that what builds on it starts there,
    also after a lost executor; its shuffles go then. Only a local session without such a folder gets one of its own;
    elsewhere it has to be set. The files go with the innermost steps() block, unless told to keep them, or with the driver."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/foliant-{uuid.uuid4().hex}-settled"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    if _open.get() and not keep:
        _open.get()[-1].append(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """What is settled within goes at the end of the block, unless it is kept; no frame that is used later may read what goes."""
    own: list[str] = []
    token = _open.set((*_open.get(), own))
    try:
        yield
    finally:
        _open.reset(token)
        for path in own:
            _drop(spark, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended already
        pass
