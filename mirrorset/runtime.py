"""Session-level helpers: cutting lineage into the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[list | None] = ContextVar("scratch tables of the running step", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN_DIR = "spark.mirrorset.local.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is made only when running in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    own = spark.conf.get(_OWN_DIR, None)
    if own:
        return own
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = "file:" + tempfile.mkdtemp(prefix="mirrorset-checkpoint-")
    spark.conf.set(_OWN_DIR, own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark)}/mirrorset/{label}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files of the jobs that run inside go as each job ends, as nothing reads them after it."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a step to the shared folder and go on from the stored table.

    A stored table survives lost executors, freezes values such as generated row numbers, and
    carries real sizes, so a join against it is broadcast only when it is known to be small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    if (made := _scope.get()) is not None:
        made.append(stored)
    return stored


@contextmanager
def scratch_scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that :func:`cut_lineage` makes inside, except those handed to the yielded function.

    What is computed inside must be written, or kept, before the end.
    """
    made: list[DataFrame] = []
    kept: set[int] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(id(df))
        return df

    before = _scope.set(made)
    try:
        yield keep
    finally:
        _scope.reset(before)
        forget(*[df for df in made if id(df) not in kept])


def forget(*stored: DataFrame) -> None:
    """Delete tables made by :func:`cut_lineage` that no later step reads any more."""
    for df in stored:
        path = getattr(df, "_stored_at", None)
        if path is None:
            continue
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        df._stored_at = None


def enable_skew_handling(spark: SparkSession) -> None:
    """Let adaptive execution split hot keys even where that costs one more shuffle."""
    for key in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
                "spark.sql.adaptive.coalescePartitions.enabled",
                "spark.sql.adaptive.forceOptimizeSkewedJoin"):
        spark.conf.set(key, "true")
