"""Shared helpers of the training-data operators: ids, splits, partitions, skew-safe joins."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorset.runtime import cut_lineage

#: A key with one in so many rows is hot; there are never more hot keys than that.
HOT_SHARE = 1000


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Hand at most ``rows`` rows at a time to Python in the jobs that run inside; for rows of any length."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frugal(run, forget=None):
    """``run`` of a mapInArrow for workers that go on to other tasks: when a task ends, ``forget`` empties the caches
    and freed memory goes back to the system. Results never depend on it."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, amount: float, each: float) -> int:
    """Enough partitions for ``amount`` at ``each`` a partition, and not fewer than the session's."""
    return max(shuffle_partitions(spark), int(amount // each) + 1)


def range_bounds(df: DataFrame, col: str, parts: int) -> list:
    """Ascending inner bounds that cut a numeric column into parts of about equal row counts."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(col, at, 20 * parts).alias("q")).first()["q"]
    return sorted(set(found or []))


def hash_sample(h: Column, rows: int, wanted: int) -> Column:
    """True on about 0.9 x ``wanted`` of ``rows`` rows, by a 64-bit hash; on all where there are no more than that.

    A limit of ``wanted`` behind it bounds the sample for certain without being what picks the rows.
    """
    share = 0.9 * wanted / rows if rows else 1.0
    return F.lit(True) if share >= 0.9 else h < F.lit(int(-(1 << 63) + share * (1 << 64)))


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Add one facts row per key to every row (both keys never null).

    ``facts`` has the row count of each key in ``count`` and is read twice, so it should be a stored
    table. Keys that hold more than one row in HOT_SHARE go by a broadcast of at most HOT_SHARE
    rows, so that a hot key is never sent to one task; the others go by a normal join.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT_SHARE > F.lit(total)
    hot = facts.where(is_hot).drop(count)
    hot_keys = [r[0] for r in hot.select(key).collect()]
    if not hot_keys:
        return rows.join(facts.drop(count), key)
    cold = rows.where(~F.col(key).isin(hot_keys)).join(facts.where(~is_hot).drop(count), key)
    return cold.unionByName(rows.where(F.col(key).isin(hot_keys)).join(F.broadcast(hot), key))


__all__ = ["cut_lineage", "documents", "frugal", "hash_sample", "id_remainder", "join_facts", "partitions_for", "range_bounds",
           "shuffle_partitions"]
