"""Per-group work that never needs one task to hold a whole group.

Window functions sort a complete group inside one task. Here group facts are aggregated with
partial aggregation and joined back, and full orders are numbered over range partitions, so a
group with a third of all rows is spread over many tasks like any other data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorset.runtime import cut_lineage


def attach(df: DataFrame, keys: list[str] | str, *facts: Column) -> DataFrame:
    """Add aggregates of each row's group (keys must not be null).

    The input is read twice, so chains of these calls grow fast: put facts into one call.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.join(df.groupBy(*keys).agg(*facts), keys)


def mark_first(df: DataFrame, keys: list[str] | str, order: list[Column], row_id: str,
               name: str = "is_first", facts: tuple[Column, ...] = ()) -> DataFrame:
    """True on the smallest row of each group by ``order`` then ``row_id``; plus other facts."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*order, F.col(row_id)])])
    last = f"o{len(order)}"
    df = attach(df, keys, F.min(rank)[last].alias("_head_row"), *facts)
    return df.withColumn(name, F.col(row_id) == F.col("_head_row")).drop("_head_row")


def newest_first(ts) -> Column:
    """Sort key that puts later timestamps first."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return -F.unix_micros(c.cast("timestamp"))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """Row number inside ``keys`` by ``order`` (which must be a total order).

    Rows are range partitioned by key and order, stored once so the partitioning is frozen, and
    numbered per partition; only (key, partition) counts are summed up to get the offsets.
    """
    by = [F.col(k) for k in keys] + order
    stored = cut_lineage(
        df.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_pos", 33)), "numbered")
    runs = stored.groupBy(*keys, "_part").agg(
        F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))
    offsets = runs.withColumn("_before", before).drop("_rows")
    return stored.join(offsets, [*keys, "_part"]).withColumn(
        name, F.col("_pos") - F.col("_start") + F.col("_before") + 1) \
        .drop("_pos", "_part", "_start", "_before")


def numbered_overall(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """Row number over the whole input by a total order, without a single-task window."""
    return numbered(df.withColumn("_all", F.lit(0)), ["_all"], order, name).drop("_all")


def running_max(df: DataFrame, keys: list[str], order: list[Column], value: Column,
                name: str) -> DataFrame:
    """Maximum of ``value`` over the earlier rows of the group, range partitioned like numbered."""
    by = [F.col(k) for k in keys] + order
    stored = cut_lineage(
        df.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_pos", 33)).withColumn("_v", value), "running")
    runs = stored.groupBy(*keys, "_part").agg(F.max("_v").alias("_m"))
    carry = runs.withColumn("_carry", F.max("_m").over(
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    local = F.max("_v").over(Window.partitionBy(*keys, "_part").orderBy("_pos")
                             .rowsBetween(Window.unboundedPreceding, -1))
    return stored.withColumn("_local", local).join(carry.drop("_m"), [*keys, "_part"]) \
        .withColumn(name, F.greatest("_local", "_carry")) \
        .drop("_pos", "_part", "_v", "_local", "_carry")


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` up to and including each row, range partitioned like ``numbered``."""
    by = [F.col(k) for k in keys] + order
    stored = cut_lineage(
        df.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_pos", 33)).withColumn("_v", value), "running")
    runs = stored.groupBy(*keys, "_part").agg(F.sum("_v").alias("_m"))
    carry = runs.withColumn("_carry", F.coalesce(F.sum("_m").over(
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.sum("_v").over(Window.partitionBy(*keys, "_part").orderBy("_pos")
                             .rowsBetween(Window.unboundedPreceding, 0))
    return stored.withColumn("_local", local).join(carry.drop("_m"), [*keys, "_part"]) \
        .withColumn(name, F.col("_local") + F.col("_carry")).drop("_pos", "_part", "_v", "_local", "_carry")


def previous(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """The value of the row before, inside ``keys`` by a total order; null on first rows. Values must not be null.

    A segmented scan: rows are range partitioned by key and order, every partition looks back on its own,
    and only one row per key and partition (its last value) is handed on, so that no task holds a key.
    """
    by = [F.col(k) for k in keys] + order
    stored = cut_lineage(
        df.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_pos", 33)), "previous")
    last = stored.groupBy(*keys, "_part").agg(F.max_by(value, "_pos").alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part"))).drop("_last")
    local = F.lag(value).over(Window.partitionBy(*keys, "_part").orderBy("_pos"))
    return stored.withColumn("_local", local).join(carry, [*keys, "_part"]) \
        .withColumn(name, F.coalesce("_local", "_carry")).drop("_pos", "_part", "_local", "_carry")
