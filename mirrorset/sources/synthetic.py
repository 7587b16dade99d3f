"""Seeded synthetic catalogs built from spark.range and integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(seed: int, name: str, low: int, high: int, key: str = "base"):
    """Integer in [low, high] from md5 of seed, name and row key; the same in every engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % (high - low + 1) + low


def generate_catalog(rows: DataFrame, dup_groups: int, group_size: int, seed: int) -> DataFrame:
    """Catalog of ``rows`` (column id), where the first groups are clones of one base file."""
    clone = F.expr(f"id < {dup_groups * group_size}")
    base = F.when(clone, F.expr(f"id div {group_size}")).otherwise(F.col("id") + F.lit(1 << 40))
    d = rows.select(F.col("id").alias("file_id"), base.alias("base"), clone.alias("cloned"))
    return d.select(
        "file_id", F.concat(F.lit("/synthetic/d"), F.col("file_id") % 100, F.lit("/f"), "file_id", F.lit(".mp4")).alias("path"),
        draw(seed, "duration", 5, 3600).cast("double").alias("duration_s"),
        (draw(seed, "size", 5, 250) * 1048576).alias("size"), draw(seed, "width", 640, 3840).alias("width"),
        draw(seed, "height", 360, 2160).alias("height"), draw(seed, "fps", 24, 60).alias("fps"), "cloned")


def generate(spark: SparkSession, n: int, dup_groups: int, group_size: int, seed: int) -> DataFrame:
    return generate_catalog(spark.range(n), dup_groups, group_size, seed)
