"""Streaming catalog refresh and matching of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from mirrorset.config import MatchConfig
from mirrorset.operators import blocking as B
from mirrorset.operators.maintenance import refresh_catalog
from mirrorset.operators.matching import find_edges, match_against, prepare
from mirrorset.runtime import scratch_scope
from mirrorset.streaming.sinks import run_available, write_batch


def latest_changes(spark: SparkSession, root: str, schema) -> DataFrame:
    """Newest change per path over all batches."""
    rows = spark.read.schema(schema).parquet(root)
    fields = [c for c in rows.columns if c not in ("path", "batch_id")]
    return rows.groupBy("path").agg(F.max_by(F.struct(*fields), "batch_id").alias("r")) \
        .select("path", *[F.col(f"r.{c}").alias(c) for c in fields])


def stream_catalog(listing: DataFrame, catalog: DataFrame, changes_root: str, checkpoint: str) -> None:
    """Refresh a stored catalog from a stream of listing rows.

    Each batch is compared with the catalog and only the touched paths are written, as one
    change folder per batch; a retried batch overwrites its own folder. The current catalog is
    the stored one overlaid with :func:`latest_changes`. Of several rows of a path in one batch the one
    modified last counts (the larger one on ties).
    """
    fields = [c for c in listing.columns if c != "path"]
    order = [c for c in ("modified", "size") if c in fields] + [c for c in fields if c not in ("modified", "size")]

    def handle(batch: DataFrame, batch_id: int) -> None:
        touched = batch.groupBy("path").agg(F.max(F.struct(*order)).alias("r")).select(
            *[F.col("path") if c == "path" else F.col(f"r.{c}").alias(c) for c in batch.columns])
        old = catalog.join(touched.select("path"), "path", "left_semi")
        write_batch(refresh_catalog(old, touched), batch_id, changes_root)

    run_available(listing, checkpoint, handle)


#: Partitions that arrivals are stored in.
BUCKETS = 1024


def with_buckets(prepared: DataFrame, cfg: MatchConfig, k: int, side: int, near: bool) -> DataFrame:
    """Adds ``bucket``, a hash of the candidate cell; with ``near`` one row per bucket a match may lie in.

    The cell has type and duration bin, and the brightness cell where only unmasked gray comparison decides (mirrored
    frames have the same brightness). Pairs that match lie at most one step apart on both axes.
    """
    only_gray = not (cfg.use_ai or cfg.ignore_black or cfg.ignore_white)
    hashed = cfg.use_phash or cfg.combine_gray_and_phash
    bright = F.floor(sum(F.col(c) for c in B.SUMS) / (cfg.gray_limit(side * side, k) + 1)).cast("bigint")
    usable = F.lit(only_gray) & (F.col("is_image") | F.lit(not hashed))
    cells = B.base_cells(prepared, cfg, folder_key=False).withColumn("_bright", F.when(usable, bright).otherwise(F.lit(0).cast("bigint")))
    if near:
        cells = B.widen_duration(cells, cfg).withColumn("_bright", F.explode(F.when(usable, B.near(F.col("_bright"))).otherwise(F.array("_bright"))))
    bucket = F.pmod(F.xxhash64("is_image", "_dur", "_bright"), F.lit(BUCKETS)).cast("int")
    return cells.withColumn("bucket", bucket).drop("_dur", "_folder", "_bright")


def arrivals_near(spark: SparkSession, arrived: str, own: DataFrame, cfg: MatchConfig, k: int, side: int) -> DataFrame:
    """Earlier arrivals in the buckets that ``own`` rows can match; only these partitions are read."""
    wanted = [r["bucket"] for r in with_buckets(own, cfg, k, side, near=True).select("bucket").distinct().collect()]
    schema = StructType([*own.schema.fields, StructField("batch_id", IntegerType()), StructField("bucket", IntegerType())])
    rows = spark.read.schema(schema).option("basePath", arrived).parquet(arrived)
    return rows.where(F.col("bucket").isin(wanted or [-1]))


def stream_match(new_features: DataFrame, stored: DataFrame, cfg: MatchConfig, k: int, side: int,
                 out_root: str, checkpoint: str, emb: DataFrame | None = None, frame_hash=None) -> None:
    """Compare arriving files with the stored catalog (tombstones included) and with all earlier arrivals.

    The stored side is prepared once; a batch only adds its own prepared rows, next to its matches. Arrivals
    are stored by candidate cell, and a batch reads the partitions its own rows can match, no others. Pairs
    inside a batch are given with the later id as new_id. A retried batch overwrites its own folders.
    """
    ready = prepare(stored, cfg, side, emb)
    arrived = f"{out_root}-arrived"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fields = [c for c in batch.columns if c != "file_id"]
        new = batch.groupBy("file_id").agg(F.max(F.struct(*fields)).alias("r")).select("file_id", "r.*").select(*batch.columns)
        with scratch_scope():
            own = prepare(new, cfg, side, emb)
            rows = match_against(new, ready, cfg, k, side, emb, frame_hash, stored_ready=True)
            if batch_id > 0:
                earlier = arrivals_near(spark, arrived, own, cfg, k, side).where(F.col("batch_id") < batch_id).drop("batch_id", "bucket")
                rows = rows.unionByName(match_against(new, earlier, cfg, k, side, emb, frame_hash, stored_ready=True))
            inside = find_edges(new, cfg, k, side, emb, frame_hash).select(
                F.col("dst").alias("new_id"), F.col("src").alias("stored_id"), "difference", "flags")
            write_batch(rows.unionByName(inside), batch_id, out_root)
            by_cell = with_buckets(own, cfg, k, side, near=False)
            by_cell.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{arrived}/batch_id={batch_id}")

    run_available(new_features, checkpoint, handle)
