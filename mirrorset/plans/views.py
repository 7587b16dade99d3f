"""Views over the plain tables that give every operator its documented input shape.

Only integer arithmetic and md5 are used, so any SQL engine can rebuild the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorset.functions.frames import median_bits
from mirrorset.functions.vectors import quantize_unit

PIXELS = 64
SIDE = 8
DIMS = 64
TOKEN_SPLIT = r"[ \t\n\r\f]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.selectExpr(
        "doc_id AS file_id",
        "concat('/lib/', source, '/', lang, '/f', doc_id, CASE WHEN doc_id % 5 = 0 THEN '.jpg' "
        "WHEN doc_id % 7 = 0 THEN '.MKV' ELSE '.mp4' END) AS path",
        "concat('/lib/', source, '/', lang) AS folder",
        "doc_id % 5 = 0 AS is_image",
        "n_chars * 1000 AS size",
        "CASE WHEN doc_id % 5 = 0 THEN 0D ELSE cast(n_chars div 10 AS double) END AS duration_s",
        "cast(320 + doc_id % 7 * 160 AS int) AS width",
        "cast(240 + doc_id % 6 * 120 AS int) AS height",
        "n_chars * 37 % 9000 * 1000 + doc_id % 1000 AS bit_rate",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id AS int)) AS created",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, "
        "cast(doc_id + doc_id % 48 AS int)) AS modified",
        "cast(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 97 = 0 THEN 2 ELSE 0 END"
        " + CASE WHEN doc_id % 89 = 0 THEN 4 ELSE 0 END + CASE WHEN doc_id % 83 = 0 THEN 8 ELSE 0 END"
        " + CASE WHEN doc_id % 79 = 0 THEN 16 ELSE 0 END + CASE WHEN doc_id % 11 = 0 THEN 32 ELSE 0 END"
        " + CASE WHEN doc_id % 53 = 0 THEN 64 ELSE 0 END + CASE WHEN doc_id % 47 = 0 THEN 128 ELSE 0 END"
        " + CASE WHEN doc_id % 61 = 0 THEN 256 ELSE 0 END + 512 AS int) AS flags",
        "substr(md5(text), 1, 16) AS os_hash",
        "cast(1 AS bigint) AS dev",
        "cast(conv(substr(md5(text), 1, 8), 16, 10) AS bigint) * 2 + doc_id % 2 AS inode")


def blocks(spark: SparkSession, sf_dir: str, source: str = "documents") -> DataFrame:
    """One row per word: (file_id, idx, n, blk) with blk a 32-bit value of the word."""
    key = "doc_id" if source == "documents" else "item_id"
    d = spread(table(spark, sf_dir, source).select(key, "text"))
    words = d.select(F.col(key).alias("file_id"),
                     F.split(F.trim("text"), TOKEN_SPLIT).alias("ws"))
    return words.select("file_id", F.size("ws").alias("n"), F.posexplode("ws").alias("idx", "w")) \
        .selectExpr("file_id", "n", "idx",
                    "cast(conv(substr(md5(w), 1, 8), 16, 10) AS bigint) AS blk")


def _histogram(k: int):
    """bins per word -> k frames of 64 counts scaled to 0..255, one numpy pass per Arrow batch."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.ShortType())))
    def run(bins: pa.Array) -> pa.Array:
        rows = len(bins)
        lengths = np.diff(bins.offsets.to_numpy())
        flat = bins.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(rows), lengths)
        idx = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        slot = row * k + idx * k // np.repeat(lengths, lengths)
        counts = np.bincount(slot * PIXELS + flat, minlength=rows * k * PIXELS)
        counts = counts.reshape(rows * k, PIXELS)
        top = counts.max(axis=1, keepdims=True) if rows else counts
        gray = (counts * 255 // np.maximum(top, 1)).astype(np.int16)
        used = top.ravel() > 0
        inner = pa.ListArray.from_arrays(
            pa.array(np.arange(rows * k + 1, dtype=np.int32) * PIXELS), pa.array(gray.ravel()))
        if not used.all():
            inner = pa.array([v if u else None for v, u in zip(inner.to_pylist(), used)],
                             type=pa.list_(pa.int16()))
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * k), inner)

    return run


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a small input comes as fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def frames_doc(spark: SparkSession, sf_dir: str, k: int = 1) -> DataFrame:
    """64-pixel gray frames and their hashes, k positions per document; no shuffle of words."""
    words = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("doc_id").alias("file_id"), F.split(F.trim("text"), TOKEN_SPLIT).alias("ws"))
    bins = words.select("file_id", F.transform("ws", lambda w: (F.conv(
        F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % PIXELS).cast("int")).alias("bins"))
    return bins.select("file_id", F.posexplode(_histogram(k)("bins")).alias("pos_idx", "gray")) \
        .where("gray IS NOT NULL").withColumn("phash", median_bits("gray"))


def pack_frames(frames: DataFrame) -> DataFrame:
    """One row per file: frames in position order, pixels concatenated. At most k rows a file."""
    packed = frames.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("pos_idx", "gray", "phash"))).alias("fs"))
    return packed.select(
        "file_id", F.size("fs").alias("n_frames"),
        F.flatten(F.col("fs.gray")).alias("gray"), F.col("fs.phash").alias("phashes"))


def features_doc(spark: SparkSession, sf_dir: str, k: int = 1) -> DataFrame:
    """Catalog columns used in matching, with the packed frames of complete files."""
    packed = pack_frames(frames_doc(spark, sf_dir, k)).where(F.col("n_frames") == k)
    base = catalog(spark, sf_dir).select(
        "file_id", "is_image", "duration_s", "folder", "size", "dev", "inode", "path")
    return base.join(packed.drop("n_frames"), "file_id")


def frames_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted near-copies: three noisy versions of each vector's frame."""
    e = spread(table(spark, sf_dir, "embeddings")).select("vec_id", "embedding", F.explode(
        F.sequence(F.lit(0), F.lit(2))).alias("copy"))
    base = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(
        F.lit(255), F.floor(x.cast("double") * 256).cast("int") + 128)))
    noisy = F.transform(base, lambda g, i: F.when(F.col("copy") == 0, g).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(255), g + (
            (F.col("vec_id") * 7 + i * 13 + F.col("copy") * 3) % 5 - 2).cast("int")))))
    return e.select(
        (F.col("vec_id") * 3 + F.col("copy")).alias("file_id"), "vec_id", "copy",
        (60 + F.col("vec_id") % 50 * 20).cast("double").alias("duration_s"),
        F.transform(noisy, lambda x: x.cast("smallint")).alias("gray")) \
        .withColumn("phash", median_bits("gray"))


def features_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames_vec(spark, sf_dir)
    return f.select(
        "file_id", F.lit(False).alias("is_image"), "duration_s",
        F.concat(F.lit("/vec/"), F.col("vec_id") % 10).alias("folder"),
        (F.col("vec_id") * 1000 + F.col("copy")).alias("size"),
        F.lit(1).cast("bigint").alias("dev"), F.col("file_id").alias("inode"),
        F.concat(F.lit("/vec/"), F.col("vec_id") % 10, F.lit("/v"), F.col("file_id"),
                 F.lit(".mp4")).alias("path"),
        "gray", F.array("phash").alias("phashes"))


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Int8 embeddings of the planted copies; a copy moves some components by one step."""
    e = spread(table(spark, sf_dir, "embeddings")).select("vec_id", F.explode(
        F.sequence(F.lit(0), F.lit(2))).alias("copy"), quantize_unit("embedding").alias("q0"))
    moved = F.transform("q0", lambda x, i: F.when(F.col("copy") == 0, x.cast("int")).otherwise(
        F.greatest(F.lit(-127), F.least(F.lit(127), x + (
            (F.col("vec_id") * 5 + i * 11 + F.col("copy")) % 3 - 1).cast("int")))))
    return e.select((F.col("vec_id") * 3 + F.col("copy")).alias("file_id"), "vec_id", "copy",
                    (60 + F.col("vec_id") % 50 * 20).cast("double").alias("duration_s"),
                    F.transform(moved, lambda x: x.cast("tinyint")).alias("q"))


def fingerprints(spark: SparkSession, sf_dir: str, source: str = "documents") -> DataFrame:
    """(file_id, n, fp): one 32-bit block per word; a document is one source, so bounded."""
    key = "doc_id" if source == "documents" else "item_id"
    words = spread(table(spark, sf_dir, source).select(key, "text")).select(
        F.col(key).alias("file_id"), F.split(F.trim("text"), TOKEN_SPLIT).alias("ws"))
    return words.select("file_id", F.size("ws").alias("n"), F.transform(
        "ws", lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint")).alias("fp"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows: one group per order, one item per order line."""
    return spread(table(spark, sf_dir, "lineitem")).selectExpr(
        "l_orderkey AS group_id",
        "(l_partkey * 10000000 + l_suppkey * 10 + l_linenumber) * 5000 "
        "+ unix_date(cast(l_shipdate AS date)) % 5000 AS item_id",
        "concat('/lib/s', l_suppkey % 50, '/o', l_orderkey, '_', l_partkey, '_', l_suppkey, '_', "
        "l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN '.png' ELSE '.mp4' END) AS path",
        "concat('/lib/s', l_suppkey % 50) AS folder",
        "l_orderkey % 5 = 0 AS is_image",
        "cast(round(l_extendedprice * 100) AS bigint) AS size",
        "CASE WHEN l_orderkey % 5 = 0 THEN 0D ELSE l_quantity * 60 + l_linenumber END AS duration_s",
        "concat(320 * (1 + l_partkey % 6), 'x', 180 * (1 + l_partkey % 6)) AS frame_size",
        "cast(500 * (1 + l_partkey % 6) AS int) AS frame_size_int",
        "CASE l_suppkey % 3 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' ELSE 'av1' END AS format",
        "CASE l_partkey % 11 WHEN 0 THEN 'HDR10' WHEN 1 THEN 'HLG' WHEN 2 THEN 'Dolby Vision' "
        "WHEN 3 THEN 'HDR10+' ELSE '' END AS hdr_format",
        "CASE WHEN l_orderkey % 5 = 0 THEN 0D ELSE cast(24 + 6 * (l_suppkey % 4) AS double) END AS fps",
        "CASE WHEN l_orderkey % 5 = 0 THEN 0L ELSE l_partkey * 7 % 9000 + 100 END AS bitrate_kbs",
        "CASE WHEN l_suppkey % 2 = 0 THEN 'aac' ELSE 'ac3' END AS audio_format",
        "CASE WHEN l_suppkey % 2 = 0 THEN 'stereo' ELSE '5.1' END AS audio_channel",
        "cast(CASE WHEN l_suppkey % 3 = 0 THEN 44100 ELSE 48000 END AS int) AS audio_sample_rate",
        "64 * (1 + l_suppkey % 5) AS audio_bitrate_kbs",
        "(90000 + cast(round(l_discount * 100) AS bigint) * 1000 "
        "- cast(round(l_tax * 100) AS bigint) * 37) / 1000D AS similarity",
        "cast(l_shipdate AS timestamp_ntz) - make_dt_interval(l_linenumber) AS created",
        "CASE WHEN l_suppkey % 29 = 0 THEN NULL ELSE cast(l_shipdate AS timestamp_ntz) END AS modified",
        "cast(CASE WHEN l_suppkey % 13 = 0 THEN 2 ELSE 0 END + CASE WHEN l_suppkey % 17 = 0 THEN 4 ELSE 0 END"
        " + CASE WHEN l_partkey % 4 = 0 THEN 8 ELSE 0 END + CASE WHEN l_partkey % 6 = 0 THEN 16 ELSE 0 END"
        " AS int) AS flags",
        "CASE WHEN l_suppkey % 13 = 0 THEN l_linenumber * 15D ELSE 0D END AS offset_s",
        "false AS is_reference",
        "l_returnflag = 'R' AS checked",
        "l_partkey % 10 <> 0 AS present",
        "l_suppkey % 7 <> 0 AS root_ready",
        "l_suppkey % 31 AS dev", "l_partkey % 40 AS inode")
