"""Complete flows: from features to ranked duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorset.config import MatchConfig
from mirrorset.operators import graph, matching, projection, ranking
from mirrorset.operators import blocking as B
from mirrorset.plans import views as V
from mirrorset.runtime import cut_lineage, enable_skew_handling


def visual_verdict(features: DataFrame, cfg: MatchConfig, k: int, pixels: int, emb: DataFrame | None = None):
    """Ungated verdict over (…, src, dst) rows: classic, or AI where that is on."""

    def run(pairs: DataFrame) -> DataFrame:
        wide = B.with_pair_columns(pairs, features, features, ["gray", "phashes", "is_image"])
        seen = matching.classic_verdict(wide, cfg, k, pixels).where("difference IS NOT NULL").select(*pairs.columns)
        if not cfg.use_ai or emb is None:
            return seen
        ai = matching.ai_similarity(pairs, emb, k).where(F.col("ai_sim") >= cfg.ai_threshold)
        return seen.unionByName(pairs.join(ai.select("src", "dst"), ["src", "dst"], "left_semi")).distinct()

    return run


def duplicate_groups(features: DataFrame, cfg: MatchConfig, k: int = 1, side: int = 32,
                     emb: DataFrame | None = None, frame_hash=None) -> DataFrame:
    """(group_id, file_id, difference, flags): match, merge under the representative check, prune.

    Features are made once; only those of files that have an edge go on after the matching step.
    """
    features = cut_lineage(features, "all-features")
    edges = cut_lineage(matching.find_edges(features, cfg, k, side, emb, frame_hash), "edges")
    touched = edges.select(F.col("src").alias("file_id")).unionByName(edges.select(F.col("dst").alias("file_id"))).distinct()
    stored = cut_lineage(features.join(touched, "file_id", "left_semi"), "features")
    verdict = visual_verdict(stored, cfg, k, side * side, emb)
    merged = cut_lineage(graph.merge_groups(edges, verdict), "merged")
    pairs = cut_lineage(matching.group_links(stored, merged, cfg, k, side, emb), "verdicts")
    pruned = graph.majority_prune(merged.select("file_id", "group_id"), pairs)
    rows = graph.founding_rows(merged, edges).select("file_id", "difference", "flags")
    return pruned.select("group_id", "file_id").join(rows, "file_id")


def duplicate_items(groups: DataFrame, catalog: DataFrame) -> DataFrame:
    """Result rows of groups: catalog columns, similarity and the eight best flags."""
    similarity = (1 - F.col("difference")) * 100
    rows = groups.join(catalog.drop("flags"), "file_id").withColumn("similarity", similarity) \
        .withColumn("item_id", F.col("file_id"))
    return ranking.highlight_best(rows)


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-equal documents as result items."""
    catalog = V.catalog(spark, sf_dir).withColumn("fps", F.lit(25.0)).withColumn("hdr_format", F.lit("")) \
        .withColumn("bitrate_kbs", F.bround(F.col("bit_rate") / 1000).cast("bigint")) \
        .withColumn("audio_sample_rate", F.lit(48000)).withColumn("audio_bitrate_kbs", F.lit(128).cast("bigint")) \
        .withColumn("frame_size_int", F.col("width") + F.col("height")) \
        .withColumn("is_reference", F.lit(False))
    edges = cut_lineage(matching.find_edges(V.features_doc(spark, sf_dir, 1), MatchConfig(), 1, V.SIDE, forest=True), "edges")
    groups = graph.components(edges)
    ends = edges.select(F.col("dst").alias("file_id"), "difference").unionByName(
        edges.select(F.col("src").alias("file_id"), "difference"))
    best = ends.groupBy("file_id").agg(F.min("difference").alias("difference"))
    rows = groups.join(best, "file_id", "left").select(
        "group_id", "file_id", F.coalesce("difference", F.lit(0.0)).alias("difference"), F.lit(0).alias("flags"))
    return duplicate_items(rows.drop("flags"), catalog).withColumn("flags", F.lit(0))


def top_duplicate_groups(spark: SparkSession, sf_dir: str, limit: int = 100) -> DataFrame:
    """Flagship report: the duplicate groups that free the most space, with their best members."""
    enable_skew_handling(spark)
    items = cut_lineage(doc_items(spark, sf_dir), "items")
    view = projection.group_view(items)
    best = items.groupBy("group_id").agg(F.min(F.when(F.col("is_best_frame"), F.col("path"))).alias("sharpest"),
                                         F.min(F.when(F.col("is_best_size"), F.col("path"))).alias("smallest"))
    return view.join(best, "group_id").select(
        "group_id", "files", F.round("min_similarity", 4).alias("min_similarity"),
        F.round("max_similarity", 4).alias("max_similarity"), "total_size", "savings", "sharpest", "smallest") \
        .orderBy(F.col("savings").desc(), F.col("group_id")).limit(limit)
