"""Incremental catalog maintenance as joins between the stored catalog and a new listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorset.functions import paths
from mirrorset.functions.bits import any_flag, clear_flag, has_flag, set_flag
from mirrorset.operators.catalog import ancestors
from mirrorset.schema import CONTENT_FLAGS, FILE_FLAGS

IDENTITY_COLUMNS = ("size", "created", "modified", "os_hash")


def refresh_catalog(old: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, outcome, size, created, modified, keep_features) for every known or listed path.

    new: unknown path. reset: size changed, or times changed without proof of equal content.
    redated: times changed but the content hash is equal. kept: nothing changed. missing: the
    stored path is not in the listing; its row stays as it is.
    """
    o = old.select("path", *[F.col(c).alias(f"o_{c}") for c in IDENTITY_COLUMNS], F.lit(True).alias("_old"))
    n = listing.select("path", *[F.col(c).alias(f"n_{c}") for c in IDENTITY_COLUMNS], F.lit(True).alias("_new"))
    j = o.join(n, "path", "full")
    retimed = ~(F.col("o_created").eqNullSafe(F.col("n_created"))
                & F.col("o_modified").eqNullSafe(F.col("n_modified")))
    same_hash = F.coalesce(F.col("o_os_hash") == F.col("n_os_hash"), F.lit(False))
    outcome = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "missing") \
        .when(F.col("o_size") != F.col("n_size"), "reset").when(retimed & same_hash, "redated") \
        .when(retimed, "reset").otherwise("kept")
    j = j.withColumn("outcome", outcome)
    take = lambda c: F.coalesce(f"n_{c}", f"o_{c}").alias(c)
    return j.select("path", "outcome", take("size"), take("created"), take("modified"),
                    F.col("outcome").isin("redated", "kept", "missing").alias("keep_features"))


def apply_refresh(old: DataFrame, listing: DataFrame) -> DataFrame:
    """The new catalog: unchanged rows keep features, reset rows start over, new rows join."""
    plan = refresh_catalog(old, listing)
    feature_columns = [c for c in old.columns if c not in ("path", "size", "created", "modified")]
    fresh = listing.select("path", *[F.col(c).alias(f"_f_{c}") for c in feature_columns if c in listing.columns])
    j = plan.join(old.select("path", *feature_columns), "path", "left").join(fresh, "path", "left")
    keep = F.col("keep_features")
    cols = [F.when(keep, F.col(c)).otherwise(
        F.col(f"_f_{c}") if c in listing.columns else F.lit(None)).alias(c) for c in feature_columns]
    return j.select("path", "size", "created", "modified", *cols).select(*old.columns)


def relink_moved(old: DataFrame, listing: DataFrame) -> DataFrame:
    """(old_path, new_path): unknown files that are the moved form of exactly one vanished file.

    Matches need equal size and content hash and must be one-to-one; all else counts as new.
    """
    gone = old.where("os_hash IS NOT NULL").join(listing.select("path"), "path", "left_anti") \
        .groupBy("size", "os_hash").agg(F.count(F.lit(1)).alias("_g"), F.min("path").alias("old_path"))
    new = listing.where("os_hash IS NOT NULL").join(old.select("path"), "path", "left_anti") \
        .groupBy("size", "os_hash").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("new_path"))
    return gone.join(new, ["size", "os_hash"]).where("_g = 1 AND _n = 1").select("old_path", "new_path")


def relocate_by_prefix(df: DataFrame, old_prefix: str, new_prefix: str) -> DataFrame:
    moved = paths.relocate("path", old_prefix, new_prefix)
    return df.withColumn("path", moved).withColumn("folder", paths.parent("path"))


def relocate_by_rescan(missing: DataFrame, found: DataFrame, use_modified: bool = True,
                       use_duration: bool = True) -> DataFrame:
    """(path, new_path, confidence) for missing catalog rows against files on disk.

    The only file of the same size wins; several are narrowed by modification time (2 s) and
    duration (0.5 s).
    """
    per_size = found.groupBy("size").agg(F.count(F.lit(1)).alias("same_size"), F.min("path").alias("only_path"))
    base = missing.select("path", "size", "modified", "duration_s").join(per_size, "size", "left")
    single = base.where("same_size = 1").select("path", F.col("only_path").alias("new_path"),
                                                F.lit("SizeOnly").alias("confidence"))
    none = base.where("same_size IS NULL").select("path", F.lit(None).cast("string").alias("new_path"),
                                                  F.lit("NotFound").alias("confidence"))
    many = base.where("same_size > 1").select("path", "size", "modified", "duration_s")
    # Only distinct (size, time, duration) values meet in the join, so a crowd of equal files is
    # one row per side. Two-second and half-second cells turn the tolerances into equi-joins.
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    used = [c for c, on in (("modified", use_modified), ("duration_s", use_duration)) if on]
    m = many.select("size", *used).distinct()
    f = found.groupBy("size", *[F.col(c).alias(f"f_{c}") for c in used]).agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("new_path"))
    keys, close = ["size"], F.lit(True)
    if use_modified:
        cell = lambda c: F.floor(micros(c) / 2_000_000)
        m = m.withColumn("_t", F.explode(F.sequence(cell("modified") - 1, cell("modified") + 1)))
        f, keys = f.withColumn("_t", cell("f_modified")), [*keys, "_t"]
        close = close & (F.abs(micros("modified") - micros("f_modified")) <= 2_000_000)
    if use_duration:
        half = lambda c: F.floor(F.col(c) / 0.5)
        m = m.withColumn("_d", F.explode(F.sequence(half("duration_s") - 2, half("duration_s") + 2)))
        f, keys = f.withColumn("_d", half("f_duration_s")), [*keys, "_d"]
        close = close & (F.abs(F.col("f_duration_s") - F.round("duration_s", 2)) <= 0.5)
    counted = m.join(f, keys).where(close).groupBy("size", *used).agg(
        F.sum("n").alias("n"), F.min("new_path").alias("new_path"))
    label = "SizeModifiedDuration" if use_duration else "SizeAndModified" if use_modified else "SizeOnly"
    refined = many.join(counted, ["size", *used], "left").select(
        "path", F.when(F.col("n") == 1, F.col("new_path")).alias("new_path"),
        F.when(F.col("n") == 1, label).when(F.col("n") > 1, "Ambiguous").otherwise("NotFound").alias("confidence"))
    return single.unionByName(none).unionByName(refined)


def mount_of(df: DataFrame, mounts: DataFrame) -> DataFrame:
    """Adds root and ready of the longest mount root above each path; null when none covers it."""
    levels = df.select("path", F.explode(ancestors("folder")).alias("root"))
    best = levels.join(mounts, "root").groupBy("path").agg(
        F.max(F.struct(F.length("root").alias("n"), "root", "ready")).alias("m")) \
        .select("path", F.col("m.root").alias("root"), F.col("m.ready").alias("ready"))
    return df.join(best, "path", "left")


def path_status(df: DataFrame, present: DataFrame, mounts: DataFrame) -> DataFrame:
    """Adds ``status``: present, tombstone (gone from a mounted drive) or offline."""
    known = mount_of(df, mounts).join(present.select("path", F.lit(True).alias("_here")), "path", "left")
    return known.withColumn("status", F.when(F.col("_here"), "present").when(
        F.coalesce("ready", F.lit(False)), "tombstone").otherwise("offline")).drop("_here", "root", "ready")


def _failed() -> Column:
    return any_flag("flags", FILE_FLAGS["metadata_error"] | FILE_FLAGS["thumbnail_error"])


def cleanup(df: DataFrame, present: DataFrame, mounts: DataFrame, remember_deleted: bool) -> DataFrame:
    """Drop failed and missing rows; in memory mode missing ones go only as ghosts.

    ``has_data`` says whether a row still holds a frame or fingerprint to compare with.
    """
    if not remember_deleted:
        return df.where(~_failed()).join(present.select("path"), "path", "left_semi")
    keep = path_status(df.where(~_failed()), present, mounts)
    return keep.where(~((F.col("status") == "tombstone") & ~F.col("has_data"))).drop("status")


def ghosts(df: DataFrame, present: DataFrame, mounts: DataFrame) -> DataFrame:
    """Rows that can never match again: gone from a mounted drive without comparable data."""
    return path_status(df, present, mounts).where("status = 'tombstone' AND NOT has_data").drop("status")


def apply_quarantine(df: DataFrame, suspects: DataFrame) -> DataFrame:
    """Flag the files that were in flight when a session died. suspects: seq, line 'phase|path'."""
    phase = F.substring_index("line", "|", 1)
    path = F.expr("substring(line, instr(line, '|') + 1)")
    ok = (F.length(phase) > 0) & (F.length(path) > 0) & F.contains("line", F.lit("|"))
    first = suspects.where(ok).select("seq", phase.alias("phase"), path.alias("path")).groupBy("path").agg(
        F.min_by("phase", "seq").alias("phase"))
    f = FILE_FLAGS
    return df.join(first, "path", "left").withColumn("flags", F.when(
        F.col("phase") == "audio", set_flag("flags", f["audio_fingerprint_error"])).when(
        F.col("phase").isNotNull(), set_flag("flags", f["thumbnail_error"])).otherwise(F.col("flags"))).drop("phase")


def heal_fingerprints(df: DataFrame) -> DataFrame:
    """Clear audio errors once; an unexplained empty fingerprint becomes 'not extracted'."""
    f = FILE_FLAGS
    bad = has_flag("flags", f["audio_fingerprint_error"])
    explained = any_flag("flags", f["no_audio_track"] | f["silent_audio_track"])
    return df.withColumn("fp", F.when(bad & (F.size("fp") == 0) & ~explained, F.lit(None)).otherwise(F.col("fp"))) \
        .withColumn("flags", F.when(bad, clear_flag("flags", f["audio_fingerprint_error"])).otherwise(F.col("flags")))


def migrate_image_hashes(df: DataFrame, stored_version: int, current: int = 1) -> DataFrame:
    """Images hashed by an older pipeline lose frames, hashes and the dark flag."""
    if stored_version >= current:
        return df
    image = F.col("is_image")
    out = df.withColumn("flags", F.when(image, clear_flag("flags", FILE_FLAGS["too_dark"])).otherwise(F.col("flags")))
    for c in ("gray", "phash", "phashes"):
        if c in df.columns:
            out = out.withColumn(c, F.when(~image, F.col(c)))
    return out


def clear_cached_media(df: DataFrame) -> DataFrame:
    """Forget everything derived from content; identity columns and user flags stay."""
    out = df.withColumn("flags", clear_flag("flags", CONTENT_FLAGS))
    for c in ("streams", "duration_s", "gray", "phash", "phashes", "fp"):
        if c in df.columns:
            out = out.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
    return out


def exclude_files(df: DataFrame, chosen: DataFrame) -> DataFrame:
    mark = df.join(chosen.select("path", F.lit(True).alias("_x")).distinct(), "path", "left")
    return mark.withColumn("flags", F.when(F.col("_x"), set_flag(
        "flags", FILE_FLAGS["manually_excluded"])).otherwise(F.col("flags"))).drop("_x")


def update_paths(df: DataFrame, moves: DataFrame) -> DataFrame:
    """moves: path, new_path (unique per path)."""
    m = df.join(moves.select("path", "new_path"), "path", "left")
    return m.withColumn("path", F.coalesce("new_path", "path")).drop("new_path") \
        .withColumn("folder", paths.parent("path"))


def remove_paths(df: DataFrame, chosen: DataFrame) -> DataFrame:
    return df.join(chosen.select("path"), "path", "left_anti")


def drive_partition(df: DataFrame, mounts: DataFrame, done: Column, in_scope: Column) -> DataFrame:
    """Per drive: total and finished files and bytes of the rows in scope."""
    placed = mount_of(df.where(in_scope), mounts)
    return placed.groupBy(F.coalesce("root", F.lit("/")).alias("root")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
        F.count_if(done).alias("done_files"), F.sum(F.when(done, F.col("size")).otherwise(0)).alias("done_bytes"))


def valid_cache(cache: DataFrame, catalog: DataFrame) -> DataFrame:
    """Cache records whose file still has the recorded size and modification time."""
    return cache.join(catalog.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_semi")


def prune_cache(cache: DataFrame, catalog: DataFrame) -> DataFrame:
    """Drop records only for paths the whole catalog no longer knows."""
    return cache.join(catalog.select("path").distinct(), "path", "left_semi")
