"""Catalog projections and filters: eligibility, scopes, streams, flags, folder counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorset.config import MatchConfig
from mirrorset.functions import media, paths
from mirrorset.functions.bits import any_flag, col, has_flag
from mirrorset.operators.grouping import numbered
from mirrorset.schema import EDITOR_ERRORS, EDITOR_FLAGS, FILE_FLAGS, FRAME_SIDE

# --- fixed values: exclusion reasons in the order they are tested -------------------------
REASONS = (
    "image files are disabled",
    "path is in the excluded directories list",
    "path is not in the included directories list",
    "file has been manually excluded",
    "file is marked as too dark",
    "file does not exist",
    "path is not valid UTF-8",
    "file size is outside the configured range",
    "file path does not match the required patterns",
    "file is a reparse point",
    "file path matches an excluded pattern",
)
# -----------------------------------------------------------------------------------------


def size_between_mb(size, low: int | None, high: int | None) -> Column:
    mb, ok = media.megabytes(size), F.lit(True)
    if low is not None:
        ok = ok & (mb >= low)
    if high is not None:
        ok = ok & (mb <= high)
    return ok


def matches_any(path, patterns) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | paths.wildcard_match(path, p)
    return hit


def eligibility(df: DataFrame, cfg: MatchConfig, present: Column | None = None) -> DataFrame:
    """Adds ``excluded_reason``: the first reason that applies, null for eligible files."""
    never = F.lit(False)
    tests = [
        F.col("is_image") if not cfg.include_images else never,
        paths.is_blacklisted("folder", cfg.exclude),
        never if cfg.scan_against_all else ~paths.in_scope("folder", cfg.include, cfg.include_subdirectories),
        has_flag("flags", FILE_FLAGS["manually_excluded"]),
        has_flag("flags", FILE_FLAGS["too_dark"]),
        never if cfg.include_missing or present is None else ~present,
        ~F.is_valid_utf8("path"),
        ~size_between_mb("size", cfg.min_size_mb, cfg.max_size_mb),
        ~matches_any("path", cfg.path_contains) if cfg.path_contains else never,
        has_flag("flags", FILE_FLAGS["reparse_point"]) if cfg.ignore_reparse_points else never,
        matches_any("path", cfg.path_not_contains),
    ]
    return df.withColumn("excluded_reason", F.coalesce(
        *[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS)], F.lit(None).cast("string")))


def exclusion_summary(df: DataFrame) -> DataFrame:
    return df.where("excluded_reason IS NOT NULL").groupBy("excluded_reason").agg(
        F.count(F.lit(1)).alias("files"))


def exclusion_samples(df: DataFrame, k: int = 5) -> DataFrame:
    """At most k logged examples per reason, as a log report shows them."""
    rows = numbered(df.where("excluded_reason IS NOT NULL").select("excluded_reason", "file_id", "path"),
                    ["excluded_reason"], [F.col("file_id")])
    return rows.where(F.col("rn") <= k)


def comparable(catalog: DataFrame, frames: DataFrame, positions: int) -> DataFrame:
    """Files that can be compared: no frame error, a usable frame at every needed position."""
    need = F.when(F.col("is_image"), 1).otherwise(positions)
    usable = frames.where(F.col("gray").isNotNull()).groupBy("file_id").agg(F.count_if(
        F.size("gray") == F.col("pixels")).alias("usable"))
    return catalog.where(~any_flag("flags", FILE_FLAGS["thumbnail_error"])
                         & (F.col("is_image") | (F.col("duration_s") > 0))) \
        .join(usable, "file_id").where(F.col("usable") >= need).drop("usable")


def heal_legacy_frames(frames: DataFrame, pixels: int = FRAME_SIDE * FRAME_SIDE) -> tuple[DataFrame, DataFrame]:
    """(kept frames, discarded count per file): frames of another size lose pixels and hash."""
    wrong = F.col("gray").isNotNull() & (F.size("gray") != pixels)
    return frames.where(~wrong), frames.where(wrong).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("discarded"))


def sample_positions(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i / F.lit(n + 1))


def frame_seconds(duration, position, max_sampling_s: float = 0.0) -> Column:
    d = col(duration)
    return (F.least(d, F.lit(max_sampling_s)) if max_sampling_s > 0 else d) * col(position)


def needs_audio_fingerprint(flags, is_image, fp, enabled: bool = True, retry: bool = False) -> Column:
    f = FILE_FLAGS
    blocked = f["no_audio_track"] | f["silent_audio_track"] | (0 if retry else f["audio_fingerprint_error"])
    return F.lit(enabled) & ~col(is_image) & ~any_flag(flags, blocked) & col(fp).isNull()


def select_streams(df: DataFrame) -> DataFrame:
    """Item columns from the largest video and most-channel audio stream, first index on ties."""
    video = F.filter("streams", lambda s: F.lower(s["codec_type"]) == "video")
    audio = F.filter("streams", lambda s: F.lower(s["codec_type"]) == "audio")
    best_v = F.array_min(F.transform(video, lambda s: F.struct(
        (-(s["width"] * s["height"])).alias("rank"), s["index"].alias("index"), s.alias("s"))))["s"]
    best_a = F.array_min(F.transform(audio, lambda s: F.struct(
        (-s["channels"]).alias("rank"), s["index"].alias("index"), s.alias("s"))))["s"]
    d = df.withColumn("_v", best_v).withColumn("_a", best_a).withColumn("_i", F.get("streams", F.lit(0)))
    v = F.when(F.col("is_image"), F.col("_i")).otherwise(F.col("_v"))
    kbs = lambda c: F.coalesce(F.bround(c.cast("decimal(20,0)") / 1000, 0).cast("bigint"), F.lit(0))
    film = lambda c: F.when(~F.col("is_image"), c)
    return d.select(
        *df.columns,
        F.when(F.col("is_image"), paths.extension("path")).otherwise(F.when(
            F.col("_v").isNotNull(), F.coalesce(F.col("_v.codec_name"), F.lit("<Unknown>")))).alias("format"),
        F.concat(v["width"].cast("string"), F.lit("x"), v["height"].cast("string")).alias("frame_size"),
        F.coalesce(v["width"] + v["height"], F.lit(0)).alias("frame_size_int"),
        F.coalesce(film(F.col("_v.frame_rate").cast("double")), F.lit(0.0)).alias("fps"),
        F.coalesce(film(kbs(F.col("_v.bit_rate"))), F.lit(0)).alias("bitrate_kbs"),
        F.coalesce(film(F.col("_v.hdr_format")), F.lit("")).alias("hdr_format"),
        film(F.when(F.col("_a").isNotNull(), F.coalesce(F.col("_a.codec_name"), F.lit("<Unknown>"))))
        .alias("audio_format"),
        film(F.when(F.col("_a").isNotNull(), F.coalesce(F.col("_a.channel_layout"), F.lit("<Unknown>"))))
        .alias("audio_channel"),
        F.coalesce(film(F.col("_a.sample_rate")), F.lit(0)).alias("audio_sample_rate"),
        F.coalesce(film(kbs(F.col("_a.bit_rate"))), F.lit(0)).alias("audio_bitrate_kbs"))


def catalog_filter(df: DataFrame, file_type: str = "all", errors_only: bool = False,
                   flag: str | None = None, search: str = "") -> DataFrame:
    image, keep = has_flag("flags", FILE_FLAGS["is_image"]), F.lit(True)
    if file_type != "all":
        keep = image if file_type == "images" else ~image
    if errors_only:
        keep = keep & any_flag("flags", EDITOR_ERRORS)
    if flag:
        keep = keep & any_flag("flags", FILE_FLAGS[flag])
    if search:
        keep = keep & F.contains(F.lower("path"), F.lit(search.lower()))
    return df.where(keep)


def catalog_order(mode: str = "path", flag_first: str | None = None) -> list[Column]:
    """Path ascending or the largest/newest/longest first, path (case-blind) as tie-break."""
    main = {"size": "size", "created": "created", "duration": "duration_s", "bitrate": "bit_rate"}.get(mode)
    order = [any_flag("flags", FILE_FLAGS[flag_first]).desc()] if flag_first else []
    if main:
        order.append(F.col(main).desc_nulls_last())
    return [*order, F.lower("path").asc(), F.col("path").asc()]


def catalog_sort(df: DataFrame, mode: str = "path", flag_first: str | None = None) -> DataFrame:
    return df.orderBy(*catalog_order(mode, flag_first))


def flag_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(any_flag("flags", FILE_FLAGS[f])).alias(f) for f in EDITOR_FLAGS],
                  F.count_if(any_flag("flags", EDITOR_ERRORS)).alias("errors"))


def ancestors(folder) -> Column:
    """A folder and all folders above it; one entry per path level."""
    parts = F.filter(F.split(col(folder), "/"), lambda s: s != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(
        F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))


def count_under(df: DataFrame, prefix: str) -> DataFrame:
    root = paths.normalize_dir(prefix)
    return df.where((F.col("folder") == root) | F.col("folder").startswith(root.rstrip("/") + "/")).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def folder_counts(df: DataFrame) -> DataFrame:
    """Files and bytes below every folder at once; folders are pre-aggregated before exploding."""
    own = df.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    return own.select(F.explode(ancestors("folder")).alias("folder"), "n", "b").groupBy("folder").agg(
        F.sum("n").alias("files"), F.sum("b").alias("bytes"))


# --- fixed values: failure patterns; earlier categories win, text is matched case-blind ----
ERROR_RULES = (
    ("hardware", (
        "lacking required capabilities", "hwaccel initiali", "failed setup for format",
        "no device available for decoder", "hwaccel transfer data failed", "cannot load nvcuda",
        "cannot load libcuda", "cannot load cuda", "hw_device_ctx", "device creation failed")),
    ("library", (
        "unable to load shared library", "could not load", "dllnotfound",
        "the installed ffmpeg major version does not match", "version mismatch")),
    ("codec", (
        "decoder not found", "unknown decoder", "no decoder for", "codec not currently supported")),
    ("corrupt", (
        "moov atom not found", "invalid data found when processing input", "invalid nal unit size",
        "error splitting the input into nal units", "could not find codec parameters",
        "non-existing pps", "non-existing sps", "error while decoding", "partial file", "truncat")),
    ("access", (
        "permission denied", "no such file or directory", "operation not permitted",
        "protocol not found")),
    ("hardware", ("generic error in an external library",)),
)
ERROR_HINTS = {
    "hardware": "Turn hardware acceleration off for this file.",
    "library": "The decoding libraries are missing or have the wrong version.",
    "codec": "The decoder for this codec is not part of the installed build.",
    "corrupt": "The file is damaged or cut off; check it in a player.",
    "access": "The file could not be read: permissions, a lock, or an unusable path.",
}
# -----------------------------------------------------------------------------------------


def error_category(message) -> Column:
    text = F.lower(F.coalesce(col(message), F.lit("")))
    rules = []
    for category, needles in ERROR_RULES:
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(text, F.lit(n))
        rules.append(F.when(hit, F.lit(category)))
    return F.coalesce(*rules, F.lit("unknown"))


def classify_errors(log: DataFrame) -> DataFrame:
    d = log.withColumn("category", error_category("message"))
    hint = F.lit(None).cast("string")
    for category, text in ERROR_HINTS.items():
        hint = F.when(F.col("category") == category, text).otherwise(hint)
    return d.withColumn("hint", hint)
