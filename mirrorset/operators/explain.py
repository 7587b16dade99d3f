"""Why a pair is or is not a duplicate: one row per gate, for any number of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorset.config import MatchConfig
from mirrorset.functions import frames
from mirrorset.functions.bits import any_flag
from mirrorset.functions.paths import folder_suffix
from mirrorset.operators import blocking as B
from mirrorset.operators import matching
from mirrorset.operators.partial import best_alignments, bit_budget, visual_gate
from mirrorset.runtime import cut_lineage
from mirrorset.schema import FILE_FLAGS

# --- fixed values: gates in the order they are tested and the advice on a failure ----------
GATES = ("inclusion", "type", "frames", "duration", "folder", "visual", "hardlink")
HINTS = {
    "inclusion": "One of the files is excluded from the scan; see its reason.",
    "type": "Images are only compared with images and videos with videos.",
    "frames": "Comparison data is missing; scan the file again.",
    "duration": "Raise the allowed duration difference.",
    "folder": "The folder mode forbids this pair.",
    "visual": "Lower the similarity threshold or try flipped comparison.",
    "hardlink": "Both paths are the same file on disk.",
}
PARTIAL_GATES = ("type", "length", "min_ratio", "max_ratio", "source_audio", "clip_audio", "blocks", "audio", "visual")
PARTIAL_HINTS = {
    "type": "Only videos can be clips of each other.",
    "length": "Both videos must be at least one second long.",
    "min_ratio": "Lower the minimum ratio of clip and source.",
    "max_ratio": "Videos of nearly one length are handled by the visual comparison.",
    "source_audio": "The longer video has no usable audio fingerprint.",
    "clip_audio": "The shorter video has no usable audio fingerprint.",
    "blocks": "The shorter video's fingerprint must be shorter than the longer one's.",
    "audio": "Lower the audio similarity threshold.",
    "visual": "Lower the visual threshold of clips or switch the visual confirmation off.",
}
# -----------------------------------------------------------------------------------------


def explain_partial(pairs: DataFrame, files: DataFrame, cfg: MatchConfig, timeline: DataFrame | None = None) -> DataFrame:
    """(src, clip, gate, step, pass, measured, required, hint, first_failure, is_partial) of clip detection by audio.

    The longer video of a pair is the source (the first one on ties). ``files``: file_id, is_image, duration_s,
    flags, fp, and interval_s where a ``timeline`` is given for the visual confirmation. Fingerprints are aligned
    only where all gates before pass; gates behind a failure count as failed. Pairs carry the lengths and hashes of
    fingerprints, and equal fingerprints are aligned once.
    """
    mark = F.xxhash64("fp")
    facts = files.select("file_id", "is_image", "duration_s", "flags", F.when(F.col("fp").isNotNull(), F.size("fp")).alias("n"), mark.alias("fp"))
    a = facts.select(*[F.col(c).alias(f"a_{c}") for c in facts.columns]).withColumnRenamed("a_file_id", "first")
    b = facts.select(*[F.col(c).alias(f"b_{c}") for c in facts.columns]).withColumnRenamed("b_file_id", "second")
    both = pairs.select(F.col("src").alias("first"), F.col("dst").alias("second")).join(a, "first").join(b, "second")
    longer = F.col("a_duration_s") >= F.col("b_duration_s")
    side = lambda c, source: F.when(longer, F.col(f"{'a' if source else 'b'}_{c}")).otherwise(F.col(f"{'b' if source else 'a'}_{c}"))
    wide = both.select(
        F.when(longer, F.col("first")).otherwise(F.col("second")).alias("src"), F.when(longer, F.col("second")).otherwise(F.col("first")).alias("clip"),
        (F.col("a_is_image") | F.col("b_is_image")).alias("image"), side("duration_s", True).alias("s_len"), side("duration_s", False).alias("c_len"),
        side("flags", True).alias("s_flags"), side("flags", False).alias("c_flags"), side("fp", True).alias("s_fp"), side("fp", False).alias("c_fp"), side("n", True).alias("s_n"), side("n", False).alias("c_n"))
    silent = FILE_FLAGS["no_audio_track"] | FILE_FLAGS["silent_audio_track"] | FILE_FLAGS["audio_fingerprint_error"]
    heard = lambda s: ~any_flag(f"{s}_flags", silent) & (F.coalesce(f"{s}_n", F.lit(0)) >= 2)
    ratio = F.col("c_len") / F.col("s_len")
    early = {
        "type": ~F.col("image"), "length": (F.col("s_len") >= 1) & (F.col("c_len") >= 1), "min_ratio": ratio >= cfg.partial_min_ratio,
        "max_ratio": ratio < cfg.partial_max_ratio, "source_audio": heard("s"), "clip_audio": heard("c"), "blocks": F.col("c_n") < F.col("s_n")}
    ready = F.lit(True)
    for ok in early.values():
        ready = ready & F.coalesce(ok, F.lit(False))
    wide = cut_lineage(wide.withColumn("_ready", ready), "pairs")
    fps = files.where("fp IS NOT NULL").select(mark.alias("file_id"), "fp").dropDuplicates(["file_id"])
    aligned = best_alignments(wide.where("_ready").select(F.col("s_fp").alias("src"), F.col("c_fp").alias("clip")), fps) \
        .withColumnsRenamed({"src": "s_fp", "clip": "c_fp"})
    found = wide.where("_ready").select("src", "clip", "s_fp", "c_fp", F.col("c_n").alias("len")).join(aligned, ["s_fp", "c_fp"]).select(
        "src", "clip", (1 - F.col("bits") / (F.col("len") * F.lit(32.0))).alias("similarity"), "offset_s",
        (F.col("bits") <= bit_budget(F.col("len"), cfg.partial_similarity)).alias("alike"))
    judged = wide.drop("s_fp", "c_fp", "s_n", "c_n", "s_flags", "c_flags").withColumns(
        {f"_{g}": F.coalesce(ok, F.lit(False)) for g, ok in early.items() if g not in ("source_audio", "clip_audio", "blocks")})
    heard_rows = wide.select("src", "clip", *[F.coalesce(early[g], F.lit(False)).alias(f"_{g}") for g in ("source_audio", "clip_audio", "blocks")])
    judged = judged.join(heard_rows, ["src", "clip"]).join(found, ["src", "clip"], "left").withColumn("_audio", F.coalesce("alike", F.lit(False)))
    used = list(PARTIAL_GATES)
    if cfg.partial_require_visual and timeline is not None:
        sure = visual_gate(found.where("alike").select("src", "clip", "similarity", "offset_s"), files, timeline, cfg.partial_visual_threshold, cfg.use_phash)
        judged = judged.join(sure.select("src", "clip", F.lit(True).alias("_seen")), ["src", "clip"], "left").withColumn("_visual", F.coalesce("_seen", F.lit(False)))
    else:
        used.remove("visual")
    text = lambda c: F.round(c, 6).cast("string")
    none = F.lit(None).cast("string")
    measured = {"length": text("c_len"), "min_ratio": text(ratio), "max_ratio": text(ratio), "audio": text("similarity")}
    required = {"length": text(F.lit(1.0)), "min_ratio": text(F.lit(cfg.partial_min_ratio)), "max_ratio": text(F.lit(cfg.partial_max_ratio)),
                "audio": text(F.lit(cfg.partial_similarity)), "visual": text(F.lit(cfg.partial_visual_threshold))}
    gates, so_far = [], F.lit(True)
    for i, g in enumerate(used):
        so_far = so_far & F.col(f"_{g}")
        gates.append(F.struct(F.lit(i).alias("step"), F.lit(g).alias("gate"), so_far.alias("pass"), measured.get(g, none).alias("measured"),
                              required.get(g, none).alias("required"), F.when(~F.col(f"_{g}"), F.lit(PARTIAL_HINTS[g])).otherwise(none).alias("hint")))
    failed = F.filter("gates", lambda x: ~x["pass"])
    return judged.withColumn("gates", F.array(*gates)).withColumn("first_failure", F.get(failed, F.lit(0))["gate"]) \
        .select("src", "clip", "offset_s", "first_failure", F.inline("gates")).withColumn("is_partial", F.col("first_failure").isNull())


def explain_pairs(pairs: DataFrame, features: DataFrame, cfg: MatchConfig, k: int, side: int,
                  emb: DataFrame | None = None, frame_hash=None) -> DataFrame:
    """(src, dst, gate, step, pass, measured, required, hint, first_failure, is_duplicate, similarities).

    ``features`` may carry ``excluded_reason`` and ``flags``; files without frames have null gray. With flipped
    comparison or AI on, rows ``flip`` and ``ai`` tell how these fared; the visual gate passes when any of the
    rules does. ``similarities`` has the share of equal brightness of every sampled position.
    """
    cols = ["is_image", "duration_s", "folder", "size", "dev", "inode", "gray", "phashes"]
    extra = [c for c in ("excluded_reason", "flags") if c in features.columns]
    wide = B.with_pair_columns(pairs.select("src", "dst"), features, features, cols + extra)
    pixels = side * side
    included = F.lit(True)
    for s in "ab":
        if "excluded_reason" in extra:
            included = included & F.col(f"{s}_excluded_reason").isNull()
    usable = F.col("a_gray").isNotNull() & F.col("b_gray").isNotNull()
    if "flags" in extra:
        bad = FILE_FLAGS["thumbnail_error"]
        usable = usable & ~any_flag("a_flags", bad) & ~any_flag("b_flags", bad)
    tol = F.least(B.tolerance("a_duration_s", cfg), B.tolerance("b_duration_s", cfg))
    gap = F.abs(F.col("a_duration_s") - F.col("b_duration_s"))
    same_folder = folder_suffix("a_folder", cfg.folder_depth) == folder_suffix("b_folder", cfg.folder_depth)
    folder_ok = {"none": F.lit(True), "same": same_folder, "different": ~same_folder}[cfg.folder_mode]
    linked = (F.col("a_size") == F.col("b_size")) & (F.col("a_dev") == F.col("b_dev")) \
        & (F.col("a_inode") == F.col("b_inode")) & (F.col("a_is_image") | (gap == 0))
    judged = matching.classic_verdict(wide, cfg, k, pixels).withColumn("orientation", F.lit("normal"))
    if cfg.compare_flipped:
        mirrored = matching.flipped(
            features.select("file_id", "gray", "phashes").where("gray IS NOT NULL"), k, side, frame_hash)
        m = mirrored.select(F.col("file_id").alias("src"), F.col("gray").alias("m_gray"), F.col("phashes").alias("m_ph"))
        other = wide.join(m, "src").withColumn("a_gray", F.col("m_gray")).withColumn("a_phashes", F.col("m_ph"))
        other = matching.classic_verdict(other, cfg, k, pixels).select("src", "dst", F.col("difference").alias("mdiff"))
        judged = judged.join(other, ["src", "dst"], "left")
        better = F.col("mdiff").isNotNull() & (F.col("difference").isNull() | (F.col("mdiff") < F.col("difference")))
        judged = judged.withColumn("orientation", F.when(better, "flipped").otherwise("normal")) \
            .withColumn("difference", F.when(better, F.col("mdiff")).otherwise(F.col("difference")))
    used = list(GATES)
    if cfg.compare_flipped:
        used.append("flip")
    else:
        judged = judged.withColumn("mdiff", F.lit(None).cast("double"))
    visual = F.col("difference").isNotNull()
    if cfg.use_ai and emb is not None:
        judged = judged.join(matching.ai_similarity(pairs, emb, k), ["src", "dst"], "left")
        by_ai = F.coalesce(F.col("ai_sim") >= cfg.ai_threshold, F.lit(False))
        visual = visual | by_ai
        used.append("ai")
    else:
        judged, by_ai = judged.withColumn("ai_sim", F.lit(None).cast("double")), F.lit(False)
    at = lambda s, p: F.slice(f"{s}_gray", p * pixels + 1, pixels)
    judged = judged.withColumn("similarities", F.array(*[
        1 - frames.sad(at("a", p), at("b", p)) / F.lit(float(pixels * 256)) for p in range(k)]))
    raw = frames.sad("a_gray", "b_gray") / F.lit(float(k * pixels * 256))
    text = lambda c: F.round(c, 6).cast("string")
    image = F.col("a_is_image")
    facts: dict[str, tuple[Column, Column, Column]] = {
        "inclusion": (included, F.lit(None).cast("string"), F.lit("both files eligible")),
        "type": (F.col("a_is_image") == F.col("b_is_image"), F.lit(None).cast("string"), F.lit("same type")),
        "frames": (usable, F.lit(None).cast("string"), F.lit(f"{k} frame(s) each")),
        "duration": (image | (gap <= tol), text(gap), text(tol)),
        "folder": (folder_ok, F.lit(None).cast("string"), F.lit(cfg.folder_mode)),
        "flip": (F.col("mdiff").isNotNull(), text("mdiff"), text(F.lit(cfg.gray_fraction))),
        "ai": (by_ai, text("ai_sim"), text(F.lit(cfg.ai_threshold))),
        "visual": (visual, text(F.coalesce("difference", raw)), text(F.lit(cfg.gray_fraction))),
        "hardlink": (~linked | F.lit(not cfg.exclude_hardlinks), F.lit(None).cast("string"), F.lit("different files")),
    }
    steps = F.array(*[F.struct(
        F.lit(i).alias("step"), F.lit(g).alias("gate"), F.coalesce(facts[g][0], F.lit(False)).alias("pass"),
        facts[g][1].alias("measured"), facts[g][2].alias("required")) for i, g in enumerate(used)])
    failed = F.filter("gates", lambda x: ~x["pass"] & ~x["gate"].isin("flip", "ai"))
    hint = F.lit(None).cast("string")
    for g, h in HINTS.items():
        hint = F.when((F.col("gate") == g) & ~F.col("pass"), h).otherwise(hint)
    return judged.withColumn("gates", steps).withColumn("first_failure", F.get(failed, F.lit(0))["gate"]) \
        .select("src", "dst", "orientation", "first_failure", "similarities", F.inline("gates")) \
        .withColumn("hint", hint).withColumn("is_duplicate", F.col("first_failure").isNull())
