"""Registered queries: catalog filters and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirrorset.config import MatchConfig
from mirrorset.functions import media, paths
from mirrorset.operators import catalog as C
from mirrorset.operators import maintenance as M
from mirrorset.operators.grouping import numbered_overall
from mirrorset.plans import oracle_views as O
from mirrorset.plans import views as V
from mirrorset.plans.registry import query

CAT = O.with_(O.CATALOG)
SCAN = MatchConfig(include=("/lib/src1", "/lib/src2/", "/lib/src3"), exclude=("/LIB/src1/de", "e?", "/lib/*2/f*"),
                   min_size_mb=1, max_size_mb=9, path_contains=("*f*1*", "*.MKV"), path_not_contains=("*f?5?.*",),
                   ignore_reparse_points=True)
MB = "floor(size::FLOAT / 1024::FLOAT / 1024::FLOAT)"
REASON_SQL = f"""elig AS (SELECT *, CASE
 WHEN lower(folder) = '/lib/src1/de' OR lower(folder) LIKE '/lib/src1/de/%' OR regexp_matches(folder, '(?i)(^|/)e.(/|$)')
  OR regexp_matches(folder, '(?is)^/lib/.*2/f.*$') THEN 'path is in the excluded directories list'
 WHEN NOT (folder IN ('/lib/src1', '/lib/src2', '/lib/src3') OR folder LIKE '/lib/src1/%' OR folder LIKE '/lib/src2/%' OR folder LIKE '/lib/src3/%')
  THEN 'path is not in the included directories list'
 WHEN flags & 2 = 2 THEN 'file has been manually excluded' WHEN flags & 16 = 16 THEN 'file is marked as too dark'
 WHEN file_id % 23 = 0 THEN 'file does not exist'
 WHEN {MB} < 1 OR {MB} > 9 THEN 'file size is outside the configured range'
 WHEN NOT (regexp_matches(path, '(?is)^.*f.*1.*$') OR regexp_matches(path, '(?is)^.*\\.mkv$')) THEN 'file path does not match the required patterns'
 WHEN flags & 256 = 256 THEN 'file is a reparse point'
 WHEN regexp_matches(path, '(?is)^.*f.5.\\..*$') THEN 'file path matches an excluded pattern' END AS excluded_reason FROM catalog)"""


def eligible(spark, sf):
    return C.eligibility(V.catalog(spark, sf), SCAN, present=F.col("file_id") % 23 != 0)


@query("eligibility", O.with_(O.CATALOG, REASON_SQL) + "SELECT file_id, excluded_reason FROM elig")
def _eligibility(spark, sf):
    return eligible(spark, sf).select("file_id", "excluded_reason")


@query("exclusion_summary", O.with_(O.CATALOG, REASON_SQL) + """SELECT excluded_reason, count(*) AS files FROM elig
WHERE excluded_reason IS NOT NULL GROUP BY excluded_reason""")
def _summary(spark, sf):
    return C.exclusion_summary(eligible(spark, sf))


@query("exclusion_samples", O.with_(O.CATALOG, REASON_SQL) + """SELECT * FROM (SELECT excluded_reason, file_id, path,
 row_number() OVER (PARTITION BY excluded_reason ORDER BY file_id) AS rn FROM elig WHERE excluded_reason IS NOT NULL) WHERE rn <= 5""")
def _samples(spark, sf):
    return C.exclusion_samples(eligible(spark, sf))


@query("in_scope", CAT + """SELECT file_id, folder LIKE '/lib/src4/%' OR folder = '/lib/src5/en' AS deep,
 folder IN ('/lib/src4', '/lib/src5/en') AS flat FROM catalog""")
def _scope(spark, sf):
    roots = ["/lib/src4/", "/lib/src5/en"]
    return V.catalog(spark, sf).select("file_id", paths.in_scope("folder", roots).alias("deep"),
                                       paths.in_scope("folder", roots, recursive=False).alias("flat"))


@query("is_blacklisted", CAT + """SELECT file_id, lower(folder) LIKE '/lib/src7/%' AS prefix,
 regexp_matches(folder, '(?i)(^|/)f.(/|$)') AS segment, regexp_matches(folder, '(?is)^/lib/src.*/e.$') AS full_path FROM catalog""")
def _blacklist(spark, sf):
    return V.catalog(spark, sf).select(
        "file_id", paths.is_blacklisted("folder", ["/LIB/SRC7"]).alias("prefix"),
        paths.is_blacklisted("folder", ["F?"]).alias("segment"),
        paths.is_blacklisted("folder", ["/lib/src*/e?"]).alias("full_path"))


@query("wildcard_match", CAT + """SELECT file_id, regexp_matches(path, '(?is)^.*/f.7\\.mp4$') AS anchored,
 regexp_matches(path, '(?is)src1.*f9') AS search_wild, contains(lower(path), 'f10') AS search_plain FROM catalog""")
def _wildcard(spark, sf):
    return V.catalog(spark, sf).select(
        "file_id", paths.wildcard_match("path", "*/F?7.mp4").alias("anchored"),
        paths.path_search("path", "SRC1*f9").alias("search_wild"), paths.path_search("path", "F10").alias("search_plain"))


@query("size_between_mb", CAT + f"SELECT file_id, {MB}::BIGINT AS mb, {MB} BETWEEN 2 AND 4 AS inside FROM catalog")
def _size(spark, sf):
    return V.catalog(spark, sf).select("file_id", media.megabytes("size").alias("mb"),
                                       C.size_between_mb("size", 2, 4).alias("inside"))


@query("comparable", O.with_(O.CATALOG, O.frames_doc(3)) + """, u AS (SELECT file_id, count(*) FILTER (WHERE (file_id + pos_idx) % 29 <> 0) AS n
 FROM frames GROUP BY file_id)
SELECT c.file_id FROM catalog c JOIN u USING (file_id) WHERE flags & 4 = 0 AND (is_image OR duration_s > 0) AND n >= CASE WHEN is_image THEN 1 ELSE 3 END""")
def _comparable(spark, sf):
    f = V.frames_doc(spark, sf, 3).withColumn("pixels", F.lit(64)) \
        .withColumn("gray", F.when((F.col("file_id") + F.col("pos_idx")) % 29 != 0, F.col("gray")))
    return C.comparable(V.catalog(spark, sf), f, 3).select("file_id")


@query("heal_legacy_frames", O.with_(O.frames_doc(3)) + """SELECT file_id, count(*) FILTER (WHERE (file_id + pos_idx) % 5 = 0) AS discarded,
 count(*) FILTER (WHERE (file_id + pos_idx) % 5 <> 0) AS kept FROM frames GROUP BY file_id""")
def _heal(spark, sf):
    f = V.frames_doc(spark, sf, 3).withColumn("gray", F.when(
        (F.col("file_id") + F.col("pos_idx")) % 5 == 0, F.slice("gray", 1, 16)).otherwise(F.col("gray")))
    kept, gone = C.heal_legacy_frames(f, 64)
    return kept.groupBy("file_id").agg(F.count(F.lit(1)).alias("kept")).join(gone, "file_id", "full") \
        .select("file_id", F.coalesce("discarded", F.lit(0)).alias("discarded"), F.coalesce("kept", F.lit(0)).alias("kept"))


@query("sample_positions", CAT + """SELECT file_id, i::INT AS pos_idx, round(i / 5::DOUBLE, 6) AS position, round(least(duration_s, 300) * i / 5::DOUBLE, 6) AS seconds
FROM catalog, (SELECT unnest(range(1, 5)) AS i) WHERE NOT is_image""")
def _positions(spark, sf):
    p = V.catalog(spark, sf).where("NOT is_image").select("file_id", "duration_s", F.posexplode(
        C.sample_positions(4)).alias("pos_idx", "position"))
    return p.select("file_id", (F.col("pos_idx") + 1).alias("pos_idx"), F.round("position", 6).alias("position"),
                    F.round(C.frame_seconds("duration_s", "position", 300.0), 6).alias("seconds"))


@query("needs_audio_fingerprint", CAT + """SELECT file_id, NOT is_image AND flags & 224 = 0 AND file_id % 3 = 0 AS needs,
 NOT is_image AND flags & 160 = 0 AND file_id % 3 = 0 AS needs_on_retry FROM catalog""")
def _needs_audio(spark, sf):
    c = V.catalog(spark, sf).withColumn("fp", F.when(F.col("file_id") % 3 != 0, F.array(F.lit(1))))
    return c.select("file_id", C.needs_audio_fingerprint("flags", "is_image", "fp").alias("needs"),
                    C.needs_audio_fingerprint("flags", "is_image", "fp", retry=True).alias("needs_on_retry"))


@query("select_streams", CAT + """, s AS (SELECT *, height > 600 AND width * height < 720 * 576 + 100000 AS second FROM catalog),
v AS (SELECT *, CASE WHEN is_image THEN width WHEN width * height >= 414720 THEN width ELSE 720 END AS w,
 CASE WHEN is_image THEN height WHEN width * height >= 414720 THEN height ELSE 576 END AS h, width * height >= 414720 AS main FROM catalog)
SELECT file_id, CASE WHEN is_image THEN 'jpg' WHEN main THEN 'h264' ELSE 'mpeg2' END AS format, w||'x'||h AS frame_size, (w + h)::INT AS frame_size_int,
 CASE WHEN is_image THEN 0::DOUBLE WHEN main THEN 25::DOUBLE ELSE 50::DOUBLE END AS fps,
 CASE WHEN is_image THEN 0 WHEN main THEN round_even(bit_rate / 1000::DOUBLE, 0)::BIGINT ELSE 2000 END AS bitrate_kbs,
 CASE WHEN NOT is_image THEN CASE WHEN file_id % 2 = 0 THEN 'aac' ELSE 'ac3' END END AS audio_format,
 CASE WHEN NOT is_image THEN CASE WHEN file_id % 2 = 0 THEN 'stereo' ELSE '5.1' END END AS audio_channel FROM v""")
def _streams(spark, sf):
    s = V.catalog(spark, sf).withColumn("streams", F.expr("""array(
      named_struct('index', 0, 'codec_name', 'h264', 'codec_type', 'Video', 'width', width, 'height', height, 'sample_rate', 0,
        'channel_layout', cast(null AS string), 'bit_rate', bit_rate, 'frame_rate', cast(25 AS float), 'channels', 0, 'hdr_format', ''),
      named_struct('index', 1, 'codec_name', 'aac', 'codec_type', 'audio', 'width', 0, 'height', 0, 'sample_rate', 48000,
        'channel_layout', 'stereo', 'bit_rate', 128500L, 'frame_rate', cast(0 AS float), 'channels', 2, 'hdr_format', ''),
      named_struct('index', 2, 'codec_name', 'ac3', 'codec_type', 'audio', 'width', 0, 'height', 0, 'sample_rate', 48000,
        'channel_layout', '5.1', 'bit_rate', 448000L, 'frame_rate', cast(0 AS float), 'channels', cast(2 + file_id % 2 * 4 AS int), 'hdr_format', ''),
      named_struct('index', 3, 'codec_name', 'mpeg2', 'codec_type', 'video', 'width', 720, 'height', 576, 'sample_rate', 0,
        'channel_layout', cast(null AS string), 'bit_rate', 2000000L, 'frame_rate', cast(50 AS float), 'channels', 0, 'hdr_format', ''))"""))
    return C.select_streams(s).select("file_id", "format", "frame_size", "frame_size_int", "fps", "bitrate_kbs",
                                      "audio_format", "audio_channel")


@query("derived_metrics", O.with_(O.ITEMS) + """SELECT group_id, item_id, CASE hdr_format WHEN 'Dolby Vision' THEN 4 WHEN 'HDR10+' THEN 3 WHEN 'HDR10' THEN 2
 WHEN 'HLG' THEN 1 ELSE 0 END AS hdr_rank, (length(path) - length(replace(path, '/', '')))::INT AS folder_depth,
 round(CASE WHEN bitrate_kbs > 0 AND fps > 0 THEN bitrate_kbs * 1000::DOUBLE / (split_part(frame_size, 'x', 1)::DOUBLE * split_part(frame_size, 'x', 2)::DOUBLE * fps)
 ELSE 0 END, 6) AS bits_per_pixel FROM items""")
def _metrics(spark, sf):
    return V.items(spark, sf).select(
        "group_id", "item_id", media.hdr_rank("hdr_format").alias("hdr_rank"), paths.folder_depth("path").alias("folder_depth"),
        F.round(media.bits_per_pixel("bitrate_kbs", "frame_size", "fps"), 6).alias("bits_per_pixel"))


@query("catalog_filter", CAT + """SELECT file_id FROM catalog WHERE flags & 1 = 0 AND flags & 92 <> 0 AND contains(lower(path), 'src1')
UNION ALL SELECT file_id + 1000000 FROM catalog WHERE flags & 128 <> 0""")
def _filter(spark, sf):
    c = V.catalog(spark, sf)
    a = C.catalog_filter(c, "videos", errors_only=True, search="SRC1").select("file_id")
    return a.unionByName(C.catalog_filter(c, flag="silent_audio_track").select((F.col("file_id") + 1000000).alias("file_id")))


@query("catalog_sort", CAT + """SELECT file_id, row_number() OVER (ORDER BY size DESC, lower(path), path) AS by_size,
 row_number() OVER (ORDER BY flags & 64 <> 0 DESC, duration_s DESC, lower(path), path) AS by_flag FROM catalog""")
def _sort(spark, sf):
    c = V.catalog(spark, sf)
    a = numbered_overall(c, C.catalog_order("size"), "by_size").select("file_id", "by_size")
    b = numbered_overall(c, C.catalog_order("duration", "audio_fingerprint_error"), "by_flag").select("file_id", "by_flag")
    return a.join(b, "file_id")


@query("flag_counts", CAT + "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE flags & {m} <> 0) AS {n}" for n, m in (
        ("manually_excluded", 2), ("thumbnail_error", 4), ("metadata_error", 8), ("too_dark", 16), ("no_audio_track", 32),
        ("silent_audio_track", 128), ("reparse_point", 256), ("is_image", 1), ("errors", 92))) + " FROM catalog")
def _flags(spark, sf):
    return C.flag_counts(V.catalog(spark, sf))


@query("folder_counts", CAT + """SELECT folder, count(*) AS files, sum(size)::BIGINT AS bytes FROM (
 SELECT folder, size FROM catalog UNION ALL SELECT regexp_extract(folder, '^(/[^/]+/[^/]+)', 1), size FROM catalog
 UNION ALL SELECT '/lib', size FROM catalog UNION ALL SELECT 'under /lib/src2', size FROM catalog WHERE folder LIKE '/lib/src2/%') GROUP BY folder""")
def _folders(spark, sf):
    c = V.catalog(spark, sf)
    one = C.count_under(c, "/lib/src2/").select(F.lit("under /lib/src2").alias("folder"), "files", "bytes")
    return C.folder_counts(c).unionByName(one)


ERROR_TEXT = """CASE event_type WHEN 'error' THEN CASE event_id % 5 WHEN 0 THEN 'Moov atom NOT found in x' WHEN 1 THEN 'hwaccel initialisation returned error; moov atom not found'
 WHEN 2 THEN 'Generic error in an external library: Permission denied' WHEN 3 THEN 'Unknown decoder foo' ELSE 'Generic error in an external library' END
 WHEN 'view' THEN 'could not load libav' ELSE event_type END"""


@query("classify_errors", f"""WITH m AS (SELECT {ERROR_TEXT} AS message FROM events),
c AS (SELECT CASE WHEN message ILIKE '%hwaccel initiali%' THEN 'hardware' WHEN message ILIKE '%could not load%' THEN 'library'
 WHEN message ILIKE '%unknown decoder%' THEN 'codec' WHEN message ILIKE '%moov atom not found%' THEN 'corrupt'
 WHEN message ILIKE '%permission denied%' THEN 'access' WHEN message ILIKE '%generic error in an external library%' THEN 'hardware' ELSE 'unknown' END AS category FROM m)
SELECT category, count(*) AS messages FROM c GROUP BY category""")
def _errors(spark, sf):
    log = V.table(spark, sf, "events").select(F.expr(ERROR_TEXT).alias("message"))
    return C.classify_errors(log).groupBy("category").agg(F.count(F.lit(1)).alias("messages"))


# --- maintenance ------------------------------------------------------------------------------

LISTING = """listing AS (SELECT file_id, CASE WHEN file_id % 17 = 0 THEN '/moved'||path ELSE path END AS path, folder,
 CASE WHEN file_id % 19 = 0 THEN size + 1 ELSE size END AS size, created,
 CASE WHEN file_id % 7 = 0 THEN modified + INTERVAL 1 DAY ELSE modified END AS modified,
 CASE WHEN file_id % 14 = 0 THEN 'x'||os_hash WHEN file_id % 31 = 0 THEN NULL ELSE os_hash END AS os_hash, duration_s, is_image, flags
 FROM catalog WHERE file_id % 13 <> 0)"""
LIST = O.with_(O.CATALOG, LISTING)


def listing(spark, sf):
    return V.catalog(spark, sf).where("file_id % 13 <> 0").selectExpr(
        "file_id", "CASE WHEN file_id % 17 = 0 THEN concat('/moved', path) ELSE path END AS path", "folder",
        "CASE WHEN file_id % 19 = 0 THEN size + 1 ELSE size END AS size", "created",
        "CASE WHEN file_id % 7 = 0 THEN modified + INTERVAL '1' DAY ELSE modified END AS modified",
        "CASE WHEN file_id % 14 = 0 THEN concat('x', os_hash) WHEN file_id % 31 = 0 THEN NULL ELSE os_hash END AS os_hash",
        "duration_s", "is_image", "flags")


@query("refresh_catalog", LIST + """SELECT path, outcome, coalesce(nsize, osize) AS size, coalesce(nm, om)::VARCHAR AS modified,
 outcome IN ('redated', 'kept', 'missing') AS keep_features FROM (SELECT coalesce(o.path, n.path) AS path, o.size AS osize, n.size AS nsize, o.modified AS om, n.modified AS nm,
 CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'missing' WHEN o.size <> n.size THEN 'reset'
  WHEN o.modified <> n.modified THEN CASE WHEN o.os_hash = n.os_hash THEN 'redated' ELSE 'reset' END ELSE 'kept' END AS outcome
 FROM catalog o FULL JOIN listing n ON o.path = n.path)""")
def _refresh(spark, sf):
    return M.refresh_catalog(V.catalog(spark, sf), listing(spark, sf)).select(
        "path", "outcome", "size", F.col("modified").cast("string").alias("modified"), "keep_features")


@query("relink_moved", LIST + """, g AS (SELECT size, os_hash, count(*) AS n, min(path) AS old_path FROM catalog
 WHERE os_hash IS NOT NULL AND path NOT IN (SELECT path FROM listing) GROUP BY ALL),
w AS (SELECT size, os_hash, count(*) AS n, min(path) AS new_path FROM listing WHERE os_hash IS NOT NULL AND path NOT IN (SELECT path FROM catalog) GROUP BY ALL)
SELECT old_path, new_path FROM g JOIN w ON g.size = w.size AND g.os_hash = w.os_hash WHERE g.n = 1 AND w.n = 1""")
def _relink(spark, sf):
    return M.relink_moved(V.catalog(spark, sf), listing(spark, sf))


@query("relocate_by_prefix", CAT + """SELECT file_id, CASE WHEN path LIKE '/lib/src1/%' THEN '/mnt/new/'||substr(path, 11) ELSE path END AS path FROM catalog""")
def _relocate(spark, sf):
    return M.relocate_by_prefix(V.catalog(spark, sf), "/lib/src1", "/mnt/new/").select("file_id", "path")


FOUND = """found AS (SELECT '/found/f'||file_id AS path, size, modified + to_seconds((file_id % 5)::INT) AS modified, duration_s + file_id % 3 * 0.4::DOUBLE AS duration_s
 FROM catalog WHERE file_id % 3 <> 0),
missing AS (SELECT path, CASE WHEN file_id % 2 = 0 THEN size // 64000 * 64000 ELSE size END AS size, modified, duration_s FROM catalog WHERE file_id % 4 = 0 OR file_id % 9 = 1),
fs AS (SELECT * REPLACE (CASE WHEN length(path) % 2 = 0 THEN size // 64000 * 64000 ELSE size END AS size) FROM found)"""


@query("relocate_by_rescan", O.with_(O.CATALOG, FOUND) + """, c AS (SELECT size, count(*) AS n, min(path) AS p FROM fs GROUP BY size),
r AS (SELECT m.path, count(f.path) AS k, min(f.path) AS p FROM missing m LEFT JOIN fs f ON f.size = m.size AND abs(epoch_us(f.modified) - epoch_us(m.modified)) <= 2000000
 AND abs(f.duration_s - m.duration_s) <= 0.5::DOUBLE GROUP BY m.path)
SELECT m.path, CASE WHEN c.n = 1 THEN c.p WHEN c.n > 1 AND r.k = 1 THEN r.p END AS new_path,
 CASE WHEN c.n IS NULL THEN 'NotFound' WHEN c.n = 1 THEN 'SizeOnly' WHEN r.k = 1 THEN 'SizeModifiedDuration' WHEN r.k > 1 THEN 'Ambiguous' ELSE 'NotFound' END AS confidence
FROM missing m LEFT JOIN c ON c.size = m.size JOIN r ON r.path = m.path""")
def _rescan(spark, sf):
    c = V.catalog(spark, sf)
    found = c.where("file_id % 3 <> 0").selectExpr(
        "concat('/found/f', file_id) AS path", "size", "modified + make_dt_interval(0, 0, 0, file_id % 5) AS modified",
        "duration_s + file_id % 3 * 0.4D AS duration_s").withColumn("size", F.expr(
            "CASE WHEN length(path) % 2 = 0 THEN size div 64000 * 64000 ELSE size END"))
    missing = c.where("file_id % 4 = 0 OR file_id % 9 = 1").selectExpr(
        "path", "CASE WHEN file_id % 2 = 0 THEN size div 64000 * 64000 ELSE size END AS size", "modified", "duration_s")
    return M.relocate_by_rescan(missing, found)


MOUNTS = """mounts AS (SELECT DISTINCT '/lib/'||source AS root, source <> 'src6' AS ready FROM documents WHERE source <> 'src9'
 UNION ALL SELECT '/lib/src6/en', true UNION ALL SELECT '/lib', false),
mo AS (SELECT c.file_id, arg_max(m.root, length(m.root)) AS root, arg_max(m.ready, length(m.root)) AS ready FROM catalog c JOIN mounts m
 ON c.folder = m.root OR starts_with(c.folder, m.root||'/') GROUP BY c.file_id),
st AS (SELECT c.*, mo.root, file_id % 3 = 0 AS has_data, CASE WHEN file_id % 4 <> 0 THEN 'present' WHEN coalesce(ready, false) THEN 'tombstone' ELSE 'offline' END AS status
 FROM catalog c LEFT JOIN mo USING (file_id))"""
STAT = O.with_(O.CATALOG, MOUNTS)


def mounts(spark, sf):
    d = V.table(spark, sf, "documents").where("source <> 'src9'").selectExpr(
        "concat('/lib/', source) AS root", "source <> 'src6' AS ready").distinct()
    return d.unionByName(spark.sql("SELECT '/lib/src6/en' AS root, true AS ready UNION ALL SELECT '/lib', false"))


def present(spark, sf):
    return V.catalog(spark, sf).where("file_id % 4 <> 0").select("path")


def with_data(spark, sf):
    return V.catalog(spark, sf).withColumn("has_data", F.col("file_id") % 3 == 0)


@query("path_status", STAT + "SELECT file_id, status FROM st")
def _status(spark, sf):
    return M.path_status(V.catalog(spark, sf), present(spark, sf), mounts(spark, sf)).select("file_id", "status")


@query("cleanup", STAT + """SELECT 'plain' AS mode, file_id FROM st WHERE flags & 12 = 0 AND status = 'present'
UNION ALL SELECT 'memory', file_id FROM st WHERE flags & 12 = 0 AND NOT (status = 'tombstone' AND NOT has_data)""")
def _cleanup(spark, sf):
    c, p, m = with_data(spark, sf), present(spark, sf), mounts(spark, sf)
    return M.cleanup(c, p, m, False).select(F.lit("plain").alias("mode"), "file_id").unionByName(
        M.cleanup(c, p, m, True).select(F.lit("memory").alias("mode"), "file_id"))


@query("ghosts", STAT + "SELECT file_id FROM st WHERE status = 'tombstone' AND NOT has_data")
def _ghosts(spark, sf):
    return M.ghosts(with_data(spark, sf), present(spark, sf), mounts(spark, sf)).select("file_id")


@query("apply_quarantine", CAT + """SELECT file_id, (CASE WHEN file_id % 10 = 1 THEN flags | 64 WHEN file_id % 10 = 2 THEN flags | 4 ELSE flags END)::INT AS flags FROM catalog""")
def _quarantine(spark, sf):
    c = V.catalog(spark, sf)
    s = c.where("file_id % 10 IN (1, 2)").select("file_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "path").selectExpr(
        "file_id * 2 + k AS seq", "concat(CASE WHEN (file_id % 10 = 1) = (k = 0) THEN 'audio' ELSE 'sampling' END, '|', path) AS line")
    return M.apply_quarantine(c, s.unionByName(spark.sql("SELECT -1L AS seq, 'broken line' AS line"))).select("file_id", "flags")


@query("heal_fingerprints", CAT + """SELECT file_id, (flags & ~64)::INT AS flags, CASE WHEN file_id % 3 = 0 THEN CASE WHEN flags & 64 = 64 AND flags & 160 = 0 THEN NULL ELSE 0 END
 ELSE 1 END::INT AS fp_length FROM catalog""")
def _heal_fp(spark, sf):
    c = V.catalog(spark, sf).withColumn("fp", F.when(F.col("file_id") % 3 == 0, F.array().cast("array<bigint>")).otherwise(
        F.array(F.lit(5).cast("bigint"))))
    return M.heal_fingerprints(c).select("file_id", "flags", F.when(F.col("fp").isNotNull(), F.size("fp")).alias("fp_length"))


@query("migrate_image_hashes", CAT + """SELECT file_id, (CASE WHEN is_image THEN flags & ~16 ELSE flags END)::INT AS flags, CASE WHEN NOT is_image THEN inode END AS phash FROM catalog""")
def _migrate(spark, sf):
    c = V.catalog(spark, sf).withColumn("phash", F.col("inode"))
    return M.migrate_image_hashes(c, 0).select("file_id", "flags", "phash")


@query("clear_cached_media", CAT + "SELECT file_id, (flags & ~252)::INT AS flags, NULL::DOUBLE AS duration_s, size FROM catalog")
def _clear(spark, sf):
    return M.clear_cached_media(V.catalog(spark, sf)).select("file_id", "flags", "duration_s", "size")


@query("edit_catalog", CAT + """SELECT file_id, (CASE WHEN file_id % 6 = 1 THEN flags | 2 ELSE flags END)::INT AS flags,
 CASE WHEN file_id % 6 = 2 THEN '/new/f'||file_id ELSE path END AS path FROM catalog WHERE file_id % 6 <> 3""")
def _edit(spark, sf):
    c = V.catalog(spark, sf)
    out = M.exclude_files(c, c.where("file_id % 6 = 1"))
    out = M.update_paths(out, c.where("file_id % 6 = 2").select("path", F.concat(F.lit("/new/f"), "file_id").alias("new_path")))
    return M.remove_paths(out, c.where("file_id % 6 = 3")).select("file_id", "flags", "path")


@query("drive_partition", STAT + """SELECT coalesce(root, '/') AS root, count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (WHERE file_id % 3 = 0) AS done_files,
 sum(CASE WHEN file_id % 3 = 0 THEN size ELSE 0 END)::BIGINT AS done_bytes FROM st WHERE NOT is_image GROUP BY ALL""")
def _drives(spark, sf):
    return M.drive_partition(V.catalog(spark, sf), mounts(spark, sf), F.col("file_id") % 3 == 0, ~F.col("is_image"))


@query("valid_cache", CAT + """SELECT 'valid' AS op, file_id FROM catalog WHERE file_id % 5 <> 0 AND file_id % 8 <> 0 AND file_id % 11 <> 0
UNION ALL SELECT 'kept', file_id FROM catalog WHERE file_id % 11 <> 0""")
def _cache(spark, sf):
    c = V.catalog(spark, sf).withColumn("mtime", F.unix_micros(F.col("modified").cast("timestamp")))
    cache = c.selectExpr("file_id", "CASE WHEN file_id % 11 = 0 THEN concat(path, '.gone') ELSE path END AS path",
                         "size + CASE WHEN file_id % 5 = 0 THEN 1 ELSE 0 END AS size", "mtime + CASE WHEN file_id % 8 = 0 THEN 1 ELSE 0 END AS mtime")
    return M.valid_cache(cache, c).select(F.lit("valid").alias("op"), "file_id").unionByName(
        M.prune_cache(cache, c).select(F.lit("kept").alias("op"), "file_id"))
