"""Registered queries: flows, explanations, sources and sinks, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirrorset.config import MatchConfig
from mirrorset.operators import explain
from mirrorset.plans import flows
from mirrorset.plans import matching_queries as MQ
from mirrorset.plans import oracle_views as O
from mirrorset.plans import result_queries as RQ
from mirrorset.plans import views as V
from mirrorset.plans.registry import query
from mirrorset.runtime import cut_lineage, scratch_path
from mirrorset.sources import probe, stores, synthetic
from mirrorset.streaming import catalog_stream, events, sinks, stateful


@query("top_duplicate_groups", O.with_(MQ.EDGES_DOC, MQ.COMPONENTS, recursive=True) + """,
bd AS (SELECT file_id, min(difference) AS difference FROM (SELECT dst AS file_id, difference FROM edges UNION ALL SELECT src, difference FROM edges) GROUP BY file_id),
it AS (SELECT g.group_id, c.file_id, path, size, (1 - coalesce(bd.difference, 0)) * 100 AS similarity, width + height AS fs,
 max(width + height) OVER (PARTITION BY g.group_id) AS mf, min(size) OVER (PARTITION BY g.group_id) AS ms
 FROM grp g JOIN catalog c USING (file_id) LEFT JOIN bd USING (file_id))
SELECT group_id, count(*) AS files, round(min(similarity), 4) AS min_similarity, round(max(similarity), 4) AS max_similarity, sum(size)::BIGINT AS total_size,
 (sum(size) - max(size))::BIGINT AS savings, min(CASE WHEN fs = mf THEN path END) AS sharpest, min(CASE WHEN size = ms THEN path END) AS smallest
FROM it GROUP BY group_id ORDER BY savings DESC, group_id LIMIT 100""")
def _top(spark, sf):
    return flows.top_duplicate_groups(spark, sf)


@query("duplicate_groups")
def _groups(spark, sf):
    return flows.duplicate_groups(V.features_doc(spark, sf, 1), MatchConfig(), 1, V.SIDE)


EXPLAIN = MatchConfig(percent=96.0, folder_mode="different", folder_depth=2, exclude_hardlinks=True)


@query("explain_pairs", O.with_(O.features_doc(1)) + f""",
p AS (SELECT a.file_id AS src, a.file_id + 1 AS dst FROM features a JOIN features b ON b.file_id = a.file_id + 1
 UNION SELECT min(file_id), max(file_id) FROM features GROUP BY gray HAVING count(*) > 1),
w AS (SELECT p.src, p.dst, a.file_id % 50 <> 0 AND b.file_id % 50 <> 0 AS inclusion, a.is_image = b.is_image AS type, true AS frames,
 a.is_image OR {MQ.DUR} AS duration, a.folder <> b.folder AS folder, {MQ.SAD} <= 655 AS visual,
 NOT (a.size = b.size AND a.dev = b.dev AND a.inode = b.inode AND (a.is_image OR a.duration_s = b.duration_s)) AS hardlink
 FROM p JOIN features a ON a.file_id = p.src JOIN features b ON b.file_id = p.dst)
SELECT src, dst, CASE WHEN NOT inclusion THEN 'inclusion' WHEN NOT type THEN 'type' WHEN NOT duration THEN 'duration' WHEN NOT folder THEN 'folder'
 WHEN NOT visual THEN 'visual' WHEN NOT hardlink THEN 'hardlink' END AS first_failure,
 inclusion::INT + type::INT + frames::INT + duration::INT + folder::INT + visual::INT + hardlink::INT AS passed FROM w""")
def _explain(spark, sf):
    f = cut_lineage(V.features_doc(spark, sf, 1).withColumn("excluded_reason", F.when(
        F.col("file_id") % 50 == 0, "file does not exist")), "features")
    ids = f.select("file_id")
    nxt = ids.select(F.col("file_id").alias("src"), (F.col("file_id") + 1).alias("dst")).join(
        ids.select(F.col("file_id").alias("dst")), "dst", "left_semi").select("src", "dst")
    same = f.groupBy("gray").agg(F.min("file_id").alias("src"), F.max("file_id").alias("dst")).where("src < dst").select("src", "dst")
    out = explain.explain_pairs(nxt.union(same).distinct(), f, EXPLAIN, 1, V.SIDE)
    return out.groupBy("src", "dst").agg(F.min("first_failure").alias("first_failure"), F.sum(F.col("pass").cast("int")).cast("int").alias("passed"))


# --- sources and sinks --------------------------------------------------------------------------

@query("read_probe_json", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 3725::DOUBLE ELSE (p_size * 7)::DOUBLE END AS duration_s, 2 AS streams,
 CASE WHEN p_partkey % 4 = 0 THEN p_partkey * 10 ELSE p_partkey * 100 END AS video_rate, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 128000 END::BIGINT AS audio_rate,
 CASE p_partkey % 5 WHEN 0 THEN 'HLG' WHEN 1 THEN 'Dolby Vision' WHEN 2 THEN 'HDR10+' WHEN 3 THEN 'HDR10' ELSE '' END AS hdr,
 CASE WHEN p_partkey % 6 = 0 THEN -1::DOUBLE ELSE round(30000 / 1001::DOUBLE, 4) END AS fps FROM part""")
def _probe(spark, sf):
    p = V.table(spark, sf, "part").selectExpr("p_partkey AS id", """to_json(named_struct('streams', array(
      named_struct('index', 0, 'codec_name', 'h264', 'codec_type', 'video', 'width', 1280, 'height', 720, 'sample_rate', cast(null AS string),
       'bit_rate', CASE WHEN p_partkey % 4 <> 0 THEN cast(p_partkey * 100 AS string) END, 'r_frame_rate', CASE WHEN p_partkey % 6 = 0 THEN '0/0' ELSE '30000/1001' END,
       'color_transfer', CASE WHEN p_partkey % 5 = 0 THEN 'ARIB-STD-B67' WHEN p_partkey % 5 < 4 THEN 'smpte2084' ELSE 'bt709' END,
       'side_data_list', CASE p_partkey % 5 WHEN 1 THEN array(named_struct('side_data_type', 'x'), named_struct('side_data_type', 'DOVI configuration record'))
         WHEN 2 THEN array(named_struct('side_data_type', 'HDR Dynamic Metadata SMPTE2094-40 (HDR10+)')) END),
      named_struct('index', 1, 'codec_name', 'aac', 'codec_type', 'audio', 'width', cast(null AS int), 'height', cast(null AS int), 'sample_rate', '48000',
       'bit_rate', CASE WHEN p_partkey % 4 <> 0 THEN '128000' END, 'r_frame_rate', '0/0', 'color_transfer', cast(null AS string),
       'side_data_list', cast(null AS array<struct<side_data_type:string>>))),
     'format', named_struct('duration', CASE WHEN p_partkey % 3 = 0 THEN '01:02:05.5' ELSE concat(p_size * 7, '.98') END, 'bit_rate', cast(p_partkey * 10 AS string)))) AS probe""")
    r = probe.read_probe_json(p)
    v, a = F.get("streams", F.lit(0)), F.get("streams", F.lit(1))
    return r.select("id", "duration_s", F.size("streams").alias("streams"), v["bit_rate"].alias("video_rate"), a["bit_rate"].alias("audio_rate"),
                    v["hdr_format"].alias("hdr"), F.round(v["frame_rate"].cast("double"), 4).alias("fps"))


@query("catalog_round_trip", O.with_(O.CATALOG) + "SELECT file_id, path, is_image, size, duration_s, flags, created::VARCHAR AS created FROM catalog")
def _round_trip(spark, sf):
    """Parquet store, JSON export and import; the last version written is the one read."""
    root = scratch_path(spark, "store")
    c = V.catalog(spark, sf)
    stores.write_catalog(c.where("is_image"), root)
    stores.write_catalog(c, root, partition_by=["is_image"])
    stored = stores.read_catalog(spark, root)
    stores.export_catalog_json(stored, root + "/json")
    back = stores.import_catalog_json(spark, root + "/json", c.schema)
    return back.select("file_id", "path", "is_image", "size", "duration_s", "flags", F.col("created").cast("string").alias("created"))


@query("anonymous_features", O.with_(O.CATALOG, O.frames_doc(2)) + """, f AS (SELECT file_id, array_to_string(list(phash ORDER BY pos_idx), ',') AS phashes FROM frames GROUP BY file_id)
SELECT row_number() OVER (ORDER BY file_id) - 1 AS id, is_image, width, height, duration_s, flags, phashes FROM catalog LEFT JOIN f USING (file_id)""")
def _anonymous(spark, sf):
    c = V.catalog(spark, sf).withColumn("streams", F.array(
        F.struct(F.lit(0).alias("width"), F.lit(0).alias("height")), F.struct("width", "height")))
    return stores.anonymous_features(c, V.frames_doc(spark, sf, 2)).withColumn("phashes", F.array_join("phashes", ",")).drop("gray_frames")


ITEM_FIELDS = "item_id bigint, path string, size bigint, similarity double"


@query("write_results_json", RQ.ITEMS + "SELECT group_id, item_id, path, size, similarity FROM items")
def _json(spark, sf):
    out = scratch_path(spark, "results-json")
    stores.write_results(V.items(spark, sf).select("group_id", "item_id", "path", "size", "similarity"), out, "json")
    return stores.read_results(spark, out, ITEM_FIELDS.replace(" bigint", ":bigint").replace(" string", ":string").replace(" double", ":double"))


@query("result_records", RQ.ITEMS + """SELECT group_id, 0::BIGINT AS part, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY similarity DESC, path) AS ids FROM items GROUP BY group_id""")
def _records(spark, sf):
    r = stores.result_records(V.items(spark, sf).select("group_id", "item_id", "path", "similarity"))
    return r.select("group_id", "part", F.size("items").cast("bigint").alias("n"), F.array_join(
        F.transform("items", lambda x: x["item_id"].cast("string")), ",").alias("ids"))


@query("write_results_csv", RQ.ITEMS + """SELECT group_id::VARCHAR AS "GroupId", printf('%.1f', round(similarity, 1)) AS "Similarity", path AS "Path", size::VARCHAR AS "Size", printf('%.3f', duration_s) AS "Duration",
 frame_size AS "FrameSize", format AS "Format", printf('%.2f', fps) AS "Fps", bitrate_kbs::VARCHAR AS "BitRateKbs", audio_format AS "AudioFormat", strftime(created, '%Y-%m-%dT%H:%M:%S.%f')||'0Z' AS "DateCreated",
 CASE WHEN is_image THEN 'True' ELSE 'False' END AS "IsImage", CASE WHEN flags = 0 THEN 'None' ELSE concat_ws(', ', CASE WHEN flags & 2 = 2 THEN 'PartialClip' END, CASE WHEN flags & 4 = 4 THEN 'AiMatched' END,
 CASE WHEN flags & 8 = 8 THEN 'GrayscaleMatched' END, CASE WHEN flags & 16 = 16 THEN 'PHashMatched' END) END AS "Flags", printf('%.0f', offset_s) AS "PartialClipOffset" FROM items""")
def _csv(spark, sf):
    out = scratch_path(spark, "results-csv")
    stores.write_results(V.items(spark, sf), out, "csv")
    return spark.read.csv(out, header=True, quote='"', escape='"', schema=", ".join(f"{c} string" for c in stores.CSV_COLUMNS))


@query("write_results_text", O.with_(RQ.FLAGGED) + """, g AS (SELECT group_id, count(*) AS n, row_number() OVER (ORDER BY group_id) AS no FROM items GROUP BY group_id),
l AS (SELECT 'Group '||no||' ('||n||' files):' AS line FROM g UNION ALL SELECT '' FROM g UNION ALL SELECT '' UNION ALL
 SELECT 'Found '||(SELECT count(*) FROM g)||' duplicate group(s), '||(SELECT count(*) FROM items)||' total file(s).' UNION ALL
 SELECT '  '||lpad(printf('%.1f', round(similarity, 1)), 6, ' ')||'%  '||path||CASE WHEN is_best_bitrate OR is_best_frame THEN ' [best]' ELSE '' END||
  CASE WHEN flags & 2 = 2 AND offset_s > 0 THEN ' [partial clip @ '||printf('00:%02d:%02d', offset_s::INT // 60, offset_s::INT % 60)||']' ELSE '' END||CASE WHEN flags & 4 = 4 THEN ' [AI]' ELSE '' END FROM flagged UNION ALL
 SELECT '         '||frame_size||', '||format||CASE WHEN is_image THEN '' ELSE ', '||printf('%.2f', fps)||' fps, '||bitrate_kbs||' kbps, '||
  printf('%02d:%02d:%02d', duration_s::INT // 3600, duration_s::INT // 60 % 60, duration_s::INT % 60) END FROM flagged)
SELECT line, count(*) AS n FROM l GROUP BY line""")
def _text(spark, sf):
    out = scratch_path(spark, "results-text")
    stores.write_results(RQ.flagged(spark, sf), out, "text")
    return spark.read.text(out).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("snapshot", RQ.ITEMS + """SELECT 'items' AS part, path FROM items WHERE item_id % 100 <> 0 UNION ALL SELECT 'selected', path FROM items WHERE checked AND item_id % 100 <> 0
UNION ALL SELECT DISTINCT 'excluded', folder FROM items""")
def _snapshot(spark, sf):
    root = scratch_path(spark, "snapshot")
    i = V.items(spark, sf).withColumn("path", F.when(F.col("item_id") % 100 == 0, "  ").otherwise(F.col("path"))).select("path", "folder", "checked", "item_id")
    dirs = i.select(F.col("folder").alias("path")).distinct()
    stores.save_snapshot(i, V.items(spark, sf).where("checked").select("path"), dirs, dirs.limit(0), root)
    s = stores.load_snapshot(spark, root)
    parts = [s[p].select(F.lit(p).alias("part"), "path") for p in ("items", "selected", "excluded")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("read_blacklist", """SELECT o_orderkey AS doc, e::BIGINT AS entry_id, '/b/'||o_orderkey||'/'||e||'/'||p AS path
FROM orders, (SELECT unnest(range(2)) AS e), (SELECT unnest(['x', 'y']) AS p)""")
def _read_blacklist(spark, sf):
    o = V.table(spark, sf, "orders").selectExpr("o_orderkey AS doc", """to_json(transform(sequence(0, 1), e -> transform(array('x', 'y'),
      p -> concat('/b/', o_orderkey, '/', e, '/', p)))) AS sets""")
    texts = o.select("doc", F.when(F.col("doc") % 2 == 0, F.col("sets")).otherwise(
        F.concat(F.lit('{"Version":1,"Groups":'), "sets", F.lit("}"))).alias("value"))
    return stores.parse_blacklist(texts).select(F.split("path", "/")[2].cast("bigint").alias("doc"), "entry_id", "path")


@query("blacklist_round_trip", """SELECT o_orderkey AS entry_id, '/b/'||o_orderkey||'/'||p AS path
FROM orders, (SELECT unnest(['x', 'y', 'z']) AS p)""")
def _blacklist_round_trip(spark, sf):
    b = V.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS entry_id", "explode(array('x', 'y', 'z')) AS p").select(
        "entry_id", F.concat_ws("/", F.lit("/b"), F.col("entry_id").cast("string"), "p").alias("path"))
    out = scratch_path(spark, "blacklist")
    stores.write_blacklist(b, out)
    return stores.read_blacklist(spark, out)


@query("generate_catalog", """WITH r AS (SELECT doc_id AS id, doc_id < 90 AS cloned, CASE WHEN doc_id < 90 THEN doc_id // 3 ELSE doc_id + 1099511627776 END AS base FROM documents)
SELECT id AS file_id, cloned, ('0x'||substr(md5('7:duration:'||base), 1, 8))::UBIGINT::BIGINT % 3596 + 5::DOUBLE AS duration_s,
 (('0x'||substr(md5('7:size:'||base), 1, 8))::UBIGINT::BIGINT % 246 + 5) * 1048576 AS size, ('0x'||substr(md5('7:width:'||base), 1, 8))::UBIGINT::BIGINT % 3201 + 640 AS width FROM r""")
def _generate(spark, sf):
    rows = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return synthetic.generate_catalog(rows, 30, 3, 7).select("file_id", "cloned", "duration_s", "size", "width")


# --- streams ------------------------------------------------------------------------------------

def event_stream(spark, sf):
    return sinks.file_stream(spark, sf, V.table(spark, sf, "events").schema, "events.parquet")


def local_ts(df):
    """Event time as a timestamp with zone, whatever the file stores."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_catalog", O.with_(O.CATALOG) + """SELECT path, CASE WHEN file_id % 3 = 0 THEN 'new' WHEN file_id % 5 = 1 THEN 'reset' ELSE 'kept' END AS outcome FROM catalog""")
def _stream_catalog(spark, sf):
    src = sinks.file_stream(spark, sf, V.table(spark, sf, "documents").schema, "documents.parquet")
    c = cut_lineage(V.catalog(spark, sf), "catalog")
    listing = src.selectExpr(
        "concat('/lib/', source, '/', lang, '/f', doc_id, CASE WHEN doc_id % 5 = 0 THEN '.jpg' WHEN doc_id % 7 = 0 THEN '.MKV' ELSE '.mp4' END) AS path",
        "n_chars * 1000 + CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END AS size",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id AS int)) AS created",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id + doc_id % 48 AS int)) AS modified",
        "substr(md5(text), 1, 16) AS os_hash")
    root = scratch_path(spark, "changes")
    catalog_stream.stream_catalog(listing, c.where("file_id % 3 <> 0"), root, scratch_path(spark, "changes-state"))
    schema = "path string, outcome string, size bigint, created timestamp_ntz, modified timestamp_ntz, keep_features boolean, batch_id bigint"
    return catalog_stream.latest_changes(spark, root, schema).select("path", "outcome")


WINDOWS = """w AS (SELECT epoch_us(ts) AS us, event_id + 1 AS completed, (epoch_us(ts) // 7200000000 - k) * 7200000000 + 21600000000 AS window_end
 FROM events, (SELECT unnest(range(3)) AS k)),
a AS (SELECT window_end, min(completed) AS first, max(completed) AS last, (max(us) - min(us)) / 1e6::DOUBLE AS span FROM w GROUP BY window_end)"""
RATE = """SELECT (window_end // 1000000)::BIGINT AS window_end, last AS completed, round(CASE WHEN span >= 900 AND last - first >= 8 THEN (last - first) / span END, 6) AS rate,
 round(CASE WHEN span >= 900 AND last - first >= 8 THEN (1000000000 - last) / ((last - first) / span) END, 1) AS eta_s FROM a"""


def progress(df):
    return local_ts(df).select("ts", (F.col("event_id") + 1).alias("completed"), F.lit(1_000_000_000).cast("bigint").alias("total"))


def show_rate(df):
    return df.select(F.unix_seconds("window_end").alias("window_end"), "completed", F.round("rate", 6).alias("rate"), F.round("eta_s", 1).alias("eta_s"))


@query("progress_rate", "WITH " + WINDOWS + "\n" + RATE)
def _rate(spark, sf):
    return show_rate(events.progress_rate(progress(V.table(spark, sf, "events")), "6 hours", "2 hours", 900.0, 8))


@query("progress_rate_stream", "WITH " + WINDOWS + "\n" + RATE + " WHERE window_end <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM events)")
def _rate_stream(spark, sf):
    s = events.progress_rate(progress(event_stream(spark, sf)), "6 hours", "2 hours", 900.0, 8, watermark="10 minutes")
    return show_rate(sinks.drain(s, "rate"))


MESSAGE = "event_type||' '||props||' of user '||user_id||' took '||'''a 5'''"
TEMPLATE = "regexp_replace(regexp_replace(regexp_replace(message, '\"[^\"]*\"', '\"*\"', 'g'), '''[^'']*''', '''*''', 'g'), '[0-9]+', '#', 'g')"


def log(df):
    return local_ts(df).select(
        "ts", F.col("event_id").alias("log_id"), "user_id", F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "view", 1).otherwise(0).alias("severity"),
        F.concat("event_type", F.lit(" "), "props", F.lit(" of user "), F.col("user_id").cast("string"), F.lit(" took 'a 5'")).alias("message"),
        (F.col("event_type") == "signup").alias("is_session_start"))


LOG = f"""lg AS (SELECT event_id AS log_id, ts, {MESSAGE} AS message, CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS severity, event_type = 'signup' AS st,
 sum((event_type = 'signup')::INT) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM events)"""


@query("log_templates", "WITH " + LOG + f""" SELECT session, severity, {TEMPLATE} AS template, count(*) AS repeats, min(log_id) AS first_id FROM lg WHERE NOT st
GROUP BY session, severity, {TEMPLATE} HAVING bool_or(contains(lower(message), 'user 1'))""")
def _log_templates(spark, sf):
    s = events.log_sessions(log(V.table(spark, sf, "events")), [F.col("ts"), F.col("log_id")])
    return events.log_templates(s, "USER 1")


@query("severity_totals", "WITH " + LOG + " SELECT severity, count(*) AS messages FROM lg WHERE NOT st GROUP BY severity")
def _severity(spark, sf):
    return events.severity_totals(log(V.table(spark, sf, "events")))


@query("log_templates_stream", "WITH " + LOG + f""" SELECT (epoch_us(ts) // 86400000000 * 86400)::BIGINT AS window_start, severity, {TEMPLATE} AS template, count(*) AS repeats FROM lg
WHERE (epoch_us(ts) // 86400000000 + 1) * 86400000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM events) GROUP BY ALL""")
def _log_stream(spark, sf):
    s = events.stream_templates(log(event_stream(spark, sf)), "1 day", "10 minutes")
    return sinks.drain(s, "templates").withColumn("window_start", F.unix_seconds("window_start"))


@query("gap_sessions", """WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 21600000000, true) AS st FROM events),
s AS (SELECT *, sum(st::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, (min(epoch_us(ts)))::BIGINT AS session_start, count(*) AS messages FROM s GROUP BY user_id, n""")
def _gap(spark, sf):
    return events.gap_sessions(log(V.table(spark, sf, "events")), "6 hours").withColumn("session_start", F.unix_micros("session_start"))


@query("stream_match", O.with_(O.features_doc(1)) + f""",
cls AS (SELECT *, min(file_id) OVER (PARTITION BY is_image, duration_s, gray, phashes, file_id % 10 = 3) AS rep FROM features),
hit AS (SELECT a.file_id AS new_id, b.file_id AS stored_id, {MQ.SAD} AS sad, a.file_id = a.rep AS ar, b.file_id = b.rep AS br,
  a.rep = b.rep AS own, b.file_id % 10 = 3 AS inside FROM cls a JOIN cls b ON a.file_id % 10 = 3 AND {MQ.TYPE} AND (a.is_image OR {MQ.DUR}) AND {MQ.SAD} <= 655)
SELECT new_id, stored_id, round(sad / 16384::DOUBLE, 6) AS difference FROM hit
WHERE CASE WHEN inside THEN stored_id < new_id AND br AND (ar OR own) ELSE ar OR br END""")
def _stream_match(spark, sf):
    f = cut_lineage(V.features_doc(spark, sf, 1), "features")
    arriving = scratch_path(spark, "arriving")
    f.where("file_id % 10 = 3").write.parquet(arriving)
    src = sinks.file_stream(spark, arriving, f.schema, "*.parquet")
    out = scratch_path(spark, "matches")
    catalog_stream.stream_match(src, f.where("file_id % 10 <> 3"), MatchConfig(), 1, V.SIDE, out, scratch_path(spark, "matches-state"))
    return spark.read.parquet(out).select("new_id", "stored_id", F.round("difference", 6).alias("difference"))


@query("capped_samples", """SELECT * FROM (SELECT event_type AS reason, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS sample_no FROM events) WHERE sample_no <= 5""")
def _capped(spark, sf):
    e = event_stream(spark, sf).select(F.col("event_type").alias("reason"), "event_id")
    return sinks.drain(stateful.capped_samples(e, 5), "capped")


@query("dedup_consecutive", """SELECT user_id AS file_id, event_id::INT AS slot FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type""")
def _dedup(spark, sf):
    e = event_stream(spark, sf).select(F.col("user_id").alias("file_id"), F.col("event_id").cast("int").alias("slot"), F.col("event_type").alias("digest"))
    return sinks.drain(stateful.dedup_consecutive(e), "dedup")


@query("dedup_backlog", """SELECT user_id AS file_id, event_id::INT AS slot FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type""")
def _dedup_backlog(spark, sf):
    e = event_stream(spark, sf).select(F.col("user_id").alias("file_id"), F.col("event_id").cast("int").alias("slot"), F.col("event_type").alias("digest"))
    out = scratch_path(spark, "backlog")
    stateful.dedup_backlog(e, out, scratch_path(spark, "backlog-state"))
    return spark.read.parquet(out).select("file_id", "slot")
