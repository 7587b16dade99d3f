"""Registered queries: ranking, selection, projection of result items."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirrorset.functions import media
from mirrorset.operators import graph, projection, ranking, selection
from mirrorset.operators.grouping import mark_first, numbered
from mirrorset.plans import oracle_views as O
from mirrorset.plans import views as V
from mirrorset.plans.registry import query
from mirrorset.runtime import cut_lineage

ITEMS = O.with_(O.ITEMS)
HDR = ("CASE hdr_format WHEN 'Dolby Vision' THEN 4 WHEN 'HDR10+' THEN 3 WHEN 'HDR10' THEN 2 "
       "WHEN 'HLG' THEN 1 ELSE 0 END")
FLAGGED = O.ITEMS + f""",
flagged AS (SELECT *, count(*) OVER g AS n,
 NOT is_image AND duration_s = max(duration_s) OVER g AS is_best_duration,
 size = min(size) OVER g AS is_best_size, NOT is_image AND fps = max(fps) OVER g AS is_best_fps,
 NOT is_image AND bitrate_kbs = max(bitrate_kbs) OVER g AS is_best_bitrate,
 NOT is_image AND audio_sample_rate = max(audio_sample_rate) OVER g AS is_best_audio_rate,
 NOT is_image AND audio_bitrate_kbs = max(audio_bitrate_kbs) OVER g AS is_best_audio_bitrate,
 NOT is_image AND {HDR} = max({HDR}) OVER g AS is_best_hdr,
 frame_size_int = max(frame_size_int) OVER g AS is_best_frame
 FROM items WINDOW g AS (PARTITION BY group_id))"""


def flagged(spark, sf):
    return ranking.highlight_best(V.items(spark, sf))


@query("highlight_best", O.with_(FLAGGED) + "SELECT group_id, item_id, " + ", ".join(ranking.BEST_COLUMNS)
       + " FROM flagged")
def _highlight(spark, sf):
    return flagged(spark, sf).select("group_id", "item_id", *ranking.BEST_COLUMNS)


def keeper_sql(steps: list[tuple[str, str, bool, str, str]]) -> str:
    """Recursive-free oracle of the near-tie walk: one CTE per criterion."""
    ctes, prev = [O.ITEMS + """,
k0 AS (SELECT *, true AS alive, NULL::VARCHAR AS decided_by, 0::DOUBLE AS key FROM items)"""], "k0"
    for i, (name, value, video, fn, tie) in enumerate(steps, 1):
        applies = "cnt > 1" + (" AND NOT is_image" if video else "")
        sign = "" if fn == "min" else "-"
        ctes.append(f"""k{i}a AS (SELECT *, {value} AS v, {fn}(CASE WHEN alive THEN {value} END) OVER w AS best,
 count(*) FILTER (WHERE alive) OVER w AS cnt FROM {prev} WINDOW w AS (PARTITION BY group_id)),
k{i}b AS (SELECT * EXCLUDE (alive, key), alive AND (NOT ({applies}) OR ({tie})) AS alive,
 CASE WHEN {applies} THEN ({sign}v)::DOUBLE ELSE key END AS key FROM k{i}a),
k{i} AS (SELECT * EXCLUDE (v, best, cnt, decided_by), coalesce(decided_by, CASE WHEN {applies} AND
 count(*) FILTER (WHERE alive) OVER (PARTITION BY group_id) = 1 THEN '{name}' END) AS decided_by FROM k{i}b)""")
        prev = f"k{i}"
    ctes.append(f"""kept AS (SELECT *, item_id = first_value(item_id) OVER (PARTITION BY group_id
 ORDER BY CASE WHEN alive THEN 0 ELSE 1 END, key, item_id) AS is_keeper, count(*) OVER (PARTITION BY group_id) AS n
 FROM {prev})""")
    return O.with_(*ctes)


SHARE = "abs(v - best) <= greatest(v, best) * 0.05::DOUBLE"
BPP = ("CASE WHEN bitrate_kbs > 0 AND fps > 0 THEN bitrate_kbs * 1000.0::DOUBLE / "
       "(split_part(frame_size, 'x', 1)::DOUBLE * split_part(frame_size, 'x', 2)::DOUBLE * fps) ELSE 0::DOUBLE END")
KEEPER = keeper_sql([
    ("Duration", "duration_s", True, "max", "abs(v - best) <= 1 OR abs(v - best) <= greatest(v, best) * 0.01::DOUBLE"),
    ("Resolution", "frame_size_int", False, "max", "v = best"), ("Bitrate", "bitrate_kbs", True, "max", SHARE),
    ("FPS", "fps", True, "max", "abs(v - best) <= 0.5::DOUBLE"), ("Bits per pixel", BPP, True, "max", SHARE),
    ("Audio Bitrate", "audio_bitrate_kbs", True, "max", SHARE), ("Size", "size", False, "min", "v = best")])
EXACT_KEEPER = keeper_sql([
    ("Duration", "duration_s", True, "max", "v = best"), ("Resolution", "frame_size_int", False, "max", "v = best"),
    ("Bitrate", "bitrate_kbs", True, "max", "v = best"), ("FPS", "fps", True, "max", "v = best"),
    ("Audio Bitrate", "audio_sample_rate", True, "max", "v = best"), ("Size", "size", False, "min", "v = best")])


@query("pick_keeper", KEEPER + "SELECT group_id, item_id, decided_by FROM kept WHERE is_keeper")
def _pick_keeper(spark, sf):
    return ranking.keepers(V.items(spark, sf)).drop("members")


@query("pick_keeper_resolution_first", keeper_sql([
    ("Resolution", "frame_size_int", False, "max", "v = best"), ("Size", "size", False, "min", "v = best"),
    ("Duration", "duration_s", True, "max", "abs(v - best) <= 1 OR abs(v - best) <= greatest(v, best) * 0.01::DOUBLE"),
    ("Bitrate", "bitrate_kbs", True, "max", SHARE), ("FPS", "fps", True, "max", "abs(v - best) <= 0.5::DOUBLE"),
    ("Bits per pixel", BPP, True, "max", SHARE), ("Audio Bitrate", "audio_bitrate_kbs", True, "max", SHARE)])
    + "SELECT group_id, item_id, decided_by FROM kept WHERE is_keeper")
def _pick_keeper_res(spark, sf):
    crit = ranking.default_criteria(["Resolution", "Size"])
    return ranking.keepers(V.items(spark, sf), crit).drop("members")


@query("keep_best_in_group", KEEPER + "SELECT group_id, item_id FROM kept WHERE NOT is_keeper")
def _keep_best(spark, sf):
    return ranking.keep_best_in_group(V.items(spark, sf))


def pct_sql(v: str, best: str) -> str:
    p = f"({v} - {best})::DOUBLE / {best} * 100"
    return (f"CASE WHEN {best} > 0 THEN CASE WHEN abs({p}) < 0.5 THEN '=' ELSE CASE WHEN {p} < 0 THEN '-' ELSE '+' END"
            f"||abs(round({p}))::BIGINT||'%' END END")


DURATION_TEXT = """CASE WHEN d = 0 THEN '=' ELSE CASE WHEN d < 0 THEN '-' ELSE '+' END||CASE
 WHEN abs(d) >= 3600 THEN printf('%dh%02dm%02ds', abs(d)::BIGINT // 3600, abs(d)::BIGINT // 60 % 60, abs(d)::BIGINT % 60)
 WHEN abs(d) >= 60 THEN printf('%dm%02ds', abs(d)::BIGINT // 60, abs(d)::BIGINT % 60)
 ELSE printf('%ds', abs(d)::BIGINT) END END"""


def delta_sql(metric: str) -> str:
    v, flag = ranking.METRICS[metric]
    text = DURATION_TEXT if metric == "duration" else pct_sql("v", "best")
    return f"""SELECT '{metric}' AS metric, group_id, item_id, CASE WHEN lo <> hi THEN CASE WHEN flag THEN 'BEST' ELSE {text} END END AS delta
 FROM (SELECT *, v - best AS d FROM (SELECT group_id, item_id, {v} AS v, {flag} AS flag, min({v}) OVER g AS lo, max({v}) OVER g AS hi,
 coalesce(max(CASE WHEN {flag} THEN {v} END) OVER g, max({v}) OVER g) AS best FROM flagged WINDOW g AS (PARTITION BY group_id)))"""


@query("metric_deltas", O.with_(FLAGGED) + " UNION ALL ".join(delta_sql(m) for m in ranking.METRICS))
def _deltas(spark, sf):
    return ranking.item_deltas(V.items(spark, sf))


@query("hdr_upgrade", ITEMS + f"""SELECT group_id, item_id,
 {HDR} > min({HDR}) OVER (PARTITION BY group_id) AS hdr_is_upgrade FROM items""")
def _hdr_upgrade(spark, sf):
    return ranking.hdr_upgrade(V.items(spark, sf)).select("group_id", "item_id", "hdr_is_upgrade")


def chip_sql(a: str, b: str) -> str:
    return f"CASE WHEN {b} IS NULL OR {a} = {b} THEN 'neutral' WHEN {a} > {b} THEN 'better' ELSE 'worse' END"


@query("chip_state", ITEMS + f""",
f AS (SELECT *, {HDR} AS hdr, min(item_id) OVER (PARTITION BY group_id) AS head FROM items)
SELECT a.group_id, a.item_id, {chip_sql('a.frame_size_int', 'b.frame_size_int')} AS resolution,
 {chip_sql('a.size', 'b.size')} AS size_chip, {chip_sql('a.hdr', 'b.hdr')} AS hdr_chip
FROM f a JOIN f b ON a.group_id = b.group_id AND b.item_id = b.head AND a.item_id <> a.head""")
def _chip(spark, sf):
    i = mark_first(V.items(spark, sf).withColumn("hdr", media.hdr_rank("hdr_format")), "group_id", [], "item_id")
    head = i.where("is_first").select("group_id", *[F.col(c).alias(f"o_{c}") for c in ("frame_size_int", "size", "hdr")])
    return i.where("NOT is_first").join(head, "group_id").select(
        "group_id", "item_id", ranking.chip_state("frame_size_int", "o_frame_size_int").alias("resolution"),
        ranking.chip_state("size", "o_size").alias("size_chip"), ranking.chip_state("hdr", "o_hdr").alias("hdr_chip"))


@query("similarity_band", ITEMS + """SELECT band, count(*) AS items FROM (SELECT CASE WHEN similarity >= 99 THEN 'high'
 WHEN similarity >= 90 THEN 'mid' ELSE 'low' END AS band FROM items) GROUP BY band""")
def _band(spark, sf):
    return V.items(spark, sf).groupBy(ranking.similarity_band("similarity").alias("band")).agg(
        F.count(F.lit(1)).alias("items"))


# --- selection --------------------------------------------------------------------------------

def rest_sql(order: str, source: str = "flagged", where: str = "n > 1") -> str:
    return f"""SELECT group_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id
 ORDER BY {order}, item_id) AS rn FROM {source} WHERE {where}) WHERE rn > 1"""


QUALITY = """CASE WHEN is_best_bitrate THEN 0 WHEN is_best_frame THEN 1 ELSE 2 END,
 CASE WHEN NOT is_best_bitrate AND NOT is_best_frame THEN -bitrate_kbs ELSE 0 END,
 CASE WHEN NOT is_best_bitrate AND NOT is_best_frame THEN -frame_size_int ELSE 0 END,
 CASE WHEN NOT is_best_bitrate AND NOT is_best_frame THEN -size ELSE 0 END"""
STRATEGIES = {"lowest-quality": QUALITY, "smallest-file": "size DESC", "shortest-duration": "duration_s DESC",
              "worst-resolution": "frame_size_int DESC"}


@query("select_for_deletion", O.with_(FLAGGED) + " UNION ALL ".join(
    f"SELECT '{n}' AS strategy, * FROM ({rest_sql(o)})" for n, o in STRATEGIES.items()) + f"""
 UNION ALL SELECT '100-percent-only', * FROM ({rest_sql(QUALITY, "(SELECT *, min(similarity) OVER (PARTITION BY group_id) AS low FROM flagged)", "n > 1 AND low >= 100")})""")
def _deletion(spark, sf):
    f, out = cut_lineage(flagged(spark, sf), "flagged"), None
    for s in [*STRATEGIES, "100-percent-only"]:
        part = selection.select_for_deletion(f, s).select(F.lit(s).alias("strategy"), "group_id", "item_id")
        out = part if out is None else out.unionByName(part)
    return out


RULES = ["keep-protected", "keep-newest-created", "keep-oldest-created", "keep-newest-modified", "keep-oldest-modified"]
PROTECTED = "(path LIKE '/lib/s1/%' OR path LIKE '/lib/s20/%')"


def rule_sql(rule: str) -> str:
    base = f"""SELECT '{rule}' AS rule, group_id, item_id FROM (SELECT *, {PROTECTED} AS prot, group_id % 3 <> 0 AS inscope,
 count(*) OVER g AS n, bool_or({PROTECTED}) OVER g AS hasprot, bool_and(modified IS NOT NULL) OVER g AS dated,
 max(created) OVER g AS c1, min(created) OVER g AS c0, max(modified) OVER g AS m1, min(modified) OVER g AS m0
 FROM items WINDOW g AS (PARTITION BY group_id)) WHERE n > 1 AND inscope AND NOT prot AND """
    return base + {"keep-protected": "hasprot", "keep-newest-created": "created < c1", "keep-oldest-created": "created > c0",
                   "keep-newest-modified": "dated AND modified < m1", "keep-oldest-modified": "dated AND modified > m0"}[rule]


@query("select_rule", ITEMS + " UNION ALL ".join(rule_sql(r) for r in RULES))
def _rules(spark, sf):
    i = V.items(spark, sf)
    return selection.select_rules(i, i.where("group_id % 3 <> 0").select("path"), ["/lib/s1/", "/lib/../lib/s20"], RULES)


IDENT = "duration_s, frame_size_int, format, audio_format, audio_channel, audio_sample_rate, bitrate_kbs, fps"
CUSTOM = {
    "any": selection.CustomSelection(file_type="videos", min_mb=20, path_not_contains=("*/s7/*",)),
    "identical": selection.CustomSelection(cluster="identical"),
    "not_identical": selection.CustomSelection(cluster="not_identical", similarity_from=92.0),
    "keep_newest": selection.CustomSelection(path_contains=("/LIB/s?/*",), dates="keep_newest", skip_checked_groups=True),
}


def custom_sql(name: str) -> str:
    where = {"any": "NOT is_image AND floor(size::FLOAT / 1024::FLOAT / 1024::FLOAT) >= 20 AND path NOT LIKE '%/s7/%'",
             "identical": "true", "not_identical": "similarity >= 92",
             "keep_newest": "path LIKE '/lib/s_/%' AND NOT busy"}[name]
    cluster = {"identical": "item_id = head OR id = hid", "not_identical": "item_id = head OR id <> hid"}.get(name, "true")
    order = "created DESC, item_id" if name == "keep_newest" else "item_id"
    partial = "matched < n" if name == "any" else "false"
    return f"""SELECT '{name}' AS spec, group_id, item_id, CASE WHEN rn = 1 AND NOT ({partial}) THEN 'keep' ELSE 'check' END AS action
FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS matched, row_number() OVER (PARTITION BY group_id ORDER BY {order}) AS rn
FROM (SELECT *, first_value(item_id) OVER o AS head, first_value(id) OVER o AS hid FROM (
 SELECT *, row(size, {IDENT}) AS id FROM vis WHERE {where}) WINDOW o AS (PARTITION BY group_id ORDER BY item_id)) WHERE {cluster})"""


@query("select_custom", ITEMS + """, vis AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n,
 bool_or(checked) OVER (PARTITION BY group_id) AS busy FROM items)
""" + " UNION ALL ".join(custom_sql(n) for n in CUSTOM))
def _custom(spark, sf):
    i, out = cut_lineage(V.items(spark, sf), "items"), None
    for name, spec in CUSTOM.items():
        part = selection.select_custom(i, spec).select(F.lit(name).alias("spec"), "group_id", "item_id", "action")
        out = part if out is None else out.unionByName(part)
    return out


@query("identical_grades", ITEMS + f""",
h AS (SELECT *, row({IDENT}) AS id, min(item_id) OVER (PARTITION BY group_id) AS head FROM items)
SELECT a.group_id, a.item_id, a.id = b.id AND a.size = b.size AS equals_full, a.id = b.id AS equals_but_size,
 true AS same_group, a.duration_s = b.duration_s AS equals_only_length
FROM h a JOIN h b ON a.group_id = b.group_id AND b.item_id = b.head""")
def _grades(spark, sf):
    i = V.items(spark, sf)
    head = mark_first(i, "group_id", [], "item_id").where("is_first")
    return selection.identical_to(i, head)


def coarse(df):
    """Rows whose identity repeats inside a group, to exercise the identical clusters."""
    return df.withColumn("size", F.col("size") % 2).withColumn("duration_s", F.col("duration_s") % 2) \
        .withColumn("frame_size_int", F.lit(500)).withColumn("bitrate_kbs", F.lit(100).cast("bigint"))


@query("select_identical", ITEMS + f""",
c AS (SELECT group_id, item_id, row(size % 2, duration_s % 2, format, audio_format, audio_channel, audio_sample_rate, fps) AS id FROM items),
k AS (SELECT *, min(item_id) OVER (PARTITION BY group_id, id) AS head, count(*) OVER (PARTITION BY group_id, id) AS n FROM c),
f AS (SELECT group_id, min(head) AS head FROM k WHERE n > 1 GROUP BY group_id)
SELECT k.group_id, k.item_id FROM k JOIN f ON k.group_id = f.group_id AND k.head = f.head WHERE k.item_id <> k.head""")
def _identical(spark, sf):
    return selection.select_identical(coarse(V.items(spark, sf)))


@query("select_in_group", O.with_(FLAGGED) + """, h AS (SELECT *, item_id = min(item_id) OVER (PARTITION BY group_id) AS hd FROM flagged)
""" + " UNION ALL ".join(f"SELECT '{k}' AS keep, * FROM ({rest_sql(o + ', hd', 'h')})" for k, o in (
    ("smallest", "size"), ("newest", "created DESC"), ("oldest", "created"))))
def _in_group(spark, sf):
    i, out = cut_lineage(V.items(spark, sf), "items"), None
    for k in ("smallest", "newest", "oldest"):
        part = selection.select_in_group(i, k).select(F.lit(k).alias("keep"), "group_id", "item_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("selection_algebra", ITEMS + """SELECT 'missing' AS op, group_id, item_id FROM items WHERE NOT present
UNION ALL SELECT 'inverted', group_id, item_id FROM items WHERE present""")
def _algebra(spark, sf):
    i = V.items(spark, sf)
    missing = selection.select_missing(i)
    return missing.withColumn("op", F.lit("missing")).unionByName(
        selection.invert(i, missing).withColumn("op", F.lit("inverted"))).unionByName(
        selection.clear(missing).withColumn("op", F.lit("cleared")))


@query("select_redownloads", ITEMS + """SELECT group_id, item_id FROM (SELECT *, bool_or(NOT present AND root_ready)
 OVER (PARTITION BY group_id) AS t FROM items) WHERE t AND present""")
def _redownloads(spark, sf):
    return selection.select_redownloads(V.items(spark, sf))


SCORED = """s0 AS (SELECT *, (flags & 2) = 2 AS clip, bool_or((flags & 2) = 2) OVER (PARTITION BY group_id) AS clips FROM items),
s AS (SELECT *, is_reference OR (clips AND NOT clip) AS ref FROM s0),
view AS (SELECT group_id, count(*) AS files, coalesce(min(CASE WHEN NOT ref THEN similarity END), min(similarity)) AS min_similarity,
 coalesce(max(CASE WHEN NOT ref THEN similarity END), max(similarity)) AS max_similarity,
 sum(greatest(size, 0))::BIGINT AS total_size, (sum(greatest(size, 0)) - max(greatest(size, 0)))::BIGINT AS savings,
 round(coalesce(min(CASE WHEN NOT ref THEN similarity END), min(similarity))::VARCHAR::DECIMAL(12,6), 1) >= 100 AS shown_hundred
 FROM s GROUP BY group_id)"""


@query("auto_select_web", EXACT_KEEPER.rstrip() + ",\n" + SCORED + f"""
SELECT 'quality' AS mode, group_id, item_id FROM kept WHERE n > 1 AND NOT is_keeper
UNION ALL SELECT 'largest', * FROM ({rest_sql('size DESC', '(SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM items)')})
UNION ALL SELECT 'hundred-percent', group_id, item_id FROM (SELECT s.*, row_number() OVER (PARTITION BY s.group_id ORDER BY NOT ref, item_id) AS rn
 FROM s JOIN view v ON s.group_id = v.group_id WHERE v.shown_hundred) WHERE rn > 1""")
def _auto(spark, sf):
    i, out = cut_lineage(V.items(spark, sf), "items"), None
    for m in ("quality", "largest", "hundred-percent"):
        part = selection.auto_select_web(i, m).select(F.lit(m).alias("mode"), "group_id", "item_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("link_targets", ITEMS + """, k AS (SELECT group_id, arg_min(path, (-similarity, item_id)) AS target FROM items
 WHERE NOT checked AND present GROUP BY group_id)
SELECT i.group_id, item_id, target FROM items i LEFT JOIN k USING (group_id) WHERE checked""")
def _links(spark, sf):
    return selection.link_targets(V.items(spark, sf))


@query("tombstone_plan", ITEMS + """SELECT group_id, min(item_id) AS item_id FROM items GROUP BY group_id HAVING bool_and(checked)""")
def _tombstones(spark, sf):
    return selection.tombstone_plan(V.items(spark, sf))


DECISION = "CASE item_id % 3 WHEN 0 THEN 'keep_left' WHEN 1 THEN 'keep_right' ELSE 'skip' END"


@query("pairwise_review", ITEMS + f""", st AS (SELECT group_id, {DECISION} AS d,
 row_number() OVER (PARTITION BY group_id ORDER BY item_id) AS pos FROM items),
w AS (SELECT *, coalesce(max(CASE WHEN d = 'keep_right' AND pos > 1 THEN pos END) OVER (PARTITION BY group_id ORDER BY pos
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS left_pos FROM st)
SELECT group_id, pos - 1 AS pair_number, left_pos, pos AS right_pos,
 CASE d WHEN 'keep_left' THEN pos WHEN 'keep_right' THEN left_pos END AS check_pos FROM w WHERE pos > 1""")
def _review(spark, sf):
    return selection.pairwise_review(V.items(spark, sf), F.expr(DECISION))


MOVE_PATH = "concat('/src/c', l_partkey % 500, '.mp4')"


@query("move_plan", """WITH sel AS (SELECT l_partkey * 10000000 + l_suppkey * 10 + l_linenumber AS item_id,
  '/src/'||l_orderkey||'/c'||(l_partkey % 500)||'.mp4' AS path, 'c'||(l_partkey % 500) AS stem FROM lineitem WHERE l_returnflag = 'R'),
ex AS (SELECT 'c'||n||s||'.mp4' AS name FROM (SELECT unnest(range(40)) AS n), (SELECT unnest(['', '_2', '_3']) AS s)),
r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY item_id, path) AS rn FROM sel),
num AS (SELECT stem, i, CASE WHEN i = 0 THEN stem||'.mp4' ELSE stem||'_'||i||'.mp4' END AS name
 FROM (SELECT stem, unnest(range(count(*) + 3)) AS i FROM sel GROUP BY stem)),
fr AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY i) AS rn FROM num WHERE name NOT IN (SELECT name FROM ex))
SELECT item_id, path, '/dst/moved/'||name AS target FROM r JOIN fr USING (stem, rn)""")
def _move(spark, sf):
    sel = V.table(spark, sf, "lineitem").where("l_returnflag = 'R'").selectExpr(
        "l_partkey * 10000000 + l_suppkey * 10 + l_linenumber AS item_id",
        "concat('/src/', l_orderkey, '/c', l_partkey % 500, '.mp4') AS path")
    existing = V.table(spark, sf, "part").selectExpr("p_partkey % 40 AS n").distinct().select(F.explode(F.array(*[
        F.concat(F.lit("c"), F.col("n").cast("string"), F.lit(s + ".mp4")) for s in ("", "_2", "_3")])).alias("name"))
    return selection.move_plan(sel, existing, "/dst/moved")


@query("cleanup_report", ITEMS + """SELECT group_id, path, size, frame_size, CASE WHEN checked THEN 'remove' ELSE 'keep' END AS action,
 group_savings::BIGINT AS group_savings, (SELECT sum(size) FROM items WHERE checked)::BIGINT AS total_savings
FROM (SELECT *, bool_or(checked) OVER g AS t, sum(CASE WHEN checked THEN size ELSE 0 END) OVER g AS group_savings
 FROM items WINDOW g AS (PARTITION BY group_id)) WHERE t""")
def _cleanup(spark, sf):
    return selection.cleanup_report(V.items(spark, sf))


@query("where_expression", ITEMS + """SELECT group_id, item_id, whole_group FROM (SELECT *, size > 5000000 AND format = 'h264' AS m,
 bool_and(size > 5000000 AND format = 'h264') OVER (PARTITION BY group_id) AS whole_group FROM items) WHERE m""")
def _where(spark, sf):
    return selection.where_expression(V.items(spark, sf), "size > 5000000 AND format = 'h264'") \
        .select("group_id", "item_id", "whole_group")


# --- projection -------------------------------------------------------------------------------

@query("group_view", ITEMS + f", {SCORED} SELECT * FROM view")
def _view(spark, sf):
    return projection.group_view(V.items(spark, sf))


def scored_on(source: str) -> str:
    return SCORED.replace("FROM items)", f"FROM {source})", 1)


@query("filter_groups", ITEMS + """, inc AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS nn FROM items
 WHERE folder NOT IN ('/lib/s3', '/lib/s4')) WHERE nn >= 2),
hit AS (SELECT * FROM (SELECT *, bool_or(path ILIKE '%/s1%') OVER (PARTITION BY group_id) AS h FROM inc) WHERE h),
""" + scored_on("hit") + " SELECT * FROM view WHERE NOT shown_hundred")
def _filter_groups(spark, sf):
    return projection.filter_groups(V.items(spark, sf), search="/S1", excluded=["/lib/s3", "/lib/s4/"],
                                    similarity="below-hundred")


@query("sort_groups", ITEMS + f""", {SCORED} SELECT group_id, row_number() OVER (ORDER BY min_similarity DESC, savings DESC, group_id) AS rn
 FROM view""")
def _sort_groups(spark, sf):
    from mirrorset.operators.grouping import numbered_overall
    return numbered_overall(projection.group_view(V.items(spark, sf)), projection.group_order()).select("group_id", "rn")


@query("page", ITEMS + f""", {SCORED} SELECT * FROM view ORDER BY min_similarity DESC, savings DESC, group_id LIMIT 50 OFFSET 100""")
def _page(spark, sf):
    return projection.page(projection.group_view(V.items(spark, sf)), 3, 50)


@query("results_filter", ITEMS + """, h AS (SELECT *, bool_or(path ILIKE '%s2_/%') OVER g AS a, bool_or(checked) OVER g AS c
 FROM items WINDOW g AS (PARTITION BY group_id)),
v AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM h WHERE a AND c AND NOT is_image AND similarity BETWEEN 91 AND 98)
SELECT group_id, item_id FROM v WHERE n >= 2""")
def _results_filter(spark, sf):
    return projection.results_filter(V.items(spark, sf), path="S2?/*", file_type="videos", low=91.0, high=98.0,
                                     only_checked_groups=True).select("group_id", "item_id")


def sorted_sql(key: str, member: str) -> str:
    return f""", g AS (SELECT group_id, row_number() OVER (ORDER BY {key}, group_id) AS group_number FROM
 (SELECT group_id, sum(greatest(size, 0)) - max(greatest(size, 0)) AS wasted, max(similarity) AS sim, max(lower(path)) AS p, bool_or(checked) AS chk,
  count(*) AS n FROM src GROUP BY group_id HAVING count(*) >= 2))
SELECT group_number, row_number() OVER (PARTITION BY group_number ORDER BY {member} item_id) AS row_number, group_id, item_id
FROM src JOIN g USING (group_id)"""


@query("sort_results_wasted", O.with_(FLAGGED, "src AS (SELECT * FROM flagged)") + sorted_sql(
    "wasted DESC", "NOT is_best_frame, size DESC,"))
def _sort_wasted(spark, sf):
    return projection.sort_results(flagged(spark, sf), "wasted_space", True, best_first="is_best_frame")


@query("sort_results_similarity", O.with_(O.ITEMS, "src AS (SELECT * FROM items)") + sorted_sql("sim", "similarity,"))
def _sort_similarity(spark, sf):
    return projection.sort_results(V.items(spark, sf), "similarity", False)


@query("sort_results_path", O.with_(O.ITEMS, "src AS (SELECT * FROM items)") + sorted_sql("p DESC", "lower(path) DESC,"))
def _sort_path(spark, sf):
    return projection.sort_results(V.items(spark, sf), "folder_path", True)


@query("sort_results_checked", O.with_(O.ITEMS, "src AS (SELECT * FROM items)") + sorted_sql("chk DESC", ""))
def _sort_checked(spark, sf):
    return projection.sort_results(V.items(spark, sf), "checked", True)


CHOICE = ("CASE group_id % 7 WHEN 0 THEN 'similarity' WHEN 1 THEN 'size' WHEN 2 THEN 'duration' WHEN 3 THEN 'bitrate' "
          "WHEN 4 THEN 'resolution' WHEN 5 THEN 'date' ELSE 'name' END")


@query("sort_members_web", ITEMS + f"""SELECT group_id, item_id, row_number() OVER (PARTITION BY group_id ORDER BY
 CASE {CHOICE} WHEN 'size' THEN size::DOUBLE WHEN 'duration' THEN duration_s WHEN 'bitrate' THEN bitrate_kbs::DOUBLE
 WHEN 'resolution' THEN frame_size_int::DOUBLE WHEN 'date' THEN epoch_us(created)::DOUBLE WHEN 'name' THEN 0 ELSE similarity END DESC,
 CASE WHEN {CHOICE} = 'name' THEN split_part(path, '/', 4) ELSE '' END, item_id) AS rn FROM items""")
def _members_web(spark, sf):
    i = V.items(spark, sf)
    return numbered(i, ["group_id"], projection.member_order(F.expr(CHOICE))).select("group_id", "item_id", "rn")


def bytes_sql(c: str) -> str:
    units = "".join(f" WHEN {c} >= {1024 ** i} THEN printf('%.1f {u}', round({c} / {1024 ** i}::DOUBLE, 1))"
                    for i, u in reversed(list(enumerate(media.SIZE_UNITS))) if 0 < i < 6)
    return f"CASE{units} WHEN {c} = 0 THEN '0 B' ELSE printf('%.1f B', {c}::DOUBLE) END"


@query("group_header", ITEMS + f""", g AS (SELECT group_id, count(*) AS files, sum(greatest(size, 0))::BIGINT AS total_bytes,
 min(similarity) AS similarity_min, max(similarity) AS similarity_max, count(*) FILTER (WHERE present) AS on_disk,
 bool_or(NOT present AND root_ready) AS has_tombstone, bool_or(NOT present AND NOT root_ready) AS has_offline, bool_or(checked) AS has_checked,
 bool_or(flags & 8 = 8) AS has_gray, bool_or(flags & 16 = 16) AS has_phash,
 (sum(greatest(size, 0)) - max(greatest(size, 0)))::BIGINT AS wasted_bytes FROM items GROUP BY group_id HAVING count(*) >= 2)
SELECT *, concat_ws(' · ', files||' files', {bytes_sql('total_bytes')}, CASE WHEN wasted_bytes > 0 THEN 'save up to '||({bytes_sql('wasted_bytes')}) END,
 CASE WHEN on_disk < files THEN on_disk||' on disk' END, CASE WHEN has_tombstone THEN 'previously deleted content' END) AS summary FROM g""")
def _header(spark, sf):
    return projection.group_header(V.items(spark, sf))


@query("totals", ITEMS + """SELECT sum(n)::BIGINT AS duplicates, count(*) AS groups, sum(t)::BIGINT AS total_bytes, sum(t - m)::BIGINT AS savings
FROM (SELECT count(*) AS n, sum(greatest(size, 0)) AS t, max(greatest(size, 0)) AS m FROM items GROUP BY group_id)""")
def _totals(spark, sf):
    return projection.totals(V.items(spark, sf))


@query("selection_totals", ITEMS + """SELECT count(*) AS rows, count(DISTINCT group_id) AS groups, sum(greatest(size, 0))::BIGINT AS bytes
FROM items WHERE checked""")
def _selection_totals(spark, sf):
    return projection.selection_totals(V.items(spark, sf))


def kbs_sql(c: str) -> str:
    return (f"CASE WHEN {c} <= 0 THEN '' WHEN {c} >= 1000 THEN printf('%.1f Mb/s', round({c} / 1000::DOUBLE, 1)) "
            f"ELSE {c}||' kb/s' END")


@query("detail_lines", ITEMS + f"""SELECT group_id, item_id,
 concat_ws(' · ', nullif(format, ''), nullif(frame_size, ''), CASE WHEN NOT is_image AND fps > 0 THEN fps::INT||' fps' END,
  CASE WHEN NOT is_image AND duration_s > 0 THEN printf('%02d:%02d:%02d', duration_s::BIGINT // 3600 % 24, duration_s::BIGINT // 60 % 60, duration_s::BIGINT % 60) END,
  nullif({kbs_sql('bitrate_kbs')}, ''), nullif(hdr_format, '')) AS video_line,
 concat_ws(' · ', audio_format, audio_channel, CASE audio_sample_rate WHEN 44100 THEN '44.1' ELSE '48' END||' kHz', {kbs_sql('audio_bitrate_kbs')}) AS audio_line,
 {bytes_sql('size')} AS size_text, round(similarity::VARCHAR::DECIMAL(12,6), 1)::DECIMAL(12,1)::VARCHAR AS score_text FROM items""")
def _detail(spark, sf):
    return projection.detail_lines(V.items(spark, sf))


@query("frame_positions", ITEMS + """SELECT group_id, item_id, i::INT AS i, round(CASE WHEN is_image THEN 0
 ELSE least(duration_s, 1200) * (i + 1) / 4::DOUBLE END, 6) AS position_s
FROM items, (SELECT unnest(range(3)) AS i) WHERE i = 0 OR NOT is_image""")
def _positions(spark, sf):
    p = projection.frame_positions(V.items(spark, sf), 3, 1200.0)
    return p.withColumn("position_s", F.round("position_s", 6))


PAIR_SQL = """, h AS (SELECT *, min(item_id) OVER (PARTITION BY group_id) AS head, flags & 2 = 2 AS clip FROM items),
p AS (SELECT a.group_id, a.item_id AS a_id, b.item_id AS b_id, a.duration_s AS ad, b.duration_s AS bd, a.is_image AS img, a.clip OR b.clip AS part,
 CASE WHEN a.clip THEN a.offset_s ELSE 0 END AS ao, CASE WHEN b.clip THEN b.offset_s ELSE 0 END AS bo
 FROM h a JOIN h b ON a.group_id = b.group_id AND a.item_id = a.head AND b.item_id <> b.head),
f AS (SELECT *, CASE WHEN img THEN 1 WHEN part THEN 3 ELSE 2 END AS frames FROM p),
r AS (SELECT *, greatest(ao, bo) AS st, least(ao + ad, bo + bd) AS en, (i + 1) / (frames + 1)::DOUBLE AS sh FROM f, (SELECT unnest(range(3)) AS i) WHERE i < frames),
m AS (SELECT *, part AND NOT img AND en > st AS shared, st + (en - st) * sh AS mo FROM r)
SELECT group_id, a_id, b_id, i::INT AS i,
 round(CASE WHEN img THEN 0 ELSE greatest(0, least(CASE WHEN shared THEN mo - ao ELSE ad * sh END, greatest(0, ad - 0.1::DOUBLE))) END, 6) AS a_pos,
 round(CASE WHEN img THEN 0 ELSE greatest(0, least(CASE WHEN shared THEN mo - bo ELSE bd * sh END, greatest(0, bd - 0.1::DOUBLE))) END, 6) AS b_pos,
 i = (frames - 1) // 2 AS opens_here FROM m"""


@query("aligned_pair_positions", ITEMS + PAIR_SQL.lstrip(" "))
def _aligned(spark, sf):
    i = mark_first(V.items(spark, sf), "group_id", [], "item_id")

    def side(df, s):
        return df.select("group_id", F.col("item_id").alias(f"{s}_id"), F.col("duration_s").alias(f"{s}_duration"),
                         F.col("is_image").alias(f"{s}_is_image"), selection.is_partial().alias(f"{s}_partial"),
                         F.col("offset_s").alias(f"{s}_offset"))

    pairs = side(i.where("is_first"), "a").join(side(i.where("NOT is_first"), "b"), "group_id")
    return projection.aligned_pair_positions(pairs, 2).select(
        "group_id", "a_id", "b_id", "i", F.round("a_pos", 6).alias("a_pos"), F.round("b_pos", 6).alias("b_pos"), "opens_here")


# --- group maintenance ------------------------------------------------------------------------

@query("drop_singletons", ITEMS + """SELECT group_id, item_id FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM items
 WHERE NOT checked) WHERE n > 1""")
def _singletons(spark, sf):
    return graph.drop_singletons(V.items(spark, sf).where("NOT checked")).select("group_id", "item_id")


@query("drop_hardlinks", ITEMS + """SELECT group_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, size % 3, dev % 2, inode % 3
 ORDER BY item_id) AS rn FROM items) WHERE rn = 1""")
def _drop_hardlinks(spark, sf):
    i = V.items(spark, sf).withColumn("size", F.col("size") % 3).withColumn("dev", F.col("dev") % 2) \
        .withColumn("inode", F.col("inode") % 3)
    return graph.drop_hardlinks(i).select("group_id", "item_id")


BLACKLIST = """blacklist AS (SELECT group_id // 4 AS entry_id, path FROM items WHERE group_id % 4 = 0
 UNION ALL SELECT group_id // 4, path FROM items WHERE group_id % 4 = 1 AND item_id % 7 <> 0)"""


def blacklist(items):
    return items.where("group_id % 4 = 0").unionByName(items.where("group_id % 4 = 1 AND item_id % 7 <> 0")) \
        .select(F.expr("group_id div 4").alias("entry_id"), "path")


@query("blacklisted_groups", O.with_(O.ITEMS, BLACKLIST) + """, n AS (SELECT group_id, count(DISTINCT path) AS n FROM items GROUP BY group_id)
SELECT DISTINCT h.group_id FROM (SELECT group_id, entry_id, count(DISTINCT path) AS c FROM items JOIN (SELECT DISTINCT * FROM blacklist) USING (path)
 GROUP BY group_id, entry_id) h JOIN n ON h.group_id = n.group_id AND c = n""")
def _blacklisted(spark, sf):
    i = V.items(spark, sf)
    return graph.blacklisted_groups(i, blacklist(i))


@query("mark_not_a_match", O.with_(O.ITEMS, BLACKLIST) + """SELECT 'rest' AS part, group_id AS id, path FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n
 FROM items WHERE group_id % 10 <> 7) WHERE n > 1
UNION ALL SELECT 'blacklist', entry_id, path FROM blacklist
UNION ALL SELECT 'blacklist', group_id + 1000000, path FROM items WHERE group_id % 10 = 7""")
def _not_a_match(spark, sf):
    i = V.items(spark, sf)
    marked = i.where("group_id % 10 = 7").select("group_id", (F.col("group_id") + 1000000).alias("entry_id")).distinct()
    rest, grown = graph.mark_not_a_match(i, blacklist(i), marked)
    return rest.select(F.lit("rest").alias("part"), F.col("group_id").alias("id"), "path").unionByName(
        grown.select(F.lit("blacklist").alias("part"), F.col("entry_id").alias("id"), "path"))


@query("prune_blacklist", O.with_(O.ITEMS, BLACKLIST) + """, gone AS (SELECT DISTINCT entry_id FROM blacklist WHERE path NOT IN (SELECT path FROM items WHERE present))
SELECT 'pruned' AS op, entry_id, path FROM blacklist WHERE entry_id NOT IN (SELECT entry_id FROM gone)
UNION ALL SELECT 'unmarked', entry_id, path FROM blacklist WHERE entry_id % 5 <> 0""")
def _prune_blacklist(spark, sf):
    i = V.items(spark, sf)
    b = blacklist(i)
    drop = b.where("entry_id % 5 = 0").select("entry_id").distinct()
    return graph.prune_blacklist(b, i.where("present")).withColumn("op", F.lit("pruned")).unionByName(
        graph.unmark(b, drop).withColumn("op", F.lit("unmarked")))
