"""Registered queries: pair verdicts, similarity joins, groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirrorset.config import MatchConfig
from mirrorset.functions import bits, frames, vectors
from mirrorset.operators import blocking as B
from mirrorset.operators import graph, matching
from mirrorset.plans import oracle_views as O
from mirrorset.plans import views as V
from mirrorset.plans.registry import query
from mirrorset.runtime import cut_lineage

GRAY = MatchConfig(percent=96.0)
VEC_HASH = MatchConfig(percent=90.0, use_phash=True)      # 6 bits
COMBINED = MatchConfig(percent=96.0, combine_gray_and_phash=True)
K2_HASH = MatchConfig(percent=96.0, use_phash=True, positions=2)

# Brute-force forms of the matching rules on (a, b) rows of ``features``.
SAD = "list_sum(list_transform(list_zip(a.gray, b.gray), lambda x: abs(x[1] - x[2])))::BIGINT"
DUR = "abs(a.duration_s - b.duration_s) <= least(a.duration_s, b.duration_s) * 20.0 / 100.0"
TYPE = "a.is_image = b.is_image"


def classes(extra: str = "") -> str:
    return f"""cls AS (SELECT *, min(file_id) OVER (PARTITION BY is_image, duration_s, gray, phashes{extra}) AS rep
 FROM features),
reps AS (SELECT * FROM cls WHERE file_id = rep)"""


def edges_gray(limit: int, scale: float) -> str:
    return f"""{classes()},
pairs AS (SELECT a.file_id AS src, b.file_id AS dst, {SAD} AS sad FROM reps a JOIN reps b
 ON a.file_id < b.file_id AND {TYPE} AND (a.is_image OR {DUR})),
edges AS (SELECT src, dst, sad / {scale}::DOUBLE AS difference, 0 AS flags FROM pairs WHERE sad <= {limit}
 UNION ALL SELECT rep, file_id, 0::DOUBLE, 0 FROM cls WHERE file_id <> rep)"""


EDGES_DOC = O.features_doc(1) + ",\n" + edges_gray(GRAY.gray_limit(64, 1), 64 * 256)


def doc_edges(spark, sf):
    return doc_match(spark, sf)[1]


def doc_forest(spark, sf):
    """Edges with the components of all edges."""
    return matching.find_edges(V.features_doc(spark, sf, 1), GRAY, k=1, side=V.SIDE, forest=True)


def doc_match(spark, sf):
    """(stored features, stored edges) of the documents."""
    f = cut_lineage(V.features_doc(spark, sf, 1), "features")
    return f, cut_lineage(matching.find_edges(f, GRAY, k=1, side=V.SIDE), "edges")


def out_edges(df):
    return df.select("src", "dst", F.round("difference", 6).alias("difference"), "flags")


@query("gray_diff", O.with_(O.FRAMES_VEC) + f"""
SELECT a.file_id AS src, b.file_id AS dst, {SAD} AS sad, round({SAD} / 16384::DOUBLE, 6) AS difference
FROM frames_vec a JOIN frames_vec b ON a.vec_id = b.vec_id AND a.copy < b.copy""")
def _gray_diff(spark, sf):
    p = planted_pairs(spark, sf)
    return p.select("src", "dst", frames.sad("a_gray", "b_gray").alias("sad"),
                    F.round(frames.gray_diff("a_gray", "b_gray"), 6).alias("difference"))


def planted_pairs(spark, sf):
    f = V.frames_vec(spark, sf)
    a = f.select("vec_id", F.col("file_id").alias("src"), F.col("copy").alias("ca"),
                 F.col("gray").alias("a_gray"), F.col("phash").alias("a_phash"))
    b = f.select("vec_id", F.col("file_id").alias("dst"), F.col("copy").alias("cb"),
                 F.col("gray").alias("b_gray"), F.col("phash").alias("b_phash"))
    return a.join(b, "vec_id").where("ca < cb")


@query("gray_diff_masked", O.with_(O.FRAMES_VEC) + """,
px AS (SELECT a.file_id AS src, b.file_id AS dst, unnest(a.gray) AS x, unnest(b.gray) AS y
 FROM frames_vec a JOIN frames_vec b ON a.vec_id = b.vec_id AND a.copy < b.copy)
SELECT src, dst, round(sum(CASE WHEN x > 128 - 96 AND y > 32 AND x < 240 AND y < 240 THEN abs(x - y) END)
 / (nullif(count(*) FILTER (WHERE x > 32 AND y > 32 AND x < 240 AND y < 240), 0) * 256)::DOUBLE, 6) AS difference
FROM px GROUP BY src, dst""")
def _gray_diff_masked(spark, sf):
    p = planted_pairs(spark, sf)
    return p.select("src", "dst", F.round(frames.gray_diff_masked(
        "a_gray", "b_gray", True, True), 6).alias("difference"))


@query("phash_similarity", O.with_(O.FRAMES_VEC) + f"""
SELECT a.file_id AS src, b.file_id AS dst, bit_count(xor(a.phash, b.phash))::INT AS bits,
 round(1 - bit_count(xor(a.phash, b.phash)) / 64::DOUBLE, 6) AS similarity,
 bit_count(xor(a.phash, b.phash)) <= {GRAY.max_bits} AS pass
FROM frames_vec a JOIN frames_vec b ON a.vec_id = b.vec_id AND a.copy < b.copy""")
def _phash_similarity(spark, sf):
    d = bits.hamming("a_phash", "b_phash")
    return planted_pairs(spark, sf).select(
        "src", "dst", d.alias("bits"), F.round(1 - d / 64.0, 6).alias("similarity"),
        (d <= GRAY.max_bits).alias("pass"))


@query("int8_cosine", O.with_(O.EMB) + """
SELECT a.file_id AS src, b.file_id AS dst,
 round(greatest(-1, least(1, list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2])) / 16129::DOUBLE)), 6) AS cosine
FROM emb a JOIN emb b ON a.vec_id = b.vec_id AND a.copy < b.copy""")
def _int8_cosine(spark, sf):
    e = cut_lineage(V.emb(spark, sf), "emb")
    a = e.select("vec_id", F.col("file_id").alias("src"), F.col("copy").alias("ca"), F.col("q").alias("qa"))
    b = e.select("vec_id", F.col("file_id").alias("dst"), F.col("copy").alias("cb"), F.col("q").alias("qb"))
    return a.join(b, "vec_id").where("ca < cb").select(
        "src", "dst", F.round(vectors.int8_cosine("qa", "qb"), 6).alias("cosine"))


@query("duration_tolerance", O.with_(O.CATALOG) + """
SELECT file_id, round(duration_s * 20.0 / 100.0, 6) AS plain,
 round(least(greatest(duration_s * 1.0 / 100.0, 5), 10), 6) AS clamped, 15::DOUBLE AS flat FROM catalog""")
def _duration_tolerance(spark, sf):
    c = MatchConfig()
    return V.catalog(spark, sf).select(
        "file_id", F.round(B.tolerance("duration_s", c), 6).alias("plain"),
        F.round(B.tolerance("duration_s", c.with_(duration_percent=1.0, duration_min_s=5.0,
                                                  duration_max_s=10.0)), 6).alias("clamped"),
        B.tolerance("duration_s", c.with_(duration_percent=0.0, duration_min_s=5.0,
                                          duration_max_s=15.0)).alias("flat"))


@query("pairs_by_duration", O.with_(O.CATALOG) + """,
d AS (SELECT is_image, duration_s, count(*) AS n FROM catalog GROUP BY ALL)
SELECT a.is_image, a.duration_s, (sum(b.n) - 1)::BIGINT AS partners
FROM d a JOIN d b ON a.is_image = b.is_image AND (a.is_image OR
 abs(a.duration_s - b.duration_s) <= least(a.duration_s, b.duration_s) * 20.0 / 100.0)
GROUP BY a.is_image, a.duration_s""")
def _pairs_by_duration(spark, sf):
    """Partners per distinct duration: the band join runs on distinct values, never on files."""
    d = V.catalog(spark, sf).groupBy("is_image", "duration_s").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.xxhash64("is_image", "duration_s").alias("file_id"), F.lit("/").alias("folder"),
                "is_image", "duration_s", "n")
    cfg = MatchConfig()
    l = B.widen_duration(B.base_cells(d, cfg), cfg)
    return B.cell_join(l, B.base_cells(d, cfg), B.BASE_KEYS, B.video_or_gate(cfg)) \
        .groupBy("l.is_image", "l.duration_s").agg((F.sum("r.n") - 1).alias("partners"))


@query("phash_join", O.with_(O.FRAMES_VEC) + f"""
SELECT a.file_id AS src, b.file_id AS dst, round(bit_count(xor(a.phash, b.phash)) / 64::DOUBLE, 6) AS difference
FROM frames_vec a JOIN frames_vec b ON a.file_id < b.file_id AND {DUR}
 AND bit_count(xor(a.phash, b.phash)) <= {VEC_HASH.max_bits}""")
def _phash_join(spark, sf):
    f = cut_lineage(V.features_vec(spark, sf), "features")
    return B.phash_pairs(f, f, VEC_HASH, 1).select(
        "src", "dst", F.round("difference", 6).alias("difference"))


@query("phash_quorum_join", O.with_(O.features_doc(2)) + f""", {classes()},
x AS (SELECT a.file_id AS src, b.file_id AS dst, bit_count(xor(a.phashes[1], b.phashes[1])) AS d1,
  bit_count(xor(a.phashes[2], b.phashes[2])) AS d2
 FROM reps a JOIN reps b ON a.file_id < b.file_id AND NOT a.is_image AND NOT b.is_image AND {DUR})
SELECT src, dst, round((d1 + d2) / 128::DOUBLE, 6) AS difference FROM x
WHERE (d1 <= {K2_HASH.max_bits})::INT + (d2 <= {K2_HASH.max_bits})::INT >= {K2_HASH.required_positions(2)}""")
def _phash_quorum_join(spark, sf):
    reps = matching.class_reps(matching.prepare(V.features_doc(spark, sf, 2), K2_HASH, V.SIDE))
    return B.phash_pairs(reps, reps, K2_HASH, 2).select(
        "src", "dst", F.round("difference", 6).alias("difference"))


@query("gray_join", O.with_(O.FRAMES_VEC) + f"""
SELECT a.file_id AS src, b.file_id AS dst, round({SAD} / 16384::DOUBLE, 6) AS difference
FROM frames_vec a JOIN frames_vec b ON a.file_id < b.file_id AND {DUR} AND {SAD} <= {GRAY.gray_limit(64, 1)}""")
def _gray_join(spark, sf):
    f = cut_lineage(B.with_sums(V.features_vec(spark, sf), V.SIDE), "features")
    return matching.class_pairs(f, GRAY, 1, V.SIDE).select("src", "dst", F.round("difference", 6).alias("difference"))


@query("gray_verdict", O.with_(O.features_doc(2)) + f""", {classes()}
SELECT a.file_id AS src, b.file_id AS dst, round({SAD} / 32768::DOUBLE, 6) AS difference
FROM reps a JOIN reps b ON a.file_id < b.file_id AND {TYPE} AND (a.is_image OR {DUR})
WHERE {SAD} <= {GRAY.gray_limit(64, 2)}""")
def _gray_verdict(spark, sf):
    reps = matching.class_reps(matching.prepare(V.features_doc(spark, sf, 2), GRAY, V.SIDE))
    return matching.class_pairs(reps, GRAY, 2, V.SIDE).select(
        "src", "dst", F.round("difference", 6).alias("difference"))


@query("combined_verdict", O.with_(O.features_doc(1)) + f""", {classes()},
x AS (SELECT a.file_id AS src, b.file_id AS dst, a.is_image, {SAD} AS sad,
  bit_count(xor(a.phashes[1], b.phashes[1])) AS d
 FROM reps a JOIN reps b ON a.file_id < b.file_id AND {TYPE} AND (a.is_image OR {DUR})),
v AS (SELECT *, sad <= {COMBINED.gray_limit(64, 1)} AS g, NOT is_image AND d <= {COMBINED.max_bits} AS p FROM x)
SELECT src, dst, round(least(CASE WHEN g THEN sad / 16384::DOUBLE END, CASE WHEN p THEN d / 64::DOUBLE END), 6) AS difference,
 (CASE WHEN g THEN 8 ELSE 0 END + CASE WHEN p THEN 16 ELSE 0 END)::INT AS flags
FROM v WHERE g OR p""")
def _combined(spark, sf):
    reps = matching.class_reps(matching.prepare(V.features_doc(spark, sf, 1), COMBINED, V.SIDE))
    return out_edges(matching.class_pairs(reps, COMBINED, 1, V.SIDE))


FLIP = GRAY.with_(compare_flipped=True)


@query("flip_verdict", O.with_(O.FRAMES_VEC) + f""",
flip AS (SELECT file_id, list_transform(range(64), lambda i: gray[(i // 8) * 8 + 8 - i % 8]) AS gray FROM frames_vec),
x AS (SELECT a.file_id AS src, b.file_id AS dst, {SAD} AS sad,
  list_sum(list_transform(list_zip(f.gray, b.gray), lambda x: abs(x[1] - x[2])))::BIGINT AS fsad
 FROM frames_vec a JOIN flip f ON f.file_id = a.file_id JOIN frames_vec b ON a.file_id < b.file_id AND {DUR}),
v AS (SELECT src, dst, CASE WHEN sad <= 655 THEN sad END AS n, CASE WHEN fsad <= 655 THEN fsad END AS f FROM x)
SELECT src, dst, round(CASE WHEN n IS NULL OR f < n THEN f ELSE n END / 16384::DOUBLE, 6) AS difference,
 (CASE WHEN n IS NULL OR f < n THEN 1 ELSE 0 END)::INT AS flags
FROM v WHERE n IS NOT NULL OR f IS NOT NULL""")
def _flip(spark, sf):
    f = cut_lineage(B.with_sums(V.features_vec(spark, sf), V.SIDE), "features")
    normal = matching.class_pairs(f, FLIP, 1, V.SIDE)
    mirrored = matching.class_pairs(f, FLIP, 1, V.SIDE, left=matching.flipped(f, 1, V.SIDE, frames.median_bits))
    return out_edges(matching.better_orientation(normal, mirrored))


AI = MatchConfig(use_ai=True, ai_percent=94.0)
COS = "greatest(-1, least(1, list_sum(list_transform(list_zip(x.q, y.q), lambda t: t[1] * t[2])) / 16129::DOUBLE))"


@query("embedding_join", O.with_(O.EMB) + f"""
SELECT x.file_id AS src, y.file_id AS dst, round({COS}, 6) AS ai_sim FROM emb x JOIN emb y
 ON x.file_id < y.file_id AND abs(x.duration_s - y.duration_s) <= least(x.duration_s, y.duration_s) * 20.0 / 100.0
WHERE {COS} >= {AI.ai_threshold!r}""")
def _embedding_join(spark, sf):
    e = cut_lineage(V.emb(spark, sf), "emb")
    files = e.select("file_id", F.lit(False).alias("is_image"), "duration_s", F.lit("/v").alias("folder"))
    long = e.select("file_id", F.lit(0).alias("pos_idx"), "q", F.lit(True).alias("bright"))
    return B.embedding_pairs(files, files, long, AI, 1).select(
        "src", "dst", F.round("ai_sim", 6).alias("ai_sim"))


@query("ai_similarity", O.with_(O.EMB) + f"""
SELECT x.file_id AS src, y.file_id AS dst, round({COS}, 6) AS ai_sim FROM emb x JOIN emb y ON x.vec_id = y.vec_id AND x.copy < y.copy
WHERE x.vec_id % 7 <> 0""")
def _ai_similarity(spark, sf):
    e = V.emb(spark, sf)
    long = e.select("file_id", F.lit(0).alias("pos_idx"), "q", (F.col("vec_id") % 7 != 0).alias("bright"))
    a = e.select("vec_id", F.col("file_id").alias("src"), F.col("copy").alias("ca"))
    b = e.select("vec_id", F.col("file_id").alias("dst"), F.col("copy").alias("cb"))
    pairs = a.join(b, "vec_id").where("ca < cb").select("src", "dst")
    return matching.ai_similarity(pairs, long, 1).withColumn("ai_sim", F.round("ai_sim", 6))


@query("union_verdict", O.with_(O.FRAMES_VEC, O.EMB) + f""",
c AS (SELECT a.file_id AS src, b.file_id AS dst, {SAD} AS sad, {COS} AS cos
 FROM frames_vec a JOIN frames_vec b ON a.file_id < b.file_id AND {DUR}
 JOIN emb x ON x.file_id = a.file_id JOIN emb y ON y.file_id = b.file_id)
SELECT src, dst, round(CASE WHEN sad <= 655 THEN sad / 16384::DOUBLE ELSE 1 - cos END, 6) AS difference,
 (CASE WHEN sad <= 655 THEN 0 ELSE 4 END)::INT AS flags
FROM c WHERE sad <= 655 OR cos >= {AI.ai_threshold!r}""")
def _union(spark, sf):
    e = V.emb(spark, sf).select("file_id", F.lit(0).alias("pos_idx"), "q", F.lit(True).alias("bright"))
    return out_edges(matching.find_edges(V.features_vec(spark, sf), AI, 1, V.SIDE, emb=e))


@query("find_duplicates", O.with_(EDGES_DOC) + """
SELECT src, dst, round(difference, 6) AS difference, flags FROM edges""")
def _find_duplicates(spark, sf):
    return out_edges(doc_edges(spark, sf))


SAME = GRAY.with_(folder_mode="same", folder_depth=2)


@query("folder_gate", O.with_(O.features_doc(1)) + f""", {classes(", folder")},
pairs AS (SELECT a.file_id AS src, b.file_id AS dst, {SAD} AS sad FROM reps a JOIN reps b
 ON a.file_id < b.file_id AND {TYPE} AND a.folder = b.folder AND (a.is_image OR {DUR}))
SELECT src, dst, round(sad / 16384::DOUBLE, 6) AS difference, 0 AS flags FROM pairs WHERE sad <= 655
UNION ALL SELECT rep, file_id, 0::DOUBLE, 0 FROM cls WHERE file_id <> rep""")
def _folder_gate(spark, sf):
    return out_edges(matching.find_edges(V.features_doc(spark, sf, 1), SAME, 1, V.SIDE))


DIFFERENT = GRAY.with_(folder_mode="different", folder_depth=2)


@query("different_folder_groups", O.with_(O.features_doc(1), recursive=True) + f""",
e AS (SELECT a.file_id AS s, b.file_id AS t FROM features a JOIN features b
 ON a.file_id <> b.file_id AND {TYPE} AND a.folder <> b.folder AND (a.is_image OR {DUR}) AND {SAD} <= 655),
r(n, m) AS (SELECT s, s FROM e UNION SELECT e.t, r.m FROM r JOIN e ON r.n = e.s)
SELECT n AS file_id, min(m) AS group_id FROM r GROUP BY n""")
def _different_folder(spark, sf):
    return graph.components(matching.find_edges(V.features_doc(spark, sf, 1), DIFFERENT, 1, V.SIDE, forest=True))


NO_LINKS = GRAY.with_(exclude_hardlinks=True)


@query("hardlink_gate", O.with_(O.features_doc(1), recursive=True) + f""",
e AS (SELECT a.file_id AS s, b.file_id AS t FROM features a JOIN features b
 ON a.file_id <> b.file_id AND {TYPE} AND NOT (a.size = b.size AND a.dev = b.dev AND a.inode = b.inode
  AND (a.is_image OR a.duration_s = b.duration_s)) AND (a.is_image OR {DUR}) AND {SAD} <= 655),
r(n, m) AS (SELECT s, s FROM e UNION SELECT e.t, r.m FROM r JOIN e ON r.n = e.s)
SELECT n AS file_id, min(m) AS group_id FROM r GROUP BY n""")
def _hardlink(spark, sf):
    return graph.components(matching.find_edges(V.features_doc(spark, sf, 1), NO_LINKS, 1, V.SIDE, forest=True))


@query("match_against", O.with_(O.features_doc(1)) + f""",
cls AS (SELECT *, min(file_id) OVER (PARTITION BY is_image, duration_s, gray, phashes, file_id % 10 = 3) AS rep FROM features)
SELECT a.file_id AS new_id, b.file_id AS stored_id, round({SAD} / 16384::DOUBLE, 6) AS difference, 0 AS flags
FROM cls a JOIN cls b ON a.file_id % 10 = 3 AND b.file_id % 10 <> 3 AND {TYPE} AND (a.is_image OR {DUR}) AND {SAD} <= 655
WHERE a.file_id = a.rep OR b.file_id = b.rep""")
def _match_against(spark, sf):
    return _against(spark, sf, GRAY)


def _against(spark, sf, cfg, emb=None):
    f = cut_lineage(V.features_doc(spark, sf, 1), "features")
    return matching.match_against(f.where("file_id % 10 = 3"), f.where("file_id % 10 <> 3"), cfg, 1, V.SIDE, emb, frames.median_bits) \
        .select("new_id", "stored_id", F.round("difference", 6).alias("difference"), "flags")


COMPONENTS = """r(n, m) AS (SELECT src, src FROM edges UNION SELECT dst, dst FROM edges
 UNION SELECT CASE WHEN r.n = e.src THEN e.dst ELSE e.src END, r.m FROM r JOIN edges e ON r.n = e.src OR r.n = e.dst),
grp AS (SELECT n AS file_id, min(m) AS group_id FROM r GROUP BY n)"""


@query("components", O.with_(EDGES_DOC, COMPONENTS, recursive=True) + "SELECT file_id, group_id FROM grp")
def _components(spark, sf):
    return graph.components(doc_forest(spark, sf))


@query("degrees", O.with_(EDGES_DOC) + """
SELECT file_id, count(*) AS degree FROM (SELECT src AS file_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY file_id""")
def _degrees(spark, sf):
    return graph.degrees(doc_edges(spark, sf))


@query("group_stats", O.with_(EDGES_DOC, COMPONENTS, recursive=True) + """,
s AS (SELECT count(*) AS n FROM grp GROUP BY group_id)
SELECT count(*) AS groups, sum(n)::BIGINT AS items, round(avg(n), 1) AS avg_size, max(n) AS max_size,
 count(*) FILTER (WHERE n > 5) AS over_5, count(*) FILTER (WHERE n > 10) AS over_10 FROM s""")
def _group_stats(spark, sf):
    return graph.group_stats(graph.components(doc_forest(spark, sf)))


def pair_verdict(features, cfg=GRAY, k=1, pixels=V.PIXELS):
    """Ungated visual verdict of (src, dst) rows."""

    def run(pairs):
        wide = B.with_pair_columns(pairs, features, features, ["gray", "phashes", "is_image"])
        return matching.classic_verdict(wide, cfg, k, pixels).where("difference IS NOT NULL") \
            .select(*pairs.columns)

    return run


@query("component_verdicts", O.with_(EDGES_DOC, COMPONENTS, recursive=True) + f""",
m AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM grp)
SELECT x.group_id, a.file_id AS src, b.file_id AS dst FROM m x JOIN m y ON x.group_id = y.group_id
 AND x.file_id < y.file_id AND x.n >= 3
JOIN features a ON a.file_id = x.file_id JOIN features b ON b.file_id = y.file_id WHERE {SAD} <= 655""")
def _component_verdicts(spark, sf):
    f, e = doc_match(spark, sf)
    g = graph.components(e)
    large = g.join(g.groupBy("group_id").count().where("count >= 3"), "group_id", "left_semi")
    return matching.group_links(f, large, GRAY, 1, V.SIDE)


@query("merge_groups")
def _merge_groups(spark, sf):
    f, e = doc_match(spark, sf)
    groups = graph.merge_groups(e, pair_verdict(f))
    return graph.founding_rows(groups, e)


@query("majority_prune")
def _majority_prune(spark, sf):
    f, e = doc_match(spark, sf)
    g = graph.components(e)
    return graph.majority_prune(g, matching.group_links(f, g, GRAY, 1, V.SIDE))
