"""From features to compact similarity edges.

Files with equal features form a *class*. Only one file per class takes part in the pair joins;
the other members are tied to it by star edges. The edge list is therefore linear in the number
of copies, while its connected components are those of the full pair graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorset.config import MatchConfig
from mirrorset.functions import vectors
from mirrorset.functions.frames import flip_rows, masked_mean_batch, phash_batch, sad_batch
from mirrorset.functions.paths import folder_suffix
from mirrorset.operators import blocking as B
from mirrorset.runtime import cut_lineage
from mirrorset.schema import BRIGHTNESS_SCALE, MATCH_FLAGS


# --- verdicts on pairs that carry a_* / b_* feature columns -----------------------------------

def gray_verdict(pairs: DataFrame, cfg: MatchConfig, k: int, pixels: int) -> DataFrame:
    """Adds ``gray_diff`` (null unless within the limit)."""
    if cfg.ignore_black or cfg.ignore_white:
        total = masked_mean_batch(k, cfg.ignore_black, cfg.ignore_white)(F.col("a_gray"), F.col("b_gray"))
        checked = pairs.withColumn("_t", total)
        return checked.withColumn("gray_diff", F.when(
            F.col("_t") <= F.lit(cfg.gray_fraction * k), F.col("_t") / k)).drop("_t")
    checked = pairs.withColumn("_sad", sad_batch(F.col("a_gray"), F.col("b_gray")))
    return checked.withColumn("gray_diff", F.when(
        F.col("_sad") <= cfg.gray_limit(pixels, k),
        F.col("_sad") / F.lit(float(k * pixels * BRIGHTNESS_SCALE)))).drop("_sad")


def phash_verdict(pairs: DataFrame, cfg: MatchConfig, k: int) -> DataFrame:
    """Adds ``phash_diff`` (null unless the quorum is met)."""
    need, bits = cfg.required_positions(k), cfg.max_bits
    dist = [F.bit_count(F.get("a_phashes", F.lit(p)).bitwiseXOR(F.get("b_phashes", F.lit(p))))
            for p in range(k)]
    passed = sum((d <= bits).cast("int") for d in dist)
    return pairs.withColumn("phash_diff", F.when(
        passed >= need, sum(dist) / F.lit(64.0 * k)))


def classic_verdict(pairs: DataFrame, cfg: MatchConfig, k: int, pixels: int) -> DataFrame:
    """Adds ``difference`` (null = no match) and ``flags`` of the classic algorithms.

    Images always compare by gray; videos by gray, by hash, or by either in combined mode.
    """
    image = F.col("a_is_image")
    if cfg.combine_gray_and_phash:
        p = phash_verdict(gray_verdict(pairs, cfg, k, pixels), cfg, k) \
            .withColumn("phash_diff", F.when(~image, F.col("phash_diff")))
        flags = (F.when(F.col("gray_diff").isNotNull(), MATCH_FLAGS["grayscale_matched"]).otherwise(0)
                 + F.when(F.col("phash_diff").isNotNull(), MATCH_FLAGS["phash_matched"]).otherwise(0))
        out = p.withColumn("difference", F.least("gray_diff", "phash_diff")) \
            .withColumn("flags", flags.cast("int"))
    elif cfg.use_phash:
        p = phash_verdict(gray_verdict(pairs, cfg, k, pixels), cfg, k)
        out = p.withColumn("difference", F.when(image, F.col("gray_diff")).otherwise(
            F.col("phash_diff"))).withColumn("flags", F.lit(0))
    else:
        out = gray_verdict(pairs, cfg, k, pixels).withColumn(
            "difference", F.col("gray_diff")).withColumn("flags", F.lit(0))
    return out.drop("gray_diff", "phash_diff")


def ai_similarity(pairs: DataFrame, emb: DataFrame, k: int) -> DataFrame:
    """(src, dst, ai_sim): mean cosine over positions usable on both sides, if at least half are.

    ``emb`` has file_id, pos_idx, q, bright.
    """
    usable = emb.where("bright AND q IS NOT NULL")
    a = usable.select(F.col("file_id").alias("src"), "pos_idx", F.col("q").alias("qa"))
    b = usable.select(F.col("file_id").alias("dst"), "pos_idx", F.col("q").alias("qb"))
    cosine = vectors.clamp_cosine(F.col("dot"))
    need = max(1, (k + 1) // 2)
    return pairs.select("src", "dst").join(a, "src").join(b, ["dst", "pos_idx"]) \
        .withColumn("dot", vectors.dot_batch("qa", "qb")) \
        .groupBy("src", "dst").agg(F.avg(cosine).alias("ai_sim"), F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") >= need).drop("n")


def flipped(features: DataFrame, k: int, side: int, frame_hash=None) -> DataFrame:
    """Mirrored frames (all positions) and their hashes.

    ``frame_hash`` is the hash that made the table's ``phashes``, a function of a frame column; by
    default the cosine-transform hash.
    """
    n, frame_hash = side * side, frame_hash or phash_batch()
    parts = [flip_rows(F.slice("gray", p * n + 1, n), side) for p in range(k)]
    out = features.withColumn("_parts", F.array(*parts)).withColumn("gray", F.flatten("_parts"))
    return out.withColumn("phashes", F.array(*[frame_hash(F.get("_parts", F.lit(p))) for p in range(k)])) \
        .drop("_parts", *B.SUMS)


# --- classes of equal features ----------------------------------------------------------------

def _digest(columns: list[Column]) -> Column:
    """128-bit key of several columns; nulls and null elements count as values of their own."""
    seen = [c.isNull().cast("int") for c in columns]
    return F.concat(*[F.hex(F.xxhash64(F.lit(i), *columns, *seen)) for i in (1, 2)])


def _embedding_keys(emb: DataFrame) -> DataFrame:
    """(file_id, emb_key): equal for files with equal usable embeddings."""
    usable = emb.where("bright AND q IS NOT NULL")
    return usable.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct(
        "pos_idx", _digest([F.col("q")]).alias("d")))).alias("_e")).select("file_id", F.to_json("_e").alias("emb_key"))


def with_class(features: DataFrame, cfg: MatchConfig, emb: DataFrame | None = None) -> DataFrame:
    """Adds ``class_key`` (equal features, type, duration, folder key, embeddings) and ``unit_key``.

    Members of one unit never match each other: same folder in different-folder mode, same
    hard-linked file when hard links are excluded.
    """
    known = F.transform("phashes", lambda x: x.isNull().cast("int"))
    parts = [F.col("is_image"), F.col("duration_s"), F.col("gray"), F.col("phashes"), known]
    if cfg.use_ai and emb is not None:
        features = features.drop("emb_key").join(_embedding_keys(emb), "file_id", "left")
        parts.append(F.col("emb_key"))
    if cfg.folder_mode == "same":
        parts.append(folder_suffix("folder", cfg.folder_depth))
    folder = folder_suffix("folder", cfg.folder_depth) if cfg.folder_mode == "different" else F.lit("")
    link = F.concat_ws(":", "size", "dev", "inode") if cfg.exclude_hardlinks else F.lit("")
    return features.withColumn("class_key", _digest(parts)) \
        .withColumn("unit_key", F.struct(F.coalesce(folder, F.lit("")).alias("folder"), link.alias("link"))).drop("emb_key")


def prepare(features: DataFrame, cfg: MatchConfig, side: int, emb: DataFrame | None = None) -> DataFrame:
    """Store the feature table once with class keys and grid sums; all joins start from it."""
    return cut_lineage(B.with_sums(with_class(features, cfg, emb), side), "features")


def class_reps(prepared: DataFrame) -> DataFrame:
    """The smallest file of every class of equal features."""
    first = prepared.groupBy("class_key").agg(F.min("file_id").alias("file_id"))
    return prepared.join(first.select("file_id"), "file_id", "left_semi")


def _gated(cfg: MatchConfig) -> bool:
    return cfg.folder_mode == "different" or cfg.exclude_hardlinks


def _compatible(a: str, b: str, cfg: MatchConfig) -> Column:
    """Whether two unit keys may match: every gated part must differ."""
    ok = F.lit(True)
    for part, on in (("folder", cfg.folder_mode == "different"), ("link", cfg.exclude_hardlinks)):
        if on:
            ok = ok & (F.col(f"{a}.{part}") != F.col(f"{b}.{part}"))
    return ok


def class_stars(members: DataFrame, cfg: MatchConfig) -> tuple[DataFrame, DataFrame]:
    """(classes, star edges). ``members``: file_id, class_key, unit_key.

    classes: class_key, r1, u1, r2, u2, where r1 is the smallest member and r2 the smallest one
    r1 may match (null if none). Star edges (class_key, src, dst) tie every member to one it may match.
    """
    units = members.groupBy("class_key", "unit_key").agg(F.min("file_id").alias("first_id"))
    one = units.groupBy("class_key").agg(F.min(F.struct("first_id", "unit_key")).alias("m")) \
        .select("class_key", F.col("m.first_id").alias("r1"), F.col("m.unit_key").alias("u1"))
    if not _gated(cfg):
        classes = one.withColumn("r2", F.lit(None).cast("bigint")).withColumn("u2", F.when(F.lit(False), F.col("u1")))
        stars = members.join(one, "class_key").where(F.col("file_id") != F.col("r1")) \
            .select("class_key", F.col("r1").alias("src"), F.col("file_id").alias("dst"))
        return classes, stars
    two = units.join(one, "class_key").where(_compatible("unit_key", "u1", cfg)) \
        .groupBy("class_key").agg(F.min(F.struct("first_id", "unit_key")).alias("m")) \
        .select("class_key", F.col("m.first_id").alias("r2"), F.col("m.unit_key").alias("u2"))
    classes = one.join(two, "class_key", "left")
    tied = members.join(classes, "class_key").where(F.col("file_id") != F.col("r1")) \
        .withColumn("mate", F.when(_compatible("unit_key", "u1", cfg), F.col("r1")).when(
            _compatible("unit_key", "u2", cfg), F.col("r2")))
    stars = tied.where("mate IS NOT NULL").select("class_key", "file_id", "mate")
    if cfg.folder_mode == "different" and cfg.exclude_hardlinks:
        # Both gates at once: a unit that may match neither r1 nor r2 looks for any other unit.
        left = tied.where("mate IS NULL").select("class_key", "unit_key").distinct()
        others = units.select("class_key", F.col("unit_key").alias("other"), "first_id")
        found = left.join(others, "class_key").where(_compatible("unit_key", "other", cfg)) \
            .groupBy("class_key", "unit_key").agg(F.min("first_id").alias("mate"))
        rest = tied.where("mate IS NULL").drop("mate").join(found, ["class_key", "unit_key"]) \
            .select("class_key", "file_id", "mate")
        stars = stars.unionByName(rest)
    return classes, stars.select("class_key", F.least("file_id", "mate").alias("src"),
                                 F.greatest("file_id", "mate").alias("dst"))


def _self_verdict(reps: DataFrame, cfg: MatchConfig, k: int, side: int, emb: DataFrame | None) -> DataFrame:
    """(class_key, difference, flags) of classes whose copies match each other.

    A representative is compared with itself by the same rules as any pair: fully masked frames do not
    match, and copies carry the flags of the algorithms that accept them.
    """
    cols = ["gray", "phashes", "is_image"]
    own = reps.select("class_key", F.col("file_id").alias("src"), F.col("file_id").alias("dst"),
                      *[F.col(c).alias(f"{x}_{c}") for c in cols for x in "ab"])
    seen = classic_verdict(own, cfg, k, side * side).select("class_key", "src", "dst", "difference", "flags")
    if cfg.use_ai and emb is not None:
        ai = ai_similarity(own, emb, k).where(F.col("ai_sim") >= cfg.ai_threshold)
        seen = seen.join(ai, ["src", "dst"], "left")
        only_ai = F.col("difference").isNull() & F.col("ai_sim").isNotNull()
        seen = seen.withColumn("flags", F.when(only_ai, MATCH_FLAGS["ai_matched"]).otherwise(F.col("flags")).cast("int")) \
            .withColumn("difference", F.when(only_ai, 1 - F.col("ai_sim")).otherwise(F.col("difference")))
    return seen.where("difference IS NOT NULL").select("class_key", "difference", "flags")


def class_pairs(reps: DataFrame, cfg: MatchConfig, k: int, side: int,
                emb: DataFrame | None = None, left: DataFrame | None = None,
                order: Column | None = None, forest: bool = False) -> DataFrame:
    """(src, dst, difference, flags) of matching class representatives, normal orientation.

    With ``forest`` only as many of the pairs that match by gray as keep all components and every file's least
    difference; not in combined mode.
    """
    pixels, lhs = side * side, reps if left is None else left
    if cfg.ignore_black or cfg.ignore_white:
        cand = B.masked_candidates(lhs, reps, cfg, k, side, order)
        wide = B.with_pair_columns(cand, lhs, reps, ["gray", "phashes", "is_image"])
        return classic_verdict(wide, cfg, k, pixels).where("difference IS NOT NULL") \
            .select("src", "dst", "difference", "flags")
    only_hash = cfg.use_phash and not cfg.combine_gray_and_phash
    gray_right = reps.where("is_image") if only_hash else reps
    gray_left = gray_right if left is None else lhs.where("is_image") if only_hash else lhs
    by_gray = B.gray_pairs(gray_left, gray_right, cfg, k, side, order is None, forest and not cfg.combine_gray_and_phash).select(
        "src", "dst", (F.col("sad") / F.lit(float(k * pixels * BRIGHTNESS_SCALE))).alias("difference"))
    if not (cfg.use_phash or cfg.combine_gray_and_phash):
        return by_gray.withColumn("flags", F.lit(0))
    by_hash = B.phash_pairs(lhs, reps, cfg, k, order)
    if only_hash:
        return by_gray.unionByName(by_hash).withColumn("flags", F.lit(0))
    either = by_gray.withColumn("flags", F.lit(MATCH_FLAGS["grayscale_matched"])).unionByName(
        by_hash.withColumn("flags", F.lit(MATCH_FLAGS["phash_matched"])))
    return either.groupBy("src", "dst").agg(F.min("difference").alias("difference"), F.sum("flags").cast("int").alias("flags"))


def _all_pairs(reps: DataFrame, cfg: MatchConfig, k: int, side: int, emb: DataFrame | None, frame_hash=None,
               left: DataFrame | None = None, order: Column | None = None, forest: bool = False) -> DataFrame:
    """Class pairs by every switched-on rule: classic, else AI, with the better orientation."""
    edges = class_pairs(reps, cfg, k, side, left=left, order=order, forest=forest)
    lhs = reps if left is None else left
    if cfg.use_ai and emb is not None:
        ai = B.embedding_pairs(lhs, reps, emb, cfg, k, ordered=order is None).select(
            "src", "dst", (1 - F.col("ai_sim")).alias("difference"),
            F.lit(MATCH_FLAGS["ai_matched"]).alias("flags"))
        edges = edges.unionByName(ai.join(edges, ["src", "dst"], "left_anti"))
    if cfg.compare_flipped:
        edges = better_orientation(edges, class_pairs(reps, cfg, k, side, left=flipped(lhs, k, side, frame_hash), order=order))
    return edges


def find_edges(features: DataFrame, cfg: MatchConfig, k: int = 1, side: int = 32,
               emb: DataFrame | None = None, frame_hash=None, forest: bool = False) -> DataFrame:
    """Compact similarity edges (src, dst, difference, flags) of a feature table.

    features: file_id, is_image, duration_s, folder, size, dev, inode, gray, phashes. ``frame_hash``: see
    :func:`flipped`. ``forest``: only edges enough for all components and, without gates, every file's least
    difference, where plain gray comparison under at most one gate decides; all edges elsewhere.
    """
    tagged = prepare(features, cfg, side, emb)
    classes, stars = class_stars(tagged.select("file_id", "class_key", "unit_key"), cfg)
    reps = tagged.join(classes.select(F.col("r1").alias("file_id")), "file_id", "left_semi")
    both_gates = cfg.folder_mode == "different" and cfg.exclude_hardlinks
    plain = not (both_gates or cfg.use_ai or cfg.compare_flipped)
    if forest and plain and _gated(cfg):
        # Under one gate a class is connected once it has two units, and all members of a class of one unit may match
        # the same files, so a forest of the classes' allowed pairs has the components of all their pairs.
        part = "folder" if cfg.folder_mode == "different" else "link"
        reps = tagged.join(classes.select(F.col("r1").alias("file_id"), *[F.col(f"{u}.{part}").alias(f"_{u}") for u in ("u1", "u2")]), "file_id")
    edges = _all_pairs(reps, cfg, k, side, emb, frame_hash, forest=forest and plain)
    copied = reps.join(stars.select("class_key").distinct(), "class_key", "left_semi")
    stars = stars.join(_self_verdict(copied, cfg, k, side, emb), "class_key").select("src", "dst", "difference", "flags")
    if not _gated(cfg):
        return edges.unionByName(stars)
    return _gated_class_edges(edges, tagged, classes, cfg).unionByName(stars)


def better_orientation(normal: DataFrame, mirrored: DataFrame) -> DataFrame:
    """The mirrored verdict replaces the normal one when that failed or is worse."""
    m = mirrored.select("src", "dst", F.col("difference").alias("mdiff"),
                        F.col("flags").bitwiseOR(F.lit(MATCH_FLAGS["flipped"])).alias("mflags"))
    use = F.col("difference").isNull() | (F.col("mdiff") < F.col("difference"))
    return normal.join(m, ["src", "dst"], "full").select(
        "src", "dst", F.when(use & F.col("mdiff").isNotNull(), F.col("mdiff")).otherwise(
            F.col("difference")).alias("difference"),
        F.when(use & F.col("mdiff").isNotNull(), F.col("mflags")).otherwise(
            F.col("flags")).cast("int").alias("flags"))


def _gated_class_edges(pairs: DataFrame, tagged: DataFrame, classes: DataFrame,
                       cfg: MatchConfig) -> DataFrame:
    """Turn class-level matches into file edges the gates allow; still linear in the files.

    The first allowed pair of representatives connects two classes. Members of a class that
    cannot match inside their own class are tied to the first partner class they may match.
    """
    a = classes.select(F.col("r1").alias("src"), F.col("u1").alias("a_u1"),
                       F.col("r2").alias("a_r2"), F.col("u2").alias("a_u2"))
    b = classes.select(F.col("r1").alias("dst"), F.col("u1").alias("b_u1"),
                       F.col("r2").alias("b_r2"), F.col("u2").alias("b_u2"))
    wide = pairs.join(a, "src").join(b, "dst")
    options = [("src", "dst", "a_u1", "b_u1"), ("src", "b_r2", "a_u1", "b_u2"),
               ("a_r2", "dst", "a_u2", "b_u1"), ("a_r2", "b_r2", "a_u2", "b_u2")]
    pick = F.coalesce(*[F.when(_compatible(ua, ub, cfg) & F.col(x).isNotNull() & F.col(y).isNotNull(),
                               F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
                        for x, y, ua, ub in options])
    linked = wide.withColumn("p", pick).where("p IS NOT NULL").select(
        F.least("p.x", "p.y").alias("src"), F.greatest("p.x", "p.y").alias("dst"),
        "difference", "flags")
    lonely = tagged.join(classes.where("r2 IS NULL"), "class_key") \
        .where(F.col("file_id") != F.col("r1")).select("file_id", "unit_key", F.col("r1").alias("own"))
    sides = pairs.select(F.col("src").alias("own"), F.col("dst").alias("other"), "difference", "flags") \
        .unionByName(pairs.select(F.col("dst").alias("own"), F.col("src").alias("other"),
                                  "difference", "flags"))
    partner = sides.join(classes.select(F.col("r1").alias("other"), "u1", "r2", "u2"), "other")
    extra = lonely.join(partner, "own").withColumn("mate", F.when(
        _compatible("unit_key", "u1", cfg), F.col("other")).when(
        _compatible("unit_key", "u2", cfg), F.col("r2"))).where("mate IS NOT NULL") \
        .groupBy("file_id").agg(F.min(F.struct("mate", "difference", "flags")).alias("m")) \
        .select(F.least("file_id", "m.mate").alias("src"), F.greatest("file_id", "m.mate").alias("dst"),
                F.col("m.difference").alias("difference"), F.col("m.flags").alias("flags"))
    return linked.unionByName(extra)


def group_links(features: DataFrame, groups: DataFrame, cfg: MatchConfig, k: int = 1, side: int = 32,
                emb: DataFrame | None = None) -> DataFrame:
    """(group_id, src, dst): similar pairs of members of one group, by classic rules or AI, without gates.

    The group takes the place of the folder key, so that candidates come from the same cells as in
    matching and the pairs of a group are never listed as such. ``groups``: file_id, group_id.
    """
    inside = cfg.with_(folder_mode="same", folder_depth=1, exclude_hardlinks=False, compare_flipped=False)
    own = groups.select("file_id", F.concat(F.lit("/g"), F.col("group_id").cast("string")).alias("folder"))
    rows = features.drop("folder", "duration_s").join(own, "file_id").withColumn("duration_s", F.lit(0.0))
    rows = cut_lineage(B.with_sums(rows, side), "members")
    found = _all_pairs(rows, inside, k, side, emb).select("src", "dst").distinct()
    return found.join(groups.select(F.col("file_id").alias("src"), "group_id"), "src").select("group_id", "src", "dst")


def match_against(new: DataFrame, stored: DataFrame, cfg: MatchConfig, k: int = 1, side: int = 32,
                  emb: DataFrame | None = None, frame_hash=None, stored_ready: bool = False) -> DataFrame:
    """New files against the whole stored catalog, missing files with features included.

    (new_id, stored_id, difference, flags) by every rule and gate of the configuration. Classes of equal
    features meet once; a hit of two classes is then given as one row for every new file (with the first
    stored file it may match) and one for every stored file (with the first new one), so no copy on
    either side is left out and the result stays linear in the files. ``stored_ready``: ``stored`` already
    is a table made by :func:`prepare` with this configuration and is not written again.
    """
    n = prepare(new, cfg, side, emb)
    s = stored if stored_ready else prepare(stored, cfg, side, emb)
    left, right = class_reps(n), class_reps(s)
    hits = cut_lineage(_all_pairs(right, cfg, k, side, emb, frame_hash, left=left, order=F.lit(True)), "hits")

    def units(df: DataFrame, x: str) -> DataFrame:
        """First file of every unit of the classes that hit."""
        firsts = df.groupBy("class_key", "unit_key").agg(F.min("file_id").alias(x))
        owner = df.groupBy("class_key").agg(F.min("file_id").alias(f"{x}_rep"))
        return firsts.join(owner, "class_key").withColumnsRenamed({"class_key": f"{x}_class", "unit_key": f"{x}_unit"})

    a, b = units(n, "new"), units(s, "old")
    met = hits.withColumnsRenamed({"src": "new_rep", "dst": "old_rep"}).join(a, "new_rep").join(b, "old_rep") \
        .where(_compatible("new_unit", "old_unit", cfg))

    def spread(members: DataFrame, own: str, other: str, name: str, mate: str) -> DataFrame:
        """Every member of ``own`` classes with the first file of ``other`` it may match and is not itself."""
        best = met.groupBy(f"{own}_class", f"{own}_unit", f"{other}_class").agg(
            F.min(F.struct(other, "difference", "flags")).alias("m"), F.max(F.struct(other, "difference", "flags")).alias("z"))
        rows = members.select(F.col("file_id").alias(name), F.col("class_key").alias(f"{own}_class"),
                              F.col("unit_key").alias(f"{own}_unit")).join(best, [f"{own}_class", f"{own}_unit"])
        pick = F.when(F.col(f"m.{other}") != F.col(name), F.col("m")).otherwise(F.col("z"))
        return rows.withColumn("p", pick).where(F.col(f"p.{other}") != F.col(name)).select(
            name, F.col(f"p.{other}").alias(mate), F.col("p.difference").alias("difference"), F.col("p.flags").alias("flags"))

    both = spread(n, "new", "old", "new_id", "stored_id").unionByName(spread(s, "old", "new", "stored_id", "new_id"))
    return both.select("new_id", "stored_id", "difference", "flags").distinct()
