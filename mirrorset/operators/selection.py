"""Which rows of a group to mark: deletion strategies, rules, custom selections, plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorset.functions import media, paths
from mirrorset.functions.bits import has_flag
from mirrorset.operators import ranking
from mirrorset.operators.grouping import attach, mark_first, newest_first, numbered, running_max
from mirrorset.runtime import cut_lineage
from mirrorset.schema import MATCH_FLAGS

KEY = ["group_id", "item_id"]


def _rest(items: DataFrame, order: list[Column]) -> DataFrame:
    """Everything but the first row of each group of two or more."""
    return mark_first(items, "group_id", order, "item_id", "_keep", (F.count(F.lit(1)).alias("_n"),)) \
        .where("_n > 1 AND NOT _keep").select(*KEY)


def quality_order() -> list[Column]:
    """Flagged best bitrate, then flagged best resolution, then plain numbers."""
    level = F.when(F.col("is_best_bitrate"), 0).when(F.col("is_best_frame"), 1).otherwise(2)
    plain = [F.when(level == 2, -F.col(c)).otherwise(0).cast("double")
             for c in ("bitrate_kbs", "frame_size_int", "size")]
    return [level, *plain]


def select_for_deletion(flagged: DataFrame, strategy: str) -> DataFrame:
    """(group_id, item_id) to delete; the first row wins ties, single rows are left alone."""
    if strategy == "100-percent-only":
        whole = attach(flagged, "group_id", F.min("similarity").alias("_low")).where("_low >= 100")
        return _rest(whole, quality_order())
    order = {
        "lowest-quality": quality_order(),
        "smallest-file": [-F.col("size")],
        "shortest-duration": [-F.col("duration_s")],
        "worst-resolution": [-F.col("frame_size_int")],
    }[strategy]
    return _rest(flagged, order)


def select_rule(items: DataFrame, scope: DataFrame, protected_dirs: list[str], rule: str) -> DataFrame:
    """Keep protected folders, or the newest/oldest by date; only unprotected rows in scope.

    Groups with an unusable path, or with a missing date under a date rule, are skipped whole.
    """
    return select_rules(items, scope, protected_dirs, [rule]).select(*KEY)


def select_rules(items: DataFrame, scope: DataFrame, protected_dirs: list[str], rules: list[str]) -> DataFrame:
    """(rule, group_id, item_id): :func:`select_rule` for several rules, which share the look at the scope and one table of group facts."""
    dates = list(dict.fromkeys(r.split("-")[2] for r in rules if r != "keep-protected"))
    dated = lambda c: F.col(c).isNotNull() & (F.col(c) > F.lit("0001-01-01").cast("timestamp_ntz"))
    rows = items.select("path", *KEY, *dates).join(scope.select("path").distinct().withColumn("_in", F.lit(True)), "path", "left").select(
        *KEY, *dates, F.coalesce("_in", F.lit(False)).alias("_in"), paths.protected("path", protected_dirs).alias("_prot"),
        paths.valid_path("path").alias("_valid"))
    facts = [F.count(F.lit(1)).alias("_n"), F.bool_or("_in").alias("_any"), F.bool_and("_valid").alias("_ok"), F.bool_or("_prot").alias("_some")]
    for c in dates:
        facts += [F.bool_and(dated(c)).alias(f"_dated_{c}"), F.min(c).alias(f"_oldest_{c}"), F.max(c).alias(f"_newest_{c}")]
    df = attach(cut_lineage(rows, "in-scope"), "group_id", *facts).where("_n > 1 AND _any AND _ok AND _in AND NOT _prot")

    def marked(rule: str) -> Column:
        if rule == "keep-protected":
            return F.col("_some")
        keep, c = rule.split("-")[1:3]
        return F.col(f"_dated_{c}") & (F.col(c) < F.col(f"_newest_{c}") if keep == "newest" else F.col(c) > F.col(f"_oldest_{c}"))

    return df.select(*KEY, F.explode(F.array_compact(F.array(*[F.when(marked(r), F.lit(r)) for r in rules]))).alias("rule")).select("rule", *KEY)


IDENTITY = ["duration_s", "frame_size_int", "format", "audio_format", "audio_channel",
            "audio_sample_rate", "bitrate_kbs", "fps"]


def identity(with_size: bool) -> Column:
    """Null-safe identity of a row inside its group, comparable as one value."""
    cols = (["size"] if with_size else []) + IDENTITY
    return F.struct(*[F.col(c) for c in cols])


def identical_to(items: DataFrame, reference: DataFrame) -> DataFrame:
    """Four equality grades of every row against its group's reference row."""
    ref = reference.select("group_id", *[F.col(c).alias(f"r_{c}") for c in ["size", *IDENTITY]])
    same = F.lit(True)
    for c in IDENTITY:
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return items.join(ref, "group_id").select(
        *KEY, (same & F.col("size").eqNullSafe(F.col("r_size"))).alias("equals_full"),
        same.alias("equals_but_size"), F.lit(True).alias("same_group"),
        F.col("duration_s").eqNullSafe(F.col("r_duration_s")).alias("equals_only_length"))


@dataclass(frozen=True)
class CustomSelection:
    file_type: str = "all"  # all | videos | images
    min_mb: int = 0
    max_mb: int = 2_147_483_647
    path_contains: tuple[str, ...] = ()
    path_not_contains: tuple[str, ...] = ()
    similarity_from: float = 0.0
    similarity_to: float = 100.0
    cluster: str = "any"  # any | identical | identical_but_size | not_identical
    dates: str = "none"  # none | keep_oldest | keep_newest
    skip_checked_groups: bool = False


def custom_filter(spec: CustomSelection) -> Column:
    ok = media.megabytes("size").between(spec.min_mb, spec.max_mb) \
        & F.col("similarity").between(spec.similarity_from, spec.similarity_to)
    if spec.file_type != "all":
        ok = ok & (F.col("is_image") if spec.file_type == "images" else ~F.col("is_image"))
    for p in spec.path_contains:
        ok = ok & paths.wildcard_match("path", p)
    for p in spec.path_not_contains:
        ok = ok & ~paths.wildcard_match("path", p)
    return ok


def select_custom(visible: DataFrame, spec: CustomSelection) -> DataFrame:
    """(group_id, item_id, action): keep one row of each matched cluster, check the others.

    When the filters match only part of a group (and no cluster or date rule narrows it), the
    unmatched rows are the survivors and every matched row is checked.
    """
    df = attach(visible, "group_id", F.count(F.lit(1)).alias("_all"), F.bool_or("checked").alias("_busy"))
    if spec.skip_checked_groups:
        df = df.where("NOT _busy")
    df = df.where(custom_filter(spec)).withColumn("_id", identity(spec.cluster != "identical_but_size"))
    df = attach(df, "group_id", F.min(F.struct("item_id", "_id")).alias("_ref_row"))
    is_ref = F.col("item_id") == F.col("_ref_row.item_id")
    same = F.col("_id").eqNullSafe(F.col("_ref_row._id"))
    if spec.cluster in ("identical", "identical_but_size"):
        df = df.where(is_ref | same)
    elif spec.cluster == "not_identical":
        df = df.where(is_ref | ~same)
    order = {"none": [], "keep_oldest": [F.col("created")], "keep_newest": [newest_first("created")]}[spec.dates]
    df = mark_first(df, "group_id", order, "item_id", "_keep", (F.count(F.lit(1)).alias("_matched"),))
    partial = (F.col("_matched") < F.col("_all")) if spec.cluster == "any" and spec.dates == "none" \
        else F.lit(False)
    return df.select(*KEY, F.when(F.col("_keep") & ~partial, "keep").otherwise("check").alias("action"))


def select_identical(items: DataFrame) -> DataFrame:
    """First cluster of fully identical rows per group: mark all but its first row."""
    tagged = items.withColumn("_id", F.sha2(F.to_json(identity(True)), 256))
    clusters = tagged.groupBy("group_id", "_id").agg(F.min("item_id").alias("head"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1")
    chosen = clusters.groupBy("group_id").agg(F.min(F.struct("head", "_id")).alias("c")) \
        .select("group_id", F.col("c.head").alias("head"), F.col("c._id").alias("_id"))
    return tagged.join(chosen, ["group_id", "_id"]).where("item_id <> head").select(*KEY)


def select_in_group(items: DataFrame, keep: str) -> DataFrame:
    """Keep the smallest file, the newest, the oldest or the best row; mark the others.

    On ties the group's first row gives way to later ones.
    """
    if keep == "best":
        return ranking.keep_best_in_group(items)
    order = {"smallest": F.col("size"), "newest": newest_first("created"),
             "oldest": -newest_first("created")}[keep]
    headed = attach(items, "group_id", F.min("item_id").alias("_head"))
    return _rest(headed, [order, F.col("item_id") == F.col("_head")])


def select_missing(items: DataFrame) -> DataFrame:
    return items.where("NOT present").select(*KEY)


def invert(items: DataFrame, selected: DataFrame) -> DataFrame:
    return items.select(*KEY).join(selected.select(*KEY), KEY, "left_anti")


def clear(selected: DataFrame) -> DataFrame:
    return selected.where(F.lit(False))


def tombstone() -> Column:
    """Gone from a mounted drive; a file on an unmounted drive is merely offline."""
    return ~F.col("present") & F.col("root_ready")


def select_redownloads(items: DataFrame) -> DataFrame:
    """Live rows of groups that hold previously deleted content."""
    return attach(items, "group_id", F.bool_or(tombstone()).alias("_t")) \
        .where("_t AND present").select(*KEY)


def auto_select_web(items: DataFrame, mode: str) -> DataFrame:
    if mode == "hundred-percent":
        from mirrorset.operators.projection import scored

        df = attach(scored(items), "group_id", F.min("_score").alias("_low"), F.min("similarity").alias("_any"))
        df = df.where(media.shown_as_hundred(F.coalesce("_low", "_any")))
        return mark_first(df, "group_id", [(~F.col("_ref")).cast("int")], "item_id", "_keep") \
            .where("NOT _keep").select(*KEY)
    if mode == "largest":
        return _rest(items, [-F.col("size")])
    picked = ranking.pick_keeper(items, ranking.exact_criteria())
    return picked.where("members > 1 AND NOT is_keeper").select(*KEY)


def link_targets(items: DataFrame) -> DataFrame:
    """(group_id, item_id, target): each selected row points at the most similar unselected one."""
    keeper = items.where("NOT checked AND present").groupBy("group_id").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), F.col("item_id").alias("i"),
                       F.col("path").alias("p"))).alias("k"))
    return items.where("checked").join(keeper, "group_id", "left").select(
        *KEY, F.col("k.p").alias("target"))


def tombstone_plan(items: DataFrame) -> DataFrame:
    """One catalog row per completely deleted group stays as memory of the content."""
    return items.groupBy("group_id").agg(F.bool_and("checked").alias("all"), F.min("item_id").alias("item_id")) \
        .where("all").select(*KEY)


def pairwise_review(items: DataFrame, decision: Column) -> DataFrame:
    """Replay of a winner-stays walk: row i meets the current winner.

    ``decision`` (keep_left, keep_right, skip) belongs to the challenger's row. The winner before
    row i is the latest earlier challenger that won, so a running maximum replaces the walk.
    """
    steps = numbered(items.select(*KEY, decision.alias("decision")), ["group_id"], [F.col("item_id")], "pos")
    won = F.when((F.col("decision") == "keep_right") & (F.col("pos") > 1), F.col("pos"))
    walked = running_max(steps, ["group_id"], [F.col("pos")], won, "left_pos") \
        .withColumn("left_pos", F.coalesce("left_pos", F.lit(1).cast("bigint")))
    return walked.where("pos > 1").select(
        "group_id", (F.col("pos") - 1).alias("pair_number"), F.col("left_pos"), F.col("pos").alias("right_pos"),
        F.when(F.col("decision") == "keep_left", F.col("pos")).when(
            F.col("decision") == "keep_right", F.col("left_pos")).alias("check_pos"))


def move_plan(selection: DataFrame, existing: DataFrame, destination: str, first_suffix: int = 1,
              max_rounds: int = 50) -> DataFrame:
    """(item_id, path, target): collision-free names in the destination folder.

    A name that is taken gets _1, _2 ... (or from 0). Each round gives the pending rows of a
    name its next free numbers; rows that clash with another name's numbered form try again.
    """
    dest = paths.normalize_dir(destination)
    name = paths.file_name("path")
    pending = selection.select(
        "item_id", "path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("ext"))
    taken = existing.select("name").distinct()
    done = None
    for _ in range(max_rounds):
        ranked = numbered(pending, ["stem", "ext"], [F.col("item_id"), F.col("path")], "rank")
        need = ranked.groupBy("stem", "ext").agg(F.count(F.lit(1)).alias("n"))
        suffix = r"^(.*)_\d+(\.[^.]*)?$"
        forms = taken.select("name", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"),
                             F.regexp_extract("name", r"(\.[^.]*)$", 1).alias("ext"))
        forms = forms.select("stem", "ext").unionByName(forms.where(F.col("name").rlike(suffix)).select(
            F.regexp_replace("stem", r"_\d+$", "").alias("stem"), "ext"))
        used = forms.groupBy("stem", "ext").agg(F.count(F.lit(1)).alias("used"))
        numbers = need.join(used, ["stem", "ext"], "left").withColumn("i", F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.col("n") + F.coalesce("used", F.lit(0)) - 1)))
        label = F.when(F.col("i") == 0, F.concat("stem", "ext")).otherwise(F.concat(
            "stem", F.lit("_"), (F.col("i") - 1 + first_suffix).cast("string"), "ext"))
        free = numbered(numbers.select("stem", "ext", "i", label.alias("name")).join(
            taken, "name", "left_anti"), ["stem", "ext"], [F.col("i")], "rank")
        claim = ranked.join(free.select("stem", "ext", "rank", "name"), ["stem", "ext", "rank"])
        winner = claim.groupBy("name").agg(F.min(F.struct("item_id", "path")).alias("w"))
        claim = claim.join(winner, "name").withColumn(
            "_won", (F.col("item_id") == F.col("w.item_id")) & (F.col("path") == F.col("w.path")))
        claim = cut_lineage(claim.select("item_id", "path", "stem", "ext", "name", "_won"), "moves")
        won = claim.where("_won").select("item_id", "path", "name")
        done = won if done is None else done.unionByName(won)
        pending = claim.where("NOT _won").select("item_id", "path", "stem", "ext")
        if pending.isEmpty():
            return done.select("item_id", "path", F.concat(F.lit(dest + "/"), "name").alias("target"))
        taken = taken.unionByName(won.select("name"))
    raise RuntimeError("move plan did not settle")


def cleanup_report(items: DataFrame) -> DataFrame:
    """Dry run, one row per file of every touched group, with group and total savings."""
    touched = attach(items, "group_id", F.bool_or("checked").alias("_t"),
                     F.sum(F.when(F.col("checked"), F.col("size")).otherwise(0)).alias("group_savings")) \
        .where("_t")
    total = items.where("checked").agg(F.sum("size").alias("total_savings")).withColumn("_one", F.lit(1))
    return touched.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select(
        "group_id", "path", "size", "frame_size", F.when(F.col("checked"), "remove").otherwise("keep")
        .alias("action"), "group_savings", "total_savings")


def where_expression(items: DataFrame, expression: str) -> DataFrame:
    """Rows matching a user predicate; ``whole_group`` tells groups that match completely.

    The text must be one boolean Spark SQL expression over the result columns.
    """
    import re

    bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "''", expression)
    if re.search(r";|:=|\b(select|from)\b", bare, re.IGNORECASE):
        raise ValueError("only a boolean column expression is allowed")
    probe = items.select(F.expr(f"({expression})").alias("m"))
    if probe.schema["m"].dataType.typeName() != "boolean":
        raise ValueError("the expression must be boolean")
    df = items.withColumn("_m", F.coalesce(F.expr(f"({expression})"), F.lit(False)))
    return attach(df, "group_id", F.bool_and("_m").alias("whole_group")).where("_m").drop("_m")


def is_partial(flags="flags") -> Column:
    return has_flag(flags, MATCH_FLAGS["partial_clip"])
