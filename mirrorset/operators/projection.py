"""Group views, sorting, paging, headers, totals and display lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorset.functions import media, paths
from mirrorset.functions.bits import has_flag
from mirrorset.operators.grouping import attach, newest_first, numbered, numbered_overall
from mirrorset.operators.selection import tombstone
from mirrorset.schema import MATCH_FLAGS


def positive_size() -> Column:
    return F.greatest(F.col("size"), F.lit(0))


def scored(items: DataFrame) -> DataFrame:
    """Adds ``_ref`` (baseline of its group) and ``_score`` (null on baselines)."""
    partial = has_flag("flags", MATCH_FLAGS["partial_clip"])
    df = attach(items.withColumn("_partial", partial), "group_id", F.bool_or("_partial").alias("_clips"))
    ref = F.col("is_reference") | (F.col("_clips") & ~F.col("_partial"))
    return df.withColumn("_ref", ref).withColumn("_score", F.when(~F.col("_ref"), F.col("similarity"))) \
        .drop("_partial", "_clips")


def group_view(items: DataFrame) -> DataFrame:
    """One row per group: similarity range without baselines, sizes, savings, 100 % mark.

    A group with clips takes its flag from the aggregate itself, so one aggregation is enough:
    baselines are the explicit references plus, where clips exist, all rows that are no clip.
    """
    clip = has_flag("flags", MATCH_FLAGS["partial_clip"])
    ref, sim = F.col("is_reference"), F.col("similarity")
    low_high = []
    for name, fn in (("min", F.min), ("max", F.max)):
        low_high += [fn(F.when(~ref, sim)).alias(f"{name}_plain"),
                     fn(F.when(~ref & clip, sim)).alias(f"{name}_clip"), fn(sim).alias(f"{name}_all")]
    g = items.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("files"), F.bool_or(clip).alias("clips"), *low_high,
        F.sum(positive_size()).alias("total_size"), F.max(positive_size()).alias("largest"))
    pick = lambda n: F.coalesce(F.when(F.col("clips"), F.col(f"{n}_clip")).otherwise(
        F.col(f"{n}_plain")), F.col(f"{n}_all"))
    return g.select(
        "group_id", "files", pick("min").alias("min_similarity"), pick("max").alias("max_similarity"),
        "total_size", (F.col("total_size") - F.col("largest")).alias("savings"),
        media.shown_as_hundred(pick("min")).alias("shown_hundred"))


def filter_groups(items: DataFrame, search: str = "", folder: str = "", excluded: list[str] = (),
                  similarity: str = "all") -> DataFrame:
    """Group views after exclusions, folder narrowing, search and the 100 % filter."""
    df = items
    if excluded:
        drop = F.lit(False)
        for d in excluded:
            drop = drop | paths.in_directory("path", d)
        df = attach(df.where(~drop), "group_id", F.count(F.lit(1)).alias("_n")).where("_n >= 2").drop("_n")
    if folder:
        df = df.where(paths.in_directory("path", folder))
    if search:
        df = attach(df.withColumn("_hit", paths.path_search("path", search)), "group_id",
                    F.bool_or("_hit").alias("_any")).where("_any").drop("_hit", "_any")
    view = group_view(df)
    if similarity == "hundred":
        view = view.where("shown_hundred")
    elif similarity == "below-hundred":
        view = view.where("NOT shown_hundred")
    return view


def group_order(ascending: bool = False) -> list[Column]:
    s = F.col("min_similarity")
    return [s.asc() if ascending else s.desc(), F.col("savings").desc(), F.col("group_id").asc()]


def sort_groups(view: DataFrame, ascending: bool = False) -> DataFrame:
    return view.orderBy(*group_order(ascending))


#: Depth up to which a page is cut from the top rows of every task.
SORTED_AT_ONCE = 10_000


def page(view: DataFrame, number: int, size: int, ascending: bool = False) -> DataFrame:
    """One page of sorted groups; the page number is clamped to the existing pages.

    Up to SORTED_AT_ONCE groups from the top are found by each task's own best rows. For deeper pages the groups
    are numbered over range partitions, so that no task sorts or skips them all.
    """
    pages = max(1, -(-view.count() // size))
    at = min(max(number, 1), pages)
    if at * size <= SORTED_AT_ONCE:
        return sort_groups(view, ascending).offset((at - 1) * size).limit(size)
    ranked = numbered_overall(view, group_order(ascending), "_rn")
    return ranked.where(F.col("_rn").between((at - 1) * size + 1, at * size)).orderBy("_rn").drop("_rn")


def results_filter(items: DataFrame, path: str = "", file_type: str = "all", low: float = 0.0,
                   high: float = 100.0, only_checked_groups: bool = False) -> DataFrame:
    """Visible rows: a path hit keeps its whole group; groups left with one row vanish."""
    df = items.withColumn("_hit", paths.path_search("path", path) if path else F.lit(True))
    df = attach(df, "group_id", F.bool_or("_hit").alias("_any"), F.bool_or("checked").alias("_chk"))
    keep = F.col("_any") & F.col("similarity").between(low, high)
    if file_type != "all":
        keep = keep & (F.col("is_image") if file_type == "images" else ~F.col("is_image"))
    if only_checked_groups:
        keep = keep & F.col("_chk")
    return attach(df.where(keep), "group_id", F.count(F.lit(1)).alias("_n")).where("_n >= 2") \
        .drop("_hit", "_any", "_chk", "_n")


# mode -> (group aggregate, member sort column or None)
SORT_MODES = {
    "wasted_space": (lambda: F.sum(positive_size()) - F.max(positive_size()), "size"),
    "total_size": (lambda: F.sum(positive_size()), "size"),
    "largest_file": (lambda: F.greatest(F.max("size"), F.lit(0)), "size"),
    "file_count": (lambda: F.count(F.lit(1)), None),
    "similarity": (lambda: F.max("similarity"), "similarity"),
    "created": (lambda: F.max("created"), "created"),
    "duration": (lambda: F.max("duration_s"), "duration_s"),
    "resolution": (lambda: F.max("frame_size_int"), "frame_size_int"),
    "folder_path": (lambda: F.min(F.lower("path")), "path"),
    "checked": (lambda: F.bool_or("checked"), None),
}


def sort_results(items: DataFrame, mode: str, descending: bool = True,
                 best_first: str | None = None) -> DataFrame:
    """(group_number, row_number, group_id, item_id) of the result list.

    Groups are ordered by the mode's aggregate (first group on ties), members by the same
    dimension; with ``best_first`` the flagged row leads its group. Groups of one row vanish.
    """
    key_of, member = SORT_MODES[mode]
    if mode == "folder_path" and descending:
        key_of = lambda: F.max(F.lower("path"))
    turn = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    groups = items.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"), key_of().alias("_key")).where("_n >= 2")
    groups = numbered_overall(groups, [turn(F.col("_key")), F.col("group_id").asc()], "group_number")
    rows = items.join(groups.select("group_id", "group_number"), "group_id")
    order = [(~F.col(best_first)).cast("int").asc()] if best_first else []
    if member:
        order.append(turn(F.lower(member) if member == "path" else F.col(member)))
    out = numbered(rows.select("group_number", "group_id", "item_id", *(
        [member] if member else []), *([best_first] if best_first else [])),
        ["group_number"], [*order, F.col("item_id").asc()], "row_number")
    return out.select("group_number", "row_number", "group_id", "item_id")


def member_order(choice: Column) -> list[Column]:
    """Sort columns of the seven member orders; ``choice`` holds the order's name per row."""
    number = F.when(choice == "size", F.col("size").cast("double")).when(
        choice == "duration", F.col("duration_s")).when(
        choice == "bitrate", F.col("bitrate_kbs").cast("double")).when(
        choice == "resolution", F.col("frame_size_int").cast("double")).when(
        choice == "date", -newest_first("created").cast("double")).when(
        choice == "name", F.lit(0.0)).otherwise(F.col("similarity"))
    name = F.when(choice == "name", paths.file_name("path")).otherwise("")
    return [number.desc(), name.asc(), F.col("item_id").asc()]


def group_header(items: DataFrame) -> DataFrame:
    """Header facts per visible group and their one-line summary."""
    t, off = tombstone(), ~F.col("present") & ~F.col("root_ready")
    g = items.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum(positive_size()).alias("total_bytes"),
        F.max(positive_size()).alias("_largest"), F.min("similarity").alias("similarity_min"),
        F.max("similarity").alias("similarity_max"), F.count_if("present").alias("on_disk"),
        F.bool_or(t).alias("has_tombstone"), F.bool_or(off).alias("has_offline"),
        F.bool_or("checked").alias("has_checked"),
        F.bool_or(has_flag("flags", MATCH_FLAGS["grayscale_matched"])).alias("has_gray"),
        F.bool_or(has_flag("flags", MATCH_FLAGS["phash_matched"])).alias("has_phash")).where("files >= 2") \
        .withColumn("wasted_bytes", F.col("total_bytes") - F.col("_largest")).drop("_largest")
    return g.withColumn("summary", F.concat_ws(
        " · ", F.concat(F.col("files").cast("string"), F.lit(" files")), media.bytes_text("total_bytes"),
        F.when(F.col("wasted_bytes") > 0, F.concat(F.lit("save up to "), media.bytes_text("wasted_bytes"))),
        F.when(F.col("on_disk") < F.col("files"), F.concat(F.col("on_disk").cast("string"), F.lit(" on disk"))),
        F.when(F.col("has_tombstone"), F.lit("previously deleted content"))))


def totals(items: DataFrame) -> DataFrame:
    per = items.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum(positive_size()).alias("t"),
                                        F.max(positive_size()).alias("m"))
    return per.agg(F.sum("n").alias("duplicates"), F.count(F.lit(1)).alias("groups"),
                   F.sum("t").alias("total_bytes"), F.sum(F.col("t") - F.col("m")).alias("savings"))


def selection_totals(items: DataFrame) -> DataFrame:
    """Two-level count of touched groups keeps the distinct distributed."""
    per = items.where("checked").groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(positive_size()).alias("b"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("groups"),
                   F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))


def detail_lines(items: DataFrame) -> DataFrame:
    """Video, audio and size lines made of the fields that exist."""
    blank = lambda c: F.when(c != "", c)
    video = F.concat_ws(
        " · ", blank(F.col("format")), blank(F.col("frame_size")),
        F.when(~F.col("is_image") & (F.col("fps") > 0), F.concat(media.number_text(F.col("fps"), 3), F.lit(" fps"))),
        F.when(~F.col("is_image") & (F.col("duration_s") > 0), media.clock_text("duration_s")),
        blank(media.bitrate_text("bitrate_kbs")), blank(F.col("hdr_format")))
    audio = F.concat_ws(
        " · ", blank(F.col("audio_format")), blank(F.col("audio_channel")),
        F.when(F.col("audio_sample_rate") > 0, F.concat(
            media.number_text(F.col("audio_sample_rate") / 1000.0, 1), F.lit(" kHz"))),
        blank(media.bitrate_text("audio_bitrate_kbs")))
    return items.select(*[c for c in ("group_id", "item_id") if c in items.columns],
                        video.alias("video_line"), audio.alias("audio_line"),
                        media.bytes_text("size").alias("size_text"),
                        media.score_text("similarity").alias("score_text"))


def frame_positions(items: DataFrame, n: int, max_sampling_s: float = 0.0) -> DataFrame:
    """Stored timestamps first, then duration * (i + 1) / (n + 1); one frame for images."""
    count = F.when(F.col("is_image"), 1).otherwise(min(max(n, 1), 20))
    d = F.greatest(F.col("duration_s"), F.lit(0.0))
    if max_sampling_s > 0:
        d = F.least(d, F.lit(max_sampling_s))
    stored = F.try_element_at("timestamps", F.col("i") + 1) if "timestamps" in items.columns \
        else F.lit(None).cast("double")
    rows = items.withColumn("i", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.select("group_id", "item_id", "i", F.when(F.col("is_image"), F.lit(0.0)).otherwise(
        F.coalesce(stored, d * (F.col("i") + 1) / (count + 1))).alias("position_s"))


END_MARGIN_S = 0.1
MIN_PARTIAL_FRAMES = 3


def aligned_pair_positions(pairs: DataFrame, n: int, max_sampling_s: float = 0.0) -> DataFrame:
    """(…, i, a_pos, b_pos): the moments both sides of a pair show for frame i.

    pairs: a_/b_ duration, is_image, partial, offset. Partial clips are laid on the source's
    timeline and show the shared interval; others (or clips sharing nothing) the same share.
    """
    sampled = max(n, 1)
    partial = (F.col("a_partial") | F.col("b_partial")) & ~F.col("a_is_image") & ~F.col("b_is_image")
    count = F.when(F.col("a_is_image") | F.col("b_is_image"), 1).when(
        F.col("a_partial") | F.col("b_partial"), max(MIN_PARTIAL_FRAMES, sampled)).otherwise(sampled)
    rows = pairs.withColumn("frames", count).withColumn("i", F.explode(F.sequence(F.lit(0), count - 1)))
    share = (F.col("i") + 1) / (F.col("frames") + 1)
    off = {s: F.when(F.col(f"{s}_partial"), F.col(f"{s}_offset")).otherwise(0.0) for s in "ab"}
    start = F.greatest(off["a"], off["b"])
    end = F.least(off["a"] + F.col("a_duration"), off["b"] + F.col("b_duration"))
    moment = start + (end - start) * share

    def clamp(s: str, value: Column) -> Column:
        last = F.greatest(F.lit(0.0), F.col(f"{s}_duration") - END_MARGIN_S)
        return F.when(F.col(f"{s}_is_image"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(value, last)))

    def relative(s: str) -> Column:
        d = F.col(f"{s}_duration")
        return (F.least(d, F.lit(max_sampling_s)) if max_sampling_s > 0 else d) * share

    shared = partial & (end > start)
    return rows.select("*", *[clamp(s, F.when(shared, moment - off[s]).otherwise(relative(s))).alias(f"{s}_pos")
                              for s in "ab"], (F.col("i") == F.floor((F.col("frames") - 1) / 2)).alias("opens_here"))
