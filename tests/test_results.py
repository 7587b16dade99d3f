import os
import struct

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from mirrorset.operators import graph, grouping, projection, ranking, selection
from mirrorset.sources import files as source_files
from mirrorset.sources import stores
from mirrorset.streaming import events

SCHEMA = ("group_id bigint, item_id bigint, path string, is_image boolean, size bigint, duration_s double, "
          "frame_size string, frame_size_int int, fps double, bitrate_kbs bigint, audio_sample_rate int, "
          "audio_bitrate_kbs bigint, hdr_format string, similarity double, flags int, is_reference boolean, "
          "created timestamp_ntz, modified timestamp_ntz, format string, audio_format string, audio_channel string, "
          "checked boolean, present boolean, root_ready boolean")


def item(item_id, group=1, path=None, image=False, size=1000, duration=60.0, frame=1920, sim=100.0, flags=0,
         ref=False, created="2024-01-01 00:00:00", modified="2024-01-01 00:00:00", bitrate=1000, checked=False):
    from datetime import datetime

    ts = lambda s: None if s is None else datetime.fromisoformat(s)
    return (group, item_id, path or f"/a/{group}_{item_id}.mp4", image, size, duration, f"{frame}x1", frame, 25.0,
            bitrate, 48000, 128, "", sim, flags, ref, ts(created), ts(modified), "h264", "aac", "stereo", checked,
            True, True)


def items(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def ids(df):
    return sorted(r.item_id for r in df.collect())


def test_pick_keeper(spark):
    df = items(spark, item(1, frame=1920, duration=30.0), item(2, frame=1920, duration=60.0), item(3, frame=1280, duration=90.0))
    k = ranking.keepers(df, ranking.default_criteria(["Resolution", "Duration"])).first()
    assert (k.item_id, k.decided_by) == (2, "Duration")
    near = items(spark, item(1, duration=100.0, frame=1280), item(2, duration=99.2, frame=1920))
    assert ranking.keepers(near).first().item_id == 2
    assert ranking.keepers(items(spark, item(5))).first().decided_by is None


@pytest.mark.parametrize("strategy,field,values,want", [
    ("smallest-file", "size", (1000, 5000, 3000), [1, 3]), ("worst-resolution", "frame", (1280, 3840, 1920), [1, 3]),
    ("shortest-duration", "duration", (30.0, 120.0, 60.0), [1, 3])])
def test_deletion_strategies(spark, strategy, field, values, want):
    df = ranking.highlight_best(items(spark, *[item(i + 1, **{field: v}) for i, v in enumerate(values)]))
    assert ids(selection.select_for_deletion(df, strategy)) == want
    one = ranking.highlight_best(items(spark, item(1)))
    assert ids(selection.select_for_deletion(one, strategy)) == []


def test_select_rule(spark):
    df = items(spark, item(1, path="/r/keep/a"), item(2, path="/r/keep/sub/b"), item(3, path="/r/keep-other/c"), item(4, 2), item(5, 2))
    assert ids(selection.select_rule(df, df, ["/r/keep"], "keep-protected")) == [3]
    ties = items(spark, item(1, created="2024-01-02"), item(2, created="2024-01-02"),
                 item(3, created="2024-01-01", path="/p/x"), item(4, created="2024-01-01"))
    assert ids(selection.select_rule(ties, ties, ["/p"], "keep-newest-created")) == [4]
    for bad in (items(spark, item(1, modified=None), item(2)), items(spark, item(1, path=" "), item(2)), items(spark, item(1)),
                items(spark, item(1), item(2))):
        assert ids(selection.select_rule(bad, bad, [], "keep-newest-modified")) == []


def test_group_view(spark):
    v = projection.group_view(items(spark, item(1, size=300, sim=100.0), item(2, size=100, sim=99.0, flags=2),
                                    item(3, size=200, sim=93.0, flags=2))).first()
    assert (v.min_similarity, v.max_similarity, v.total_size, v.savings) == (93.0, 99.0, 600, 300)
    for s, want in ((99.949, False), (99.95, True), (100.0, True)):
        assert projection.group_view(items(spark, item(1, sim=s), item(2, sim=100.0))).first().shown_hundred is want


def test_sort_groups(spark):
    df = items(spark, item(1, 1, sim=99.0, size=100), item(2, 1, sim=99.0, size=100), item(3, 2, sim=99.0, size=400),
               item(4, 2, sim=99.0, size=400), item(5, 3, sim=95.0, size=800), item(6, 3, sim=95.0, size=800))
    view = projection.group_view(df)
    assert [r.group_id for r in projection.sort_groups(view).collect()] == [2, 1, 3]
    assert [r.group_id for r in projection.sort_groups(view, True).collect()] == [3, 2, 1]
    assert [r.group_id for r in projection.page(view, 99, 2).collect()] == [3]


def test_blacklist_groups(spark):
    black = spark.createDataFrame([(1, p) for p in ("/a/1_1.mp4", "/a/1_2.mp4", "/a/1_3.mp4")], "entry_id bigint, path string")
    for n, want in ((2, 1), (3, 1), (4, 0)):
        assert graph.blacklisted_groups(items(spark, *[item(i + 1) for i in range(n)]), black).count() == want


def test_numbering_of_one_huge_group_over_many_partitions(spark):
    df = spark.range(0, 5000).select(F.lit(1).alias("g"), F.pmod(F.col("id") * 7919, F.lit(5000)).alias("v"))
    rows = grouping.numbered(df, ["g"], [F.col("v")]).collect()
    assert all(r.rn == r.v + 1 for r in rows)
    run = grouping.running_sum(df, ["g"], [F.col("v")], F.col("v"), "s").collect()
    assert all(r.s == r.v * (r.v + 1) // 2 for r in run)
    top = grouping.running_max(df, ["g"], [F.col("v")], F.when(F.col("v") % 10 == 0, F.col("v")), "m").collect()
    assert all(r.m == (None if r.v == 0 else (r.v - 1) // 10 * 10) for r in top)


def test_move_plan_never_collides(spark):
    sel = spark.createDataFrame([(i, f"/s{i}/{n}.mp4") for i, n in enumerate(["a", "a", "a_1", "a", "b"])], "item_id bigint, path string")
    taken = spark.createDataFrame([("a.mp4",), ("b.mp4",), ("b_1.mp4",)], "name string")
    got = {r.item_id: r.target for r in selection.move_plan(sel, taken, "/d").collect()}
    assert len(set(got.values())) == 5 and not {v.rsplit("/", 1)[1] for v in got.values()} & {"a.mp4", "b.mp4", "b_1.mp4"}
    assert got[4] == "/d/b_2.mp4" and got[0] == "/d/a_1.mp4"


def test_where_expression_accepts_only_predicates(spark):
    df = items(spark, item(1, size=1), item(2, size=5))
    assert ids(selection.where_expression(df, "size > 3")) == [2]
    for bad in ("size", "size > 3; drop table x", "(select 1) = 1"):
        with pytest.raises(Exception):
            selection.where_expression(df, bad).collect()


def test_pairwise_review(spark):
    df = items(spark, *[item(i) for i in (1, 2, 3, 4)])
    d = F.when(F.col("item_id") == 2, "keep_right").when(F.col("item_id") == 3, "skip").otherwise("keep_left")
    got = [(r.left_pos, r.right_pos, r.check_pos) for r in selection.pairwise_review(df, d).orderBy("pair_number").collect()]
    assert got == [(1, 2, 1), (2, 3, None), (2, 4, 4)]


def test_progress_rate(spark):
    df = spark.createDataFrame([(60, 600), (120, 660)], "s bigint, completed bigint").select(
        F.timestamp_seconds("s").alias("ts"), "completed", F.lit(1000).cast("bigint").alias("total"))
    etas = [r.eta_s for r in events.progress_rate(df, "120 seconds", "120 seconds").collect() if r.eta_s is not None]
    assert etas == [] or etas == [340.0]
    one = events.progress_rate(df, "600 seconds", "600 seconds").first()
    assert one.eta_s == pytest.approx(340.0)


def test_content_fingerprint_and_scan(spark, tmp_path):
    big = os.urandom(200_000)
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.MP4").write_bytes(big)
    (tmp_path / "v" / "b.jpg").write_bytes(b"x" * 100)
    (tmp_path / "v" / "c.txt").write_bytes(b"x")
    df = source_files.scan_files(spark, [str(tmp_path)])
    assert sorted(os.path.basename(r.path) for r in df.collect()) == ["a.MP4", "b.jpg"]
    assert source_files.scan_files(spark, [str(tmp_path)], include_images=False).count() == 1
    got = {os.path.basename(r.path): r.os_hash for r in source_files.content_fingerprint(df).collect()}
    words = sum(struct.unpack("<8192Q", big[:65536])) + sum(struct.unpack("<8192Q", big[-65536:])) + len(big)
    assert got == {"a.MP4": f"{words % 2 ** 64:016x}", "b.jpg": None}


def test_snapshot_of_nothing_removes_the_store(spark, tmp_path):
    df, none = items(spark, item(1)), spark.createDataFrame([], "path string")
    root = str(tmp_path / "s")
    assert stores.load_snapshot(spark, root) is None
    assert stores.save_snapshot(df, df.select("path"), none, none, root)
    assert stores.load_snapshot(spark, root)["items"].count() == 1
    assert not stores.save_snapshot(df.limit(0), none, none, none, root)
    assert stores.load_snapshot(spark, root) is None


def test_blacklist_round_trip(spark, tmp_path):
    b = spark.createDataFrame([(1, "/x"), (1, "/y"), (2, "/z"), (7, "/w")] + [(9, f"/p{i}") for i in range(2500)], "entry_id bigint, path string")
    stores.write_blacklist(b, str(tmp_path / "b"))
    assert rows_of(stores.read_blacklist(spark, str(tmp_path / "b"))) == rows_of(b)
    (tmp_path / "old.json").write_text('{"Version":1,\n"Groups":[["/a","/b"],["/c"]]}')
    assert sorted((r.entry_id, r.path) for r in stores.read_blacklist(spark, str(tmp_path / "old.json")).collect()) == [
        (0, "/a"), (0, "/b"), (1, "/c")]


def test_results_keep_every_row_of_a_big_group(spark, tmp_path):
    df = spark.range(0, 2500).select(F.lit(1).cast("bigint").alias("group_id"), F.col("id").alias("item_id"),
                                     F.concat(F.lit("/p"), "id").alias("path"), F.lit(1.0).alias("similarity"))
    stores.write_results(df, str(tmp_path / "r"))
    back = stores.read_results(spark, str(tmp_path / "r"), "item_id:bigint,path:string,similarity:double")
    assert rows_of(back.select("group_id", "item_id", "path", "similarity")) == rows_of(df)


def test_deep_pages_equal_shallow_ones(spark, monkeypatch):
    view = spark.range(300).selectExpr("id AS group_id", "cast(id % 7 AS double) AS min_similarity", "id % 11 AS savings")
    shallow = [r.group_id for r in projection.page(view, 4, 20).collect()]
    monkeypatch.setattr(projection, "SORTED_AT_ONCE", 10)
    assert [r.group_id for r in projection.page(view, 4, 20).collect()] == shallow and len(shallow) == 20


def shuffles(df):
    """Exchanges that the planned query deals rows by, and broadcasts."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_rules_and_deltas_of_all_kinds_deal_rows_once(spark):
    rules = ["keep-protected", "keep-newest-created", "keep-oldest-created", "keep-newest-modified", "keep-oldest-modified"]
    df = items(spark, item(1, path="/p/a", created="2024-01-02"), item(2, created="2024-01-01", modified="2024-01-03"), item(3, created="2024-01-03"),
               item(4, 2, created="2024-01-02"), item(5, 2, modified=None), item(6, 3, path="/q/a", image=True, size=5), item(7, 3, duration=90.0))
    scope = df.where("item_id <> 3")
    assert shuffles(selection.select_rules(df, scope, ["/p"], rules)) <= shuffles(selection.select_rules(df, scope, ["/p"], rules[:1]))
    got = selection.select_rules(df, scope, ["/p"], rules)
    assert rows_of(got) == rows_of(spark.createDataFrame(
        [("keep-protected", 1, 2), ("keep-newest-created", 1, 2), ("keep-newest-created", 2, 5), ("keep-oldest-created", 2, 4), ("keep-oldest-modified", 1, 2)],
        "rule string, group_id bigint, item_id bigint"))
    deltas = ranking.item_deltas(df)
    flagged = ranking.highlight_best(df)
    single = [ranking.metric_deltas(flagged, m).select(F.lit(m).alias("metric"), "group_id", "item_id", "delta") for m in ranking.METRICS]
    want = single[0]
    for part in single[1:]:
        want = want.unionByName(part)
    assert shuffles(deltas) < shuffles(want)
    assert rows_of(deltas) == rows_of(want)


def test_records_and_report_of_small_and_large_groups(spark, monkeypatch, tmp_path):
    """Groups of one record and longer ones give the same order; rows of small groups are not numbered over ranges."""
    numbered = []
    monkeypatch.setattr(stores, "ITEMS_PER_RECORD", 3)
    monkeypatch.setattr(stores, "numbered", lambda df, *a, f=grouping.numbered: numbered.append(df.count()) or f(df, *a))
    rows = [item(i, sim=90.0 + i % 4) for i in range(8)] + [item(20 + i, 2, sim=99.0 - i) for i in range(3)] + [item(30, 3)]
    df = items(spark, *rows)
    got = {(r["group_id"], r["part"]): [x["item_id"] for x in r["items"]] for r in stores.result_records(df.select("group_id", "item_id", "path", "similarity")).collect()}
    assert got == {(1, 0): [3, 7, 2], (1, 1): [6, 1, 5], (1, 2): [0, 4], (2, 0): [20, 21, 22], (3, 0): [30]}
    assert numbered == [8]
    stores.write_results(ranking.highlight_best(df.withColumn("offset_s", F.lit(0.0))), str(tmp_path / "t"), "text")
    parts = sorted((tmp_path / "t").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).split("\n")
    assert [x.split("_")[1].split(".")[0] for x in lines if "/a/" in x] == [str(i) for i in (3, 7, 2, 6, 1, 5, 0, 4, 20, 21, 22, 30)]
    assert lines[:3] == ["Found 3 duplicate group(s), 12 total file(s).", "", "Group 1 (8 files):"] and lines[19:21] == ["", "Group 2 (3 files):"]
