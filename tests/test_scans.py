"""Segmented scans, growing components, scratch scopes and stored arrivals."""

import os
import random

import pytest
from helpers import features, file_row
from pyspark.sql import functions as F

from mirrorset.config import MatchConfig
from mirrorset.operators import graph, grouping
from mirrorset.operators.matching import prepare
from mirrorset.runtime import cut_lineage, scratch_path, scratch_scope
from mirrorset.sources import stores
from mirrorset.streaming import catalog_stream, events, sinks, stateful


def test_previous_looks_across_partitions(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 == 0 else f"u{i % 7}", i, rng.randrange(1000)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(5)
    got = {(r.k, r.at): r.before for r in grouping.previous(df, ["k"], [F.col("at")], "v", "before").collect()}
    last, want = {}, {}
    for k, at, v in rows:
        want[k, at], last[k] = last.get(k), v
    assert got == want


def test_a_hot_user_is_spread_over_tasks(spark):
    df = spark.range(0, 20_000).select(F.lit("hot").alias("k"), F.col("id").alias("at"), (F.col("id") % 5).alias("v"))
    out = grouping.previous(df, ["k"], [F.col("at")], "v", "before")
    spread = df.repartitionByRange(8, "k", "at").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert out.count() == 20_000 and len(spread) > 1 and max(r["count"] for r in spread) < 20_000


def test_gap_sessions_equal_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice((1, 1, 1, 2, 3, None)), 1_700_000_000 + rng.randrange(0, 400_000)) for _ in range(600)] + [(9, None)]
    log = spark.createDataFrame(rows, "user_id bigint, s bigint").select("user_id", F.timestamp_seconds("s").alias("ts"))
    got = sorted((r.user_id is None, r.user_id or 0, r.start, r.messages) for r in
                 events.gap_sessions(log, "1 hour").select("user_id", F.unix_seconds("session_start").alias("start"), "messages").collect())
    want = []
    for user in {u for u, s in rows if s is not None}:
        times = sorted(s for u, s in rows if u == user and s is not None)
        start, n, before = times[0], 0, times[0]
        for t in times:
            if t - before >= 3600:
                want.append((user is None, user or 0, start, n))
                start, n = t, 0
            n, before = n + 1, t
        want.append((user is None, user or 0, start, n))
    assert got == sorted(want)


def test_dedup_backlog_over_batches(spark):
    rng = random.Random(4)
    rows = [(f, s, rng.choice("ab")) for f in range(5) for s in range(60)]
    root = scratch_path(spark, "frames")
    for b in range(3):
        part = [r for r in rows if 20 * b <= r[1] < 20 * b + 20]
        spark.createDataFrame(part, "file_id bigint, slot int, digest string").coalesce(1).write.mode("append").parquet(root)
    stream = spark.readStream.schema("file_id bigint, slot int, digest string").option("maxFilesPerTrigger", 1).parquet(root)
    out = scratch_path(spark, "kept")
    stateful.dedup_backlog(stream, out, scratch_path(spark, "kept-state"))
    got = {(r.file_id, r.slot) for r in spark.read.parquet(out).collect()}
    # Batches arrive by file time, which is the order of the slots here.
    by_file = {f: [(s, d) for g, s, d in rows if g == f] for f in range(5)}
    want = {(f, s) for f, x in by_file.items() for (s, d), before in zip(x, [(None, None), *x]) if d != before[1]}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_growing_components_equal_the_full_run(spark, seed):
    rng = random.Random(seed)
    batches = [[(rng.randrange(60), rng.randrange(60)) for _ in range(12)] for _ in range(4)]
    groups, edges = None, []
    for batch in batches:
        edges += batch
        groups = graph.add_edges(groups, spark.createDataFrame(batch, "src bigint, dst bigint"))
        whole = graph.components(spark.createDataFrame(edges, "src bigint, dst bigint"))
        assert {(r.file_id, r.group_id) for r in groups.collect()} == {(r.file_id, r.group_id) for r in whole.collect()}


def test_scratch_scope_deletes_what_is_not_kept(spark):
    with scratch_scope() as keep:
        gone, kept = cut_lineage(spark.range(3), "gone"), keep(cut_lineage(spark.range(4), "kept"))
        paths = [df._stored_at.removeprefix("file:") for df in (gone, kept)]
        assert all(map(os.path.exists, paths))
    assert not os.path.exists(paths[0]) and os.path.exists(paths[1]) and kept.count() == 4


def test_a_batch_reads_only_its_own_cells(spark):
    """Arrivals far apart in duration and brightness: a later batch reads few of the stored rows and finds its match."""
    cfg = MatchConfig(percent=96.0)
    rows = [file_row(i, [10 + (i * 37) % 220] * 64, 5.0 * 1.7 ** (i % 12)) for i in range(120)]
    first, second = features(spark, rows), features(spark, [file_row(900, rows[5][8], rows[5][2])])
    arrived = scratch_path(spark, "arrived")
    own = prepare(first, cfg, 8)
    catalog_stream.with_buckets(own, cfg, 1, 8, near=False).write.partitionBy("bucket").parquet(f"{arrived}/batch_id=0")
    near = catalog_stream.arrivals_near(spark, arrived, prepare(second, cfg, 8), cfg, 1, 8)
    assert "PartitionFilters: [" in near._jdf.queryExecution().toString() and 5 in {r.file_id for r in near.collect()}
    assert near.count() < 120 / 4


def test_stream_match_over_batches_equals_one_batch(spark):
    rng = random.Random(6)
    base = [[rng.randrange(40, 200) for _ in range(64)] for _ in range(6)]
    rows = [file_row(i, [min(255, p + rng.randrange(2)) for p in base[i % 6]], 50.0 + i % 3) for i in range(36)]
    stored = features(spark, rows[:12])
    found = []
    for files in (1, 4):
        root = scratch_path(spark, "arriving")
        for b in range(files):
            features(spark, [r for r in rows[12:] if r[0] % files == b]).coalesce(1).write.mode("append").parquet(root)
        stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(root)
        out = scratch_path(spark, "matches")
        catalog_stream.stream_match(stream, stored, MatchConfig(), 1, 8, out, scratch_path(spark, "matches-state"))
        found.append({frozenset((r.new_id, r.stored_id)) for r in spark.read.parquet(out).collect()})
    groups = []
    for pairs in found:
        edges = spark.createDataFrame([tuple(sorted(p)) for p in pairs], "src bigint, dst bigint")
        groups.append({(r.file_id, r.group_id) for r in graph.components(edges).collect()})
    assert groups[0] == groups[1] and len(groups[0]) == 36


def test_blacklist_files_of_both_kinds(spark, tmp_path):
    b = spark.createDataFrame([(1, "/a"), (1, "/b"), (2, "/c"), (2, "/d")], "entry_id bigint, path string")
    out = str(tmp_path / "lines")
    stores.write_blacklist(b, out)
    assert {tuple(r) for r in stores.read_blacklist(spark, out).collect()} == {(1, "/a"), (1, "/b"), (2, "/c"), (2, "/d")}
    old = tmp_path / "old.json"
    old.write_text('[["/x",\n "/y"],\n ["/z", "/w"]]')
    assert {r.path for r in stores.read_blacklist(spark, str(old)).collect()} == {"/x", "/y", "/z", "/w"}


def test_a_table_of_part_files_is_streamed_whole(spark, sf, tmp_path):
    """A table may be one file or a folder of them; a filter on file names took no part file."""
    import __spark_entry__ as entry

    for name in ("documents", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("stream_catalog", "capped_samples"):
        query = entry.queries()[name]
        one, many = (sorted(map(tuple, query(spark, where).collect()), key=str) for where in (sf, str(tmp_path)))
        assert len(one) > 0 and len(one) == len(many)
        if name == "stream_catalog":
            assert one == many
