"""Candidate generation of the joins: lossless against brute force, and candidates that grow with the rows."""

import itertools
import random

import numpy as np
import pytest
from helpers import features, file_row
from pyspark.sql import functions as F

from mirrorset.config import MatchConfig
from mirrorset.functions import bits
from mirrorset.operators import blocking as B
from mirrorset.operators import graph, matching, partial
from mirrorset.runtime import cut_lineage


@pytest.mark.parametrize("radius", [0, 1, 3, 6, 7, 8, 10, 13, 16])
def test_parts_cover_every_error_pattern(radius):
    rng = random.Random(radius)
    parts = bits.hamming_parts(radius)
    assert len({s for s, _, _ in parts}) == len(parts) and max(s + n for s, n, _ in parts) <= 64
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), radius))
        assert any((x >> s & (1 << n) - 1).bit_count() <= r for s, n, r in parts)


def test_ball_is_all_near_values():
    assert sorted(bits.ball(6, 2)) == [x for x in range(64) if x.bit_count() <= 2]


@pytest.mark.parametrize("percent", [88.0, 82.0, 75.0])
def test_wide_hash_join_equals_brute_force(spark, percent):
    """8, 11 and 16 bits: every pair at the limit and none beyond it."""
    rng = random.Random(3)
    cfg = MatchConfig(percent=percent, use_phash=True)
    rows = []
    for i in range(150):
        h = rng.getrandbits(64) - (1 << 63)
        if i % 3:
            h = rows[-1][9][0]
            for b in rng.sample(range(63), rng.choice((cfg.max_bits - 1, cfg.max_bits, cfg.max_bits + 1))):
                h ^= 1 << b
        rows.append(file_row(i, [0] * 64, 50 + i % 5, phashes=(h,)))
    f = features(spark, rows)
    got = [(r.src, r.dst) for r in B.phash_pairs(f, f, cfg, 1).collect()]
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2)
            if ((a[9][0] ^ b[9][0]) & (1 << 64) - 1).bit_count() <= cfg.max_bits
            and abs(a[2] - b[2]) <= min(cfg.tolerance(a[2]), cfg.tolerance(b[2]))}
    assert cfg.max_bits >= 7 and len(got) == len(set(got)) and set(got) == want and want


def unit(v):
    return (v / np.linalg.norm(v, axis=-1, keepdims=True) * 127).round().astype(int)


def vector_rows(spark, vectors, images=True, positions=1):
    n = len(vectors) // positions
    files = spark.createDataFrame([(i, images, 100.0 + i % 7, "/f") for i in range(n)], "file_id bigint, is_image boolean, duration_s double, folder string")
    emb = spark.createDataFrame([(i // positions, i % positions, v.tolist(), (i * 7) % 11 != 0) for i, v in enumerate(vectors)],
                                "file_id bigint, pos_idx int, q array<tinyint>, bright boolean")
    return files, emb


@pytest.mark.parametrize("images,positions", [(True, 1), (False, 1), (True, 3), (False, 2)])
def test_embedding_join_equals_brute_force(spark, monkeypatch, images, positions):
    """Many small cells, vectors around the threshold, several positions of which some are not usable."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((25, 16))
    vectors = unit(np.repeat(centres[rng.integers(0, 25, 200)], positions, axis=0) + 0.33 * rng.standard_normal((200 * positions, 16)))
    files, emb = vector_rows(spark, vectors, images, positions)
    cfg = MatchConfig(use_ai=True, ai_percent=90.0)
    usable = {(i // positions, i % positions): v for i, v in enumerate(vectors) if (i * 7) % 11}
    want = {}
    for a, b in itertools.combinations(range(200), 2):
        if not images and abs(a % 7 - b % 7) > min(cfg.tolerance(100.0 + a % 7), cfg.tolerance(100.0 + b % 7)):
            continue
        both = [float(np.clip(usable[a, p] @ usable[b, p] / 127 ** 2, -1, 1)) for p in range(positions) if (a, p) in usable and (b, p) in usable]
        if len(both) >= cfg.ai_required(positions) and sum(both) / len(both) >= cfg.ai_threshold:
            want[a, b] = sum(both) / len(both)
    whole = B.pivots_for
    monkeypatch.setattr(B, "pivots_for", lambda v, limit: whole(v, limit, rows_per_pivot=5))
    rows = B.embedding_pairs(files, files, emb, cfg, positions).collect()
    got = {(r.src, r.dst): r.ai_sim for r in rows}
    assert len(rows) == len(got) and set(got) == set(want) and want
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_embedding_candidates_grow_with_the_rows(spark):
    """Clustered vectors, clusters as many as the rows call for: candidates a row stay about the same."""
    rng = np.random.default_rng(9)
    a_row = []
    for n in (1000, 2000, 4000, 8000):
        centres = rng.standard_normal((n // 50, 64))
        vectors = unit(np.repeat(centres, 50, axis=0) + 0.1 * rng.standard_normal((n, 64)))
        _, emb = vector_rows(spark, vectors)
        pivots = B.pivots_for(emb.select("q"), 0.94, rows_per_pivot=50)
        l, r = B.with_cells(emb, pivots, True).groupBy("_pivot").count(), B.with_cells(emb, pivots, False).groupBy("_pivot").agg(F.count("q").alias("m"))
        a_row.append(l.join(r, "_pivot").agg(F.sum(F.col("count") * F.col("m"))).first()[0] / n)
    assert max(a_row) < 0.3 * 1000 and a_row[-1] < 2 * a_row[0], a_row


def masked_corpus(n=140, seed=4):
    """Frames with black halves, white frames and bars, copies with noise, in one duration bin; 8x8."""
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.integers(40, 230, (8, 8))
        kind = int(rng.integers(0, 6))
        for _ in range(int(rng.integers(1, 4))):
            frame = np.clip(base + rng.integers(-3, 4, (8, 8)), 34, 238)
            if kind == 1:
                frame[:4] = rng.integers(0, 30)
            elif kind == 2:
                frame[:, :4] = 250
            elif kind == 3:
                frame[rng.integers(0, 8)] = 3
            elif kind == 4:
                frame[::2, ::2] = 0
            if rng.random() < 0.2:
                frame[4:] = 0
            rows.append(file_row(len(rows), frame.ravel().tolist(), 100.0, is_image=bool(len(rows) % 2)))
    return rows


def masked_mean(x, y, black, white):
    x, y = np.array(x), np.array(y)
    keep = np.ones(64, bool)
    if black:
        keep &= (x > 32) & (y > 32)
    if white:
        keep &= (x < 240) & (y < 240)
    return np.abs(x - y)[keep].sum() / keep.sum() / 256 if keep.any() else None


@pytest.mark.parametrize("black,white", [(True, True), (True, False), (False, True)])
@pytest.mark.parametrize("most", [4096, 3])
def test_masked_matching_equals_brute_force(spark, monkeypatch, black, white, most):
    monkeypatch.setattr(B.free_regions, "__defaults__", (most,))
    cfg = MatchConfig(percent=96.0, ignore_black=black, ignore_white=white)
    rows = masked_corpus()
    f = cut_lineage(B.with_sums(features(spark, rows), 8), "features")
    pairs = [(r.src, r.dst) for r in matching.class_pairs(f, cfg, 1, 8).collect()]
    want = set()
    for a, b in itertools.combinations(rows, 2):
        mean = masked_mean(a[8], b[8], black, white)
        if a[1] == b[1] and mean is not None and mean <= cfg.gray_fraction:
            want.add((a[0], b[0]))
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 15


def test_masked_candidates_are_few(spark):
    """Spread frames with free cells in common: far fewer candidates than pairs of the duration bin."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        frame = np.repeat(np.repeat(rng.integers(40, 230, (2, 2)), 4, axis=0), 4, axis=1)
        frame[:2] = 0
        rows.append(file_row(i, frame.ravel().tolist(), 100.0))
    f = cut_lineage(B.with_sums(features(spark, rows), 8), "features")
    cfg = MatchConfig(percent=98.0, ignore_black=True, ignore_white=True)
    assert B.masked_candidates(f, f, cfg, 1, 8).count() < 600 * 599 / 2 / 20


def test_free_regions_never_claim_a_masked_cell():
    rng = random.Random(1)
    sets = [(rng.getrandbits(16), rng.randrange(1, 9)) for _ in range(300)] + [(0xFFFF, 900)]
    sets = list(dict(sets).items())
    table = {free: (own, regions) for free, own, regions in B.free_regions(sets, 12)}
    assert len({own for own, _ in table.values()}) <= 13
    for free, (own, regions) in table.items():
        assert own & ~free == 0
        assert {own & other for other, _ in table.values()} <= set(regions)


def test_frame_hits_equal_the_product_of_ratio_pairs(spark, monkeypatch):
    """Frames first gives what comparing all frames of all ratio pairs gives."""
    rng = np.random.default_rng(2)
    whole = partial.pivots_for
    monkeypatch.setattr(partial, "pivots_for", lambda v, limit: whole(v, limit, rows_per_pivot=6))
    base = rng.standard_normal((40, 64))
    rows, files = [], []
    for i in range(30):
        slots = int(rng.integers(2, 25))
        start = int(rng.integers(0, 15))
        files.append((i, slots * 5.0, f"/f{i % 2}", False))
        for s in range(slots):
            rows.append((i, s, 5.0, None if (i + s) % 9 == 0 else unit(base[start + s] + 0.25 * rng.standard_normal(64)).tolist()))
    d = spark.createDataFrame(rows, "file_id bigint, slot int, interval_s double, q array<tinyint>")
    f = spark.createDataFrame(files, "file_id bigint, duration_s double, folder string, is_image boolean")
    for mode in ("none", "same", "different"):
        cfg = MatchConfig(folder_mode=mode)
        got = [(r.src, r.clip, r.offset, r.dot) for r in partial.dense_frame_hits(f, d, cfg, 0.89, 64).collect()]
        bound, want = 100, set()
        from mirrorset.functions.vectors import sign_bound
        bound = sign_bound(0.89, 64)
        length = {x[0]: x[1] for x in files}
        for (a, s, _, x), (b, t, _, y) in itertools.product(rows, rows):
            if a == b or x is None or y is None or (mode == "same" and a % 2 != b % 2) or (mode == "different" and a % 2 == b % 2):
                continue
            if not cfg.partial_min_ratio <= length[b] / length[a] < cfg.partial_max_ratio:
                continue
            x_, y_ = np.array(x), np.array(y)
            dot = int(x_ @ y_)
            if min(1.0, dot / 127 ** 2) >= 0.89 and ((x_ < 0) != (y_ < 0)).sum() <= bound:
                want.add((a, b, 5.0 * (s - t), dot))
        assert len(want) > 20 and set(got) == want


def test_alignments_end_at_their_bound_and_lose_nothing(spark, monkeypatch):
    """All offsets of all pairs were compared whole; bounds leave few and every match with its first best offset."""
    monkeypatch.setattr(partial, "SOURCES_AT_ONCE", 8)
    monkeypatch.setattr(partial, "CLIPS_AT_ONCE", 4)
    rng = np.random.default_rng(12)
    words = rng.integers(0, 1 << 32, 400)
    sources = [words[rng.integers(0, 400, int(rng.integers(1, 200)))] for _ in range(30)] + [np.tile(words[:5], 20)]
    clips = [words[rng.integers(0, 400, int(rng.integers(1, 40)))] for _ in range(6)] + [words[:5], np.zeros(0, np.int64)]
    for i in range(12):
        whole = sources[i] if len(sources[i]) >= 12 else sources[30]
        start = int(rng.integers(0, len(whole) - 10))
        clips.append(whole[start:start + 10] ^ np.bitwise_or.reduce([1 << rng.integers(0, 32, 10) for _ in range(1 + i)]))
    table = lambda rows: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "file_id bigint, fp array<bigint>")
    pairs = [(a, b) for a in range(len(sources)) for b in range(len(clips))]
    want = {}
    for a, b in pairs:
        s, c = sources[a], clips[b]
        totals = [sum(int(x).bit_count() for x in s[o:o + len(c)] ^ c) for o in range(len(s) - len(c) + 1)] if len(c) else []
        if totals and min(totals) <= int((1.0 - 0.8) * 32 * len(c) + 1e-6):
            want[a, b] = (round(1 - min(totals) / (len(c) * 32.0), 9), totals.index(min(totals)))
    got = partial.sliding_match(spark.createDataFrame(pairs, "src bigint, clip bigint"), table(sources), table(clips), 0.8).collect()
    assert {(r.src, r.clip): (round(r.similarity, 9), r.offset_s) for r in got} == want and len(got) == len(want) > 10
    # Bits of a pair without a common word cannot reach the budget: no offset is looked at.
    far, clip = np.arange(50, dtype=np.uint32), np.full(10, 0xFFFFFFFF, dtype=np.uint32)
    monkeypatch.setattr(np.lib.stride_tricks, "sliding_window_view", None)
    assert partial.best_alignment(clip, far, partial._least_distances(clip, far), 64) is None


def test_frames_of_files_that_are_no_clip_never_meet(spark, monkeypatch):
    """Frames of files of one duration were compared although no ratio allows them; the limits of the ratio stay."""
    rng = np.random.default_rng(4)
    q = unit(rng.standard_normal(64)).tolist()
    seconds = [1000.0] * 30 + [100.0, 99.9, 949.9, 950.0, 5000.0]
    f = spark.createDataFrame([(i, s, "/f", False) for i, s in enumerate(seconds)], "file_id bigint, duration_s double, folder string, is_image boolean")
    d = spark.createDataFrame([(i, 0, 5.0, q) for i in range(len(seconds))], "file_id bigint, slot int, interval_s double, q array<tinyint>")
    met, join = [], partial.block_join

    def seen(left, right, *rest):
        met.append(left.join(right, ["_pivot", "_ratio"]).count())
        return join(left, right, *rest)

    monkeypatch.setattr(partial, "block_join", seen)
    cfg = MatchConfig()
    got = {(r.src, r.clip) for r in partial.dense_frame_hits(f, d, cfg, 0.89, 64).collect()}
    want = {(a, b) for a, s in enumerate(seconds) for b, c in enumerate(seconds)
            if a != b and cfg.partial_min_ratio <= c / s < cfg.partial_max_ratio}
    assert got == want and (0, 30) in want and (0, 32) in want and (0, 33) not in want
    assert met[0] < len(want) + 100


def test_offset_consensus_takes_the_upper_median(spark):
    rng = random.Random(7)
    hits, want = [], {}
    for pair in range(40):
        offsets = [float(rng.randrange(0, 120, 5)) for _ in range(rng.randrange(1, 14))]
        dots = [rng.randrange(15000, 16300) for _ in offsets]
        hits += [(pair, 99, o, d) for o, d in zip(offsets, dots)]
        if len(offsets) >= 4:
            median = sorted(offsets)[len(offsets) // 2]
            agree = [min(1.0, d / 127 ** 2) for o, d in zip(offsets, dots) if abs(o - median) <= 30]
            if len(agree) >= 4:
                want[pair] = (round(sum(agree) / len(agree), 9), int(median))
    df = spark.createDataFrame(hits, "src bigint, clip bigint, offset double, dot bigint")
    got = {r.src: (round(r.similarity, 9), r.offset_s) for r in partial.offset_consensus(df).collect()}
    assert got == want


def test_group_links_stay_inside_their_group(spark):
    """Two groups of near-equal frames and different durations: links never name a member of the other group."""
    rng = np.random.default_rng(1)
    base = rng.integers(40, 200, 64)
    rows = [file_row(i, (base + rng.integers(0, 2, 64)).tolist(), 100.0 if i < 4 else 900.0, folder=f"/d/{i}") for i in range(8)]
    f = features(spark, rows)
    groups = spark.createDataFrame([(i, 0 if i < 4 else 4) for i in range(8)], "file_id bigint, group_id bigint")
    links = [(r.group_id, r.src, r.dst) for r in matching.group_links(f, groups, MatchConfig(), 1, 8).collect()]
    assert sorted(links) == sorted((g, a, b) for g in (0, 4) for a, b in itertools.combinations(range(g, g + 4), 2))


def near_frames(n, seed, noise):
    """Frames around three pictures; with little noise all frames of a picture match each other."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (3, 64))
    return np.clip(base[np.arange(n) % 3] + rng.integers(-noise, noise + 1, (n, 64)), 0, 255).astype(int)


def test_frame_angles_keep_every_pair_within_the_limit():
    for side, k, limit in ((8, 1, 655), (8, 2, 60), (32, 1, 10485), (10, 1, 0)):
        rng = np.random.default_rng(side + k)
        x = rng.integers(0, 256, (300, k * side * side)).astype(np.int16)
        y = np.clip(x + rng.integers(-1, 2, x.shape) * rng.integers(0, 25, (300, 1)), 0, 255).astype(np.int16)
        (fx, least), fy = B.frame_angles(x, k, side, limit), B.frame_angles(y, k, side, limit)[0]
        sad = np.abs(x[:, None].astype(int) - y[None]).sum(axis=2)
        kept = fx @ fy.T >= least
        assert (sad <= limit).any() and kept[sad <= limit].all()
        assert kept[sad > 6 * max(limit, 1)].mean() < 0.1


def test_matches_of_a_crowd_leave_the_task_as_a_forest(spark):
    """120 frames of three pictures match 40 * 39 / 2 times each; the forest has the components and least differences."""
    g = near_frames(120, 4, 6)
    f = features(spark, [file_row(i, g[i].tolist(), duration=100.0 + i % 5) for i in range(120)])
    cfg = MatchConfig()
    whole = matching.find_edges(f, cfg, 1, 8).toPandas()
    some = matching.find_edges(f, cfg, 1, 8, forest=True)
    sad = np.abs(g[:, None] - g[None]).sum(axis=2)
    want = {(i, j): sad[i, j] / (64 * 256) for i in range(120) for j in range(i + 1, 120) if sad[i, j] <= cfg.gray_limit(64, 1)}
    assert {(s, d): x for s, d, x in zip(whole.src, whole.dst, whole.difference)} == want and len(want) > 2000
    pairs = {(r.src, r.dst): r.difference for r in some.collect()}
    assert len(pairs) == 117 and all(want[p] == x for p, x in pairs.items())
    least = lambda e: {i: min(x for p, x in e.items() if i in p) for i in range(120)}
    assert least(pairs) == least(want)
    assert {(r.file_id, r.group_id) for r in graph.components(some).collect()} == {(i, i % 3) for i in range(120)}


@pytest.mark.parametrize("block", [7, 8000])
def test_each_two_frames_are_compared_once(spark, monkeypatch, block):
    """Rows went to all neighbouring cells of their own, so every two frames met twice."""
    monkeypatch.setattr(B, "ROWS_PER_FRAME_BLOCK", block)
    monkeypatch.setattr(B, "PAIRS_AT_A_TIME", 50)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 256, (12, 1)) + rng.integers(-15, 16, (12, 64))
    g = np.clip(base[np.arange(150) % 12] + rng.integers(-9, 10, (150, 64)), 0, 255).astype(int)
    seconds = rng.choice([60.0, 70.0, 71.0, 85.0, 100.0, 130.0], 150)
    f = features(spark, [file_row(i, g[i].tolist(), duration=seconds[i], is_image=i % 4 == 0) for i in rng.permutation(150).tolist()])
    met, cfg = [], MatchConfig()
    join = B.block_join

    def seen(left, right, *rest):
        met.append((left.count(), right.count()))
        return join(left, right, *rest)

    monkeypatch.setattr(B, "block_join", seen)
    got = [tuple(r) for r in B.gray_pairs(f, f, cfg, 1, 8).collect()]
    sad = np.abs(g[:, None] - g[None]).sum(axis=2)
    tolerance = np.array([cfg.tolerance(s) for s in seconds])
    near = np.abs(seconds[:, None] - seconds[None]) <= np.minimum(tolerance[:, None], tolerance[None])
    want = [(i, j, int(sad[i, j])) for i in range(150) for j in range(i + 1, 150) if (i % 4 == 0) == (j % 4 == 0)
            and (i % 4 == 0 or near[i, j]) and sad[i, j] <= cfg.gray_limit(64, 1)]
    assert sorted(got) == want and len(want) > 300
    # One signed sum tells these rows apart: 1 + 4 of 9 cells for videos, 1 + 1 of 3 for images.
    assert met == [(112 * 5 + 38 * 2, 300)]


def test_scattered_vectors_are_not_copied_to_every_cell(spark):
    """Vectors spread evenly in 64 dimensions reach most cells at 94 %; they were sent to each of them."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(4000, 64))
    q = np.rint(v / np.linalg.norm(v, axis=1, keepdims=True) * 127).astype(int)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "file_id bigint, q array<tinyint>")
    pivots = B.pivots_for(df, 0.94)
    assert B.with_cells(df, pivots, True).count() <= 4000 * B.MOST_REACH * B.MOST_PIVOTS / 100


def test_small_cells_share_groups(spark):
    """Thousands of cells of two rows each make a few groups, and each cell is compared on its own."""
    df = spark.range(6000).select(F.col("id").alias("file_id"), (F.col("id") % 3000).alias("cell"))

    def pairs(a, b):
        assert len(a) == len(b) == 2
        return a.merge(b, how="cross", suffixes=("", "_r"))[["file_id", "file_id_r"]].set_axis(["src", "dst"], axis=1)

    rows = B.block_join(df, df, ["cell"], [], pairs, "src bigint, dst bigint").withColumn("task", F.spark_partition_id())
    assert rows.count() == 12_000 and rows.where("src % 3000 <> dst % 3000").count() == 0
