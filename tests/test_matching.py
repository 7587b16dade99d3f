import itertools
import random

import numpy as np
import pytest
from helpers import features, file_row, rows_of
from pyspark.sql import functions as F

from mirrorset.config import MatchConfig
from mirrorset.operators import blocking as B
from mirrorset.operators import graph, matching, partial
from mirrorset.functions.frames import median_bits
from mirrorset.plans.flows import duplicate_groups, visual_verdict


def corpus(n=120, seed=5):
    rng = np.random.default_rng(seed)
    rows, gid = [], 0
    while len(rows) < n:
        base = rng.integers(0, 256, 64)
        dur = float(rng.integers(5, 200))
        for _ in range(int(rng.integers(1, 5)) if gid % 3 == 0 else 1):
            noise = rng.integers(-2, 3, 64) * int(rng.integers(0, 2))
            gray = np.clip(base + noise, 0, 255).astype(int).tolist()
            bits = int(rng.integers(0, 2 ** 62))
            rows.append(file_row(len(rows), gray, dur * float(rng.choice([1.0, 1.005, 1.3])),
                                 folder=f"/f{int(rng.integers(0, 3))}", is_image=gid % 7 == 0, size=len(gray),
                                 inode=int(rng.integers(0, 6)), phashes=(bits, bits ^ 1)))
        gid += 1
    return rows


def brute(rows, cfg):
    limit, out = cfg.gray_limit(64, 1), set()
    for a, b in itertools.combinations(rows, 2):
        if a[1] != b[1]:
            continue
        if not a[1] and abs(a[2] - b[2]) > min(cfg.tolerance(a[2]), cfg.tolerance(b[2])):
            continue
        if cfg.folder_mode == "same" and a[3] != b[3] or cfg.folder_mode == "different" and a[3] == b[3]:
            continue
        if cfg.exclude_hardlinks and a[4:7] == b[4:7] and (a[1] or a[2] == b[2]):
            continue
        if int(np.abs(np.array(a[8]) - np.array(b[8])).sum()) <= limit:
            out.add((a[0], b[0]))
    return out


def groups_of(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("changes", [
    {}, {"folder_mode": "same"}, {"folder_mode": "different"}, {"exclude_hardlinks": True},
    {"folder_mode": "different", "exclude_hardlinks": True}, {"duration_percent": 1.0, "duration_min_s": 4.0},
    {"duration_percent": 0.0}])
def test_compact_edges_have_the_components_of_all_pairs(spark, changes):
    cfg = MatchConfig(percent=96.0).with_(**changes)
    rows = corpus()
    edges = matching.find_edges(features(spark, rows), cfg, 1, 8)
    got = {r.file_id: r.group_id for r in graph.components(edges).collect()}
    want = groups_of(brute(rows, cfg))
    assert {k: min(m for m in want if want[m] == want[k]) for k in want} == got


def test_edges_of_copies_stay_linear(spark):
    rows = [file_row(i, [9] * 64) for i in range(300)]
    edges = matching.find_edges(features(spark, rows), MatchConfig(), 1, 8)
    assert edges.count() == 299


@pytest.mark.parametrize("percent,k", [(96.0, 1), (90.0, 1), (96.0, 2), (75.0, 2)])
def test_hash_join_equals_brute_force(spark, percent, k):
    rng = random.Random(11)
    cfg = MatchConfig(percent=percent, use_phash=True, quorum_ratio=1.0 if k == 2 else 0.6)
    rows = []
    for i in range(80):
        h = [rng.getrandbits(63) for _ in range(k)] if i % 2 == 0 else [
            x ^ sum(1 << rng.randrange(62) for _ in range(rng.randrange(4))) for x in rows[-1][9]]
        rows.append(file_row(i, [0] * 64, 50 + i % 5, phashes=h))
    f = features(spark, rows)
    got = {(r.src, r.dst) for r in B.phash_pairs(f, f, cfg, k).collect()}
    need = cfg.required_positions(k)
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2)
            if abs(a[2] - b[2]) <= min(cfg.tolerance(a[2]), cfg.tolerance(b[2]))
            and sum(bin(x ^ y).count("1") <= cfg.max_bits for x, y in zip(a[9], b[9])) >= need}
    assert got == want and len(B.phash_pairs(f, f, cfg, k).collect()) == len(got)


def test_crowded_cells_are_split_without_loss(spark):
    df = spark.range(0, 90).select(F.col("id").alias("file_id"), (F.col("id") % 2).alias("k"))
    whole = B.cell_join(df, df, ["k"], B.ordered_ids()).select("l.file_id", F.col("r.file_id").alias("o"))
    split = B.cell_join(df, df, ["k"], B.ordered_ids(), rows_per_block=7).select(
        "l.file_id", F.col("r.file_id").alias("o"))
    assert rows_of(whole) == rows_of(split) and whole.count() == 2 * 45 * 44 // 2


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_result_does_not_depend_on_partitioning(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    rows = corpus(60)
    base = rows_of(matching.find_edges(features(spark, rows), MatchConfig(), 1, 8))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        again = rows_of(matching.find_edges(features(spark, rows).repartition(parts), MatchConfig(), 1, 8))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert base == again


def edges_df(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src bigint, dst bigint")


def test_components_of_long_chain_and_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)]
    got = {r.file_id: r.group_id for r in graph.components(edges_df(spark, pairs)).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[1000 + i] for i in range(80)} == {1000}


def test_merge_groups_properties(spark):
    rng = random.Random(4)
    points = {i: rng.random() * 12 for i in range(60)}
    near = {(a, b) for a, b in itertools.combinations(points, 2) if abs(points[a] - points[b]) <= 0.3}
    table = edges_df(spark, sorted(near))

    def verdict(pairs):
        p = pairs.select("*", F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"))
        return p.join(table.select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"], "left_semi") \
            .select(*pairs.columns)

    rows = graph.merge_groups(table, verdict).collect()
    by = {}
    for r in rows:
        by.setdefault(r.group_id, []).append(r)
    assert len({r.file_id for r in rows}) == len(rows) and all(len(g) >= 2 for g in by.values())
    reps = {g: {r.rep for r in m} for g, m in by.items()}
    assert all(len(s) == 1 for s in reps.values())
    # No two groups linked by a pair may have matching representatives.
    rep = {r.file_id: r.rep for r in rows}
    for a, b in near:
        if a in rep and b in rep and rep[a] != rep[b]:
            assert (min(rep[a], rep[b]), max(rep[a], rep[b])) not in near
    assert rows_of(graph.merge_groups(table, verdict)) == rows_of(graph.merge_groups(table.repartition(5), verdict))


def naive_prune(nodes, sim):
    alive, dropped = list(nodes), []
    while len(alive) >= 2:
        deg = [sum(sim(a, b) for b in alive if b != a) for a in alive]
        worst = min(range(len(alive)), key=lambda i: deg[i])
        if deg[worst] >= len(alive) // 2:
            break
        dropped.append(alive.pop(worst))
    return alive, dropped


def naive_groups(nodes, sim):
    """file -> new group by the rule, step by step."""
    kept, dropped = naive_prune(nodes, sim)
    parts, seen, out = [kept], set(), {}
    for s in dropped:
        part, queue = [], [s]
        while queue:
            cur = queue.pop()
            if cur not in seen:
                seen.add(cur)
                part.append(cur)
                queue += [o for o in dropped if o not in seen and sim(cur, o)]
        parts.append(naive_prune(sorted(part), sim)[0])
    for part in parts:
        out.update({x: min(part) for x in part if len(part) > 1})
    return out


def test_majority_prune_equals_naive(spark):
    members, edges, want = [], [], {}
    for seed in range(30):
        rng = random.Random(seed)
        n, base = rng.randrange(2, 15), 100 * seed
        pairs = {(base + a, base + b) for a, b in itertools.combinations(range(n), 2) if rng.random() < rng.choice((0.2, 0.45, 0.7))}
        members += [(base + i, base) for i in range(n)]
        edges += [(base, a, b) for a, b in pairs]
        want.update(naive_groups(range(base, base + n), lambda a, b: (min(a, b), max(a, b)) in pairs))
    got = graph.majority_prune(spark.createDataFrame(members, "file_id bigint, group_id bigint"),
                               spark.createDataFrame(edges, "group_id bigint, src bigint, dst bigint")).collect()
    assert {r.file_id: r.group_id for r in got} == want
    assert all(r.old_group == r.file_id // 100 * 100 for r in got)


def test_majority_prune_of_a_star_of_5000_and_a_clique(spark):
    star = spark.range(1, 5000).selectExpr("0L AS group_id", "0L AS src", "id AS dst")
    clique = spark.createDataFrame([(9000, a, b) for a, b in itertools.combinations(range(9000, 9005), 2)], star.schema)
    groups = spark.range(5000).selectExpr("id AS file_id", "0L AS group_id").unionByName(
        spark.range(9000, 9005).selectExpr("id AS file_id", "9000L AS group_id"))
    got = {r.file_id: r.group_id for r in graph.majority_prune(groups, star.unionByName(clique)).collect()}
    assert got == {0: 0, 4998: 0, 4999: 0, **{i: 9000 for i in range(9000, 9005)}}


@pytest.mark.parametrize("alone", [graph.ALONE, 60])
def test_majority_prune_of_chains_stores_few_tables(spark, monkeypatch, alone):
    """Groups that one task can hold take no rounds; larger ones (here: of over 60 rows) do, with the same result."""
    stored, keep = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df, label="stage": stored.append(label) or keep(df, label))
    monkeypatch.setattr(graph, "ALONE", alone)
    members, edges, want = [], [], {}
    for k, n in enumerate([9, 24, 40]):
        base = (1 << 60) + 1000 * k + 1
        pairs = {(base + a, base + b) for a, b in itertools.combinations(range(n), 2) if b - a == 1 or a < 6 and b < 12}
        members += [(base + i, k) for i in range(n)]
        edges += [(k, a, b) for a, b in pairs]
        want.update(naive_groups(range(base, base + n), lambda a, b: (min(a, b), max(a, b)) in pairs))
    got = graph.majority_prune(spark.createDataFrame(members, "file_id bigint, group_id bigint"),
                               spark.createDataFrame(edges, "group_id bigint, src bigint, dst bigint")).collect()
    assert {r.file_id: r.group_id for r in got} == want
    assert ("candidates" in stored) == (alone == 60)


@pytest.mark.parametrize("gate", [dict(folder_mode="different"), dict(exclude_hardlinks=True)])
def test_gated_forest_has_the_components_of_all_pairs(spark, gate):
    """Near files of few folders and links: as many edges as files at most, tied as all allowed pairs tie them."""
    rng = random.Random(4)
    rows = []
    for i in range(90):
        base = rng.randrange(6)
        gray = [(40 * base + 20 + (p % 3 if rng.random() < 0.3 else 0)) % 256 for p in range(64)]
        where = base * 10 + rng.randrange(1 if base % 3 == 0 else 3)
        rows.append(file_row(i, rows[rng.randrange(i)][8] if i and rng.random() < 0.3 else gray, folder=f"/f{where}", size=where, inode=where))
    table, cfg = features(spark, rows), MatchConfig(folder_depth=1, **gate)
    every = matching.find_edges(table, cfg, 1, 8)
    some = matching.find_edges(table, cfg, 1, 8, forest=True)
    assert rows_of(graph.components(some)) == rows_of(graph.components(every))
    assert some.count() <= 2 * len(rows) < every.count()
    assert some.join(every, ["src", "dst"], "left_anti").isEmpty()


def test_majority_prune_of_dense_groups_takes_no_rounds(spark, monkeypatch):
    """A group of many similar pairs but few members is pruned in a task; repeated pairs count as often as they come."""
    stored, keep = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df, label="stage": stored.append(label) or keep(df, label))
    monkeypatch.setattr(graph, "ALONE", 90)
    members, edges, want = [], [], {}
    for k, n in enumerate([20, 44, 45]):
        rng, base = random.Random(k), 1000 * k
        pairs = {(base + a, base + b) for a, b in itertools.combinations(range(n), 2) if a < n // 2 or rng.random() < 0.3}
        pairs -= {p for p in pairs if rng.random() < 0.4}
        members += [(base + i, k) for i in range(n)]
        edges += [(k, *(p if rng.random() < 0.5 else p[::-1])) for p in pairs] + [(k, base, 99_999)]
        want.update(naive_groups(range(base, base + n), lambda a, b: (min(a, b), max(a, b)) in pairs))

    def run(rows):
        got = graph.majority_prune(spark.createDataFrame(members, "file_id bigint, group_id bigint"),
                                   spark.createDataFrame(rows, "group_id bigint, src bigint, dst bigint")).collect()
        return {r.file_id: r.group_id for r in got}

    assert min(sum(e[0] == k for e in edges) for k in (1, 2)) > 90
    assert run(edges) == want and len(set(want.values())) > 1
    assert "candidates" not in stored
    again = edges + edges[::3]
    few = run(again)
    monkeypatch.setattr(graph, "ALONE", 1_000_000)
    assert run(again) == few


def test_duplicate_groups_flow(spark):
    rows = corpus(80, seed=9)
    out = duplicate_groups(features(spark, rows), MatchConfig(), 1, 8).collect()
    assert len({r.file_id for r in out}) == len(out)
    sizes = {}
    for r in out:
        sizes[r.group_id] = sizes.get(r.group_id, 0) + 1
    assert min(sizes.values()) >= 2


def test_flipped_frames_are_found(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (8, 8))
    rows = [file_row(0, a.ravel().tolist()), file_row(1, a[:, ::-1].ravel().tolist())]
    f = features(spark, rows)
    assert matching.find_edges(f, MatchConfig(), 1, 8).count() == 0
    e = matching.find_edges(f, MatchConfig(compare_flipped=True), 1, 8, frame_hash=median_bits).collect()
    assert [(r.src, r.dst, r.flags) for r in e] == [(0, 1, 1)]
    assert visual_verdict(f, MatchConfig(), 1, 64)(spark.createDataFrame([(0, 1)], "src bigint, dst bigint")).count() == 0


def test_odd_folder_names_with_both_gates(spark):
    rows = [file_row(0, [9] * 64, folder="/x/a|b", inode=1), file_row(1, [9] * 64, folder="/x/a|c", inode=2)]
    cfg = MatchConfig(folder_mode="different", exclude_hardlinks=True)
    assert [(r.src, r.dst) for r in matching.find_edges(features(spark, rows), cfg, 1, 8).collect()] == [(0, 1)]


def test_fully_masked_copies_do_not_match(spark):
    rows = [file_row(0, [0] * 64, is_image=True), file_row(1, [0] * 64, is_image=True), file_row(2, [90] * 64, is_image=True), file_row(3, [90] * 64, is_image=True)]
    cfg = MatchConfig(ignore_black=True)
    assert [(r.src, r.dst) for r in matching.find_edges(features(spark, rows), cfg, 1, 8).collect()] == [(2, 3)]


def test_flags_of_copies_in_combined_mode(spark):
    rows = [file_row(0, [9] * 64, is_image=True), file_row(1, [9] * 64, is_image=True), file_row(2, [99] * 64), file_row(3, [99] * 64)]
    cfg = MatchConfig(combine_gray_and_phash=True)
    assert {(r.src, r.dst, r.flags) for r in matching.find_edges(features(spark, rows), cfg, 1, 8).collect()} == {(0, 1, 8), (2, 3, 24)}


def embeddings(spark, vectors):
    return spark.createDataFrame([(i, 0, list(v), True) for i, v in vectors.items()], "file_id bigint, pos_idx int, q array<int>, bright boolean")


def test_ai_pairs_survive_equal_frames_and_form_groups(spark):
    rng = np.random.default_rng(4)
    noise = lambda: rng.integers(0, 256, 64).tolist()
    same = noise()
    rows = [file_row(1, same), file_row(2, same), file_row(3, noise()), file_row(4, noise()), file_row(5, noise()), file_row(6, noise())]
    cfg = MatchConfig(use_ai=True)
    emb = embeddings(spark, {1: [127, 0, 0], 2: [0, 127, 0], 3: [0, 127, 0], 4: [0, 0, 127], 5: [0, 0, 127], 6: [0, 0, 127]})
    got = {(r.src, r.dst, r.flags) for r in matching.find_edges(features(spark, rows), cfg, 1, 8, emb).collect()}
    assert got == {(1, 2, 0), (2, 3, 4), (4, 5, 4), (4, 6, 4), (5, 6, 4)}
    groups = duplicate_groups(features(spark, rows), cfg, 1, 8, emb).collect()
    assert {r.file_id for r in groups if r.group_id == 4} == {4, 5, 6}


def test_match_against_follows_all_settings(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 256, (8, 8))
    row = a.ravel().tolist()
    new = features(spark, [file_row(100, row, folder="/x/p"), file_row(101, row, folder="/x/q")])
    stored = features(spark, [file_row(0, row, folder="/x/p"), file_row(1, row, folder="/x/p"), file_row(2, row, folder="/x/r"),
                              file_row(3, a[:, ::-1].ravel().tolist(), folder="/x/z")])

    def pairs(**changes):
        return {(r.new_id, r.stored_id, r.flags) for r in matching.match_against(
            new, stored, MatchConfig().with_(**changes), 1, 8, frame_hash=median_bits).collect()}

    assert pairs() == {(100, 0, 0), (101, 0, 0), (100, 1, 0), (100, 2, 0)}
    gated = pairs(folder_mode="different")
    assert {(n, s) for n, s, _ in gated} == {(101, 0), (101, 1), (100, 2)}
    assert {(n, s, f) for n, s, f in pairs(compare_flipped=True) if s == 3} == {(100, 3, 1), (101, 3, 1)}


# --- clips --------------------------------------------------------------------------------------

def fp_files(spark, prints):
    return spark.createDataFrame([(i, float(len(p)), "/a", False, 0, len(p), list(p)) for i, p in prints.items()],
                                 "file_id bigint, duration_s double, folder string, is_image boolean, flags int, "
                                 "n int, fp array<bigint>")


@pytest.mark.parametrize("clip,source,sim,off", [
    ([0xAAAAAAAA, 0xBBBBBBBB, 0xCCCCCCCC], [0xAAAAAAAA, 0xBBBBBBBB, 0xCCCCCCCC], 1.0, 0),
    ([0, 0], [0xFFFFFFFF] * 3, 0.0, 0),
    ([0xDEADBEEF, 0xCAFEBABE], [0, 0x11111111, 0xDEADBEEF, 0xCAFEBABE, 0x22222222], 1.0, 2)])
def test_sliding_match(spark, clip, source, sim, off):
    s, c = fp_files(spark, {1: source}), fp_files(spark, {2: clip})
    pairs = spark.createDataFrame([(1, 2)], "src bigint, clip bigint")
    r = partial.sliding_match(pairs, s, c, 0.0).first()
    assert (r.similarity, r.offset_s) == (sim, off)


def test_assign_clips_prefers_longest_source(spark):
    src = fp_files(spark, {0: [1] * 50, 1: [1] * 40})
    m = spark.createDataFrame([(1, 2, 0.9, 5), (0, 2, 0.9, 5), (1, 6, 0.9, 1)],
                              "src bigint, clip bigint, similarity double, offset_s int")
    got = {r.clip: (r.src, r.offset_s, r.group_id) for r in partial.assign_clips(m, src).collect()}
    assert got == {2: (0, 5, 0), 6: (1, 1, 1)}


def planted(seed=2, n=40):
    rng = random.Random(seed)
    prints = {i: [rng.getrandbits(32) for _ in range(rng.randrange(200, 300))] for i in range(n)}
    clip = [b ^ (1 << rng.randrange(32)) if k % 5 == 0 else b for k, b in enumerate(prints[7][60:180])]
    prints[100] = clip
    return prints


def test_index_finds_planted_clip_and_prunes(spark):
    files = fp_files(spark, planted())
    found, fallback = partial.fp_candidates(files, files.where("file_id = 100"), MatchConfig())
    assert [(r.clip, r.src) for r in found.collect()] == [(100, 7)] and fallback.count() == 0


def test_hot_keys_force_fallback(spark):
    files = fp_files(spark, {i: [0] * 100 for i in range(30)})
    found, fallback = partial.fp_candidates(files, files.where("file_id = 3"), MatchConfig(), hot_limit=200)
    assert found.count() == 0 and [r.clip for r in fallback.collect()] == [3]


@pytest.mark.parametrize("mode", ["fast", "exact"])
def test_find_partial_audio(spark, mode):
    prints = planted()
    prints[101] = prints[100]
    out = partial.find_partial_audio(fp_files(spark, prints), MatchConfig(partial_mode=mode)).collect()
    assert {(r.group_id, r.file_id, r.offset_s, r.is_reference) for r in out} == {
        (7, 7, 0.0, True), (7, 100, 60.0, False), (7, 101, 60.0, False)}


def dense_files(spark, timelines, interval=5.0):
    rows = [(f, interval, s, q) for f, t in timelines.items() for s, q in t]
    d = spark.createDataFrame(rows, "file_id bigint, interval_s double, slot int, q array<tinyint>")
    files = spark.createDataFrame([(f, float(max(s for s, _ in t) + 1) * interval, "/d", False)
                                   for f, t in timelines.items()],
                                  "file_id bigint, duration_s double, folder string, is_image boolean")
    return files, d


def test_visual_timeline_match(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(40, 64))
    q = np.rint(v / np.linalg.norm(v, axis=1, keepdims=True) * 127).astype(int).tolist()
    files, d = dense_files(spark, {1: list(enumerate(q)), 2: list(enumerate(q[12:26])), 3: list(enumerate(q[5:8]))})
    rows = {r.file_id: (r.offset_s, r.flags) for r in partial.find_partial_visual(files, d, MatchConfig(), 64).collect()}
    assert rows == {1: (0.0, 0), 2: (60.0, 6)}


def test_audit_recall(spark):
    a = spark.createDataFrame([(1, 2), (3, 4)], "src int, dst int")
    b = spark.createDataFrame([(1, 2), (5, 6)], "src int, dst int")
    got = {(r.kind, r.src) for r in partial.audit_join_recall(a, b, ["src", "dst"]).collect()}
    assert got == {("missing", 5), ("extra", 3)}


def test_explain_tells_flip_and_ai(spark):
    from mirrorset.operators.explain import explain_pairs

    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 256, (8, 8)), rng.integers(0, 256, (8, 8))
    f = features(spark, [file_row(1, a.ravel().tolist()), file_row(2, a[:, ::-1].ravel().tolist()), file_row(3, b.ravel().tolist())])
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "src bigint, dst bigint")
    emb = embeddings(spark, {1: [127, 0], 2: [0, 127], 3: [127, 0]})
    rows = explain_pairs(pairs, f, MatchConfig(compare_flipped=True, use_ai=True), 1, 8, emb, median_bits).collect()
    got = {(r.dst, r.gate): r["pass"] for r in rows}
    assert got[2, "flip"] and not got[2, "ai"] and got[2, "visual"] and not got[3, "flip"] and got[3, "ai"] and got[3, "visual"]
    assert all(r.is_duplicate and len(r.similarities) == 1 and 0 <= r.similarities[0] <= 1 for r in rows)


def test_pairs_by_duration_equal_brute_force(spark):
    rng = random.Random(12)
    rows = [file_row(i, [0] * 64, rng.choice([1.0, 5.0, 5.5, 60.0, 61.0, 72.0, 300.0]), is_image=i % 6 == 0) for i in range(60)]
    for cfg in (MatchConfig(), MatchConfig(duration_percent=1.0, duration_min_s=4.0, duration_max_s=9.0), MatchConfig(duration_percent=0.0)):
        got = [(r.src, r.dst) for r in B.pairs_by_duration(features(spark, rows), features(spark, rows), cfg).collect()]
        want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and (
            a[1] or abs(a[2] - b[2]) <= min(cfg.tolerance(a[2]), cfg.tolerance(b[2])))}
        assert len(got) == len(set(got)) and set(got) == want


def test_signed_sums_leave_few_candidates(spark):
    """Pairs that meet in a cell, for the half-frame sums of before and for the signed sums."""
    rng = np.random.default_rng(3)
    shape = np.kron(rng.integers(0, 256, (1500, 4, 4)), np.ones((2, 2), int)).reshape(1500, 64)
    f = B.with_sums(features(spark, [file_row(i, x.tolist(), is_image=True) for i, x in enumerate(shape)]), 8)
    limit = MatchConfig().gray_limit(64, 1)
    rows = np.array(f.select(*B.signed_cells(limit, 3), *B.SUMS).collect())
    signed, sums = rows[:, :3], rows[:, 3:]
    halves = np.stack([sums[:, :8].sum(axis=1), sums[:, 8:].sum(axis=1)], axis=1) // (limit + 1)

    def met(cells):
        return sum(int((np.abs(cells - c) <= 1).all(axis=1).sum()) - 1 for c in cells) / 2

    assert 4 * met(signed) < met(halves)
    few = f.where("file_id < 120").cache()
    found = [rows_of(B.gray_candidates(few, few, MatchConfig(), 1, 8, patterns=n)) for n in (1, 2, 3, 4)]
    assert found[0] == found[1] == found[2] == found[3]
    assert all(abs(np.dot(B._walsh(p), B._walsh(q))) == 16 * (p == q) for p in range(4) for q in range(4))


def test_audit_counts_the_copies_of_a_vector_only(spark, tmp_path):
    """Vectors 0 to 19 come again as 50 to 69, with the same durations: their pairs are none of the audited ones."""
    import random

    import duckdb

    import __spark_entry__ as entry

    rng = random.Random(5)
    vectors = [[rng.gauss(0, 0.125) for _ in range(64)] for _ in range(20)]
    rows = [(i + base, v) for base in (0, 50) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = dict(con.execute(entry.oracle_sql()["audit_join_recall"]).fetchall())
    got = {r.kind: r.pairs for r in entry.queries()["audit_join_recall"](spark, str(tmp_path)).collect()}
    assert got == want and want["missing"] > 0


def test_explaining_clips_aligns_equal_fingerprints_once(spark, monkeypatch):
    """Pairs carry no fingerprints; a fingerprint and its copies are aligned as one."""
    from mirrorset.operators import explain

    rng, met, keep = random.Random(7), [], partial.best_alignments
    monkeypatch.setattr(explain, "best_alignments", lambda pairs, fps: met.append(pairs.distinct().count()) or keep(pairs, fps))
    source, other = ([rng.randrange(1 << 32) for _ in range(60)] for _ in range(2))
    rows = [(i, False, 60.0, 0, source) for i in range(20)] + [(100 + i, False, 20.0, 0, source[25:45]) for i in range(20)]
    rows += [(200, False, 20.0, 0, [x ^ 5 for x in other[3:23]]), (201, False, 60.0, 0, other), (202, False, 20.0, 0, None)]
    files = spark.createDataFrame(rows, "file_id bigint, is_image boolean, duration_s double, flags int, fp array<bigint>")
    pairs = [(i, 100 + j) if (i + j) % 2 else (100 + j, i) for i in range(20) for j in range(20)] + [(200, 201), (201, 202)]
    got = explain.explain_partial(spark.createDataFrame(pairs, "src bigint, dst bigint"), files, MatchConfig()).where("gate = 'audio'").collect()
    assert met == [2] and len(got) == 402
    for r in got:
        want = (201, "0.9375", 3, None) if r["clip"] == 200 else (201, None, None, "clip_audio") if r["clip"] == 202 else (r["src"], "1.0", 25, None)
        assert (r["src"], r["measured"], r["offset_s"], r["first_failure"]) == want and r["src"] < r["clip"] or r["src"] == 201
