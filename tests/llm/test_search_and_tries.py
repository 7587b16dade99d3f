"""Prefix trie, nearest neighbours and spelling variants against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorset.llm import near_copies, neighbours, prefix_trie, spelling

TURNS = "conv_id bigint, turn bigint, role string, text string"
CLASHING = "key size path sizes family shard skel kind seq u v s x q code word n m form root mate blocks vec embedding2 rank score".split()


def clash(df):
    for i, c in enumerate(CLASHING):
        df = df.withColumn(c, F.lit(i) if i % 2 else F.lit("x"))
    return df


# ---- prefix trie


def brute_trie(rows, shared=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()
            convs[conv].append((turn is not None, turn or 0, digest, (role, text)))
    convs = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9 if shared else 0
        built[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:]) if shared else tuple(own)
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if built[c] == p)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def rows_of(df):
    return Counter(tuple(r[c] for c in prefix_trie.COLUMNS) for r in df.collect())


def random_turns(seed, convs=120, hot=40):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(("user", "assistant")), f"text {rng.randrange(3)}"))
    for c in range(1000, 1000 + hot):
        rows += [(c, t, "user", f"same {t}") for t in range(4)]
    rows += [(7000, t, "user", "same 0" if not t else f"long {t % 50}") for t in range(700)]
    return rows


@pytest.mark.parametrize("shards", [1, 2, 7, 30])
@pytest.mark.parametrize("shared", [True, False])
def test_trie_against_brute_force(spark, shards, shared):
    rows = random_turns(shards)
    paths = prefix_trie.conversation_paths(spark.createDataFrame(rows, TURNS), 5 if shared else 0, prefix_trie.shared_turns)
    assert rows_of(prefix_trie.prefix_trie(paths, shards)) == brute_trie(rows, shared)


def test_trie_with_short_splitters(spark, monkeypatch):
    """Splitters cut to one turn cost balance and never change the result."""
    monkeypatch.setattr(prefix_trie, "SKELETON_NODES", 4)
    rows = random_turns(9)
    paths = prefix_trie.conversation_paths(spark.createDataFrame(rows, TURNS))
    assert rows_of(prefix_trie.prefix_trie(paths, 9)) == brute_trie(rows, False)


def test_trie_of_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, 1, "assistant", None), (None, 0, "user", "lost"),
            (2, 5, None, ""), (5, 0, "user", "x" * 300_000), (6, 3, "user", "b"), (11, 0, "", "b"), (12, None, "u", "é"), (10, 0, "u", "é"), (14, 1, "q", "z")]
    turns = clash(spark.createDataFrame(rows, TURNS))
    paths = prefix_trie.conversation_paths(turns, 5, prefix_trie.shared_turns)
    assert rows_of(prefix_trie.prefix_trie(paths)) == brute_trie(rows)
    none = prefix_trie.prefix_trie(prefix_trie.conversation_paths(turns.limit(0)))
    assert none.count() == 0 and none.columns == list(prefix_trie.COLUMNS)


def test_skeleton_numbers():
    turn = [bytes([i]) * 16 for i in range(5)]
    cuts = [(turn[0] + turn[1], 1), (turn[0] + turn[1], 9), (turn[0] + turn[2], 4), (turn[3], 2)]
    along, parents = prefix_trie.skeleton(cuts)
    assert along == [[0, 1, 2], [0, 1, 2], [0, 1, 3], [0, 4]] and parents == [-1, 0, 1, 1, 0]


# ---- nearest neighbours


def brute_nearest(rows, wanted, k=5):
    out = {}
    for q, a in rows.items():
        if q % wanted:
            continue
        near = sorted(((-float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), i) for i, b in rows.items() if i != q))
        out[q] = near[:k]
    return out


def test_neighbours_recall_on_clusters(spark):
    """Recall against brute force on clusters, copies and noise, and exact scores."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 24))
    rows = {i: (centres[i % 12] + 0.6 * rng.standard_normal(24)) for i in range(2500)}
    rows |= {i: rows[0] for i in range(3000, 3900)}
    rows |= {i: rows[1] + 0.01 * rng.standard_normal(24) for i in range(4000, 4400)}
    rows = {i: v.astype(np.float32).astype(float) for i, v in rows.items()}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows.items()], "vec_id bigint, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(rows, 50)
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and q not in {v for _, v, _ in mine}
        for (_, v, s), following in zip(mine, mine[1:] + [None]):
            assert math.isclose(s, float(np.dot(rows[q], rows[v]) / (np.linalg.norm(rows[q]) * np.linalg.norm(rows[v]))), abs_tol=1e-12)
            assert following is None or s > following[2] or (s == following[2] and v < following[1])
        # A tie counts as found where its score does.
        hits += sum(s >= -near[-1][0] - 1e-12 for _, _, s in mine)
    assert hits / (5 * len(want)) >= 0.95
    assert [v for _, v, _ in sorted(got[3000])] == [0, 3001, 3002, 3003, 3004]


def test_neighbours_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0]), (5, None), (None, [1.0, 0.0]), (6, [0.0, 0.0]),
            (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (100, [-1.0]), (11, [])]
    df = clash(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 6)) for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    half = round(math.sqrt(0.5), 6)
    assert got == {(0, 1): (50, 1.0), (0, 2): (4, half), (0, 3): (3, 0.0), (0, 4): (100, -1.0),
                   (50, 1): (0, 1.0), (50, 2): (4, half), (50, 3): (3, 0.0), (50, 4): (100, -1.0),
                   (100, 1): (3, 0.0), (100, 2): (4, -half), (100, 3): (0, -1.0), (100, 4): (50, -1.0)}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(50, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in neighbours.nearest(alone, F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 1)]


# ---- spelling variants


def brute_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_forms(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def spelled(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


def noisy_documents(seed, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéñÖ÷") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(80):
            w = base[min(int(rng.expovariate(0.12)), 39)]
            if rng.random() < 0.5:
                at = rng.randrange(len(w))
                w = rng.choice((w[:at] + w[at + 1:], w[:at] + rng.choice("abc") + w[at:], w[:at] + rng.choice("abc") + w[at + 1:]))
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice((" ", ", ", "-1-")).join(words)))
    return docs


def test_vectors_travel_in_proportion(spark):
    """Five times the vectors make about five times the rows of a round, also where blocks are few."""
    def sent(n):
        rng = np.random.default_rng(n)
        pairs = np.column_stack([np.repeat(np.arange(n), 20), rng.integers(0, n, 20 * n)]).tolist()
        lists = spark.createDataFrame(pairs, "u bigint, v bigint").withColumn("block", F.floor(F.col("u") / neighbours.ROUND_BLOCK))
        return neighbours._visits(lists).count()

    assert sent(10_240) < 6.5 * sent(2_048)


def test_spelling_against_brute_force(spark, monkeypatch):
    docs = noisy_documents(1)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = brute_forms(brute_words(docs))
    assert sum(f is not None for _, f, *_ in want) > 20
    got = spelled(spelling.spelling_forms(df))
    assert len(got) == len(set(got)) and set(got) == want
    # Crowded keys are cut into blocks and parts are small; the result is the same.
    monkeypatch.setattr(spelling, "WORDS_PER_BLOCK", 3)
    words = spelling.vocabulary(df)
    pairs = [(r["word"], r["mate"]) for r in spelling.near_words(words).collect()]
    near = {(a, b) for a in brute_words(docs) for b in brute_words(docs) if one_apart(a, b)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == near


def test_one_edit_kernel():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 7))) for _ in range(700)})
    q, h = spelling.one_edit(words, words)
    got = list(zip(q.tolist(), h.tolist()))
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if len(b) >= len(a) and one_apart(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_spelling_of_awkward_rows(spark):
    long_run = "ab" * 40_000
    docs = [(1, None), (2, ""), (3, "Hello hello HELLO hellos hellos hellos"), (3, "Hello hello HELLO hellos hellos hellos"), (None, "hello hello"),
            (4, " ".join([long_run] * 3)), (5, " ".join([long_run + "a"] * 7)), (6, "ÀÀÀÀÀ ÀÀÀÀÀ ààààà ààààà ààààà 😀hello")]
    df = clash(spark.createDataFrame(docs, "doc_id bigint, text string"))
    got = spelled(spelling.spelling_forms(df))
    assert len(got) == len(set(got)) and set(got) == brute_forms(brute_words(docs))
    assert spelling.spelling_forms(df.limit(0)).count() == 0


def test_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(45)], "word string, form string")
    assert {r["root"] for r in spelling.follow(forms).collect()} == {"w45"}


# ---- shared shingles of different texts


def _postings_of(spark, monkeypatch, df):
    """Groups of the texts, and rows by label of the tables that the step stores."""
    stored = Counter()
    keep = near_copies.cut_lineage

    def counting(rows, label="stage"):
        out = keep(rows, label)
        stored[label] += out.count()
        return out

    monkeypatch.setattr(near_copies, "cut_lineage", counting)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(df, words=5, similarity=0.8).collect()}
    return got, stored


def test_small_postings_take_one_round(spark, monkeypatch):
    """Texts that meet in some shingles only are compared once; their postings are neither stored nor joined again."""
    rng = random.Random(5)
    quotes = [" ".join(f"q{k}w{i}" for i in range(12)) for k in range(150)]
    texts = {}
    for i in range(300):  # each quote stands in two texts of very different sizes
        own = [f"t{i}w{j}" for j in range(40 + 100 * (i % 2))]
        texts[i] = " ".join([quotes[i // 2], *own])
    body = [f"b{j}" for j in range(200)]
    for i in range(60):  # one family: postings of more members than the first round has pivots
        texts[1000 + i] = " ".join(w if rng.random() > 0.004 else f"{w}x{i}" for w in body)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got, stored = _postings_of(spark, monkeypatch, df)
    assert all(got[i] == i for i in range(300)) and len({got[i] for i in texts if i >= 1000}) < 60
    assert "copy-firsts" not in stored and "copy-open" not in stored
    shingles = sum(len(t.split()) for t in texts.values())
    assert stored["copy-postings"] < shingles / 4


@pytest.mark.parametrize("high", [2, 8])
def test_rounds_give_the_pairs_of_brute_force(high):
    """Pivots of a round meet all later members of their postings, however the rows are cut into batches."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(high)
    rows = sorted({(int(k), int(f)) for k, f in zip(rng.zipf(1.3, 3000) % 50, rng.integers(0, 500, 3000))})
    size, place = rng.integers(20, 30, 500), rng.integers(0, 3, 500)
    whole = [(k, f, int(size[f]), int(place[f]), f % 7) for k, f in rows for _ in range(1 + f % 2)]
    names = ["key", "fp", "size", "place", "root"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*whole[a:a + 37])], names) for a in range(0, len(whole), 37)]
    want, rest, members = set(), [], {}
    for k, f in rows:
        members.setdefault(k, []).append(f)
    for k, fs in members.items():
        rest += [(k, f) for f in fs if len(fs) > high]
        for i, a in enumerate(fs[1:high], 1):
            for b in fs[i + 1:]:
                if a % 7 != b % 7 and min(size[a], size[b]) >= 0.8 * max(size[a], size[b]) - 1e-6 and \
                        min(size[a] - place[a], size[b] - place[b]) >= near_copies.least_common(size[a], size[b], 0.8):
                    want.add((a, b))
    near_merged = near_copies._merged
    try:
        near_copies._merged = lambda b: b
        out = [r for b in near_copies._round_batches(1, high, 0.8)(batches) for r in b.to_pylist()]
    finally:
        near_copies._merged = near_merged
    assert {(r["fp"], r["dst"]) for r in out if r["dst"] is not None} == want
    assert sorted((r["key"], r["fp"]) for r in out if r["dst"] is None) == sorted(rest)


def test_signatures_lose_no_similar_pair():
    """Different bits never exceed the different shingles, whatever the widths; far sets are told apart."""
    rng = np.random.default_rng(3)
    far = 0
    for n in [0, 1, 2, 5, 30, 120, 250, 600, 5000]:
        for keep in (1.0, 0.95, 0.85, 0.0):
            a = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
            b = np.unique(np.append(a[:int(keep * len(a))], rng.integers(0, 1 << 48, len(a) - int(keep * len(a)) + n // 20).astype(np.uint64)))
            x, y = near_copies.signatures(np.append(a, b), np.array([0, len(a), len(a) + len(b)]))
            common = len(np.intersect1d(a, b))
            if common >= 0.8 * (len(a) + len(b) - common):
                assert near_copies.may_be_similar(x, y, 0.8) and near_copies.may_be_similar(y, x, 0.8)
            elif n >= 30 and keep == 0:
                far += near_copies.may_be_similar(x, y, 0.8)
    assert far == 0


def test_stored_tables_leave_no_shuffle_files(spark):
    from mirrorset import runtime

    def files():
        kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in re.findall(r"shuffle_\d+_\w+\.data", kept.mkString(" "))}

    before = files()
    out = runtime.cut_lineage(spark.range(1000).repartition(5, "id"), "shuffled")
    assert not files() - before
    assert out.count() == 1000
    assert spark.conf.get(runtime._CLEANUP, "false") == "false"
    runtime.forget(out)
