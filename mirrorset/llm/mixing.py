"""Mixing sources to target weights as a minimum-cost flow.

Documents may belong to several sources. They are first aggregated by membership pattern, so the
flow problem has one node per pattern and per source and does not grow with the documents. Tokens
flow from patterns to the quotas of their sources; taking a pattern for the second and third time
costs more each time (convex cost), so repetition is used only where a quota cannot be met
otherwise. Inside a pattern, documents are taken in a seeded hash order.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorset.llm.common import cut_lineage
from mirrorset.operators.grouping import running_sum

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 20240229


def word_count(text_col: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint")


def capped_targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of the total by weight; a share over cap * size stops there and its excess goes to the others."""
    total, fixed = float(sum(sizes)), {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        weight = sum(weights[i] for i in open_)
        left = total - sum(fixed.values())
        over = [i for i in open_ if left * weights[i] / weight > cap * sizes[i]] if weight else []
        if not over:
            return [fixed[i] if i in fixed else left * weights[i] / weight for i in range(len(sizes))]
        fixed.update({i: cap * sizes[i] for i in over})


def route(capacity: list[int], members: list[list[int]], quotas: list[int], levels: int = MAX_REPEATS) -> list[dict[int, int]]:
    """Minimum-cost maximum flow: tokens of each pattern that go to each of its sources.

    Pattern p offers ``capacity[p]`` tokens ``levels`` times; the k-th time costs k a token. Augments
    along cheapest paths (Dijkstra with potentials). Ties go to lower node numbers.
    """
    n_p, n_s = len(capacity), len(quotas)
    source, sink, n = n_p + n_s, n_p + n_s + 1, n_p + n_s + 2
    to, room, cost, out = [], [], [], [[] for _ in range(n)]

    def arc(u: int, v: int, c: int, w: int) -> None:
        for a, b, r, x in ((u, v, c, w), (v, u, 0, -w)):
            out[a].append(len(to))
            to.append(b)
            room.append(r)
            cost.append(x)

    for p in range(n_p):
        for k in range(levels):
            arc(source, p, capacity[p], k)
    first = len(to)
    owners = [(p, s) for p in range(n_p) for s in members[p]]
    for p, s in owners:
        arc(p, n_p + s, capacity[p] * levels, 0)
    for s in range(n_s):
        arc(n_p + s, sink, quotas[s], 0)
    height = [0] * n
    while True:
        far, via = [None] * n, [-1] * n
        far[source], heap = 0, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out[u]:
                v = to[e]
                if room[e] > 0 and (far[v] is None or d + cost[e] + height[u] - height[v] < far[v]):
                    far[v], via[v] = d + cost[e] + height[u] - height[v], e
                    heapq.heappush(heap, (far[v], v))
        if far[sink] is None:
            break
        worst = max(x for x in far if x is not None)
        height = [h + (worst if far[v] is None else far[v]) for v, h in enumerate(height)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step
    flow: list[dict[int, int]] = [{} for _ in range(n_p)]
    for i, (p, s) in enumerate(owners):
        flow[p][s] = room[first + 2 * i + 1]
    return flow


def _order(id_col: str, text_col: str, seed: int):
    """Seeded order of rows: half of an md5, which SQL has as well."""
    parts = [F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))]
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16)


def plan(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = MAX_REPEATS, seed: int = SEED):
    """(per pattern: copies and hash cut-off, per source: size and target) as small Python lists.

    ``docs`` is a stored table of doc_id, members (array of sources, sorted), size. Patterns and
    sources, one row each, come to the driver; documents do not. Sources are weighed by their code
    point order, null last.
    """
    patterns = docs.groupBy("members").agg(F.sum("size").alias("t")).orderBy("members").collect()
    sizes: dict = {}
    for row in patterns:
        for s in row["members"]:
            sizes[s] = sizes.get(s, 0) + row["t"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    total = sum(row["t"] for row in patterns)
    held = [sizes[s] for s in names]
    wanted = [weights[i % len(weights)] for i in range(len(names))]
    scale = total / sum(held) if sum(held) else 0.0
    targets = capped_targets([x * scale for x in held], wanted, cap) if total else [0.0] * len(names)
    at = {s: i for i, s in enumerate(names)}
    flow = route([r["t"] for r in patterns], [[at[s] for s in r["members"]] for r in patterns],
                 [int(x + 0.5) for x in targets], int(cap))
    rows = []
    for row, given in zip(patterns, flow):
        full, rest = divmod(sum(given.values()), row["t"]) if row["t"] else (0, 0)
        rows.append((row["members"], full, rest))
    return rows, [(s, held[at[s]], float(targets[at[s]])) for s in names]


def _plan_frame(spark: SparkSession, docs: DataFrame, rows: list) -> DataFrame:
    """(members, full, cut): every document is taken ``full`` times and once more up to hash ``cut``.

    The cut-off is the hash up to which the running sum of sizes, by hash, stays nearest to the rest.
    """
    frame = spark.createDataFrame(rows, "members array<string>, full int, rest bigint")
    parts = docs.join(frame.where("rest > 0"), "members").select(
        F.to_json("members").alias("pattern"), "members", "rest", "size", "doc_id", "h")
    summed = running_sum(parts.drop("members"), ["pattern"], [F.col("h"), F.col("doc_id")], F.col("size"), "upto")
    cuts = summed.where(F.col("upto") * 2 - F.col("size") <= F.col("rest") * 2).groupBy("pattern").agg(F.max("h").alias("cut"))
    return frame.withColumn("pattern", F.to_json("members")).join(cuts, "pattern", "left").select("members", "full", "cut")


def _members(docs: DataFrame, source_col: str):
    source = F.col(source_col)
    return F.array_sort(F.array_distinct(source if dict(docs.dtypes)[source_col].startswith("array") else F.array(source)))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), _members(docs, source_col).alias("members"), word_count(text_col).alias("size"),
        _order(id_col, text_col, seed).alias("h")), "sizes")


def _copies(h):
    return F.col("full") + F.coalesce((h <= F.col("cut")).cast("int"), F.lit(0))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple = WEIGHTS, cap: float = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, members, size, source_size, target, copies, taken) of every row.

    ``source_col`` is a string or, for overlapping sources, an array of them; source_size and target
    are those of the first source. Null sources are one source, weighed last. A null text has size
    0. Rows of one id are taken together. A pattern's documents are taken at most ``cap`` times. Ties in the
    seeded order go by id; repeated rows stay rows and are taken alike; other columns are not looked at; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    sized = _sized(docs, id_col, text_col, source_col, seed)
    rows, sources = plan(sized, weights, cap, seed)
    if not rows:
        return sized.select("doc_id", "members", "size", *[F.lit(0).cast(t).alias(c) for c, t in (
            ("source_size", "bigint"), ("target", "double"), ("copies", "int"), ("taken", "bigint"))])
    cut = cut_lineage(_plan_frame(spark, sized, rows), "mix-plan")
    facts = spark.createDataFrame(sources, "s string, source_size bigint, target double")
    with_facts = cut.join(facts, F.col("members")[0].eqNullSafe(F.col("s")), "left").drop("s")
    return sized.join(with_facts, "members").withColumn("copies", _copies(F.col("h"))).select(
        "doc_id", "members", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple = WEIGHTS, cap: float = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, all columns kept.

    Copies follow from the pattern's plan and the row's own hash, so texts are not shuffled. Nulls, ties and
    repeated rows as in :func:`mix_sources`; columns keep their names and values; an empty table stays empty.
    """
    spark, names = docs.sparkSession, docs.columns
    sized = _sized(docs, id_col, text_col, source_col, seed)
    rows, _ = plan(sized, weights, cap, seed)
    if not rows:
        return docs
    cut = cut_lineage(_plan_frame(spark, sized, rows), "mix-plan")
    marked = docs.select(_members(docs, source_col).alias("members"), _order(id_col, text_col, seed).alias("h"),
                         F.struct(*[F.col(c) for c in names]).alias("row")).join(cut, "members")
    return marked.withColumn("copy", F.explode(F.array_repeat(F.lit(1), _copies(F.col("h"))))).select("row.*")
