"""Prefix trie of conversations over sorted shards and a skeleton of splitter paths.

A conversation is the sequence of its turns; each turn counts by the 128-bit digest of role and text, so
a conversation is one byte string, its path, and never its texts. Paths are dealt to shards by range:
splitters are taken from a sample, by path and then by conversation, so that a group of equal paths is cut
like any other. A trie node whose members lie in two shards is a prefix of a splitter that lies between
them. The trie of the splitter paths, the skeleton, is therefore all that shards have to share: it is
broadcast (at most SKELETON_NODES nodes), each shard finishes every other node on its own in one pass over
its sorted paths, and gives partial aggregates of skeleton nodes, which are reduced by node.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorset.llm.common import cut_lineage, hash_sample, partitions_for
from mirrorset.operators.grouping import numbered_overall

#: Bytes of one turn in a path.
TURN = 16
#: Most nodes of the broadcast skeleton; splitter paths are cut so that they fit, which costs balance only.
SKELETON_NODES = 1 << 18
#: Turns of a shard, and most shards.
SHARD_TURNS, MOST_SHARDS = 500_000, 1 << 17
_SAMPLES_PER_SHARD = 64
_IDS_PER_CHUNK = 8192
_EMPTY = hashlib.sha256(b"").hexdigest()
_PATHS = "conv_id bigint, path binary, sizes array<bigint>"
_PASS = ("kind int, skel bigint, shard int, seq bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
         "n_children bigint, n_leaves bigint, saved_tokens bigint, ends string")
NODE, PARTIAL, CHUNK = 0, 1, 2
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def shared_turns(conv_id: int) -> int:
    """How many leading turns a conversation takes from the first of its five."""
    return zlib.crc32(str(conv_id).encode()) % 9


def _path_batches(shared: Callable[[int], int] | None, most: int):
    """Paths from turns sorted by family, first conversation of the family, conversation and place."""
    def run(batches):
        family = conv = None
        lead: tuple[list, list] = ([], [])
        keys, sizes, out = [], [], ([], [], [])

        def close():
            if conv is None:
                return
            if conv == family:
                lead[0][:], lead[1][:] = keys[:most], sizes[:most]
            h = shared(conv) if shared else 0
            out[0].append(conv)
            out[1].append(b"".join(lead[0][:h] + keys[h:]))
            out[2].append(lead[1][:h] + sizes[h:])

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64()))],
                ["conv_id", "path", "sizes"])
            for part in out:
                part.clear()
            return batch

        for batch in batches:
            for f, c, key, size in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if c != conv or f != family:
                    close()
                    if f != family:
                        family = f
                        lead[0].clear()
                        lead[1].clear()
                    conv = c
                    keys, sizes = [], []
                keys.append(key)
                sizes.append(size)
            if len(out[0]) >= 4096:
                yield flush()
        close()
        if out[0]:
            yield flush()
    return run


def conversation_paths(turns: DataFrame, every: int = 0, shared: Callable[[int], int] | None = None, most: int = 8) -> DataFrame:
    """(conv_id, path, sizes) of every conversation: the digests of its turns in order, and their text bytes.

    ``turns`` has conv_id, turn, role, text. With ``every``, conversation c starts with the first
    ``shared(c)`` (at most ``most``) turns of conversation c - c % every, in place of as many of its own.
    Turns go by ``turn``, null first, equal ones by digest. Null role and text count as empty. Repeated rows
    are turns of their own. Rows without a conv_id take no part; other columns are not looked at.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    family = F.col("conv_id") - F.col("conv_id") % every if every else F.col("conv_id")
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint"), F.col("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, F.lit(":"), text))).alias("key"),
        F.octet_length(text).cast("bigint").alias("size")).withColumn("family", family)
    return rows.repartition("family").sortWithinPartitions(
        "family", F.col("family") != F.col("conv_id"), "conv_id", F.col("turn").asc_nulls_first(), "key") \
        .select("family", "conv_id", "key", "size").mapInArrow(_path_batches(shared if every else None, most), _PATHS)


def splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Ascending (path, conv_id) that cut the conversations into about ``shards`` equal ranges."""
    rows = paths.count()
    if shards < 2 or rows < 2:
        return []
    longest = max(1, SKELETON_NODES // shards)
    sample = paths.select("conv_id", "path").where(hash_sample(F.xxhash64("conv_id"), rows, _SAMPLES_PER_SHARD * shards))
    ranked = cut_lineage(numbered_overall(sample, [F.col("path"), F.col("conv_id")]), "trie-sample")
    step = max(1, ranked.count() // shards)
    found = set()
    cut = ranked.where((F.col("rn") % step == 0) & (F.col("rn") < step * shards)).select(
        F.substring("path", 1, TURN * longest), "conv_id", F.octet_length("path") > TURN * longest)
    for path, conv, longer in cut.toLocalIterator():
        found.add((bytes(path), -(1 << 63) if longer else conv))
    return sorted(found)


def skeleton(cuts: list[tuple[bytes, int]]) -> tuple[list[list[int]], list[int]]:
    """Trie of the splitter paths: node numbers along every splitter (the root is 0), and every node's parent.

    A parent has a smaller number than its children.
    """
    along, parents, last = [], [-1], b""
    for path, _ in cuts:
        d = common_turns(last, path)
        ids = (along[-1] if along else [0])[:d + 1]
        for _ in range(d, len(path) // TURN):
            parents.append(ids[-1])
            ids.append(len(parents) - 1)
        along.append(ids)
        last = path
    return along, parents


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    low, high = 0, n // TURN
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid * TURN] == b[:mid * TURN]:
            low = mid
        else:
            high = mid - 1
    return low


def _deal_batches(cuts: list[tuple[bytes, int]]):
    def run(batches):
        for batch in batches:
            shard = [bisect_right(cuts, row) for row in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *batch.columns], ["shard", *batch.schema.names])
    return run


class _Shard:
    """One pass over the sorted paths of a shard; open nodes lie on a stack, finished ones in flat arrays."""

    def __init__(self, shard: int, cuts, along):
        self.shard = shard
        self.lower = (cuts[shard - 1][0], along[shard - 1]) if shard else (b"", [0])
        self.upper = (cuts[shard][0], along[shard]) if shard < len(cuts) else (b"", [0])
        self.last, self.stack = b"", []
        # skeleton parent or -1, own conv, depth, local parent or -1, members, children, leaves, tokens
        self.nodes = [array("q") for _ in range(8)]
        self.ends: dict[int, str] = {}
        self.shared: list[tuple] = []
        self._open(0, 0, b"")

    def _open(self, depth: int, size: int, path: bytes) -> None:
        skel = -1
        for cut, ids in (self.lower, self.upper):
            if depth < len(ids) and path[:depth * TURN] == cut[:depth * TURN]:
                skel = ids[depth]
        row = -1
        if skel < 0:
            row = len(self.nodes[0])
            parent = self.stack[-1]
            for column, value in zip(self.nodes, (parent[0], 0, depth, parent[1], 0, 0, 0, 0)):
                column.append(value)
        # skeleton number, row, members, smallest member, children, leaves, tokens, text bytes, ends
        self.stack.append([skel, row, 0, None, 0, 0, 0, size, []])

    def _close(self) -> None:
        depth = len(self.stack) - 1
        skel, row, n, low, children, leaves, tokens, size, ends = self.stack.pop()
        up = self.stack[-1] if self.stack else None
        if skel < 0:
            leaves = leaves or 1
            tokens += (n - 1) * size
            for column, value in zip(self.nodes[4:], (n, children, leaves, tokens)):
                column[row] = value
            self.nodes[1][row] = low
            if ends:
                self.ends[row] = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
            up[4] += 1
            up[5] += leaves
            up[6] += tokens
        elif n:
            self.shared.append((PARTIAL, skel, 0, low, depth, size, n, children, leaves, tokens, None))
            for i in range(0, len(ends), _IDS_PER_CHUNK):
                self.shared.append((CHUNK, skel, i, *[None] * 7, ",".join(map(str, ends[i:i + _IDS_PER_CHUNK]))))
        if up is not None:
            up[2] += n
            up[3] = low if up[3] is None or (low is not None and low < up[3]) else up[3]

    def add(self, conv: int, path: bytes, sizes: list[int]) -> None:
        d = common_turns(self.last, path)
        while len(self.stack) > d + 1:
            self._close()
        for depth in range(d + 1, len(path) // TURN + 1):
            self._open(depth, sizes[depth - 1], path)
        top = self.stack[-1]
        top[2] += 1
        top[3] = conv if top[3] is None else min(top[3], conv)
        top[8].append(conv)
        self.last = path

    def finish(self):
        while self.stack:
            self._close()
        skel, conv, depth, parent, n, children, leaves, tokens = self.nodes
        for lo in range(0, len(conv), 65_536):
            hi = min(lo + 65_536, len(conv))
            m = hi - lo
            yield pa.RecordBatch.from_arrays([
                pa.array([NODE] * m, pa.int32()), pa.array([s if s >= 0 else None for s in skel[lo:hi]], pa.int64()),
                pa.array([self.shard] * m, pa.int32()), pa.array([0] * m, pa.int64()), pa.array(conv[lo:hi], pa.int64()),
                pa.array(depth[lo:hi], pa.int64()), pa.array([conv[p] if p >= 0 else None for p in parent[lo:hi]], pa.int64()),
                *[pa.array(c[lo:hi], pa.int64()) for c in (n, children, leaves, tokens)],
                pa.array([self.ends.get(i, _EMPTY) for i in range(lo, hi)], pa.string())], names=_NAMES)
        if self.shared:
            kind, skel, seq, conv, depth, size, n, children, leaves, tokens, ends = zip(*self.shared)
            whole = [pa.array(c, pa.int64()) for c in (seq, conv, depth, size, n, children, leaves, tokens)]
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(skel, pa.int64()), pa.array([self.shard] * len(kind), pa.int32()),
                                              *whole, pa.array(ends, pa.string())], names=_NAMES)


_NAMES = [c.split()[0] for c in _PASS.split(", ")]


def _shard_batches(cuts, along):
    def run(batches):
        now = None
        for batch in batches:
            for shard, conv, path, sizes in zip(*[batch.column(c).to_pylist() for c in ("shard", "conv_id", "path", "sizes")]):
                if now is None or now.shard != shard:
                    if now is not None:
                        yield from now.finish()
                    now = _Shard(shard, cuts, along)
                now.add(conv, path, sizes)
        if now is not None:
            yield from now.finish()
    return run


def _digest_batches(batches):
    """(skel, ends_sha256) from chunks of ids in order; a node's ids stream through one hash state."""
    skel = state = None
    for batch in batches:
        out = []
        for s, text in zip(batch.column("skel").to_pylist(), batch.column("ends").to_pylist()):
            if s != skel:
                if state is not None:
                    out.append((skel, state.hexdigest()))
                skel, state = s, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if out:
            yield _digests(out)
    if state is not None:
        yield _digests([(skel, state.hexdigest())])


def _digests(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())],
                                      ["skel", "ends_sha256"])


def _roll_up(partials: DataFrame, parents: list[int]) -> list[tuple]:
    """Whole skeleton nodes (skel, conv_id, depth, parent, ...) from reduced partial aggregates; at most SKELETON_NODES."""
    facts = {r["skel"]: [r["conv_id"], r["depth"], r["size"], r["n"], r["children"], r["leaves"], r["tokens"]] for r in partials.collect()}
    for skel in sorted(facts, reverse=True):
        own = facts[skel]
        own[5] = own[5] if own[4] else 1
        own[6] += (own[3] - 1) * own[2]
        up = facts.get(parents[skel])
        if up is not None:
            up[4] += 1
            up[5] += own[5]
            up[6] += own[6]
    return [(skel, conv, depth, facts[parents[skel]][0] if skel else None, n, children, leaves, tokens)
            for skel, (conv, depth, _, n, children, leaves, tokens) in sorted(facts.items())]


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per distinct prefix of the conversations' turns, the root included; see COLUMNS.

    ``paths`` is what :func:`conversation_paths` gives. conv_id is a node's smallest member, parent_conv_id
    that of its parent (null for the root), n_convs its members, n_children its child nodes, n_leaves the
    childless nodes of its subtree, saved_tokens the sum over its subtree of (members - 1) times the bytes
    of the last text, ends_sha256 the hash of the comma-joined ascending conv_ids that end in it. Equal
    paths share all nodes. No conversations give no rows, not even a root. A path is held in one row
    (16 bytes a turn), so memory is bounded by the longest conversation's number of turns.
    """
    spark = paths.sparkSession
    stored = cut_lineage(paths, "trie-paths")
    if shards is None:
        turns = stored.agg(F.sum(F.size("sizes"))).first()[0] or 0
        shards = min(MOST_SHARDS, partitions_for(spark, turns, SHARD_TURNS))
    cuts = splitters(stored, shards)
    along, parents = skeleton(cuts)
    dealt = stored.mapInArrow(_deal_batches(cuts), "shard int, " + _PATHS)
    done = cut_lineage(dealt.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id").mapInArrow(
        _shard_batches(cuts, along), _PASS), "trie-nodes")
    # A partial row holds the text bytes in parent_conv_id's place.
    partials = done.where(F.col("kind") == PARTIAL).groupBy("skel").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("size"), F.sum("n_convs").alias("n"),
        F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("tokens"))
    ends = done.where(F.col("kind") == CHUNK).select("skel", "shard", "seq", "ends").repartition("skel") \
        .sortWithinPartitions("skel", "shard", "seq").select("skel", "ends").mapInArrow(_digest_batches, "skel bigint, ends_sha256 string")
    top = spark.createDataFrame(_roll_up(partials, parents), "skel bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
                                "n_children bigint, n_leaves bigint, saved_tokens bigint")
    whole = top.join(ends, "skel", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY))).select(*COLUMNS)
    above = top.select("skel", F.col("conv_id").alias("_above"))
    local = done.where(F.col("kind") == NODE).join(F.broadcast(above), "skel", "left").withColumn(
        "parent_conv_id", F.coalesce("_above", "parent_conv_id")).withColumn("ends_sha256", F.col("ends")).select(*COLUMNS)
    return whole.unionByName(local)
