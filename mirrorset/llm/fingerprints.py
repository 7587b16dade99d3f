"""SimHash document fingerprints and permuted block tables.

Terms are pairs of neighbouring words (a lone word is its own term), weighted by 1 + ln(count in the
document). Each term's 64-bit hash votes with its weight for or against every bit. Two fingerprints'
likeness is the cosine that their differing bits stand for, at least 0.

The search tables cut the 64 bits into blocks; fingerprints that differ in at most ``radius`` bits
agree on some choice of ``BLOCKS - radius`` whole blocks, so one table per choice, keyed by those blocks,
finds all of them. A pair is reported by the first table it meets in only.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorset.llm.arrays import mix, text_blocks, words
from mirrorset.llm.common import partitions_for, range_bounds

BITS = 64
BLOCKS = 6
ROWS_PER_PART = 8192
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _terms(data: np.ndarray, offsets: np.ndarray):
    """(hash, document, weight) of the distinct terms of every document."""
    h, _, _, doc = words(data, offsets, fold=True)
    if not len(h):
        return h, doc, np.empty(0, np.int32)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * _STEP + h[1:])
    inside = doc[:-1] == doc[1:]
    lone = count[doc] == 1
    term = np.concatenate([pair[inside], h[lone]])
    owner = np.concatenate([doc[:-1][inside], doc[lone]])
    own, first, times = np.unique(term ^ mix(owner.astype(np.uint64) + _STEP), return_index=True, return_counts=True)
    order = np.argsort(owner[first], kind="stable")
    first, times = first[order], times[order]
    return term[first], owner[first], np.round(256 * (1 + np.log(times))).astype(np.int32)


def simhash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprint of every document of a block; 0 without words."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    h, doc, weight = _terms(data, offsets)
    if len(h):
        filled, first = np.unique(doc, return_index=True)
        vote = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
        vote *= 2
        vote -= 1
        vote *= weight[:, None]  # whole numbers, so that the order of terms does not matter
        won = np.packbits(np.add.reduceat(vote, first, axis=0) > 0, axis=1, bitorder="little")
        out[filled] = np.ascontiguousarray(won).view(np.uint64)[:, 0]
    return out


def column_simhash(column) -> np.ndarray:
    found = [simhash(data, offsets) for _, _, data, offsets in text_blocks(column, 1 << 20)]
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(np.cos(np.pi * np.bitwise_count(a ^ b) / BITS), 0.0)


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of every row; null texts count as empty, other columns are not looked at."""

    def run(batches):
        for batch in batches:
            fp = column_simhash(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, "doc_id bigint, fp bigint")


def _hex(fp: np.ndarray) -> pa.Array:
    return pa.array([f"{x:016x}" for x in fp.tolist()])


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last quarter (rounded down) replaced by the start of the next document in
    ascending doc_id (null first, ties by text); the first document follows the last. Documents are
    dealt by id range once; the first id of every range is dealt to the range before it as well, so
    that each task sees the successor of its last row without a global sort. A single row is its own
    successor. Null texts count as empty; repeated rows follow one another; other columns are not looked at.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = partitions_for(spark, rows.count(), ROWS_PER_PART)
    bounds = range_bounds(rows, "doc_id", parts)
    part = F.lit(0)
    for_part = F.coalesce(F.aggregate(F.lit(bounds).cast("array<bigint>"), F.lit(0), lambda n, b: n + (F.col("doc_id") >= b).cast("int")),
                          F.lit(0)) if bounds else part
    firsts = sorted(rows.select("doc_id").withColumn("part", for_part).groupBy("part").agg(
        F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first")).collect())
    cuts, at, home = np.array(bounds, np.int64), [r["first"] for r in firsts], [r["part"] for r in firsts]
    before = {f: home[i - 1] for i, f in enumerate(at)}

    def deal(batches):
        for batch in batches:
            key = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.searchsorted(cuts, key, "right").astype(np.int32)),
                pa.array(np.zeros(len(key), bool)), batch.column("doc_id"), batch.column("text")], names)
            extra = np.flatnonzero(np.isin(key, at))
            if len(extra):
                yield pa.RecordBatch.from_arrays([
                    pa.array([before[k] for k in key[extra].tolist()], pa.int32()), pa.array(np.ones(len(extra), bool)),
                    batch.column("doc_id").take(pa.array(extra)), batch.column("text").take(pa.array(extra))], names)

    names = ["part", "follows", "doc_id", "text"]

    def compare(batches):
        held = None
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                now = list(zip(*[batch.column(c)[a:a + 512].to_pylist() for c in ("part", "follows", "doc_id", "text")]))
                if held is not None:
                    now.insert(0, held)
                held = now[-1]
                pairs = [(x, y) for x, y in zip(now, now[1:]) if x[0] == y[0] and not x[1]]
                if pairs:
                    yield _compared(pairs)

    return rows.mapInArrow(deal, "part int, follows boolean, doc_id bigint, text string") \
        .repartition(parts, "part").sortWithinPartitions("part", "follows", F.col("doc_id").asc_nulls_first(), "text") \
        .mapInArrow(compare, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                             "edited_fingerprint string, near_edited double, near_next double")


def _compared(pairs: list) -> pa.RecordBatch:
    texts = [x[3] for x, _ in pairs]
    size = [len(t) for t in texts]
    edited = [t[:n - n // 4] + y[3][:n // 4] for t, n, (_, y) in zip(texts, size, pairs)]
    fp = column_simhash(pa.array([*texts, pairs[-1][1][3]], pa.large_string()))
    follower = np.append(fp[1:-1], fp[-1])
    for i, (x, y) in enumerate(pairs[:-1]):
        if y is not pairs[i + 1][0]:
            follower[i] = column_simhash(pa.array([y[3]], pa.large_string()))[0]
    own, changed = fp[:-1], column_simhash(pa.array(edited, pa.large_string()))
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([x[2] for x, _ in pairs], pa.int64()), "n_chars": pa.array(size, pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        "fingerprint": _hex(own), "edited_fingerprint": _hex(changed),
        "near_edited": pa.array(likeness(own, changed)), "near_next": pa.array(likeness(own, follower))})


def _block_masks() -> list[int]:
    edges = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables(radius: int) -> list[int]:
    masks = _block_masks()
    return [_signed(sum(masks[i] for i in keep)) for keep in combinations(range(BLOCKS), BLOCKS - radius)]


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def within_radius(queries: DataFrame, base: DataFrame, radius: int = 3) -> DataFrame:
    """(query, fp, bits): all distinct ``base`` fingerprints within ``radius`` bits of each query, itself included.

    Both inputs have a column ``fp``; repeated values count once, so groups of copies cost one row.
    """
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"radius must be below {BLOCKS}")
    tables = _tables(radius)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(tables)])
        return df.where("fp IS NOT NULL").select("fp").distinct().select(F.col("fp").alias(name), F.explode(keys).alias("x")) \
            .select(name, "x.t", "x.k")

    met = keyed(queries, "query").join(keyed(base, "fp"), ["t", "k"])
    diff = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(diff.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(tables)])
    return met.where((_apart("query", "fp") <= radius) & (F.col("t") == first)).select("query", "fp", _apart("query", "fp").alias("bits"))


__all__ = ["column_simhash", "compare_edited", "document_fingerprints", "likeness", "simhash", "within_radius"]
