"""Deleted-interpolation language model: P(w|h) = a2 f(w|h) + a1 f(w) + a0 / (V + 1).

f are maximum-likelihood estimates; the weights depend on how often the context h was seen (buckets
by powers of two) and are learned by expectation-maximisation on documents deleted from the counts.

How it runs. Documents are packed into chunks of about CHUNK_TOKENS tokens, stored once as word
hashes and word numbers. Each chunk sends its distinct n-gram keys with their counts, cut into key
ranges, to the reducers; a range's totals go back to every chunk in the order of its own keys. Each
distinct n-gram of a chunk thus crosses the network once as a key and once as a count, a frequent one
is one entry per chunk wherever it occurs, and no count table is ever broadcast. Word keys are full
64-bit hashes; pair keys keep 40 bits within their range, of which there are as many as the corpus needs.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorset.llm.arrays import blocks, mix, text_blocks, utf8, words
from mirrorset.llm.common import cut_lineage, id_remainder, partitions_for

CHUNK_TOKENS = 1_500_000
KEYS_PER_RANGE = 1_500_000
PAIR_BITS = 40
#: Resolution of the held-out table that the weights are learned on: steps per factor of ten.
STEPS = 50
ROUNDS = 100
_END = np.uint64(0x5F3759DF12345677)
_BEGIN = np.uint64(0x1F83D9ABFB41BD6B)
_STEP = np.uint64(0x9E3779B97F4A7C15)
HELD_OUT, DELETED, FIT = 0, 1, 2
TOP_BUCKET = 40


def _squeeze(a: np.ndarray) -> bytes:
    """Bytes of an array, by byte plane, compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else np.empty(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _expand(data: bytes, dtype, n: int) -> np.ndarray:
    kind = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind)[:, 0] if n else np.empty(0, kind)


def _tokens(column):
    """(token hashes with one end per document, tokens per document) of a text column."""
    hashes, sizes = [], []
    for first, last, data, offsets in text_blocks(column):
        h, _, _, doc = words(data, offsets, fold=True)
        count = np.bincount(doc, minlength=last - first)
        size = count + 1
        out = np.full(int(size.sum()), _END, np.uint64)
        out[np.arange(len(h)) + doc] = h
        hashes.append(out)
        sizes.append(size)
    return (np.concatenate(hashes), np.concatenate(sizes)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _chunk_batches(batches):
    held = {}

    def flush(kind):
        parts = held.pop(kind)
        h, size = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        ids = pa.concat_arrays([p[0] for p in parts])
        role = np.concatenate([p[3] for p in parts])
        known, number = np.unique(h, return_inverse=True)
        trained = np.repeat(role, size)
        name = int.from_bytes(os.urandom(8), "little") >> 1  # stored with the chunk, so it stays the same for every reader
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([name]), "deleted": pa.array([kind == 1]), "n_docs": pa.array([len(size)]), "n_words": pa.array([len(known)]),
            "n_tokens": pa.array([len(h)]), "fit_tokens": pa.array([int((trained == FIT).sum())]), "del_tokens": pa.array([int((trained == DELETED).sum())]),
            "fit_docs": pa.array([int((role == FIT).sum())]), "del_docs": pa.array([int((role == DELETED).sum())]),
            "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "role": pa.array([role.astype(np.uint8).tobytes()]),
            "size": pa.array([_squeeze(size.astype(np.uint32))]), "words": pa.array([_squeeze(np.diff(known, prepend=np.uint64(0)))]),
            "numbers": pa.array([_squeeze(number.astype(np.uint32))])})

    count = {0: 0, 1: 0}
    for batch in (b.slice(first, last - first) for b in batches for first, last in blocks(utf8(b.column("text"))[1])):
        h, size = _tokens(batch.column("text"))
        role = batch.column("role").to_numpy()
        own = np.repeat(role == DELETED, size)
        for kind in (0, 1):
            docs = np.flatnonzero((role == DELETED) == bool(kind))
            if not len(docs):
                continue
            held.setdefault(kind, []).append((batch.column("doc_id").take(pa.array(docs)), h[own == bool(kind)], size[docs], role[docs]))
            count[kind] += int(size[docs].sum())
            if count[kind] >= CHUNK_TOKENS:
                yield flush(kind)
                count[kind] = 0
    for kind in list(held):
        yield flush(kind)


_CHUNKS = ("chunk bigint, deleted boolean, n_docs bigint, n_words bigint, n_tokens bigint, fit_tokens bigint, del_tokens bigint, "
           "fit_docs bigint, del_docs bigint, ids array<bigint>, role binary, size binary, words binary, numbers binary")


class Chunk:
    """A stored chunk: documents, word hashes, and its sorted distinct n-gram keys."""

    def __init__(self, row, ranges_bits: int):
        self.name, n = row["chunk"], row["n_tokens"]
        self.size = _expand(row["size"], np.uint32, row["n_docs"]).astype(np.int64)
        self.role = np.frombuffer(row["role"], np.uint8)
        self.ids = row["ids"]
        self.known = np.cumsum(_expand(row["words"], np.uint64, row["n_words"]), dtype=np.uint64)
        self.number = _expand(row["numbers"], np.uint32, n).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.shift = np.uint64(64 - ranges_bits) if ranges_bits else None
        h = self.known[self.number]
        before = np.roll(h, 1)
        before[self.first] = _BEGIN
        with np.errstate(over="ignore"):
            pair = mix(before * _STEP + h)
        self.drop = np.uint64(max(0, 64 - ranges_bits - PAIR_BITS))
        self.pairs, self.pair_number = np.unique(pair >> self.drop, return_inverse=True)
        self.token_role = np.repeat(self.role, self.size)

    def ranges(self, keys: np.ndarray, ranges_bits: int, width: int) -> np.ndarray:
        """Position of the first key of every range, and the end."""
        top = (np.arange(1 << ranges_bits, dtype=np.uint64)) << np.uint64(width - ranges_bits) if ranges_bits else np.zeros(1, np.uint64)
        return np.append(np.searchsorted(keys, top), len(keys))

    def counts(self, number: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.bincount(number[self.token_role == r], minlength=n).astype(np.uint32) for r in (FIT, DELETED))


def _key_batches(ranges_bits: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row, ranges_bits)
                out = {k: [] for k in ("range", "chunk", "pairs", "n", "keys", "fit", "deleted")}
                for is_pair, keys, number, width in ((False, c.known, c.number, 64), (True, c.pairs, c.pair_number, 64 - int(c.drop))):
                    fit, deleted = c.counts(number, len(keys))
                    at = c.ranges(keys, ranges_bits, width)
                    for r, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
                        if a < b:
                            for k, v in zip(out, (r, c.name, is_pair, b - a, _squeeze(np.diff(keys[a:b], prepend=np.uint64(0))),
                                                  _squeeze(fit[a:b]), _squeeze(deleted[a:b]))):
                                out[k].append(v)
                del c
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "range" else None) for k, v in out.items()})

    return run


_KEYS = "range int, chunk bigint, pairs boolean, n bigint, keys binary, fit binary, deleted binary"
_TOTALS = "range int, chunk bigint, pairs boolean, n bigint, fit binary, deleted binary, vocabulary bigint"


def _sum_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals of one key range, given back to every chunk in the order of its own keys."""
    keys = np.concatenate([np.cumsum(_expand(k, np.uint64, n), dtype=np.uint64) for k, n in zip(pdf["keys"], pdf["n"])])
    _, place = np.unique(keys, return_inverse=True)
    del keys
    ends = np.cumsum(pdf["n"].to_numpy())
    total = []
    for col in ("fit", "deleted"):
        own = np.concatenate([_expand(x, np.uint32, n) for x, n in zip(pdf[col], pdf["n"])])
        total.append(np.bincount(place, weights=own).astype(np.uint32))
    pair = bool(pdf["pairs"].iloc[0])
    fit, deleted = total[0][place], total[1][place]
    seen = 0 if pair else int(((total[0].astype(np.int64) + total[1]) > 0).sum())
    out = pdf[["range", "chunk", "pairs", "n"]].copy()
    out["fit"] = [_squeeze(fit[b - n:b]) for b, n in zip(ends, pdf["n"])]
    out["deleted"] = [_squeeze(deleted[b - n:b]) for b, n in zip(ends, pdf["n"])]
    out["vocabulary"] = [seen] + [0] * (len(pdf) - 1)
    return out


def _totals_of(back: pd.DataFrame, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    rows = back[back["pairs"] == pairs].sort_values("range")
    return tuple(np.concatenate([_expand(x, np.uint32, n) for x, n in zip(rows[col], rows["n"])] or [np.empty(0, np.uint32)]).astype(np.int64)
                 for col in ("fit", "deleted"))


def _bucket(context: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: 0 for unseen, then one per power of two."""
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))).astype(np.int64), TOP_BUCKET), 0)


def _events(c: Chunk, word: np.ndarray, pair: np.ndarray, docs: int):
    """(bucket, f(w|h), f's numerator c(w)) of every token, for the given counts."""
    own = word[c.number]
    context = np.roll(own, 1)
    context[c.first] = docs
    both = pair[c.pair_number]
    return _bucket(context), both / np.maximum(context, 1), own


def _quantise(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(-np.log10(np.maximum(p, 1e-300)) * STEPS).astype(np.int64), -1)


def learn_weights(table: pd.DataFrame, uniform: float) -> np.ndarray:
    """Weights (pair, word, uniform) of every context bucket by expectation-maximisation.

    table: bucket, q2, q1, n - held-out events by their rounded estimates. A bucket without events has
    the weights of the next lower one that has some; bucket 0 never uses the pair estimate.
    """
    weights = np.tile(np.array([1 / 3, 1 / 3, 1 / 3]), (TOP_BUCKET + 1, 1))
    weights[0] = [0, 0.5, 0.5]
    last = None
    for b in range(TOP_BUCKET + 1):
        t = table[table["bucket"] == b]
        if len(t):
            q2, q1, n = (t[x].to_numpy() for x in ("q2", "q1", "n"))
            p = np.stack([np.where(q2 >= 0, 10.0 ** (-q2 / STEPS), 0), np.where(q1 >= 0, 10.0 ** (-q1 / STEPS), 0), np.full(len(t), uniform)])
            w = weights[b]
            for _ in range(ROUNDS):
                share = w[:, None] * p
                w = (share / share.sum(axis=0) * n).sum(axis=1) + np.array([1e-3 * (b > 0), 1e-3, 1e-3])
                w = w / w.sum()
            weights[b] = w
            last = b if b else last
        elif last:
            weights[b] = weights[last]
    return weights


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_mod: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Documents whose crc32(id as text) mod ``held_out_mod`` is 0 are scored only; those with 1 are
    the deleted part that the weights are learned on, and count like the rest in the final model.
    A null id counts as the empty text, a null text as empty (one end token). Repeated rows count as
    often as they occur. Other columns are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    left = id_remainder(id_col, held_out_mod)
    role = F.when(left == 0, HELD_OUT).when(left == 1, DELETED).otherwise(FIT)
    chunks = cut_lineage(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), role.alias("role"))
                         .mapInArrow(_chunk_batches, _CHUNKS), "lm-chunks")
    s = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "fit_tokens", "del_tokens", "fit_docs", "del_docs")]).first()
    bits = max(0, int(np.ceil(np.log2(max(1, s["n_tokens"] / KEYS_PER_RANGE)))))
    parts = partitions_for(spark, 2 << bits, 1)
    few = partitions_for(spark, s["n_tokens"], 4 * CHUNK_TOKENS)
    back = cut_lineage(chunks.repartition(partitions_for(spark, s["n_tokens"], 2 * CHUNK_TOKENS), "chunk").mapInArrow(_key_batches(bits), _KEYS)
                       .repartition(parts, "range", "pairs").groupBy("range", "pairs").applyInPandas(_sum_range, _TOTALS), "lm-totals")
    vocabulary = back.agg(F.coalesce(F.sum("vocabulary"), F.lit(0))).first()[0]
    uniform = 1 / (vocabulary + 1)
    returned = back.drop("vocabulary")

    def gather(key, own: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(own.iloc[0], bits)
        bucket, f2, f1 = _events(c, _totals_of(totals, False)[0], _totals_of(totals, True)[0], s["fit_docs"])
        code = (bucket << 40) + (_quantise(f2) + 1 << 20) + _quantise(f1 / max(1, s["fit_tokens"])) + 1
        code, n = np.unique(code, return_counts=True)
        return pd.DataFrame({"bucket": code >> 40, "q2": (code >> 20 & 0xFFFFF) - 1, "q1": (code & 0xFFFFF) - 1, "n": n})

    deleted = chunks.where("deleted")
    held = returned.join(deleted.select("chunk"), "chunk", "left_semi")
    table = deleted.repartition(few, "chunk").groupBy("chunk").cogroup(held.repartition(few, "chunk").groupBy("chunk")) \
        .applyInPandas(gather, "bucket bigint, q2 bigint, q1 bigint, n bigint") \
        .groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(table, uniform)
    train_tokens, train_docs = s["fit_tokens"] + s["del_tokens"], s["fit_docs"] + s["del_docs"]

    def score(key, own: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(own.iloc[0], bits)
        word, pair = sum(_totals_of(totals, False)), sum(_totals_of(totals, True))
        bucket, f2, count = _events(c, word, pair, train_docs)
        w = weights[bucket]
        p = np.log10(w[:, 0] * f2 + w[:, 1] * (count / max(1, train_tokens)) + w[:, 2] * uniform)
        base = np.log10((count + 0.1) / (train_tokens + 0.1 * (vocabulary + 1)))
        return pd.DataFrame({"doc_id": pd.array(c.ids, "Int64"), "held_out": c.role == HELD_OUT, "n_tokens": c.size,
                             "n_known": np.add.reduceat((count > 0).astype(np.int64), c.first), "train_tokens": train_tokens,
                             "base_score": np.add.reduceat(base, c.first), "score": np.add.reduceat(p, c.first)})

    return chunks.repartition(few, "chunk").groupBy("chunk").cogroup(returned.repartition(few, "chunk").groupBy("chunk")).applyInPandas(
        score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
