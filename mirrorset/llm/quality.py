"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

Terms are hashed words and word shapes (case, digits, symbols, length, equal to the word before). Every
term has a fixed sparse random index vector; a term's vector is the sum of the index vectors around
all its occurrences in the corpus, so it is learned from all text by counting alone. There are TERMS
hash slots, a size that does not depend on the corpus, which bounds what is broadcast. A document is
the mean of its terms' unit vectors. The network is trained on a bounded sample of labelled rows on
the driver; its logits are divided by a temperature fitted on rows it has not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorset.llm.arrays import mix, text_blocks, words
from mirrorset.llm.common import cut_lineage, hash_sample, id_remainder

WORD_SLOTS, SHAPE_SLOTS, DIM, SPARSE, REACH = 1 << 14, 1 << 11, 32, 2, 2
TERMS = WORD_SLOTS + SHAPE_SLOTS
FEATURES = 2 * DIM + 2
#: The network is fitted on at most so many labelled rows, by hash of the id.
SAMPLE_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 0.01, 1e-4
THRESHOLD = 0.7
HELD_OUT_MOD, HELD_OUT_REST = 4, 2

_CLASS = np.zeros((4, 256), np.int32)
_CLASS[0, 65:91] = 1
_CLASS[1, 48:58] = 1
_CLASS[2, [ord(c) for c in "#*$%&|<>{}[]\\/=_~^@+"]] = 1
_CLASS[3, [ord(c) for c in "!?.,;:"]] = 1


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(positions, signs) of the non-zero entries of every term's index vector."""
    bits = mix(np.arange(TERMS * SPARSE, dtype=np.uint64) + np.uint64(77)).reshape(TERMS, SPARSE)
    return (bits % np.uint64(DIM)).astype(np.int64), np.where(bits >> np.uint64(63), 1.0, -1.0)


def terms(data: np.ndarray, offsets: np.ndarray):
    """(word slot, shape slot, document) of every word."""
    h, start, end, doc = words(data, offsets, fold=True)
    if not len(h):
        return h.astype(np.int64), h.astype(np.int64), doc
    size = end - start
    many = np.minimum(np.floor(np.log2(size)).astype(np.int64), 7)
    total = [np.zeros(len(data) + 1, np.int64) for _ in range(4)]
    for t, c in zip(total, _CLASS):
        np.cumsum(c[data], out=t[1:])
    upper, digit, symbol, mark = (t[end] - t[start] for t in total)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    shape = many
    for flag in (_CLASS[0, data[start]], upper > 1, digit > 0, symbol > 0, symbol == size, mark > 1, same, data[start] > 127):
        shape = shape * 2 + flag
    return (h >> np.uint64(50)).astype(np.int64), WORD_SLOTS + shape, doc


def _context_batches(batches):
    """Sums of index vectors around every term; one row per term that this task has met."""
    where, sign = _index_vectors()
    table = np.zeros(TERMS * DIM)
    for batch in batches:
        for _, _, data, offsets in text_blocks(batch.column("text")):
            word, shape, doc = terms(data, offsets)
            for step in range(1, REACH + 1):
                near = np.flatnonzero(doc[step:] == doc[:-step])
                for mine, theirs in ((near, near + step), (near + step, near)):
                    for own in (word, shape):
                        for other in (word, shape):
                            for k in range(SPARSE):
                                table += np.bincount(own[mine] * DIM + where[other[theirs], k], sign[other[theirs], k], TERMS * DIM)
    table = table.reshape(TERMS, DIM).astype(np.int64)
    used = np.flatnonzero(table.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(table[used, i]) for i in range(DIM)]],
                                     ["term", *[f"v{i}" for i in range(DIM)]])


def term_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors of all slots (TERMS x DIM), from all texts; the sums are made by Spark."""
    names = [f"v{i}" for i in range(DIM)]
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(
        _context_batches, "term bigint, " + ", ".join(f"{n} bigint" for n in names)) \
        .groupBy("term").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((TERMS, DIM), np.float32)
    out[rows["term"].to_numpy()] = rows[names].to_numpy(np.float32)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(size, 1e-9)


def pool(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of every document: mean vectors of words and shapes, and the lengths of those means."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.float32)
    word, shape, doc = terms(data, offsets)
    if len(word):
        filled, first, count = np.unique(doc, return_index=True, return_counts=True)
        for i, term in enumerate((word, shape)):
            mean = np.add.reduceat(vectors[term], first, axis=0) / count[:, None]
            out[filled, i * DIM:(i + 1) * DIM] = mean
            out[filled, 2 * DIM + i] = np.linalg.norm(mean, axis=1)
    return out


def document_features(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, features binary) of every row; features are zero without words."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in batches:
            rows = [x for _, _, data, offsets in text_blocks(batch.column("text"), 1 << 20) for x in pool(shared.value, data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x.tobytes() for x in rows], pa.binary())],
                                             ["doc_id", "held_out", "features"])

    held_out = id_remainder(id_col, HELD_OUT_MOD) == HELD_OUT_REST
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text")) \
        .mapInArrow(run, "doc_id bigint, held_out boolean, features binary")


class Network:
    """Two-layer network with standardised inputs and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        check, learn = order[:len(x) // 5], order[len(x) // 5:]
        self.mean, self.scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-6
        self.weights = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        self._fit(x[learn], y[learn].astype(float), rng)
        self._calibrate(self.logit(x[check]), y[check])

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))

    def _fit(self, x: np.ndarray, y: np.ndarray, rng) -> None:
        z = (x - self.mean) / self.scale
        first, second, t = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for i in range(0, len(z), BATCH):
                rows, t = order[i:i + BATCH], t + 1
                a, b, c, d = self.weights
                hidden = np.tanh(z[rows] @ a + b)
                miss = (1 / (1 + np.exp(-(hidden @ c + d[0]))) - y[rows]) / len(rows)
                back = miss[:, None] * c * (1 - hidden ** 2)
                slopes = [z[rows].T @ back + DECAY * a, back.sum(axis=0), hidden.T @ miss + DECAY * c, np.array([miss.sum()])]
                for k, g in enumerate(slopes):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] = self.weights[k] - RATE * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)

    def _calibrate(self, logit: np.ndarray, y: np.ndarray) -> None:
        if len(y):
            ones = int(y.sum())
            want = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))  # a finite sample is never certain
            grid = np.geomspace(0.25, 32, 99)
            loss = [(np.logaddexp(0, logit / t) - want * logit / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])


def train(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality"):
    """A function from features to probabilities, learned on rows that are not held out.

    Without labels of both kinds every score is the rate of label 1 (0.5 without any label).
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).alias("y"))
    rows = features.where(~F.col("held_out")).join(known, "doc_id")
    picked = hash_sample(F.xxhash64("doc_id", "features"), rows.count(), SAMPLE_ROWS)
    sample = sorted(rows.where(picked).select("doc_id", "features", "y").limit(SAMPLE_ROWS).collect())
    y = np.array([r["y"] for r in sample])
    if len(set(y.tolist())) < 2:
        rate = float(y[0]) if len(y) else 0.5
        return lambda x: np.full(len(x), rate)
    x = np.stack([np.frombuffer(r["features"], np.float32) for r in sample]).astype(float)
    return Network(x, y).probability


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; labels of held-out ids are never looked at.

    Held out: crc32 of the id as text, modulo 4, is 2 (a null id counts as the empty text). Null and
    empty texts have zero features and are scored like any other. Labels other than 0 and 1 and those of
    unknown ids are ignored; several labels of one id each count. Only the text decides a score, so equal
    texts tie. Repeated rows stay rows and are scored alike; other columns are not looked at, whatever their
    names; an empty table gives an empty result.
    """
    features = cut_lineage(document_features(docs, term_vectors(docs, text_col), id_col, text_col), "quality-features")
    probability = train(features, labels, id_col, label_col)

    def run(batches):
        for batch in batches:
            x = np.stack([np.frombuffer(v, np.float32) for v in batch.column("features").to_pylist()]).astype(float) \
                if batch.num_rows else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(probability(x), pa.float64())],
                                             ["doc_id", "held_out", "score"])

    return features.mapInArrow(run, "doc_id bigint, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
