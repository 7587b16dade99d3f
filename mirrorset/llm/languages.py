"""Language identification by interpolated Kneser-Ney character models.

Letters are folded to lower case and mapped to SYMBOLS classes (a-z have one each, all other letters
share the rest by hash), words are separated by one boundary symbol and a word's context starts
afresh. A trigram is thus a number below 2**21: no model has more entries than that, whatever the
corpus, and counts are sums over all training text. Each language keeps its trigrams and bigrams as
sorted key arrays with log probabilities and back-off weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorset.llm.arrays import mix, text_blocks
from mirrorset.llm.common import cut_lineage, id_remainder

SYMBOL_BITS = 7
SYMBOLS = 1 << SYMBOL_BITS
CODES = SYMBOLS ** 3
PAIRS = SYMBOLS ** 2
HELD_OUT_MOD, HELD_OUT_REST = 4, 2
UNKNOWN = "und"
#: Share of the training documents of a language that its rejection limit lets pass.
ACCEPTED = 0.999
_table: np.ndarray | None = None


def symbol_table() -> np.ndarray:
    """Symbol of every code point; 0 for all that are not letters."""
    global _table
    if _table is None:
        letters = np.array([i for i in range(0x110000) if chr(i).isalpha()])
        folded = np.array([ord(chr(i).lower()[0]) for i in letters.tolist()])
        shared = 27 + (mix(folded.astype(np.uint64)) % np.uint64(SYMBOLS - 27)).astype(np.int64)
        _table = np.zeros(0x110000, np.uint8)
        _table[letters] = np.where((folded >= 97) & (folded <= 122), folded - 96, shared)
    return _table


def trigram_codes(data: np.ndarray, offsets: np.ndarray):
    """(code, document) of every letter and every word end."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    sizes = np.diff(heads[offsets])
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)
    symbol = np.zeros(len(doc), np.int64)
    symbol[np.arange(len(points)) + np.repeat(np.arange(len(sizes)), sizes)] = symbol_table()[points]
    keep = symbol > 0
    keep[1:] |= symbol[:-1] > 0
    symbol, doc = symbol[keep], doc[keep]
    one, two = np.zeros_like(symbol), np.zeros_like(symbol)
    one[1:], two[2:] = symbol[:-1], symbol[:-2]
    two[one == 0] = 0
    return (two << 2 * SYMBOL_BITS) | (one << SYMBOL_BITS) | symbol, doc


def _count_batches(batches):
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        number = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        own = np.array([number[x] for x in langs])
        for first, last, data, offsets in text_blocks(batch.column("text")):
            code, doc = trigram_codes(data, offsets)
            lang = own[first:last][doc] if len(doc) else doc
            for name, i in number.items():
                picked = code[lang == i]
                if len(picked):
                    totals[name] = totals.get(name, np.zeros(CODES, np.int64)) + np.bincount(picked, minlength=CODES)
    for name, total in totals.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(used)), "code": pa.array(used.astype(np.int32)), "n": pa.array(total[used])})


class CharModel:
    """Sorted trigram and bigram keys of one language, with log probabilities."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        order = np.argsort(code)
        code, n = code[order].astype(np.int64), n[order].astype(float)
        pair, last = code >> SYMBOL_BITS, code & (PAIRS - 1)
        seen = np.bincount(last, minlength=PAIRS)
        middle = np.bincount(np.arange(PAIRS) & (SYMBOLS - 1), (seen > 0), SYMBOLS)
        top = (middle + 0.5) / (middle.sum() + 0.5 * SYMBOLS)
        d2, d3 = self._discount(seen[seen > 0]), self._discount(n)
        by_one = seen.reshape(SYMBOLS, SYMBOLS)
        ends = np.maximum(by_one.sum(axis=1), 1e-9)
        kinds = (by_one > 0).sum(axis=1)
        left = np.where(kinds > 0, d2 * kinds / ends, 1.0)
        lower = (np.maximum(by_one - d2, 0) / ends[:, None] + left[:, None] * top[None, :]).ravel()
        context, kind = np.bincount(pair, n, PAIRS), np.bincount(pair, minlength=PAIRS)
        open_ = np.where(kind > 0, d3 * kind / np.maximum(context, 1e-9), 1.0)
        self.keys, self.log = code.astype(np.int32), np.log(np.maximum(n - d3, 0) / context[pair] + open_[pair] * lower[last]).astype(np.float32)
        self.pair_keys = np.flatnonzero(seen).astype(np.int32)
        self.pair_log = np.log(lower[self.pair_keys]).astype(np.float32)
        self.single_log, self.single_left = np.log(top).astype(np.float32), np.log(left).astype(np.float32)
        self.open_keys = np.flatnonzero(kind).astype(np.int32)
        self.open_log = np.log(open_[self.open_keys]).astype(np.float32)

    @staticmethod
    def _discount(n: np.ndarray) -> float:
        one, two = float((n == 1).sum()), float((n == 2).sum())
        return min(max(one / (one + 2 * two), 0.1), 0.9) if one + two else 0.5

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], other)

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        last = code & (PAIRS - 1)
        low = self._find(self.pair_keys, self.pair_log, last, self.single_left[last >> SYMBOL_BITS] + self.single_log[last & (SYMBOLS - 1)])
        zero = np.zeros(len(code), np.float32)
        return self._find(self.keys, self.log, code, self._find(self.open_keys, self.open_log, code >> SYMBOL_BITS, zero) + low)


def train_models(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, CharModel]:
    """One model per language value, in order of the values; rows without text or language are not used."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_count_batches, "lang string, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    return {lang: CharModel(t["code"].to_numpy(), t["n"].to_numpy()) for lang, t in counts.groupby("lang", sort=True)}


def entropies(models: list[CharModel], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy per symbol for each document and model, symbols per document)."""
    n = len(offsets) - 1
    code, doc = trigram_codes(data, offsets)
    size = np.bincount(doc, minlength=n)
    out = np.zeros((n, len(models)))
    if len(code):
        met = np.flatnonzero(np.bincount(code, minlength=CODES))
        number = np.zeros(CODES, np.int32)
        number[met] = np.arange(len(met), dtype=np.int32)
        at = number[code]
        for j, model in enumerate(models):
            out[:, j] = -np.bincount(doc, model.log_probability(met)[at], n) / np.maximum(size, 1)
    return out, size


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, entropy, accepted) of every row.

    Held-out rows (crc32 of the id as text, modulo 4, is 2; a null id counts as the empty text) and rows
    with a null language are not learned from. lang_pred has the lowest cross-entropy per symbol, ties
    by name; it is ``und`` with score 0 for null texts, texts without a letter, and without any
    training text. score is the calibrated probability: a softmax over -sharpness x entropy, the
    sharpness being the best of a fixed grid over all training rows. accepted is false where the entropy
    is over the limit that ACCEPTED of the training rows of that language stay under. Repeated rows stay rows
    and count again in training; other columns are not looked at; an empty table gives an empty result. Long
    texts are read whole.
    """
    spark = docs.sparkSession
    held_out = id_remainder(id_col, HELD_OUT_MOD) == HELD_OUT_REST
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = train_models(rows.where("NOT held_out"), "text", "lang")
    names = list(found)
    shared = spark.sparkContext.broadcast(list(found.values()))

    def run(batches):
        for batch in batches:
            parts = [entropies(shared.value, data, offsets) for _, _, data, offsets in text_blocks(batch.column("text"))]
            e = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, len(names)))
            size = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("lang"), pa.array(size),
                                              pa.array(list(e), pa.list_(pa.float64()))], ["doc_id", "held_out", "lang", "size", "e"])

    if not names:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"), F.lit(False).alias("accepted"))
    scored = cut_lineage(rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang string, size bigint, e array<double>"), "languages")
    listed = F.array(*[F.lit(x) for x in names])
    best = F.array_min("e")
    ranked = scored.withColumn("best", best).withColumn("at", F.array_position("e", F.col("best")).cast("int"))
    training = ranked.where("NOT held_out AND lang IS NOT NULL AND size > 0")
    own = F.try_element_at("e", F.array_position(listed, F.col("lang")).cast("int"))
    grid = [float(x) for x in np.geomspace(1, 512, 19)]

    def spread(k: float):
        return F.aggregate("e", F.lit(0.0), lambda s, x: s + F.exp(-F.lit(k) * (x - F.col("best"))))

    loss = training.agg(*[F.avg(F.log(spread(k)) + F.lit(k) * (own - F.col("best"))).alias(f"k{i}") for i, k in enumerate(grid)]).first()
    sharp = grid[min(range(len(grid)), key=lambda i: (loss[i] if loss[i] is not None else 0.0, i))]
    limits = {r["at"]: r["limit"] for r in training.where(F.element_at(listed, F.col("at")) == F.col("lang")).groupBy("at").agg(
        F.percentile_approx("best", ACCEPTED, 10000).alias("limit")).collect()}
    limit = F.element_at(F.array(*[F.lit(limits.get(i + 1, float("inf"))) for i in range(len(names))]), F.col("at"))
    has = F.col("size") > 0
    return ranked.select("doc_id", "held_out", F.when(has, F.element_at(listed, F.col("at"))).otherwise(UNKNOWN).alias("lang_pred"),
                         F.when(has, 1 / spread(sharp)).otherwise(0.0).alias("score"), F.col("best").alias("entropy"),
                         (has & (F.col("best") <= limit)).alias("accepted"))
