"""Quality rules with host verdicts.

Every document gets its own rule results. The failures are then summed up per host; a host's
failure rate is shrunk towards the corpus rate by a beta prior fitted to all hosts (method of
moments), so that a host with three pages is not judged like one with three million. A host is
rejected when its shrunken rate is over ``max_rate`` by more than two posterior deviations; all its
documents go. Only sums per host are shuffled; host verdicts come back by a skew-safe join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorset.llm.arrays import SPACE, line_hashes, mix, per_doc, text_blocks, words
from mirrorset.llm.common import cut_lineage, frugal, join_facts

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MAX_HOST_RATE = 0.5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    flag = np.zeros(len(keys), bool)
    flag[1:] |= same
    flag[:-1] |= same
    out = np.empty(len(keys), bool)
    out[order] = flag
    return out


def repeat_words(h: np.ndarray, doc: np.ndarray, n_docs: int, width: int = WINDOW) -> np.ndarray:
    """Words per document that lie in a window of ``width`` words found twice or more in the document."""
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(n_docs, np.int64)
    with np.errstate(over="ignore"):
        key = np.zeros(n, np.uint64)
        for k in range(width):
            key = key * _STEP + h[k:k + n]
        inside = np.flatnonzero(doc[:n] == doc[width - 1:])
        key = mix(key[inside]) ^ mix(doc[inside].astype(np.uint64) + _STEP)
    hit = inside[_repeated(key)]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def text_facts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """FACTS of every document of a block."""
    n_docs = len(offsets) - 1
    h, _, _, doc = words(data, offsets)
    line, has_word, line_doc = line_hashes(data, offsets)
    line, line_doc = line[has_word], line_doc[has_word]
    with np.errstate(over="ignore"):
        own = line ^ mix(line_doc.astype(np.uint64) + _STEP)
    _, first = np.unique(own, return_index=True)
    dup = np.bincount(line_doc, minlength=n_docs) - np.bincount(line_doc[first], minlength=n_docs)
    starts_char = ~SPACE[data] & ((data & 0xC0) != 0x80)
    return [np.bincount(doc, minlength=n_docs), per_doc(starts_char, offsets), per_doc(SYMBOLS[data], offsets),
            dup, repeat_words(h, doc, n_docs)]


def _column_facts(column) -> list[pa.Array]:
    found = [text_facts(data, offsets) for _, _, data, offsets in text_blocks(column)]
    return [pa.array(np.concatenate([x[i] for x in found]).astype(np.int64) if found else np.empty(0, np.int64))
            for i in range(len(FACTS))]


def _fact_batches(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *_column_facts(batch.column("text"))],
                                         ["doc_id", "host", *FACTS])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, FACTS, base_failed) of every row; null texts have no words, null hosts are one host."""
    host = F.when(F.col(host_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(host_col)))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), host.alias("host"), F.col(text_col).alias("text")) \
        .mapInArrow(frugal(_fact_batches), "doc_id bigint, host string, " + ", ".join(f"{c} bigint" for c in FACTS)) \
        .withColumn("base_failed", base_failed())


def host_verdicts(rules: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n, failed, rate, host_failed): shrunken failure rate and verdict of every host.

    The prior Beta(a, b) has the corpus failure rate as its mean; its strength follows from the
    spread of host rates, weighted by rows, beyond what chance gives. Without such spread the
    strength is the whole corpus. Only one row of sums comes to the driver.
    """
    hosts = cut_lineage(rules.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed")), "hosts")
    s = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count(F.lit(1)).alias("hosts"),
                  F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("square")).first()
    total, failed = s["n"] or 0, s["failed"] or 0
    mean = failed / total if total else 0.0
    chance = mean * (1 - mean)
    strength = float(total)
    if total and chance > 0:
        spread = ((s["square"] or 0.0) - total * mean * mean - (s["hosts"] - 1) * chance) / total
        strength = min(strength, max(chance / spread - 1, 1.0)) if spread > 0 else strength
    a, b = mean * strength, (1 - mean) * strength
    rate = (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(a + b) + 1))
    return hosts.withColumn("rate", rate).withColumn("host_failed", F.col("rate") - 2 * deviation > max_rate)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                     max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(doc_id, host, FACTS, base_failed, host_failed, kept) of every row.

    Empty and null texts fail by their word count. Repeated rows count as rows. Null ids stay null.
    An empty table gives an empty result. Other columns are not looked at.
    """
    rules = cut_lineage(document_rules(docs, id_col, text_col, host_col), "rules")
    verdicts = cut_lineage(host_verdicts(rules, max_rate).select("host", "n", "host_failed"), "host-verdicts")
    return join_facts(rules, verdicts, "host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
              max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that pass their own rules and whose host is not rejected, all columns kept.

    Rules are computed again for the filter rather than joined back, so that texts are not shuffled. Null and
    empty texts have no words and fail; rows of a null host are one host; repeated rows stay or go alike;
    an empty table stays empty.
    """
    rules = cut_lineage(document_rules(docs, id_col, text_col, host_col), "rules")
    bad = cut_lineage(host_verdicts(rules, max_rate).where("host_failed").select("host"), "bad-hosts")
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def passing(batches):
        for batch in batches:
            n, _, _, _, repeats = [x.to_numpy() for x in _column_facts(batch.column(names.index(text_col)))]
            ok = (n >= MIN_WORDS) & (100 * repeats <= MAX_REPEAT_PERCENT * n)
            yield batch.filter(pa.array(ok))

    kept = docs.mapInArrow(frugal(passing), fields)
    if bad.isEmpty():
        return kept
    host = F.when(F.col(host_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(host_col)))
    return kept.select(F.struct(*[F.col(c) for c in names]).alias("row"), host.alias("host")).join(bad, "host", "left_anti").select("row.*")
