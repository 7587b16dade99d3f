"""Spelling variants: words of a vocabulary that are one edit apart, by a bit-sliced position index.

The index of a part of the vocabulary is one bitset per (position, letter): which words have this letter
there. A batch of query words is advanced letter by letter over all words of the part at once, 64 words an
operation. Three sets move together: words equal so far; words with one letter replaced so far; and words
with one letter more so far, which are read one position further on. What is left in the last two after
the last letter is exactly one edit away (a deletion is the other word's insertion).

Parts are made so that work grows with the vocabulary. Words one edit apart, the shorter one of n letters,
have the first n // 2 letters or the last n - n // 2 letters in common: these are the keys words are
shuffled by. Keys are packed into parts of a few thousand words, and a key with more words than
WORDS_PER_BLOCK is cut into blocks, each pair of blocks being a part of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorset.llm.common import cut_lineage

_RUN = re.compile("[a-zÀ-ÿ]+")
EVERY = 97
MIN_LETTERS, MIN_COUNT = 5, 3
#: Words of one key beyond which it is cut into blocks; words and letters at which a part is full.
WORDS_PER_BLOCK = 16_384
PART_WORDS, PART_LETTERS = 4096, 1 << 16
#: 64-bit words of a batch of query sets.
_BATCH = 1 << 17
_FLUSH = 200_000


def slipped(run: str, start: int) -> str:
    """The run without one letter where its checksum asks for it; ``start`` is the crc32 of the document's prefix."""
    h = zlib.crc32(run.encode(), start)
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _count_batches(shortest: int):
    """(word, n) partial counts of the words of whole texts."""
    def run(batches):
        counts: Counter = Counter()
        crc = zlib.crc32
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                start = crc(f"{'' if doc_id is None else doc_id}:".encode())
                # Lower-casing bytes touches A-Z only.
                for word, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
                    if not crc(word.encode(), start) % EVERY:
                        word = slipped(word, start)
                    if len(word) >= shortest:
                        counts[word] += n
                if len(counts) > _FLUSH:
                    yield _counted(counts)
                    counts.clear()
        if counts:
            yield _counted(counts)
    return run


def _counted(counts: Counter):
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = MIN_LETTERS, least: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words of at least ``shortest`` letters that occur at least ``least`` times."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count_batches(shortest), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _postings(words: DataFrame) -> DataFrame:
    """(key, part, word, n, asks): every word under the keys of pairs in which it is the shorter and the longer one."""
    size = F.char_length("word")
    places = []
    for less in (0, 1):
        short = size - less
        head = F.floor(short / 2).cast("int")
        first = F.substring(F.col("word"), F.lit(1), head)
        last = F.right(F.col("word"), short - head)
        for side, text in (("<", first), (">", last)):
            places.append(F.struct(F.concat(short.cast("string"), F.lit(side), text).alias("key"), F.lit(less == 0).alias("shorter")))
    rows = words.select("word", "n", F.inline(F.array(*places)))
    sizes = cut_lineage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("shorter").alias("any")).where("m > 1 AND any").select("key", "m"), "spelling-keys")
    crowded = sizes.where(F.col("m") > WORDS_PER_BLOCK).select("key", F.ceil(F.col("m") / WORDS_PER_BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes.select("key"), "key", "left_semi").join(crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    # Block pair (i, j): the shorter words of block i ask all words of block j.
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asks = rows.where("shorter").select("key", F.col("own").alias("i"), F.col("other").alias("j"), "word", "n", F.lit(True).alias("asks"), (F.col("own") == F.col("other")).alias("held"))
    held = rows.where("NOT shorter OR own <> other").select("key", F.col("other").alias("i"), F.col("own").alias("j"), "word", "n", F.lit(False).alias("asks"), F.lit(True).alias("held"))
    return asks.unionByName(held)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all words, word offsets)."""
    flat = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16).astype(np.int64)
    return flat, np.append(0, np.cumsum([len(w) for w in words]))


def one_edit(queries: list[str], held: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(query, held) places of all pairs in which the held word is the query with one letter replaced or inserted."""
    flat, at = _letters(held)
    size = np.diff(at)
    width = (len(held) + 63) // 64
    owner = np.repeat(np.arange(len(held)), size)
    place = np.arange(len(flat)) - at[owner]
    code, row = np.unique(place << 16 | flat, return_inverse=True)
    index = np.zeros((len(code) + 1, width), np.uint64)
    np.bitwise_or.at(index, (row, owner >> 6), np.uint64(1) << (owner & 63).astype(np.uint64))

    def row_of(place_no: int, letters: np.ndarray) -> np.ndarray:
        """Rows of the index; the last one is empty and stands for what occurs nowhere."""
        wanted = letters | place_no << 16
        found = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
        return np.where(code[found] == wanted, found, len(code))

    def of_size(n: int) -> np.ndarray:
        bits = np.zeros(width * 64, np.uint8)
        bits[:len(held)] = size == n
        return np.packbits(bits, bitorder="little").view(np.uint64)

    q_flat, q_at = _letters(queries)
    q_size = np.diff(q_at)
    out_q, out_h = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n in np.unique(q_size).tolist():
        same, longer = of_size(n), of_size(n + 1)
        if not (same.any() or longer.any()):
            continue
        mine = np.flatnonzero(q_size == n)
        for lo in range(0, len(mine), max(1, _BATCH // width)):
            some = mine[lo:lo + max(1, _BATCH // width)]
            letters = q_flat[q_at[some][:, None] + np.arange(n)]
            equal = np.broadcast_to(same | longer, (len(some), width)).copy()
            replaced, inserted = np.zeros_like(equal), equal.copy()
            for i in range(n):
                here = index[row_of(i, letters[:, i])]
                replaced = (replaced & here) | (equal & ~here)
                equal &= here
                inserted &= index[row_of(i + 1, letters[:, i])]
                inserted |= equal
            hit = (replaced & same) | (inserted & longer)
            q, w = np.nonzero(hit)
            k, bit = np.nonzero(hit[q, w][:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1))
            out_q.append(some[q[k]])
            out_h.append(w[k] * 64 + bit)
    return np.concatenate(out_q), np.concatenate(out_h)


def _near_in_part(rows: list[tuple]):
    """Batch (word, mate, mate_n), both ways, of the near pairs of whole block pairs; each pair comes out of one key."""
    ask = [r for r in rows if r[5]]
    held = [r for r in rows if r[6]]
    if not ask or not held:
        return None
    out = []
    for a, b in zip(*[x.tolist() for x in one_edit([r[3] for r in ask], [r[3] for r in held])]):
        key, i, j, word, n = ask[a][:5]
        other = held[b]
        mate = other[3]
        if other[0] != key or other[1] != i or other[2] != j:
            continue
        if len(mate) == len(word) and mate < word:
            continue
        head = len(word) // 2
        if ">" in key and word[:head] == mate[:head]:
            continue
        out += [(word, mate, other[4]), (mate, word, n)]
    if not out:
        return None
    word, mate, n = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(mate, pa.string()), pa.array(n, pa.int64())], ["word", "mate", "mate_n"])


def _near_batches(batches):
    rows, letters, last = [], 0, None
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(7)]):
            if row[:3] != last:
                if len(rows) >= PART_WORDS or letters >= PART_LETTERS:
                    found = _near_in_part(rows)
                    if found is not None:
                        yield found
                    rows, letters = [], 0
                last = row[:3]
            rows.append(row)
            letters += len(row[3])
    found = _near_in_part(rows)
    if found is not None:
        yield found


def near_words(words: DataFrame) -> DataFrame:
    """(word, mate, mate_n): all words of a vocabulary (word unique, n) that are one edit apart, both ways."""
    dealt = _postings(words).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.select("key", "i", "j", "word", "n", "asks", "held").mapInArrow(_near_batches, "word string, mate string, mate_n bigint")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that forms lead to; ``forms`` has word and form, without cycles.

    Each round doubles the steps that are taken, so that rounds grow with the logarithm of the longest chain.
    """
    now = cut_lineage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = cut_lineage(now.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spelling-roots")
        if step.where("moved").isEmpty():
            return now
        now = step.drop("moved")


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary of whole texts.

    Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased, of which one in EVERY loses
    a letter by the checksum of document and run; they have MIN_LETTERS letters and MIN_COUNT occurrences or
    more. A word's form is the most frequent word one edit away, the smallest on ties, if it is at least
    twice as frequent. Null and empty texts have no words; a null id counts as the empty text; repeated rows
    count again; other columns are not looked at; an empty table gives no rows. Long texts and long runs are
    words like any other.
    """
    words = cut_lineage(vocabulary(docs, id_col, text_col), "spelling-words")
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("mate_n")).alias("less"), "mate")).alias("m"))
    rows = cut_lineage(words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("m.less") >= 2 * F.col("n"), -F.col("m.less"))).select(
        "word", F.when(F.col("form_n").isNotNull(), F.col("m.mate")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"), "spelling-forms")
    roots = follow(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
