"""Token-id shards with a shared zstandard dictionary.

A store has two Parquet tables, so that Spark's own commit protocol protects them on any file
system: ``dictionary`` (one row: the dictionary and its hash) and ``shards`` (one self-contained
binary shard a row, about SHARD_BYTES). Documents lie in ascending doc_id order over the shards.

Shard layout, little-endian:

    4 bytes magic, 2 version, 1 bytes per id, 1 zero, 8 hash of the dictionary,
    8 number of documents n, n x 8 doc_id, n x 1 id is null, (n + 1) x 8 frame offsets, frames

Each frame is one document's id array, compressed on its own against the dictionary, so that one
short document is read by one seek and one small decompression.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorset.llm.common import hash_sample, partitions_for, range_bounds
from mirrorset.operators.grouping import running_sum

MAGIC, VERSION = b"MTOK", 1
_HEAD = struct.Struct("<4sHBBQQ")
SHARD_BYTES = 4 << 20
ROWS_PER_PART = 8192
#: The dictionary is trained on at most so many documents, picked by hash, and one slice of so many
#: characters of each, which starts anywhere by another hash.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 2000, 20_000, 64 << 10
#: Encoded words that a worker keeps for reuse; more only costs time, never results.
_CACHE_WORDS = 700_000
_RUN_WORDS, _RUNS = 64, 256
_UNEVEN = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?= \S)")


class WordEncoder:
    """Byte-level BPE ids of whole texts, encoding each distinct word once.

    The pre-tokenizer never joins a word with the single space before it to what stands earlier, so a
    text may be cut before any single space between two non-spaces without a change to its ids. New
    words are encoded in runs, which the lengths of the pieces cut again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = id_type(size)
        letters = set(pre_tokenizers.ByteLevel.alphabet())
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.width = np.array([len(n) if set(n) <= letters else len(n.encode()) for n in names], np.int64)
        self.tails = {c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, self.dtype).tobytes() for c in ".,"}
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        """Ids of words behind a space. A stop or comma right after a letter is always a piece of its own."""
        tailed = [w for w in words if w[-1:] in self.tails and w[-2:-1].isalpha()]
        new = list((words.difference(tailed) | {w[:-1] for w in tailed}).difference(self.known))
        runs = [new[a:a + _RUN_WORDS] for a in range(0, len(new), _RUN_WORDS)]
        for a in range(0, len(runs), _RUNS):
            found = self.tokenizer.encode_batch_fast([" " + " ".join(r) for r in runs[a:a + _RUNS]], add_special_tokens=False)
            part = [w for r in runs[a:a + _RUNS] for w in r]
            ids = np.array([i for e in found for i in e.ids], np.int64)
            ends = np.cumsum(self.width[ids])
            want = np.cumsum([len(w.encode()) + 1 for w in part])
            cut = np.searchsorted(ends, want) + 1
            if not np.array_equal(ends[cut - 1], want):
                raise ValueError("a piece crosses two words")
            raw, k = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            at = [0, *(cut * k).tolist()]
            self.known.update(zip(part, [raw[i:j] for i, j in zip(at, at[1:])]))
        self.known.update([(w, self.known[w[:-1]] + self.tails[w[-1]]) for w in tailed])

    def encode(self, texts: list[str]) -> list[bytes]:
        first, rows = [], []
        for text in texts:
            if text and (text[0].isspace() or text[-1].isspace() or _UNEVEN.search(text)):
                head, *rest = _CUT.split(text)
                first.append(head)
                rows.append([u[1:] for u in rest])
            else:
                head, _, rest = text.partition(" ")
                first.append(head)
                rows.append(rest.split(" ") if rest else [])
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        self._learn(set(chain.from_iterable(rows)).difference(self.known))
        heads = self.tokenizer.encode_batch_fast(first, add_special_tokens=False)
        get = self.known.__getitem__
        return [np.array(h.ids, self.dtype).tobytes() + b"".join(map(get, row)) for h, row in zip(heads, rows)]


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def dictionary_hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def _codec(data: bytes):
    d = zstandard.ZstdCompressionDict(data) if data else None
    return (zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False), zstandard.ZstdDecompressor(dict_data=d))


def train_dictionary(docs: DataFrame, n_docs: int, tokenizer_path: str, id_col: str, text_col: str) -> bytes:
    """Dictionary bytes; plain content of the sample where it is too small to train on, empty without text."""
    picked = hash_sample(F.xxhash64(id_col, text_col), n_docs, SAMPLE_DOCS)
    starts = F.greatest(F.length(text_col) - SAMPLE_CHARS + 1, F.lit(1))
    first = F.pmod(F.xxhash64(F.lit("slice"), id_col, text_col), starts).cast("int") + 1
    sample = docs.where((F.length(text_col) > 0) & picked).select(F.substring(F.col(text_col), first, F.lit(SAMPLE_CHARS)).alias("t")).limit(SAMPLE_DOCS).collect()
    arrays = encoder(tokenizer_path).encode(sorted(r["t"] for r in sample)) if sample else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[:DICTIONARY_BYTES]


def pack_shard(doc_ids: list, frames: list[bytes], id_bytes: int, dict_hash: int) -> bytes:
    ids = np.array([i or 0 for i in doc_ids], "<i8")
    null = np.array([i is None for i in doc_ids], np.uint8)
    offsets = np.zeros(len(frames) + 1, "<u8")
    np.cumsum([len(f) for f in frames], out=offsets[1:])
    head = _HEAD.pack(MAGIC, VERSION, id_bytes, 0, dict_hash, len(frames))
    return b"".join([head, ids.tobytes(), null.tobytes(), offsets.tobytes(), *frames])


class Shard:
    """Random access to the documents of one shard."""

    def __init__(self, blob: bytes, dictionary: bytes):
        magic, version, self.id_bytes, _, used, n = _HEAD.unpack_from(blob)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard")
        if used != dictionary_hash(dictionary):
            raise ValueError("the shard was written with another dictionary")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(blob, "<i8", n, at)
        self.null = np.frombuffer(blob, np.uint8, n, at + 8 * n).astype(bool)
        self.offsets = np.frombuffer(blob, "<u8", n + 1, at + 9 * n).astype(np.int64)
        self._base, self._blob, self._open = at + 9 * n + 8 * (n + 1), blob, _codec(dictionary)[1]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        a, b = self._base + self.offsets[i], self._base + self.offsets[i + 1]
        return np.frombuffer(self._open.decompress(self._blob[a:b]), "<u2" if self.id_bytes == 2 else "<u4")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int | None = 0) -> None:
    """Encode every text (null: empty), append ``end_id`` and write the store to ``path``.

    Ties of doc_id are ordered by token count and content hash; null ids come first. Texts of any length are one
    document each. An empty table writes a store without shards. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    n_docs, width = rows.count(), encoder(tokenizer_path).dtype.itemsize
    dictionary = train_dictionary(rows, n_docs, tokenizer_path, "doc_id", "text")
    digest = dictionary_hash(dictionary)
    spark.createDataFrame([(f"{digest:016x}", bytearray(dictionary), tokenizer_path)], "hash string, dictionary binary, tokenizer string") \
        .write.parquet(f"{path}/dictionary")
    parts = partitions_for(spark, n_docs, ROWS_PER_PART)
    bounds = np.array(range_bounds(rows, "doc_id", parts), np.int64)

    def encode(batches):
        enc = encoder(tokenizer_path)
        shrink = _codec(dictionary)[0]
        tail = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            ids = batch.column("doc_id")
            shard = np.searchsorted(bounds, ids.fill_null(-(1 << 63)).to_numpy(), "right").astype(np.int32)
            for a in range(0, len(ids), 256):
                arrays = [x + tail for x in enc.encode([t or "" for t in batch.column("text")[a:a + 256].to_pylist()])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[a:a + 256]), ids[a:a + 256], pa.array([len(x) // enc.dtype.itemsize for x in arrays], pa.int64()),
                     pa.array([xxhash.xxh3_64_intdigest(x) >> 1 for x in arrays], pa.int64()),
                     pa.array([shrink.compress(x) for x in arrays], pa.binary())], ["shard", "doc_id", "n", "h", "frame"])

    def assemble(batches):
        shard, part, ids, frames, total, held = None, 0, [], [], 0, 0

        def flush():
            blob = pack_shard(ids, frames, width, digest)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()),
                                               "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([total], pa.int64()),
                                               "blob": pa.array([blob], pa.binary())})

        for batch in batches:
            for s, i, n, frame in zip(*[batch.column(c).to_pylist() for c in ("shard", "doc_id", "n", "frame")]):
                if frames and (s != shard or held >= SHARD_BYTES):
                    yield flush()
                    part = part + 1 if s == shard else 0
                    ids, frames, total, held = [], [], 0, 0
                if s != shard:
                    shard, part = s, 0
                ids.append(i)
                frames.append(frame)
                total += n
                held += len(frame)
        if frames:
            yield flush()

    rows.mapInArrow(encode, "shard int, doc_id bigint, n bigint, h bigint, frame binary") \
        .repartition(parts, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "n", "h") \
        .drop("h").mapInArrow(assemble, "shard int, part int, n_docs bigint, n_ids bigint, blob binary") \
        .write.parquet(f"{path}/shards")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(shard, part, position, doc_id, start, n_tokens, ids_crc32) of every document in a store.

    start counts the ids of all documents before it. Everything is taken from the decompressed frames.
    """
    stored = spark.read.parquet(f"{path}/shards")
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])

    def unpack(batches):
        for batch in batches:
            for s, p, blob in zip(*[batch.column(c).to_pylist() for c in ("shard", "part", "blob")]):
                shard = Shard(blob, dictionary)
                size, crc = np.empty(len(shard), np.int64), np.empty(len(shard), np.int64)
                for i in range(len(shard)):
                    ids = shard.ids(i)
                    size[i], crc[i] = len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(np.full(len(shard), s, np.int32)), "part": pa.array(np.full(len(shard), p, np.int32)),
                    "position": pa.array(np.arange(len(shard))), "doc_id": pa.array(shard.doc_ids, mask=shard.null),
                    "local": pa.array(np.cumsum(size) - size), "n_tokens": pa.array(size), "ids_crc32": pa.array(crc)})

    docs = stored.select("shard", "part", "blob").mapInArrow(
        unpack, "shard int, part int, position bigint, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    totals = stored.select(F.lit(0).alias("one"), "shard", "part", "n_ids")
    before = running_sum(totals, ["one"], [F.col("shard"), F.col("part")], F.col("n_ids"), "upto") \
        .select("shard", "part", (F.col("upto") - F.col("n_ids")).alias("before"))
    return docs.join(before, ["shard", "part"]).select(
        "shard", "part", "position", "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def stored_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """Ids of a few documents by random access to their shards."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    wanted = set(doc_ids)

    def pick(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                shard = Shard(blob, dictionary)
                hits = [i for i in np.flatnonzero(np.isin(shard.doc_ids, list(wanted)) & ~shard.null)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids[hits]), "ids": pa.array(
                    [shard.ids(i).astype(np.int64) for i in hits], pa.list_(pa.int64()))})

    rows = spark.read.parquet(f"{path}/shards").select("blob").mapInArrow(pick, "doc_id bigint, ids array<bigint>").collect()
    return {r["doc_id"]: list(r["ids"]) for r in rows}
