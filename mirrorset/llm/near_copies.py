"""SimHash near-duplicate groups by a byte-position inverted index with count filtering.

Two fingerprints of eight bytes that differ in at most two bits share at least six of their eight
positional bytes. The count filter keeps exactly the pairs that share so many. Tallying single
bytes would list every pair of a posting (1/256 of all rows), which grows with the square of the
input; so a posting here is a choice of six positions with their bytes: a pair has the guaranteed
count if and only if it meets in one of the 28 postings of this kind. Fingerprints of one posting
differ in two bytes only, so a posting never has more than 65,536 of them, whatever the input, and
its links are settled exactly in one step over the 16 open bits. Each fingerprint is tied to the
smallest one it reaches inside the posting, so the output is linear even for thousands of near
copies, while the components are those of all links.

Copies by similarity of shingle sets differ in too many bits for that index (Jaccard 0.8 is about 3 to 11 of
64 bits). ``similar_groups`` keeps the two steps, an inverted index with a count filter and an exact check, on
the shingles themselves: sets of n and m shingles with an index of s have at least s / (1 + s) * (n + m) in
common, so each of two such sets has one of them among its first n - ceil(s * n) + 1 in any order that both
use. The order is from rare to frequent: what many documents share comes last and is hardly ever posted.
Places in the order and sizes bound the count from above, and pairs whose bound falls short are never listed.
Nothing is lost, so recall is one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirrorset.llm.arrays import FOLD, SPACE, mix, text_blocks, word_spans, words
from mirrorset.llm.common import arrow_rows, cut_lineage, frugal, join_facts
from mirrorset.operators.graph import add_edges, components
from mirrorset.runtime import forget

SEED = 42
MAX_BITS = 2
OPEN = list(combinations(range(8), 2))
#: A shingle in a set is a number of so many bytes.
SET_BYTES = 6
#: Frequencies of shingles are counted in 2 ** SKETCH_BITS cells, sent in SKETCH_RANGES pieces. They order postings only.
SKETCH_BITS, SKETCH_RANGES = 20, 64
#: A pivot of more pairs than this is copied, so that its pairs are checked by several tasks.
PAIRS_PER_PIVOT = 2000
#: Sets handed to a Python worker at a time; they are as long as their texts.
ROWS_OF_SETS = 512
#: Bits of the filter that holds back sets without a pair.
FILTER_BITS = 1 << 23
#: A signature has 2 ** MIN_POWER bits or more.
MIN_POWER = 6
_BALL = np.array([0, *(1 << i for i in range(16)), *((1 << i) | (1 << j) for i, j in combinations(range(16), 2))])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = 3):
    """(XXH64, document) of every word shingle, repeats included; words lower-cased and joined by one space."""
    starts, ends, doc = word_spans(data, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keep = ~SPACE[data]
    after = ends[ends < len(data)]
    keep[after] = True
    flat = FOLD[data]
    flat[SPACE[flat]] = 32
    moved = np.cumsum(keep) - 1
    flat = flat[keep].tobytes()
    left, right = moved[starts], moved[ends - 1] + 1
    count = np.bincount(doc, minlength=len(offsets) - 1)
    end_of_doc = np.cumsum(count)[doc]
    at = np.arange(len(doc))
    first_of_doc = end_of_doc - count[doc]
    head = (at + size <= end_of_doc) | (at == first_of_doc)
    last = np.minimum(at + size, end_of_doc) - 1
    lo, hi = left[head].tolist(), right[last[head]].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], SEED) for a, b in zip(lo, hi)), np.uint64, len(lo)), doc[head]


def majority(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """64-bit fingerprint of every document: bits set in over half of its hashes."""
    out = np.zeros(n_docs, np.uint64)
    if len(hashes):
        filled, first = np.unique(doc, return_index=True)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        size = np.diff(np.append(first, len(hashes)))
        won = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little")
        out[filled] = np.ascontiguousarray(won).view(np.uint64)[:, 0]
    return out


def _fingerprint_batches(batches):
    for batch in batches:
        found = [majority(*shingle_hashes(data, offsets), len(offsets) - 1)
                 for _, _, data, offsets in text_blocks(batch.column("text"))]
        fp = np.concatenate(found) if found else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of every row. Null texts count as empty; a text without words has fp 0."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(_fingerprint_batches, "doc_id bigint, fp bigint")


def _near(values: np.ndarray) -> np.ndarray:
    """For distinct fingerprints of one posting: index of the smallest one each reaches by links."""
    if len(values) <= 128:
        apart = np.bitwise_count(values[:, None] ^ values[None, :]) > MAX_BITS
        label = np.arange(len(values))
        while True:
            new = np.where(apart, len(values), label[None, :]).min(axis=1)
            if (new == label).all():
                return label
            label = new
    differ = values ^ values[0]
    spread = int(np.bitwise_or.reduce(differ))
    where = [p for p in range(8) if spread >> (8 * p) & 255]
    x = np.zeros(len(values), np.int64)
    for k, p in enumerate(where):
        x |= ((differ >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64) << (8 * k)
    slot = np.full(1 << 16, -1, np.int64)
    slot[x] = np.arange(len(values))
    label = np.arange(len(values))
    others = [(t, s[t]) for m in _BALL[1:] for s in [slot[x ^ m]] for t in [np.flatnonzero(s >= 0)] if len(t)]
    while True:
        new = label.copy()
        for mine, theirs in others:
            new[mine] = np.minimum(new[mine], label[theirs])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(slot: np.ndarray, key: np.ndarray, fp: np.ndarray):
    """(src, dst) links of whole postings, rows sorted by posting and fingerprint."""
    change = np.flatnonzero((slot[1:] != slot[:-1]) | (key[1:] != key[:-1])) + 1
    first = np.append(0, change)
    size = np.diff(np.append(first, len(fp)))
    two = first[size == 2]
    a, b = fp[two], fp[two + 1]
    ok = np.bitwise_count(a ^ b) <= MAX_BITS
    src, dst = [a[ok]], [b[ok]]
    for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        values = fp[at:at + n]
        root = _near(values)
        moved = root != np.arange(n)
        src.append(values[root[moved]])
        dst.append(values[moved])
    return np.concatenate(src), np.concatenate(dst)


def _link_batches(batches):
    rest = None
    for batch in batches:
        now = [batch.column(i).to_numpy() for i in range(3)]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        if not len(now[0]):
            continue
        cut = int(np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1])).max(initial=-1)) + 1
        rest = [x[cut:] for x in now]
        if cut:
            yield _pairs(*[x[:cut] for x in now])
    if rest is not None and len(rest[0]):
        yield _pairs(*rest)


def _pairs(slot, key, fp):
    src, dst = _linked(slot, key, fp.view(np.uint64))
    return pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], ["src", "dst"])


def links(distinct: DataFrame) -> DataFrame:
    """(src, dst): links whose components are those of all pairs within two bits; ``distinct`` has unique ``fp``."""
    postings = [F.struct(F.lit(i).alias("slot"),
                         F.col("fp").bitwiseAND(F.lit(_signed(~(255 << 8 * p | 255 << 8 * q) & (1 << 64) - 1))).alias("key"))
                for i, (p, q) in enumerate(OPEN)]
    rows = distinct.select("fp", F.explode(F.array(*postings)).alias("p")).select("p.slot", "p.key", "fp")
    return rows.repartition("slot", "key").sortWithinPartitions("slot", "key", "fp") \
        .mapInArrow(_link_batches, "src bigint, dst bigint").distinct()


def word_shingles(data: np.ndarray, offsets: np.ndarray, size: int):
    """(48-bit number, document) of every word shingle, repeats included; a shorter text is one shingle."""
    word, _, _, doc = words(data, offsets, fold=True)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    end = np.cumsum(count)[doc]
    at = np.arange(len(doc))
    out = np.zeros(len(doc), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = mix(out + np.where(at + j < end, word[np.minimum(at + j, len(word) - 1)], np.uint64(0)) + np.uint64(1))
    head = (at + size <= end) | (at == end - count[doc])
    return out[head] >> np.uint64(64 - 8 * SET_BYTES), doc[head]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """(numbers, first) of the distinct shingles of every document, ascending; document i has numbers[first[i]:first[i + 1]]."""
    hashes, doc = word_shingles(data, offsets, size)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.append(0, np.cumsum(np.bincount(doc[new], minlength=len(offsets) - 1)))


def set_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit key of every shingle set; the empty set has key 0."""
    out, size = np.zeros(len(first) - 1, np.uint64), np.diff(first)
    if len(hashes):
        with np.errstate(over="ignore"):
            out[size > 0] = mix(np.add.reduceat(mix(hashes), first[:-1][size > 0]) + size[size > 0].astype(np.uint64))
    return out


def pack(numbers: np.ndarray) -> np.ndarray:
    """SET_BYTES bytes of every number."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]).ravel()


def unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // SET_BYTES, 8), np.uint8)
    wide[:, :SET_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SET_BYTES)
    return wide.view("<u8")[:, 0]


def _cell(numbers: np.ndarray) -> np.ndarray:
    return (mix(numbers) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def signatures(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Size of every set and, in a power of two of bits (half its size or more), how many of its shingles fall on each bit, modulo two."""
    size = np.diff(first)
    power = np.maximum(np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64) - 1, MIN_POWER)
    width = 1 << power
    start = np.cumsum(width) - width
    bit = (mix(hashes) >> np.repeat(64 - power, size).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(np.repeat(start, size) + bit, minlength=int(width.sum())) & 1
    flat = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [n.tobytes() + flat[a // 8:(a + w) // 8] for n, a, w in zip(size.astype("<i8"), start.tolist(), width.tolist())]


def may_be_similar(a: bytes, b: bytes, similarity: float) -> bool:
    """False only if the signatures differ in more bits than similar sets have shingles of their own."""
    n, m = int.from_bytes(a[:8], "little"), int.from_bytes(b[:8], "little")
    a, b = np.frombuffer(a, np.uint8, -1, 8), np.frombuffer(b, np.uint8, -1, 8)
    if len(a) != len(b):
        a, b = sorted((a, b), key=len)
        b = np.packbits(np.bitwise_xor.reduce(np.unpackbits(b, bitorder="little").reshape(8 * len(a), -1), axis=1), bitorder="little")
    return int(np.bitwise_count(a ^ b).sum()) <= n + m - 2 * int(least_common(n, m, similarity))


_SETS = "doc_id bigint, fp bigint, size bigint, set binary, signature binary, piece int, counts binary"


def _set_batches(size: int):
    """One row per document, with its set once a task, and at last the task's frequencies of shingles (``counts``)."""
    def run(batches):
        seen: set = set()
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            ids = batch.column("doc_id")
            done = 0
            for _, _, data, offsets in text_blocks(batch.column("text")):
                hashes, first = shingle_sets(data, offsets, size)
                fps = set_keys(hashes, first).view(np.int64)
                flat = pack(hashes).tobytes()
                sets, signs = [], signatures(hashes, first)
                for fp, lo, hi in zip(fps.tolist(), first[:-1].tolist(), first[1:].tolist()):
                    new = hi > lo and fp not in seen
                    seen.add(fp)
                    sets.append(flat[lo * SET_BYTES:hi * SET_BYTES] if new else None)
                fresh = np.repeat(np.array([x is not None for x in sets], bool), np.diff(first))
                counts += np.bincount(_cell(hashes[fresh]), minlength=1 << SKETCH_BITS).astype(np.uint32)
                n = len(fps)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(done, n), pa.array(fps), pa.array(np.diff(first)), pa.array(sets, pa.binary()),
                     pa.array([x if s is not None else None for x, s in zip(signs, sets)], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    names=_SET_NAMES)
                done += n
        width = len(counts) // SKETCH_RANGES
        pieces = [(i, counts[i * width:(i + 1) * width]) for i in range(SKETCH_RANGES)]
        pieces = [(i, c.tobytes()) for i, c in pieces if c.any()]
        n = len(pieces)
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(n, pa.int64())] * 3, *[pa.nulls(n, pa.binary())] * 2, pa.array([i for i, _ in pieces], pa.int32()), pa.array([c for _, c in pieces], pa.binary())],
            names=_SET_NAMES)
    return run


_SET_NAMES = [c.split()[0] for c in _SETS.split(", ")]


def _sum_batches(batches):
    """Sums of sketch pieces from rows sorted by piece."""
    piece = total = None
    for batch in batches:
        for p, counts in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist()):
            counts = np.frombuffer(counts, np.uint32).astype(np.uint64)
            if p != piece:
                if total is not None:
                    yield _piece(piece, total)
                piece, total = p, counts
            else:
                total = total + counts
    if total is not None:
        yield _piece(piece, total)


def _piece(piece, total):
    # Frequencies only order shingles, so steps of a sixteenth do and two bytes hold any of them.
    steps = np.minimum(np.log2(total + 1.0) * 16, 65_535).astype(np.uint16)
    return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([steps.tobytes()], pa.binary())], ["piece", "counts"])


def frequencies(sets: DataFrame) -> np.ndarray:
    """How frequent the shingles of every cell are, in steps; 2 ** SKETCH_BITS numbers whatever the corpus."""
    rows = sets.where("counts IS NOT NULL").select("piece", "counts").repartition("piece").sortWithinPartitions("piece") \
        .mapInArrow(_sum_batches, "piece int, counts binary").collect()
    out = np.zeros((SKETCH_RANGES, (1 << SKETCH_BITS) // SKETCH_RANGES), np.uint16)
    for r in rows:
        out[r["piece"]] = np.frombuffer(r["counts"], np.uint16)
    return out.ravel()


def least_common(n, m, similarity: float):
    """Smallest number of shared shingles of sets of n and m shingles with the similarity."""
    return np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9).astype(np.int64)


def _posting_batches(frequency: np.ndarray, similarity: float):
    """(key, fp, size, place) of the first shingles of every set, from rare to frequent."""
    def run(batches):
        for batch in batches:
            fps, sizes, data = batch.column("fp").to_numpy(), batch.column("size").to_numpy(), batch.column("set").to_pylist()
            for lo in range(0, len(fps), 512):
                size = sizes[lo:lo + 512]
                numbers = unpack(b"".join(data[lo:lo + 512]))
                owner = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((numbers, frequency[_cell(numbers)], owner))
                place = np.arange(len(numbers)) - np.repeat(np.cumsum(size) - size, size)
                keep = place <= (size - np.ceil(similarity * size - 1e-9).astype(np.int64))[owner]
                at = order[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[at].view(np.int64)), pa.array(fps[lo:lo + 512][owner[keep]]), pa.array(size[owner[keep]]), pa.array(place[keep].astype(np.int32))],
                    ["key", "fp", "size", "place"])
    return run


def _key_batches(size: int):
    """(doc_id, fp) of every row."""
    def run(batches):
        for batch in batches:
            found = [np.empty(0, np.uint64)]
            found += [set_keys(*shingle_sets(data, offsets, size)) for _, _, data, offsets in text_blocks(batch.column("text"))]
            yield _rows([batch.column("doc_id"), np.concatenate(found).view(np.int64)], ["doc_id", "fp"])
    return run


def _rows(arrays, names):
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)


def _merged(batches, rows: int = 16_384):
    """The same rows in batches of at least ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_ROUND = "key bigint, fp bigint, size bigint, place int, dst bigint"
_ROUND_NAMES = [c.split()[0] for c in _ROUND.split(", ")]


def _round_batches(low: int, high: int, similarity: float):
    """Pairs (fp, dst) of members low to high - 1 of every posting with all later ones that are not tied yet and may
    be similar, and the members of postings of more than ``high`` (``dst`` null), which take another round.

    Rows (key, fp, size, place, root) come sorted by key and fp; repeated ones count once, and of a posting only its
    first ``high`` members are held.
    """
    def pairs(src, dst):
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        new = np.append(True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]))
        src, dst = src[new], dst[new]
        none = pa.array(np.zeros(len(src), np.int64))
        return pa.RecordBatch.from_arrays([none, pa.array(src), none, none.cast(pa.int32()), pa.array(dst)], _ROUND_NAMES)

    def run(batches):
        front, count, last = None, 0, None
        for batch in _merged(batches):
            now = [batch.column(c).to_numpy() for c in ("key", "fp", "size", "place", "root")]
            again = np.append((now[0][0], now[1][0]) == last, (now[0][1:] == now[0][:-1]) & (now[1][1:] == now[1][:-1]))
            last = now[0][-1], now[1][-1]
            now = [x[~again] for x in now]
            if not len(now[0]):
                continue
            old, shift = 0, 0
            if front is not None and front[0][0] == now[0][0]:
                old, shift = len(front[0]), count - len(front[0])
                now = [np.append(f, x) for f, x in zip(front, now)]
            key, fp, size, place, root = now
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(first, len(key)))
            start = np.repeat(first, n)
            rank = np.arange(len(key)) - start
            # Held members were pivots and given out already, unless the posting was not known to be large.
            large = np.repeat(n, n) > high
            large[:n[0]] = shift + n[0] > high
            if count > high:
                large[:old] = False
            rank[old:n[0]] += shift
            rank[:old] = -1
            src, dst = [], []
            for p in range(low, min(high, int(rank.max()))):
                at = np.flatnonzero(rank > p)
                pivot = start[at] + p
                ok = (root[at] != root[pivot]) & (np.minimum(size[at], size[pivot]) >= similarity * np.maximum(size[at], size[pivot]) - 1e-6)
                at, pivot = at[ok], pivot[ok]
                most = np.minimum(size[at] - place[at], size[pivot] - place[pivot])
                ok = most >= least_common(size[at], size[pivot], similarity)
                src.append(fp[pivot[ok]])
                dst.append(fp[at[ok]])
            if sum(map(len, src)):
                yield pairs(np.concatenate(src), np.concatenate(dst))
            if large.any():
                yield pa.RecordBatch.from_arrays([*[pa.array(x[large]) for x in now[:4]], pa.nulls(int(large.sum()), pa.int64())], _ROUND_NAMES)
            count = (shift if len(first) == 1 else 0) + int(n[-1])
            front = [x[first[-1]:first[-1] + high] for x in now]
    return run


def _wanted_batches(mask: np.ndarray):
    """Rows whose fp is marked; a few others pass too."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(mask[batch.column("fp").to_numpy() & (FILTER_BITS - 1)]))
    return run


def _marked(pairs: DataFrame) -> np.ndarray:
    """Which remainders of fp occur in pairs; FILTER_BITS of them whatever the number of pairs."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("fp"))
    rows = ends.select(F.col("fp").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("bit")).groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("m"))
    mask = np.zeros((FILTER_BITS // 32_768, 4096), np.uint8)
    for r in rows.collect():
        mask[r["b"] - 1] = np.frombuffer(r["m"], np.uint8)
    return np.unpackbits(mask.ravel(), bitorder="little").astype(bool)


def _similar(a: bytes, b: bytes, similarity: float) -> bool:
    a, b = unpack(a), unpack(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def _check_batches(test, similarity: float):
    def run(batches):
        for batch in batches:
            near = [test(a.as_py(), b.as_py(), similarity) for a, b in zip(batch.column("src_data"), batch.column("dst_data"))]
            near = np.array(near, bool)
            yield _rows([batch.column("src").to_numpy()[near], batch.column("dst").to_numpy()[near]], ["src", "dst"])
    return run


def _passing(pairs: DataFrame, rows: DataFrame, data: str, test, similarity: float, label: str) -> DataFrame:
    """The (src, dst) of stored ``pairs`` that pass a test of the ``data`` of both in ``rows``; that of frequent pivots is copied."""
    with arrow_rows(pairs.sparkSession, ROWS_OF_SETS):
        wanted = cut_lineage(rows.select("fp", F.col(data).alias("data")).mapInArrow(
            frugal(_wanted_batches(_marked(pairs))), "fp bigint, data binary").dropDuplicates(["fp"]), label)
    hot = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PAIRS_PER_PIVOT).select(
        "src", F.ceil(F.col("n") / PAIRS_PER_PIVOT).cast("int").alias("copies"))
    copies = F.coalesce("copies", F.lit(1))
    left = wanted.select(F.col("fp").alias("src"), F.col("data").alias("src_data")).join(hot, "src", "left").select(
        "src", "src_data", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    right = wanted.select(F.col("fp").alias("dst"), F.col("data").alias("dst_data"))
    salted = pairs.join(hot, "src", "left").select("src", "dst", F.pmod(F.xxhash64("dst"), copies).cast("int").alias("salt"))
    with arrow_rows(pairs.sparkSession, ROWS_OF_SETS // 8):
        near = cut_lineage(salted.join(right, "dst").join(left, ["src", "salt"]).select("src", "src_data", "dst", "dst_data")
                           .mapInArrow(frugal(_check_batches(test, similarity)), "src bigint, dst bigint"), "copy-links")
    forget(wanted)
    return near


def check_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (src, dst) of stored ``pairs`` whose ``sets`` (fp, set, signature) are similar.

    Signatures, about a fiftieth of the sets, rule out most pairs that are not; sets travel for the rest only.
    """
    close = _passing(pairs, sets, "signature", may_be_similar, similarity, "copy-signatures")
    near = _passing(close, sets, "set", _similar, similarity, "copy-sets")
    forget(close)
    return near


def similar_groups(stored: DataFrame, similarity: float) -> DataFrame:
    """(file_id, group_id): components of all pairs of sets with a Jaccard index of ``similarity`` or more.

    ``stored`` is the table of :func:`_set_batches`. Postings are settled in rounds: the first members of each
    posting against all others that no link ties to them yet, then sixteen times as many. A posting of copies
    is done after the first round; members whose bounds allow a similarity that they do not have take more.
    """
    sets = stored.where("set IS NOT NULL").select("fp", "size", "set")
    live = sets.mapInArrow(frugal(_posting_batches(frequencies(stored), similarity)), "key bigint, fp bigint, size bigint, place int") \
        .withColumn("root", F.col("fp"))
    ties = stored.sparkSession.createDataFrame([], "file_id bigint, group_id bigint")
    low, high, found = 0, 8, None
    while True:
        before = found
        with arrow_rows(stored.sparkSession, ROWS_OF_SETS):
            found = cut_lineage(live.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(
                frugal(_round_batches(low, high, similarity)), _ROUND), "copy-postings")
        forget(*filter(None, [before]))
        pairs = cut_lineage(found.where("dst IS NOT NULL").select(F.col("fp").alias("src"), "dst").distinct(), "copy-pairs")
        if not pairs.isEmpty():
            near = check_pairs(pairs, stored.where("set IS NOT NULL").select("fp", "set", "signature"), similarity)
            before, ties = ties, add_edges(ties if hasattr(ties, "_stored_at") else None, near)
            forget(before, near)
        forget(pairs)
        rest = found.where("dst IS NULL").drop("dst")
        if rest.isEmpty():
            forget(found)
            return ties
        same = Window.partitionBy("key")
        live = rest.join(ties.select(F.col("file_id").alias("fp"), F.col("group_id").alias("tie")), "fp", "left") \
            .withColumn("root", F.coalesce("tie", "fp")).drop("tie") \
            .withColumn("a", F.min("root").over(same)).withColumn("b", F.max("root").over(same)).where("a < b").drop("a", "b")
        low, high = high, 16 * high


def _groups(docs: DataFrame, id_col: str, text_col: str, words: int | None, similarity: float):
    """Rows (doc_id, fp), and one row per fp: (fp, component_id, root, n)."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    counts = F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")
    if words is None:
        rows = cut_lineage(fingerprints(docs, id_col, text_col), "simhash")
        distinct = cut_lineage(rows.groupBy("fp").agg(*counts), "simhash-values")
        groups = components(cut_lineage(links(distinct), "simhash-links"))
    else:
        with arrow_rows(docs.sparkSession, 2 * ROWS_OF_SETS):
            stored = cut_lineage(source.mapInArrow(frugal(_set_batches(words)), _SETS), "shingle-sets")
        rows = cut_lineage(stored.where("size IS NOT NULL").select("doc_id", "fp"), "shingle-keys")
        distinct = cut_lineage(rows.groupBy("fp").agg(*counts), "simhash-values")
        groups = similar_groups(stored, similarity)
        forget(stored)
    members = cut_lineage(groups.select(F.col("file_id").alias("fp"), F.col("group_id").alias("root")), "simhash-groups")
    lowest = members.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("low"))
    linked = members.join(lowest, "root").select("fp", "low", "root")
    facts = cut_lineage(distinct.join(linked, "fp", "left").select(
        "fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("low")).alias("component_id"), F.coalesce("root", "fp").alias("root"), "n"), "simhash-facts")
    return rows, facts


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int | None = None, similarity: float = 0.8) -> DataFrame:
    """(doc_id, fp bigint, component_id): near-duplicate group of every row.

    Fingerprints within two differing bits link; component_id is the smallest doc_id reachable. With ``words``,
    fp is the key of the set of shingles of so many words instead, and sets link at a Jaccard index of ``similarity``.
    Null and empty texts share fingerprint 0 and link like any other. Repeated rows stay rows. Rows
    with a null id join groups too; a group of null ids only has a null component_id. Other
    columns are not looked at. An empty table gives an empty result.
    """
    rows, facts = _groups(docs, id_col, text_col, words, similarity)
    return join_facts(rows, facts.drop("root"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(col: str = "fp"):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int | None = None, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one row of each near-duplicate group of ``near_groups``: that of the smallest id.

    Repeated rows of the kept id and text leave one row; of rows of one id with different texts each goes by its
    own text's group, and those of one group leave one. In a group without any id one row stays.
    """
    rows, facts = _groups(docs, id_col, text_col, words, similarity)
    groups = join_facts(rows, facts.drop("root"), "fp")
    named = groups.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    # Hashes stand for the text, and the rows are dealt by id already.
    text = F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull()
    # Ids of several rows, few or none as a rule: a kept id says nothing about its other texts.
    several = cut_lineage(groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id") == F.col("component_id")).alias("kept"))
                          .where("n > 1 AND kept > 0").select(F.col("doc_id").alias(id_col)), "ids-of-several-rows")
    again = not several.isEmpty()
    single = named.join(several, id_col, "left_anti") if again else named
    left = docs.join(single, id_col, "left_semi").select(*docs.columns, F.xxhash64(*text).alias("_near_text_1"), F.xxhash64(F.lit(1), *text).alias("_near_text_2")) \
        .dropDuplicates([id_col, "_near_text_1", "_near_text_2"]).select(*docs.columns)
    if again:
        some = _with_keys(docs.join(several, id_col, "left_semi"), id_col, text_col, words).join(facts.select("fp", "component_id", "root"), "fp") \
            .where("id = component_id")
        first = some.groupBy("id", "root").agg(F.min("k").alias("k"))
        left = left.unionByName(some.join(first, ["id", "root", "k"], "left_semi").select("row.*"))
    nameless = facts.where("component_id IS NULL").select("fp", "root")
    if nameless.isEmpty():
        return left
    loose = _with_keys(docs.where(F.col(id_col).isNull()), id_col, text_col, words).join(nameless, "fp")
    first = loose.groupBy("root").agg(F.min("k").alias("k"))
    return left.unionByName(loose.join(first.select("k"), "k", "left_semi").select("row.*"))


def _with_keys(docs: DataFrame, id_col: str, text_col: str, words: int | None) -> DataFrame:
    """(row, id, k, fp): one row per id and text of ``docs``, which is ``row``, with hash ``k`` and key ``fp`` of its text."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).cast("bigint").alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("k", F.xxhash64("t")).dropDuplicates(["id", "k"])
    texts = rows.select("k", "t").dropDuplicates(["k"])
    keyed = fingerprints(texts, "k", "t") if words is None else \
        texts.select(F.col("k").alias("doc_id"), F.col("t").alias("text")).mapInArrow(_key_batches(words), "doc_id bigint, fp bigint")
    return rows.drop("t").join(keyed.withColumnRenamed("doc_id", "k"), "k")
