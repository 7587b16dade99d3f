"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text is cut into units (a run of the space mark and what follows up to the next); no piece crosses
them, nor a place between two characters that stand side by side in no piece, so a unit is cut there too
(text without blanks becomes many short rows). Each distinct unit is encoded once per batch. Rows advance
together, the longest first and shorter ones dropping out, one position at a time: the polynomial hashes of
all substrings that end there are probed in the sorted piece keys, and each row takes the best candidate
and stores a back-pointer. A very long row of a BPE model advances as overlapping stretches of equal length:
the candidate at a place depends on the places one piece back only, so where two stretches agree on that
many places they agree from there on; where they do not, the later one is advanced from the earlier one.

What is best depends on the model file. For a unigram model it is the highest sum of scores. A BPE
model's scores are merge ranks, whose highest sum is not the encoding; there a prefix has exactly
one encoding, and a piece may follow the last piece of the shorter prefix only if merging the two
alone would leave both whole. The candidate with that property is the maximum, so the same
lattice gives exactly the ids of the BPE merges. The piece file is a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorset.llm.arrays import blocks, utf8
from mirrorset.llm.common import frugal

MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C55)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_PRESENT_BITS = 20
_NONE = 1 << 40
#: Units advanced together at most; bounds memory.
_BATCH_CHARS = 1 << 19
#: Encoded units that a worker keeps for reuse; more only costs time, never results.
_CACHE_UNITS = 200_000
#: Characters of the texts that are encoded in one step; a longer text is a step of its own.
_STEP_CHARS = 1 << 20
#: Rows of a BPE model beyond this length advance as stretches of this length, with so much overlap at first.
_STRETCH, _OVERLAP = 1024, 128


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value, at, shift = value | (b & 127) << shift, at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of the fields of one serialized protocol message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at:at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at:at + n], at + n
        yield key >> 3, value


@dataclass
class PieceModel:
    """Pieces of a model file as arrays. Kinds: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    bpe: bool
    dummy_prefix: bool
    keys: np.ndarray = field(init=False)
    key_ids: np.ndarray = field(init=False)

    def __post_init__(self):
        usable = [i for i, k in enumerate(self.kinds) if k in (1, 4) and self.pieces[i]]
        self.length = np.array([len(p) for p in self.pieces], np.int64)
        self.longest = max((int(self.length[i]) for i in usable), default=1)
        self.hashes = np.zeros(len(self.pieces), np.uint64)
        for i in usable:
            self.hashes[i] = _hash(_points(self.pieces[i]))
        keys = (self.hashes[usable] + self.length[usable].astype(np.uint64)) * _SPREAD
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(usable, np.int64)[order]
        self.present = np.zeros(1 << _PRESENT_BITS, bool)
        self.present[keys >> np.uint64(64 - _PRESENT_BITS)] = True
        self.by_text = {self.pieces[i]: i for i in usable}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == 6}
        self.unknown = int(np.flatnonzero(self.kinds == 2)[0]) if (self.kinds == 2).any() else 0
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 2)], np.uint64)
        order = np.lexsort((np.arange(len(self.pieces)), -self.scores))
        self.rank = np.empty(len(self.pieces), np.int64)
        self.rank[order] = np.arange(len(order))
        self._spell()
        points = [_points(self.pieces[i]).astype(np.int64) for i in usable if self.length[i] > 1]
        #: Pairs of characters that stand side by side in some piece.
        self.pairs = np.unique(np.concatenate([p[:-1] << 21 | p[1:] for p in points])) if points else np.empty(0, np.int64)
        if self.bpe:
            #: Marks of the piece that long runs of marks are cut into from the left; nothing merges with it any more.
            first = self._merge(MARK * 4 * self.longest)[0][:2] if MARK in self.by_text else []
            size = int(self.length[first[0]]) if len(set(first)) == 1 and len(first) == 2 and first[0] >= 0 else 0
            self.mark_run = size if not any(MARK * (size + n) in self.by_text for n in range(1, self.longest + 1)) else 0
            self._find_splits(usable)

    def _spell(self) -> None:
        """Bytes that each id stands for, in one array."""
        byte_of = {i: b for b, i in self.byte_ids.items()}
        spelled = [bytes([byte_of[i]]) if i in byte_of else p.replace(MARK, " ").encode() if k in (1, 4) else " ⁇ ".encode() if k == 2 else b""
                   for i, (p, k) in enumerate(zip(self.pieces, self.kinds.tolist()))]
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelling_size = np.array([len(x) for x in spelled], np.int64)
        self.spelling_start = np.cumsum(self.spelling_size) - self.spelling_size

    def _find_splits(self, usable: list[int]) -> None:
        """left and right part of the last merge of every piece; itself for pieces that no merge makes."""
        self.left, self.right = np.arange(len(self.pieces)), np.arange(len(self.pieces))
        for i in usable:
            if self.length[i] > 1:
                last = self._merge(self.pieces[i])[1]
                if last:
                    self.left[i], self.right[i] = last

    def _merge(self, text: str):
        """(ids, last merge): plain BPE merges of one text, best rank first, leftmost on ties."""
        parts, last = list(text), None
        while len(parts) > 1:
            found = [(-self.scores[i], at) for at in range(len(parts) - 1) if (i := self.by_text.get(parts[at] + parts[at + 1])) is not None]
            if not found:
                break
            at = min(found)[1]
            last = (self.by_text.get(parts[at]), self.by_text.get(parts[at + 1]))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        ids = [self.by_text.get(p, -1 - ord(p[0])) for p in parts]
        whole = len(ids) == 1 and last is not None and None not in last
        return ids, last if whole else None

    def probe(self, hashes: np.ndarray, lengths) -> np.ndarray:
        """Piece id of each substring hash, or -1. A bit table of the keys' first bits spares most searches."""
        wanted = (hashes + (np.uint64(lengths) if np.isscalar(lengths) else lengths.astype(np.uint64))) * _SPREAD
        out = np.full(len(wanted), -1, np.int64)
        maybe = np.flatnonzero(self.present[wanted >> np.uint64(64 - _PRESENT_BITS)])
        wanted = wanted[maybe]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        out[maybe[hit]] = self.key_ids[at[hit]]
        return out

    def stays_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where BPE of the two pieces' joined text gives back the two pieces."""
        ok = np.ones(len(a), bool)
        live, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), _NONE)
        while len(live):
            n = self.length[a] + self.length[b]
            fits = n <= self.longest
            joined = np.full(len(a), -1)
            if fits.any():
                x, y = a[fits], b[fits]
                joined[fits] = self.probe(self.hashes[x] * self.powers[self.length[y]] + self.hashes[y], n[fits])
            broken = (joined >= 0) & (2 * self.rank[joined] < limit)
            ok[live[broken]] = False
            open_left = (self.rank[a] > self.rank[b]) & (self.right[a] != a)
            open_right = ~open_left & (self.left[b] != b)
            open_left |= ~open_right & (self.right[a] != a)
            go = ~broken & (open_left | open_right)
            live, a, b, step = live[go], a[go], b[go], open_left[go]
            limit = np.where(step, 2 * self.rank[a], 2 * self.rank[b] + 1)
            a, b = np.where(step, self.right[a], a), np.where(step, b, self.left[b])
        return ok


def _hash(points: np.ndarray) -> np.uint64:
    value = 0
    for p in points.tolist():
        value = (value * int(_BASE) + p + 1) & (1 << 64) - 1
    return np.uint64(value)


def load_model(path: str) -> PieceModel:
    """Read a SentencePiece model file; only identity normalization is supported."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, bpe, dummy = [], [], [], False, True
    for number, value in _fields(data):
        if number == 1:
            parts = dict(_fields(value))
            pieces.append(parts[1].decode("utf-8"))
            scores.append(np.frombuffer(parts[2], "<f4")[0] if 2 in parts else 0.0)
            kinds.append(parts.get(3, 1))
        elif number == 2:
            bpe = dict(_fields(value)).get(3, 1) == 2
        elif number == 3:
            rules = dict(_fields(value))
            dummy = bool(rules.get(3, 1))
            if rules.get(2) or rules.get(4, 1):
                raise ValueError("only models without normalization rules are supported")
    return PieceModel(pieces, np.array(scores, np.float64), np.array(kinds), bpe, dummy)


class Encoder:
    """Encodes and decodes texts, each distinct unit once while it is remembered.

    A unit is remembered under its text after one mark; units without a mark or with several keep their
    form (with a space in front, which no unit contains, or their marks).
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def units(self, text: str) -> list[str]:
        """Keys of the units of a text."""
        if not text:
            return []
        if self.model.dummy_prefix and text[0] != " " != text[-1] and "  " not in text and MARK not in text:
            return text.split(" ")
        marked = (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        found, run = [], ""
        for part in marked.split(MARK):
            if part:
                found.append(run + part)
                run = ""
            run += MARK
        if run[:-1]:
            found.append(run[:-1])
        return [u if u.startswith(MARK * 2) else u[1:] if u.startswith(MARK) else " " + u for u in found]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text)."""
        cut = [self.units(t) for t in texts]
        if len(self.known) > _CACHE_UNITS:
            self.forget()
        new = list(set().union(*cut).difference(self.known))
        if new:
            self._learn(new)
        number = np.array(list(map(self.known.__getitem__, chain.from_iterable(cut))), np.int64)
        size = self.size[number]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(self.start[number] - ends + size, size) + np.arange(total)]
        at = np.append(0, ends)[np.append(0, np.cumsum([len(row) for row in cut], dtype=np.int64))]
        return flat, np.diff(at)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        flat, size = self.encode_flat(texts)
        return np.split(flat, np.cumsum(size)[:-1]) if len(size) else []

    def _learn(self, keys: list[str]) -> None:
        m = self.model
        units = [k if k.startswith(MARK) else k[1:] if k.startswith(" ") else MARK + k for k in keys]
        runs = [i for i, u in enumerate(units) if m.bpe and u.startswith(MARK * 2)]
        plain = np.ones(len(keys), bool)
        plain[runs] = False
        members = np.flatnonzero(plain)
        flat = _points("".join(units[i] for i in members)).astype(np.int64)
        first = np.zeros(len(flat), bool)
        length = np.array([len(units[i]) for i in members], np.int64)
        unit_start = np.cumsum(length) - length
        first[unit_start] = True
        if len(flat):
            code = flat[:-1] << 21 | flat[1:]
            at = np.minimum(np.searchsorted(m.pairs, code), max(len(m.pairs) - 1, 0))
            first[1:] |= m.pairs[at] != code if len(m.pairs) else True
        row_start = np.flatnonzero(first)
        ids, size = self._rows(flat, row_start, np.diff(np.append(row_start, len(flat))))
        sizes = np.zeros(len(keys), np.int64)
        if len(members):
            sizes[members] = np.add.reduceat(size, np.searchsorted(row_start, unit_start))
        parts = [self.flat, ids]
        for i in runs:
            # runs of marks are pieces of equal score, whose order of merging is by place
            some = np.array(self._mark_run(units[i]))
            some = self._with_bytes(some, np.array([len(some)]))[0]
            sizes[i] = len(some)
            parts.append(some)
        start = np.zeros(len(keys), np.int64)
        order = np.append(members, np.array(runs, np.int64))
        start[order] = len(self.flat) + np.cumsum(sizes[order]) - sizes[order]
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys))))
        self.flat = np.concatenate(parts)
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, sizes])

    def _mark_run(self, unit: str) -> list[int]:
        m = self.model
        n = len(unit) - len(unit.lstrip(MARK))
        whole = max(0, n // m.mark_run - 3) if m.mark_run > 1 else 0
        return [m.by_text[MARK * m.mark_run]] * whole + m._merge(unit[whole * m.mark_run:])[0] if whole else m._merge(unit)[0]

    def _rows(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in order, ids per row) of stretches of code points."""
        order = np.argsort(-length, kind="stable")
        found, at = [], 0
        while at < len(order):
            longest = int(length[order[at]])
            if self.model.bpe and longest > 2 * _STRETCH:
                part = order[at:at + 1]
                found.append((part, *self._with_bytes(*self._long_row(flat[start[part[0]]:start[part[0]] + longest]))))
            else:
                part = order[at:at + max(1, _BATCH_CHARS // longest)]
                found.append((part, *self._with_bytes(*self._viterbi(*self._padded(flat, start[part], length[part])))))
            at += len(part)
        if not found:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        size = np.empty(len(start), np.int64)
        base = np.empty(len(start), np.int64)
        done = 0
        for part, _, n in found:
            size[part] = n
            base[part] = done + np.cumsum(n) - n
            done += int(n.sum())
        ids = np.concatenate([x for _, x, _ in found])
        ends = np.cumsum(size)
        return ids[np.repeat(base - ends + size, size) + np.arange(len(ids))], size

    @staticmethod
    def _padded(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(points, length) of rows from the longest to the shortest, filled up by zeros."""
        within = np.arange(int(length[0]))
        points = flat[np.minimum(start[:, None] + within, len(flat) - 1)]
        points[within >= length[:, None]] = 0
        return points.astype(np.uint64), length

    def _lattice(self, points: np.ndarray, length: np.ndarray, known: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(back, piece) at every place of every row: length and id of the last piece up to there.

        ``known`` has both of the first places of a single row, from which it goes on.
        """
        n, longest = points.shape
        prefix = np.zeros((longest + 1, n), np.uint64)
        back, piece = np.ones((longest + 1, n), np.int16), np.full((longest + 1, n), -1, np.int32)
        with np.errstate(over="ignore"):
            for i in range(longest):
                prefix[i + 1] = prefix[i] * _BASE + points[:, i] + np.uint64(1)
            if known is not None:
                back[:len(known[0]), 0], piece[:len(known[0]), 0] = known
            for end in range(1 if known is None else len(known[0]), longest + 1):
                k = int(np.searchsorted(-length, -end, "right"))
                (self._only_candidate if self.model.bpe else self._best_candidate)(prefix[:, :k], back[:, :k], piece[:, :k], end)
        return back, piece

    def _viterbi(self, points: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in a row, ids per row); -1 - code point stands for a character without a piece."""
        return self._walk_back(points, length, *self._lattice(points, length))

    @staticmethod
    def _walk_back(points, length, back, piece) -> tuple[np.ndarray, np.ndarray]:
        n = len(points)
        row, at, found = np.arange(n), length.copy(), []
        while len(row):
            p = piece[at, row].astype(np.int64)
            found.append((row, np.where(p >= 0, p, -1 - points[row, at - 1].astype(np.int64))))
            at = at - back[at, row]
            row, at = row[at > 0], at[at > 0]
        size = np.bincount(np.concatenate([r for r, _ in found]), minlength=n)
        ids, ends = np.empty(int(size.sum()), np.int64), np.cumsum(size)
        for step, (r, x) in enumerate(found):
            ids[ends[r] - 1 - step] = x
        return ids, size

    def _long_row(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One very long row by overlapping stretches that are checked to agree."""
        n, window = len(row), self.model.longest
        overlap = max(_OVERLAP, 4 * window)
        begin = np.arange(0, n, _STRETCH)
        start, stop = np.maximum(begin - overlap, 0), np.minimum(begin + _STRETCH, n)
        back, piece = np.ones(n + 1, np.int16), np.full(n + 1, -1, np.int32)
        order = np.argsort(start - stop, kind="stable")
        backs, pieces = self._lattice(*self._padded(row, start[order], (stop - start)[order]))
        column = np.argsort(order)
        for j, (lo, b, hi) in enumerate(zip(start.tolist(), begin.tolist(), stop.tolist())):
            own_back, own_piece = backs[:, column[j]], pieces[:, column[j]]
            if lo and not ((own_back[b - lo - window + 1:b - lo + 1] == back[b - window + 1:b + 1]).all()
                              and (own_piece[b - lo - window + 1:b - lo + 1] == piece[b - window + 1:b + 1]).all()):
                lo = b - window
                one_back, one_piece = self._lattice(row[None, lo:hi].astype(np.uint64), np.array([hi - lo]), (back[lo:b + 1], piece[lo:b + 1]))
                own_back, own_piece = one_back[:, 0], one_piece[:, 0]
            back[b + 1:hi + 1], piece[b + 1:hi + 1] = own_back[b - lo + 1:hi - lo + 1], own_piece[b - lo + 1:hi - lo + 1]
        found, at = [], n
        back, piece = back.tolist(), piece.tolist()
        while at:
            found.append(piece[at] if piece[at] >= 0 else -1 - int(row[at - 1]))
            at -= back[at]
        return np.array(found[::-1], np.int64), np.array([len(found)])

    def _only_candidate(self, prefix, back, piece, end: int) -> None:
        """BPE: the longest candidate that stays apart from the piece before it is the only one that does."""
        m = self.model
        rows = np.arange(prefix.shape[1])
        for size in range(min(m.longest, end), 0, -1):
            found = m.probe(prefix[end, rows] - prefix[end - size, rows] * m.powers[size], size)
            if size == 1:
                piece[end, rows] = found
                break
            good = np.flatnonzero(found >= 0)
            good = good[m.left[found[good]] != found[good]]
            if not len(good):
                continue
            before = piece[end - size, rows[good]].astype(np.int64)
            fits = before < 0
            fits[~fits] = m.stays_apart(before[~fits], found[good][~fits])
            good = good[fits]
            back[end, rows[good]], piece[end, rows[good]] = size, found[good]
            open_ = np.ones(len(rows), bool)
            open_[good] = False
            rows = rows[open_]
            if not len(rows):
                break

    def _best_candidate(self, prefix, back, piece, end: int) -> None:
        """Unigram: the candidate with the highest sum of scores; a character without a piece costs extra."""
        m = self.model
        if end == 1:
            self._score = np.full(prefix.shape, -np.inf)
            self._score[0] = 0
        score = self._score[:, :prefix.shape[1]]
        score[end] = score[end - 1] + float(m.scores.min()) - 10.0
        for size in range(1, min(m.longest, end) + 1):
            found = m.probe(prefix[end] - prefix[end - size] * m.powers[size], size)
            value = np.where(found >= 0, score[end - size] + m.scores[found], -np.inf)
            better = value > score[end]
            score[end, better], back[end, better], piece[end, better] = value[better], size, found[better]

    def _with_bytes(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace characters without a piece by byte pieces or the unknown id."""
        m, missing = self.model, np.unique(ids[ids < 0])
        if not len(missing):
            return ids.astype(np.int32), size
        spelled = [[m.byte_ids[b] for b in chr(-1 - i).encode()] if m.byte_ids else [m.unknown] for i in missing.tolist()]
        letters, first = np.array([b for x in spelled for b in x], np.int64), np.cumsum([0, *map(len, spelled)])
        lost = np.flatnonzero(ids < 0)
        which = np.searchsorted(missing, ids[lost])
        width = np.ones(len(ids), np.int64)
        width[lost] = np.diff(first)[which]
        at = np.cumsum(width) - width
        out = np.repeat(ids, width)
        n = width[lost]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(at[lost], n) + within] = letters[np.repeat(first[which], n) + within]
        owner = np.repeat(np.arange(len(size)), size)
        return out.astype(np.int32), np.bincount(owner, width, len(size)).astype(np.int64)

    def decode_flat(self, flat: np.ndarray, size: np.ndarray) -> list[str]:
        """Texts of id rows. Marks become spaces and the one that encoding adds in front is taken off."""
        width = self.model.spelling_size[flat]
        total = int(width.sum())
        ends = np.cumsum(width)
        raw = self.model.spelling[np.repeat(self.model.spelling_start[flat] - ends + width, width) + np.arange(total)].tobytes()
        cut = np.append(0, ends)[np.append(0, np.cumsum(size))].tolist()
        strip = self.model.dummy_prefix
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]
        return [t[1:] if strip and t[:1] == " " else t for t in texts]

    def decode(self, ids) -> str:
        return self.decode_flat(np.asarray(ids, np.int64), np.array([len(ids)]))[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(load_model(path))
    return _encoders[path]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids array<int>) of every row; null and empty texts have no pieces.

    ``decoded`` adds the text that the ids decode to. Texts go through in slices of a task's batch, so
    memory is bounded by the longest text. Repeated rows stay rows, other columns are not looked at, an
    empty table gives an empty result.
    """

    def run(batches):
        enc = encoder(model_path)
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for a, b in blocks(offsets, _STEP_CHARS):
                flat, size = enc.encode_flat([t or "" for t in batch.column("text")[a:b].to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(flat, pa.int32()))
                columns = {"doc_id": batch.column("doc_id")[a:b], "n_pieces": pa.array(size), "ids": lists}
                if decoded:
                    columns["decoded"] = pa.array(enc.decode_flat(flat, size), pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(frugal(run, lambda: encoder(model_path).forget()), "doc_id bigint, n_pieces bigint, ids array<int>" + (", decoded string" if decoded else ""))


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the texts of id arrays; a null array gives a null text."""

    def run(batches):
        enc = encoder(model_path)
        for batch in batches:
            rows = batch.column("ids").to_pylist()
            texts = enc.decode_flat(np.array([i for x in rows for i in x or ()], np.int64), np.array([len(x or ()) for x in rows], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t if x is not None else None for t, x in zip(texts, rows)], pa.string())],
                                             ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id bigint, text string")
