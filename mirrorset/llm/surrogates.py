"""PII replacement by keyed surrogates of the same type, gender, script and format.

Surrogates come from keyed permutations: a value's letters and digits are read as one number in the
range that its format allows, and that number is permuted (Feistel rounds, walking on until the
result is in range). A permutation never sends two values to one, so distinct entities stay distinct,
and the same entity gets the same surrogate in every document, in any task, without a lookup table
that would grow with the corpus. Names are permuted inside lists by gender, or letter by letter in their
own script. That no two entities of the corpus share a surrogate, and that none keeps its value, is
checked on the table of all distinct entities; if the check fails, the key's round is raised.

One entity written in several formats (separators, brackets, digits of another script, with or without the
country code that its format implies) is one entity: its bare digits are permuted, and the format is put
back. Every letter and number of every script can change: those outside the alphabets below move among the
characters of the same kind and script in their 256 code points. A value without any such character is
replaced by keyed letters of its length. Names are found behind a title only, and their further mentions in
the same document; given names that keep their gender come from a short list. The key is the caller's
secret: whoever has it can undo the replacement.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorset.llm.common import cut_lineage, frugal
from mirrorset.runtime import forget

_WALKS = 100_000

# Honorifics with the gender they state, and given names by gender.
TITLES = {"mr": "m", "mr.": "m", "mister": "m", "herr": "m", "herrn": "m", "monsieur": "m", "señor": "m", "sr.": "m",
          "mrs": "f", "mrs.": "f", "ms": "f", "ms.": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "sra.": "f",
          "dr.": "", "prof.": ""}
GIVEN = {"m": ("James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Peter Paul Andrew "
               "Hans Karl Jürgen Stefan Wolfgang Pierre Jean Michel Philippe Louis Carlos José Luis Miguel Antonio").split(),
         "f": ("Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emily Anna Julia Laura Alice "
               "Ursula Sabine Petra Monika Greta Marie Claire Sophie Camille Isabelle Carmen Lucía Elena Rosa Pilar").split()}
_GENDER = {n: g for g, names in GIVEN.items() for n in names}
#: Runs of code points of one script and case; letters are permuted within their run.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäçèéêëíîïñóôöùúûüœß", "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜŒ",
             "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"]
_PLACE = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
# Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = ("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
                   "81 82 84 86 90 91 92 93 94 95 98").split()
#: Characters that are permuted as one number; longer values go piece by piece.
_PIECE = 64
#: Rows of a batch whose texts a worker holds at a time.
_SLICE_ROWS = 1000


@lru_cache(maxsize=1 << 16)
def _place(c: str) -> tuple[str, int] | None:
    """(alphabet, place in it) of a letter or number; None for characters that stay."""
    if c in _PLACE:
        return _PLACE[c]
    kind = unicodedata.category(c)
    if kind == "Nd":
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10))), unicodedata.decimal(c)
    if kind[0] not in "LN":
        return None
    alphabet = _block(ord(c) >> 8, kind, unicodedata.name(c, "").split(" ")[0])
    return (alphabet, alphabet.index(c)) if len(alphabet) > 1 else None


@lru_cache(maxsize=1 << 12)
def _block(block: int, kind: str, script: str) -> str:
    """Characters of 256 code points of one category whose names begin with the same word."""
    some = map(chr, range(block << 8, (block + 1) << 8))
    return "".join(c for c in some if c not in _PLACE and unicodedata.category(c) == kind and unicodedata.name(c, "").split(" ")[0] == script)


def plain_digits(value: str) -> str:
    """Decimal digits of every script as 0-9."""
    return value if value.isascii() else "".join(str(unicodedata.decimal(c)) if unicodedata.category(c) == "Nd" else c for c in value)


def _refilled(value: str, new: str, keep) -> str:
    """``value`` with the characters that ``keep`` accepts replaced in order; digits stay in their script."""
    rest, out = iter(new), []
    for c in value:
        if not keep(c):
            out.append(c)
            continue
        n = next(rest)
        out.append(chr(ord(c) - unicodedata.decimal(c) + int(n)) if n.isdigit() and unicodedata.category(c) == "Nd" else n)
    return "".join(out)

#: Numbers of another kind that a phone number does not run into.
_OTHER = r"(?:\d{1,3}\.){3}\d|\d{3}-\d{2}-\d"
_TITLE = "|".join(re.escape(x) for t in TITLES for x in (t[0].upper() + t[1:], t.upper()))
_NAME = r"[^\W\d_a-zà-öø-ÿ]\w*(?:[-'’]\w+)*"
#: Detectors in order; where two overlap, the one that starts first wins, then the earlier in this list.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,9}[A-Za-z]{2,63}(?![\w-])",
    "secret": r"(?<![^\W_])(?i:password|passwd|pwd|secret|api[_-]?key|token)(?i:[_-]key)?['\"]?\s?[=:]\s?['\"]?(?P<secret_value>[^\s,;'\"]{6,})",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "card": r"(?<![\w-])(?:(?:\d{4}[ -]?){3}\d{4}(?:\d{1,3})?|3[47]\d\d[ -]?\d{6}[ -]?\d{5})(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?![\w-])|"
             r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?(?!" + _OTHER + r")\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])",
    "name": r"(?<!\w)(?:" + _TITLE + r") (?P<name_value>" + _NAME + "(?: " + _NAME + "){0,2})",
}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
_CARD, _PHONE = re.compile(PATTERNS["card"]), re.compile(PATTERNS["phone"])
_TOKEN, _COMPOUND = re.compile(r"\w+"), re.compile(r"\w+(?:[-'’]\w+)+")
_HEX = re.compile(r"[0-9a-f]{8,}")
_HINT = re.compile(r"[@=:]|\d{3}|\d\.\d|\+\d|AKIA|ASIA|" + "(?:" + _TITLE + ") ")


def _iban_rest(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def is_card(value: str) -> bool:
    """A number with the prefix, length and check digit of a payment card."""
    d = re.sub(r"\D", "", plain_digits(value))
    n, two, four = len(d), int(d[:2]), int(d[:4])
    known = d[0] == "4" and n in (16, 19) or n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720) or two in (34, 37) and n == 15 \
        or 16 <= n <= 19 and (two in (50, 62, 65) or 56 <= two <= 58 or two in (60, 61, 63, 64, 66, 67, 68, 69) or 3528 <= four <= 3589)
    return known and luhn(d)


def _before_card(text: str, start: int, end: int) -> int:
    """Where a phone number ends that runs into a card number; ``end`` if it does not."""
    at = start
    while (m := _CARD.search(text, at, end + 40)) and m.start() < end:
        if m.end() > end and is_card(m.group()):
            shorter = _PHONE.match(text, start, m.start())
            return shorter.end() if shorter else end
        at = m.start() + 1
    return end


def _repeats(text: str, names: set[str], taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Further mentions of names without their title: the whole name, its first two words, or one word of it.

    A single word counts if the name has at most two (a third may be any capitalised word behind it) and the text
    does not also use it in lower case.
    """
    wanted, once = set(names), set(_TOKEN.findall(text)) | set(_COMPOUND.findall(text))
    for name in names:
        words = name.split(" ")
        wanted.add(" ".join(words[:2]))
        wanted |= {w for w in words if len(words) <= 2 and len(w) > 2 and w.lower() not in once}
    # Names by their first token, and how many tokens those have.
    lengths: dict[str, set[int]] = {}
    for w in wanted:
        tokens = _TOKEN.findall(w)
        lengths.setdefault(tokens[0], set()).add(len(tokens))
    spans = [m.span() for m in _TOKEN.finditer(text)]
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end = spans[i]
        for n in sorted(lengths.get(text[start:end], ()), reverse=True):
            if i + n <= len(spans) and text[start:spans[i + n - 1][1]] in wanted:
                stop = spans[i + n - 1][1]
                while at < len(taken) and taken[at][1] <= start:
                    at += 1
                if at == len(taken) or taken[at][0] >= stop:
                    out.append((start, stop, "name", text[start:stop]))
                i += n - 1
                break
        i += 1
    return out


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, value) of every entity, in order, not overlapping."""
    if not text or not _HINT.search(text):
        return []
    out, names, at = [], set(), 0
    while m := _FIND.search(text, at):
        kind = m.lastgroup if m.lastgroup in PATTERNS else m.lastgroup.split("_")[0]
        part = f"{kind}_value" if f"{kind}_value" in m.re.groupindex else kind
        value = m.group(part)
        if kind == "iban" and _iban_rest(plain_digits(value).replace(" ", "")) != 1 or kind == "card" and not is_card(value):
            at = m.start() + 1
            continue
        at = m.end()
        if kind == "phone":
            at = _before_card(text, m.start(), at)
            value = text[m.start():at]
        if kind == "name":
            names.add(value)
        out.append((m.start(part), m.start(part) + len(value), kind, value))
    return sorted(out + _repeats(text, names, out)) if names else out


def _permute(x: int, n: int, key: bytes, back: bool = False) -> int:
    """Keyed permutation of 0..n-1, or its inverse."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low, size = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = (x & low, x >> half) if back else (x >> half, x & low)
        for r in range(5, -1, -1) if back else range(6):
            f = hashlib.shake_128(key + bytes([r]) + right.to_bytes(size, "big")).digest(size)
            left, right = right, left ^ (int.from_bytes(f, "big") & low)
        x = right << half | left if back else left << half | right
        if x < n:
            return x


def _move(x: int, n: int, key: bytes) -> int:
    """Keyed permutation of 0..n-1 in one cycle, so that nothing stays where it is."""
    return _permute((_permute(x, n, key) + 1) % n, n, key, back=True)


def _letters(value: str, key: bytes, change=_permute) -> str:
    """Permute letters and numbers within their script and case; other characters stay."""
    if len(value) > _PIECE:
        return "".join(_letters(value[i:i + _PIECE], key + f"{i}/{len(value)}|".encode(), change) for i in range(0, len(value), _PIECE))
    at = [_place(c) for c in value]
    pattern = "".join(p[0][0] if p else c for p, c in zip(at, value))
    x, n = 0, 1
    for p in at:
        if p:
            x, n = x * len(p[0]) + p[1], n * len(p[0])
    y, out = change(x, n, key + pattern.encode("utf-8", "surrogatepass")), list(value)
    for i in range(len(value) - 1, -1, -1):
        if at[i]:
            y, k = divmod(y, len(at[i][0]))
            out[i] = at[i][0][k]
    return "".join(out)


def _made_up(value: str, key: bytes) -> str:
    """Keyed letters of the same length, for values in which nothing can be permuted."""
    stream = hashlib.shake_128(key + value.encode("utf-8", "surrogatepass")).digest(len(value))
    return "".join(ALPHABETS[1][b % 26] for b in stream)


def _walk(value: str, step, ok) -> str:
    """Apply a permutation until the result is in the allowed set that ``value`` is in; still a permutation."""
    for _ in range(_WALKS):
        value = step(value)
        if ok(value):
            break
    return value


def _same_case(shape: str, lower: str) -> str:
    return "".join(c.upper() if s != s.lower() and len(c.upper()) == 1 else c for s, c in zip(shape, lower))


def _ip_class(value: str) -> str:
    a, b = (int(x) for x in value.split(".")[:2])
    return "private" if a == 10 or (a, b) == (192, 168) or a == 172 and 16 <= b < 32 else "odd" if a in (0, 127) or a >= 224 else "public"


def _ip(value: str, key: bytes) -> str:
    def step(v: str) -> str:
        x = 0
        for part in v.split("."):
            x = x << 8 | int(part)
        y = _permute(x, 1 << 32, key)
        return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))

    kind = _ip_class(value)
    return _walk(value, step, lambda v: _ip_class(v) == kind)


def _email(value: str, key: bytes) -> str:
    low = value.lower()
    local, domain = low.split("@")
    host, top = domain.rsplit(".", 1)
    new_domain = _letters(host, key + b"domain" + top.encode()) + "." + top
    return _same_case(value, _letters(local, key + b"local" + domain.encode()) + "@" + new_domain)


def _name_part(word: str, key: bytes) -> str:
    if len(word) > 1 and word.isupper() and word.capitalize() != word == word.capitalize().upper():
        new = _name_part(word.capitalize(), key)
        if len(new.upper()) == len(word):
            return new.upper()
    gender = _GENDER.get(word)
    if gender is not None:
        names = GIVEN[gender]
        return names[_move(names.index(word), len(names), key + gender.encode())]
    if not any(map(_place, word)):
        return _made_up(word, key)
    return _walk(word, lambda w: _letters(w, key + b"name", _move), lambda w: w not in _GENDER)


def split_phone(value: str) -> tuple[str, str]:
    """(country code, national digits); a number without a plus has the format of country code 1."""
    digits = re.sub(r"\D", "", plain_digits(value))
    if not value.startswith("+"):
        return "1", digits
    size = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3
    size = min(size, len(digits) - 1)
    return digits[:size], digits[size:]


def _phone(value: str, key: bytes) -> str:
    code, national = split_phone(value)
    leads = national[0] in "01"
    new = _walk(national, lambda v: _letters(v, key + code.encode()), lambda v: (v[0] in "01") == leads)
    return _refilled(value, (code if value.startswith("+") else "") + new, str.isdecimal)


def _card(value: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", plain_digits(value))
    valid, first = is_card(digits), digits[0]
    new = _walk(digits, lambda v: first + _letters(v[1:], key + first.encode()), lambda v: is_card(v) == valid)
    return _refilled(value, new, str.isdecimal)


def _iban(value: str, key: bytes) -> str:
    compact = plain_digits(value).replace(" ", "")
    new = _walk(compact, lambda v: v[:2] + _letters(v[2:], key + v[:2].encode()), lambda v: _iban_rest(v) == 1)
    return _refilled(value, new, str.isalnum)


@lru_cache(maxsize=1 << 15)
def surrogate(kind: str, value: str, key: str, round_: int = 0) -> str:
    """The replacement of one mention; a permutation of the entities of one type, in the mention's format."""
    k = f"{key}|{round_}|{kind}|".encode()
    if kind == "email":
        return _email(value, k)
    if kind == "ip":
        return _refilled(value, _ip(plain_digits(value), k), str.isdecimal) if not value.isascii() else _ip(value, k)
    if kind == "name":
        return " ".join(_name_part(w, k) for w in value.split(" "))
    if kind == "key":
        return value[:4] + _letters(value[4:], k)
    if kind in ("phone", "card", "iban"):
        return {"phone": _phone, "card": _card, "iban": _iban}[kind](value, k)
    if kind == "ssn":
        return _refilled(value, _letters(plain_digits(value).replace("-", ""), k), str.isdecimal)
    if _HEX.fullmatch(value) and len(value) <= _PIECE:
        return f"{_permute(int(value, 16), 16 ** len(value), k + str(len(value)).encode()):0{len(value)}x}"
    if not any(map(_place, value)):
        return _made_up(value, k)
    return _walk(value, lambda v: _letters(v, k), lambda v: not (_HEX.fullmatch(v) and len(v) <= _PIECE))


def canonical(kind: str, value: str) -> str:
    """What makes two mentions the same entity: the value without its format."""
    if kind == "email":
        return value.lower()
    if kind == "phone":
        return "+" + "".join(split_phone(value))
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", plain_digits(value))
    if kind == "iban":
        return plain_digits(value).replace(" ", "")
    return plain_digits(value) if kind == "ip" else value


def replace(text: str | None, key: str, round_: int = 0) -> tuple[str | None, int]:
    """(text with surrogates, number of replaced mentions)."""
    found = find(text or "")
    if not found:
        return text, 0
    parts, at = [], 0
    for start, end, kind, value in found:
        parts += [text[at:start], surrogate(kind, value, key, round_)]
        at = end
    return "".join([*parts, text[at:]]), len(found)


def _forget() -> None:
    for cached in (_place, _block, surrogate):
        cached.cache_clear()


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, value, mentions): distinct entities of the corpus; counted per task first."""

    def run(batches):
        for batch in batches:
            count: dict = {}
            for text in batch.column(0).to_pylist():
                for _, _, kind, value in find(text or ""):
                    count[kind, canonical(kind, value)] = count.get((kind, canonical(kind, value)), 0) + 1
            yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in count], pa.string()), "value": pa.array([v for _, v in count], pa.string()),
                                              "n": pa.array(list(count.values()), pa.int64())})

    return docs.select(F.col(text_col).alias("text")).mapInArrow(frugal(run, _forget), "kind string, value string, n bigint") \
        .groupBy("kind", "value").agg(F.sum("n").alias("mentions"))


def surrogate_table(found: DataFrame, key: str, round_: int = 0) -> DataFrame:
    """(kind, value, surrogate) of every distinct entity."""

    def run(batches):
        for batch in batches:
            kinds, values = batch.column("kind"), batch.column("value")
            new = [surrogate(k, v, key, round_) for k, v in zip(kinds.to_pylist(), values.to_pylist())]
            yield pa.RecordBatch.from_arrays([kinds, values, pa.array(new, pa.string())], ["kind", "value", "surrogate"])

    return found.select("kind", "value").mapInArrow(frugal(run, _forget), "kind string, value string, surrogate string")


def _letters_of(col: str):
    return F.regexp_replace(col, r"[^\p{L}\p{N}]", "")


def safe_round(docs: DataFrame, key: str, text_col: str = "text", max_rounds: int = 16) -> int:
    """The first key round in which the corpus has no collision and no entity that keeps its value.

    A short value may keep itself with the chance of any permutation: entities of up to six letters and
    digits do not count as kept. Should every round have a clash, the one with the fewest is taken.
    """
    found = cut_lineage(entities(docs, text_col), "entities")
    fewest, best = None, 0
    for round_ in range(max_rounds):
        table = surrogate_table(found, key, round_)
        clashes = table.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("surrogate") == F.col("value")) & (
            F.length(_letters_of("value")) > 6)).alias("kept")).where("n > 1 OR kept").count()
        if fewest is None or clashes < fewest:
            fewest, best = clashes, round_
        if not clashes:
            break
    forget(found)
    return best


def replace_pii(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text_col``; all columns and rows stay, others are untouched.

    Null and empty texts stay as they are; texts without an entity come back unchanged, byte by byte.
    Repeated rows stay and get the same surrogates; ids are not looked at, so ties and null ids do not
    matter; an empty table stays empty. Long texts take time in proportion to their length.
    """
    round_ = safe_round(docs, key, text_col)
    at = docs.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        for batch in batches:
            for lo in range(0, max(len(batch), 1), _SLICE_ROWS):
                part = batch.slice(lo, _SLICE_ROWS)
                new = [replace(t, key, round_)[0] for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.mapInArrow(frugal(run, _forget), fields)


def surrogate_texts(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_entities, text) of every row, texts with surrogates.

    Null texts stay null and empty ones empty, with no entities. Repeated rows and rows of a null id stay
    rows; other columns are not looked at; an empty table gives an empty result.
    """
    round_ = safe_round(docs, key, text_col)

    def run(batches):
        for batch in batches:
            for lo in range(0, max(len(batch), 1), _SLICE_ROWS):
                part = batch.slice(lo, _SLICE_ROWS)
                done = [replace(t, key, round_) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for _, n in done], pa.int64()), pa.array([t for t, _ in done], pa.string())],
                                                 ["doc_id", "n_entities", "text"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(frugal(run, _forget), "doc_id bigint, n_entities bigint, text string")
