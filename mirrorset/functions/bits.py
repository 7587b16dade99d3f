"""Bit arithmetic on hashes and flags kept in signed integers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and bind it inside lambdas, which would repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hamming(a, b) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def has_flag(flags, mask: int) -> Column:
    return col(flags).bitwiseAND(F.lit(mask)) == mask


def any_flag(flags, mask: int) -> Column:
    return col(flags).bitwiseAND(F.lit(mask)) != 0


def set_flag(flags, mask: int) -> Column:
    return col(flags).bitwiseOR(F.lit(mask))


def clear_flag(flags, mask: int) -> Column:
    return col(flags).bitwiseAND(F.lit(~mask))


def band_layout(bands: int, width: int = 64) -> list[tuple[int, int]]:
    """(shift, length) of ``bands`` disjoint bit ranges covering ``width`` bits."""
    base, extra = divmod(width, bands)
    layout, shift = [], 0
    for i in range(bands):
        length = base + (1 if i < extra else 0)
        layout.append((shift, length))
        shift += length
    return layout


def hamming_parts(radius: int, width: int = 64, parts: int = 4) -> list[tuple[int, int, int]]:
    """(shift, length, part radius) of disjoint parts of which one is within its radius if the whole is.

    Up to ``parts`` - 1 bits, one part more than bits is equal. Beyond, the bits are spread: were every one
    of the first parts over ``radius // parts`` and every other one at that many, there would be too many bits.
    """
    count = min(radius + 1, parts)
    each, left = divmod(radius, count)
    # ``left`` + 1 parts may hold ``each`` bits; the others hold one less, or are never needed.
    return [(shift, length, each if i <= left else each - 1) for i, (shift, length) in enumerate(band_layout(count, width))
            if i <= left or each]


def ball(length: int, radius: int) -> list[int]:
    """All masks of ``length`` bits with at most ``radius`` set, fewest first."""
    return [sum(1 << b for b in some) for n in range(radius + 1) for some in combinations(range(length), n)]


def probes(value: Column, length: int, radius: int) -> Column:
    """Array of all values of ``length`` bits within ``radius`` bits of ``value``."""
    masks = F.split(F.lit(",".join(map(str, ball(length, radius)))), ",").cast("array<bigint>")
    return F.transform(masks, lambda m: value.bitwiseXOR(m))


def band_value(h, shift: int, length: int) -> Column:
    part = F.shiftrightunsigned(col(h), shift)
    return part if length == 64 else part.bitwiseAND(F.lit((1 << length) - 1))


def pack_bits(flags_column: Column) -> Column:
    """Pack array<boolean> into one bigint, element i to bit i (at most 64 elements)."""
    indexed = F.transform(flags_column, lambda x, i: F.when(x, F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(indexed, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))


def sign_words(q, dims: int) -> Column:
    """One bigint per 64 components; a bit is set where the component is negative."""
    words = []
    for start in range(0, dims, 64):
        part = F.slice(col(q), start + 1, min(64, dims - start))
        words.append(pack_bits(F.transform(part, lambda x: x < 0)))
    return F.array(*words)


def hamming_words(a, b) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")),
        F.lit(0).cast("bigint"), lambda acc, x: acc + x)
