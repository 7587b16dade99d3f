"""Derived media metrics and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirrorset.functions.bits import col


# --- fixed values: dynamic-range ranks and unit names ------------------------------------
HDR_RANKS = {"Dolby Vision": 4, "HDR10+": 3, "HDR10": 2, "HLG": 1}
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB")
# -----------------------------------------------------------------------------------------


def hdr_rank(hdr_format) -> Column:
    rank = F.lit(0)
    for name, value in HDR_RANKS.items():
        rank = F.when(col(hdr_format) == name, value).otherwise(rank)
    return rank


def hdr_format(color_transfer, side_data_types) -> Column:
    transfer, side = F.lower(col(color_transfer)), F.lower(F.coalesce(col(side_data_types), F.lit("")))
    return F.when(transfer == "arib-std-b67", "HLG").when(
        (transfer == "smpte2084") & F.contains(side, F.lit("dovi")), "Dolby Vision").when(
        (transfer == "smpte2084") & F.contains(side, F.lit("smpte2094")), "HDR10+").when(
        transfer == "smpte2084", "HDR10").otherwise("")


def bits_per_pixel(bitrate_kbs, frame_size, fps) -> Column:
    """kb/s per pixel and frame; 0 when any part is unknown."""
    w = F.try_element_at(F.split(col(frame_size), "x"), F.lit(1)).try_cast("double")
    h = F.try_element_at(F.split(col(frame_size), "x"), F.lit(2)).try_cast("double")
    value = F.try_divide(col(bitrate_kbs) * F.lit(1000.0), w * h * col(fps))
    known = (col(bitrate_kbs) > 0) & (col(fps) > 0) & (w > 0) & (h > 0)
    return F.coalesce(F.when(known, value), F.lit(0.0))


def megabytes(size) -> Column:
    """Whole megabytes, truncated; two 32-bit divisions as stored sizes are compared."""
    kb = (col(size).cast("float") / F.lit(1024.0).cast("float")).cast("float")
    return F.floor((kb / F.lit(1024.0).cast("float")).cast("float"))


def score_text(score) -> Column:
    """One decimal, half away from zero, on the shortest decimal form of the number."""
    return F.round(col(score).cast("string").cast("decimal(12,6)"), 1).cast("decimal(12,1)").cast("string")


def shown_as_hundred(score) -> Column:
    return F.round(col(score).cast("string").cast("decimal(12,6)"), 1) >= 100


def bytes_text(size) -> Column:
    s, text = col(size), None
    for i in reversed(range(1, len(SIZE_UNITS))):
        piece = F.format_string(f"%.1f {SIZE_UNITS[i]}", F.round(s / F.lit(float(1024 ** i)), 1))
        text = F.when(s >= 1024 ** i, piece) if text is None else text.when(s >= 1024 ** i, piece)
    return text.when(s == 0, "0 B").otherwise(F.format_string("%.1f B", s.cast("double")))


def bitrate_text(kbs) -> Column:
    k = col(kbs)
    return F.when(k <= 0, "").when(
        k >= 1000, F.format_string("%.1f Mb/s", F.round(k / F.lit(1000.0), 1))).otherwise(
        F.concat(F.round(k).cast("bigint").cast("string"), F.lit(" kb/s")))


def clock_text(seconds) -> Column:
    s = F.floor(col(seconds)).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60)


def number_text(value: Column, digits: int) -> Column:
    """At most ``digits`` decimals without trailing zeros."""
    fixed = F.format_string(f"%.{digits}f", F.round(value, digits))
    return F.regexp_replace(fixed, r"\.?0+$", "")


def percent_text(part: Column, best: Column) -> Column:
    """Signed whole percent against the best value; '=' below half a percent."""
    pct = (part - best) / best * 100
    whole = F.abs(F.round(pct, 0)).cast("bigint").cast("string")
    return F.when(best > 0, F.when(F.abs(pct) < 0.5, "=").otherwise(
        F.concat(F.when(pct < 0, "-").otherwise("+"), whole, F.lit("%"))))


def duration_delta_text(diff: Column) -> Column:
    a = F.abs(diff).cast("bigint")
    h, m, s = F.floor(a / 3600), F.floor(a / 60) % 60, a % 60
    body = F.when(a >= 3600, F.format_string("%dh%02dm%02ds", h, m, s)).when(
        a >= 60, F.format_string("%dm%02ds", m, s)).otherwise(F.format_string("%ds", s))
    return F.when(diff == 0, "=").otherwise(F.concat(F.when(diff < 0, "-").otherwise("+"), body))


def exif_timestamp(text) -> Column:
    """Date of an EXIF text such as 2024:05:06 07:08:09; null where it is not one."""
    c = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(F.trim(c), F.lit("yyyy:MM:dd HH:mm:ss"))
