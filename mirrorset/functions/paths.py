"""Path columns: extension, scopes, wildcards, depth."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirrorset.functions.bits import col


def extension(path) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([^./\\]+)$", 1))


def file_name(path) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def parent(path) -> Column:
    return F.regexp_replace(col(path), r"/[^/]*$", "")


def normalize_dir(directory: str) -> str:
    """Absolute form of a directory setting without a trailing separator."""
    parts: list[str] = []
    for part in directory.strip().split("/"):
        if part in ("", "."):
            continue
        if part == "..":
            if parts:
                parts.pop()
            continue
        parts.append(part)
    return "/" + "/".join(parts)


def normalized(path) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path column."""
    segments = F.filter(F.split(col(path), "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(
            F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def wildcard_regex(pattern: str, anchored: bool = True) -> str:
    """``*`` and ``?`` patterns as a case-insensitive regular expression."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return f"(?is)^{body}$" if anchored else f"(?is){body}"


def wildcard_match(c, pattern: str) -> Column:
    return col(c).rlike(wildcard_regex(pattern))


def path_search(path, needle: str) -> Column:
    """Search box rule: substring, or unanchored wildcard when it holds ``*`` or ``?``."""
    if "*" in needle or "?" in needle:
        return col(path).rlike(wildcard_regex(needle, anchored=False))
    return F.contains(F.lower(col(path)), F.lit(needle.lower()))


def _below(folder: Column, root: str) -> Column:
    """Strictly below ``root`` and not inside a hidden first directory."""
    prefix = root if root.endswith("/") else root + "/"
    return folder.startswith(prefix) & ~folder.startswith(prefix + ".")


def in_scope(folder, roots, recursive: bool = True) -> Column:
    """Case-sensitive include scope with a directory boundary."""
    f, ok = col(folder), F.lit(False)
    for root in map(normalize_dir, roots):
        ok = ok | (f == root)
        if recursive:
            ok = ok | _below(f, root)
    return ok


def is_blacklisted(folder, patterns) -> Column:
    """Plain entries cover a directory tree; wildcards a segment or the full path. Case-blind."""
    f, hit = col(folder), F.lit(False)
    for p in patterns:
        if "*" not in p and "?" not in p:
            root = normalize_dir(p).lower()
            hit = hit | (F.lower(f) == root) | _below(F.lower(f), root)
        elif "/" not in p:
            rx = wildcard_regex(p)
            hit = hit | F.exists(F.split(f, "/"), lambda s: (s != "") & s.rlike(rx))
        else:
            hit = hit | wildcard_match(f, p)
    return hit


def protected(path, directories) -> Column:
    """Recursive prefix on the normalised path; unusable paths count as protected."""
    p, hit = normalized(path), F.lit(False)
    for d in directories:
        root = normalize_dir(d)
        hit = hit | p.startswith(root if root.endswith("/") else root + "/")
    return hit | ~F.coalesce(valid_path(path), F.lit(False))


def valid_path(path) -> Column:
    return (F.length(F.trim(col(path))) > 0) & ~F.contains(col(path), F.lit("\u0000"))


def in_directory(path, directory: str) -> Column:
    """Exactly in this directory, not below it."""
    return parent(normalized(path)) == normalize_dir(directory)


def folder_depth(path) -> Column:
    return F.length(path_ := col(path)) - F.length(F.replace(path_, F.lit("/"), F.lit("")))


def folder_suffix(folder, depth: int) -> Column:
    """The last ``depth`` path segments, lower-cased; equal suffixes are the same folder."""
    segments = F.reverse(F.filter(F.split(F.lower(col(folder)), "/"), lambda s: s != ""))
    return F.array_join(F.slice(segments, 1, depth), "/")


def relocate(path, old_prefix: str, new_prefix: str) -> Column:
    old = normalize_dir(old_prefix).rstrip("/") + "/"
    new = normalize_dir(new_prefix).rstrip("/") + "/"
    p = col(path)
    return F.when(p.startswith(old), F.concat(
        F.lit(new), F.substring(p, len(old) + 1, 2147483647))).otherwise(p)
