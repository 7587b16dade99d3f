"""Listing media files and fingerprinting their content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mirrorset.functions import paths
from mirrorset.schema import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS

CHUNK_BYTES = 64 * 1024


def plain_path(column: str = "path"):
    """Drop the scheme that listings put in front of local paths."""
    return F.regexp_replace(column, r"^file:/+", "/")


def scan_files(spark: SparkSession, roots: list[str], recursive: bool = True, include_images: bool = True,
               exclude: list[str] = (), extensions: tuple[str, ...] | None = None) -> DataFrame:
    """(path, folder, is_image, size, modified): media files below the roots; content is not read."""
    wanted = extensions or VIDEO_EXTENSIONS + (IMAGE_EXTENSIONS if include_images else ())
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    rows = reader.load(list(roots)).select(plain_path().alias("path"), F.col("length").alias("size"),
                                           F.col("modificationTime").alias("modified"))
    ext = paths.extension("path")
    out = rows.where(ext.isin(*wanted)).withColumn("folder", paths.parent("path")) \
        .withColumn("is_image", ext.isin(*IMAGE_EXTENSIONS))
    if exclude:
        out = out.where(~paths.is_blacklisted("folder", exclude))
    return out.select("path", "folder", "is_image", "size", "modified")


def _content_sum(path: str) -> str | None:
    """Size plus the little-endian words of the first and last 64 KiB, modulo 2^64, as hex."""
    from pyarrow import fs

    try:
        system, name = fs.FileSystem.from_uri(path)
        with system.open_input_file(name) as f:
            size = f.size()
            if size < CHUNK_BYTES:
                return None
            head = f.read_at(CHUNK_BYTES, 0)
            tail = f.read_at(CHUNK_BYTES, size - CHUNK_BYTES)
    except (OSError, ValueError):
        return None
    words = np.frombuffer(head, dtype="<u8").sum(dtype=np.uint64) + np.frombuffer(tail, dtype="<u8").sum(dtype=np.uint64)
    return f"{(int(words) + size) % 2 ** 64:016x}"


def content_fingerprint(files: DataFrame) -> DataFrame:
    """Adds ``os_hash`` by two ranged reads per file; null for small or unreadable files."""
    schema = StructType([*files.schema.fields, StructField("os_hash", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(os_hash=[_content_sum(p) for p in pdf["path"]])

    return files.mapInPandas(run, schema)
