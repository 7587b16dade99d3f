"""Int8 embeddings: quantisation and cosine."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorset.functions.bits import col
from mirrorset.functions.frames import _matrix

SCALE = 127


def quantize_unit(vec) -> Column:
    """Round half to even to +-127."""
    return F.transform(col(vec), lambda x: F.greatest(F.lit(-127.0), F.least(
        F.lit(127.0), F.rint((x * F.lit(127.0).cast("float")).cast("double")))).cast("tinyint"))


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x.cast("bigint") * y.cast("bigint")),
        F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def clamp_cosine(dot_product: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot_product / F.lit(float(SCALE * SCALE))))


def int8_cosine(a, b) -> Column:
    return clamp_cosine(dot(a, b))


@F.arrow_udf(T.LongType())
def dot_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = _matrix(a).astype(np.int32), _matrix(b).astype(np.int32)
    return pa.array(np.einsum("ij,ij->i", x, y).astype(np.int64) if len(a) else [], type=pa.int64())


def sign_bound(threshold: float, dims: int) -> int:
    """Sign-bit distance beyond which a cosine of ``threshold`` is out of reach (4.6 sigma)."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(dims * p + 4.6 * math.sqrt(dims * p * (1 - p)))
