"""Small helpers shared by the tests."""

import math


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


def file_row(file_id, gray, duration=100.0, folder="/a", is_image=False, size=1000, inode=None, phashes=(0,)):
    return (file_id, is_image, float(duration), folder, size, 1, inode if inode is not None else file_id,
            f"{folder}/{file_id}", list(gray), list(phashes))


FEATURES = ("file_id bigint, is_image boolean, duration_s double, folder string, size bigint, dev bigint, "
            "inode bigint, path string, gray array<smallint>, phashes array<bigint>")


def features(spark, rows):
    return spark.createDataFrame(rows, FEATURES)
