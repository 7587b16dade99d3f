"""Running a stream over what is there now, and idempotent batch writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mirrorset.runtime import scratch_path


def file_stream(spark: SparkSession, folder: str, schema, glob: str, fmt: str = "parquet") -> DataFrame:
    """Rows of what ``glob`` names in a folder: files, or folders of part files. Braces make any name a pattern."""
    return spark.readStream.format(fmt).schema(schema).load(f"{folder}/{{{glob}}}")


def write_batch(df: DataFrame, batch_id: int, root: str) -> None:
    """One folder per batch id, overwritten when the batch is retried: exactly-once results."""
    df.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None] | None = None,
                  out: str | None = None, mode: str = "append") -> None:
    """Process everything available and stop."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if handle is not None:
        q = writer.foreachBatch(handle).start()
    else:
        q = writer.format("parquet").option("path", out).start()
    q.awaitTermination()


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream to its end into the scratch folder and return the written table."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, label + "-state")
    if mode == "append":
        run_available(stream, checkpoint, out=out)
    else:
        run_available(stream, checkpoint, lambda df, i: write_batch(df, i, out), mode=mode)
    return spark.read.schema(stream.schema).parquet(out)
