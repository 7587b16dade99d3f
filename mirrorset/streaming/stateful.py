"""Keyed state: capped samples per reason and consecutive-frame filtering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mirrorset.operators.grouping import previous
from mirrorset.runtime import cut_lineage, scratch_scope
from mirrorset.streaming.sinks import run_available, write_batch


def capped_samples(events: DataFrame, k: int = 5) -> DataFrame:
    """(reason, event_id, sample_no): the first k arriving examples of every reason.

    events: reason, event_id. Batches are thinned to k rows per reason before the shuffle, so a
    reason with most of the rows sends its state task a handful of rows per input batch.
    """
    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values("event_id").groupby("reason", sort=False).head(k)

    def take(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("event_id").head(k - seen) if seen < k else None
        if rows is None or rows.empty:
            return
        state.update((seen + len(rows),))
        yield pd.DataFrame({"reason": [key[0]] * len(rows), "event_id": rows["event_id"].to_numpy(),
                            "sample_no": range(seen + 1, seen + len(rows) + 1)})

    small = events.select("reason", "event_id").mapInPandas(thin, "reason string, event_id bigint")
    return small.groupBy("reason").applyInPandasWithState(
        take, "reason string, event_id bigint, sample_no bigint", "seen bigint", "append", GroupStateTimeout.NoTimeout)


def dedup_backlog(frames: DataFrame, out_root: str, checkpoint: str) -> None:
    """Like :func:`dedup_consecutive`, for streams whose batches hold many frames of one file.

    Inside a batch the frame before comes from a segmented scan, so no task holds a file; between batches
    the last digest of every touched file is stored. Rows (file_id, slot) go to one folder per batch, and a
    retried batch overwrites its own.
    """
    last_root = f"{out_root}-last"

    def handle(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope():
            rows = cut_lineage(batch.select("file_id", "slot", "digest"), "frames")
            seen = previous(rows, ["file_id"], [F.col("slot"), F.col("digest")], "digest", "before")
            if batch_id > 0:
                state = batch.sparkSession.read.parquet(last_root).where(F.col("batch_id") < batch_id) \
                    .groupBy("file_id").agg(F.max_by("digest", "batch_id").alias("last"))
                seen = seen.join(state, "file_id", "left").withColumn("before", F.coalesce("before", "last"))
            write_batch(seen.where("before IS NULL OR before <> digest").select("file_id", "slot"), batch_id, out_root)
            write_batch(rows.groupBy("file_id").agg(F.max_by("digest", F.struct("slot", "digest")).alias("digest")), batch_id, last_root)

    run_available(frames, checkpoint, handle)


def dedup_consecutive(frames: DataFrame) -> DataFrame:
    """(file_id, slot) of frames that differ from the file's previous frame.

    frames: file_id, slot, digest. The state of a file is the digest of its last frame; slots of
    a file arrive in order, and one batch holds at most the file's bounded number of slots.
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("slot")
        before = rows["digest"].shift(1)
        before.iloc[0] = last
        state.update((rows["digest"].iloc[-1],))
        kept = rows[rows["digest"] != before]
        yield pd.DataFrame({"file_id": [key[0]] * len(kept), "slot": kept["slot"].to_numpy()})

    return frames.select("file_id", "slot", "digest").groupBy("file_id").applyInPandasWithState(
        step, "file_id bigint, slot int", "digest string", "append", GroupStateTimeout.NoTimeout)
