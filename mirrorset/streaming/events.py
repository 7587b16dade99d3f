"""Progress rates and log templates; the same functions serve batch and streaming input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorset.operators.grouping import previous, running_sum
from mirrorset.runtime import cut_lineage


def progress_rate(progress: DataFrame, window: str = "90 seconds", slide: str = "30 seconds",
                  min_observation_s: float = 15.0, min_completed: int = 8, watermark: str | None = None) -> DataFrame:
    """Rate and remaining seconds per sliding window; null below the minimum evidence.

    progress: ts, completed, total. Finished work has zero seconds left.
    """
    src = progress.withWatermark("ts", watermark) if watermark else progress
    g = src.groupBy(F.window("ts", window, slide)).agg(
        F.min("completed").alias("first"), F.max("completed").alias("last"), F.max("total").alias("total"),
        (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("span_us"))
    span, done = F.col("span_us") / 1e6, F.col("last") - F.col("first")
    enough = (span >= min_observation_s) & (done >= min_completed)
    rate = F.when(enough, done / span)
    return g.select(F.col("window.end").alias("window_end"), F.col("last").alias("completed"), rate.alias("rate"),
                    F.when(F.col("last") >= F.col("total"), F.lit(0.0)).otherwise(
                        (F.col("total") - F.col("last")) / rate).alias("eta_s"))


def linear_eta(completed: Column, total: Column, elapsed_s: Column) -> Column:
    return F.when(completed > 0, elapsed_s * (total - completed) / completed)


def message_template(message) -> Column:
    """Quoted spans become *, digit runs become #; an unclosed quote swallows the rest."""
    m = F.col(message) if isinstance(message, str) else message
    quoted = F.regexp_replace(m, r"(?s)(['\"]).*?\1", "$1*$1")
    closed = F.regexp_replace(quoted, r"(?s)^((?:[^'\"]|'\*'|\"\*\")*+)(['\"]).*$", "$1$2")
    return F.regexp_replace(closed, r"\d+", "#")


def log_sessions(log: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``session``: 0 before the first start row, then counting up."""
    one = log.withColumn("_log", F.lit(0))
    return running_sum(one, ["_log"], order, F.col("is_session_start").cast("int"), "session").drop("_log")


def log_templates(sessions: DataFrame, search: str = "") -> DataFrame:
    """(session, severity, template, repeats, first_id): messages collapsed by shape.

    A template survives a search when any of its messages contains the text.
    """
    rows = sessions.where("NOT is_session_start")
    hit = F.contains(F.lower("message"), F.lit(search.lower())) if search else F.lit(True)
    return rows.groupBy("session", "severity", message_template("message").alias("template")).agg(
        F.count(F.lit(1)).alias("repeats"), F.min("log_id").alias("first_id"), F.bool_or(hit).alias("_hit")) \
        .where("_hit").drop("_hit")


def severity_totals(log: DataFrame) -> DataFrame:
    return log.where("NOT is_session_start").groupBy("severity").agg(F.count(F.lit(1)).alias("messages"))


def stream_templates(log: DataFrame, window: str, watermark: str) -> DataFrame:
    """Template counts per tumbling window of a log stream."""
    return log.withWatermark("ts", watermark).groupBy(
        F.window("ts", window), "severity", message_template("message").alias("template")).agg(
        F.count(F.lit(1)).alias("repeats")).select(
        F.col("window.start").alias("window_start"), "severity", "template", "repeats")


def gap_sessions(log: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """Sessions of a user's log rows separated by silence of at least ``gap``.

    Stored logs are cut by a segmented scan, so a user with a third of all rows is spread over tasks;
    streams keep a window per open session as state.
    """
    if not log.isStreaming:
        length = log.sparkSession.range(1).select(F.expr(f"unix_micros(timestamp '1970-01-01' + interval {gap}) - unix_micros(timestamp '1970-01-01')")).first()[0]
        rows = log.select("user_id", F.unix_micros("ts").alias("at")).where("at IS NOT NULL")
        none = F.coalesce(F.col("user_id").cast("string"), F.lit("")), F.col("user_id").isNull()
        keyed = rows.withColumn("_user", F.concat_ws(":", none[1].cast("string"), none[0])).withColumn("_id", F.monotonically_increasing_id())
        seen = cut_lineage(previous(keyed, ["_user"], [F.col("at"), F.col("_id")], "at", "before"), "sessions")
        starts = F.when(F.col("before").isNull() | (F.col("at") - F.col("before") >= length), 1).otherwise(0)
        numbered = running_sum(seen, ["_user"], [F.col("at"), F.col("_id")], starts, "session")
        return numbered.groupBy("_user", "session").agg(F.first("user_id").alias("user_id"), F.min("at").alias("start"), F.count(F.lit(1)).alias("messages")) \
            .select("user_id", F.timestamp_micros("start").alias("session_start"), "messages")
    src = log.withWatermark("ts", watermark) if watermark else log
    return src.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("messages")).select(
        "user_id", F.col("session_window.start").alias("session_start"), "messages")
