"""Job progress: status per track, and how jobs end.

Every function takes a batch or a streaming DataFrame unless it says
otherwise; event time must be a TIMESTAMP.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The steps of each track, terminal steps and the idle limit.
TRACK_STEPS = {
    "frame": ("download", "downloaded", "frames", "frames_analyze", "frames_done", "frames_error"),
    "audio": ("audio", "audio_analyze", "audio_done", "audio_error"),
    "text": ("asr", "text_analyze", "text_done", "text_error"),
}
TERMINAL_STEPS = ("complete", "error")
IDLE_SECONDS = 300


def track_of(step: Column) -> Column:
    result = F.lit(None).cast("string")
    for name, steps in TRACK_STEPS.items():
        result = F.when(step.isin(*steps), name).otherwise(result)
    return result


def status_of(step: Column) -> Column:
    return F.when(step.endswith("_done"), "Done").when(step.endswith("_error"), "Error").otherwise("Running")


def progress_status(
    events: DataFrame,
    job: str = "job_id",
    step: str = "step",
    ts: str = "ts",
    tie: str = "event_id",
    delay: str | None = None,
    span: str = "1 day",
) -> DataFrame:
    """Latest status per job and track; run streams in update mode.

    With a ``delay`` the input is a stream with event-time windows of ``span``:
    state of a window goes when the watermark has passed it, and a job that
    lives longer has one row per window, of which the largest version counts
    (``jobs.run_update`` takes it).
    """
    tracked = events.withColumn("track", track_of(F.col(step))).filter(F.col("track").isNotNull())
    newest = F.struct(F.col(ts), F.col(tie))
    last = [F.max_by(status_of(F.col(step)), newest).alias("status"), F.max(newest).alias("version")]
    if delay is None:
        return tracked.groupBy(job, "track").agg(*last)
    grouped = tracked.withWatermark(ts, delay).groupBy(job, "track", F.window(ts, span).alias("_w"))
    return grouped.agg(*last).drop("_w")


def job_sessions(
    events: DataFrame, job: str = "job_id", step: str = "step", ts: str = "ts", idle_seconds: int = IDLE_SECONDS
) -> DataFrame:
    """How each run of a job ended: ``finished`` or, after idling, ``timed_out``.

    Batch form. Events less than the idle limit apart belong together, so all
    events of one slot of that length do; slots are aggregated before the
    window, which leaves one row per job and slot however busy a job is.
    """
    at = F.col(ts)
    slots = events.groupBy(job, F.floor(F.unix_micros(at) / F.lit(idle_seconds * 1_000_000)).alias("_slot")).agg(
        F.min(at).alias("_first"),
        F.max(at).alias("_last"),
        F.count(F.lit(1)).alias("_n"),
        F.max(F.col(step).isin(*TERMINAL_STEPS)).alias("_end"),
    )
    by_time = Window.partitionBy(job).orderBy("_slot")
    gap = F.unix_micros("_first") - F.unix_micros(F.lag("_last").over(by_time))
    opened = slots.withColumn("_new", F.when(gap < idle_seconds * 1_000_000, 0).otherwise(1))
    numbered = opened.withColumn("_run", F.sum("_new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy(job, "_run")
        .agg(
            F.min("_first").alias("started"),
            F.max("_last").alias("last_event"),
            F.sum("_n").alias("events"),
            F.max("_end").alias("finished"),
        )
        .withColumn("outcome", F.when(F.col("finished"), "finished").otherwise("timed_out"))
        .drop("_run", "finished")
    )


def job_sessions_stream(
    events: DataFrame,
    job: str = "job_id",
    step: str = "step",
    ts: str = "ts",
    idle_seconds: int = IDLE_SECONDS,
    delay: str = "10 minutes",
) -> DataFrame:
    """The same as a stream, in append mode: a run is emitted once the
    watermark has passed its idle limit, and its state is dropped."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(job, F.session_window(ts, f"{idle_seconds} seconds").alias("_w"))
        .agg(
            F.min(ts).alias("started"),
            F.max(ts).alias("last_event"),
            F.count(F.lit(1)).alias("events"),
            F.max(F.col(step).isin(*TERMINAL_STEPS)).alias("finished"),
        )
        .select(
            job,
            "started",
            "last_event",
            "events",
            F.when(F.col("finished"), "finished").otherwise("timed_out").alias("outcome"),
        )
    )
