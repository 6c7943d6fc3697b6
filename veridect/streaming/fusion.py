"""Modality results that arrive one by one, fused per video as soon as all are in."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridect.operators.fusion import MODALITY_ERRORS, MODALITY_WEIGHTS, fuse_weighted

MODALITIES = tuple(MODALITY_WEIGHTS)
GAVE_UP = "No result in time"
_SCORES = ", ".join(f"{m} double, {m}_error string" for m in MODALITIES)
_STATE = "opened long, last long, results long, closed boolean, no_audio boolean, " + ", ".join(
    f"{m}_at long, {m} double, {m}_error string" for m in MODALITIES
)


@dataclass
class VideoRun:
    """What has come for a video since it was last silent for the whole timeout."""

    opened: int
    last: int
    results: int = 0
    closed: bool = False
    no_audio: bool = False
    latest: dict[str, tuple[int, float | None, str | None]] = field(default_factory=dict)

    @classmethod
    def of(cls, state: tuple) -> VideoRun:
        opened, last, results, closed, no_audio, *rest = state
        held = {m: tuple(rest[3 * i : 3 * i + 3]) for i, m in enumerate(MODALITIES)}
        return cls(opened, last, results, closed, no_audio, {m: v for m, v in held.items() if v[0] is not None})

    def state(self) -> tuple:
        values = [v for m in MODALITIES for v in self.latest.get(m, (None, None, None))]
        return (self.opened, self.last, self.results, self.closed, self.no_audio, *values)

    def take(self, at: int, modality: str, score: float | None, error: str | None) -> None:
        """The latest result of a modality counts; at one instant a score goes before an error, a higher one before a lower."""
        rank = lambda v: (v[0], v[1] is not None, v[1] or 0.0, v[2] or "")
        new = (at, score, None if score is not None else error)
        self.results += 1
        self.no_audio |= modality == "audio" and score is None
        if modality not in self.latest or rank(new) > rank(self.latest[modality]):
            self.latest[modality] = new

    @property
    def complete(self) -> bool:
        """All modalities have a score or an error; without audio there is no text to wait for."""
        return all(m in self.latest or m == "text" and self.no_audio for m in MODALITIES)

    def verdict(self, reason: str) -> tuple:
        out: list[Any] = [self.opened, self.results, reason]
        for m in MODALITIES:
            missing = MODALITY_ERRORS["audio"] if m == "text" and self.no_audio else GAVE_UP
            _, score, error = self.latest.get(m, (None, None, missing))
            out += [score, error]
        return tuple(out)


def _reports(results: DataFrame, video: str) -> DataFrame:
    """video, modality, score, error, ts and the instant in microseconds; a row without a score is an error."""
    given = F.col("error") if "error" in results.columns else F.lit(None).cast("string")
    score = F.nullif(F.col("score").cast("double"), F.lit(float("nan")))
    reasons = F.create_map(*[F.lit(x) for pair in MODALITY_ERRORS.items() for x in pair])
    error = F.when(score.isNull(), F.coalesce(given, reasons[F.col("modality")]))
    return results.select(
        video, "modality", score.alias("score"), error.alias("error"), "ts", F.unix_micros("ts").alias("at")
    ).filter(F.col("modality").isin(*MODALITIES) & F.col("ts").isNotNull())


def _stream(reports: DataFrame, video: str, timeout: int) -> DataFrame:
    def step(key: tuple, chunks: Iterator[Any], state: Any) -> Iterator[Any]:
        import pandas as pd

        run = VideoRun.of(state.get) if state.exists else None
        out: list[tuple] = []
        if state.hasTimedOut:
            if run is not None and not run.closed:
                out.append(run.verdict("timeout"))
            state.remove()
        else:
            rows = sorted((r for c in chunks for r in zip(c["at"], c["modality"], c["score"], c["error"], strict=True)), key=lambda r: r[0])
            for i, (at, modality, score, error) in enumerate(rows):
                if run is not None and at - run.last >= timeout:
                    if not run.closed:
                        out.append(run.verdict("timeout"))
                    run = None
                run = run or VideoRun(int(at), int(at))
                run.opened, run.last = min(run.opened, int(at)), max(run.last, int(at))
                if run.closed:
                    continue
                run.take(int(at), modality, None if pd.isna(score) else float(score), None if pd.isna(error) else error)
                # what comes at one instant comes together
                if run.complete and (i + 1 == len(rows) or rows[i + 1][0] > at):
                    out.append(run.verdict("complete"))
                    run.closed = True
            if run is not None:
                silent = -(-(run.last + timeout) // 1000)
                if silent > state.getCurrentWatermarkMs():
                    state.update(run.state())
                    state.setTimeoutTimestamp(silent)
                else:
                    if not run.closed:
                        out.append(run.verdict("timeout"))
                    if state.exists:
                        state.remove()
        names = ["opened", "results", "reason", *[c for m in MODALITIES for c in (m, f"{m}_error")]]
        frame = pd.DataFrame(out, columns=names)
        frame.insert(0, video, [key[0]] * len(out))
        yield frame

    kind = reports.schema[video].dataType.simpleString()
    return reports.groupBy(video).applyInPandasWithState(
        step, f"{video} {kind}, opened long, results long, reason string, {_SCORES}", _STATE, "append", "EventTimeTimeout"
    )


def _batch(reports: DataFrame, video: str, timeout: int) -> DataFrame:
    by_video = Window.partitionBy(video)
    gap = F.col("at") - F.lag("at").over(by_video.orderBy("at"))
    runs = reports.withColumn("_opens", F.when(gap < timeout, 0).otherwise(1)).withColumn(
        "_run", F.sum("_opens").over(by_video.orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    )
    run = Window.partitionBy(video, "_run")

    def first(condition: Any) -> Any:
        return F.min(F.when(condition, F.col("at"))).over(run)

    no_audio = (F.col("modality") == "audio") & F.col("score").isNull()
    marked = runs.withColumns(
        {
            "_opened": F.min("at").over(run),
            "_image": first(F.col("modality") == "image"),
            "_audio": first(F.col("modality") == "audio"),
            "_text": first((F.col("modality") == "text") | no_audio),
        }
    )
    # NULL unless every modality is in at some time
    done = F.when(F.col("_image").isNotNull() & F.col("_audio").isNotNull() & F.col("_text").isNotNull(), F.greatest("_image", "_audio", "_text"))
    counted = marked.withColumn("_done", done).filter("_done IS NULL OR at <= _done")
    latest = F.struct("at", F.col("score").isNotNull().alias("scored"), "score", "error")
    seen = counted.groupBy(video, "_run").agg(
        F.min("_opened").alias("opened"),
        F.count(F.lit(1)).alias("results"),
        F.when(F.max("_done").isNull(), "timeout").otherwise("complete").alias("reason"),
        F.bool_or(no_audio).alias("_no_audio"),
        *[F.max(F.when(F.col("modality") == m, latest)).alias(f"_{m}") for m in MODALITIES],
    )
    missing = {m: F.lit(GAVE_UP) for m in MODALITIES}
    missing["text"] = F.when(F.col("_no_audio"), MODALITY_ERRORS["audio"]).otherwise(GAVE_UP)
    scores = [
        c
        for m in MODALITIES
        for c in (
            F.col(f"_{m}.score").alias(m),
            F.when(F.col(f"_{m}").isNull(), missing[m]).otherwise(F.col(f"_{m}.error")).alias(f"{m}_error"),
        )
    ]
    return seen.select(video, "opened", "results", "reason", *scores)


def fuse_results(
    results: DataFrame, video: str = "video_id", timeout_seconds: int = 300, delay: str | None = None
) -> DataFrame:
    """One verdict per run of a video, from rows of (video, modality, score, ts) and, if there is one, ``error``.

    Results of a video are one run until none has come for ``timeout_seconds``.
    A row without a score is a failed modality. The verdict leaves when all
    modalities have a score or an error (``reason`` complete), or else when the
    timeout has passed; the latest result of each modality up to then counts,
    and what comes later in the run is a repetition that changes nothing. Where
    audio failed no text is waited for. ``<modality>_error`` says why a score is
    missing. Rows of other modalities and rows without a time are left out.

    With a ``delay`` the input is a stream: run it in append mode. The state of
    a video is one row with an event-time timer, so a complete video leaves in
    the micro-batch that completes it; a task holds a video's results of one
    micro-batch. Rows behind the watermark are dropped and counted (see
    ``jobs.Run``); one that is older than what came before it still joins the
    open run. Without a ``delay`` it is the batch twin, by window functions.
    """
    reports = _reports(results if delay is None else results.withWatermark("ts", delay), video)
    runs = (_batch if delay is None else _stream)(reports, video, timeout_seconds * 1_000_000)
    return fuse_weighted(runs.withColumn("opened", F.timestamp_micros("opened")))
