"""Frames to video score, modalities to verdict."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridect.functions.numeric import round_half_up
from veridect.functions.text import trim_space
from veridect.operators.ordered import row_positions

# Frame limit, modality weights, confidence gate, verdict labels.
MAX_FRAMES = 10
MODALITY_WEIGHTS = {"image": 0.5, "audio": 0.3, "text": 0.2}
MODALITY_ERRORS = {
    "image": "No frames extracted",
    "audio": "Audio extraction failed",
    "text": "No speech detected in audio",
}
CONFIDENCE_GATE, GATED_OUT_SCORE = 0.8, 0.5
FUSED_FAKE, FUSED_REAL, FUSED_UNKNOWN = "FAKE / AI-GENERATED", "REAL / HUMAN", "UNKNOWN"


def first_frames(frames: DataFrame, video: str, order: Sequence[str], limit: int = MAX_FRAMES) -> DataFrame:
    """The first frames of each video, numbered from 1.

    Spark keeps only ``limit`` rows per video and task before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(video).orderBy(*order))
    return frames.withColumn("frame", place).filter(F.col("frame") <= limit)


def frames_mean(frames: DataFrame, video: str, order: Sequence[str], p: str = "p", limit: int = MAX_FRAMES) -> DataFrame:
    """Mean of the rounded probabilities of the first frames.

    The rounded probabilities have four decimals; summing them as decimals
    makes the mean independent of the order of summation.
    """
    rounded = first_frames(frames, video, order, limit).withColumn("_p4", round_half_up(F.col(p), 4))
    per_frame = F.struct(
        F.col("frame"),
        F.when(F.col(p) > F.lit(0.5), "FAKE").otherwise("REAL").alias("label"),
        F.col("_p4").alias("fake_prob"),
        round_half_up(F.lit(1.0) - F.col(p), 4).alias("real_prob"),
        round_half_up(F.greatest(F.col(p), F.lit(1.0) - F.col(p)), 4).alias("confidence"),
    )
    return (
        rounded.groupBy(video)
        .agg(
            (F.sum(F.col("_p4").cast("decimal(5,4)")).cast("double") / F.count(F.lit(1))).alias("_mean"),
            F.count(F.lit(1)).alias("frames_analyzed"),
            F.array_sort(F.collect_list(per_frame)).alias("per_frame"),
        )
        .select(
            video,
            F.when(F.col("_mean") > F.lit(0.5), "FAKE").otherwise("REAL").alias("label"),
            round_half_up(F.col("_mean"), 4).alias("fake_prob"),
            "frames_analyzed",
            "per_frame",
        )
    )


def frames_max(frames: DataFrame, video: str, p: str = "p") -> DataFrame:
    return frames.groupBy(video).agg(F.max(p).alias("fake_prob"))


def frames_sliding(
    frames: DataFrame, video: str, order: Sequence[str], width: int = 3, p: str = "p", block: int = 10_000
) -> DataFrame:
    """Largest mean of ``width`` consecutive frames; shorter videos use their mean.

    Videos are cut into blocks of consecutive frames. The last ``width - 1``
    frames of a block are copied to the next one, so every window is complete
    inside one block and a very long video spreads over many tasks.
    """
    if not 1 <= width <= block + 1:
        raise ValueError("width must be at least 1 and at most block + 1, or windows would span three blocks")
    placed = row_positions(frames.select(video, *order, p), order, [video], "_place")
    home = F.expr(f"div(_place - 1, {block})")
    spill = (F.col("_place") - 1) % block >= block - (width - 1)
    copies = placed.withColumn(
        "_block", F.explode(F.when(spill, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    window = Window.partitionBy(video, "_block").orderBy("_place").rowsBetween(-(width - 1), 0)
    moved = copies.withColumns(
        {
            "_avg": F.avg(p).over(window),
            "_full": (F.count(F.lit(1)).over(window) == width) & (F.col("_block") == home),
        }
    )
    own = F.col("_block") == home
    return moved.groupBy(video).agg(
        F.coalesce(
            F.max(F.when(F.col("_full"), F.col("_avg"))),
            F.avg(F.when(own, F.col(p))),
        ).alias("fake_prob")
    )


def gate_text(df: DataFrame, audio: str = "audio", text: str = "text", transcript: str | None = None) -> DataFrame:
    """Text counts only where audio worked and the transcript is not blank."""
    audio_missing = F.col(audio).isNull()
    blank = (F.coalesce(trim_space(F.col(transcript)), F.lit("")) == "") if transcript else F.col(text).isNull()
    return df.withColumn(
        "text_error",
        F.when(audio_missing, MODALITY_ERRORS["audio"]).when(blank, MODALITY_ERRORS["text"]),
    ).withColumn(text, F.when(F.col("text_error").isNull(), F.col(text)))


def weighted_score(weights: Mapping[str, float] = MODALITY_WEIGHTS) -> Column:
    """Weighted mean over the modalities that are present; NULL if none is."""
    total = F.lit(0.0)
    mass = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(F.col(name) * F.lit(weight), F.lit(0.0))
        mass = mass + F.when(F.col(name).isNotNull(), F.lit(weight)).otherwise(F.lit(0.0))
    return total / F.nullif(mass, F.lit(0.0))


def fuse_weighted(df: DataFrame, weights: Mapping[str, float] = MODALITY_WEIGHTS) -> DataFrame:
    """Adds the verdict and the rounded fused score."""
    fused = df.withColumn("_fused", weighted_score(weights))
    label = (
        F.when(F.col("_fused").isNull(), FUSED_UNKNOWN)
        .when(F.col("_fused") > F.lit(0.5), FUSED_FAKE)
        .otherwise(FUSED_REAL)
    )
    return fused.withColumns({"final_label": label, "fused_score": round_half_up(F.col("_fused"), 4)}).drop("_fused")


def nested_modalities(df: DataFrame, errors: Mapping[str, str] = MODALITY_ERRORS) -> DataFrame:
    """Adds ``modalities``: per modality its score, or why there is none.

    A column ``<modality>_error`` takes precedence over the general reason.
    """
    parts = []
    for name, reason in errors.items():
        known = F.col(f"{name}_error") if f"{name}_error" in df.columns else F.lit(None).cast("string")
        error = F.when(F.col(name).isNull(), F.coalesce(known, F.lit(reason)))
        parts.append(F.struct(F.col(name).alias("score"), error.alias("error")).alias(name))
    return df.withColumn("modalities", F.struct(*parts))


def join_modalities(videos: DataFrame, video: str, modalities: Mapping[str, DataFrame]) -> DataFrame:
    """One row per video with a score column per modality; absent ones are NULL.

    Each modality table holds (video, score), one row per video, so all joins
    share one key and none is skewed.
    """
    joined = videos
    for name, scores in modalities.items():
        joined = joined.join(scores.select(video, F.col("score").alias(name)), video, "left")
    return joined


def rule_fusion(columns: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Fixed weights that sum to 1, equal by default; NULL if a score is missing."""
    weights = weights or [1.0 / len(columns)] * len(columns)
    if abs(sum(weights) - 1.0) > 1e-9:
        raise ValueError("weights must sum to 1")
    total = F.lit(0.0)
    for name, weight in zip(columns, weights):
        total = total + F.col(name) * F.lit(weight)
    return total


def max_fusion(columns: Sequence[str]) -> Column:
    return F.greatest(*[F.col(c) for c in columns])


def gated_fusion(
    scores: Sequence[str], confidences: Sequence[str], gate: float = CONFIDENCE_GATE, fallback: float = GATED_OUT_SCORE
) -> Column:
    """Mean of the scores whose confidence is strictly above the gate."""
    total, kept = F.lit(0.0), F.lit(0)
    for score, conf in zip(scores, confidences):
        take = (F.col(conf) > F.lit(gate)) & F.col(score).isNotNull()
        total = total + F.when(take, F.col(score)).otherwise(F.lit(0.0))
        kept = kept + F.when(take, 1).otherwise(0)
    return F.coalesce(total / F.nullif(kept.cast("double"), F.lit(0.0)), F.lit(fallback))
