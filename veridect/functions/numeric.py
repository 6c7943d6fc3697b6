"""Rounding, clamping, grids and pointwise losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    """Half-up rounding in the scaled domain, the same in every IEEE engine."""
    scale = F.lit(float(10**digits))
    return F.floor(F.nullif(x, F.lit(float("nan"))) * scale + F.lit(0.5)) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def safe_ratio(numerator: Column, denominator: Column, empty: float | None = 0.0) -> Column:
    """``numerator / denominator`` with ``empty`` in place of a zero division."""
    ratio = numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
    return ratio if empty is None else F.coalesce(ratio, F.lit(empty))


def unit_bin(p: Column, bins: int) -> Column:
    """Index of ``p`` among ``bins`` equal bins of [0, 1], the last one closed.

    Edges are ``i * (1 / bins)`` in double arithmetic, so 0.3 lies in bin 2 of
    10 (the edge is 0.30000000000000004). ``floor`` only guesses the bin; the
    comparison with the edges decides. NULL outside [0, 1].
    """
    step = F.lit(1.0 / bins)
    guess = F.least(F.greatest(F.floor(p * F.lit(float(bins))), F.lit(0)), F.lit(bins - 1)).cast("int")
    index = (
        guess
        - F.when(p < guess.cast("double") * step, 1).otherwise(0)
        + F.when((guess < bins - 1) & (p >= (guess + 1).cast("double") * step), 1).otherwise(0)
    )
    return F.when((p >= 0.0) & (p <= 1.0), index)


def grid_value(index: Column, start: float = 0.01, step: float = 0.01) -> Column:
    return F.lit(start) + index.cast("double") * F.lit(step)


def grid_passed(p: Column, count: int = 99, start: float = 0.01, step: float = 0.01) -> Column:
    """How many of the thresholds ``start + i * step`` are at or below ``p``."""
    guess = F.least(F.greatest(F.floor((p - F.lit(start)) / F.lit(step)) + 1, F.lit(0)), F.lit(count)).cast("int")
    return (
        guess
        - F.when((guess > 0) & (p < grid_value(guess - 1, start, step)), 1).otherwise(0)
        + F.when((guess < count) & (p >= grid_value(guess, start, step)), 1).otherwise(0)
    )


def bce_with_logits(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def smooth_label(y: Column, smoothing: float) -> Column:
    return y * F.lit(1.0 - smoothing) + F.lit(0.5 * smoothing)


def focal_with_logits(z: Column, y: Column, alpha: float, gamma: float, smoothing: float = 0.0) -> Column:
    """Sigmoid focal loss; a negative ``alpha`` switches the class weight off."""
    target = smooth_label(y, smoothing)
    p = sigmoid(z)
    p_t = p * target + (F.lit(1.0) - p) * (F.lit(1.0) - target)
    loss = bce_with_logits(z, target) * F.pow(F.lit(1.0) - p_t, F.lit(gamma))
    if alpha >= 0:
        loss = loss * (F.lit(alpha) * target + F.lit(1.0 - alpha) * (F.lit(1.0) - target))
    return loss
