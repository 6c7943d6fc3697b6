"""Turning scores into labels, bands and confidences.

Thresholds are strict in some rules and inclusive in others; each function
says which.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridect.functions.numeric import round_half_up, sigmoid

# Labels and band edges of the decision rules.
FAKE, REAL, UNKNOWN = "FAKE", "REAL", "UNKNOWN"
HIGH_RISK, MEDIUM_RISK = 0.7, 0.4
BAND_REAL, BAND_AI = 30, 70


def complement(p: Column) -> Column:
    """Fake probability from a model that emits the real one, and back."""
    return F.lit(1.0) - p


def binary_label(p_fake: Column, threshold: float = 0.5) -> Column:
    """FAKE iff strictly above the threshold, on the unrounded score."""
    return F.when(p_fake > F.lit(threshold), FAKE).otherwise(REAL)


def is_correct(p_fake: Column, y: Column, threshold: float = 0.5) -> Column:
    return (y == 1) == (p_fake > F.lit(threshold))


def two_class_label(p_fake: Column, p_real: Column, tie: str = FAKE) -> Column:
    """Larger of two outputs. Equal outputs go to ``tie``."""
    wins = (p_fake >= p_real) if tie == FAKE else (p_fake > p_real)
    return F.when(wins, FAKE).otherwise(REAL)


def two_class_confidence(p_fake: Column, p_real: Column) -> Column:
    return F.greatest(p_fake, p_real)


def calibrated(z: Column, temperature: Column | float) -> Column:
    scale = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return sigmoid(z / scale)


def calibrated_label(p: Column, threshold: Column) -> Column:
    """AI-generated iff at or above the threshold."""
    return F.when(p >= threshold, "AI-generated").otherwise("Real")


def calibrated_confidence(p: Column, threshold: Column) -> Column:
    return F.when(p >= threshold, p).otherwise(F.lit(1.0) - p)


def risk_level(p_fake: Column) -> Column:
    """Both edges belong to the lower band."""
    return F.when(p_fake > F.lit(HIGH_RISK), "High").when(p_fake > F.lit(MEDIUM_RISK), "Medium").otherwise("Low")


def likelihood_band(p_fake: Column) -> Column:
    """Bands on the displayed percentage; both edges belong to the upper band."""
    shown = F.floor(p_fake * F.lit(100.0) + F.lit(0.5))
    return (
        F.when(shown < BAND_REAL, "likely real").when(shown < BAND_AI, "uncertain").otherwise("likely AI-generated")
    )


def item_result(p_fake: Column) -> Column:
    """Label on the exact score, probabilities rounded afterwards."""
    return F.struct(
        binary_label(p_fake).alias("label"),
        round_half_up(p_fake, 4).alias("fake_prob"),
        round_half_up(complement(p_fake), 4).alias("real_prob"),
        round_half_up(F.greatest(p_fake, complement(p_fake)), 4).alias("confidence"),
    )
