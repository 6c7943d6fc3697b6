"""Label encodings, split filters, score contracts and keyed joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = ("training", "validation", "testing")
DOMAIN_CODES = {"gan": 0, "diffusion": 1}


def fake_positive(label: Column) -> Column:
    """``fake``/``real`` text to 1/0: the polarity used everywhere inside."""
    text = F.lower(label)
    return F.when(text == "fake", 1).when(text == "real", 0)


def real_positive(label: Column) -> Column:
    """The opposite polarity some manifests carry; flip it at the edge."""
    return F.lit(1) - fake_positive(label)


def label_text(y: Column) -> Column:
    return F.when(y == 1, "FAKE").when(y == 0, "REAL")


def domain_code(domain: Column, codes: Mapping[str, int] = DOMAIN_CODES) -> Column:
    result = F.lit(None).cast("int")
    for name, code in codes.items():
        result = F.when(F.lower(domain) == name, code).otherwise(result)
    return result


def split_rows(df: DataFrame, split: str, column: str = "split") -> DataFrame:
    return df.filter(F.col(column) == split)


def target_counts(df: DataFrame, keys: Sequence[str] = ("split",), y: str = "y") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.count_if(F.col(y) == 0).alias("num_real"),
        F.count_if(F.col(y) == 1).alias("num_fake"),
    )


def pair_real_fake(real: DataFrame, fake: DataFrame, y: str = "y") -> DataFrame:
    return real.withColumn(y, F.lit(0)).unionByName(fake.withColumn(y, F.lit(1)))


def attach_predictions(manifest: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Source rows with their prediction, by row id and never by position."""
    return manifest.join(predictions, key, "inner")


def score_contract(
    df: DataFrame, modality: str, score: str, label: str, allowed: Sequence[str] = ("FAKE", "REAL")
) -> DataFrame:
    """Violations per modality and rule, in one pass and one row per rule."""
    p, name = F.col(score), F.col(label)
    rules = {
        "score_missing": p.isNull() | F.isnan(p),
        "score_out_of_range": (p < 0.0) | ((p > 1.0) & ~F.isnan(p)),
        "label_not_allowed": ~F.coalesce(name.isin(*allowed), F.lit(False)),
    }
    wide = df.groupBy(modality).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()]
    )
    return wide.unpivot([modality, "rows"], list(rules), "rule", "violations")


def log_probability_to_score(log_probability: Column) -> Column:
    """Brings a raw log-probability into [0, 1] before fusion."""
    return F.exp(F.least(log_probability, F.lit(0.0)))


def perplexity_to_score(perplexity: Column, midpoint: float) -> Column:
    """Low perplexity reads as machine text; ``midpoint`` maps to 0.5."""
    return F.lit(midpoint) / (F.lit(midpoint) + perplexity)


def class_distribution(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def split_summary(df: DataFrame, split: str, target: str, platform: str) -> DataFrame:
    """Rows by split, by split and target, by split and platform in one scan."""
    s, t, p = F.col(split), F.col(target), F.col(platform)
    return (
        df.groupingSets([[s], [s, t], [s, p]], s, t, p)
        .agg(F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("level"))
        .withColumn(
            "section", F.when(F.col("level") == 3, "split").when(F.col("level") == 1, "target").otherwise("platform")
        )
        .drop("level")
    )
