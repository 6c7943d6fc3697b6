"""Feature arrays with higher-order functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Channel statistics of the image normaliser.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)
DB_FLOOR, DB_RANGE = 1e-10, 80.0


def fix_length(a: Column, length: int) -> Column:
    """Cut to ``length`` or pad with zeros on the right."""
    missing = F.greatest(F.lit(length) - F.size(a), F.lit(0))
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), missing)), 1, length)


def with_constant(a: Column, constant: Column, function: Callable[[Column, Column], Column]) -> Column:
    """``function(element, constant)`` over ``a``.

    A row-level value captured by a lambda may be computed once per element;
    repeated as an array it is computed once per row.
    """
    return F.zip_with(a, F.array_repeat(constant, F.size(a)), function)


def power_to_db(a: Column, relative: bool = True, top_db: float | None = DB_RANGE) -> Column:
    """Power to decibels against the array maximum, or against 1 if not ``relative``."""

    def db(x: Column) -> Column:
        return F.lit(10.0) * F.log10(F.greatest(x, F.lit(DB_FLOOR)))

    top = db(F.array_max(a))
    if relative:
        levels = with_constant(a, top, lambda x, t: db(x) - t)
        return levels if top_db is None else F.transform(levels, lambda x: F.greatest(x, F.lit(-top_db)))
    if top_db is None:
        return F.transform(a, db)
    return with_constant(a, top, lambda x, t: F.greatest(db(x), t - F.lit(top_db)))


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))


def squared_deviations(a: Column, center: Column) -> Column:
    squares = with_constant(a, center, lambda x, m: (x - m) * (x - m))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def array_std(a: Column, ddof: int = 0, mean: Column | None = None) -> Column:
    center = array_mean(a) if mean is None else mean
    return F.sqrt(squared_deviations(a, center) / F.nullif(F.greatest(F.size(a) - ddof, F.lit(0)), F.lit(0)))


def standardized(a: Column, mean: Column, std: Column, epsilon: float) -> Column:
    scale = F.struct(mean.alias("mean"), std.alias("std"))
    return with_constant(a, scale, lambda x, s: (x - s["mean"]) / (s["std"] + F.lit(epsilon)))


def sample_standardize(a: Column, epsilon: float = 1e-8) -> Column:
    """Per-row standardisation with the sample deviation."""
    return standardized(a, array_mean(a), array_std(a, ddof=1), epsilon)


def channel_normalize(
    a: Column,
    method: str = "imagenet",
    mean: Sequence[float] = CHANNEL_MEAN,
    std: Sequence[float] = CHANNEL_STD,
) -> Column:
    """Interleaved pixels: ``imagenet`` scales and centres each channel,
    ``unit`` only divides by 255, ``raw_bgr`` keeps values in reversed channels."""
    if method == "unit":
        return F.transform(a, lambda x: x.cast("double") / F.lit(255.0))
    if method == "raw_bgr":
        return reverse_channels(a)
    if method != "imagenet":
        raise ValueError(f"unknown method {method!r}")
    means, stds = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    channels = len(mean)
    return F.transform(
        a,
        lambda x, i: (x.cast("double") / F.lit(255.0) - F.get(means, i % channels)) / F.get(stds, i % channels),
    )


def reverse_channels(a: Column, channels: int = 3) -> Column:
    """Each pixel's channels in reverse order, by sorting on (pixel, -channel)."""
    tagged = F.transform(
        a, lambda x, i: F.struct((i - i % channels).alias("pixel"), (-(i % channels)).alias("channel"), x.alias("x"))
    )
    return F.transform(F.array_sort(tagged), lambda t: t["x"])


def to_mono(channels: Column) -> Column:
    """Mean over an array of equally long channels."""
    first = F.transform(F.get(channels, F.lit(0)), lambda x: x.cast("double") * F.lit(0.0))
    total = F.aggregate(channels, first, lambda acc, c: F.zip_with(acc, c, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(channels))


def diagnostics(df: DataFrame, array: str) -> DataFrame:
    """Length, range, mean and population deviation of an array."""
    a = F.col(array)
    return df.withColumn("length", F.size(a)).withColumns(
        {"min_value": F.array_min(a), "max_value": F.array_max(a), "mean_value": array_mean(a)}
    ).withColumn("std_value", array_std(a, mean=F.col("mean_value")))


def dot(a: Column, weights: Sequence[float]) -> Column:
    """Native dot product of an array column with fixed weights."""
    products = F.zip_with(a, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
