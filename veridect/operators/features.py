"""Feature operators that need statistics of other rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridect.functions.arrays import array_mean, squared_deviations, standardized
from veridect.operators.ordered import beside
from veridect.session import cut_lineage


def array_statistics(df: DataFrame, array: str) -> DataFrame:
    """Count, mean and population deviation of all elements of all arrays, in one row.

    Every row folds to its count, mean and sum of squared deviations, and rows
    of one length merge in Spark's own mergeable moments; lengths, of which there
    are few, merge by the same rule. Squares of the values themselves are never
    summed, so values far from zero keep their deviation.
    """
    center = df.select(F.size(array).alias("n"), F.col(array).alias("a"), array_mean(F.col(array)).alias("mean")).filter("n > 0")
    rows = center.select("n", "mean", squared_deviations(F.col("a"), F.col("mean")).alias("m2"))
    by_length = cut_lineage(
        rows.groupBy("n").agg(
            (F.col("n") * F.count(F.lit(1))).alias("count"),
            F.avg("mean").alias("mean"),
            (F.sum("m2") + F.col("n") * F.count(F.lit(1)) * F.var_pop("mean")).alias("m2"),
        )
    )
    whole = by_length.agg(F.sum("count").alias("count"), (F.sum(F.col("mean") * F.col("count")) / F.sum("count")).alias("_mean"))
    apart = F.col("mean") - F.col("_mean")
    merged = beside(by_length.withColumnRenamed("count", "_n"), whole)
    return merged.agg(
        F.max("count").alias("count"),
        F.max("_mean").alias("mean"),
        F.sqrt(F.sum(F.col("m2") + F.col("_n") * apart * apart) / F.max("count")).alias("std"),
    )


def global_standardize(train: DataFrame, apply_to: DataFrame, array: str, epsilon: float = 1e-6) -> DataFrame:
    """Mean and population deviation over all training elements, applied to any split."""
    stats = array_statistics(train, array).select(F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    return (
        beside(apply_to, stats)
        .withColumn(array, standardized(F.col(array), F.col("_mean"), F.col("_std"), epsilon))
        .drop("_mean", "_std")
    )
