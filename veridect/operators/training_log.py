"""Operators over epoch and batch logs (a row per run and epoch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridect.operators.ordered import running_totals

PRIMARY_METRICS = ("f1", "acc", "sens", "spec")


def running_mean(df: DataFrame, run: str, order: str, value: str, size: str) -> DataFrame:
    """Size-weighted mean of all values up to each batch of a run."""
    weighted = df.withColumns({"_vn": F.col(value) * F.col(size), "_n": F.col(size)})
    summed = running_totals(weighted, [run], [order], ["_vn", "_n"])
    return summed.withColumn("running_mean", F.col("cum__vn") / F.col("cum__n")).select(*df.columns, "running_mean")


def checkpoint_marks(
    df: DataFrame, metric: str, run: str = "run", epoch: str = "epoch", start: float = float("-inf")
) -> DataFrame:
    """Marks the epochs that beat everything before them strictly.

    ``start`` is the value to beat at first: minus infinity, or 0.0. A run has
    few epochs, so a window per run is small.
    """
    before = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.coalesce(F.max(metric).over(before), F.lit(start)), F.lit(start))
    return df.withColumn("best_before", best).withColumn("saved", F.col(metric) > F.col("best_before"))


def best_epoch(
    df: DataFrame, metric: str, run: str = "run", epoch: str = "epoch", start: float = float("-inf"), check: bool = True
) -> DataFrame:
    """Earliest epoch of the largest metric; no row if nothing beats ``start``."""
    if check and metric not in PRIMARY_METRICS:
        raise ValueError(f"metric must be one of {PRIMARY_METRICS}, not {metric!r}")
    row = F.max_by(F.struct(epoch, metric), F.struct(F.col(metric), -F.col(epoch)))
    return (
        df.filter(F.col(metric) > F.lit(start))
        .groupBy(run)
        .agg(row.alias("_b"))
        .select(run, F.col(f"_b.{epoch}").alias("best_epoch"), F.col(f"_b.{metric}").alias(f"best_{metric}"))
    )


def early_stop(
    df: DataFrame, metric: str, run: str = "run", epoch: str = "epoch", patience: int = 5
) -> DataFrame:
    """First epoch with ``patience`` epochs since the best, and the epoch restored.

    A run that never stalls that long ends at its last epoch. As in training,
    epochs after the stop do not count.
    """
    by_epoch = Window.partitionBy(run).orderBy(epoch)
    marked = checkpoint_marks(df, metric, run, epoch).withColumn("_place", F.row_number().over(by_epoch))
    upto = by_epoch.rowsBetween(Window.unboundedPreceding, 0)
    waited = marked.withColumns(
        {
            "_best_place": F.max(F.when(F.col("saved"), F.col("_place"))).over(upto),
            "_best_epoch": F.max(F.when(F.col("saved"), F.col(epoch))).over(upto),
        }
    ).withColumn("_stop", F.col("_place") - F.col("_best_place") >= patience)
    stop = F.min(F.when(F.col("_stop"), F.struct(F.col("_place"), F.col(epoch), F.col("_best_epoch"))))
    last = F.max(F.struct(F.col("_place"), F.col(epoch), F.col("_best_epoch")))
    return (
        waited.groupBy(run)
        .agg(stop.alias("_s"), last.alias("_l"))
        .select(
            run,
            F.coalesce(F.col(f"_s.{epoch}"), F.col(f"_l.{epoch}")).alias("stop_epoch"),
            F.coalesce(F.col("_s._best_epoch"), F.col("_l._best_epoch")).alias("restored_epoch"),
            F.col("_s").isNotNull().alias("stopped_early"),
        )
    )
