"""Metrics of the score order: ROC, AUC, average precision, Youden, F1 sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridect.functions.numeric import grid_passed, grid_value, safe_ratio
from veridect.operators.evaluation import prf_columns
from veridect.operators.ordered import join_on, totals_of_counts


def score_ladder(df: DataFrame, groups: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Distinct scores from high to low with cumulative true and false positives.

    At a row, ``cum_tp`` and ``cum_fp`` are the counts when everything scored
    at or above ``p`` is called fake.
    """
    ties = (
        df.filter(F.col(p).isNotNull())
        .groupBy(*groups, p)
        .agg(F.count_if(F.col(y) == 1).alias("tp"), F.count_if(F.col(y) != 1).alias("fp"))
        .withColumn("_down", -F.col(p))
    )
    return totals_of_counts(ties, groups, ["_down"], ["tp", "fp"]).drop("_down")


def roc_curve(df: DataFrame, groups: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """(fpr, tpr, threshold) per distinct score, starting at (0, 0, infinity)."""
    ladder = score_ladder(df, groups, y, p)
    points = ladder.select(
        *groups,
        safe_ratio(F.col("cum_fp"), F.col("tot_fp"), None).alias("fpr"),
        safe_ratio(F.col("cum_tp"), F.col("tot_tp"), None).alias("tpr"),
        F.col(p).cast("double").alias("threshold"),
    )
    frame = df.filter(F.col(p).isNotNull()).select(*groups).distinct() if groups else df.sparkSession.range(1)
    start = frame.select(
        *groups, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    return points.unionByName(start)


def area_sum() -> Column:
    """Pairs of a fake above another over a ladder, ties counted half."""
    return F.sum(F.col("fp") * (F.col("cum_tp").cast("double") - F.col("tp") / F.lit(2.0)))


def auc_column(empty: float | None = None) -> Column:
    """Area under the ROC curve over a ladder; ``empty`` stands for one class."""
    value = area_sum() / F.nullif(F.max(F.col("tot_tp").cast("double") * F.col("tot_fp")), F.lit(0.0))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def ap_column() -> Column:
    gain = F.col("tp") / F.nullif(F.col("tot_tp"), F.lit(0)) * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    return F.coalesce(F.sum(gain), F.lit(0.0))


def roc_auc(df: DataFrame, groups: Sequence[str] = (), y: str = "y", p: str = "p", empty: float | None = None) -> DataFrame:
    return score_ladder(df, groups, y, p).groupBy(*groups).agg(auc_column(empty).alias("roc_auc"))


def average_precision(df: DataFrame, groups: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    return score_ladder(df, groups, y, p).groupBy(*groups).agg(ap_column().alias("avg_precision"))


def youden(df: DataFrame, groups: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Threshold of the largest tpr - fpr, the highest one on ties."""
    curve = roc_curve(df, groups, y, p).withColumn("j", F.col("tpr") - F.col("fpr"))
    best = F.max_by(F.struct("threshold", "tpr", "fpr", "j"), F.struct("j", "threshold"))
    return curve.groupBy(*groups).agg(best.alias("_b")).select(*groups, "_b.threshold", "_b.tpr", "_b.fpr", "_b.j")


def threshold_sweep(
    df: DataFrame, groups: Sequence[str] = (), y: str = "y", p: str = "p", count: int = 99
) -> DataFrame:
    """Counts and metrics at every grid threshold.

    Rows fall into ``count + 1`` cells by the number of thresholds at or below
    the score; the rest works on those cells, so the grid never meets the rows.
    """
    groups = list(groups)
    cells = (
        df.filter(F.col(p).isNotNull())
        .groupBy(*groups, grid_passed(F.col(p), count).alias("cell"))
        .agg(F.count_if(F.col(y) == 1).alias("_tp"), F.count_if(F.col(y) != 1).alias("_fp"))
    )
    return sweep_cells(cells, groups, count)


def sweep_cells(cells: DataFrame, groups: Sequence[str] = (), count: int = 99) -> DataFrame:
    """The sweep over (groups..., cell, _tp, _fp), a row per cell that has rows."""
    groups = list(groups)
    frame = cells.select(*groups).distinct() if groups else cells.agg(F.count(F.lit(1)).alias("_c")).select()
    grid = frame.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(count))))
    filled = join_on(grid, cells, [*groups, "cell"], "left").fillna(0, ["_tp", "_fp"])
    keys = groups or [F.lit(0)]
    above = Window.partitionBy(*keys).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    counted = filled.withColumns(
        {
            "tp": F.sum("_tp").over(above),
            "fp": F.sum("_fp").over(above),
            "_p": F.sum("_tp").over(whole),
            "_n": F.sum("_fp").over(whole),
        }
    ).filter(F.col("cell") > 0)
    return (
        counted.withColumns(
            {
                "step": F.col("cell") - 1,
                "threshold": grid_value(F.col("cell") - 1),
                "tn": F.col("_n") - F.col("fp"),
                "fn": F.col("_p") - F.col("tp"),
            }
        )
        .withColumns(prf_columns())
        .select(*groups, "step", "threshold", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1")
    )


def best_f1(df: DataFrame, groups: Sequence[str] = (), y: str = "y", p: str = "p", count: int = 99) -> DataFrame:
    """The first grid threshold that reaches the largest F1."""
    return best_of_sweep(threshold_sweep(df, groups, y, p, count), groups)


def best_of_sweep(sweep: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("step")))
    return sweep.groupBy(*groups).agg(best.alias("_b")).select(*groups, "_b.threshold", "_b.f1")


def by_generator(df: DataFrame, group: str, y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Rows, accuracy and AUC per generator from one score ladder."""
    ladder = score_ladder(df, [group], y, p)
    hit = F.col(p) >= F.lit(threshold)
    return ladder.groupBy(group).agg(
        F.sum(F.col("tp") + F.col("fp")).alias("n"),
        (F.sum(F.when(hit, F.col("tp")).otherwise(F.col("fp"))) / F.sum(F.col("tp") + F.col("fp"))).alias("accuracy"),
        auc_column().alias("roc_auc"),
    )
