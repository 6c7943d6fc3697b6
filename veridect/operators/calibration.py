"""Temperature scaling and the calibrated evaluation report."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from veridect.functions.decisions import calibrated
from veridect.functions.numeric import bce_with_logits, grid_passed, sigmoid, unit_bin
from veridect.operators.evaluation import prf_columns
from veridect.operators.ordered import totals_of_counts
from veridect.operators.ranked import ap_column, area_sum, best_of_sweep, sweep_cells
from veridect.operators.sampling import stratified_split
from veridect.session import cut_lineage

MIN_TEMPERATURE, MAX_TEMPERATURE = 1e-3, 100.0
#: Bins of the calibration error.
BINS = 10


@dataclass(frozen=True)
class TemperatureFit:
    temperature: float
    loss: float
    iterations: int


def fit_temperature(
    df: DataFrame, y: str = "y", z: str = "z", max_iter: int = 50, tol: float = 1e-10, cache: bool = True, weight: str | None = None
) -> TemperatureFit:
    """Temperature of the least mean cross-entropy of ``z / T``.

    The loss is convex in ``b = 1 / T``, so each step is Newton's inside a
    bracket that the gradient sign shrinks, or halves the bracket where Newton
    hardly lowers the gradient. A step is one aggregate of three means with no
    shuffle of rows; only those means reach the driver. ``cache`` keeps the two
    columns between steps, unless the caller cached the input already. ``weight``
    says how many rows a row stands for. Where the loss still falls
    at a limit of T, as for separable classes, that limit is the answer.
    """
    times = F.lit(1) if weight is None else F.col(weight)
    pairs = df.filter(F.col(z).isNotNull()).select(F.col(z).alias("z"), F.col(y).alias("y"), times.alias("w"))
    if cache:
        pairs = pairs.persist(StorageLevel.MEMORY_AND_DISK)
    low, high = 1.0 / MAX_TEMPERATURE, 1.0 / MIN_TEMPERATURE

    def loss_and_slopes(b: float) -> list[Column]:
        scaled, s = F.col("z") * F.lit(b), sigmoid(F.col("z") * F.lit(b))
        values = [
            bce_with_logits(scaled, F.col("y")),
            (s - F.col("y")) * F.col("z"),
            s * (F.lit(1.0) - s) * F.col("z") * F.col("z"),
        ]
        return [F.sum(v * F.col("w")) / F.sum("w") for v in values]

    try:
        ends = pairs.agg(*[c for b in (low, high) for c in loss_and_slopes(b)[:2]]).first()
        if ends[0] is None:
            raise ValueError("no rows to calibrate on")
        if ends[3] <= 0:
            return TemperatureFit(MIN_TEMPERATURE, ends[2], 1)
        if ends[1] >= 0:
            return TemperatureFit(MAX_TEMPERATURE, ends[0], 1)
        b, last = 1.0, float("inf")
        for step in range(1, max_iter + 1):
            loss, slope, curve = pairs.agg(*loss_and_slopes(b)).first()
            low, high = (low, b) if slope > 0 else (b, high)
            move = b - slope / curve if curve > 0 else 0.0
            if not low < move < high or abs(slope) > 0.5 * last:
                move = (low * high) ** 0.5
            if slope == 0 or abs(move - b) <= tol * b:
                break
            b, last = move, abs(slope)
        return TemperatureFit(1.0 / b, loss, step)
    finally:
        if cache:
            pairs.unpersist()


def temperature_losses(
    df: DataFrame, points: int = 200, low: float = 0.1, high: float = 10.0, y: str = "y", z: str = "z"
) -> DataFrame:
    """Mean loss at log-spaced temperatures.

    Each task folds its rows to one sum per temperature, so the grid is never
    crossed with the rows in a shuffle.
    """
    ratio = (high / low) ** (1.0 / (points - 1))
    grid = np.array([low * ratio**i for i in range(points)])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(points), 0
        for batch in batches:
            label = batch["y"].to_numpy(dtype=float)[:, None]
            for start in range(0, len(batch), 2_000):  # keeps the matrix small
                scaled = batch["z"].to_numpy(dtype=float)[start : start + 2_000, None] / grid
                losses = np.maximum(scaled, 0.0) - scaled * label[start : start + 2_000] + np.log1p(np.exp(-np.abs(scaled)))
                total += losses.sum(axis=0)
            rows += len(batch)
        yield pd.DataFrame({"step": np.arange(points, dtype="int32"), "temperature": grid, "loss": total, "rows": rows})

    partial = (
        df.filter(F.col(z).isNotNull())
        .select(F.col(z).alias("z"), F.col(y).alias("y"))
        .mapInPandas(fold, "step int, temperature double, loss double, rows bigint")
    )
    return partial.groupBy("step", "temperature").agg((F.sum("loss") / F.sum("rows")).alias("loss"))


def score_counts(df: DataFrame, groups: Sequence[str] = (), y: str = "y", z: str = "z") -> DataFrame:
    """Distinct logits with the fakes (``tp``) and others (``fp``) that have them; ``n`` also counts rows without a logit."""
    fake = F.col(y) == 1
    return df.groupBy(*groups, F.col(z).alias("z")).agg(
        F.count_if(fake).alias("tp"), F.count_if(~fake).alias("fp"), F.count(F.lit(1)).alias("n")
    )


def best_thresholds(counts: DataFrame, temperatures: Mapping[str, float], steps: int = 99) -> dict[str, float]:
    """The first grid threshold of the largest F1 at each temperature, from score counts, in one pass."""
    ways = F.array(
        *[
            F.struct(F.lit(name).alias("variant"), grid_passed(calibrated(F.col("z"), t), steps).alias("cell"))
            for name, t in temperatures.items()
        ]
    )
    cells = (
        counts.filter("z IS NOT NULL")
        .select(F.inline(ways), "tp", "fp")
        .groupBy("variant", "cell")
        .agg(F.sum("tp").alias("_tp"), F.sum("fp").alias("_fp"))
    )
    return {r.variant: r.threshold for r in best_of_sweep(sweep_cells(cells, ["variant"], steps), ["variant"]).collect()}


def metric_rows(counts: DataFrame, variants: Mapping[str, tuple[float, float]]) -> DataFrame:
    """All metrics of each named (temperature, threshold), a row per name.

    A temperature keeps the order of the logits, so one ladder of distinct
    logits gives the ranked metrics of all variants, and one pass over it their
    counts, Brier scores and bins.
    """
    ordered = counts.filter("z IS NOT NULL").select("z", "tp", "fp", (-F.col("z")).alias("_down"))
    ladder = totals_of_counts(ordered, [], ["_down"], ["tp", "fp"])
    temperatures = sorted({t for t, _ in variants.values()})
    ladder = ladder.withColumns({f"_p{j}": calibrated(F.col("z"), t) for j, t in enumerate(temperatures)})
    ladder = ladder.withColumns({f"_bin{j}": unit_bin(F.col(f"_p{j}"), BINS) for j in range(len(temperatures))})
    n = F.col("tp") + F.col("fp")
    sums = {"_area": area_sum(), "_ap": ap_column(), "_tp": F.sum("tp"), "_fp": F.sum("fp")}
    for j in range(len(temperatures)):
        p = F.col(f"_p{j}")
        sums[f"_brier{j}"] = F.sum(F.col("tp") * (p - 1.0) * (p - 1.0) + F.col("fp") * p * p)
        for b in range(BINS):
            sums[f"_gap{j}_{b}"] = F.coalesce(F.sum(F.when(F.col(f"_bin{j}") == b, F.col("tp") - n * p)), F.lit(0.0))
    for i, (t, threshold) in enumerate(variants.values()):
        hit = F.col(f"_p{temperatures.index(t)}") >= F.lit(threshold)
        sums[f"_tp_at{i}"] = F.coalesce(F.sum(F.when(hit, F.col("tp"))), F.lit(0))
        sums[f"_fp_at{i}"] = F.coalesce(F.sum(F.when(hit, F.col("fp"))), F.lit(0))
    total = ladder.agg(*[c.alias(k) for k, c in sums.items()])
    rows = []
    for i, (name, (t, threshold)) in enumerate(variants.items()):
        j = temperatures.index(t)
        gaps = [F.abs(F.col(f"_gap{j}_{b}")) for b in range(BINS)]
        rows.append(
            F.struct(
                F.lit(name).alias("variant"),
                F.lit(float(threshold)).alias("threshold"),
                F.col(f"_tp_at{i}").alias("tp"),
                F.col(f"_fp_at{i}").alias("fp"),
                (F.col("_fp") - F.col(f"_fp_at{i}")).alias("tn"),
                (F.col("_tp") - F.col(f"_tp_at{i}")).alias("fn"),
                F.col("_area").alias("_area"),
                F.col("_ap").alias("_ap"),
                F.col(f"_brier{j}").alias("_brier"),
                sum(gaps[1:], gaps[0]).alias("_gap"),
            )
        )
    all_rows = F.nullif((F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).cast("double"), F.lit(0.0))
    positives = (F.col("tp") + F.col("fn")).cast("double")
    negatives = (F.col("fp") + F.col("tn")).cast("double")
    return (
        total.select(F.inline(F.array(*rows)))
        .withColumns(prf_columns())
        .select(
            "variant",
            "accuracy",
            "precision",
            "recall",
            "f1",
            (F.col("_area") / F.nullif(positives * negatives, F.lit(0.0))).alias("roc_auc"),
            F.col("_ap").alias("avg_precision"),
            (F.col("_brier") / all_rows).alias("brier"),
            (F.col("_gap") / all_rows).alias("ece10"),
            "threshold",
        )
    )


@dataclass(frozen=True)
class CalibrationReport:
    metrics: DataFrame | None
    fit: TemperatureFit
    threshold_raw: float
    threshold_calibrated: float
    val_ratio: float
    seed: int
    #: rows of each half, those without a logit included
    n_val: int = 0
    n_test: int = 0


def calibration_report(
    df: DataFrame, id_col: str = "id", y: str = "y", z: str = "z", val_ratio: float = 0.2, seed: int = 42, test_metrics: bool = True
) -> CalibrationReport:
    """Temperature and thresholds fitted on validation, reported on test if asked for.

    After the split only counts of distinct logits are left; they are written
    once, and the fit, both thresholds and all metrics read them.
    """
    halves = stratified_split(df.select(id_col, y, z), y, id_col, val_ratio, seed)
    counts = cut_lineage(score_counts(halves, ["split"], y, z))
    val, test = counts.filter("split = 'val'"), counts.filter("split = 'test'")
    sizes = {r.split: r.rows for r in counts.groupBy("split").agg(F.sum("n").alias("rows")).collect()}
    both = F.array(F.struct(F.lit(1).alias("y"), F.col("tp").alias("w")), F.struct(F.lit(0).alias("y"), F.col("fp").alias("w")))
    fit = fit_temperature(val.select("z", F.inline(both)).filter("w > 0"), cache=False, weight="w")
    best = best_thresholds(val, {"raw": 1.0, "calibrated": fit.temperature})
    metrics = None
    if test_metrics:
        variants = {
            "baseline_t05": (1.0, 0.5),
            "threshold_only": (1.0, best["raw"]),
            "threshold_plus_calibration": (fit.temperature, best["calibrated"]),
        }
        metrics = metric_rows(test, variants)
    return CalibrationReport(metrics, fit, best["raw"], best["calibrated"], val_ratio, seed, sizes.get("val", 0), sizes.get("test", 0))
