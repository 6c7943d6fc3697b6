"""Evaluation aggregates over a scored relation.

``y = 1`` means fake and ``p`` is the probability of fake. Everything here is
a grouped aggregate with map-side combine, or works on counts of distinct
scores, which are stored once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridect.functions.numeric import (
    bce_with_logits,
    focal_with_logits,
    round_half_up,
    safe_ratio,
    smooth_label,
    unit_bin,
)
from veridect.operators.ordered import join_bounded, join_on, percentiles_of_counts, row_positions, value_counts
from veridect.session import cut_lineage

# Verdict texts and their bounds.
SEPARATION_GOOD, SEPARATION_LIMITED = 0.3, 0.1
GENERALIZES, PARTLY_GENERALIZES = 75.0, 60.0


def _rate(hits: Column, rows: Column) -> Column:
    return safe_ratio(hits, rows) * F.lit(100.0)


def _accuracy_sums(rows: Column, ok: Column, fake: Column) -> list[Column]:
    def total(value: Column, of: Column) -> Column:
        return F.coalesce(F.sum(F.when(of, value)), F.lit(0))

    every = F.lit(True)
    return [
        total(rows, every).alias("total"),
        total(ok, every).alias("correct_total"),
        total(rows, ~fake).alias("real_total"),
        total(ok, ~fake).alias("real_correct"),
        total(rows, fake).alias("fake_total"),
        total(ok, fake).alias("fake_correct"),
    ]


def _accuracy_rates() -> dict[str, Column]:
    return {
        "real_acc": _rate(F.col("real_correct"), F.col("real_total")),
        "fake_acc": _rate(F.col("fake_correct"), F.col("fake_total")),
        "overall_acc": _rate(F.col("correct_total"), F.col("total")),
    }


def accuracy(df: DataFrame, groups: Sequence[str] = (), y: str = "y", correct: str = "correct") -> DataFrame:
    """Per-class and overall accuracy in percent; an empty class gives 0."""
    ok = F.when(F.col(correct), 1).otherwise(0).cast("bigint")
    sums = _accuracy_sums(F.lit(1).cast("bigint"), ok, F.col(y) == 1)
    return df.groupBy(*groups).agg(*sums).withColumns(_accuracy_rates())


def describe(df: DataFrame, groups: Sequence[str], value: str = "p", digits: int = 4) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, rounded.

    All from the counts of distinct values. A group without any value has a
    count of 0 and nothing else.
    """
    groups, v = list(groups), F.col(value)
    counts = cut_lineage(df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n")))
    valued = counts.filter(v.isNotNull())
    carried = {"count": F.sum("n"), "mean": F.sum(v * F.col("n")) / F.sum("n"), "min": F.min(v), "max": F.max(v)}
    found = cut_lineage(percentiles_of_counts(valued, groups, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, carried))
    apart = v - F.col("mean")
    spread = (
        join_bounded(valued, found.select(*groups, "mean", "count"), groups, found.count())
        .groupBy(*groups)
        .agg(F.sqrt(F.sum(F.col("n") * apart * apart) / F.nullif(F.max("count") - 1, F.lit(0))).alias("std"))
    )
    every = counts.select(*groups).distinct() if groups else df.sparkSession.range(1).select()
    whole = join_on(join_on(every, found, groups, "left"), spread, groups, "left").fillna(0, ["count"])
    numbers = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    return whole.select(*groups, "count", *[round_half_up(F.col(c), digits).alias(c) for c in numbers])


def _class_stats(counts: DataFrame, groups: Sequence[str], y: str, p: str, empty: float | None) -> DataFrame:
    """Means and medians of both classes from counts (groups..., y, p, n)."""
    scored = counts.filter(F.col(p).isNotNull()).select(*groups, y, p, "n")
    mean = F.sum(F.col(p) * F.col("n")) / F.sum("n")
    per_class = percentiles_of_counts(scored, [*groups, y], p, {"_median": 0.5}, {"_mean": mean})

    def pick(column: str, label: int) -> Column:
        value = F.max(F.when(F.col(y) == label, F.col(column)))
        return value if empty is None else F.coalesce(value, F.lit(empty))

    return (
        per_class.groupBy(*groups)
        .agg(
            pick("_mean", 1).alias("fake_mean"),
            pick("_median", 1).alias("fake_median"),
            pick("_mean", 0).alias("real_mean"),
            pick("_median", 0).alias("real_median"),
        )
        .withColumn("separation", F.col("fake_mean") - F.col("real_mean"))
    )


def domain_stats(
    df: DataFrame, groups: Sequence[str], y: str = "y", p: str = "p", empty: float | None = 0.0
) -> DataFrame:
    """Mean and median score of both classes and their separation.

    ``empty`` is the value of an empty class: 0.0, or None for NULL.
    """
    return _class_stats(cut_lineage(value_counts(df, [*groups, y], p)), groups, y, p, empty)


def separation_verdict(separation: Column) -> Column:
    return (
        F.when(separation > F.lit(SEPARATION_GOOD), "good")
        .when(separation >= F.lit(SEPARATION_LIMITED), "limited")
        .when(separation >= F.lit(0.0), "insufficient")
        .otherwise("inverted")
    )


def generalization_verdict(overall_acc: Column) -> Column:
    return (
        F.when(overall_acc >= F.lit(GENERALIZES), "generalizes")
        .when(overall_acc >= F.lit(PARTLY_GENERALIZES), "limited")
        .otherwise("fails")
    )


def group_report(
    df: DataFrame, groups: Sequence[str], empty: float | None = 0.0, y: str = "y", p: str = "p", correct: str = "correct"
) -> DataFrame:
    """Accuracy and distribution statistics side by side, both from one stored count of (class, score)."""
    ok = F.count_if(F.col(correct)).alias("_ok")
    counts = cut_lineage(df.groupBy(*groups, y, p).agg(F.count(F.lit(1)).alias("n"), ok))
    rated = counts.groupBy(*groups).agg(*_accuracy_sums(F.col("n"), F.col("_ok"), F.col(y) == 1)).withColumns(_accuracy_rates())
    return join_on(rated, _class_stats(counts, groups, y, p, empty), groups, "left")


def domain_compare(df: DataFrame, domain: str, source: str, target: str) -> DataFrame:
    """Change of accuracy, fake detection and separation from source to target.

    The report has one row per domain, so turning it into columns is free.
    """
    report = group_report(df.filter(F.col(domain).isin(source, target)), [domain], empty=None)

    def at(column: str, name: str) -> Column:
        return F.max(F.when(F.col(domain) == name, F.col(column)))

    return (
        report.agg(
            *[
                at(c, d).alias(f"{side}_{c}")
                for side, d in (("source", source), ("target", target))
                for c in ("real_acc", "fake_acc", "overall_acc", "separation")
            ]
        )
        .withColumns(
            {
                "acc_delta": F.col("target_overall_acc") - F.col("source_overall_acc"),
                "fake_rate_delta": F.col("target_fake_acc") - F.col("source_fake_acc"),
                "separation_delta": F.col("target_separation") - F.col("source_separation"),
                "verdict": generalization_verdict(F.col("target_overall_acc")),
            }
        )
    )


def strategy_compare(df: DataFrame, strategy: str = "strategy") -> DataFrame:
    """All statistics per strategy, with the separation verdict."""
    return group_report(df, [strategy]).withColumn("conclusion", separation_verdict(F.col("separation")))


def forgetting_check(df: DataFrame, strategies: DataFrame | None, domain: str, source: str) -> DataFrame:
    """Overall source-domain accuracy per strategy; NULL where it has no data.

    Without a list of ``strategies`` it is those of ``df``, in the same scan.
    """
    own = F.col(domain) == source
    rows = F.count_if(own)
    measured = df.groupBy("strategy").agg(
        F.nullif(rows, F.lit(0)).alias("rows"),
        F.when(rows > 0, _rate(F.count_if(own & F.col("correct")), rows)).alias("overall_acc"),
    )
    listed = measured if strategies is None else join_on(strategies, measured, ["strategy"], "left")
    return listed.withColumn("skipped", F.col("rows").isNull())


def histogram(df: DataFrame, groups: Sequence[str], p: str = "p", bins: int = 20) -> DataFrame:
    """Rows per bin of [0, 1] with empty bins kept; values outside are not counted."""
    counted = (
        df.withColumn("bin", unit_bin(F.col(p), bins))
        .filter(F.col("bin").isNotNull())
        .groupBy(*groups, "bin")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    frame = counted.select(*groups).distinct() if groups else df.sparkSession.range(1).select()
    grid = frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return join_on(grid, counted, [*groups, "bin"], "left").fillna(0, ["rows"])


def boxplot(df: DataFrame, groups: Sequence[str], value: str = "p", whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the most extreme data inside the fences, outliers.

    Works on distinct values and their counts after the quartiles are known.
    """
    ladder = cut_lineage(value_counts(df, groups, value))
    quartiles = percentiles_of_counts(ladder, groups, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    fenced = quartiles.withColumns(
        {
            "_low": F.col("q1") - F.lit(whisker) * (F.col("q3") - F.col("q1")),
            "_high": F.col("q3") + F.lit(whisker) * (F.col("q3") - F.col("q1")),
        }
    )
    fenced = cut_lineage(fenced)
    v = F.col(value)
    inside = (v >= F.col("_low")) & (v <= F.col("_high"))
    return (
        join_bounded(ladder, fenced, groups, fenced.count())
        .groupBy(*groups)
        .agg(
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.least(F.min(F.when(v >= F.col("_low"), v)), F.max("q1")).alias("whisker_low"),
            F.greatest(F.max(F.when(v <= F.col("_high"), v)), F.max("q3")).alias("whisker_high"),
            F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("outliers"),
        )
    )


def predicted(p: Column, threshold: float | Column, inclusive: bool) -> Column:
    bound = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (p >= bound) if inclusive else (p > bound)


def confusion(
    df: DataFrame,
    groups: Sequence[str] = (),
    y: str = "y",
    p: str = "p",
    threshold: float | Column = 0.5,
    inclusive: bool = True,
) -> DataFrame:
    hit, fake = predicted(F.col(p), threshold, inclusive), F.col(y) == 1
    return df.groupBy(*groups).agg(
        F.count_if(hit & fake).alias("tp"),
        F.count_if(hit & ~fake).alias("fp"),
        F.count_if(~hit & ~fake).alias("tn"),
        F.count_if(~hit & fake).alias("fn"),
    )


def prf_columns() -> dict[str, Column]:
    """Accuracy, precision, recall and F1 from the four counts."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return {
        "accuracy": safe_ratio(tp + tn, tp + fp + tn + fn),
        "precision": safe_ratio(tp, tp + fp),
        "recall": safe_ratio(tp, tp + fn),
        "f1": safe_ratio(tp * 2, tp * 2 + fp + fn),
    }


def prf(df: DataFrame, groups: Sequence[str] = (), **options) -> DataFrame:
    return confusion(df, groups, **options).withColumns(prf_columns())


def sens_spec_balanced(df: DataFrame, groups: Sequence[str] = (), **options) -> DataFrame:
    counts = confusion(df, groups, **{"inclusive": False, **options})
    rated = counts.withColumns(
        {
            "sensitivity": safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "specificity": safe_ratio(F.col("tn"), F.col("tn") + F.col("fp")),
            "f1": prf_columns()["f1"],
        }
    )
    return rated.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / F.lit(2.0))


def class_report(df: DataFrame, groups: Sequence[str] = (), names: tuple[str, str] = ("real", "fake"), **options) -> DataFrame:
    """Precision, recall, F1 and support per class with accuracy and averages.

    Expands the one-row confusion counts of a group into five report rows.
    """
    counts = confusion(df, groups, **options)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def scores(hit: Column, wrong: Column, missed: Column) -> tuple[Column, Column, Column]:
        return safe_ratio(hit, hit + wrong), safe_ratio(hit, hit + missed), safe_ratio(hit * 2, hit * 2 + wrong + missed)

    real, fake = scores(tn, fn, fp), scores(tp, fp, fn)
    n_real, n_fake, n = tn + fp, tp + fn, tp + fp + tn + fn
    share = safe_ratio(tp + tn, n)
    macro = [(a + b) / F.lit(2.0) for a, b in zip(real, fake)]
    weighted = [safe_ratio(a * n_real + b * n_fake, n) for a, b in zip(real, fake)]
    nothing = F.lit(None).cast("double")

    def line(name: str, values: Sequence[Column], support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("row"),
            *[v.alias(c) for c, v in zip(("precision", "recall", "f1"), values)],
            support.alias("support"),
        )

    lines = F.array(
        line(names[0], real, n_real),
        line(names[1], fake, n_fake),
        line("accuracy", [nothing, nothing, share], n),
        line("macro avg", macro, n),
        line("weighted avg", weighted, n),
    )
    return counts.select(*groups, F.inline(lines))


def brier(df: DataFrame, groups: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(*groups).agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))


def reliability(df: DataFrame, groups: Sequence[str] = (), y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Rows, observed rate and mean confidence per non-empty bin."""
    return (
        df.withColumn("bin", unit_bin(F.col(p), bins))
        .groupBy(*groups, "bin")
        .agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(y)).alias("observed"), F.avg(F.col(p)).alias("confidence"))
    )


def ece(df: DataFrame, groups: Sequence[str] = (), y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Expected calibration error: an aggregate over at most ``bins`` rows a group."""
    table = reliability(df, groups, y, p, bins)
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("observed") - F.col("confidence")) * F.col("rows"))
    return table.groupBy(*groups).agg((F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("rows")).alias("ece"))


def bce_loss(df: DataFrame, groups: Sequence[str] = (), y: str = "y", z: str = "z") -> DataFrame:
    return df.groupBy(*groups).agg(F.avg(bce_with_logits(F.col(z), F.col(y))).alias("loss"))


def batched_bce_loss(df: DataFrame, order: Sequence[str], batch_size: int = 32, y: str = "y", z: str = "z") -> DataFrame:
    """Mean of per-batch means, which over-weights a ragged last batch."""
    placed = row_positions(df.select(*order, y, z), order)
    batch = F.expr(f"div(position - 1, {batch_size})")
    per_batch = placed.groupBy(batch.alias("batch")).agg(F.avg(bce_with_logits(F.col(z), F.col(y))).alias("_loss"))
    return per_batch.agg(F.avg("_loss").alias("loss"), F.count(F.lit(1)).alias("batches"))


def training_losses(
    df: DataFrame,
    groups: Sequence[str] = (),
    y: str = "y",
    z: str = "z",
    smoothing: float = 0.02,
    alpha: float = 0.25,
    gamma: float = 2.0,
) -> DataFrame:
    """Label-smoothed cross-entropy and focal loss."""
    target = smooth_label(F.col(y), smoothing)
    return df.groupBy(*groups).agg(
        F.avg(bce_with_logits(F.col(z), target)).alias("smoothed_bce"),
        F.avg(focal_with_logits(F.col(z), F.col(y), alpha, gamma, smoothing)).alias("focal"),
    )


def by_partition(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Metrics per partition, per prefix of the keys and overall, in one scan.

    ``keys_used`` is the number of keys a row stands for, which tells a NULL
    key from the subtotal over it.
    """
    hit, fake = F.col(p) > F.lit(threshold), F.col(y) == 1
    return (
        df.rollup(*keys)
        .agg(
            F.count_if(hit & fake).alias("tp"),
            F.count_if(hit & ~fake).alias("fp"),
            F.count_if(~hit & ~fake).alias("tn"),
            F.count_if(~hit & fake).alias("fn"),
            (F.lit(len(keys)) - F.bit_count(F.grouping_id())).cast("int").alias("keys_used"),
        )
        .withColumns(prf_columns())
    )


def by_domain(df: DataFrame, domain: str, domains: Sequence[str], correct: str = "correct") -> DataFrame:
    """Accuracy as a share, overall and under one mask per domain, in one row."""
    ok = F.col(correct)

    def share(mask: Column) -> Column:
        return safe_ratio(F.count_if(ok & mask), F.count_if(mask))

    return df.agg(
        share(F.lit(True)).alias("mixed_acc"), *[share(F.col(domain) == d).alias(f"{d}_acc") for d in domains]
    )


def batch_vs_pooled(df: DataFrame, batch: str, y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Size-weighted means of per-batch metrics next to the pooled metrics."""
    rated = sens_spec_balanced(df, [batch], y=y, p=p, threshold=threshold).withColumn(
        "_n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    )

    # per-batch balanced accuracy averages over the classes the batch contains
    classes = F.when(F.col("tp") + F.col("fn") > 0, 1).otherwise(0) + F.when(F.col("tn") + F.col("fp") > 0, 1).otherwise(0)
    rated = rated.withColumn("balanced_accuracy", safe_ratio(F.col("sensitivity") + F.col("specificity"), classes))

    def weighted(column: str) -> Column:
        return F.sum(F.col(column) * F.col("_n")) / F.sum("_n")

    pooled = {c: F.sum(c) for c in ("tp", "fp", "tn", "fn")}
    summed = rated.agg(
        F.count(F.lit(1)).alias("batches"),
        weighted("f1").alias("batch_f1"),
        weighted("sensitivity").alias("batch_sensitivity"),
        weighted("specificity").alias("batch_specificity"),
        weighted("balanced_accuracy").alias("batch_balanced_accuracy"),
        *[v.alias(k) for k, v in pooled.items()],
    )
    sens = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    spec = safe_ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return summed.withColumns(
        {
            "pooled_f1": prf_columns()["f1"],
            "pooled_sensitivity": sens,
            "pooled_specificity": spec,
            "pooled_balanced_accuracy": (sens + spec) / F.lit(2.0),
        }
    ).drop("tp", "fp", "tn", "fn")
