import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridect.functions.numeric import grid_passed, round_half_up, unit_bin
from veridect.operators import calibration as C
from veridect.operators import evaluation as E
from veridect.operators import ordered as O
from veridect.operators import ranked as R
from veridect.operators import training_log as L

SCORED = "id int, g string, y int, p double, z double"


def sample(n, seed, ties=True):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = rng.random() < 0.4
        z = rng.gauss(0.8 if y else -0.4, 1.3)
        p = 1 / (1 + math.exp(-z))
        out.append((i, "hot" if rng.random() < 0.8 else rng.choice("ab"), int(y), round(p, 2) if ties else p, z))
    return out


def auc_of(pairs):
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def ap_of(pairs):
    total, value, last = sum(y for _, y in pairs), 0.0, 0.0
    for t in sorted({p for p, _ in pairs}, reverse=True):
        hit = [y for p, y in pairs if p >= t]
        value += (sum(hit) / total - last) * sum(hit) / len(hit)
        last = sum(hit) / total
    return value


@pytest.mark.parametrize("ties", [True, False])
def test_ranked_metrics_against_brute_force(spark, ties):
    data = sample(400, 3, ties)
    df = spark.createDataFrame(data, SCORED)
    auc = {r.g: r.roc_auc for r in R.roc_auc(df, ["g"]).collect()}
    ap = {r.g: r.avg_precision for r in R.average_precision(df, ["g"]).collect()}
    for g in auc:
        pairs = [(p, y) for _, h, y, p, _ in data if h == g]
        assert auc[g] == pytest.approx(auc_of(pairs))
        assert ap[g] == pytest.approx(ap_of(pairs))
    best = R.youden(df).first()
    options = []
    for t in [math.inf, *sorted({r[3] for r in data}, reverse=True)]:
        tpr = sum(r[3] >= t for r in data if r[2]) / sum(r[2] for r in data)
        fpr = sum(r[3] >= t for r in data if not r[2]) / sum(not r[2] for r in data)
        options.append((tpr - fpr, t))
    j, t = max(options, key=lambda o: (round(o[0], 12), o[1]))
    assert best.j == pytest.approx(j) and best.threshold == t


def test_one_class_auc(rows):
    df = rows([(1, "a", 1, 0.4, 0.0), (2, "a", 1, 0.6, 0.0)], SCORED)
    assert R.roc_auc(df).first().roc_auc is None
    assert R.roc_auc(df, empty=0.0).first().roc_auc == 0.0


def test_auc_invariants(spark):
    df = spark.createDataFrame(sample(300, 9, ties=False), SCORED)
    base = R.roc_auc(df).first().roc_auc
    assert R.roc_auc(df, p="z").first().roc_auc == pytest.approx(base)
    flipped = df.withColumn("p", 1 - F.col("p"))
    assert R.roc_auc(flipped).first().roc_auc == pytest.approx(1 - base)


def test_roc_curve_starts_at_origin(rows):
    df = rows([(1, "a", 1, 0.9, 0.0), (2, "a", 0, 0.5, 0.0), (3, "a", 1, 0.5, 0.0)], SCORED)
    points = sorted((r.threshold, r.fpr, r.tpr) for r in R.roc_curve(df).collect())
    assert points == [(0.5, 1.0, 1.0), (0.9, 0.0, 0.5), (math.inf, 0.0, 0.0)]


def test_sweep_against_direct_counts(spark):
    data = sample(300, 5)
    data += [(1000 + i, "a", i % 2, float(t), 0.0) for i, t in enumerate(np.linspace(0.01, 0.99, 99))]
    got = {r.step: (r.tp, r.fp, r.threshold, r.f1) for r in R.threshold_sweep(spark.createDataFrame(data, SCORED)).collect()}
    assert len(got) == 99
    best, best_t = -1.0, None
    for i, t in enumerate(np.linspace(0.01, 0.99, 99)):
        tp = sum(r[3] >= t and r[2] == 1 for r in data)
        fp = sum(r[3] >= t and r[2] == 0 for r in data)
        fn = sum(r[3] < t and r[2] == 1 for r in data)
        f1 = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
        assert got[i][:3] == (tp, fp, float(t))
        assert got[i][3] == pytest.approx(f1)
        if f1 > best:
            best, best_t = f1, float(t)
    chosen = R.best_f1(spark.createDataFrame(data, SCORED)).first()
    assert chosen.threshold == best_t and chosen.f1 == pytest.approx(best)


def test_no_positive_keeps_first_threshold(rows):
    df = rows([(1, "a", 0, 0.3, 0.0), (2, "a", 0, 0.9, 0.0)], SCORED)
    assert tuple(R.best_f1(df).first()) == (0.01, 0.0)


def test_bin_and_grid_edges(spark):
    for bins in (10, 20):
        edges = np.linspace(0, 1, bins + 1)
        values = sorted({*edges.tolist(), *(i / 100 for i in range(101)), 0.3, 0.6, 0.7, np.nextafter(0.3, 1)})
        df = spark.createDataFrame([(float(v),) for v in values], "p double")
        for r in df.select("p", unit_bin(F.col("p"), bins).alias("b")).collect():
            want = next(i for i in range(bins) if edges[i] <= r.p and (r.p < edges[i + 1] or (i == bins - 1 and r.p <= 1)))
            assert r.b == want, (bins, r.p)
    outside = spark.createDataFrame([(-0.1,), (1.1,)], "p double")
    assert [r[0] for r in outside.select(unit_bin(F.col("p"), 10)).collect()] == [None, None]
    grid = np.linspace(0.01, 0.99, 99)
    values = [*grid.tolist(), *np.nextafter(grid, 0).tolist(), 0.0, 1.0, 0.06, 0.3]
    df = spark.createDataFrame([(float(v),) for v in values], "p double")
    for r in df.select("p", grid_passed(F.col("p")).alias("n")).collect():
        assert r.n == int((grid <= r.p).sum()), r.p


def test_ece_bin_of_030(rows):
    df = rows([(1, "a", 1, 0.3, 0.0), (2, "a", 0, 0.25, 0.0), (3, "a", 1, 1.0, 0.0)], SCORED)
    bins = {r.bin: r.rows for r in E.reliability(df).collect()}
    assert bins == {2: 2, 9: 1}
    want = (2 * abs(0.5 - 0.275) + 0.0) / 3
    assert E.ece(df).first().ece == pytest.approx(want)


def test_golden_accuracy(rows):
    data = [(i, 0, i < 39) for i in range(50)] + [(100 + i, 1, i < 42) for i in range(50)]
    r = E.accuracy(rows(data, "id int, y int, correct boolean")).first()
    assert (r.real_acc, r.fake_acc, r.overall_acc) == (78.0, 84.0, 81.0)
    data = [(i, 0, i < 14) for i in range(50)] + [(100 + i, 1, i < 29) for i in range(50)]
    r = E.accuracy(rows(data, "id int, y int, correct boolean")).first()
    assert (r.real_acc, r.fake_acc, r.overall_acc) == pytest.approx((28.0, 58.0, 43.0))


def test_empty_class_rules(rows):
    df = rows([(1, "a", 1, 0.4, 0.0), (2, "a", 1, 0.8, 0.0)], SCORED).withColumn("correct", F.col("p") > 0.5)
    assert E.accuracy(df).first().real_acc == 0.0
    zero, null = E.domain_stats(df, ["g"]).first(), E.domain_stats(df, ["g"], empty=None).first()
    assert zero.real_mean == 0.0 and zero.separation == pytest.approx(0.6)
    assert null.real_mean is None and null.separation is None
    compared = E.domain_compare(df.withColumn("domain", F.lit("tgt")), "domain", "src", "tgt").first()
    assert compared.source_overall_acc is None and compared.target_overall_acc == 50.0
    assert compared.acc_delta is None and compared.verdict == "fails"


@pytest.mark.parametrize(
    "value, name", [(0.31, "good"), (0.3, "limited"), (0.1, "limited"), (0.09, "insufficient"), (0.0, "insufficient"), (-0.01, "inverted")]
)
def test_separation_bounds(spark, value, name):
    assert spark.range(1).select(E.separation_verdict(F.lit(value))).first()[0] == name


@pytest.mark.parametrize("value, name", [(75.0, "generalizes"), (74.9, "limited"), (60.0, "limited"), (59.9, "fails")])
def test_generalization_bounds(spark, value, name):
    assert spark.range(1).select(E.generalization_verdict(F.lit(value))).first()[0] == name


def test_percentiles_and_describe(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.random(501), 2)
    df = spark.createDataFrame([("g" if i % 3 else "h", float(v)) for i, v in enumerate(values)], "g string, p double")
    got = {r.g: r for r in E.describe(df, ["g"]).collect()}
    for g, keep in (("g", lambda i: i % 3), ("h", lambda i: not i % 3)):
        v = np.array([x for i, x in enumerate(values) if keep(i)])
        want = [v.mean(), v.std(ddof=1), v.min(), *np.percentile(v, [25, 50, 75]), v.max()]
        row = got[g]
        assert [row[c] for c in ("mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx(want, abs=5.1e-5)
    assert E.describe(df, []).first()["count"] == 501


@pytest.mark.parametrize("cell_values", [100_000, 50, 1])
def test_percentiles_by_refinement(spark, monkeypatch, cell_values):
    """Cells split until they are small, over even, skewed and constant groups."""
    monkeypatch.setattr(O, "CELL_VALUES", cell_values)
    monkeypatch.setattr(O, "CELL_BUCKETS", 16)
    rng = np.random.default_rng(7)
    groups = {"even": rng.random(3000), "skewed": np.exp(rng.normal(0, 4, 1500)), "ties": rng.integers(0, 3, 400).astype(float), "one": np.array([5.0])}
    df = spark.createDataFrame([(g, float(x)) for g, values in groups.items() for x in values] + [("even", None)], "g string, p double")
    quantiles = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.75, "e": 1.0}
    got = {r.g: list(r)[1:] for r in O.percentiles(df, ["g"], "p", quantiles).collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        assert got[g] == pytest.approx(np.quantile(values, list(quantiles.values())).tolist())


def test_reports_scan_once(spark, tmp_path):
    """The source is read once; no rows are range partitioned."""
    path = str(tmp_path / "t")
    spark.createDataFrame(sample(200, 3), SCORED).withColumn("correct", F.col("p") > 0.5).repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    for made in (E.group_report(df, ["g"]), E.describe(df, ["g"]), E.boxplot(df, ["g"])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" not in plan and "rangepartitioning" not in plan
    want = E.accuracy(df, ["g"]).join(E.domain_stats(df, ["g"]), "g")
    assert sorted(map(tuple, E.group_report(df, ["g"]).collect())) == sorted(map(tuple, want.collect()))


def test_describe_of_groups_without_values(rows):
    got = {r.g: r for r in E.describe(rows([("a", 1.0), ("b", None), ("b", None)], "g string, p double"), ["g"]).collect()}
    assert (got["a"]["count"], got["a"].std, got["b"]["count"], got["b"].q50) == (1, None, 0, None)


def test_boxplot_whiskers(rows):
    df = rows([("a", float(v)) for v in [1, 2, 3, 4, 5, 100, -50]], "g string, p double")
    r = E.boxplot(df, ["g"]).first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers) == (1.5, 3.0, 4.5, 1.0, 5.0, 2)


def test_boxplot_join_without_broadcast(rows, monkeypatch):
    monkeypatch.setattr(O, "BROADCAST_ROWS", 0)
    df = rows([("a", float(v)) for v in [1, 2, 3, 4, 5, 100]] + [(None, 1.0), (None, 2.0)], "g string, p double")
    got = {r.g: r.median for r in E.boxplot(df, ["g"]).collect()}
    assert got == {"a": 3.5, None: 1.5}


def test_histogram_keeps_empty_bins(rows):
    values = [0.0, 1.0, 0.049, 1.2, 0.95, 0.96, 0.3, 0.15]
    got = {r.bin: r.rows for r in E.histogram(rows([("a", v) for v in values], "g string, p double"), ["g"]).collect()}
    want, _ = np.histogram(values, bins=20, range=(0, 1))
    assert [got[i] for i in range(20)] == want.tolist()


@pytest.mark.parametrize("group_rows", [100_000, 0])
def test_ladders_in_windows_and_slabs(spark, monkeypatch, group_rows):
    """Small groups by windows and large ones by slabs give the same ladders."""
    monkeypatch.setattr(O, "GROUP_ROWS", group_rows)
    data = sample(300, 9)
    for r in R.roc_auc(spark.createDataFrame(data, SCORED), ["g"]).collect():
        y = np.array([d[2] for d in data if d[1] == r.g])
        p = np.array([d[3] for d in data if d[1] == r.g])
        pairs = p[y == 1][:, None] - p[y == 0]
        assert r.roc_auc == pytest.approx((pairs > 0).mean() + 0.5 * (pairs == 0).mean())
    assert R.roc_auc(spark.createDataFrame([], SCORED)).first().roc_auc is None


def test_running_totals_hot_group_and_nulls(spark):
    data = [("hot", i, 1) for i in range(3000)] + [("b", i, 2) for i in range(7)] + [(None, i, 3) for i in range(5)]
    df = spark.createDataFrame(data, "g string, o int, n bigint").repartition(5)
    out = O.running_totals(df, ["g"], ["o"], ["n"]).collect()
    assert len(out) == len(data)
    for r in out:
        step = {"hot": 1, "b": 2, None: 3}[r.g]
        size = {"hot": 3000, "b": 7, None: 5}[r.g]
        assert r.cum_n == step * (r.o + 1) and r.tot_n == step * size


def test_bce_batches(spark):
    data = sample(70, 2)
    df = spark.createDataFrame(data, SCORED)
    loss = [max(z, 0) - z * y + math.log1p(math.exp(-abs(z))) for _, _, y, _, z in data]
    means = [np.mean(loss[i : i + 32]) for i in range(0, 70, 32)]
    got = E.batched_bce_loss(df, ["id"]).first()
    assert (got.loss, got.batches) == (pytest.approx(np.mean(means)), 3)
    assert E.bce_loss(df).first().loss == pytest.approx(np.mean(loss))


def test_temperature_is_the_minimum(spark):
    data = sample(500, 11)
    df = spark.createDataFrame(data, SCORED)
    fit = C.fit_temperature(df)

    def loss(t):
        return np.mean([max(z / t, 0) - z / t * y + math.log1p(math.exp(-abs(z / t))) for _, _, y, _, z in data])

    assert fit.loss == pytest.approx(loss(fit.temperature))
    assert fit.loss <= min(loss(fit.temperature * 0.99), loss(fit.temperature * 1.01), loss(1.0))
    grid = {r.step: r for r in C.temperature_losses(df).collect()}
    assert len(grid) == 200 and grid[100].loss == pytest.approx(loss(grid[100].temperature))


def test_temperature_limits(rows):
    separable = rows([(1, "a", 1, 0.9, 2.0), (2, "a", 0, 0.1, -2.0)], SCORED)
    assert C.fit_temperature(separable).temperature == 1e-3
    inverted = rows([(1, "a", 0, 0.9, 2.0), (2, "a", 1, 0.1, -2.0)], SCORED)
    assert C.fit_temperature(inverted).temperature == 100.0
    with pytest.raises(ValueError):
        C.fit_temperature(separable.limit(0))


def test_temperature_of_small_logits(rows):
    """The optimum is far from 1, where plain Newton steps are slow."""
    data = [(i, "a", int(i % 20 > 0), 0.5, 0.02) for i in range(100)]
    fit = C.fit_temperature(rows(data, SCORED))
    assert fit.temperature == pytest.approx(0.02 / math.log(19), rel=1e-6)


def test_calibration_leaves_ranking_alone(spark):
    report = C.calibration_report(spark.createDataFrame(sample(600, 21, ties=False), SCORED).drop("p"))
    got = {r.variant: r for r in report.metrics.collect()}
    assert len({round(r.roc_auc, 9) for r in got.values()}) == 1
    assert len({round(r.avg_precision, 9) for r in got.values()}) == 1
    assert got["baseline_t05"].threshold == 0.5


def test_metrics_of_all_variants(spark):
    """One ladder of logits against each variant's own scores."""
    data = sample(400, 5)
    counts = C.score_counts(spark.createDataFrame(data + [(999, "g", 1, None, None)], SCORED))
    got = {r.variant: r for r in C.metric_rows(counts, {"a": (1.0, 0.5), "b": (1.0, 0.3), "c": (2.5, 0.4)}).collect()}
    y, z = np.array([r[2] for r in data]), np.array([r[4] for r in data])
    for name, t, threshold in (("a", 1.0, 0.5), ("b", 1.0, 0.3), ("c", 2.5, 0.4)):
        p = 1 / (1 + np.exp(-z / t))
        hit = p >= threshold
        pairs = (p[y == 1][:, None] > p[y == 0]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0]).mean()
        bins = np.minimum((p * 10).astype(int), 9)
        gap = sum(abs((y - p)[bins == b].sum()) for b in range(10)) / len(y)
        row = got[name]
        assert row.accuracy == pytest.approx((hit == y).mean()) and row.precision == pytest.approx(y[hit].mean())
        assert row.roc_auc == pytest.approx(pairs) and row.brier == pytest.approx(((p - y) ** 2).mean())
        assert row.ece10 == pytest.approx(gap, abs=1e-6) and row.threshold == threshold


def test_class_report_and_zero_division(rows):
    df = rows([(1, "a", 1, 0.4, 0.0), (2, "a", 0, 0.2, 0.0)], SCORED)
    got = {r.row: r for r in E.class_report(df).collect()}
    assert (got["fake"].precision, got["fake"].recall, got["fake"].f1, got["fake"].support) == (0.0, 0.0, 0.0, 1)
    assert (got["real"].precision, got["real"].recall) == (0.5, 1.0)
    assert got["accuracy"].f1 == 0.5 and got["macro avg"].precision == 0.25


def test_epoch_rules(rows):
    log = rows(
        [("r", e, v) for e, v in enumerate([0.1, 0.5, 0.5, 0.4, 0.3, 0.2, 0.1, 0.9], 1)]
        + [("zero", 1, 0.0), ("zero", 2, 0.0), ("short", 1, 0.2), ("short", 2, 0.3)],
        "run string, epoch int, f1 double",
    )
    best = {r.run: (r.best_epoch, r.best_f1) for r in L.best_epoch(log, "f1").collect()}
    assert best == {"r": (8, 0.9), "zero": (1, 0.0), "short": (2, 0.3)}
    assert {r.run for r in L.best_epoch(log, "f1", start=0.0).collect()} == {"r", "short"}
    with pytest.raises(ValueError):
        L.best_epoch(log, "loss")
    stop = {r.run: (r.stop_epoch, r.restored_epoch, r.stopped_early) for r in L.early_stop(log, "f1").collect()}
    assert stop == {"r": (7, 2, True), "zero": (2, 1, False), "short": (2, 2, False)}
    saved = [r.epoch for r in L.checkpoint_marks(log, "f1").filter("run = 'r' AND saved").orderBy("epoch").collect()]
    assert saved == [1, 2, 8]


def test_rounding_is_half_up(spark):
    df = spark.createDataFrame([(0.12345,), (0.5,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(round_half_up(F.col("x"), 4)).collect()] == [0.1235, 0.5, None, None]
