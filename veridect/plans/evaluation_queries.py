"""Evaluation and calibration queries over the scored relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridect.functions.decisions import is_correct
from veridect.functions.numeric import round_half_up
from veridect.operators import calibration as C
from veridect.operators import evaluation as E
from veridect.operators import ranked as R
from veridect.operators import training_log as L
from veridect.operators.ordered import beside
from veridect.plans import fixtures as X
from veridect.plans.fixtures import round_columns, rounded, with_fixtures
from veridect.plans.registry import query


def _scored(spark: SparkSession, sf_dir: str, grp: bool = False) -> DataFrame:
    return X.scored(spark, sf_dir, grp).withColumn("correct", is_correct(F.col("p"), F.col("y")))


def _ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} = 0 THEN 0e0 ELSE CAST({num} AS DOUBLE) / ({den}) END"


_ACC = "(y = 1) = (p > 5e-1)"


def _accuracy_sql(keys: str, source: str, correct: str) -> str:
    group = f"GROUP BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""
    SELECT {head}count(*) AS total, count(*) FILTER (WHERE {correct}) AS correct_total,
           count(*) FILTER (WHERE y = 0) AS real_total, count(*) FILTER (WHERE y = 0 AND {correct}) AS real_correct,
           count(*) FILTER (WHERE y = 1) AS fake_total, count(*) FILTER (WHERE y = 1 AND {correct}) AS fake_correct
    FROM {source} {group}"""


_RATES = f"""{_ratio('real_correct', 'real_total')} * 1e2 AS real_acc, {_ratio('fake_correct', 'fake_total')} * 1e2 AS fake_acc,
       {_ratio('correct_total', 'total')} * 1e2 AS overall_acc"""


def _stats_sql(keys: str, source: str) -> str:
    return f"""
    SELECT {keys}, avg(p) FILTER (WHERE y = 1) AS fake_mean, median(p) FILTER (WHERE y = 1) AS fake_median,
           avg(p) FILTER (WHERE y = 0) AS real_mean, median(p) FILTER (WHERE y = 0) AS real_median
    FROM {source} GROUP BY {keys}"""


@query("ev_accuracy", with_fixtures("scored", f"""
SELECT grp, total, correct_total, real_total, real_correct, fake_total, fake_correct,
       {rounded('real_acc')} AS real_acc, {rounded('fake_acc')} AS fake_acc, {rounded('overall_acc')} AS overall_acc
FROM (SELECT *, {_RATES} FROM ({_accuracy_sql('grp', 'scored', _ACC)}) a) b"""))
def ev_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(E.accuracy(_scored(spark, sf_dir, grp=True), ["grp"]), "real_acc", "fake_acc", "overall_acc")


@query("ev_describe", with_fixtures("scored", f"""
SELECT y, count(p) AS count, {rounded('avg(p)', 4)} AS mean, {rounded('stddev_samp(p)', 4)} AS std, {rounded('min(p)', 4)} AS min,
       {rounded('quantile_cont(p, 0.25)', 4)} AS q25, {rounded('quantile_cont(p, 0.5)', 4)} AS q50,
       {rounded('quantile_cont(p, 0.75)', 4)} AS q75, {rounded('max(p)', 4)} AS max
FROM scored GROUP BY y"""))
def ev_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.describe(_scored(spark, sf_dir), ["y"])


_STAT_COLUMNS = ("fake_mean", "fake_median", "real_mean", "real_median", "separation")


@query("ev_domain_stats", with_fixtures("scored", f"""
SELECT domain, {', '.join(f'{rounded(c)} AS {c}' for c in _STAT_COLUMNS)}
FROM (SELECT *, fake_mean - real_mean AS separation FROM ({_stats_sql('domain', 'scored')}) s) t"""))
def ev_domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(E.domain_stats(_scored(spark, sf_dir), ["domain"]), *_STAT_COLUMNS)


_SEPARATION = (
    "CASE WHEN separation > 3e-1 THEN 'good' WHEN separation >= 1e-1 THEN 'limited' WHEN separation >= 0e0 THEN 'insufficient'"
    " ELSE 'inverted' END"
)


@query("ev_separation_verdict", with_fixtures("strategies", f"""
SELECT strategy, domain, {rounded('separation')} AS separation, {_SEPARATION} AS conclusion
FROM (SELECT strategy, domain, avg(p) FILTER (WHERE y = 1) - avg(p) FILTER (WHERE y = 0) AS separation
      FROM strategies GROUP BY strategy, domain) s"""))
def ev_separation_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = X.strategies(spark, sf_dir).groupBy("strategy", "domain").agg(
        (F.avg(F.when(F.col("y") == 1, F.col("p"))) - F.avg(F.when(F.col("y") == 0, F.col("p")))).alias("separation")
    )
    return stats.select(
        "strategy",
        "domain",
        round_half_up(F.col("separation"), 6).alias("separation"),
        E.separation_verdict(F.col("separation")).alias("conclusion"),
    )


_GENERAL = "CASE WHEN overall_acc >= 7.5e1 THEN 'generalizes' WHEN overall_acc >= 6e1 THEN 'limited' ELSE 'fails' END"


@query("ev_generalization_verdict", with_fixtures("strategies", f"""
SELECT strategy, domain, {rounded('overall_acc')} AS overall_acc, {_GENERAL} AS verdict
FROM (SELECT *, {_RATES} FROM ({_accuracy_sql('strategy, domain', 'strategies', 'correct')}) a) b"""))
def ev_generalization_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = E.accuracy(X.strategies(spark, sf_dir), ["strategy", "domain"])
    return report.select(
        "strategy",
        "domain",
        round_half_up(F.col("overall_acc"), 6).alias("overall_acc"),
        E.generalization_verdict(F.col("overall_acc")).alias("verdict"),
    )


_COMPARED = [f"{s}_{c}" for s in ("source", "target") for c in ("real_acc", "fake_acc", "overall_acc", "separation")]
_DELTAS = ["acc_delta", "fake_rate_delta", "separation_delta"]


@query("ev_domain_compare", with_fixtures("scored", f"""
WITH report AS (
  SELECT a.*, s.separation FROM (SELECT *, {_RATES} FROM ({_accuracy_sql('domain', 'scored', _ACC)}) x) a
  JOIN (SELECT domain, fake_mean - real_mean AS separation FROM ({_stats_sql('domain', 'scored')}) y) s ON a.domain = s.domain),
sides AS (
  SELECT {', '.join(f"max({c[7:]}) FILTER (WHERE domain = '{'src' if c.startswith('source') else 'tgt'}') AS {c}" for c in _COMPARED)} FROM report)
SELECT {', '.join(f'{rounded(c)} AS {c}' for c in _COMPARED)},
       {rounded('target_overall_acc - source_overall_acc')} AS acc_delta, {rounded('target_fake_acc - source_fake_acc')} AS fake_rate_delta,
       {rounded('target_separation - source_separation')} AS separation_delta,
       {_GENERAL.replace('overall_acc', 'target_overall_acc')} AS verdict FROM sides"""))
def ev_domain_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = E.domain_compare(_scored(spark, sf_dir), "domain", "src", "tgt")
    return round_columns(compared, *_COMPARED, *_DELTAS)


_REPORT = ("real_acc", "fake_acc", "overall_acc", *_STAT_COLUMNS)


@query("ev_strategy_compare", with_fixtures("strategies", f"""
SELECT strategy, {', '.join(f'{rounded(c)} AS {c}' for c in _REPORT)}, {_SEPARATION} AS conclusion FROM (
  SELECT a.*, fake_mean, fake_median, real_mean, real_median, fake_mean - real_mean AS separation
  FROM (SELECT *, {_RATES} FROM ({_accuracy_sql('strategy', 'strategies', 'correct')}) x) a
  JOIN ({_stats_sql('strategy', 'strategies')}) s ON a.strategy = s.strategy) r"""))
def ev_strategy_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = E.strategy_compare(X.strategies(spark, sf_dir))
    return round_columns(report.select("strategy", *_REPORT, "conclusion"), *_REPORT)


@query("ev_forgetting_check", with_fixtures("strategies", f"""
SELECT s.strategy, rows, {rounded('overall_acc')} AS overall_acc, rows IS NULL AS skipped
FROM (SELECT DISTINCT strategy FROM strategies) s
LEFT JOIN (SELECT strategy, total AS rows, {_RATES} FROM ({_accuracy_sql('strategy', "(SELECT * FROM strategies WHERE domain = 'src')", 'correct')}) x) a
ON s.strategy = a.strategy"""))
def ev_forgetting_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = E.forgetting_check(X.strategies(spark, sf_dir), None, "domain", "src")
    return round_columns(checked, "overall_acc")


@query("ev_histogram", with_fixtures("scored", """
SELECT g.domain, g.y, CAST(b.bin AS INT) AS bin, count(s.p) AS rows
FROM (SELECT DISTINCT domain, y FROM scored) g, (SELECT unnest(range(20)) AS bin) b
LEFT JOIN scored s ON s.domain = g.domain AND s.y = g.y AND s.p >= CAST(b.bin AS DOUBLE) * 5e-2
  AND (s.p < CAST(b.bin + 1 AS DOUBLE) * 5e-2 OR (b.bin = 19 AND s.p <= 1e0))
GROUP BY ALL"""))
def ev_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.histogram(_scored(spark, sf_dir), ["domain", "y"])


@query("ev_boxplot", with_fixtures("scored", f"""
WITH q AS (SELECT domain, y, quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.5) AS median, quantile_cont(p, 0.75) AS q3 FROM scored GROUP BY domain, y)
SELECT domain, y, {rounded('q1')} AS q1, {rounded('median')} AS median, {rounded('q3')} AS q3,
       {rounded('least(whisker_low, q1)')} AS whisker_low, {rounded('greatest(whisker_high, q3)')} AS whisker_high, outliers
FROM (SELECT q.domain, q.y, q1, median, q3, min(p) FILTER (WHERE p >= q1 - 1.5e0 * (q3 - q1)) AS whisker_low,
             max(p) FILTER (WHERE p <= q3 + 1.5e0 * (q3 - q1)) AS whisker_high,
             count(*) FILTER (WHERE p < q1 - 1.5e0 * (q3 - q1) OR p > q3 + 1.5e0 * (q3 - q1)) AS outliers
      FROM scored s JOIN q ON s.domain = q.domain AND s.y = q.y GROUP BY q.domain, q.y, q1, median, q3) b"""))
def ev_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = E.boxplot(_scored(spark, sf_dir), ["domain", "y"])
    return round_columns(box, "q1", "median", "q3", "whisker_low", "whisker_high")


def _confusion_sql(keys: str, source: str, hit: str) -> str:
    head, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""SELECT {head}count(*) FILTER (WHERE ({hit}) AND y = 1) AS tp, count(*) FILTER (WHERE ({hit}) AND y = 0) AS fp,
      count(*) FILTER (WHERE NOT ({hit}) AND y = 0) AS tn, count(*) FILTER (WHERE NOT ({hit}) AND y = 1) AS fn FROM {source} {group}"""


_PRF = {
    "accuracy": _ratio("tp + tn", "tp + fp + tn + fn"),
    "precision": _ratio("tp", "tp + fp"),
    "recall": _ratio("tp", "tp + fn"),
    "f1": _ratio("2 * tp", "2 * tp + fp + fn"),
}
_PRF_SQL = ", ".join(f'{rounded(v)} AS "{k}"' for k, v in _PRF.items())
_COUNTS = "tp, fp, tn, fn"


@query("ev_confusion", with_fixtures("scored", _confusion_sql("grp, domain", "scored", "p >= 5e-1")))
def ev_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(_scored(spark, sf_dir, grp=True), ["grp", "domain"])


@query("ev_prf", with_fixtures("scored", f"""
SELECT domain, {_COUNTS}, {_PRF_SQL} FROM ({_confusion_sql('domain', 'scored', 'p >= 5e-1')}) c"""))
def ev_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(E.prf(_scored(spark, sf_dir), ["domain"]), *_PRF)


@query("ev_sens_spec_balanced", with_fixtures("scored", f"""
SELECT grp, {_COUNTS}, {rounded('sensitivity')} AS sensitivity, {rounded('specificity')} AS specificity, {rounded('f1')} AS f1,
       {rounded('(sensitivity + specificity) / 2e0')} AS balanced_accuracy
FROM (SELECT *, {_ratio('tp', 'tp + fn')} AS sensitivity, {_ratio('tn', 'tn + fp')} AS specificity, {_PRF['f1']} AS f1
      FROM ({_confusion_sql('grp', 'scored', 'p > 5e-1')}) c) d"""))
def ev_sens_spec_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = E.sens_spec_balanced(_scored(spark, sf_dir, grp=True), ["grp"])
    return round_columns(report, "sensitivity", "specificity", "f1", "balanced_accuracy")


def _report_line(row: str, p: str, r: str, f: str, support: str) -> str:
    cast = [f"{rounded(x)}" if x != "NULL" else "CAST(NULL AS DOUBLE)" for x in (p, r, f)]
    return f'SELECT domain, \'{row}\' AS "row", {cast[0]} AS "precision", {cast[1]} AS recall, {cast[2]} AS f1, {support} AS support FROM m'


@query("ev_class_report", with_fixtures("scored", f"""
WITH m AS (SELECT *, {_ratio('tn', 'tn + fn')} AS p0, {_ratio('tn', 'tn + fp')} AS r0, {_ratio('2 * tn', '2 * tn + fn + fp')} AS f0,
                  {_PRF['precision']} AS p1, {_PRF['recall']} AS r1, {_PRF['f1']} AS f1, tn + fp AS n0, tp + fn AS n1, tp + fp + tn + fn AS n
           FROM ({_confusion_sql('domain', 'scored', 'p >= 5e-1')}) c)
{_report_line('real', 'p0', 'r0', 'f0', 'n0')} UNION ALL {_report_line('fake', 'p1', 'r1', 'f1', 'n1')} UNION ALL
{_report_line('accuracy', 'NULL', 'NULL', 'CAST(tp + tn AS DOUBLE) / n', 'n')} UNION ALL
{_report_line('macro avg', '(p0 + p1) / 2e0', '(r0 + r1) / 2e0', '(f0 + f1) / 2e0', 'n')} UNION ALL
{_report_line('weighted avg', '(p0 * n0 + p1 * n1) / n', '(r0 * n0 + r1 * n1) / n', '(f0 * n0 + f1 * n1) / n', 'n')}"""))
def ev_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(E.class_report(_scored(spark, sf_dir), ["domain"]), "precision", "recall", "f1")


def _ladder_sql(keys: str, source: str = "scored") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""SELECT *, sum(tp) OVER ({part} ORDER BY p DESC) AS ctp, sum(fp) OVER ({part} ORDER BY p DESC) AS cfp,
      sum(tp) OVER ({part}) AS ttp, sum(fp) OVER ({part}) AS tfp
      FROM (SELECT {head}p, count(*) FILTER (WHERE y = 1) AS tp, count(*) FILTER (WHERE y = 0) AS fp FROM {source} GROUP BY {head}p) t"""


_AUC = "CAST(sum(fp * (ctp - tp / 2e0)) AS DOUBLE) / nullif(CAST(max(ttp * tfp) AS DOUBLE), 0e0)"
_AP = "sum(CAST(tp AS DOUBLE) / CAST(ttp AS DOUBLE) * CAST(ctp AS DOUBLE) / CAST(ctp + cfp AS DOUBLE))"


@query("ev_roc_curve", with_fixtures("scored", f"""
SELECT domain, {rounded('CAST(cfp AS DOUBLE) / CAST(tfp AS DOUBLE)')} AS fpr, {rounded('CAST(ctp AS DOUBLE) / CAST(ttp AS DOUBLE)')} AS tpr, p AS threshold
FROM ({_ladder_sql('domain')}) l UNION ALL SELECT DISTINCT domain, 0e0, 0e0, CAST(NULL AS DOUBLE) FROM scored"""))
def ev_roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = R.roc_curve(_scored(spark, sf_dir), ["domain"])
    return round_columns(curve, "fpr", "tpr").withColumn("threshold", F.nullif("threshold", F.lit(float("inf"))))


@query("ev_roc_auc", with_fixtures("scored", f"SELECT domain, {rounded(_AUC)} AS roc_auc FROM ({_ladder_sql('domain')}) l GROUP BY domain"))
def ev_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(R.roc_auc(_scored(spark, sf_dir), ["domain"]), "roc_auc")


@query("ev_avg_precision", with_fixtures("scored", f"SELECT domain, {rounded(_AP)} AS avg_precision FROM ({_ladder_sql('domain')}) l GROUP BY domain"))
def ev_avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(R.average_precision(_scored(spark, sf_dir), ["domain"]), "avg_precision")


@query("ev_brier", with_fixtures("scored", f"SELECT grp, {rounded('avg((p - y) * (p - y))')} AS brier FROM scored GROUP BY grp"))
def ev_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(E.brier(_scored(spark, sf_dir, grp=True), ["grp"]), "brier")


_BIN = "(SELECT count(*) FROM (SELECT unnest(range(1, 10)) AS i) e WHERE p >= CAST(i AS DOUBLE) * 1e-1)"


@query("ev_ece", with_fixtures("scored", f"""
SELECT domain, {rounded('sum(abs(observed - confidence) * rows) / sum(rows)')} AS ece FROM (
  SELECT domain, bin, count(*) AS rows, avg(y) AS observed, avg(p) AS confidence
  FROM (SELECT domain, y, p, {_BIN} AS bin FROM scored) b GROUP BY domain, bin) t GROUP BY domain"""))
def ev_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(E.ece(_scored(spark, sf_dir), ["domain"]), "ece")


@query("ev_reliability", with_fixtures("scored", f"""
SELECT domain, CAST(bin AS INT) AS bin, count(*) AS rows, {rounded('avg(y)')} AS observed, {rounded('avg(p)')} AS confidence
FROM (SELECT domain, y, p, {_BIN} AS bin FROM scored) b GROUP BY domain, bin"""))
def ev_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(E.reliability(_scored(spark, sf_dir), ["domain"]), "observed", "confidence")


_BCE = "greatest({z}, 0e0) - ({z}) * ({y}) + ln(1e0 + exp(-abs({z})))"


@query("ev_bce_loss", with_fixtures("scored", f"""
SELECT {rounded('(SELECT avg(' + _BCE.format(z='z', y='y') + ') FROM scored)')} AS sample_loss,
       {rounded('avg(loss)')} AS batch_loss, count(*) AS batches
FROM (SELECT avg({_BCE.format(z='z', y='y')}) AS loss FROM (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 32 AS batch FROM scored) r GROUP BY batch) b"""))
def ev_bce_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    batched = E.batched_bce_loss(rows, ["id"]).select(F.col("loss").alias("batch_loss"), "batches")
    both = E.bce_loss(rows).select(F.col("loss").alias("sample_loss"))
    return round_columns(beside(both, batched), "sample_loss", "batch_loss")


_SMOOTH = "(y * 9.8e-1 + 1e-2)"
_SIG = "(1e0 / (1e0 + exp(-z)))"
_PT = f"({_SIG} * {_SMOOTH} + (1e0 - {_SIG}) * (1e0 - {_SMOOTH}))"


@query("ev_smoothed_focal_loss", with_fixtures("scored", f"""
SELECT grp, {rounded('avg(' + _BCE.format(z='z', y=_SMOOTH) + ')')} AS smoothed_bce,
       {rounded(f'avg(({_BCE.format(z="z", y=_SMOOTH)}) * pow(1e0 - {_PT}, 2e0) * (2.5e-1 * {_SMOOTH} + 7.5e-1 * (1e0 - {_SMOOTH})))')} AS focal
FROM scored GROUP BY grp"""))
def ev_smoothed_focal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(E.training_losses(_scored(spark, sf_dir, grp=True), ["grp"]), "smoothed_bce", "focal")


_GRID = "(SELECT i, 1e-2 + CAST(i AS DOUBLE) * 1e-2 AS threshold FROM (SELECT unnest(range(99)) AS i) r)"


def _sweep_sql(keys: str, source: str = "scored") -> str:
    head = f"{keys}, " if keys else ""
    return f"""SELECT {head}CAST(i AS INT) AS step, threshold, count(*) FILTER (WHERE p >= threshold AND y = 1) AS tp,
       count(*) FILTER (WHERE p >= threshold AND y = 0) AS fp, count(*) FILTER (WHERE p < threshold AND y = 0) AS tn,
       count(*) FILTER (WHERE p < threshold AND y = 1) AS fn FROM {source}, {_GRID} g GROUP BY {head}i, threshold"""


@query("ev_threshold_sweep", with_fixtures("scored", f"""
SELECT domain, step, {rounded('threshold')} AS threshold, {_COUNTS}, {_PRF_SQL} FROM ({_sweep_sql('domain')}) s"""))
def ev_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(R.threshold_sweep(_scored(spark, sf_dir), ["domain"]), "threshold", *_PRF)


@query("ev_best_f1", with_fixtures("scored", f"""
SELECT domain, {rounded('threshold')} AS threshold, {rounded('f1')} AS f1
FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY f1 DESC, step) AS rn
      FROM (SELECT *, {_PRF['f1']} AS f1 FROM ({_sweep_sql('domain')}) s) t) u WHERE rn = 1"""))
def ev_best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(R.best_f1(_scored(spark, sf_dir), ["domain"]), "threshold", "f1")


@query("ev_youden", with_fixtures("scored", f"""
WITH curve AS (SELECT p AS threshold, CAST(ctp AS DOUBLE) / CAST(ttp AS DOUBLE) AS tpr, CAST(cfp AS DOUBLE) / CAST(tfp AS DOUBLE) AS fpr
               FROM ({_ladder_sql('', "(SELECT * FROM scored WHERE domain = 'src')")}) l),
best AS (SELECT * FROM curve ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1)
SELECT threshold, {rounded('tpr')} AS tpr, {rounded('fpr')} AS fpr, {rounded('tpr - fpr')} AS j,
       (SELECT count(*) FROM scored WHERE domain = 'tgt' AND p >= threshold AND y = 1) AS tp,
       (SELECT count(*) FROM scored WHERE domain = 'tgt' AND p >= threshold AND y = 0) AS fp,
       (SELECT count(*) FROM scored WHERE domain = 'tgt' AND p < threshold AND y = 0) AS tn,
       (SELECT count(*) FROM scored WHERE domain = 'tgt' AND p < threshold AND y = 1) AS fn FROM best"""))
def ev_youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold chosen on one domain and applied to the other."""
    rows = _scored(spark, sf_dir)
    best = R.youden(rows.filter("domain = 'src'"))
    target = beside(rows.filter("domain = 'tgt'"), best.select("threshold"))
    applied = E.confusion(target, threshold=F.col("threshold"))
    return round_columns(beside(best, applied), "tpr", "fpr", "j")


_BCE_T = _BCE.format(z="z / t", y="y")


@query("ev_temperature_grid", with_fixtures("scored", f"""
SELECT CAST(i AS INT) AS step, {rounded('t')} AS temperature, {rounded('avg(' + _BCE_T + ')')} AS loss
FROM scored, (SELECT i, 1e-1 * pow(pow(1e2, 1e0 / 1.99e2), i) AS t FROM (SELECT unnest(range(200)) AS i) r) g GROUP BY i, t"""))
def ev_temperature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(C.temperature_losses(_scored(spark, sf_dir)), "temperature", "loss")


def _newton_sql(source: str) -> str:
    """Newton's steps for b = 1 / T as a recursive query."""
    s = "(1e0 / (1e0 + exp(-z * b)))"
    return f"""newton(i, b) AS (
  SELECT 0, 1e0 UNION ALL
  SELECT i + 1, b - g / h FROM (SELECT i, b, sum(({s} - y) * z) AS g, sum({s} * (1e0 - {s}) * z * z) AS h
                                FROM newton, {source} v WHERE i < 12 GROUP BY i, b) step),
fit AS (SELECT b FROM newton WHERE i = 12)"""


@query("ev_temperature_fit", with_fixtures("scored", f"""
WITH RECURSIVE {_newton_sql('scored')}
SELECT {rounded('1e0 / b', 4)} AS temperature, {rounded('(SELECT avg(' + _BCE.format(z='z * b', y='y') + ') FROM scored)')} AS loss FROM fit"""))
def ev_temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = C.fit_temperature(X.scored(spark, sf_dir))
    return spark.range(1).select(
        round_half_up(F.lit(fit.temperature), 4).alias("temperature"), round_half_up(F.lit(fit.loss), 6).alias("loss")
    )


_CLASS_SPLIT = """classes AS (SELECT y, count(*) AS c FROM scored GROUP BY y),
shares AS (SELECT y, c, sum(c) OVER () AS n, sum(c) OVER () - CAST(ceil(8e-1 * sum(c) OVER ()) AS BIGINT) AS total FROM classes),
bases AS (SELECT y, total, (c * total) // n AS base, row_number() OVER (ORDER BY (c * total) % n DESC, y) AS place FROM shares),
quotas AS (SELECT y, base + CASE WHEN place <= total - (SELECT sum(base) FROM bases) THEN 1 ELSE 0 END AS quota FROM bases),
ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(id || ':42'), id) AS rk FROM scored),
halves AS (SELECT r.id, r.y, r.z, 1e0 / (1e0 + exp(-r.z)) AS p, CASE WHEN rk <= quota THEN 'val' ELSE 'test' END AS split
           FROM ranked r JOIN quotas q ON r.y = q.y)"""
SPLIT_CTES = _CLASS_SPLIT


def _variant_sql(name: str, source: str, threshold: str) -> str:
    ladder = _ladder_sql("", source)
    return f"""SELECT '{name}' AS variant, {_PRF_SQL},
      (SELECT {rounded(_AUC)} FROM ({ladder}) l) AS roc_auc, (SELECT {rounded(_AP)} FROM ({ladder}) l) AS avg_precision,
      (SELECT {rounded('avg((p - y) * (p - y))')} FROM {source} s) AS brier,
      (SELECT {rounded('sum(gap) / sum(rows)')} FROM (SELECT abs(avg(y) - avg(p)) * count(*) AS gap, count(*) AS rows
         FROM (SELECT y, p, {_BIN} AS bin FROM {source} s) b GROUP BY bin) t) AS ece10,
      {rounded('threshold')} AS threshold
      FROM (SELECT c.*, threshold FROM ({_confusion_sql('threshold', f'(SELECT * FROM {source} a, (SELECT {threshold} AS threshold) th) s', 'p >= threshold')}) c) d"""


def _best_threshold_sql(source: str) -> str:
    return f"(SELECT threshold FROM (SELECT *, {_PRF['f1']} AS f1 FROM ({_sweep_sql('', source)}) s) t ORDER BY f1 DESC, step LIMIT 1)"


METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "avg_precision", "brier", "ece10", "threshold")


CALIBRATION_CTES = f"""WITH RECURSIVE {_CLASS_SPLIT},
val AS MATERIALIZED (SELECT * FROM halves WHERE split = 'val'), test AS MATERIALIZED (SELECT * FROM halves WHERE split = 'test'),
{_newton_sql('val')},
val_cal AS MATERIALIZED (SELECT y, 1e0 / (1e0 + exp(-(z * b))) AS p FROM val, fit),
test_cal AS MATERIALIZED (SELECT y, 1e0 / (1e0 + exp(-(z * b))) AS p FROM test, fit)"""
CALIBRATION_VARIANTS = f"""{_variant_sql('baseline_t05', 'test', '5e-1')} UNION ALL
{_variant_sql('threshold_only', 'test', _best_threshold_sql('val'))} UNION ALL
{_variant_sql('threshold_plus_calibration', 'test_cal', _best_threshold_sql('val_cal'))}"""
CALIBRATION_FIT = f"""SELECT {rounded('1e0 / b', 4)} AS temperature, {rounded(_best_threshold_sql('val'))} AS threshold_raw,
       {rounded(_best_threshold_sql('val_cal'))} AS threshold_calibrated FROM fit"""


@query("ev_calibration_report", with_fixtures("scored", f"{CALIBRATION_CTES}\n{CALIBRATION_VARIANTS}"))
def ev_calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(C.calibration_report(X.scored(spark, sf_dir)).metrics, *METRICS)


@query("ev_by_generator", with_fixtures("scored", f"""
SELECT grp, CAST(sum(tp + fp) AS BIGINT) AS n, {rounded('CAST(sum(CASE WHEN p >= 5e-1 THEN tp ELSE fp END) AS DOUBLE) / CAST(sum(tp + fp) AS DOUBLE)')} AS accuracy,
       {rounded(_AUC)} AS roc_auc FROM ({_ladder_sql('grp')}) l GROUP BY grp"""))
def ev_by_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(R.by_generator(_scored(spark, sf_dir, grp=True), "grp"), "accuracy", "roc_auc")


@query("ev_by_partition", with_fixtures("scored", f"""
SELECT domain, grp, keys_used, {_COUNTS}, {_PRF_SQL} FROM ({_confusion_sql('ROLLUP (domain, grp)', 'scored', 'p > 5e-1').replace('SELECT ROLLUP (domain, grp), ', 'SELECT domain, grp, CAST(2 - grouping(domain) - grouping(grp) AS INT) AS keys_used, ')}) c"""))
def ev_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(E.by_partition(_scored(spark, sf_dir, grp=True), ["domain", "grp"]), *_PRF)


def _share(mask: str) -> str:
    return rounded(_ratio(f"count(*) FILTER (WHERE ({_ACC}) AND {mask})", f"count(*) FILTER (WHERE {mask})"))


@query("ev_by_domain", with_fixtures("scored", f"""
SELECT {_share('true')} AS mixed_acc, {_share("domain = 'src'")} AS src_acc, {_share("domain = 'tgt'")} AS tgt_acc FROM scored"""))
def ev_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = E.by_domain(_scored(spark, sf_dir), "domain", ["src", "tgt"])
    return round_columns(report, "mixed_acc", "src_acc", "tgt_acc")


@query("ev_running_mean", with_fixtures("epochs", f"""
SELECT run, epoch, n, f1, {rounded('sum(f1 * n) OVER w / sum(n) OVER w')} AS running_mean FROM epochs
WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING)"""))
def ev_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(L.running_mean(X.epochs(spark, sf_dir), "run", "epoch", "f1", "n"), "running_mean")


_POOLED = ("f1", "sensitivity", "specificity", "balanced_accuracy")


@query("ev_batch_vs_pooled", with_fixtures("scored", f"""
WITH per AS (SELECT *, {_PRF['f1']} AS f1, {_ratio('tp', 'tp + fn')} AS sensitivity, {_ratio('tn', 'tn + fp')} AS specificity, tp + fp + tn + fn AS n
             FROM ({_confusion_sql('grp', 'scored', 'p > 5e-1')}) c),
bal AS (SELECT *, (sensitivity + specificity) / (CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END + CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END) AS balanced_accuracy FROM per),
pool AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM per)
SELECT count(*) AS batches, {', '.join(f'{rounded(f"sum({c} * n) / sum(n)")} AS batch_{c}' for c in _POOLED)},
       (SELECT {rounded(_PRF['f1'])} FROM pool) AS pooled_f1, (SELECT {rounded(_ratio('tp', 'tp + fn'))} FROM pool) AS pooled_sensitivity,
       (SELECT {rounded(_ratio('tn', 'tn + fp'))} FROM pool) AS pooled_specificity,
       (SELECT {rounded('((' + _ratio('tp', 'tp + fn') + ') + (' + _ratio('tn', 'tn + fp') + ')) / 2e0')} FROM pool) AS pooled_balanced_accuracy
FROM bal"""))
def ev_batch_vs_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each generator stands for one batch."""
    report = E.batch_vs_pooled(_scored(spark, sf_dir, grp=True), "grp")
    return round_columns(report, *[f"{s}_{c}" for s in ("batch", "pooled") for c in _POOLED])


@query("ev_best_epoch", with_fixtures("epochs", """
SELECT run, epoch AS best_epoch, f1 AS best_f1
FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, epoch) AS rn FROM epochs) e WHERE rn = 1"""))
def ev_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.best_epoch(X.epochs(spark, sf_dir), "f1")


@query("ev_checkpoint_marks", with_fixtures("epochs", """
SELECT run, epoch, f1, coalesce(f1 > max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS saved
FROM epochs"""))
def ev_checkpoint_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.checkpoint_marks(X.epochs(spark, sf_dir), "f1").select("run", "epoch", "f1", "saved")


@query("ev_early_stop", with_fixtures("epochs", """
WITH marked AS (SELECT run, epoch, row_number() OVER (PARTITION BY run ORDER BY epoch) AS place,
                       coalesce(f1 > max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS saved FROM epochs),
waited AS (SELECT *, max(CASE WHEN saved THEN place END) OVER w AS best_place, max(CASE WHEN saved THEN epoch END) OVER w AS restored FROM marked
           WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT *, place - best_place >= 5 AS stalled FROM waited)
SELECT run, epoch AS stop_epoch, restored AS restored_epoch, stalled AS stopped_early
FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY stalled DESC, CASE WHEN stalled THEN place ELSE -place END) AS rn FROM ends) e WHERE rn = 1"""))
def ev_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.early_stop(X.epochs(spark, sf_dir), "f1")
