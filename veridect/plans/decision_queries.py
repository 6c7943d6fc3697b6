"""Scoring, decision, fusion, sink, streaming and training queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridect.functions import arrays as A
from veridect.functions import decisions as D
from veridect.functions.numeric import round_half_up, sigmoid
from veridect.operators import calibration as C
from veridect.operators import documents, epochs
from veridect.operators import evaluation as E
from veridect.operators import fusion as U
from veridect.operators import ranked as R
from veridect.operators import sampling as S
from veridect.operators import training_log as L
from veridect.operators.ordered import beside
from veridect.operators.scoring import LinearScorer, batch_summary, score_batches
from veridect.plans import fixtures as X
from veridect.plans.dataset_queries import _SUMMARY_SQL, SEED, split_rows
from veridect.plans.evaluation_queries import CALIBRATION_CTES, CALIBRATION_FIT, CALIBRATION_VARIANTS, METRICS
from veridect.plans.fixtures import round_columns, rounded, table, with_fixtures
from veridect.plans import text_queries  # noqa: F401  (registers the oracle reused here)
from veridect.plans.registry import ORACLES, query
from veridect.session import cut_lineage, scratch_path
from veridect.sinks import committed, writers
from veridect.streaming import fusion as stream_fusion
from veridect.streaming import jobs
from veridect.streaming import progress as P

WEIGHTS = tuple(((i * 37) % 11 - 5) / 10.0 for i in range(64))
_DOT = "list_sum(list_transform(v, lambda x, i: x * (CAST(((i - 1) * 37) % 11 - 5 AS DOUBLE) / 1e1)))"


# ---- scoring ---------------------------------------------------------------


@query("scr_batch", with_fixtures("vectors", f"""
SELECT vec_id, CASE WHEN label <> 9 THEN {rounded(f'1e0 / (1e0 + exp(-({_DOT} + 1e-1)))')} END AS p, label = 9 AS failed FROM vectors"""))
def scr_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python model with the skip policy; rows without features fail. One pass writes both, and both are read back."""
    root = scratch_path(spark, "scored-batch")
    rows = X.vectors(spark, sf_dir).select("vec_id", F.when(F.col("label") != 9, F.col("v")).alias("features"))
    results = score_batches(rows, LinearScorer(WEIGHTS, 0.1), "skip").drop("features")
    writers.write_scored(results, root)
    good, failed = writers.read_scored(spark, root, results.schema)
    scored = good.withColumn("error", F.lit(None).cast("string")).unionByName(failed)
    return scored.select("vec_id", round_half_up(F.col("p"), 6).alias("p"), F.col("error").isNotNull().alias("failed"))


@query("scr_batch_native", with_fixtures("vectors", f"""
SELECT vec_id, {rounded(f'1e0 / (1e0 + exp(-({_DOT} + 1e-1)))')} AS p FROM vectors"""))
def scr_batch_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same linear model as a native expression."""
    score = sigmoid(A.dot(F.col("v"), WEIGHTS) + F.lit(0.1))
    return X.vectors(spark, sf_dir).select("vec_id", round_half_up(score, 6).alias("p"))


@query("scr_sigmoid", with_fixtures("scored", f"SELECT id, {rounded('1e0 / (1e0 + exp(-z))')} AS p FROM scored"))
def scr_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.scored(spark, sf_dir).select("id", round_half_up(sigmoid(F.col("z")), 6).alias("p"))


@query("scr_complement", with_fixtures("scored", f"SELECT id, {rounded('1e0 - p')} AS real_prob FROM scored"))
def scr_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.scored(spark, sf_dir).select("id", round_half_up(D.complement(F.col("p")), 6).alias("real_prob"))


@query("scr_binary_label", with_fixtures("scored", f"""
SELECT id, CASE WHEN p > 5e-1 THEN 'FAKE' ELSE 'REAL' END AS label, {rounded('p', 4)} AS fake_prob, {rounded('1e0 - p', 4)} AS real_prob,
       {rounded('greatest(p, 1e0 - p)', 4)} AS confidence, (y = 1) = (p > 5e-1) AS correct
FROM (SELECT id, y, 1e0 / (1e0 + exp(-z)) AS p FROM scored) s"""))
def scr_binary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.scored(spark, sf_dir).withColumn("p", sigmoid(F.col("z")))
    return rows.select("id", D.item_result(F.col("p")).alias("r"), D.is_correct(F.col("p"), F.col("y")).alias("correct")).select(
        "id", "r.*", "correct"
    )


@query("scr_two_class_label", with_fixtures("scored", f"""
SELECT id, CASE WHEN f >= r THEN 'FAKE' ELSE 'REAL' END AS argmax_label, CASE WHEN f > r THEN 'FAKE' ELSE 'REAL' END AS strict_label,
       {rounded('greatest(f, r)')} AS confidence
FROM (SELECT id, floor(p * 1e1) / 1e1 AS f, floor((1e0 - p) * 1e1) / 1e1 AS r FROM scored) s"""))
def scr_two_class_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs cut to one decimal, so that ties occur."""

    def cut(x):
        return F.floor(x * F.lit(10.0)) / F.lit(10.0)

    rows = X.scored(spark, sf_dir).select("id", cut(F.col("p")).alias("f"), cut(F.lit(1.0) - F.col("p")).alias("r"))
    f, r = F.col("f"), F.col("r")
    return rows.select(
        "id",
        D.two_class_label(f, r).alias("argmax_label"),
        D.two_class_label(f, r, tie="REAL").alias("strict_label"),
        round_half_up(D.two_class_confidence(f, r), 6).alias("confidence"),
    )


@query("scr_calibrated_decision", with_fixtures("scored", f"""
SELECT id, CASE WHEN p >= 2.4e-1 THEN 'AI-generated' ELSE 'Real' END AS label, {rounded('p')} AS calibrated_prob,
       {rounded('CASE WHEN p >= 2.4e-1 THEN p ELSE 1e0 - p END')} AS confidence
FROM (SELECT id, 1e0 / (1e0 + exp(-(z / 2.1098e0))) AS p FROM scored) s"""))
def scr_calibrated_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"temperature": 2.1098, "threshold": 0.24}
    rows = X.scored(spark, sf_dir).withColumn("p", D.calibrated(F.col("z"), config["temperature"]))
    p, threshold = F.col("p"), F.lit(config["threshold"])
    return rows.select(
        "id",
        D.calibrated_label(p, threshold).alias("label"),
        round_half_up(p, 6).alias("calibrated_prob"),
        round_half_up(D.calibrated_confidence(p, threshold), 6).alias("confidence"),
    )


@query("scr_risk_level", with_fixtures("scored", """
SELECT grp, CASE WHEN p > 7e-1 THEN 'High' WHEN p > 4e-1 THEN 'Medium' ELSE 'Low' END AS risk_level, count(*) AS items FROM scored GROUP BY ALL"""))
def scr_risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.scored(spark, sf_dir, grp=True)
    return rows.groupBy("grp", D.risk_level(F.col("p")).alias("risk_level")).agg(F.count(F.lit(1)).alias("items"))


@query("scr_likelihood_band", with_fixtures("scored", """
SELECT grp, CASE WHEN floor(p * 1e2 + 5e-1) < 30 THEN 'likely real' WHEN floor(p * 1e2 + 5e-1) < 70 THEN 'uncertain' ELSE 'likely AI-generated' END AS band,
       count(*) AS items FROM scored GROUP BY ALL"""))
def scr_likelihood_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.scored(spark, sf_dir, grp=True)
    return rows.groupBy("grp", D.likelihood_band(F.col("p")).alias("band")).agg(F.count(F.lit(1)).alias("items"))


@query("scr_batch_summary", with_fixtures("scored", f"""
SELECT total, fake_count, total - fake_count AS real_count, {rounded('fake_count * 1e2 / total')} AS fake_percent,
       {rounded('(total - fake_count) * 1e2 / total')} AS real_percent
FROM (SELECT count(*) AS total, count(*) FILTER (WHERE p > 5e-1) AS fake_count FROM scored) s"""))
def scr_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.scored(spark, sf_dir).select(D.binary_label(F.col("p")).alias("label"))
    return round_columns(batch_summary(rows), "fake_percent", "real_percent")


# ---- fusion ----------------------------------------------------------------


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.scored(spark, sf_dir).select("video_id", "frame_no", "id", "p")


_ORDER = ("frame_no", "id")


@query("fus_frames_mean", with_fixtures("scored", f"""
SELECT video_id, CASE WHEN m > 5e-1 THEN 'FAKE' ELSE 'REAL' END AS label, {rounded('m', 4)} AS fake_prob, frames_analyzed, per_frame
FROM (SELECT video_id, CAST(sum(CAST(p AS DECIMAL(5,4))) AS DOUBLE) / count(*) AS m, count(*) AS frames_analyzed,
             string_agg(rn || ':' || CASE WHEN p > 5e-1 THEN 'FAKE' ELSE 'REAL' END || ':' || CAST(CAST(floor(p * 1e4 + 5e-1) AS BIGINT) AS VARCHAR)
               || ':' || CAST(CAST(floor((1e0 - p) * 1e4 + 5e-1) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(greatest(p, 1e0 - p) * 1e4 + 5e-1) AS BIGINT) AS VARCHAR), ',' ORDER BY rn) AS per_frame
      FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_no, id) AS rn FROM scored) f WHERE rn <= 10 GROUP BY video_id) g"""))
def fus_frames_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = U.frames_mean(_frames(spark, sf_dir), "video_id", _ORDER)
    line = F.transform(
        "per_frame",
        lambda f: F.concat_ws(
            ":",
            f["frame"].cast("string"),
            f["label"],
            *[F.floor(f[c] * F.lit(10000.0) + F.lit(0.5)).cast("string") for c in ("fake_prob", "real_prob", "confidence")],
        ),
    )
    return result.withColumn("per_frame", F.array_join(line, ","))


@query("fus_frames_max", with_fixtures("scored", "SELECT video_id, max(p) AS fake_prob FROM scored GROUP BY video_id"))
def fus_frames_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.frames_max(_frames(spark, sf_dir), "video_id")


@query("fus_frames_sliding", with_fixtures("scored", f"""
SELECT video_id, {rounded('coalesce(max(m) FILTER (WHERE n = 3), avg(p))')} AS fake_prob
FROM (SELECT video_id, p, avg(p) OVER w AS m, count(*) OVER w AS n FROM scored
      WINDOW w AS (PARTITION BY video_id ORDER BY frame_no, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) s GROUP BY video_id"""))
def fus_frames_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(U.frames_sliding(_frames(spark, sf_dir), "video_id", _ORDER, 3), "fake_prob")


def _modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos, audio, text = X.audio_text_scores(spark, sf_dir)
    image = U.frames_mean(_frames(spark, sf_dir), "video_id", _ORDER).select("video_id", F.col("fake_prob").alias("score"))
    joined = U.join_modalities(videos, "video_id", {"image": image, "audio": audio, "text": text})
    return U.gate_text(joined)


_WSUM = "coalesce(image * 5e-1, 0e0) + coalesce(audio * 3e-1, 0e0) + coalesce(text * 2e-1, 0e0)"
_MASS = "CASE WHEN image IS NULL THEN 0e0 ELSE 5e-1 END + CASE WHEN audio IS NULL THEN 0e0 ELSE 3e-1 END + CASE WHEN text IS NULL THEN 0e0 ELSE 2e-1 END"


@query("fus_weighted", with_fixtures("modalities", f"""
SELECT video_id, CASE WHEN s IS NULL THEN 'UNKNOWN' WHEN s > 5e-1 THEN 'FAKE / AI-GENERATED' ELSE 'REAL / HUMAN' END AS final_label, {rounded('s', 4)} AS fused_score,
       image, CASE WHEN image IS NULL THEN 'No frames extracted' END AS image_error, audio, CASE WHEN audio IS NULL THEN 'Audio extraction failed' END AS audio_error,
       text, CASE WHEN text IS NOT NULL THEN NULL WHEN audio IS NULL THEN 'Audio extraction failed' ELSE 'No speech detected in audio' END AS text_error
FROM (SELECT *, ({_WSUM}) / nullif({_MASS}, 0e0) AS s FROM modalities) f"""))
def fus_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict with its nested modalities, flattened for comparison."""
    fused = U.nested_modalities(U.fuse_weighted(_modalities(spark, sf_dir)))
    parts = [F.col(f"modalities.{m}.{part}").alias(m if part == "score" else f"{m}_error") for m in U.MODALITY_ERRORS for part in ("score", "error")]
    return fused.select("video_id", "final_label", "fused_score", *parts)


@query("fus_text_gated", with_fixtures("modalities", """
SELECT video_id, audio, text, CASE WHEN audio IS NULL THEN 'Audio extraction failed' WHEN text IS NULL THEN 'No speech detected in audio' END AS text_error
FROM modalities"""))
def fus_text_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos, audio, text = X.audio_text_scores(spark, sf_dir)
    gated = U.gate_text(U.join_modalities(videos, "video_id", {"audio": audio, "text": text}))
    return gated.select("video_id", "audio", "text", "text_error")


@query("fus_rule_equal", with_fixtures("modalities", f"""
SELECT video_id, {rounded('image * (1e0 / 3e0) + audio * (1e0 / 3e0) + text * (1e0 / 3e0)')} AS score FROM modalities"""))
def fus_rule_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = U.rule_fusion(["image", "audio", "text"])
    return _modalities(spark, sf_dir).select("video_id", round_half_up(score, 6).alias("score"))


@query("fus_max", with_fixtures("modalities", "SELECT video_id, greatest(image, audio, text) AS score FROM modalities"))
def fus_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modalities(spark, sf_dir).select("video_id", U.max_fusion(["image", "audio", "text"]).alias("score"))


_GATED = "CASE WHEN greatest({0}, 1e0 - {0}) > 8e-1 THEN {1} ELSE {2} END"


@query("fus_confidence_gate", with_fixtures("modalities", f"""
SELECT video_id, {rounded(f"coalesce(({' + '.join(_GATED.format(m, m, '0e0') for m in ('image', 'audio', 'text'))}) / nullif({' + '.join(_GATED.format(m, '1e0', '0e0') for m in ('image', 'audio', 'text'))}, 0e0), 5e-1)")} AS score
FROM modalities"""))
def fus_confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["image", "audio", "text"]
    rows = _modalities(spark, sf_dir).withColumns({f"{m}_conf": F.greatest(F.col(m), F.lit(1.0) - F.col(m)) for m in names})
    score = U.gated_fusion(names, [f"{m}_conf" for m in names])
    return rows.select("video_id", round_half_up(score, 6).alias("score"))


# ---- sinks -----------------------------------------------------------------


@query("sink_predictions", with_fixtures("strategies", """
SELECT strategy, id AS file, CASE WHEN y = 1 THEN 'FAKE' ELSE 'REAL' END AS true_label, p AS fake_prob,
       CASE WHEN p > 5e-1 THEN 'FAKE' ELSE 'REAL' END AS pred_label, correct FROM strategies"""))
def sink_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written per strategy as CSV and read back."""
    root = scratch_path(spark, "by-strategy")
    rows = X.strategies(spark, sf_dir).select(
        "strategy",
        F.col("id").alias("file"),
        F.when(F.col("y") == 1, "FAKE").otherwise("REAL").alias("true_label"),
        F.col("p").alias("fake_prob"),
        D.binary_label(F.col("p")).alias("pred_label"),
        "correct",
    )
    writers.write_predictions(rows, root)
    schema = "file string, true_label string, fake_prob double, pred_label string, correct boolean, strategy string"
    return spark.read.schema(schema).option("header", True).csv(committed.part_path(spark, root, "predictions"))


@query("sink_sample_copy", """
WITH files AS (
  SELECT path, string_split(path, '/')[-1] AS name FROM (
    SELECT '/corpus/' || source || '/' || CAST(doc_id AS VARCHAR) || '/' || lang || CASE doc_id % 11 WHEN 3 THEN '_1' WHEN 5 THEN '_2' WHEN 7 THEN '_2_1' ELSE '' END || '.jpg' AS path
    FROM documents) p),
parts AS (SELECT *, regexp_replace(name, '\\.[^.]+$', '') AS stem, regexp_extract(name, '\\.[^.]+$') AS ext,
                 row_number() OVER (PARTITION BY name ORDER BY path) - 1 AS i FROM files),
names AS (SELECT DISTINCT name, stem, ext FROM parts),
owned AS (SELECT regexp_replace(stem, '_[0-9]+$', '') || ext AS parent, CAST(regexp_extract(stem, '_([1-9][0-9]*)$', 1) AS BIGINT) AS k
          FROM names WHERE regexp_matches(stem, '_[1-9][0-9]*$')),
gaps AS (SELECT parent, k - row_number() OVER (PARTITION BY parent ORDER BY k) AS free_below FROM owned)
SELECT path, CASE WHEN i = 0 THEN name ELSE stem || '_' || CAST(i + (SELECT count(*) FROM gaps WHERE parent = name AND free_below < i) AS VARCHAR) || ext END AS target_name
FROM parts""")
def sink_sample_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of few names in many folders, some already named like copies."""
    suffix = F.expr("CASE doc_id % 11 WHEN 3 THEN '_1' WHEN 5 THEN '_2' WHEN 7 THEN '_2_1' ELSE '' END")
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), "lang", suffix, F.lit(".jpg")).alias("path")
    )
    return S.collision_free_names(files, "path")


@query("sink_run_snapshot", _SUMMARY_SQL)
def sink_run_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved rows and summary written; the summary is recomputed from the written rows."""
    root = scratch_path(spark, "run")
    writers.write_run_snapshot(split_rows(spark, sf_dir), root, "split", "target", "source_platform")
    return committed.read_part(spark, root, "summary")


@query("sink_decision_config", with_fixtures("scored", f"""{CALIBRATION_CTES}
SELECT 'local/linear' AS model_repo, 'sigmoid(logit/temperature) >= threshold' AS decision_type, temperature, threshold_calibrated AS threshold,
       2e-1 AS val_ratio, 42 AS seed FROM ({CALIBRATION_FIT}) f"""))
def sink_decision_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration as written and read back, flattened and rounded for comparison."""
    root = scratch_path(spark, "config")
    report = C.calibration_report(X.scored(spark, sf_dir), test_metrics=False)
    writers.write_json(writers.decision_config_frame(spark, report, "local/linear"), root)
    schema = (
        "model_repo string, decision_type string, temperature double, threshold double,"
        " fit_split struct<val_ratio: double, seed: int>"
    )
    written = spark.read.schema(schema).json(root).select("model_repo", "decision_type", "temperature", "threshold", "fit_split.*")
    return round_columns(round_columns(written, "temperature", digits=4), "threshold")


@query("sink_report", with_fixtures("scored", f"""{CALIBRATION_CTES}
SELECT v.*, n_samples, n_val, n_samples - n_val AS n_test, temperature, threshold_raw, threshold_calibrated
FROM ({CALIBRATION_VARIANTS}) v, ({CALIBRATION_FIT}) f,
     (SELECT CAST(sum(c) AS BIGINT) AS n_samples FROM classes) s, (SELECT CAST(sum(quota) AS BIGINT) AS n_val FROM quotas) q"""))
def sink_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as written and read back: one row per set of test metrics, rounded for comparison."""
    root = scratch_path(spark, "report")
    report = C.calibration_report(X.scored(spark, sf_dir))
    sizes = {"n_samples": report.n_val + report.n_test, "n_val": report.n_val, "n_test": report.n_test}
    counts = spark.range(1).select(*[F.lit(n).cast("long").alias(name) for name, n in sizes.items()])
    frame = writers.report_frame(report, "local/linear", sf_dir, counts)
    writers.write_json(frame, root)
    written = spark.read.schema(frame.schema).json(root)
    names = [c.removeprefix("test_metrics_") for c in written.columns if c.startswith("test_metrics_")]
    sets = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(f"test_metrics_{n}").alias("m")) for n in names])
    whole = [F.col(c).cast("long").alias(c) for c in ("n_samples", "n_val", "n_test")]
    fitted = ["temperature", "threshold_raw", "threshold_calibrated"]
    flat = written.select(*whole, *fitted, F.inline(sets)).select("variant", "m.*", "n_samples", "n_val", "n_test", *fitted)
    return round_columns(round_columns(flat, "temperature", digits=4), *METRICS, "threshold_raw", "threshold_calibrated")


# ---- streams ---------------------------------------------------------------


def _events_input(spark: SparkSession, sf_dir: str) -> jobs.BoundedInput:
    schema = table(spark, sf_dir, "events").schema
    return jobs.BoundedInput(spark, f"{sf_dir}/events.parquet", schema, event_type="view")


_TRACKED = """SELECT job_id, CASE WHEN step IN ('frames', 'frames_done') THEN 'frame' ELSE 'audio' END AS track,
  CASE WHEN step LIKE '%\\_done' ESCAPE '\\' THEN 'Done' WHEN step LIKE '%\\_error' ESCAPE '\\' THEN 'Error' ELSE 'Running' END AS status, ts, event_id
  FROM progress WHERE step <> 'complete'"""


@query("str_progress_fold", with_fixtures("progress", f"""
SELECT job_id, track, status FROM (SELECT *, row_number() OVER (PARTITION BY job_id, track ORDER BY ts DESC, event_id DESC) AS rn FROM ({_TRACKED}) t) r WHERE rn = 1"""))
def str_progress_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream in update mode."""
    path = f"{sf_dir}/events.parquet"
    events = jobs.read_parquet_stream(spark, path, table(spark, sf_dir, "events").schema)
    status = P.progress_status(X.progress_events(events), delay="10 minutes")
    return jobs.run_update(status, ["job_id", "track"], "progress").select("job_id", "track", "status")


@query("str_job_terminal", with_fixtures("progress", """
WITH gaps AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id)) < 300000000 THEN 0 ELSE 1 END AS opens FROM progress),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM gaps)
SELECT job_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS last_event, count(*) AS events,
       CASE WHEN bool_or(step IN ('complete', 'error')) THEN 'finished' ELSE 'timed_out' END AS outcome FROM runs GROUP BY job_id, run"""))
def str_job_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = P.job_sessions(X.progress(spark, sf_dir))
    return ended.withColumns({c: F.unix_micros(c) for c in ("started", "last_event")})


@query("str_job_terminal_stream", ORACLES["str_job_terminal"])
def str_job_terminal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream, up to the end of the input."""
    source = _events_input(spark, sf_dir)
    ended = P.job_sessions_stream(X.progress_events(source.frame))
    return jobs.run_append(ended, "terminal", source)[0].withColumns({c: F.unix_micros(c) for c in ("started", "last_event")})


@query("str_score", ORACLES["txt_ai_score"])
def str_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored as they arrive, by the batch functions."""
    schema = table(spark, sf_dir, "documents").schema
    stream = jobs.read_parquet_stream(spark, f"{sf_dir}/documents.parquet", schema)
    scored = jobs.score_stream(stream, documents.score_documents).select("doc_id", round_half_up(F.col("ai_score"), 6).alias("ai_score"))
    return jobs.run_append(scored, "scored")[0]


_SESSION_SCORE = "floor(least(value / 5e2, 1e0) * 1e4 + 5e-1) / 1e4"


_REPORTS = f"""reports AS (SELECT user_id, epoch_us(ts) AS tick, modality, CASE WHEN event_type IN ('view', 'click', 'signup') THEN {_SESSION_SCORE} END AS score,
                  CASE event_type WHEN 'error' THEN 'Audio extraction failed' WHEN 'purchase' THEN 'No speech detected in audio' END AS error
            FROM (SELECT *, CASE WHEN event_type = 'view' THEN 'image' WHEN event_type IN ('click', 'error') THEN 'audio' ELSE 'text' END AS modality FROM events
                  WHERE event_type IN ('view', 'click', 'signup', 'error', 'purchase')) e)"""


@query("str_fuse_batch", f"""
WITH {_REPORTS},
gaps AS (SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY user_id ORDER BY tick) < 3600000000 THEN 0 ELSE 1 END AS opens FROM reports),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY tick RANGE UNBOUNDED PRECEDING) AS run FROM gaps),
firsts AS (SELECT user_id, run, min(tick) AS opened, min(tick) FILTER (WHERE modality = 'image') AS i, min(tick) FILTER (WHERE modality = 'audio') AS a,
                  min(tick) FILTER (WHERE modality = 'text' OR modality = 'audio' AND score IS NULL) AS t FROM runs GROUP BY user_id, run),
ends AS (SELECT *, CASE WHEN i IS NOT NULL AND a IS NOT NULL AND t IS NOT NULL THEN greatest(i, a, t) END AS done FROM firsts),
counted AS (SELECT runs.*, opened, done FROM runs JOIN ends ON runs.user_id = ends.user_id AND runs.run = ends.run WHERE done IS NULL OR tick <= done),
held AS (SELECT user_id AS video_id, min(opened) AS opened, count(*) AS results, CASE WHEN max(done) IS NULL THEN 'timeout' ELSE 'complete' END AS reason,
                bool_or(modality = 'audio' AND score IS NULL) AS no_audio,
                {", ".join(f"max(score) FILTER (WHERE modality = '{m}' AND tick = last_{m} AND score IS NOT NULL) AS {m}, max(error) FILTER (WHERE modality = '{m}' AND tick = last_{m}) AS {m}_said, count(*) FILTER (WHERE modality = '{m}') AS {m}_n" for m in ("image", "audio", "text"))}
         FROM (SELECT *, {", ".join(f"max(tick) FILTER (WHERE modality = '{m}') OVER (PARTITION BY user_id, run) AS last_{m}" for m in ("image", "audio", "text"))} FROM counted) c
         GROUP BY user_id, run)
SELECT video_id, opened, results, reason, image, audio, text,
       CASE WHEN image_n = 0 THEN 'No result in time' WHEN image IS NULL THEN image_said END AS image_error,
       CASE WHEN audio_n = 0 THEN 'No result in time' WHEN audio IS NULL THEN audio_said END AS audio_error,
       CASE WHEN text_n = 0 AND no_audio THEN 'Audio extraction failed' WHEN text_n = 0 THEN 'No result in time' WHEN text IS NULL THEN text_said END AS text_error,
       CASE WHEN s IS NULL THEN 'UNKNOWN' WHEN s > 5e-1 THEN 'FAKE / AI-GENERATED' ELSE 'REAL / HUMAN' END AS final_label, {rounded('s', 4)} AS fused_score
FROM (SELECT *, ({_WSUM}) / nullif({_MASS}, 0e0) AS s FROM held) f""")
def str_fuse_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch twin of the fusing stream; a job is silent for an hour at its end."""
    fused = stream_fusion.fuse_results(modality_results(table(spark, sf_dir, "events")), timeout_seconds=3600)
    return fused.withColumn("opened", F.unix_micros("opened"))


@query("str_fuse", ORACLES["str_fuse_batch"])
def str_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream, up to the end of the input: a verdict leaves with the result that completes it."""
    source = _events_input(spark, sf_dir)
    fused = stream_fusion.fuse_results(modality_results(source.frame), timeout_seconds=3600, delay="10 minutes")
    return jobs.run_append(fused, "fused", source)[0].withColumn("opened", F.unix_micros("opened"))


def modality_results(events: DataFrame) -> DataFrame:
    """Views, clicks and sign-ups stand for image, audio and text results, errors for failed audio, purchases for audio without speech."""
    kind = F.col("event_type")
    modality = F.when(kind == "view", "image").when(kind.isin("click", "error"), "audio").when(kind.isin("signup", "purchase"), "text")
    score = round_half_up(F.least(F.col("value") / F.lit(500.0), F.lit(1.0)), 4)
    return events.select(
        F.col("user_id").alias("video_id"),
        modality.alias("modality"),
        F.when(kind.isin("view", "click", "signup"), score).alias("score"),
        F.when(kind == "error", U.MODALITY_ERRORS["audio"]).when(kind == "purchase", U.MODALITY_ERRORS["text"]).alias("error"),
        X.instant(events, "ts").alias("ts"),
    ).filter(F.col("modality").isNotNull())


# ---- training --------------------------------------------------------------


_VECTOR_SPLIT = """classes AS (SELECT y, count(*) AS c FROM vectors GROUP BY y),
shares AS (SELECT y, c, sum(c) OVER () AS n, sum(c) OVER () - CAST(ceil(8e-1 * sum(c) OVER ()) AS BIGINT) AS total FROM classes),
bases AS (SELECT y, total, (c * total) // n AS base, row_number() OVER (ORDER BY (c * total) % n DESC, y) AS place FROM shares),
quotas AS (SELECT y, base + CASE WHEN place <= total - (SELECT sum(base) FROM bases) THEN 1 ELSE 0 END AS quota FROM bases),
halves AS (SELECT vec_id, r.y, CASE WHEN rk > quota THEN 'training' WHEN substr(md5('half:' || vec_id), 1, 1) < '8' THEN 'test' ELSE 'validation' END AS split
           FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(vec_id || ':42'), CAST(vec_id AS VARCHAR)) AS rk FROM vectors) r JOIN quotas q ON r.y = q.y)"""


def _split_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their sum of magnitudes behind them, split into training, validation and test; written once."""
    rows = X.vectors(spark, sf_dir).withColumn("energy", F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)))
    split = S.stratified_split(rows, "y", "vec_id", 0.2, SEED)
    half = F.substring(F.md5(F.concat(F.lit("half:"), F.col("vec_id").cast("string"))), 1, 1) < "8"
    named = F.when(F.col("split") != "val", "training").when(half, "test").otherwise("validation")
    return cut_lineage(split.select("vec_id", "y", F.concat("v", F.array("energy")).alias("features"), named.alias("split")))


def _training_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("split <> 'test'").withColumn("fits", F.col("split") == "training")


_ENERGY_AT = 64
_STOPPING = {"epochs": 12, "patience": 3}


@query("ml_epoch_log")
def ml_epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training by epochs: the log of two learning rates, with the epochs whose weights were kept."""
    rows = _split_vectors(spark, sf_dir)
    runs = epochs.train_epochs(_training_rows(rows), [epochs.Setting(0.5, tuple(range(64)), "fast"), epochs.Setting(0.01, tuple(range(64)), "slow")], **_STOPPING)
    return round_columns(epochs.epoch_log(rows, runs), "train_loss", "val_loss", "acc", "sens", "spec", "f1", "auc", digits=4)


@query("ml_train_detector", with_fixtures("vectors", f"""
WITH {_VECTOR_SPLIT}
SELECT split, count(*) AS rows, count(*) FILTER (WHERE y = 1) AS fakes, TRUE AS epochs_follow, TRUE AS best_is_first_largest, TRUE AS stops_by_patience, TRUE AS weights_are_the_best
FROM halves GROUP BY split"""))
def ml_train_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector trained by epochs, its rows per split, and whether its log keeps the rules: the operators on
    training logs agree with what training did, and the kept weights score as the log says of their epoch."""
    rows = _split_vectors(spark, sf_dir)
    (run,) = epochs.train_epochs(_training_rows(rows), [epochs.Setting(0.5, tuple(range(64)), "detector")], metric="f1", **_STOPPING)
    log = epochs.epoch_log(rows, [run])
    best = L.best_epoch(log, "f1").first()
    stop = L.early_stop(log, "f1", patience=_STOPPING["patience"]).first()
    held = epochs.with_score(rows.filter("split = 'validation'"), run.weights)
    again = E.prf(held, inclusive=False).first()
    rules = {
        "epochs_follow": [r["epoch"] for r in run.log] == list(range(len(run.log))),
        "best_is_first_largest": (best.best_epoch, best.best_f1) == (run.best_epoch, run.best),
        "stops_by_patience": (stop.stop_epoch, stop.restored_epoch) == (run.log[-1]["epoch"], run.best_epoch),
        "weights_are_the_best": abs(again.f1 - run.best) < 1e-9,
    }
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("y") == 1).alias("fakes"))
    return counts.withColumns({name: F.lit(bool(value)) for name, value in rules.items()})


_TRIALS, _LOW, _HIGH = 9, 1e-3, 1.0
_UNIT = "CAST(('0x' || substr(md5('{}:' || i || ':42'), 1, 12)) AS BIGINT) / CAST(16 ** 12 AS DOUBLE)"


def _search(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[epochs.Setting], list[epochs.Rung]]:
    rows = _split_vectors(spark, sf_dir)
    settings = epochs.draw_settings(_TRIALS, _LOW, _HIGH, {"vector": range(_ENERGY_AT), "vector_energy": range(_ENERGY_AT + 1)}, SEED)
    return rows, settings, epochs.halving_search(_training_rows(rows), "vec_id", settings, 3, epochs=4, seed=SEED)


@query("ml_trial_search", with_fixtures("vectors", f"""
WITH {_VECTOR_SPLIT},
trials AS (SELECT i, ln(1e-3) + {_UNIT.format('rate')} * (ln(1e0) - ln(1e-3)) AS log_rate, {_UNIT.format('features')} AS pick FROM (SELECT unnest(range({_TRIALS})) AS i) r),
places AS (SELECT split, CAST(('0x' || substr(md5(vec_id || ':42'), 1, 8)) AS BIGINT) / CAST(16 ** 8 AS DOUBLE) AS place FROM halves),
sizes AS (SELECT count(*) FILTER (WHERE split = 'training' AND place < 1e0 / 9) AS small_rows, count(*) FILTER (WHERE split = 'training' AND place < 1e0 / 3) AS middle_rows,
                 count(*) FILTER (WHERE split = 'training') AS all_rows, count(*) FILTER (WHERE split = 'test') AS test_rows FROM places)
SELECT CAST(i AS INT) AS trial, {rounded('log_rate')} AS log_rate, CASE WHEN pick < 5e-1 THEN 'vector' ELSE 'vector_energy' END AS features, small_rows, middle_rows, all_rows, test_rows,
       CAST(3 AS INT) AS rungs, TRUE AS best_leads_its_rungs FROM trials, sizes"""))
def ml_trial_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws of the search, the rows of its rungs and of the test, and whether the best trial leads every rung's survivors at the end."""
    rows, settings, rungs = _search(spark, sf_dir)
    best = rungs[-1].runs[0]
    survived = all(best.setting.name in [r.setting.name for r in rung.runs[: max(1, -(-rung.settings // 3))]] for rung in rungs)
    sizes = {name: rung.rows for name, rung in zip(("small_rows", "middle_rows", "all_rows"), rungs, strict=True)}
    sizes["test_rows"] = rows.filter("split = 'test'").count()
    drawn = [(int(s.name.split(":")[0]), math.log(s.rate), s.name.split(":")[1]) for s in settings]
    return round_columns(spark.createDataFrame(drawn, "trial int, log_rate double, features string"), "log_rate").withColumns(
        {k: F.lit(v).cast("long") for k, v in sizes.items()} | {"rungs": F.lit(len(rungs)), "best_leads_its_rungs": F.lit(survived)}
    )


@query("ml_trial_report")
def ml_trial_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation AUC of every trial at the last rung it reached, and the test metrics of the best one, which was fitted on all training rows."""
    rows, _, rungs = _search(spark, sf_dir)
    reached = {run.setting.name: (number, rung.rows, run.best) for number, rung in enumerate(rungs) for run in rung.runs}
    trials = spark.createDataFrame([(name, *what) for name, what in reached.items()], "trial string, rung int, rows long, auc double")
    best = rungs[-1].runs[0]
    test = epochs.with_score(rows.filter("split = 'test'"), best.weights)
    metrics = E.prf(test, inclusive=False).select("accuracy", "precision", "recall", "f1")
    metrics = beside(metrics, R.roc_auc(test))
    tested = metrics.select(F.lit(best.setting.name).alias("trial"), *[F.col(c).alias(f"test_{c}") for c in metrics.columns])
    whole = trials.join(F.broadcast(tested), "trial", "left")
    return round_columns(whole, "auc", *[c for c in whole.columns if c.startswith("test_")], digits=4)
