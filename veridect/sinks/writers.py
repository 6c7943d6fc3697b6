"""Writers. Every function writes from the tasks and returns nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridect.operators.calibration import CalibrationReport
from veridect.operators.labels import split_summary
from veridect.operators.ordered import beside
from veridect.sinks.committed import commit, read_part


#: Folders that a task of ``write_predictions`` keeps open at once; beyond them it sorts its rows by folder.
OPEN_FOLDERS = 32


def write_predictions(df: DataFrame, path: str, partition_by: str | None = "strategy", fmt: str = "csv") -> None:
    """Predictions, one folder per strategy, published as part ``predictions`` of ``path`` (see ``committed``).

    Strategies are few, so every task keeps a file open for each of them and
    writes its rows as they come: they are neither shuffled nor sorted.
    """
    spark, limit = df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"

    def write(folder: str) -> None:
        writer = df.write.format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"')
        if partition_by:
            writer = writer.partitionBy(partition_by)
        before = spark.conf.get(limit)
        spark.conf.set(limit, max(int(before), OPEN_FOLDERS))
        try:
            writer.save(folder)
        finally:
            spark.conf.set(limit, before)

    commit(spark, path, {"predictions": write})


def decision_config_frame(spark: SparkSession, report: CalibrationReport, model_repo: str) -> DataFrame:
    return spark.range(1).select(
        F.lit(model_repo).alias("model_repo"),
        F.lit("sigmoid(logit/temperature) >= threshold").alias("decision_type"),
        F.lit(report.fit.temperature).alias("temperature"),
        F.lit(report.threshold_calibrated).alias("threshold"),
        F.struct(F.lit(report.val_ratio).alias("val_ratio"), F.lit(report.seed).alias("seed")).alias("fit_split"),
    )


def report_frame(report: CalibrationReport, model_repo: str, data_dir: str, counts: DataFrame) -> DataFrame:
    """The full report in one nested row. ``counts`` holds n_samples, n_val, n_test."""
    names = [c for c in report.metrics.columns if c != "variant"]

    def variant(name: str):
        return F.max(F.when(F.col("variant") == name, F.struct(*names)))

    metrics = report.metrics.agg(
        variant("baseline_t05").alias("test_metrics_baseline_t05"),
        variant("threshold_only").alias("test_metrics_threshold_only"),
        variant("threshold_plus_calibration").alias("test_metrics_threshold_plus_calibration"),
    )
    return beside(counts, metrics).select(
        F.lit(model_repo).alias("model_repo"),
        F.lit(data_dir).alias("data_dir"),
        F.lit(report.val_ratio).alias("val_ratio"),
        F.lit(report.seed).alias("seed"),
        "n_samples",
        "n_val",
        "n_test",
        F.lit(report.fit.temperature).alias("temperature"),
        F.lit(report.threshold_raw).alias("threshold_raw"),
        F.lit(report.threshold_calibrated).alias("threshold_calibrated"),
        *[c for c in metrics.columns],
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_run_snapshot(df: DataFrame, path: str, split: str, target: str, platform: str) -> None:
    """Resolved rows by split (part ``frames``) and the summary of what was written (part ``summary``), published together."""
    written: list[DataFrame] = []

    def frames(folder: str) -> None:
        df.write.partitionBy(split).parquet(folder)
        # the schema is given: a split's name is text, whatever it looks like
        written.append(df.sparkSession.read.schema(df.schema).parquet(folder))

    def summary(folder: str) -> None:
        split_summary(written[0], split, target, platform).write.parquet(folder)

    commit(df.sparkSession, path, {"frames": frames, "summary": summary})


def write_scored(scored: DataFrame, path: str, error: str = "error") -> dict[str, int]:
    """Scored rows (part ``scored``) with the failed ones apart, written in one pass; returns how many there are of each.

    Rows go to folders ``failed=false`` and ``failed=true``, where they are
    counted, so the model runs once.
    """
    marked = scored.withColumn("failed", F.col(error).isNotNull())
    commit(scored.sparkSession, path, {"scored": lambda folder: marked.write.partitionBy("failed").parquet(folder)})
    # the written files say how many there are; the model does not run again
    written = read_part(scored.sparkSession, path, "scored", T.StructType([*scored.schema.fields, T.StructField("failed", T.BooleanType())]))
    found = {row["failed"]: row["count"] for row in written.groupBy("failed").count().collect()}
    return {"good": found.get(False, 0), "failed": found.get(True, 0)}


def read_scored(spark: SparkSession, path: str, schema: T.StructType, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows, without the error column, and failed ones; ``schema`` is that of the scored rows."""
    whole = T.StructType([*schema.fields, T.StructField("failed", T.BooleanType())])
    rows = read_part(spark, path, "scored", whole)
    return rows.filter("NOT failed").drop("failed", error), rows.filter("failed").drop("failed")
