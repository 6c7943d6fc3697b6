"""Typed readers of evaluation shards, split files and prediction files."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridect.sources.csv_files import NamedCsv, read_named_csv
from veridect.sources.manifests import require_rows

EVAL_SCHEMA = T.StructType(
    [
        T.StructField("image_data", T.BinaryType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("model_name", T.StringType()),
    ]
)
SPLIT_SCHEMA = T.StructType(
    [
        T.StructField("filepath", T.StringType()),
        T.StructField("target", T.IntegerType()),
        T.StructField("skip_time", T.DoubleType()),
        T.StructField("source_platform", T.StringType()),
    ]
)
PREDICTION_TEXT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("file", "true_label", "fake_prob", "real_prob", "pred_label", "correct")]
)


def read_eval_shards(spark: SparkSession, path: str, columns: tuple[str, ...] = ("image_data", "label", "model_name")) -> DataFrame:
    """The evaluation columns of all shards. Empty shards are harmless, an
    empty set of shards is an error."""
    return require_rows(spark.read.parquet(path).select(*columns), path)


def read_latest_snapshot(spark: SparkSession, root: str, key: str = "snapshot") -> DataFrame:
    """Rows of the lexicographically last ``key=`` directory, whose name stays text.

    Only the names of the directories below ``root`` are listed, one per
    snapshot, and one of them is read.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in system.listStatus(at) if status.isDirectory()]
    values = [name.removeprefix(f"{key}=") for name in names if name.startswith(f"{key}=")]
    if not values:
        raise FileNotFoundError(f"no snapshot below {root}")
    latest = max(values, key=unquote)
    return spark.read.parquet(f"{root.rstrip('/')}/{key}={latest}").withColumn(key, F.lit(unquote(latest)))


def split_files(spark: SparkSession, paths: Mapping[str, str], schema: T.StructType = SPLIT_SCHEMA) -> dict[str, NamedCsv]:
    """Each split's CSV (file or folder), its columns found by name, and the records that do not fit."""
    return {split: read_named_csv(spark, path, schema, ("filepath", "target")) for split, path in paths.items()}


def read_split_files(spark: SparkSession, paths: Mapping[str, str], schema: T.StructType = SPLIT_SCHEMA) -> DataFrame:
    """The rows of :func:`split_files`, with the split name attached."""
    frames = [found.rows.withColumn("split", F.lit(split)) for split, found in split_files(spark, paths, schema).items()]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def parse_truth(text: Column) -> Column:
    """``true``/``false`` in any case, else truthiness: numbers other than 0,
    any other text, and missing values count as true."""
    low = F.lower(F.btrim(text))
    number = text.try_cast("double")
    return (
        F.when(low == "true", True)
        .when(low == "false", False)
        .when(number.isNotNull(), number != 0.0)
        .otherwise(F.coalesce(text != "", F.lit(True)))
    )


def normalize_predictions(raw: DataFrame) -> DataFrame:
    """Upper-cased labels, numeric scores, boolean ``correct``; rows without a
    usable score are dropped."""

    def number(name: str) -> Column:
        return F.nullif(F.col(name).try_cast("double"), F.lit(float("nan")))

    return (
        raw.withColumns(
            {
                "true_label": F.upper("true_label"),
                "fake_prob": number("fake_prob"),
                "real_prob": number("real_prob"),
                "correct": parse_truth(F.col("correct")),
            }
        )
        .na.drop(subset=["fake_prob"])
    )


def prediction_files(spark: SparkSession, path: str) -> NamedCsv:
    """Predictions CSVs with or without ``real_prob``, in any order of columns, still as text."""
    return read_named_csv(spark, path, PREDICTION_TEXT_SCHEMA, ("true_label", "fake_prob", "correct"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`prediction_files`, normalised; columns that a file lacks are NULL."""
    return normalize_predictions(prediction_files(spark, path).rows)


def coalesce_results(df: DataFrame, result: str) -> DataFrame:
    """Label and score from result objects whose field names differ by detector.

    The first field that exists wins, as a dictionary lookup with defaults
    would do; a score that is not a JSON number is not used.
    """
    fields = F.from_json(F.col(result), "map<string,string>")
    parsed = F.try_parse_json(F.col(result))

    def has(name: str) -> Column:
        return F.map_contains_key(fields, F.lit(name))

    def get(name: str) -> Column:
        return F.try_element_at(fields, F.lit(name))

    def number(name: str) -> Column:
        """The field if it is written as a number: quotes make it text, whatever it holds."""
        value = F.try_variant_get(parsed, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(parsed, f"$.{name}", "double"))

    label = F.when(has("prediction"), get("prediction")).when(has("label"), get("label")).otherwise("UNKNOWN")
    score = (
        F.when(has("prob_fake"), number("prob_fake"))
        .when(has("fake_probability"), number("fake_probability"))
        .otherwise(number("score"))
    )
    return df.withColumns({"prediction": label, "prob_fake": score})


def load_config(path: str) -> dict[str, Any]:
    """A JSON settings file, or YAML where a parser is installed."""
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as problem:
            raise RuntimeError("reading YAML needs the yaml package; use JSON") from problem
        return yaml.safe_load(text)
    return json.loads(text)
