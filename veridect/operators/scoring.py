"""Batch scoring with a pluggable model, and summaries of its results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridect.functions.numeric import safe_ratio

ON_ERROR = ("skip", "zero", "fail")
_MODELS: dict[Any, Any] = {}


class Scorer(Protocol):
    """A model for :func:`score_batches`.

    ``key`` names the loaded model, so a Python worker loads it once and keeps
    it. ``score`` returns fake probabilities for the rows of a frame, ``zero``
    that of an all-zero input. Rows where a ``required`` column is NULL are
    never passed to ``score``.
    """

    key: Any
    required: tuple[str, ...]

    def load(self) -> Any: ...

    def score(self, model: Any, rows: pd.DataFrame) -> Sequence[float]: ...

    def zero(self, model: Any) -> float: ...


class LinearScorer:
    """Logistic score of a feature array."""

    def __init__(self, weights: Sequence[float], bias: float = 0.0, features: str = "features"):
        self.weights, self.bias, self.features = tuple(weights), bias, features
        self.key = ("linear", self.weights, bias)
        self.required = (features,)

    def load(self) -> np.ndarray:
        return np.asarray(self.weights, dtype=float)

    def score(self, model: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        matrix = np.asarray([np.asarray(v, dtype=float) for v in rows[self.features]])
        return 1.0 / (1.0 + np.exp(-(matrix @ model + self.bias)))

    def zero(self, model: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-self.bias)))


def loaded(scorer: Scorer) -> Any:
    if scorer.key not in _MODELS:
        _MODELS[scorer.key] = scorer.load()
    return _MODELS[scorer.key]


def score_batches(df: DataFrame, scorer: Scorer, on_error: str = "skip", name: str = "p") -> DataFrame:
    """Adds the score and an ``error`` column, batch by batch in the tasks.

    ``skip`` leaves the score NULL and the message in ``error`` (see
    :func:`split_errors`), ``zero`` scores an all-zero input instead and keeps
    the message, ``fail`` stops the job. A batch is scored at once; one that
    fails is halved until the bad rows are alone, so k bad rows among n cost
    about k log n calls.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(scorer)
        for rows in batches:
            if rows.empty:
                continue
            values = np.full(len(rows), np.nan)
            errors: list[str | None] = [None] * len(rows)

            def failed(at: int, message: str) -> None:
                errors[at] = message
                if on_error == "zero":
                    values[at] = scorer.zero(model)

            missing = rows[list(scorer.required)].isna().any(axis=1).to_numpy()
            if missing.any() and on_error == "fail":
                raise ValueError(f"NULL in {scorer.required}")
            for at in np.flatnonzero(missing):
                failed(int(at), f"ValueError: NULL in {', '.join(scorer.required)}")
            parts = [np.flatnonzero(~missing)]
            while parts:
                part = parts.pop()
                if not len(part):
                    continue
                try:
                    scores = np.asarray(scorer.score(model, rows.iloc[part]), dtype=float)
                    if scores.shape != (len(part),):
                        raise ValueError(f"expected {len(part)} scores, got shape {scores.shape}")
                    values[part] = scores
                except Exception as problem:
                    if on_error == "fail":
                        raise
                    if len(part) == 1:
                        failed(int(part[0]), f"{type(problem).__name__}: {problem}")
                    else:
                        parts += [part[: len(part) // 2], part[len(part) // 2 :]]
            yield rows.assign(**{name: values, "error": errors})

    scored = df.mapInPandas(run, schema)
    return scored.withColumn(name, F.nullif(F.col(name), F.lit(float("nan"))))


def split_errors(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and the side output of rows that failed."""
    return scored.filter(F.col("error").isNull()).drop("error"), scored.filter(F.col("error").isNotNull())


def batch_summary(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows, and fake and real counts with their share in percent."""
    fake = F.col(label) == "FAKE"
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(fake).alias("fake_count"),
        F.count_if(~fake).alias("real_count"),
    ).withColumns(
        {
            "fake_percent": safe_ratio(F.col("fake_count"), F.col("total")) * F.lit(100.0),
            "real_percent": safe_ratio(F.col("real_count"), F.col("total")) * F.lit(100.0),
        }
    )
