"""Training a detector on feature columns and searching its settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    """Numeric and array columns as one feature vector."""
    arrays = {c for c, t in df.dtypes if t.startswith("array")}
    ready = df.withColumns({f"_v_{c}": array_to_vector(F.col(c)) for c in columns if c in arrays})
    inputs = [f"_v_{c}" if c in arrays else c for c in columns]
    return VectorAssembler(inputCols=inputs, outputCol=name).transform(ready).drop(*[f"_v_{c}" for c in columns if c in arrays])


def train_detector(
    train: DataFrame, y: str = "y", features: str = "features", reg: float = 0.01, elastic_net: float = 0.0, max_iter: int = 50
) -> PipelineModel:
    model = LogisticRegression(
        labelCol=y, featuresCol=features, regParam=reg, elasticNetParam=elastic_net, maxIter=max_iter
    )
    return Pipeline(stages=[model]).fit(train)


def predict(model: Any, df: DataFrame, features: str = "features", name: str = "p") -> DataFrame:
    scored = model.transform(df).withColumn(name, F.get(vector_to_array("probability"), F.lit(1)))
    return scored.drop("rawPrediction", "probability", "prediction", features)


def trial_search(
    df: DataFrame,
    feature_sets: Mapping[str, Sequence[str]],
    regs: Sequence[float] = (1e-5, 1e-4, 1e-3, 1e-2),
    elastic_nets: Sequence[float] = (0.0, 0.5),
    y: str = "y",
    split: str = "split",
    train: str = "training",
    validation: str = "validation",
    parallelism: int = 4,
) -> tuple[list[dict[str, Any]], PipelineModel]:
    """Every setting fitted on the training split and ranked by validation AUC.

    The split column is kept as given. Returns the trials, best first, and the
    best setting refitted.
    """
    trials: list[dict[str, Any]] = []
    evaluator = BinaryClassificationEvaluator(labelCol=y, rawPredictionCol="rawPrediction", numBins=0)
    for name, columns in feature_sets.items():
        ready = assemble(df.select(y, split, *columns), columns).select(y, split, "features")
        fitting = ready.filter(F.col(split) == train).persist(StorageLevel.MEMORY_AND_DISK)
        holdout = ready.filter(F.col(split) == validation).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            base = LogisticRegression(labelCol=y, featuresCol="features", maxIter=30)
            settings = list(product(regs, elastic_nets))
            maps = [{base.regParam: r, base.elasticNetParam: e} for r, e in settings]
            models = base.fitMultiple(fitting, maps)

            def one(_: int) -> tuple[int, float]:
                index, model = next(models)
                return index, evaluator.evaluate(model.transform(holdout))

            with ThreadPoolExecutor(parallelism) as pool:
                for index, auc in pool.map(one, range(len(maps))):
                    reg, elastic = settings[index]
                    trials.append({"feature_set": name, "reg": reg, "elastic_net": elastic, "auc": auc})
        finally:
            fitting.unpersist()
            holdout.unpersist()
    trials.sort(key=lambda t: (-t["auc"], t["feature_set"], t["reg"], t["elastic_net"]))
    best = trials[0]
    columns = feature_sets[best["feature_set"]]
    rows = assemble(df.filter(F.col(split) == train), columns)
    return trials, train_detector(rows, y, reg=best["reg"], elastic_net=best["elastic_net"])
