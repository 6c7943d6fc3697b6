"""Training by epochs in the tasks, for one setting or many at once.

A setting is a learning rate and a choice of features; its model is logistic.
In each epoch every task runs mini-batch steps over its rows from the same
weights, and the tasks' weights are averaged by rows. The pass that trains an
epoch also evaluates the weights it starts from on the validation rows, so an
epoch costs one pass, whatever the number of settings. Only weights and counts
reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridect.operators.sampling import hash_key

#: Cells of the scores from which the area under the curve is counted.
SCORE_CELLS = 10_000
_PARTS = "kind string, setting int, value array<double>"


@dataclass(frozen=True)
class Setting:
    """``features`` are positions in the feature array; all if empty."""

    rate: float
    features: tuple[int, ...] = ()
    name: str = ""


@dataclass
class Run:
    """The log of a setting, a row an epoch, and the weights of its best one; the bias is the last weight."""

    setting: Setting
    log: list[dict[str, Any]] = field(default_factory=list)
    weights: np.ndarray | None = None
    best_epoch: int = -1
    best: float = -math.inf

    def note(self, row: dict[str, Any], weights: np.ndarray, metric: str) -> None:
        row["saved"] = row[metric] > self.best
        if row["saved"]:
            self.best, self.best_epoch, self.weights = row[metric], row["epoch"], weights.copy()
        self.log.append(row)

    def waited(self) -> int:
        return self.log[-1]["epoch"] - self.best_epoch if self.log else 0


def _probability(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _pass(
    rows: DataFrame, weights: np.ndarray, masks: np.ndarray, rates: np.ndarray, epoch: int, batch_rows: int, seed: int, steps: bool
) -> DataFrame:
    """Weight sums and evaluation counts of all settings, a few rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
        w, trained, loss = weights.copy(), 0, np.zeros(len(weights))
        cells = np.zeros((len(weights), 2, SCORE_CELLS + 1))
        held = np.zeros((len(weights), 6))  # tp, fp, tn, fn, loss and rows of the validation
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("features").to_pylist(), dtype=float)
            x = np.hstack([x, np.ones((len(x), 1))])
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            fits = batch.column("fits").to_numpy(zero_copy_only=False).astype(bool)
            p = _probability(x[~fits] @ weights.T)
            truth = y[~fits][:, None] == 1
            hit = p > 0.5
            safe = np.clip(p, 1e-12, 1 - 1e-12)
            for i, part in enumerate((hit & truth, hit & ~truth, ~hit & ~truth, ~hit & truth)):
                held[:, i] += part.sum(axis=0)
            held[:, 4] -= np.where(truth, np.log(safe), np.log(1 - safe)).sum(axis=0)
            held[:, 5] += len(p)
            place = np.round(p * SCORE_CELLS).astype(int)
            for s in range(len(weights)):
                for label in (0, 1):
                    cells[s, label] += np.bincount(place[truth[:, 0] == label, s], minlength=SCORE_CELLS + 1)
            if not steps:
                continue
            order = rng.permutation(np.flatnonzero(fits))
            for start in range(0, len(order), batch_rows):
                some = order[start : start + batch_rows]
                guess = _probability(x[some] @ w.T)
                safe = np.clip(guess, 1e-12, 1 - 1e-12)
                loss -= np.where(y[some][:, None] == 1, np.log(safe), np.log(1 - safe)).sum(axis=0)
                w -= rates[:, None] * ((guess - y[some][:, None]).T @ x[some] / len(some)) * masks
                trained += len(some)
        out = []
        for s in range(len(weights)):
            out.append(("weights", s, [*(w[s] * trained), loss[s], float(trained)]))
            out.append(("held", s, held[s].tolist()))
            for label in (0, 1):
                used = np.flatnonzero(cells[s, label])
                out.append((f"cells{label}", s, [v for c in used for v in (float(c), cells[s, label, c])]))
        kind, setting, value = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(setting, pa.int32()), pa.array(value, pa.list_(pa.float64()))], ["kind", "setting", "value"])

    return rows.mapInArrow(run, _PARTS)


def _sums(parts: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """The tasks' vectors added up place by place; cells by their number."""
    plain = parts.filter("kind IN ('weights', 'held')").selectExpr("kind", "setting", "posexplode(value) AS (place, v)")
    cells = parts.filter("kind LIKE 'cells%'").selectExpr(
        "kind", "setting", "inline(transform(sequence(0, size(value) DIV 2), i -> struct(CAST(get(value, 2 * i) AS INT) AS place, get(value, 2 * i + 1) AS v)))"
    )
    totals = plain.unionByName(cells.filter("place IS NOT NULL")).groupBy("kind", "setting", "place").agg(F.sum("v").alias("v"))
    out: dict[tuple[str, int], dict[int, float]] = {}
    for row in totals.collect():  # a few numbers a setting, however many rows there are
        out.setdefault((row.kind, row.setting), {})[row.place] = row.v
    return {key: np.array([[p, v] for p, v in sorted(values.items())]) for key, values in out.items()}


def _area(sums: dict[tuple[str, int], np.ndarray], s: int) -> float:
    """Area under the curve from score cells; 0 without both classes."""
    counts = np.zeros((2, SCORE_CELLS + 1))
    for label in (0, 1):
        found = sums.get((f"cells{label}", s))
        if found is not None:
            counts[label, found[:, 0].astype(int)] = found[:, 1]
    real, fake = counts
    if not real.sum() or not fake.sum():
        return 0.0
    below = np.cumsum(real) - real
    return float((fake * (below + real / 2)).sum() / real.sum() / fake.sum())


def train_epochs(
    rows: DataFrame,
    settings: Sequence[Setting],
    epochs: int = 20,
    patience: int = 3,
    metric: str = "auc",
    batch_rows: int = 64,
    seed: int = 42,
) -> list[Run]:
    """Every setting trained on the rows that ``fits`` marks, and judged on the others.

    ``rows`` hold features (array of numbers, all of one length), y and fits;
    keep them stored, as each epoch reads them. Epoch 0 judges the weights that
    training starts from. A setting ends when its metric has not beaten its best
    for ``patience`` epochs, and keeps the weights of the best one.
    """
    length = rows.select(F.max(F.size("features"))).first()[0]
    if not length:
        raise ValueError("no features to train on")
    runs = [Run(s) for s in settings]
    masks = np.zeros((len(settings), length + 1))
    for i, s in enumerate(settings):
        masks[i, list(s.features) if s.features else slice(0, length)] = 1.0
        masks[i, length] = 1.0
    weights = np.zeros((len(settings), length + 1))
    loss = np.full(len(settings), np.nan)
    active = list(range(len(settings)))
    for epoch in range(epochs + 1):
        rates = np.array([settings[i].rate for i in active])
        sums = _sums(_pass(rows, weights[active], masks[active], rates, epoch, batch_rows, seed, epoch < epochs))
        for place, i in enumerate(list(active)):
            tp, fp, tn, fn, held_loss, n = sums["held", place][:, 1]
            ratio = lambda a, b: float(a / b) if b else 0.0
            row = {
                "run": settings[i].name or str(i),
                "epoch": epoch,
                "train_loss": None if np.isnan(loss[i]) else float(loss[i]),
                "val_loss": ratio(held_loss, n),
                "acc": ratio(tp + tn, n),
                "sens": ratio(tp, tp + fn),
                "spec": ratio(tn, tn + fp),
                "f1": ratio(2 * tp, 2 * tp + fp + fn),
                "auc": _area(sums, place),
            }
            runs[i].note(row, weights[i], metric)
            summed = sums["weights", place][:, 1]
            if summed[-1]:
                weights[i], loss[i] = summed[: length + 1] / summed[-1], summed[-2] / summed[-1]
        active = [i for i in active if runs[i].waited() < patience]
        if not active:
            break
    return runs


LOG = "run string, epoch int, train_loss double, val_loss double, acc double, sens double, spec double, f1 double, auc double, saved boolean"


def epoch_log(df: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """The runs' logs as a table for the operators on training logs; a row per run and epoch."""
    return df.sparkSession.createDataFrame([row for r in runs for row in r.log], LOG)


def with_score(df: DataFrame, weights: np.ndarray, features: str = "features", name: str = "p") -> DataFrame:
    """The probability of a trained model, as a column expression."""
    dot = F.aggregate(
        F.zip_with(F.col(features), F.array(*[F.lit(float(w)) for w in weights[:-1]]), lambda x, w: x * w), F.lit(float(weights[-1])), lambda s, v: s + v
    )
    return df.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-dot)))


def draw_settings(n: int, low: float, high: float, choices: Mapping[str, Sequence[int]], seed: int = 42) -> list[Setting]:
    """Seeded draws: rates even in their logarithm, one of the feature choices each."""

    def unit(what: str, i: int) -> float:
        return int(hashlib.md5(f"{what}:{i}:{seed}".encode()).hexdigest()[:12], 16) / 16**12

    names = sorted(choices)
    out = []
    for i in range(n):
        rate = math.exp(math.log(low) + unit("rate", i) * (math.log(high) - math.log(low)))
        name = names[int(unit("features", i) * len(names))]
        out.append(Setting(rate, tuple(choices[name]), f"{i}:{name}"))
    return out


@dataclass
class Rung:
    rows: int
    settings: int
    runs: list[Run]


def halving_search(
    rows: DataFrame, id_col: str, settings: Sequence[Setting], keep: int = 3, epochs: int = 4, metric: str = "auc", seed: int = 42, **options: Any
) -> list[Rung]:
    """Successive halving: all settings on a small sample, the best of ``keep`` each on a sample ``keep`` times as large, and so on.

    Samples are nested (the lowest hashes of the ids) and end with all training
    rows; the validation rows are whole at every rung. The last rung's best run
    holds the search's result.
    """
    rungs, left = [], list(settings)
    count = max(1, math.ceil(math.log(len(left), keep) - 1e-9) + 1)
    place = F.conv(F.substring(hash_key(F.col(id_col), seed), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    for rung in range(count):
        share = 1.0 / keep ** (count - 1 - rung)
        sample = rows.filter(~F.col("fits") | (place < F.lit(share)))
        runs = train_epochs(sample, left, epochs=epochs, metric=metric, seed=seed, **options)
        used = sample.filter("fits").count()
        rungs.append(Rung(used, len(left), sorted(runs, key=lambda r: (-r.best, r.setting.name))))
        left = [r.setting for r in rungs[-1].runs[: max(1, math.ceil(len(left) / keep))]]
    return rungs
