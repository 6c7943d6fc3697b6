import numpy as np
import pytest
from pyspark.sql import functions as F

from veridect.operators import epochs, training_log
from veridect.operators import evaluation as E
from veridect.operators import ranked as R


@pytest.fixture(scope="module")
def rows(spark):
    """Two noisy features tell the classes apart, a third does not."""
    rng = np.random.default_rng(2)
    data = []
    for i in range(900):
        y = int(rng.random() < 0.4)
        data.append((i, y, [float(rng.normal(y, 0.8)), float(rng.normal(-y, 1.0)), float(rng.normal())], i % 3 > 0))
    return spark.createDataFrame(data, "id int, y int, features array<double>, fits boolean").repartition(4).cache()


def test_log_and_kept_weights(rows):
    (run,) = epochs.train_epochs(rows, [epochs.Setting(0.3, name="a")], epochs=8, patience=2)
    log = epochs.epoch_log(rows, [run])
    first, last = run.log[0], run.log[-1]
    assert first["auc"] == 0.5 and first["val_loss"] == pytest.approx(np.log(2)) and first["train_loss"] is None
    assert last["val_loss"] < first["val_loss"] and run.best > 0.85
    best = training_log.best_epoch(log, "auc", check=False).first()
    stop = training_log.early_stop(log, "auc", patience=2).first()
    assert (best.best_epoch, best.best_auc) == (run.best_epoch, run.best)
    assert (stop.stop_epoch, stop.restored_epoch) == (last["epoch"], run.best_epoch)
    held = epochs.with_score(rows.filter("NOT fits"), run.weights)
    again, kept = E.prf(held, inclusive=False).first(), run.log[run.best_epoch]
    assert (again.accuracy, again.f1) == (pytest.approx(kept["acc"]), pytest.approx(kept["f1"]))
    assert R.roc_auc(held).first().roc_auc == pytest.approx(run.best, abs=1e-3)  # scores meet in cells of 1e-4
    truth = np.array([(r.y, r.p) for r in held.select("y", "p").collect()])
    loss = -np.mean(np.where(truth[:, 0] == 1, np.log(truth[:, 1]), np.log(1 - truth[:, 1])))
    assert loss == pytest.approx(kept["val_loss"])


def test_settings_do_not_touch_each_other(rows):
    """Many settings in one pass learn what each learns alone, and features left out keep a weight of 0."""
    settings = [epochs.Setting(0.3, (0, 1), "two"), epochs.Setting(0.01, name="slow"), epochs.Setting(0.3, (2,), "noise")]
    together = epochs.train_epochs(rows, settings, epochs=3, patience=9)
    for setting, run in zip(settings, together):
        (alone,) = epochs.train_epochs(rows, [setting], epochs=3, patience=9)
        assert [r["auc"] for r in alone.log] == pytest.approx([r["auc"] for r in run.log])
        assert alone.weights == pytest.approx(run.weights)
    assert together[0].weights[2] == 0 and not together[2].weights[:2].any()
    assert together[0].best > 0.85 > together[2].best


def test_one_class_and_no_rows(spark):
    schema = "id int, y int, features array<double>, fits boolean"
    one = spark.createDataFrame([(i, 1, [1.0], i > 2) for i in range(8)], schema)
    (run,) = epochs.train_epochs(one, [epochs.Setting(0.1)], epochs=2, patience=5)
    assert [r["auc"] for r in run.log] == [0.0, 0.0, 0.0] and run.log[-1]["acc"] == 1.0
    with pytest.raises(ValueError):
        epochs.train_epochs(one.limit(0), [epochs.Setting(0.1)])


def test_halving(rows):
    settings = epochs.draw_settings(9, 1e-3, 1.0, {"good": (0, 1), "noise": (2,)}, seed=7)
    assert settings == epochs.draw_settings(9, 1e-3, 1.0, {"good": (0, 1), "noise": (2,)}, seed=7)
    assert all(1e-3 <= s.rate <= 1.0 for s in settings) and {s.name.split(":")[1] for s in settings} == {"good", "noise"}
    rungs = epochs.halving_search(rows, "id", settings, 3, epochs=2)
    assert [r.settings for r in rungs] == [9, 3, 1]
    assert rungs[0].rows < rungs[1].rows < rungs[2].rows == rows.filter("fits").count()
    assert rungs[2].runs[0].setting.name.endswith("good") and rungs[2].runs[0].best > 0.85
    assert [r.best for r in rungs[0].runs] == sorted([r.best for r in rungs[0].runs], reverse=True)


def test_score_expression(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "features array<double>")
    got = epochs.with_score(df, np.array([0.5, -0.25, 0.1])).select(F.round("p", 9)).first()[0]
    assert got == pytest.approx(1 / (1 + np.exp(-0.1)))
