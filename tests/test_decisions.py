import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridect.functions import arrays as A
from veridect.functions import decisions as D
from veridect.operators import fusion as U
from veridect.operators.features import array_statistics, global_standardize
from veridect.operators.scoring import LinearScorer, batch_summary, score_batches, split_errors


def values(spark, numbers, *columns):
    return [tuple(r) for r in spark.createDataFrame([(float(x),) for x in numbers], "p double").select(*columns).collect()]


def test_thresholds(spark):
    p = F.col("p")
    got = values(spark, [0.5, 0.50001, 0.7, 0.71, 0.4, 0.41], D.binary_label(p), D.risk_level(p))
    assert got == [("REAL", "Medium"), ("FAKE", "Medium"), ("FAKE", "Medium"), ("FAKE", "High"), ("REAL", "Low"), ("REAL", "Medium")]
    got = values(spark, [0.2949, 0.295, 0.3, 0.694, 0.695, 0.7], D.likelihood_band(p))
    assert [g[0] for g in got] == ["likely real", "uncertain", "uncertain", "uncertain", "likely AI-generated", "likely AI-generated"]


def test_label_before_rounding(spark):
    r = values(spark, [0.50001], D.item_result(F.col("p")))[0][0]
    assert (r.label, r.fake_prob, r.real_prob, r.confidence) == ("FAKE", 0.5, 0.5, 0.5)


def test_two_class_tie(spark):
    f, r = F.lit(0.5), F.lit(0.5)
    assert values(spark, [0], D.two_class_label(f, r), D.two_class_label(f, r, "REAL")) == [("FAKE", "REAL")]


def test_calibrated_rule_is_inclusive(spark):
    got = values(spark, [0.24, 0.2399], D.calibrated_label(F.col("p"), F.lit(0.24)), D.calibrated_confidence(F.col("p"), F.lit(0.24)))
    assert got == [("AI-generated", 0.24), ("Real", pytest.approx(0.7601))]


def test_weighted_fusion(rows):
    df = rows(
        [(1, 0.8, 0.2, 0.4), (2, 0.8, None, 0.4), (3, None, None, None), (4, 0.5, None, None), (5, None, None, 0.9)],
        "video_id int, image double, audio double, text double",
    )
    got = {r.video_id: (r.final_label, r.fused_score) for r in U.fuse_weighted(df).collect()}
    assert got == {
        1: ("FAKE / AI-GENERATED", 0.54),
        2: ("FAKE / AI-GENERATED", 0.6857),
        3: ("UNKNOWN", None),
        4: ("REAL / HUMAN", 0.5),
        5: ("FAKE / AI-GENERATED", 0.9),
    }


def test_text_gate(rows):
    df = rows([(1, 0.5, 0.4, "hi"), (2, None, 0.4, "hi"), (3, 0.5, 0.4, "  "), (4, 0.5, 0.4, None), (5, 0.5, 0.4, "\n\t")], "v int, audio double, text double, t string")
    got = {r.v: (r.text, r.text_error) for r in U.gate_text(df, transcript="t").collect()}
    assert got[1] == (0.4, None) and got[2] == (None, "Audio extraction failed")
    assert got[3] == got[4] == got[5] == (None, "No speech detected in audio")


def test_other_fusions(rows):
    df = rows([(0.9, 0.3, 0.6), (0.5, 0.5, 0.5), (0.9, None, 0.85)], "a double, b double, c double")
    conf = [F.greatest(F.col(x), 1 - F.col(x)).alias(f"{x}c") for x in "abc"]
    got = df.select("*", *conf).select(U.rule_fusion(list("abc")), U.max_fusion(list("abc")), U.gated_fusion(list("abc"), ["ac", "bc", "cc"])).collect()
    assert got[0][0] == pytest.approx(0.6) and got[0][1:] == (0.9, 0.9)
    assert got[1][2] == 0.5
    assert got[2][0] is None and got[2][1] == 0.9 and got[2][2] == pytest.approx(0.875)
    with pytest.raises(ValueError):
        U.rule_fusion(["a", "b"], [0.5, 0.6])


def test_frames(spark):
    data = [("long", i, 0.1 if i <= 10 else 1.0) for i in range(1, 13)] + [("two", 1, 0.4), ("two", 2, 0.7)]
    df = spark.createDataFrame(data, "video string, frame_no int, p double")
    mean = {r.video: r for r in U.frames_mean(df, "video", ["frame_no"]).collect()}
    assert (mean["long"].fake_prob, mean["long"].frames_analyzed, mean["long"].label) == (0.1, 10, "REAL")
    assert [f.frame for f in mean["long"].per_frame] == list(range(1, 11))
    assert (mean["two"].fake_prob, mean["two"].label) == (0.55, "FAKE")
    assert {r.video: r.fake_prob for r in U.frames_max(df, "video").collect()} == {"long": 1.0, "two": 0.7}


@pytest.mark.parametrize("block", [10_000, 5, 4])
def test_sliding_frames_across_blocks(spark, block):
    rng = np.random.default_rng(7)
    data = [("v", i, float(rng.random())) for i in range(37)] + [("short", 0, 0.2), ("short", 1, 0.6)]
    df = spark.createDataFrame(data, "video string, frame_no int, p double").repartition(4)
    got = {r.video: r.fake_prob for r in U.frames_sliding(df, "video", ["frame_no"], 3, block=block).collect()}
    p = [x for v, _, x in data if v == "v"]
    assert got["v"] == pytest.approx(max(np.mean(p[i : i + 3]) for i in range(35)))
    assert got["short"] == pytest.approx(0.4)


def test_sliding_windows_fit_two_blocks(spark):
    with pytest.raises(ValueError):
        U.frames_sliding(spark.createDataFrame([("v", 1, 0.5)], "video string, frame_no int, p double"), "video", ["frame_no"], 7, block=5)


def test_first_frames_are_cut_before_the_shuffle(spark, capsys):
    df = spark.range(100).select((F.col("id") % 3).alias("video"), F.col("id").alias("n"))
    U.first_frames(df, "video", ["n"]).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_arrays(rows):
    a = [0.0, 1.0, 4.0, 1e-12]
    df = rows([(1, a)], "id int, a array<double>")
    c = F.col("a")
    r = df.select(
        A.fix_length(c, 6).alias("pad"), A.fix_length(c, 2).alias("cut"), A.power_to_db(c).alias("db"),
        A.power_to_db(c, relative=False).alias("fixed"), A.sample_standardize(c).alias("s"),
    ).first()
    assert r.pad == a + [0.0, 0.0] and r.cut == a[:2]
    db = 10 * np.log10(np.maximum(a, 1e-10))
    assert r.db == pytest.approx(np.maximum(db - db.max(), -80.0))
    assert r.fixed == pytest.approx(np.maximum(db, db.max() - 80.0))
    assert r.s == pytest.approx((np.array(a) - np.mean(a)) / (np.std(a, ddof=1) + 1e-8))
    d = A.diagnostics(df, "a").first()
    assert (d.length, d.min_value, d.max_value) == (4, 0.0, 4.0)
    assert (d.mean_value, d.std_value) == pytest.approx((np.mean(a), np.std(a)))


def test_channels(rows):
    pixels = [10.0, 20.0, 30.0, 40.0, 50.0, 60.0]
    df = rows([(pixels,)], "a array<double>")
    r = df.select(A.channel_normalize(F.col("a")).alias("n"), A.channel_normalize(F.col("a"), "unit").alias("u"), A.channel_normalize(F.col("a"), "raw_bgr").alias("b")).first()
    x = np.array(pixels).reshape(-1, 3)
    want = (x / 255.0 - [0.485, 0.456, 0.406]) / [0.229, 0.224, 0.225]
    assert r.n == pytest.approx(want.ravel()) and r.u == pytest.approx(x.ravel() / 255.0)
    assert r.b == [30.0, 20.0, 10.0, 60.0, 50.0, 40.0]
    with pytest.raises(ValueError):
        A.channel_normalize(F.col("a"), "other")
    stereo = rows([([[1.0, 2.0], [3.0, 6.0], [5.0, 1.0]],)], "c array<array<double>>")
    assert stereo.select(A.to_mono(F.col("c"))).first()[0] == [3.0, 3.0]


def test_global_standardize_uses_training_rows(rows):
    train = rows([(1, [1.0, 2.0]), (2, [3.0])], "id int, a array<double>")
    test = rows([(3, [2.0, 10.0])], "id int, a array<double>")
    x = np.array([1.0, 2.0, 3.0])
    got = global_standardize(train, test, "a").first().a
    assert got == pytest.approx((np.array([2.0, 10.0]) - x.mean()) / (x.std() + 1e-6))


def test_global_statistics_far_from_zero(spark):
    """Values around 1e9 with a spread of 1, in rows of different lengths, some empty or missing."""
    rng = np.random.default_rng(4)
    arrays = [(1e9 + rng.normal(size=n) + n / 10).tolist() for n in rng.integers(0, 9, 400)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate([*arrays, None])], "id int, a array<double>").repartition(7)
    every = np.concatenate([np.array(a) for a in arrays])
    got = array_statistics(df, "a").first()
    assert got["count"] == len(every)
    assert got["mean"] == pytest.approx(every.mean(), rel=1e-12)
    assert got["std"] == pytest.approx(every.std(), rel=1e-6)
    scaled = global_standardize(df, df.filter("id = 1"), "a").first().a
    assert scaled == pytest.approx((np.array(arrays[1]) - every.mean()) / (every.std() + 1e-6), abs=1e-5)


def test_bad_record_policies(rows):
    df = rows([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 2.0])], "id int, features array<double>")
    scorer = LinearScorer([1.0, -1.0], 0.5)
    good, bad = split_errors(score_batches(df, scorer))
    assert {r.id: round(r.p, 6) for r in good.collect()} == {
        1: round(1 / (1 + math.exp(-1.5)), 6), 4: round(1 / (1 + math.exp(1.5)), 6)}
    assert {r.id for r in bad.collect()} == {2, 3} and all(r.p is None for r in bad.collect())
    zero = {r.id: r.p for r in score_batches(df, scorer, "zero").collect()}
    assert zero[2] == zero[3] == pytest.approx(1 / (1 + math.exp(-0.5)))
    with pytest.raises(Exception):
        score_batches(df, scorer, "fail").collect()
    with pytest.raises(ValueError):
        score_batches(df, scorer, "ignore")


def test_batch_summary(rows):
    got = batch_summary(rows([("FAKE",), ("REAL",), ("FAKE",), ("FAKE",)], "label string")).first()
    assert tuple(got) == (4, 3, 1, 75.0, 25.0)
    assert tuple(batch_summary(rows([], "label string")).first()) == (0, 0, 0, 0.0, 0.0)
