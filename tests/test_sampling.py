import hashlib
import re
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veridect.operators import labels as B
from veridect.operators import ordered as O
from veridect.operators import sampling as S
from veridect.operators.labels import class_distribution


def key(i, seed=42):
    return hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), str(i)


def order(ids, seed=42):
    return sorted(ids, key=lambda i: key(i, seed))


@pytest.fixture(params=["default", "cut keys", "fine buckets", "no broadcast"])
def mode(request, monkeypatch):
    """The same results by cut keys, with finer hash buckets and without broadcasts."""
    if request.param != "default":
        monkeypatch.setattr(S, "LOWEST_ROWS", -1)
    if request.param == "fine buckets":
        monkeypatch.setattr(S, "BUCKET_ROWS", 1)
    if request.param == "no broadcast":
        monkeypatch.setattr(O, "BROADCAST_ROWS", 0)
    return request.param


@pytest.fixture
def items(spark):
    data = [(i, "a" if i % 3 else "b") for i in range(500)] + [(500 + i, "tiny") for i in range(4)] + [(600, None)]
    return data, spark.createDataFrame(data, "id int, label string")


def by_class(data):
    groups = defaultdict(list)
    for i, label in data:
        groups[label].append(i)
    return {label: order(ids) for label, ids in groups.items()}


def test_sample_per_class(items, mode):
    data, df = items
    got = defaultdict(set)
    for r in S.sample_per_class(df, ["label"], "id", 50).collect():
        got[r.label].add(r.id)
    assert got == {label: set(ids[:50]) for label, ids in by_class(data).items()}
    assert S.sample_per_class(df, ["label"], "id", 0).count() == 0


def test_small_samples_scan_once(spark, tmp_path):
    """One scan and no shuffle of more than each task's lowest rows."""
    spark.range(40_000).selectExpr("id", "id % 3 AS y").repartition(4).write.parquet(str(tmp_path / "t"))
    sample = S.train_val_per_class(spark.read.parquet(str(tmp_path / "t")), ["y"], "id", 1500, 500)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "WindowGroupLimit" in plan and "ExistingRDD" not in plan
    assert Counter((r.y, r.subset) for r in sample.collect()) == {(y, s): n for y in range(3) for s, n in (("train", 1500), ("val", 500))}


def test_train_val_slices(items, mode):
    data, df = items
    got = defaultdict(set)
    for r in S.train_val_per_class(df, ["label"], "id", 200, 100).collect():
        got[r.label, r.subset].add(r.id)
    want = defaultdict(set)
    for label, ids in by_class(data).items():
        want[label, "train"] |= set(ids[:200])
        if ids[200:300]:
            want[label, "val"] |= set(ids[200:300])
    assert got == want


def test_quota_and_check(items, rows, mode):
    data, df = items
    quotas = rows([("a", 7), ("tiny", 9), ("absent", 3), ("b", 0)], "label string, quota int")
    delivered = S.sample_by_quota(df, ["label"], "id", quotas)
    assert {r.id for r in delivered.collect()} == set(by_class(data)["a"][:7]) | set(by_class(data)["tiny"])
    report = S.quota_check(df, ["label"], delivered, quotas.withColumnRenamed("quota", "requested"))
    got = {r.label: (r.requested, r.available, r.delivered, r.short) for r in report.collect()}
    assert got == {"a": (7, 333, 7, False), "b": (0, 167, 0, False), "tiny": (9, 4, 4, True), "absent": (3, 0, 0, True)}


def test_uniform_sample(items, mode):
    data, df = items
    got = {r.id for r in S.sample_uniform(df, "id", 20).collect()}
    assert got == set(order([i for i, _ in data])[:20])
    assert S.sample_uniform(df, "id", 10_000).count() == len(data)


@pytest.mark.parametrize("sizes", [(10, 5), (7, 1), (1, 1), (333, 167), (50, 3)])
def test_stratified_split(spark, sizes, mode):
    if mode != "default" and sizes != (333, 167):
        pytest.skip("one size is enough")
    data = [(f"{y}-{i}", y) for y, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(data, "id string, y int")
    split = S.stratified_split(df, "y", "id").collect()
    assert len(split) == len(data)
    n = len(data)
    total = n - math.ceil(0.8 * n)
    val = Counter(r.y for r in split if r.split == "val")
    assert sum(val.values()) == total
    for y, size in enumerate(sizes):
        assert abs(val[y] - size * total / n) < 1
        ids = order([i for i, label in data if label == y])
        assert {r.id for r in split if r.y == y and r.split == "val"} == set(ids[: val[y]])


def test_equal_and_missing_ids_keep_counts_exact(spark, mode):
    data = [(i // 4, "a", i) for i in range(80)] + [(None, "a", i) for i in range(6)] + [(7, "b", 0)] * 9
    df = spark.createDataFrame(data, "id int, label string, row int")
    for n in (1, 5, 50, 85, 100):
        got = Counter(r.label for r in S.sample_per_class(df, ["label"], "id", n).collect())
        assert got == {"a": min(n, 86), "b": min(n, 9)}
    split = Counter(r.subset for r in S.train_val_per_class(df, ["label"], "id", 5, 3).collect())
    assert split == {"train": 10, "val": 6}
    assert S.sample_uniform(df, "id", 33).count() == 33


def test_oversample_keeps_the_missing_class(spark, mode):
    df = spark.createDataFrame([(i, None if i < 5 else "a" if i < 15 else "b") for i in range(35)], "id int, y string")
    assert Counter(r.y for r in S.oversample(df, "y", "id").collect()) == {None: 20, "a": 20, "b": 20}


def test_shuffle_positions(items, mode):
    data, df = items
    got = {r.id: r.position for r in S.shuffled(df, "id").collect()}
    assert got == {i: k for k, i in enumerate(order([i for i, _ in data]))}


@pytest.mark.parametrize("draws_per_key", [100_000, 3])
def test_oversample(spark, draws_per_key, mode):
    data = [(i, 0) for i in range(90)] + [(100 + i, 1) for i in range(4)]
    df = spark.createDataFrame(data, "id int, y int")
    got = S.oversample(df, "y", "id", draws_per_key=draws_per_key).collect()
    assert Counter(r.y for r in got) == {0: 90, 1: 90}
    assert {(r.y, r.draw) for r in got} == {(y, k) for y in (0, 1) for k in range(90)}
    ids = {0: order(range(90)), 1: order(range(100, 104))}
    for r in got:
        h = int(hashlib.md5(f"{r.y}:{r.draw}:42".encode()).hexdigest()[:15], 16)
        assert r.id == ids[r.y][h % len(ids[r.y])]


def test_oversample_broadcasts_no_draws(spark):
    df = spark.createDataFrame([(i, int(i < 10)) for i in range(100)], "id int, y int")
    got = S.oversample(df, "y", "id")
    assert len(got.collect()) == 180
    joins = re.findall(r"(\w+Join) \[[^\]]*_index", got._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}


def test_class_distribution_of_balanced_rows_broadcasts_no_draws(spark):
    df = spark.createDataFrame([(i, None if i < 3 else int(i < 10)) for i in range(100)], "id int, y int")
    got = class_distribution(S.oversample(df, "y", "id"), ["y"])
    assert {r.y: r.rows for r in got.collect()} == {None: 90, 0: 90, 1: 90}
    joins = re.findall(r"(\w+Join) \[[^\]]*_index", got._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}


def greedy_names(paths):
    """One file after the other: first files of every name, then copies by path."""
    seen, firsts, copies = set(), [], []
    for p in sorted(paths):
        name = p.rsplit("/", 1)[1]
        (copies if name in seen else firsts).append((p, name))
        seen.add(name)
    taken, result = set(), {}
    for p, name in firsts + sorted(copies):
        stem, dot, ext = name.rpartition(".")
        if not dot or not stem:
            stem, ext = name, ""
        target, k = name, 0
        while target in taken:
            k += 1
            target = f"{stem}_{k}" + (f".{ext}" if ext else "")
        taken.add(target)
        result[p] = target
    return result


@pytest.mark.parametrize("seed", range(4))
def test_collision_free_names(spark, seed):
    rng = random.Random(seed)
    names = ["a.jpg", "a_1.jpg", "a_2.jpg", "a_1_1.jpg", "a_5.jpg", "a_01.jpg", "b.png", "b_3.png", "c", "c_1", ".jpg", "a_0.jpg"]
    paths = sorted({f"/d{rng.randrange(40):02d}/{rng.choice(names)}" for _ in range(120)})
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.target_name for r in S.collision_free_names(df, "path").collect()}
    assert got == greedy_names(paths)
    assert len(set(got.values())) == len(paths)


def test_class_mapping_and_labels(rows):
    df = rows([("real",), ("FAKE",), ("other",), (None,)], "name string")
    assert {r.name: r.class_index for r in S.class_mapping(df, "name").collect()} == {"FAKE": 0, "other": 1, "real": 2}
    got = df.select("name", B.fake_positive(F.col("name")).alias("f"), B.real_positive(F.col("name")).alias("r")).collect()
    assert [(r.f, r.r) for r in got] == [(0, 1), (1, 0), (None, None), (None, None)]


def test_score_contract_counts(rows):
    df = rows(
        [("image", 0.5, "FAKE"), ("image", 1.5, "REAL"), ("image", None, "x"), ("text", float("nan"), None), ("text", 0.0, "REAL")],
        "modality string, score double, label string",
    )
    got = {(r.modality, r.rule): r.violations for r in B.score_contract(df, "modality", "score", "label").collect()}
    assert got == {
        ("image", "score_missing"): 1, ("image", "score_out_of_range"): 1, ("image", "label_not_allowed"): 1,
        ("text", "score_missing"): 1, ("text", "score_out_of_range"): 0, ("text", "label_not_allowed"): 1,
    }


def test_raw_scores_are_normalised(spark):
    r = spark.range(1).select(
        B.log_probability_to_score(F.lit(0.0)), B.log_probability_to_score(F.lit(3.0)), B.perplexity_to_score(F.lit(20.0), 20.0)
    ).first()
    assert tuple(r) == (1.0, 1.0, 0.5)
