import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from veridect.llm.minhash import (
    SKETCH,
    _meeting,
    _nodes,
    keep_one_per_class,
    marks,
    near_duplicate_classes,
    probability_jaccard,
    profiles,
    signatures,
    spanning_links,
)


def profile(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    return {g: 1 + math.log(n) for g, n in Counter(grams).items()}


def similarity(a, b):
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def brute(rows):
    profiles = [profile(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holds = defaultdict(list)
    for i, p in enumerate(profiles):
        for g in p:
            holds[g].append(i)
    seen = Counter()
    for at in holds.values():
        for x in at:
            for y in at:
                if x < y:
                    seen[x, y] += 1
    for (x, y), shared in seen.items():
        small, large = sorted((len(profiles[x]), len(profiles[y])))
        if shared >= 0.5 * large and find(x) != find(y) and similarity(profiles[x], profiles[y]) >= 0.8:
            root[find(y)] = find(x)
    classes = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        classes[find(i)].append(k)
    return Counter(tuple(sorted(c, key=str)) for c in classes.values())


def near_copies():
    rnd = random.Random(5)
    rows = []
    for c in range(12):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(60, 300))]
        for _ in range(rnd.randrange(1, 9)):
            words = list(base)
            for _ in range(rnd.randrange(0, 1 + len(words) // 40)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(base[: len(base) // 2])))
    return rows


@pytest.mark.parametrize("name", ["docs", "odd", "near", "empty"])
def test_classes(spark, request, name):
    source = spark.createDataFrame(near_copies(), "doc_id long, text string") if name == "near" else request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"]) for r in source.select("doc_id", "text").collect()]
    out = near_duplicate_classes(source).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    # rows that stand alone form classes of one row
    got = defaultdict(list)
    for k, r in enumerate(out):
        got[(r["class_id"], r["class_rows"]) if r["class_rows"] > 1 else ("alone", k)].append(r["doc_id"])
    assert Counter(tuple(sorted(c, key=str)) for c in got.values()) == want


def test_estimate_is_close():
    rnd = np.random.default_rng(3)
    a = {int(k): float(w) for k, w in zip(range(300), rnd.uniform(1, 3, 300), strict=True)}
    b = {k: w * rnd.choice([1.0, 1.5]) for k, w in a.items() if k > 60} | {k + 1000: 1.0 for k in range(20)}
    owner = np.repeat([0, 1], [len(a), len(b)])
    kept = signatures(owner, np.array([*a, *b], dtype=np.uint64), np.array([*a.values(), *b.values()]), 2, 4000)
    exact = probability_jaccard(a, b)
    assert abs(exact - similarity(a, b)) < 1e-9
    assert abs((kept[0] == kept[1]).mean() - exact) < 0.03


def test_one_of_each_class_stays(spark, odd, empty):
    rows = near_copies()
    source = spark.createDataFrame([(k, t, "a", k) for k, t in rows], "doc_id long, text string, class_id string, node long")
    kept = keep_one_per_class(source)
    assert kept.columns == source.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(c) for c in brute(rows))
    stay = Counter(r["doc_id"] for r in keep_one_per_class(odd).collect())
    assert stay == Counter([1, 2, 3, 4, 5, 6, 7, None, 8, 9, 10])
    assert keep_one_per_class(empty).count() == 0


def test_unlike_texts_without_or_with_one_id_stay(spark):
    texts = [" ".join(f"{c}{i}" for i in range(100)) for c in "abcdef"]
    near = texts[0].replace("a50", "other")
    rows = [(None, texts[0]), (None, near), (None, texts[1]), (None, texts[2]), (None, ""), (5, texts[3]), (5, texts[4]), (6, texts[5]), (None, texts[5])]
    kept = {(r["doc_id"], r["text"]) for r in keep_one_per_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    always = {(None, texts[1]), (None, texts[2]), (None, ""), (5, texts[3]), (5, texts[4]), (6, texts[5])}
    assert always <= kept and len(kept) == 7 and kept - always <= {(None, texts[0]), (None, near)}


def test_profiles_bound_the_similarity():
    rnd = np.random.default_rng(8)
    for _ in range(200):
        pool = rnd.integers(0, 2**63, 120)
        a, b = ({int(k): 1 + math.log(rnd.integers(1, 9)) for k in rnd.choice(pool, rnd.integers(60, 120), replace=False)} for _ in "ab")
        owner = np.repeat([0, 1], [len(a), len(b)])
        profile, unit = profiles(owner, np.array([*a, *b], dtype=np.uint64), np.array([*a.values(), *b.values()]), 2)
        assert probability_jaccard(a, b) <= np.minimum(*(profile * unit[:, None])).sum() + 1e-9
        assert profiles(owner, np.array([*a, *b], dtype=np.uint64), np.array([*a.values(), *b.values()]), 3)[0][2].sum() == 0


def test_pairs_that_meet_once_are_compared(spark):
    """Near pairs among texts that share half of their words; two bands, so no pair shares three."""
    rows = []
    for c in range(20):
        common = [f"c{c}w{i}" for i in range(60)]
        for k in range(8):
            words = common + [f"c{c}k{max(k, 1)}w{i}" for i in range(60)]
            rows.append((8 * c + k, " ".join(["other", *words[1:]] if k == 0 else words)))
    source = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = source.selectExpr("doc_id", "text as t", "xxhash64(text) as text_key")
    bands = {r["doc_id"]: r["bands"] for r in _nodes(keyed, 5, 2, 1).collect()}
    out = {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(source, bands=2, rows=1).collect()}
    met = [c for c in range(20) if any(x == y for x, y in zip(bands[8 * c], bands[8 * c + 1], strict=True))]
    assert len(met) >= 15
    assert {k for k, v in out.items() if k != v} == {8 * c + 1 for c in met}


def test_spanning_links_join_the_classes(spark):
    rows = near_copies()
    texts = dict(rows)
    source = spark.createDataFrame(rows, "doc_id long, text string")
    root = {k: k for k in texts}
    for r in spanning_links(source).collect():
        a, b = r["doc_a"], r["doc_b"]
        assert similarity(profile(texts[a]), profile(texts[b])) >= 0.8 - 1e-9
        root = {k: root[a] if v == root[b] else v for k, v in root.items()}
    for a, t in rows:  # equal texts need no link
        for b, u in rows:
            if profile(t) == profile(u):
                root = {k: root[a] if v == root[b] else v for k, v in root.items()}
    classes = defaultdict(list)
    for k, v in root.items():
        classes[v].append(k)
    assert Counter(tuple(sorted(c, key=str)) for c in classes.values()) == brute(rows)
    assert "n_links" not in near_duplicate_classes(source).columns


def test_marks_bound_the_similarity():
    rnd = np.random.default_rng(9)
    unlike = 0
    for k in range(300):
        size = int(rnd.integers(100, 130) if k % 2 else rnd.integers(1, 6))
        pool = rnd.integers(0, 2**63, size + 2 + k % 30)
        a, b = ({int(e): 1 + math.log(rnd.integers(1, 2 + k % 5)) for e in rnd.choice(pool, size, replace=False)} for _ in "ab")
        one, two = marks(np.repeat([0, 1], [len(a), len(b)]), np.array([*a, *b], dtype=np.uint64), 2).view(np.uint64).tolist()
        d = sum((x ^ y).bit_count() for x, y in zip(one, two, strict=True))
        assert d <= len(a.keys() ^ b.keys())
        s = 2 * (sum(a.values()) + sum(b.values())) - len(a) - len(b)
        assert probability_jaccard(a, b) <= (s - d) / (s + d) + 1e-9
        unlike += (s - d) / (s + d) < 0.8
    assert 50 < unlike < 250


def test_unlike_texts_of_a_band_make_no_pairs(spark):
    """Texts that share two thirds of their shingles all meet, in many bands; a pair comes once, and only if it may be similar."""
    common = [f"c{i}" for i in range(200)]
    rows = [(k, " ".join(common + [f"k{k}w{i}" for i in range(100)])) for k in range(60)]
    rows += [(k + 60, t.replace("w50 ", "x ")) for k, t in rows[:5]]
    keyed = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text as t", "xxhash64(text) as text_key")
    nodes = _nodes(keyed, 5, 32, 1)
    rest = nodes.selectExpr("explode(bands) as band", "node", "node as root", "bands", *SKETCH).localCheckpoint()
    assert rest.alias("x").join(rest.alias("y"), "band").filter("x.root < y.root").count() > 10_000
    number = {bytes(r["node"]): r["doc_id"] for r in nodes.collect()}
    got = [tuple(sorted((number[bytes(r["a"])], number[bytes(r["b"])]))) for r in _meeting(rest, 0.8).collect()]
    assert sorted(got) == [(k, k + 60) for k in range(5)]


def test_a_task_sketches_little_text_at_a_time():
    """A task's arrays stay small, however many texts a batch brings."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField

    class Docs:
        schema = {"doc_id": StructField("doc_id", LongType())}

        def mapInArrow(self, sketch, schema):  # noqa: N802
            return sketch

    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(500)) for _ in range(1200)]
    size = sum(map(len, texts))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text_key", "t"])
    sketch = _nodes(Docs(), 5, 32, 5)
    tracemalloc.start()
    n = sum(out.num_rows for out in sketch(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 4 << 20 and n == len(texts)
    assert peak < 100 << 20
