import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridect.llm.frames import SHUFFLE_CLEANUP, stored
from veridect.llm.suffix_dedup import ORBITS, difference_cover, remove_repeated_bytes


def test_difference_covers():
    for v in ORBITS:
        modulus, places = difference_cover(10 * v // 7 + 1)
        assert modulus == v
        assert {(a - b) % v for a in places for b in places} == set(range(v))
    assert difference_cover(400)[0] == 273 and len(difference_cover(400)[1]) == 17


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def repeats():
    rnd = random.Random(4)
    draw = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    parts = [draw(rnd.randrange(8, 60)) for _ in range(12)]
    rows = []
    for i in range(60):
        rows.append((i, "".join(rnd.choice([draw(rnd.randrange(30)), rnd.choice(parts)]) for _ in range(rnd.randrange(8)))))
    return rows + [(100, rows[3][1]), (101, rows[3][1]), (102, "ab" * 60), (103, parts[0] + parts[0])]


@pytest.mark.parametrize(("name", "length"), [("repeats", 20), ("repeats", 33), ("repeats", 120), ("odd", 20), ("docs", 400), ("empty", 400)])
def test_repeated_bytes(spark, request, name, length):
    source = spark.createDataFrame(repeats(), "doc_id long, text string").repartition(4) if name == "repeats" else request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"]) for r in source.select("doc_id", "text").collect()]
    out = remove_repeated_bytes(source, length).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out)
    assert got == brute(rows, length)
    assert all(sum(b - a for a, b in r["spans"]) == r["n_removed"] for r in out)


def test_texts_are_not_shuffled_beside_the_buckets(spark, docs):
    """Ranks are settled before the texts meet them: the result's plan holds no ranking any more."""
    plan = remove_repeated_bytes(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "FlatMapGroupsInPandas" not in plan


def test_what_stands_behind_written_rows_leaves_the_disk(spark):
    """Shuffle files go once the rows are written, also while the frame they belong to is still in use."""
    files = lambda: {
        f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())
    }
    before = files()
    setting = spark.conf.get(SHUFFLE_CLEANUP)
    counted = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count()
    out = stored(counted, "counted", drop_shuffles=True)
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting
    end = time.time() + 20
    while (left := [f for f in files() - before if f.startswith("shuffle_") and f.endswith(".data")]) and time.time() < end:
        time.sleep(0.2)
    assert not left and out.count() == 700 and counted.count() == 700
