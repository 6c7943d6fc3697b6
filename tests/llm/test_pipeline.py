"""Each stage against a plain version on the stage's own input."""

from collections import Counter, defaultdict

import pytest
from test_lines import brute as plain_lines
from test_minhash import brute as plain_classes
from test_tokens import NAMES, plain

import corpus_pipeline
from veridect.llm.frames import stored


def run_stages(spark, docs, sf_dir):
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], sf_dir), f"test-{name}"))
    return frames


def rows(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_stages(spark, request, name):
    sf_dir = "/root/testdata/sf0.001"
    docs = request.getfixturevalue(name)
    start, clean, lined, near, free, packed = run_stages(spark, docs, sf_dir)
    for frame in (clean, lined, near, free):
        assert frame.columns == docs.columns

    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").collect()} if name == "docs" else set()
    kept = {k for k, _ in rows(clean)}
    gone = {k for k, _ in rows(start)} - kept
    assert Counter(rows(clean)) <= Counter(rows(start)) and len(gone & toxic) >= 0.6 * len(toxic)

    assert Counter(rows(lined)) == plain_lines(rows(clean))

    # of each class one row stays, the one with the least id; wordless rows all stay
    least = Counter()
    for members, n in plain_classes([(k, t) for k, t in rows(lined) if (t or "").split()]).items():
        least[min((k for k in members if k is not None), default=None)] += n
    least.update(k for k, t in rows(lined) if not (t or "").split())
    assert Counter(k for k, _ in rows(near)) == least

    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = {k for k, t in rows(near) if any(f" {i} " in f" {' '.join((t or '').lower().split())} " for i in items)}
    dropped = Counter(rows(near)) - Counter(rows(free))
    assert held <= {k for k, _ in dropped} and len(dropped) <= len(held) + 2

    want = Counter((k, len(plain(NAMES[0], t)) + 1) for k, t in rows(free))
    got = defaultdict(int)
    for r in packed.collect():
        got[r["doc_id"], r["start"] - r["piece"] * 4096] += r["length"]
    assert sum(n for n in got.values()) == sum(k[1] * n for k, n in want.items())


def test_run_writes_all_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
