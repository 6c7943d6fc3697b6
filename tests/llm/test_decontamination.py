import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from veridect.llm import hashing
from veridect.llm.decontamination import _frequencies, _sums, contaminated, drop_contaminated, lcs_length


@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    assert lcs_length(a, b) == row[-1]


def corpus():
    """Documents of random words; some hold an item, whole or with a fifth of its words changed."""
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: [vocabulary[int(len(vocabulary) * rnd.random() ** 2)] for _ in range(n)]
    items = [draw(rnd.randrange(18, 60)) for _ in range(40)]
    rows, leaks = [], set()
    for doc in range(400):
        words = draw(rnd.randrange(5, 400))
        if doc % 5 == 0:
            i = rnd.randrange(len(items))
            text = list(items[i])
            if doc % 10:
                for place in rnd.sample(range(len(text) - 8), max(1, len(text) // 5)):
                    text[place] = "other"
            at = rnd.randrange(len(words))
            words[at:at] = text
            leaks.add((doc, i))
        rows.append((doc, " ".join(words)))
    return rows, [(i, " ".join(t)) for i, t in enumerate(items)], leaks


def test_planted_items_are_found(spark):
    rows, items, leaks = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, benchmark).collect()}
    whole = {(d, i) for d, i in leaks if d % 10 == 0}
    assert whole <= found <= leaks and len(found) >= 0.95 * len(leaks)
    assert whole <= {(r["doc_id"], r["item_id"]) for r in contaminated(docs, benchmark, block_items=15).collect()} <= leaks
    kept = drop_contaminated(docs, benchmark)
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k, _ in rows if k not in {d for d, _ in found}]


def test_whole_items_in_table(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r["doc_id"], r["text"].lower().split()) for r in docs.collect()]
    want = set()
    for r in items.collect():
        own = " ".join(r["text"].lower().split())
        want |= {(d, r["item_id"]) for d, words in rows if f" {own} " in f" {' '.join(words)} "}
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()}
    assert want and want <= found


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_odd_rows(spark, request, name):
    source = request.getfixturevalue(name)
    items = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "word " * 40), (3, "word " * 40)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(source, items).collect()} == ({(7, 3)} if name == "odd" else set())
    assert drop_contaminated(source, items.limit(0)).count() == source.count()
    assert np.isfinite([r["cosine"] for r in contaminated(source, items).collect()]).all()


@pytest.mark.parametrize("texts", [["w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"], ["a b c", "d e f g"], ["a b c"]])
def test_few_blocks(spark, texts):
    source = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, texts[0]), (2, "other " * 40)], "item_id long, text string")
    found = contaminated(source, items).collect()
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in found} == {(0, 1, "copy")}


def test_rows_with_a_leaks_id_stay(spark):
    item = " ".join(f"item{i}" for i in range(40))
    clean = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcde"]
    rows = [(None, clean[0]), (None, f"{clean[1]} {item}"), (None, clean[2]), (None, None), (5, clean[3]), (5, item), (6, clean[4])]
    source = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in drop_contaminated(source, items).collect()} == {r for r in rows if item not in (r[1] or "")}
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(source, items).collect()} == {(None, 1), (5, 1)}


def test_items_without_an_id_count(spark):
    """An item with no id is found like any other, also beside items of other texts without one."""
    items = [" ".join(f"{c}{i}" for i in range(40)) for c in ("item", "other")]
    rows = [(1, f"before {items[0]} behind"), (2, "clean words of no item at all"), (3, items[1])]
    source = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, items[0]), (None, items[1]), (7, None)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in contaminated(source, benchmark).collect()} == {(1, None, "copy"), (3, None, "copy")}
    assert [r["doc_id"] for r in drop_contaminated(source, benchmark).collect()] == [2]


def test_columns_of_any_name(spark):
    item = " ".join(f"item{i}" for i in range(40))
    schema = "doc_id long, text string, __leak long, __leak_key long, text_key string, kind string"
    source = spark.createDataFrame([(1, item, 1, 2, "k", "x"), (2, "clean words", 1, 2, "k", "x")], schema)
    kept = drop_contaminated(source, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == source.columns and [tuple(r) for r in kept.collect()] == [(2, "clean words", 1, 2, "k", "x")]


def test_powers_are_made_once_for_batches_of_any_size():
    most = hashing._powers(1 << 18, False), hashing._powers(1 << 18, True)
    for size in (1 << 16, 1 << 17, 1 << 18, 1 << 16):
        for inverse, longest in enumerate(most):
            assert np.shares_memory(hashing._powers(size, bool(inverse)), longest)
    data = np.frombuffer(b"Some Words, and some words", np.uint8)
    upper, lower = hashing.ByteHashes(data), hashing.ByteHashes(data, lower=True)
    start, end = np.array([0, 5, 16, 21]), np.array([4, 10, 20, 26])
    assert len(set(upper.ranges(start, end).tolist())) == 4
    assert lower.ranges(start, end)[0] == lower.ranges(start, end)[2] == upper.ranges(start, end)[2]


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\x0b\xa0é", max_size=12)), max_size=12))
def test_words_know_their_text(texts):
    owner, word = hashing.words([None if t is None else t.encode() for t in texts])
    want = [(i, w.lower()) for i, t in enumerate(texts) for w in (t or "").encode().split()]
    assert owner.tolist() == [i for i, _ in want]
    alone = [hashing.words([w])[1][0] for _, w in want]
    assert word.tolist() == [int(x) for x in alone]


def test_terms_are_counted_once_a_document(spark):
    """By what the documents hold, not by a flag for each document and term."""

    class Frame:
        def __getattr__(self, _):
            return lambda *args: self

        def mapInArrow(self, function, _):
            self.rows = list(function(iter(batches)))
            return self

        def collect(self):
            return [r for b in self.rows for r in b.to_pylist()]

    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(60))) for _ in range(700)] + [None, ""]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 500], pa.string())], names=["t"]) for k in (0, 500)]
    hashing.words([b"a"])
    tracemalloc.start()
    found, n = _frequencies(Frame(), 8192)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.zeros(8192, dtype=np.int64)
    for t in texts:
        for term in {int(w) % 8192 for w in hashing.words([(t or "").encode()])[1]}:
            want[term] += 1
    assert n == len(texts) and (found == want).all()
    assert peak < 4 << 20


def test_sums_of_named_rows():
    matrix = np.random.default_rng(1).standard_normal((9, 4)).astype(np.float32)
    terms = np.array([[0, 8, 3], [2, 2, 2]])
    assert np.allclose(_sums(matrix, terms), matrix[terms].sum(axis=1))
