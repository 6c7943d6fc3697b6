import random
import string

import pytest

from veridect.llm.toxicity import LexiconAutomaton, ToxicityModel, drop_toxic, fit_toxicity, hits, score_toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rnd = random.Random(1)
    terms = ["idiot", "moron", "pathetic", "scum", "trash"]
    automaton = LexiconAutomaton(dict.fromkeys(terms, 5.0), {"vequ": 4.0})
    words = set(terms)
    for t in terms:
        for _ in range(400):
            w = list(t)
            for _ in range(rnd.randrange(3)):
                i = rnd.randrange(len(w))
                w[i : i + rnd.randrange(2)] = rnd.choice(["", rnd.choice(string.ascii_lowercase)])
                w = w or ["x"]
            words.add("".join(w))
    for w in words:
        want = [t for t in terms if w == t or len(t) >= 5 and w[:1] == t[0] and distance(w, t) <= 1]
        got = automaton.match(w)
        assert (got is not None) == bool(want), w
        if got:
            assert got[0] in want and got[1] == (w not in terms), w
    assert automaton.match("vequair") == ("vequ*", 0) and automaton.match("veqair") is None


def test_quotation_counts_less():
    model = ToxicityModel((("idiot", 6.0),), ())
    assert hits(model, "you are an idiot")[0][4] == 1.0
    assert hits(model, 'the paper wrote "idiot" on its front page')[0][4] < 1.0
    assert hits(model, "you idoit and id1ot, idiott")[0][0] == "idiott"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, fit_toxicity(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    truth = [(r["score"] >= 0.3, r["toxic"] == 1) for r in scored]
    right = sum(p and t for p, t in truth)
    assert right >= 0.9 * sum(t for _, t in truth) and right >= 0.9 * sum(p for p, _ in truth)


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_odd_rows(spark, request, name):
    source = request.getfixturevalue(name)
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (99, 1), (6, None)], "doc_id long, toxic int")
    model = fit_toxicity(source, labels)
    rows = score_toxicity(source, model).collect()
    assert len(rows) == source.count() and all(0 <= r["score"] < 0.3 for r in rows)
    kept = drop_toxic(source, model)
    assert kept.columns == source.columns and kept.count() == source.count()


def test_columns_of_any_name_and_bounded_memory(spark, monkeypatch):
    """Scores do not depend on what a worker still remembers."""
    import sys

    module = sys.modules[drop_toxic.__module__]
    model = module.ToxicityModel((("idiot", 4.0), ("stupid", 4.0)), (), (-3.0, 1.5, 0.5, 0.0, 0.0, 0.0))
    rows = [(1, "you stupid idiot", "keep", "r"), (2, "a calm day by the sea", "keep", "r"), (3, None, "keep", "r")]
    source = spark.createDataFrame(rows, "doc_id long, text string, __found string, row string")
    kept = drop_toxic(source, model)
    assert kept.columns == source.columns and sorted(map(str, kept.collect())) == sorted(map(str, source.filter("doc_id > 1").collect()))
    texts = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} idiot stupidd calm{chr(97 + i % 26)}" for i in range(300)]
    want = [module.hits(model, t) for t in texts]
    monkeypatch.setattr(module, "KNOWN_HITS", 1)
    monkeypatch.setattr(module, "KEPT_STATES", 2)
    module._matcher.cache_clear()
    module._matcher(model.words, model.prefixes)[1].limit = 500
    assert [(module.settle(model), module.hits(model, t))[1] for t in texts] == want
    module._matcher.cache_clear()
