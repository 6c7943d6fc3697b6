import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veridect.llm.line_templates import drop_recurring_lines, line_keys, recurring_templates


def keys(line, depth=2, min_short=4, min_fields=8, max_tokens=24):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", re.sub(r"[^ \t\n\x0b\f\r]*[0-9][^ \t\n\x0b\f\r]*", "<*>", line)) if w]
    if not words:
        return set()
    out = {(0, len(words), *words)}
    if min_short <= len(words) < min_fields:
        depth = 1
        out.add((4, len(words), *words[1:]))
    if min_short <= len(words) <= max_tokens:
        for r in range(3):
            out.add((r + 1, len(words), *(w for i, w in enumerate(words) if i < depth or (i - depth) % 3 != r)))
    return out


def brute(rows, min_docs=5):
    docs, texts, first = Counter(), defaultdict(set), {}
    for doc, text in rows:
        for k in set().union(*(keys(x) for x in (text or "").split("\n"))):
            docs[k] += 1
            texts[k].add(text)
            if doc is not None:
                first[k] = min(first.get(k, doc), doc)
    recurring = {k for k, n in docs.items() if n >= min_docs and len(texts[k]) > 1}
    out = []
    for doc, text in rows:
        if text is not None:
            lines = [x for x in text.split("\n") if not any(k in recurring and first.get(k) != doc for k in keys(x))]
            text = "\n".join(lines)
        out.append((doc, text))
    return Counter(out)


def logs():
    rows = []
    for i in range(30):
        name = f"user{chr(97 + i % 26)}"
        rows.append(
            (
                i,
                f"Some words of document {name} {chr(97 + i)} stand here alone.\n"
                f"Subscribe to our newsletter for the latest offers\n\nPage {i} of 30\n"
                f"Session opened for member {name} on the main server by root",
            )
        )
    return rows + [(i, "a text that is copied\nwith two lines") for i in range(100, 110)]


@pytest.mark.parametrize("name", ["logs", "docs", "odd", "empty"])
def test_lines(spark, request, name):
    source = spark.createDataFrame(logs(), "doc_id long, text string") if name == "logs" else request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"]) for r in source.select("doc_id", "text").collect()]
    out = drop_recurring_lines(source)
    assert out.columns == source.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == brute(rows)


def test_fields_generalise(spark):
    source = spark.createDataFrame(logs(), "doc_id long, text string")
    out = {r["doc_id"]: r for r in drop_recurring_lines(source, counts=True).collect()}
    assert out[0]["__n_removed"] == 0 and out[3]["__n_removed"] == 3 and out[3]["__n_lines"] == 5
    assert out[105]["text"] == "a text that is copied\nwith two lines"
    assert recurring_templates(line_keys(source)).filter("n_documents = 30").count() >= 3


def test_paragraphs_are_compared_whole(spark):
    long = " ".join(f"word{chr(97 + i)}" for i in range(26))
    wide = "   ".join(["a", "line", "of", "few", "words"] * 4)
    texts = [f"Document {chr(97 + i)} alone.\n{long}\n{wide}\n{long} {chr(97 + i)}" for i in range(6)]
    out = {r["doc_id"]: r["text"] for r in drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == {i: t if i == 0 else t.replace(f"{long}\n{wide}\n", "") for i, t in enumerate(texts)}


def test_columns_of_any_name(spark):
    """Columns named like the operator's own come through as they are."""
    names = "__lines string, row string, gone int, keys string, text_key long, line int, key long, first_doc long, gone_id long, doc_id_ string"
    rows = [(i, f"line one of all\nalone {chr(97 + i)}", "keep", "r", 1, "k", 2, 3, 4, 5, 6, "d") for i in range(6)]
    source = spark.createDataFrame(rows, f"doc_id long, text string, {names}")
    out = drop_recurring_lines(source)
    assert out.columns == source.columns
    assert sorted(map(tuple, out.collect())) == sorted((r[0], r[1] if r[0] == 0 else r[1].split("\n")[1], *r[2:]) for r in rows)
    counted = drop_recurring_lines(source.withColumn("__n_lines", F.lit("x")), counts=True).filter("doc_id = 1").first()
    assert (counted["__n_lines"], counted["__n_removed"]) == (2, 1)


@pytest.mark.parametrize("line", ["user {} logged in from home", "{} opened the session", "the job of {} has ended well", "disk of host {} is full"])
def test_varying_words_of_short_lines(spark, line):
    """A field that holds no digit is found inside a short line and at its start."""
    names = ["alice", "bob", "carol", "dave", "erin", "frank", "grace", "heidi"]
    rows = [(i, f"Document {chr(97 + i)}.\n{line.format(n)}") for i, n in enumerate(names)]
    out = {r["doc_id"]: r["text"] for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: t if i == 0 else t.split("\n")[0] for i, t in rows}
