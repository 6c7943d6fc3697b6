from collections import Counter, defaultdict

import pytest

from veridect.llm.sentence_spans import remove_repeated_spans, sentences_of


def brute(rows, sentences=2, min_words=12):
    places = defaultdict(list)
    documents = sorted({(d is not None, d or 0, (t or "")) for d, t in rows})
    for number, (_, _, text) in enumerate(documents):
        parts = [tuple(s.lower().split()) for s in sentences_of(text)]
        for i in range(len(parts)):
            for j in range(i + sentences, len(parts) + 1):
                if sum(map(len, parts[i:j])) >= min_words:
                    places[tuple(parts[i:j])].append((number, i, j))
                    break
    gone = defaultdict(set)
    for at in places.values():
        for number, i, j in sorted(at)[1:]:
            gone[number].update(range(i, j))
    kept = {}
    for number, (has, d, text) in enumerate(documents):
        parts = sentences_of(text)
        left = "".join(p for k, p in enumerate(parts) if k not in gone[number]) if gone[number] else text
        kept[(d if has else None), text] = (len(parts), len(gone[number]), left)
    return Counter((d, *kept[d, t or ""]) for d, t in rows)


def passages():
    passage = "The river rose in the night. It took the mill and two of the old barns. Nobody was hurt. The mayor thanked all who came to help that day."
    return [(i, f"Document {i} begins here with its own words and so on. {passage}\nIt ends as number {i} of a short series of texts.") for i in range(6)] + [
        (6, passage),
        (7, "A short one. Yes."),
        (8, "A short one. Yes."),
        (9, f"{passage} {passage}"),
    ]


@pytest.mark.parametrize("name", ["passages", "docs", "odd", "empty"])
def test_spans(spark, request, name):
    source = spark.createDataFrame(passages(), "doc_id long, text string") if name == "passages" else request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"]) for r in source.select("doc_id", "text").collect()]
    # texts with equal ids are ordered by hash, not by text: leave them to the operator
    got = Counter((r["doc_id"], r["n_sentences"], r["n_removed"], r["clean_text"]) for r in remove_repeated_spans(source).collect())
    assert got == brute(rows)


def test_first_passage_stays(spark):
    out = {r["doc_id"]: r for r in remove_repeated_spans(spark.createDataFrame(passages(), "doc_id long, text string")).collect()}
    assert out[0]["n_removed"] == 0 and out[3]["n_removed"] == 4 and out[6]["clean_text"] == "" and out[8]["n_removed"] == 0
    assert out[9]["clean_text"] == ""


def every_run(rows, sentences=2, min_words=12):
    """Number of sentences that repeated runs of any length cover."""
    places = defaultdict(list)
    for number, (_, text) in enumerate(rows):
        parts = [tuple(s.lower().split()) for s in sentences_of(text)]
        for i in range(len(parts)):
            for j in range(i + sentences, len(parts) + 1):
                if sum(map(len, parts[i:j])) >= min_words:
                    places[tuple(parts[i:j])].append((number, i, j))
    gone = {(n, k) for at in places.values() for n, i, j in sorted(at)[1:] for k in range(i, j)}
    return [sum(n == number for n, _ in gone) for number in range(len(rows))]


def test_short_end_of_a_passage_goes(spark):
    long = " ".join(f"word{i}" for i in range(20))
    passage = f"It was {long}. And so it. Then went home again."
    rows = passages() + [(10 + i, f"Opening of number {i} with words of its own. {passage} Closing of number {i} with others {i}.") for i in range(4)]
    rows += [(20 + i, f"Short{i} one. {passage}") for i in range(3)]
    out = remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), both_ends=True).collect()
    got = {r["doc_id"]: r["n_removed"] for r in out}
    assert [got[d] for d, _ in rows] == every_run(rows) and got[11] == 3
