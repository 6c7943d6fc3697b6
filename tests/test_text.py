import re

import pytest
from pyspark.sql import functions as F

from veridect.functions import text as T
from veridect.operators import documents as D

TEXTS = [
    "",
    "   \t\n ",
    "I think. We agree! Do we?  Yes",
    "A robust, systematic framework; furthermore (increasingly) robust deployment.",
    "my night-morning me-we our_our Our yesterday's I'm",
    " . foo.  bar .baz? qux　end ",
    "supercalifragilistic ab-cdef-ghij a1b2c3d4e5f6g7h8 12345678 ------ éléphantesque",
    "One.\nTwo!\r\nThree?   Four.Five. ",
    "we we we. robust robust scalability framework. plain words only here.",
]


def expected(text):
    """The scorer's rules written directly, with Python's own regex engine."""
    space = "[\t\n\x0b\x0c\r    -     　﻿]"
    strip = "".join(T.SPACES)
    tokens = [t for t in re.split(f"{space}+", text) if t]
    words = max(len(tokens), 1)

    def hits(names, s):
        return len(re.findall(rf"\b(?:{'|'.join(names)})\b", s, re.IGNORECASE | re.ASCII))

    long_words = sum(len(re.sub("[^a-zA-Z]", "", t)) >= 8 for t in tokens)
    punct = len(re.findall("[,:;()-]", text))
    formal = hits("increasingly robust framework systematic deployment optimize landscape furthermore".split(), text)
    personal = hits("I my me we our yesterday morning night".split(), text)
    score = 0.32 + long_words / words * 0.85 + punct / words * 1.1 + formal * 0.08 - personal * 0.06
    score = max(0.06, min(0.96, score))
    pieces = [s.strip(strip) for s in re.split(rf"(?<=[.!?]){space}+", text)]
    pieces = [s for s in pieces if s]
    per = []
    for i, s in enumerate(pieces):
        v = score + 0.09 * hits("robust systematic increasingly framework scalability".split(), s)
        v += (0.02 if i % 2 == 0 else -0.01) - 0.08 * hits("I my me we".split(), s)
        per.append(max(0.05, min(0.98, v)))
    suspicious = sum(p >= 0.58 for p in per)
    cue = "Balanced stylistic signals"
    if formal >= 2:
        cue = "Overly polished abstraction"
    if personal >= 2:
        cue = "Concrete personal detail"
    if suspicious > len(pieces) / 2:
        cue = "Sentence-level consistency spike"
    return len(tokens), long_words, punct, formal, personal, score, pieces, per, suspicious, cue


def test_scorer_against_rules(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    out = {r.id: r for r in D.analyze_documents(df).collect()}
    for i, text in enumerate(TEXTS):
        words, long_words, punct, formal, personal, score, pieces, per, suspicious, cue = expected(text)
        r = out[i]
        assert (r.words, r.long_words, r.punctuation, r.formal_cues, r.personal_cues) == (
            words, long_words, punct, formal, personal), text
        assert r.ai_score == pytest.approx(score, abs=1e-12)
        assert r.sentences == pieces
        assert r.sentence_scores == pytest.approx(per, abs=1e-12)
        assert (r.suspicious, r.cue) == (suspicious, cue)


def test_sentence_rows_equal_sentence_arrays(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    arrays = {(r.id, i): s for r in D.analyze_documents(df).collect() for i, s in enumerate(r.sentence_scores)}
    lines = {(r.id, r.sentence_no): r.score for r in D.score_sentences(df).collect()}
    assert lines == pytest.approx(arrays)


def test_long_token_of_digits_is_linear(spark):
    df = spark.range(1).select(F.lit("7" * 20_000 + " abcdefgh").alias("text"))
    assert D.text_counts(df).first().long_words == 1


@pytest.mark.parametrize(
    "score, verdict, cue, low, capped",
    [
        (0.55, "Likely AI", "Model probabilistic analysis", 0.604, 0.604),
        (0.5499, "Borderline / Mixed", "Model probabilistic analysis", 0.603912, 0.603912),
        (0.40, "Likely Human", "Model probabilistic analysis", 0.648, 0.648),
        (0.4001, "Borderline / Mixed", "Model probabilistic analysis", 0.647912, 0.647912),
        (0.70, "Likely AI", "Model probabilistic analysis", 0.736, 0.736),
        (0.71, "Likely AI", "High AI probability across document", 0.7448, 0.7448),
        (0.30, "Likely Human", "Model probabilistic analysis", 0.736, 0.736),
        (0.29, "Likely Human", "Strong human writing patterns", 0.7448, 0.7448),
        (1.0, "Likely AI", "High AI probability across document", 0.97, 0.97),
    ],
)
def test_boundaries(spark, score, verdict, cue, low, capped):
    s = F.lit(score)
    r = spark.range(1).select(
        T.verdict(s).alias("v"), T.verdict_cue(s).alias("c"), T.confidence(s).alias("a"), T.confidence(s, False).alias("b")
    ).first()
    assert (r.v, r.c) == (verdict, cue)
    assert (r.a, r.b) == pytest.approx((low, capped))


def test_document_verdict_is_inclusive(rows):
    df = rows([(0.5, [0.5, 0.49994, 0.2]), (0.49999, []), (0.9, [0.9, 0.8])], "p double, s array<double>")
    got = D.document_verdict(df, F.col("p"), F.col("s")).orderBy("p").collect()
    assert [r.label for r in got] == ["HUMAN", "AI", "AI"]
    assert [r.ai_probability for r in got] == [0.5, 0.5, 0.9]
    assert [r.ai_sentence_ratio for r in got] == [0.0, 0.3333, 1.0]
    assert got[1].sentence_probabilities == [0.5, 0.4999, 0.2]


def test_transcripts_and_blanks(rows):
    df = rows([(1, "  " + "x" * 600 + " "), (2, " \n"), (3, None), (4, "y" * 60)], "id int, text string")
    out = {r.id: r for r in D.prepare_transcripts(df).collect()}
    assert len(out[1].detector_text) == 600 and len(out[1].transcript) == 500
    assert out[1].snippet == "x" * 60 + "…" and out[4].snippet == "y" * 60
    assert out[2].detector_text is None and out[2].error == out[3].error == "No speech detected in audio"
    assert D.drop_blank(df, "text").count() == 2
    assert tuple(D.blank_summary(df, "text").first()) == (2, 2)
