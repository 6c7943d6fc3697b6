"""The text scorer as native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridect.functions.numeric import clamp

# Cue words, weights, bounds and thresholds of the text scorer.
FORMAL_CUES = ("increasingly", "robust", "framework", "systematic", "deployment", "optimize", "landscape", "furthermore")
PERSONAL_CUES = ("I", "my", "me", "we", "our", "yesterday", "morning", "night")
SENTENCE_FORMAL_CUES = ("robust", "systematic", "increasingly", "framework", "scalability")
SENTENCE_PERSONAL_CUES = ("I", "my", "me", "we")
PUNCTUATION = ",:;()-"
LONG_WORD_LETTERS = 8
BASE_SCORE, LONG_WEIGHT, PUNCT_WEIGHT, FORMAL_WEIGHT, PERSONAL_WEIGHT = 0.32, 0.85, 1.1, 0.08, 0.06
SCORE_BOUNDS = (0.06, 0.96)
SENTENCE_FORMAL_WEIGHT, SENTENCE_PERSONAL_WEIGHT = 0.09, 0.08
EVEN_SENTENCE_SHIFT, ODD_SENTENCE_SHIFT = 0.02, -0.01
SENTENCE_BOUNDS = (0.05, 0.98)
SUSPICIOUS_SCORE = 0.58
CONFIDENCE_BASE, CONFIDENCE_SLOPE, CONFIDENCE_BOUNDS = 0.56, 0.88, (0.51, 0.97)
LIKELY_AI, LIKELY_HUMAN = 0.55, 0.40

# Unicode white space as ECMAScript defines it; Java's own class is ASCII only.
SPACE_CODES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
SPACES = "".join(map(chr, SPACE_CODES))
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
LONG_TOKEN = rf"(?<![^ ])(?:[^ a-zA-Z]*+[a-zA-Z]){{{LONG_WORD_LETTERS}}}[^ ]*+"


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def plain_spaces(text: Column) -> Column:
    """Every white-space character as a space, which keeps later patterns cheap."""
    others = SPACES.replace(" ", "")
    return F.translate(text, others, " " * len(others))


def count_words(text: Column, words: Sequence[str]) -> Column:
    """Whole-word, case-insensitive hits with ASCII word boundaries."""
    pattern = rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])"
    return F.regexp_count(text, F.lit(pattern))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty pieces between white space that follows . ! or ?

    Breaks swallow all white space, so trimming the text trims every piece.
    """
    pieces = F.split(trim_space(text), f"(?<=[.!?]){SPACE}+")
    return F.filter(pieces, lambda s: s != "")


def word_count(plain: Column) -> Column:
    """Tokens of a text that went through :func:`plain_spaces`."""
    return F.regexp_count(plain, F.lit("[^ ]++"))


def long_word_count(plain: Column) -> Column:
    """Tokens with enough ASCII letters, of a text with plain spaces."""
    return F.regexp_count(plain, F.lit(LONG_TOKEN))


def punctuation_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, PUNCTUATION, ""))


def per_word(count: Column, words: Column) -> Column:
    return count.cast("double") / F.greatest(words, F.lit(1)).cast("double")


def document_score(long_ratio: Column, punct_density: Column, formal: Column, personal: Column) -> Column:
    raw = (
        F.lit(BASE_SCORE)
        + long_ratio * F.lit(LONG_WEIGHT)
        + punct_density * F.lit(PUNCT_WEIGHT)
        + formal.cast("double") * F.lit(FORMAL_WEIGHT)
        - personal.cast("double") * F.lit(PERSONAL_WEIGHT)
    )
    return clamp(raw, *SCORE_BOUNDS)


def sentence_score(score: Column, formal: Column, personal: Column, index: Column) -> Column:
    """Score of one sentence from its cue counts and its 0-based index."""
    shift = F.when(index % 2 == 0, F.lit(EVEN_SENTENCE_SHIFT)).otherwise(F.lit(ODD_SENTENCE_SHIFT))
    base = score + formal.cast("double") * F.lit(SENTENCE_FORMAL_WEIGHT)
    return clamp(base - personal.cast("double") * F.lit(SENTENCE_PERSONAL_WEIGHT) + shift, *SENTENCE_BOUNDS)


def sentence_scores(sentence_array: Column, score: Column) -> Column:
    """Scores of all sentences of a document.

    The document score enters through ``array_repeat`` and not as a captured
    column: the optimizer may inline its expression, and inside a lambda it
    would then run once per sentence.
    """
    cues = F.transform(
        sentence_array,
        lambda s, i: F.struct(
            count_words(s, SENTENCE_FORMAL_CUES).alias("formal"),
            count_words(s, SENTENCE_PERSONAL_CUES).alias("personal"),
            i.alias("i"),
        ),
    )
    return F.zip_with(
        cues,
        F.array_repeat(score, F.size(sentence_array)),
        lambda c, doc: sentence_score(doc, c["formal"], c["personal"], c["i"]),
    )


def suspicious_count(scores: Column) -> Column:
    return F.size(F.filter(scores, lambda s: s >= F.lit(SUSPICIOUS_SCORE)))


def confidence(score: Column, floor: bool = True) -> Column:
    """The document form is bounded on both sides, the verdict form only above."""
    raw = F.lit(CONFIDENCE_BASE) + F.abs(score - F.lit(0.5)) * F.lit(CONFIDENCE_SLOPE)
    low, high = CONFIDENCE_BOUNDS
    return clamp(raw, low, high) if floor else F.least(F.lit(high), raw)


def verdict(score: Column) -> Column:
    return (
        F.when(score >= F.lit(LIKELY_AI), "Likely AI")
        .when(score <= F.lit(LIKELY_HUMAN), "Likely Human")
        .otherwise("Borderline / Mixed")
    )


def cue(formal: Column, personal: Column, suspicious: Column, n_sentences: Column) -> Column:
    """Later rules override earlier ones, so the strongest is tested first."""
    return (
        F.when(suspicious.cast("double") > n_sentences.cast("double") / F.lit(2.0), "Sentence-level consistency spike")
        .when(personal >= 2, "Concrete personal detail")
        .when(formal >= 2, "Overly polished abstraction")
        .otherwise("Balanced stylistic signals")
    )


def verdict_cue(score: Column, model_name: str = "Model") -> Column:
    """Cue of a document scored elsewhere; ``model_name`` labels the middle case."""
    return (
        F.when(score > F.lit(0.7), "High AI probability across document")
        .when(score < F.lit(0.3), "Strong human writing patterns")
        .otherwise(f"{model_name} probabilistic analysis")
    )


def percent(x: Column) -> Column:
    return F.floor(x * F.lit(100.0) + F.lit(0.5)).cast("int")
