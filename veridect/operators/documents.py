"""Document-level text scoring: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridect.functions import text as T
from veridect.functions.numeric import round_half_up


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the raw counts the score is made of."""
    body, plain = F.col(text), F.col("_plain")
    return (
        df.withColumn("_plain", T.plain_spaces(body))
        .withColumns(
            {
                "words": T.word_count(plain),
                "long_words": T.long_word_count(plain),
                "punctuation": T.punctuation_count(body),
                "formal_cues": T.count_words(body, T.FORMAL_CUES),
                "personal_cues": T.count_words(body, T.PERSONAL_CUES),
            }
        )
        .drop("_plain")
    )


def score_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds counts, ratios and the document score ``ai_score``."""
    counted = text_counts(df, text).withColumns(
        {
            "long_ratio": T.per_word(F.col("long_words"), F.col("words")),
            "punct_density": T.per_word(F.col("punctuation"), F.col("words")),
        }
    )
    return counted.withColumn(
        "ai_score",
        T.document_score(F.col("long_ratio"), F.col("punct_density"), F.col("formal_cues"), F.col("personal_cues")),
    )


def analyze_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """Full verdict: sentences, their scores, confidence, verdict and cue."""
    scored = score_documents(df, text).withColumn("sentences", T.sentences(F.col(text)))
    scored = scored.withColumn("sentence_scores", T.sentence_scores(F.col("sentences"), F.col("ai_score")))
    scored = scored.withColumn("suspicious", T.suspicious_count(F.col("sentence_scores")))
    return scored.withColumns(
        {
            "confidence": T.confidence(F.col("ai_score")),
            "verdict": T.verdict(F.col("ai_score")),
            "cue": T.cue(
                F.col("formal_cues"), F.col("personal_cues"), F.col("suspicious"), F.size("sentences")
            ),
        }
    )


def score_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per sentence with its score; each sentence is scored on its own row."""
    lines = score_documents(df, text).select(
        *[c for c in df.columns if c != text],
        "ai_score",
        F.posexplode(T.sentences(F.col(text))).alias("sentence_no", "sentence"),
    )
    sentence = F.col("sentence")
    score = T.sentence_score(
        F.col("ai_score"),
        T.count_words(sentence, T.SENTENCE_FORMAL_CUES),
        T.count_words(sentence, T.SENTENCE_PERSONAL_CUES),
        F.col("sentence_no"),
    )
    return lines.withColumn("score", score)


def feature_cards(df: DataFrame) -> DataFrame:
    """Three presentation features of a scored document, flags included."""
    long_ratio, score, density = F.col("long_ratio"), F.col("ai_score"), F.col("punct_density")
    return df.withColumns(
        {
            "style_entropy": T.percent(F.lit(1.0) - long_ratio),
            "style_detail": F.when(long_ratio > F.lit(0.24), "Dense academic diction").otherwise(
                "More natural lexical spread"
            ),
            "regularity": T.percent(score),
            "regularity_detail": F.when(score > F.lit(0.55), "Higher LM-likeness").otherwise("Less templated flow"),
            "cohesion": T.percent(F.lit(0.4) + density * F.lit(4.0)),
            "cohesion_detail": F.when(density > F.lit(0.09), "Rigid sentence packing").otherwise(
                "Looser human rhythm"
            ),
        }
    )


def backend_feature_cards(df: DataFrame) -> DataFrame:
    """The three cards of a document judged by the service (see :func:`document_verdict`), and its cue."""
    probability, scores = F.col("ai_probability"), F.col("sentence_probabilities")
    flagged = F.size(F.filter(scores, lambda p: p >= F.lit(T.SUSPICIOUS_SCORE)))
    return df.withColumns(
        {
            "probability_percent": T.percent(probability),
            "probability_detail": F.when(probability > F.lit(0.55), "Document skews AI-generated").otherwise(
                "Document skews human-written"
            ),
            "ratio_percent": T.percent(F.col("ai_sentence_ratio")),
            "ratio_detail": F.concat(
                flagged.cast("string"), F.lit(" of "), F.size(scores).cast("string"), F.lit(" sentences flagged AI-likely")
            ),
            "model": F.lit("CSPF-Net"),
            "model_detail": F.lit("Context-aware sentence probability fusion"),
            "service_cue": F.when(probability > F.lit(0.7), "High AI probability across document")
            .when(probability < F.lit(0.3), "Strong human writing patterns")
            .otherwise("CSPF-Net probabilistic analysis"),
        }
    )


def document_verdict(
    df: DataFrame, probability: Column, sentence_probabilities: Column, threshold: float = 0.5
) -> DataFrame:
    """Label, rounded probability and share of AI sentences of a scored document."""
    flagged = F.size(F.filter(sentence_probabilities, lambda p: p >= F.lit(threshold)))
    ratio = F.coalesce(
        flagged.cast("double") / F.nullif(F.size(sentence_probabilities), F.lit(0)).cast("double"), F.lit(0.0)
    )
    return df.withColumns(
        {
            "label": F.when(probability >= F.lit(threshold), "AI").otherwise("HUMAN"),
            "ai_probability": round_half_up(probability, 4),
            "ai_sentence_ratio": round_half_up(ratio, 4),
            "sentence_probabilities": F.transform(sentence_probabilities, lambda p: round_half_up(p, 4)),
        }
    )


def prepare_transcripts(df: DataFrame, text: str = "text", keep: int = 500, snippet: int = 60) -> DataFrame:
    """Stripped transcript for the detector, its stored head and a short snippet.

    An empty transcript becomes NULL, which downstream means that the text
    modality is missing.
    """
    body = F.nullif(T.trim_space(F.col(text)), F.lit(""))
    return df.withColumn("detector_text", body).withColumns(
        {
            "transcript": F.substring("detector_text", 1, keep),
            "snippet": F.concat(
                F.substring("detector_text", 1, snippet),
                F.when(F.length("detector_text") > snippet, F.lit("…")).otherwise(""),
            ),
            "error": F.when(F.col("detector_text").isNull(), "No speech detected in audio"),
        }
    )


def drop_blank(df: DataFrame, text: str) -> DataFrame:
    return df.filter(T.trim_space(F.col(text)) != "")


def blank_summary(df: DataFrame, text: str) -> DataFrame:
    """Accepted and rejected rows; a missing value counts as blank."""
    blank = F.coalesce(T.trim_space(F.col(text)) == "", F.lit(True))
    return df.agg(F.count_if(~blank).alias("accepted"), F.count_if(blank).alias("rejected"))
