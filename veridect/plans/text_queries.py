"""Text scorer queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridect.functions import text as T
from veridect.functions.numeric import round_half_up
from veridect.operators import documents as D
from veridect.operators.evaluation import prf
from veridect.operators.labels import attach_predictions
from veridect.plans.fixtures import joined_items, joined_items_sql, round_columns, rounded, table
from veridect.plans.registry import query
from veridect.session import spread_small_input

_SPACE = r"[\s\x{0B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_NOT_SPACE = _SPACE.replace("[", "[^", 1)


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _hits(words: tuple[str, ...], text: str) -> str:
    return f"len(regexp_extract_all({text}, '(?i)\\b(?:{'|'.join(words)})\\b'))"


# RE2 has no look-behind: mark the break after the full stop, then split there
_CTE = f"""
WITH counted AS (
  SELECT doc_id, text, lang,
         regexp_extract_all(text, '{_NOT_SPACE}+') AS tokens,
         list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_SPACE}+', '\\1' || chr(1), 'g'), chr(1)),
                                    lambda s: {_trim('s')}), lambda s: s <> '') AS sentences,
         CAST(len(regexp_extract_all(text, '[,:;()-]')) AS INT) AS punctuation,
         CAST({_hits(T.FORMAL_CUES, 'text')} AS INT) AS formal_cues,
         CAST({_hits(T.PERSONAL_CUES, 'text')} AS INT) AS personal_cues
  FROM documents),
ratios AS (
  SELECT *, CAST(len(tokens) AS INT) AS words,
         CAST(len(list_filter(tokens, lambda w: length(regexp_replace(w, '[^a-zA-Z]', '', 'g')) >= 8)) AS INT) AS long_words
  FROM counted),
scored AS (
  SELECT *, CAST(long_words AS DOUBLE) / CAST(greatest(words, 1) AS DOUBLE) AS long_ratio,
         CAST(punctuation AS DOUBLE) / CAST(greatest(words, 1) AS DOUBLE) AS punct_density
  FROM ratios),
verdicts AS (
  SELECT *, greatest(6e-2, least(9.6e-1, 3.2e-1 + long_ratio * 8.5e-1 + punct_density * 1.1e0
                    + CAST(formal_cues AS DOUBLE) * 8e-2 - CAST(personal_cues AS DOUBLE) * 6e-2)) AS ai_score
  FROM scored),
analyzed AS (
  SELECT *, list_transform(sentences, lambda s, i: greatest(5e-2, least(9.8e-1,
            ai_score + CAST({_hits(T.SENTENCE_FORMAL_CUES, 's')} AS DOUBLE) * 9e-2
            - CAST({_hits(T.SENTENCE_PERSONAL_CUES, 's')} AS DOUBLE) * 8e-2
            + CASE WHEN (i - 1) % 2 = 0 THEN 2e-2 ELSE -1e-2 END))) AS sentence_scores
  FROM verdicts),
flagged AS (
  SELECT *, CAST(len(list_filter(sentence_scores, lambda s: s >= 5.8e-1)) AS INT) AS suspicious FROM analyzed)
"""
_VERDICT = "CASE WHEN ai_score >= 5.5e-1 THEN 'Likely AI' WHEN ai_score <= 4e-1 THEN 'Likely Human' ELSE 'Borderline / Mixed' END"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small_input(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")


@query("txt_sentences", _CTE + """
SELECT doc_id, CAST(i - 1 AS INT) AS sentence_no, sentences[i] AS sentence
FROM (SELECT doc_id, sentences, unnest(range(1, len(sentences) + 1)) AS i FROM counted) s""")
def txt_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(
        "doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_no", "sentence")
    )


@query("txt_word_count", _CTE + "SELECT doc_id, words FROM ratios")
def txt_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.word_count(T.plain_spaces(F.col("text"))).alias("words"))


@query("txt_long_word_ratio", _CTE + f"SELECT doc_id, long_words, {rounded('long_ratio')} AS long_ratio FROM scored")
def txt_long_word_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = D.score_documents(_documents(spark, sf_dir))
    return round_columns(scored.select("doc_id", "long_words", "long_ratio"), "long_ratio")


@query("txt_punct_density", _CTE + f"SELECT doc_id, punctuation, {rounded('punct_density')} AS punct_density FROM scored")
def txt_punct_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = D.score_documents(_documents(spark, sf_dir))
    return round_columns(scored.select("doc_id", "punctuation", "punct_density"), "punct_density")


@query("txt_formal_cues", _CTE + "SELECT doc_id, formal_cues FROM counted")
def txt_formal_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.count_words(F.col("text"), T.FORMAL_CUES).alias("formal_cues"))


@query("txt_personal_cues", _CTE + "SELECT doc_id, personal_cues FROM counted")
def txt_personal_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(
        "doc_id", T.count_words(F.col("text"), T.PERSONAL_CUES).alias("personal_cues")
    )


@query("txt_ai_score", _CTE + f"SELECT doc_id, {rounded('ai_score')} AS ai_score FROM verdicts")
def txt_ai_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(D.score_documents(_documents(spark, sf_dir)).select("doc_id", "ai_score"), "ai_score")


@query("txt_sentence_scores", _CTE + f"""
SELECT doc_id, CAST(i - 1 AS INT) AS sentence_no, {rounded('sentence_scores[i]')} AS score
FROM (SELECT doc_id, sentence_scores, unnest(range(1, len(sentence_scores) + 1)) AS i FROM analyzed) s""")
def txt_sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.score_sentences(_documents(spark, sf_dir))
    return round_columns(lines.select("doc_id", "sentence_no", "score"), "score")


@query("txt_suspicious", _CTE + "SELECT doc_id, suspicious, CAST(len(sentences) AS INT) AS sentence_count FROM flagged")
def txt_suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzed = D.analyze_documents(_documents(spark, sf_dir))
    return analyzed.select("doc_id", "suspicious", F.size("sentences").alias("sentence_count"))


@query("txt_confidence", _CTE + f"""
SELECT doc_id, {rounded('greatest(5.1e-1, least(9.7e-1, 5.6e-1 + abs(ai_score - 5e-1) * 8.8e-1))')} AS confidence,
       {rounded('least(9.7e-1, 5.6e-1 + abs(ai_score - 5e-1) * 8.8e-1)')} AS verdict_confidence FROM verdicts""")
def txt_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("ai_score")
    return D.score_documents(_documents(spark, sf_dir)).select(
        "doc_id",
        round_half_up(T.confidence(score), 6).alias("confidence"),
        round_half_up(T.confidence(score, floor=False), 6).alias("verdict_confidence"),
    )


@query("txt_verdict", _CTE + f"SELECT {_VERDICT} AS verdict, lang, count(*) AS documents FROM verdicts GROUP BY ALL")
def txt_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = D.score_documents(_documents(spark, sf_dir))
    return scored.groupBy(T.verdict(F.col("ai_score")).alias("verdict"), "lang").agg(
        F.count(F.lit(1)).alias("documents")
    )


@query("txt_cue", _CTE + """
SELECT doc_id,
       CASE WHEN suspicious > len(sentences) / 2e0 THEN 'Sentence-level consistency spike'
            WHEN personal_cues >= 2 THEN 'Concrete personal detail'
            WHEN formal_cues >= 2 THEN 'Overly polished abstraction'
            ELSE 'Balanced stylistic signals' END AS cue,
       CASE WHEN ai_score > 7e-1 THEN 'High AI probability across document'
            WHEN ai_score < 3e-1 THEN 'Strong human writing patterns'
            ELSE 'Model probabilistic analysis' END AS verdict_cue
FROM flagged""")
def txt_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzed = D.analyze_documents(_documents(spark, sf_dir))
    return analyzed.select("doc_id", "cue", T.verdict_cue(F.col("ai_score")).alias("verdict_cue"))


@query("txt_feature_cards", _CTE + """
SELECT doc_id,
       CAST(floor((1e0 - long_ratio) * 1e2 + 5e-1) AS INT) AS style_entropy,
       CASE WHEN long_ratio > 2.4e-1 THEN 'Dense academic diction' ELSE 'More natural lexical spread' END AS style_detail,
       CAST(floor(ai_score * 1e2 + 5e-1) AS INT) AS regularity,
       CASE WHEN ai_score > 5.5e-1 THEN 'Higher LM-likeness' ELSE 'Less templated flow' END AS regularity_detail,
       CAST(floor((4e-1 + punct_density * 4e0) * 1e2 + 5e-1) AS INT) AS cohesion,
       CASE WHEN punct_density > 9e-2 THEN 'Rigid sentence packing' ELSE 'Looser human rhythm' END AS cohesion_detail
FROM verdicts""")
def txt_feature_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = D.feature_cards(D.score_documents(_documents(spark, sf_dir)))
    return cards.select(
        "doc_id", "style_entropy", "style_detail", "regularity", "regularity_detail", "cohesion", "cohesion_detail"
    )


@query("txt_backend_cards", _CTE + f"""
SELECT doc_id, CAST(floor(ap * 1e2 + 5e-1) AS INT) AS probability_percent,
       CASE WHEN ap > 5.5e-1 THEN 'Document skews AI-generated' ELSE 'Document skews human-written' END AS probability_detail,
       CAST(floor(ratio * 1e2 + 5e-1) AS INT) AS ratio_percent, k || ' of ' || n || ' sentences flagged AI-likely' AS ratio_detail, 'CSPF-Net' AS model,
       CASE WHEN ap > 7e-1 THEN 'High AI probability across document' WHEN ap < 3e-1 THEN 'Strong human writing patterns' ELSE 'CSPF-Net probabilistic analysis' END AS service_cue
FROM (SELECT doc_id, {rounded('ai_score', 4)} AS ap, len(sentence_scores) AS n,
             len(list_filter(sentence_scores, lambda s: floor(s * 1e4 + 5e-1) / 1e4 >= 5.8e-1)) AS k,
             {rounded("CASE WHEN len(sentence_scores) = 0 THEN 0e0 ELSE CAST(len(list_filter(sentence_scores, lambda s: s >= 5e-1)) AS DOUBLE) / len(sentence_scores) END", 4)} AS ratio
      FROM analyzed) c""")
def txt_backend_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzed = D.analyze_documents(_documents(spark, sf_dir))
    cards = D.backend_feature_cards(D.document_verdict(analyzed, F.col("ai_score"), F.col("sentence_scores")))
    return cards.select("doc_id", "probability_percent", "probability_detail", "ratio_percent", "ratio_detail", "model", "service_cue")


@query("txt_doc_sentence_verdict", _CTE + f"""
SELECT doc_id, CASE WHEN ai_score >= 5e-1 THEN 'AI' ELSE 'HUMAN' END AS label, {rounded('ai_score', 4)} AS ai_probability,
       {rounded("CASE WHEN len(sentence_scores) = 0 THEN 0e0 ELSE CAST(len(list_filter(sentence_scores, lambda s: s >= 5e-1)) AS DOUBLE) / len(sentence_scores) END", 4)}
         AS ai_sentence_ratio,
       {joined_items_sql('sentence_scores')} AS sentence_probabilities
FROM analyzed""")
def txt_doc_sentence_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzed = D.analyze_documents(_documents(spark, sf_dir))
    judged = D.document_verdict(analyzed, F.col("ai_score"), F.col("sentence_scores"))
    return judged.select(
        "doc_id",
        "label",
        "ai_probability",
        "ai_sentence_ratio",
        joined_items(F.col("sentence_probabilities")).alias("sentence_probabilities"),
    )


@query("txt_transcript_prep", f"""
SELECT conv_id, turn, substring(body, 1, 500) AS transcript,
       substring(body, 1, 60) || CASE WHEN length(body) > 60 THEN '…' ELSE '' END AS snippet,
       CASE WHEN body IS NULL THEN 'No speech detected in audio' END AS error, length(body) AS detector_chars
FROM (SELECT conv_id, turn, nullif({_trim('text')}, '') AS body FROM conversations) c""")
def txt_transcript_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = D.prepare_transcripts(table(spark, sf_dir, "conversations"))
    return prepared.select(
        "conv_id",
        "turn",
        "transcript",
        "snippet",
        "error",
        F.length("detector_text").cast("bigint").alias("detector_chars"),
    )


@query("prj_empty_guard", f"""
SELECT count(*) FILTER (WHERE {_trim('text')} <> '') AS accepted,
       count(*) FILTER (WHERE text IS NULL OR {_trim('text')} = '') AS rejected FROM conversations""")
def prj_empty_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.blank_summary(table(spark, sf_dir, "conversations"), "text")


@query("prj_attach_predictions", _CTE + f"""
SELECT d.doc_id, d.source, {rounded('v.ai_score', 4)} AS y_pred, CAST(1 - l.quality AS INT) AS y_true
FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN verdicts v ON d.doc_id = v.doc_id""")
def prj_attach_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    truth = labels.select("doc_id", (F.lit(1) - F.col("quality")).alias("y_true"))
    scored = D.score_documents(spread_small_input(documents.select("doc_id", "source", "text"), "doc_id"))
    # the text ends here; what the join moves is three short columns
    manifest = scored.select("doc_id", "source", round_half_up(F.col("ai_score"), 4).alias("y_pred"))
    return attach_predictions(manifest, truth, "doc_id").select("doc_id", "source", "y_pred", "y_true")


def document_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents scored, judged at 0.5 and evaluated by language."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    truth = labels.select("doc_id", (F.lit(1) - F.col("quality")).alias("y"))
    scored = D.score_documents(spread_small_input(documents.select("doc_id", "text", "lang"), "doc_id"))
    judged = scored.select("doc_id", "lang", F.col("ai_score").alias("p")).join(truth, "doc_id")
    report = prf(judged, ["lang"], threshold=0.5)
    return round_columns(report, "accuracy", "precision", "recall", "f1")


_PRF = f"""
SELECT lang, tp, fp, tn, fn, {rounded('CASE WHEN tp+fp+tn+fn = 0 THEN 0e0 ELSE CAST(tp+tn AS DOUBLE) / (tp+fp+tn+fn) END')} AS accuracy,
       {rounded('CASE WHEN tp+fp = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / (tp+fp) END')} AS "precision",
       {rounded('CASE WHEN tp+fn = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / (tp+fn) END')} AS recall,
       {rounded('CASE WHEN 2*tp+fp+fn = 0 THEN 0e0 ELSE CAST(2*tp AS DOUBLE) / (2*tp+fp+fn) END')} AS f1
FROM (SELECT lang, count(*) FILTER (WHERE ai_score >= 5e-1 AND quality = 0) AS tp,
             count(*) FILTER (WHERE ai_score >= 5e-1 AND quality = 1) AS fp,
             count(*) FILTER (WHERE ai_score < 5e-1 AND quality = 1) AS tn,
             count(*) FILTER (WHERE ai_score < 5e-1 AND quality = 0) AS fn
      FROM verdicts v JOIN labels l ON v.doc_id = l.doc_id GROUP BY lang) c"""


@query("txt_evaluation_by_lang", _CTE + _PRF)
def txt_evaluation_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_evaluation(spark, sf_dir)
