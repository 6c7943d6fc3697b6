"""Registered queries of this package: thin digests of the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridect.llm import oracles
from veridect.llm.alignment import align_documents
from veridect.llm.bpe import round_trip
from veridect.llm.conversation_trie import conversation_turns, prefix_trie, regenerate
from veridect.llm.decontamination import contaminated
from veridect.llm.frames import documents
from veridect.llm.licenses import scan_licenses
from veridect.llm.line_templates import drop_recurring_lines
from veridect.llm.minhash import near_duplicate_classes
from veridect.llm.packing import pack_documents
from veridect.llm.quality import clean_lines
from veridect.llm.sentence_spans import remove_repeated_spans
from veridect.llm.suffix_dedup import remove_repeated_bytes
from veridect.llm.token_files import token_file_digest
from veridect.llm.tokens import tokenizer_path
from veridect.llm.toxicity import fit_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op2_quality_rules": oracles.QUALITY,
    "op7_line_templates": oracles.LINES,
    "op9_license_scan": oracles.LICENSES,
    "op12_conversation_trie": oracles.TRIE,
}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), keep_ids=False)


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = clean_lines(documents(spark, sf_dir)).drop("clean_text")
    return judged.withColumn("lost_percent", F.floor(F.col("lost_percent") * 1e6 + 0.5) / 1e6)


@query
def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_recurring_lines(documents(spark, sf_dir), counts=True)
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 9).alias("score"))


@query
def op3_probminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_rows")


@query
def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_spans(documents(spark, sf_dir), both_ends=True)
    return kept.select("doc_id", "n_sentences", "n_removed", F.length("clean_text").cast("long").alias("n_chars"), F.sha2("clean_text", 256).alias("kept_sha256"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(documents(spark, sf_dir)).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = round_trip(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie(regenerate(conversation_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return align_documents(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), groups=False)
