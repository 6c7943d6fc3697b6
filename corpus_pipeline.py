"""Cleans a corpus stage by stage; each stage is written as Parquet and read again as the next one's documents.

toxicity        documents that score 0.3 or more go
lines           recurring template lines go from the texts
near_duplicates of each class of near copies the document with the least id stays
decontamination documents that hold a benchmark item go
packing         pieces of the remaining documents and their places in sequences

NULL and empty texts pass all stages and end as pieces of the end id alone;
repeated rows count as copies of one document. Empty tables give no rows. Extra
columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridect.llm.decontamination import drop_contaminated
from veridect.llm.frames import documents, stored
from veridect.llm.line_templates import drop_recurring_lines
from veridect.llm.minhash import keep_one_per_class
from veridect.llm.packing import pack_documents
from veridect.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, keep_ids=False)


STAGES = [
    ("toxicity", toxicity),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: The stages use a fitted model, random registers and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the rows of the last one."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
