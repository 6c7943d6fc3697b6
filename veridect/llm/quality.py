"""Line-first cleaning: rules judge lines, failing lines go, documents that lose too much text are rejected.

Everything is a column expression, so a document never leaves the JVM or its
partition and no shuffle takes place.

Defined cases: a NULL or wordless text has no words, fails the base rules
(fewer than ``min_words``) and is not kept; its clean text is empty. Repeated
rows are judged one by one, so equal rows get equal results. An empty table
gives an empty result. Only the named id and text columns are read; other
columns, whatever their names, do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters that separate words, and characters that count as symbols.
SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Phrases of page furniture, matched in lower case.
BOILERPLATE = (
    "all rights reserved|accept all cookies|we use cookies|cookie policy|privacy policy|terms of service|terms of use|"
    "enable javascript|javascript is disabled|lorem ipsum|click here|read more|sign up for|subscribe to our|log in to|skip to content"
)


@dataclass(frozen=True)
class LineRules:
    """``min_words`` and ``max_repeat_percent`` are the base rules; the rest judges lines."""

    min_words: int = 20
    gram: int = 8
    max_repeat_percent: int = 30
    symbol_share: float = 0.25  # symbols per word of a line
    shout_share: float = 0.25  # "!!" per word of a line
    min_distinct_share: float = 0.3  # distinct words of a line with min_words or more
    open_words: int = 5  # shorter lines must end with punctuation
    menu_links: int = 2  # separators that make a line navigation
    max_lost_percent: int = 40


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _base(docs: DataFrame, rules: LineRules, id_col: str, text_col: str) -> DataFrame:
    g = rules.gram
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).withColumn("b", F.btrim("t", F.lit(SEPARATORS)))
    # an empty text splits into one empty word, which is taken away again
    two = one.select(
        "doc_id",
        "t",
        F.array_remove(F.split("b", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.expr(r"filter(split(t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    three = two.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.expr(
            f"if(size(words) < {g}, cast(array() as array<bigint>),"
            f" transform(sequence(1, greatest(size(words) - {g - 1}, 1)), i -> xxhash64(slice(words, i, {g}))))"
        ).alias("grams"),
    )
    # positions of windows whose hash occurs twice: sort (hash, place) and look at neighbours
    four = three.select(
        "*",
        F.expr(
            "if(size(array_distinct(grams)) = size(grams), cast(array() as array<struct<h: bigint, p: int>>),"
            " array_sort(transform(grams, (h, p) -> struct(h as h, p as p))))"
        ).alias("s"),
    )
    five = four.select(
        "*",
        F.expr(
            "array_sort(array_distinct(flatten(filter("
            "zip_with(s, slice(s, 2, greatest(size(s) - 1, 0)), (a, b) -> if(a.h = b.h, array(a.p, b.p), null)), x -> x is not null))))"
        ).alias("places"),
    )
    covered = F.expr(
        f"aggregate(zip_with(places, slice(places, 2, greatest(size(places) - 1, 0)),"
        f" (a, b) -> least({g}, coalesce(b - a, {g}))), 0L, (n, x) -> n + x)"
    )
    return five.select(
        "doc_id",
        "t",
        "words",
        "lines",
        "n_words",
        F.length(F.translate("t", SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def clean_lines(docs: DataFrame, rules: LineRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base figures, ``kept``, ``clean_text``, ``n_lines``, ``n_lines_removed``, ``lost_percent``."""
    rules = rules or LineRules()
    symbols = "".join(f"\\\\{c}" for c in SYMBOLS)
    judged = F.expr(
        rf"""
        transform(
          transform(lines, l -> struct(l as l, array_remove(split(btrim(l, ' \t\u000b\f\r'), '[\\x20\\x09-\\x0D]+'), '') as w)),
          x -> struct(x.l as l, not (
            regexp_count(x.l, '[{symbols}]') > {rules.symbol_share} * size(x.w)
            or regexp_count(x.l, '!!') > {rules.shout_share} * size(x.w)
            or regexp_count(x.l, '[|»›]') >= {rules.menu_links} and regexp_count(x.l, '[|»›]') * 4 >= size(x.w)
            or size(x.w) < {rules.open_words} and not x.l rlike '[.!?:;)"…”。！？][\\s]*$'
            or size(x.w) >= {rules.min_words} and size(array_distinct(x.w)) < {rules.min_distinct_share} * size(x.w)
            or lower(x.l) rlike {_literal(BOILERPLATE)}
          ) as ok))
        """
    )
    base = _base(docs, rules, id_col, text_col).withColumn("judged", judged).drop("lines", "words")
    base = base.withColumn("good", F.expr("transform(filter(judged, x -> x.ok), x -> x.l)"))
    chars = "aggregate({}, 0L, (n, x) -> n + length({}))"
    figures = base.select(
        "*",
        ((F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))).alias("base_failed"),
        F.expr(chars.format("judged", "x.l")).alias("all_chars"),
        F.expr(chars.format("good", "x")).alias("good_chars"),
    )
    lost = F.when(F.col("all_chars") > 0, 100.0 * (F.col("all_chars") - F.col("good_chars")) / F.col("all_chars")).otherwise(F.lit(0.0))
    return figures.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (lost <= rules.max_lost_percent)).alias("kept"),
        F.array_join("good", "\n").alias("clean_text"),
        F.size("judged").cast("long").alias("n_lines"),
        (F.size("judged") - F.size("good")).cast("long").alias("n_lines_removed"),
        lost.alias("lost_percent"),
    )
