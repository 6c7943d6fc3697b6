"""Licence scan with a positional index of rare licence words.

Fixed licence templates give postings (word -> template, place). Document
frequencies over the whole table choose, for every template, its rarest words;
only these are indexed. A file's words look up the postings, hits of one
template at one shift (place in the file less place in the template) belong
together, and a template counts when enough of its rare words stand at the same
shift and one of its mandatory phrases is in the file.

Only column expressions. The templates have a fixed size, so the postings are
broadcast; what is shuffled are the few indexed words that a file holds.

Defined cases: a NULL or empty text has no words, no labels and score 0. Rows
are scanned one by one, also when ids repeat; equal rows get equal results. An
empty table gives an empty result. Only the id and text columns are read, so
other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases of the base scan and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Licence announcements as (label, template, mandatory phrase).
TEMPLATES = [
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0", "has dedicated the work to the public domain by waiving all rights", "dedicated the work to the public domain"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software"),
    ("lgpl", "licensed under the gnu lesser general public license version", "gnu lesser general public license"),
    ("mit", "released under the mit license", "under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge to any person"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _normal(text: Column) -> Column:
    """A-Z in lower case, words joined by one space, a space at either end; a single space without words."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), SEPARATOR, " ")


def _postings(spark: SparkSession, frequency: DataFrame, rare_words: int) -> DataFrame:
    """(word, template, tpos, indexed) of the ``rare_words`` least frequent words of each template."""
    rows = [f"struct('{word}', {t}, {place})" for t, (_, text, _) in enumerate(TEMPLATES) for place, word in enumerate(text.split())]
    words = spark.range(1).selectExpr(f"inline(array({', '.join(rows)})) as (word, template, tpos)")
    ranked = words.join(F.broadcast(frequency), "word", "left").fillna({"df": 0})
    rank = F.row_number().over(Window.partitionBy("template").orderBy("df", "word", "tpos"))
    kept = ranked.withColumn("rank", rank).filter(F.col("rank") <= rare_words)
    return kept.select("word", "template", "tpos", F.count("*").over(Window.partitionBy("template")).alias("indexed"))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _phrase_places(phrase: str) -> tuple[Column, Column, Column]:
    """Number of places, first and last start word: a word stands behind as many words as there are spaces before it."""
    parts = F.when(F.expr(f"contains(norm, ' {phrase} ')"), F.split("norm", f" {phrase}(?= )"))
    first = _spaces(F.element_at(parts, 1))
    last = F.col("n_words") - len(phrase.split()) - _spaces(F.element_at(parts, -1)) + 1
    return F.coalesce(F.size(parts) - 1, F.lit(0)), first, last


def scan_licenses(docs: DataFrame, rare_words: int = 5, min_share: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    ``rare_words`` words of each template are indexed; ``min_share`` of them
    must stand at one shift. ``found`` lists (label, start word, share) of each
    accepted template, ``score`` is the best share, or 1 for a base phrase.
    """
    spark = docs.sparkSession
    words = F.split(F.btrim("norm"), " ")
    norm = docs.select(F.col(id_col).alias("doc_id"), _normal(F.col(text_col)).alias("norm"))
    # rows with equal ids but different texts stay apart; equal rows share a key and its result
    keyed = norm.select("doc_id", "norm", F.xxhash64("norm").alias("k"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"))

    counted = keyed.withColumn("n_words", _spaces(F.col("norm")) - 1)
    counts, firsts, lasts = zip(*(_phrase_places(p) for p in BASE_PHRASES), strict=True)
    labels = [F.when(n > 0, F.lit(label)) for n, label in zip(counts, BASE_PHRASES.values(), strict=True)]
    base = counted.select(
        "doc_id",
        "k",
        "d",
        F.col("n_words").cast("long").alias("n_words"),
        sum(counts, F.lit(0)).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base"),
    )

    vocabulary = F.array(*(F.lit(w) for w in sorted({w for _, text, _ in TEMPLATES for w in text.split()})))
    frequency = norm.select(F.explode(F.array_intersect(words, vocabulary)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    postings = F.broadcast(_postings(spark, frequency, rare_words))
    verified = F.array_compact(F.array(*(F.when(F.expr(f"contains(norm, ' {must} ')"), F.lit(t)) for t, (_, _, must) in enumerate(TEMPLATES))))
    # two steps: beside a generator, expressions would be evaluated once per word
    parts = keyed.select("k", "d", verified.alias("verified"), words.alias("words"))
    places = parts.select("k", "d", "verified", F.posexplode("words").alias("pos", "word"))
    votes = (
        places.join(postings, "word")
        .groupBy("k", "d", "template", (F.col("pos") - F.col("tpos")).alias("shift"))
        .agg(F.count_distinct("tpos").alias("hits"), F.first("indexed").alias("indexed"), F.first("verified").alias("verified"))
        .withColumn("share", F.col("hits") / F.col("indexed"))
        .filter((F.col("share") >= min_share) & F.expr("array_contains(verified, template)"))
    )
    names = F.element_at(F.array(*(F.lit(label) for label, _, _ in TEMPLATES)), F.col("template") + 1)
    found = votes.groupBy("k", "d").agg(
        F.array_sort(F.collect_set(F.struct(names.alias("label"), F.col("shift").alias("word"), "share"))).alias("found"),
        F.max("share").alias("best"),
    )
    joined = base.join(found, ["k", "d"], "left")
    own = F.coalesce(F.expr("transform(found, x -> x.label)"), F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("found", F.expr("cast(array() as array<struct<label: string, word: int, share: double>>)")).alias("found"),
    )
