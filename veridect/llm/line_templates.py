"""Line de-duplication by a fixed-depth tree of log templates, in column expressions only.

Words with a digit become the field ``<*>``. The path in the tree is the number
of words and the first ``depth`` words; a leaf holds the template with all words
and, for lines of ``min_fields`` to ``max_tokens`` words, three templates that
leave out every third word behind the path, so lines that differ in a field (or
in fields three apart) meet in one of them. Lines of ``min_short`` words up to
there have a path of their number of words and the first word, and a fourth
template behind the wildcard child, for lines that differ in that word. Longer
lines are paragraphs and have the template with all words only. A template recurs if
at least ``min_docs`` documents with at least two different texts have it. Its
lines are dropped everywhere but in the document with the least id.

Texts are parsed once: the keys of their lines are written, and both the counts
and the places of recurring lines are read from there. Per document, equal
template keys are collapsed before the shuffle, so a line that a third of the
corpus holds is one partial count per task; the recurring templates are
broadcast while they are few.

Defined cases: a NULL text stays NULL, an empty one empty; blank lines stay.
Rows with equal ids and texts get equal results. If every document with a
template lacks an id, they all keep it. An empty table gives an empty result. A
text of any length is one row of keys. Extra columns pass through unchanged,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridect.llm.frames import stored
from veridect.operators.ordered import join_bounded

_NO_KEYS = "cast(array() as array<bigint>)"


def _line_keys(text: str, depth: int, min_short: int, min_fields: int, max_tokens: int) -> Column:
    """The template keys of each line of ``text``."""
    # words of a line with fields masked; no words for blank lines
    words = r"array_remove(split(regexp_replace(l, '\\S*\\d\\S*', '<*>'), '\\s+'), '')"

    def general(path: int) -> str:
        return ", ".join(f"xxhash64({r + 1}, size(w), filter(w, (t, i) -> i < {path} or (i - {path}) % 3 <> {r}))" for r in range(3))

    keys = (
        f"case when size(w) = 0 then {_NO_KEYS}"
        f" when size(w) < {min_short} or size(w) > {max_tokens} then array(xxhash64(0, size(w), w))"
        f" when size(w) < {min_fields} then array(xxhash64(0, size(w), w), {general(1)}, xxhash64(4, size(w), slice(w, 2, size(w))))"
        f" else array(xxhash64(0, size(w), w), {general(depth)}) end"
    )
    return F.expr(rf"transform(transform(split({text}, '\n'), l -> {words}), w -> {keys})")


def line_keys(
    docs: DataFrame, depth: int = 2, min_short: int = 4, min_fields: int = 8, max_tokens: int = 24, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, text_key and the keys of each line (an array of arrays) of every row; written once."""
    keys = _line_keys(f"`{text_col}`", depth, min_short, min_fields, max_tokens)
    return stored(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), keys.alias("keys")), "line-keys")


def recurring_templates(keyed: DataFrame, min_docs: int = 5) -> DataFrame:
    """key, n_documents, first_doc of each template that recurs, from :func:`line_keys`."""
    found = keyed.select("doc_id", "text_key", F.explode(F.array_distinct(F.flatten("keys"))).alias("key"))
    counts = found.groupBy("key").agg(
        F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc"), F.min("text_key").alias("lo"), F.max("text_key").alias("hi")
    )
    return counts.filter((F.col("n_documents") >= min_docs) & (F.col("lo") < F.col("hi"))).select("key", "n_documents", "first_doc")


def drop_recurring_lines(
    docs: DataFrame, min_docs: int = 5, depth: int = 2, min_short: int = 4, min_fields: int = 8, max_tokens: int = 24,
    id_col: str = "doc_id", text_col: str = "text", counts: bool = False,
) -> DataFrame:
    """``docs`` with the recurring lines taken out of the text; with ``counts``, also __n_lines and __n_removed."""
    keyed = line_keys(docs, depth, min_short, min_fields, max_tokens, id_col, text_col)
    recurring = stored(recurring_templates(keyed, min_docs), "templates").select("key", "first_doc")
    places = keyed.select("doc_id", "text_key", F.posexplode("keys").alias("line", "line_keys"))
    occurrences = places.select("doc_id", "text_key", "line", F.explode("line_keys").alias("key"))
    gone = (
        join_bounded(occurrences, recurring, ["key"], recurring.count())
        .filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .groupBy(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
        .agg(F.collect_set("line").alias("gone"))
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text_col).alias("text_key"))
    text, row_id = F.col("row")[text_col], F.col("row")[id_col]
    joined = rows.join(gone, (F.col("text_key") == F.col("gone_key")) & row_id.eqNullSafe(F.col("gone_id")), "left")
    kept = F.expr(rf"array_join(filter(split(row.`{text_col}`, '\n'), (l, i) -> not array_contains(gone, i)), '\n')")
    out = [F.when(F.col("gone").isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    if counts:
        out = [o for o, c in zip(out, docs.columns, strict=True) if c not in ("__n_lines", "__n_removed")]
        out.append(F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("__n_lines"))
        out.append(F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("__n_removed"))
    return joined.select(*out)
