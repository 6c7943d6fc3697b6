"""Substring de-duplication by sliding sentence spans.

From every sentence starts a run: it and the next sentences, ``sentences`` of
them at least and as many more as it takes to reach ``min_words`` words. With
``both_ends``, as in the registered query, a run of the same kind, counted
backwards, also ends at every sentence, so a repeated span of that many
sentences and words is covered up to its end. Runs
are compared by a hash of their words in lower case. A run that occurs in two
places is repeated; its first place (least id, then position) stays, and every
sentence that a repeated run covers elsewhere is removed. Runs are judged on
the input, not on what is left.

Defined cases: a NULL text counts as empty and gives an empty clean text; a
text with fewer than ``sentences`` sentences or ``min_words`` words has no run.
Rows equal in id and text are one document. Rows without an id come first. An
empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridect.llm import hashing
from veridect.llm.frames import small_batches, stored

# a sentence ends at white space behind . ! or ?, or at a line end; the white space belongs to it
END = re.compile(r"(?<=[.!?])\s+|\n\s*")


def sentences_of(text: str) -> list[str]:
    cuts = [0, *(m.end() for m in END.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if text[a:b].strip()]


def _runs(texts: list[str], sentences: int, min_words: int, both_ends: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key, first sentence, number of sentences) of each run."""
    owner, hashes, words = [], [], []
    for i, text in enumerate(texts):
        for sentence in sentences_of(text):
            parts = sentence.lower().split()
            owner.append(i)
            words.append(len(parts))
            hashes.append(xxhash.xxh3_64_intdigest(" ".join(parts)))
    n = len(owner)
    of = np.array(owner, dtype=np.int64)
    h = hashing.mix(np.array(hashes, dtype=np.uint64))
    total = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    start = np.arange(n)
    # the first end that gives enough words, then at least so many sentences
    end = np.maximum(np.searchsorted(total, total[start] + min_words), start + sentences)
    good = end <= n
    good[good] = of[end[good] - 1] == of[start[good]]
    start, end = start[good], end[good]
    if both_ends:
        # for each end, the last start that gives enough words and sentences
        stop = np.arange(1, n + 1)
        begin = np.minimum(np.searchsorted(total, total[stop] - min_words, side="right") - 1, stop - sentences)
        good = begin >= 0
        good[good] = of[begin[good]] == of[stop[good] - 1]
        start, end = np.unique(np.concatenate([[start, end], [begin[good], stop[good]]], axis=1), axis=1)
    # polynomial of the sentence hashes, from prefix sums
    power = np.full(n + 1, np.uint64(hashing.BASE))
    power[0] = 1
    power = np.multiply.accumulate(power)
    inverse = np.full(n + 1, np.uint64(pow(hashing.BASE, -1, 2**64)))
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n])])
    key = hashing.mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(of, np.arange(len(texts)))
    return of[start], key.astype(np.int64), (start - first[of[start]]).astype(np.int32), (end - start).astype(np.int32)


def remove_repeated_spans(
    docs: DataFrame, sentences: int = 2, min_words: int = 12, id_col: str = "doc_id", text_col: str = "text", both_ends: bool = False
) -> DataFrame:
    """doc_id, n_sentences, n_removed, clean_text of each document."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("text_key", F.xxhash64("t"))
    kind = plain.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t"):
            owner, key, start, count = _runs(batch.column("t").to_pylist(), sentences, min_words, both_ends)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(key), pa.array(start), pa.array(count)],
                names=["doc_id", "text_key", "key", "start", "count"],
            )

    spans = stored(plain.mapInArrow(cut, f"doc_id {kind}, text_key long, key long, start int, count int"), "spans")
    place = F.struct("doc_id", "text_key", "start")
    repeated = spans.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("key", "first")
    marks = (
        spans.join(repeated, "key")
        .filter(place != F.col("first"))
        .groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("tk"))
        .agg(F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts"))
    )
    joined = plain.join(marks, (plain.text_key == marks.tk) & plain.doc_id.eqNullSafe(marks.id), "left").select("doc_id", "t", "starts", "counts")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t"):
            total, removed, text = [], [], []
            for t, starts, counts in zip(*(batch.column(c).to_pylist() for c in ("t", "starts", "counts")), strict=True):
                parts = sentences_of(t)
                gone = np.zeros(len(parts) + 1, dtype=np.int64)
                if starts:
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, np.add(starts, counts), -1)
                gone = np.cumsum(gone) > 0
                total.append(len(parts))
                removed.append(int(gone.sum()))
                text.append("".join(p for p, g in zip(parts, gone, strict=False) if not g) if starts else t)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(text, pa.string())],
                names=["doc_id", "n_sentences", "n_removed", "clean_text"],
            )

    return joined.mapInArrow(clean, f"doc_id {kind}, n_sentences long, n_removed long, clean_text string")
