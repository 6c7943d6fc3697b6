"""Benchmark decontamination by latent semantic retrieval.

Passages are runs of words; a word is one of ``dimension`` hashed terms,
weighted by its inverse document frequency over all documents. A randomised
decomposition of the passages' TF-IDF matrix A is made in one distributed pass:
tasks add up A'AW for a fixed random W, and the small product gives the leading
right singular vectors (Nystrom). Benchmark windows and document passages are
compared by cosine in the whitened latent space, and each candidate is checked
with the longest common subsequence of words against the region around the
passage, for paraphrases also with the item's closing words (its answer).

The benchmark is a stated query set: items are taken in blocks of
``block_items``, each broadcast for one pass over all documents.

Defined cases: a NULL or wordless document matches nothing, nor does a wordless
item; items without an id are found like others and reported with a NULL id.
A text of any length is cut into batches of passages. Documents shorter than a passage are one passage. Repeated documents or
items give repeated matches, one per pair of ids with the best figures; rows are
dropped by id and text, so rows that share a leak's id, or lack one, stay. Empty
tables give an empty result. Only ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridect.llm import hashing
from veridect.llm.frames import small_batches, stored

# Words of a passage, and from one document passage to the next.
PASSAGE, STRIDE = 32, 8
#: Words of a document passage and step between an item's windows, for items of a passage or more and for shorter ones.
SCALES = ((PASSAGE, 8), (PASSAGE // 2, 4))


def _texts(batch: pa.RecordBatch, column: str = "t") -> list[bytes | None]:
    return [None if t is None else t.encode() for t in batch.column(column).to_pylist()]


BATCH_BYTES = 1 << 18  # small enough for the working arrays to stay in the processor's cache


def _frequencies(docs: DataFrame, dimension: int) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and their number; one row per term reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dimension + 1, dtype=np.int64)
        for batch in small_batches(batches, "t", BATCH_BYTES):
            owner, word = hashing.words(_texts(batch))
            total[dimension] += batch.num_rows
            # a term counts once for each document that holds it
            held = np.sort(owner * dimension + (word % np.uint64(dimension)).astype(np.int64))
            new = np.ones(len(held), dtype=bool)
            new[1:] = held[1:] != held[:-1]
            total[:dimension] += np.bincount(held[new] % dimension, minlength=dimension)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "n"])

    rows = docs.select("t").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(dimension + 1, dtype=np.int64)
    for r in rows:
        total[r["term"]] = r["n"]
    return total[:dimension], int(total[dimension])


def _runs(owner: np.ndarray, term: np.ndarray, size: int, empty: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of consecutive runs of ``size`` words as rows, filled up with ``empty``; their document; their first word."""
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    count = np.diff(np.append(first, len(owner)))
    runs = -(-count // size)
    before = np.cumsum(runs) - runs
    place = np.arange(len(owner)) - np.repeat(first, count)
    out = np.full(int(runs.sum()) * size, empty, dtype=np.int64)
    out[place + np.repeat(before * size, count)] = term
    within = np.arange(int(runs.sum())) - np.repeat(before, runs)
    return out.reshape(-1, size), np.repeat(owner[first], runs), np.repeat(first, runs) + within * size


def _sums(matrix: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Sum of the matrix rows that each row of ``terms`` names."""
    columns = np.ascontiguousarray(terms.T)
    total = matrix.take(columns[0], axis=0)
    more = np.empty_like(total)
    for column in columns[1:]:
        total += matrix.take(column, axis=0, out=more, mode="clip")
    return total


def _closed(matrix: np.ndarray) -> np.ndarray:
    """``matrix`` with a row of zeros for the empty term."""
    return np.vstack([matrix, np.zeros((1, matrix.shape[1]), matrix.dtype)])


def latent_space(docs: DataFrame, idf: np.ndarray, rank: int, leading: int, extra: int = 8, seed: int = 7) -> np.ndarray:
    """Matrix that takes term counts to whitened latent coordinates, without the ``leading`` ones.

    The first directions tell languages and styles apart, which makes any two
    passages of one language alike; the rest tells passages apart.
    """
    dimension, width = len(idf), rank + extra
    test = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, width)))[0]
    weighted = _closed((test * idf[:, None]).astype(np.float32))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, dimension + 1), dtype=np.float64)
        weight = np.append(idf, 0.0)
        for batch in small_batches(batches, "t", BATCH_BYTES):
            owner, word = hashing.words(_texts(batch))
            if not len(word):
                continue
            terms, _, _ = _runs(owner, (word % np.uint64(dimension)).astype(np.int64), PASSAGE, dimension)
            # rows of A have unit length: equal terms of a passage are counted by their sorted order
            ordered = np.sort(terms, axis=1).ravel()
            new = np.ones(len(ordered), dtype=bool)
            new[1:] = ordered[1:] != ordered[:-1]
            new[::PASSAGE] = True
            at = np.flatnonzero(new)
            square = (np.diff(np.append(at, len(ordered))) * weight[ordered[at]]) ** 2
            norm = np.bincount(at // PASSAGE, square, minlength=len(terms))
            product = _sums(weighted, terms) / np.maximum(norm, 1e-9)[:, None].astype(np.float32)
            flat = terms.ravel()
            for k, weights in enumerate(np.ascontiguousarray(product.T, dtype=np.float64)):
                total[k] += np.bincount(flat, np.repeat(weights, PASSAGE), minlength=dimension + 1)
        z = (total * weight).T[:dimension]
        held = np.flatnonzero(z.any(axis=1))
        columns = [pa.array(held), *(pa.array(z[held, k].astype(np.float32)) for k in range(width))]
        yield pa.RecordBatch.from_arrays(columns, names=["term", *(f"z{k}" for k in range(width))])

    kinds = ", ".join(f"z{k} float" for k in range(width))
    sums = [F.sum(f"z{k}").alias(f"z{k}") for k in range(width)]
    rows = docs.select("t").mapInArrow(sketch, f"term long, {kinds}").groupBy("term").agg(*sums).collect()  # dimension rows at most
    z = np.zeros((dimension, width))
    for r in rows:
        z[r["term"]] = r[1:]
    small = test.T @ z
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    good = values > max(values.max(), 0) * 1e-9
    if not good.any():
        return np.zeros((dimension, 1), dtype=np.float32)
    left, singular, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    keep = (np.arange(len(singular)) < rank) & (singular > singular[0] * 1e-6)
    if keep.sum() > 2 * leading:
        keep[:leading] = False
    return (left[:, keep] / singular[keep] * idf[:, None]).astype(np.float32)


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one big-integer step per element of ``b``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        match = row & places.get(y, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    dimension: int = 8192,
    rank: int = 56,
    leading: int = 6,
    min_cosine: float = 0.45,
    min_overlap: float = 0.35,
    copy_share: float = 0.75,
    paraphrase_share: float = 0.55,
    answer_words: int = 8,
    answer_share: float = 0.75,
    block_items: int = 5_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, text_key, item_id, cosine, lcs_share, answer_share, kind of each leak; one row per id, text and item."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("t"))
    spark = docs.sparkSession
    schema = f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, text_key long, item_id long, cosine double, lcs_share double, answer_share double"
    items = benchmark.filter("text is not null").count()
    if not items:
        return spark.createDataFrame([], schema + ", kind string")
    found, n = _frequencies(plain, dimension)
    idf = np.log((n + 1) / (found + 1)) + 1e-3
    space = latent_space(plain, idf, rank, leading)
    blocks = -(-items // block_items)
    parts = None
    for number in range(blocks):
        block = benchmark.filter("text is not null").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        rows = block.select("item_id", "text").collect()
        owner, word = hashing.words([r["text"].encode() for r in rows])
        words = [word[owner == i].tolist() for i in range(len(rows))]
        term = (word % np.uint64(dimension)).astype(np.int64)
        windows: list[list[np.ndarray]] = [[] for _ in SCALES]
        of: list[list[int]] = [[] for _ in SCALES]
        for i in range(len(rows)):
            own = term[owner == i]
            if not len(own):
                continue
            scale = 0 if len(own) >= PASSAGE else 1
            size, step = SCALES[scale]
            last = max(len(own) - size, 0)
            for s in sorted({*range(0, last + 1, step), last}):
                windows[scale].append(space[own[s : s + size]].sum(axis=0))
                of[scale].append(i)
        queries = [_unit(np.array(w, dtype=np.float32).reshape(-1, space.shape[1])).T for w in windows]
        # block_items items at most
        held = spark.sparkContext.broadcast((space, idf, queries, [np.array(x, dtype=np.int64) for x in of], words, [r["item_id"] for r in rows]))
        part = plain.mapInArrow(_matcher(held, min_cosine, min_overlap, paraphrase_share, answer_words), schema)
        parts = part if parts is None else parts.union(part)
    if parts is None:
        return spark.createDataFrame([], schema + ", kind string")
    best = F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("best")
    copy = F.col("lcs_share") >= copy_share
    return (
        parts.groupBy("doc_id", "text_key", "item_id")
        .agg(best)
        .select("doc_id", "text_key", "item_id", "best.cosine", "best.lcs_share", "best.answer_share")
        .filter(copy | (F.col("answer_share") >= answer_share))
        .withColumn("kind", F.when(copy, "copy").otherwise("paraphrase"))
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share, kind ('copy' or 'paraphrase') of each leak found."""
    figures = F.struct("lcs_share", "answer_share", "cosine", "kind")
    best = _leaks(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(F.max(figures).alias("best"))
    return best.select("doc_id", "item_id", "best.cosine", "best.lcs_share", "best.answer_share", "best.kind")


def _matcher(held, min_cosine: float, min_overlap: float, least_share: float, answer_words: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, idf, queries, query_item, items, names = held.value
        dimension = len(space)
        closed, weight = _closed(space), np.append(idf, 0.0).astype(np.float32)
        holds = np.zeros((len(items), dimension + 1), dtype=bool)
        for i, own in enumerate(items):
            holds[i, np.array(own, dtype=np.uint64) % np.uint64(dimension)] = True
        for batch in small_batches(batches, "t", BATCH_BYTES):
            owner, word = hashing.words(_texts(batch))
            if not len(word):
                continue
            terms, of, start = _runs(owner, (word % np.uint64(dimension)).astype(np.int64), STRIDE, dimension)
            block = _sums(closed, terms)
            keys, cosines = [], []
            passage, blocks = block.copy(), 1
            # a passage's terms: those of its first block, then of the blocks behind it in the same document
            inside = [terms]
            for (size, _), query, item in sorted(zip(SCALES, queries, query_item, strict=True), key=lambda x: x[0]):
                for k in range(blocks, size // STRIDE):
                    same = np.zeros(len(block), dtype=bool)
                    if k < len(block):
                        same[:-k] = of[k:] == of[:-k]
                    behind = np.full_like(terms, dimension)
                    behind[same] = terms[np.flatnonzero(same) + k]
                    inside.append(behind)
                    passage[same] += block[np.flatnonzero(same) + k]
                blocks = size // STRIDE
                score = _unit(passage) @ query
                if not score.shape[1]:
                    continue
                at, column = np.divmod(np.flatnonzero(score >= min_cosine), score.shape[1])
                # chance neighbours share few of the words that carry weight
                own = np.hstack([part[at] for part in inside])
                heavy = weight[own]
                shared = (heavy * holds[item[column][:, None], own]).sum(axis=1)
                good = shared >= min_overlap * heavy.sum(axis=1)
                keys.append(at[good] * len(items) + item[column[good]])
                cosines.append(score[at[good], column[good]])
            pairs, back = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            if not len(pairs):
                continue
            cosine = np.zeros(len(pairs), dtype=np.float32)
            np.maximum.at(cosine, back, np.concatenate(cosines))
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            out = []
            for pair, near in zip(pairs.tolist(), cosine.tolist(), strict=True):
                place, i = divmod(pair, len(items))
                doc, first, own = int(of[place]), int(start[place]), items[i]
                region = word[max(bounds[doc], first - len(own)) : min(bounds[doc + 1], first + PASSAGE + len(own))].tolist()
                # words in common bound the subsequence from above
                if sum(map(set(region).__contains__, own)) < least_share * len(own):
                    continue
                share = lcs_length(own, region) / len(own)
                if share >= least_share:
                    answer = own[-answer_words:]
                    out.append((doc, names[i], near, share, lcs_length(answer, region) / len(answer)))
            if out:
                docs, ids, near, share, answer = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(at := pa.array(docs, pa.int64())),
                        batch.column("text_key").take(at),
                        pa.array(ids, pa.int64()),
                        pa.array(near, pa.float64()),
                        pa.array(share, pa.float64()),
                        pa.array(answer, pa.float64()),
                    ],
                    names=["doc_id", "text_key", "item_id", "cosine", "lcs_share", "answer_share"],
                )

    return match


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` without a leak, told apart by id and text; all columns unchanged."""
    found = _leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    leaks = stored(found.select(F.col("doc_id").alias("leak"), F.col("text_key").alias("leak_key")).distinct(), "leaks")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text_col).alias("text_key"))
    same = (F.col("text_key") == F.col("leak_key")) & F.col("row")[id_col].eqNullSafe(F.col("leak"))
    return rows.join(leaks, same, "left_anti").select("row.*")
