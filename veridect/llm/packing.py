"""Best-two-fit packing of token documents into sequences of bounded length.

Piece lengths have at most ``max_tokens`` different values, so their histogram
is small whatever the corpus, and bins are planned on it: a bin is filled
greedily with the longest lengths that still fit; then its shortest piece makes
room for two unpacked pieces if they fill the widened gap more tightly. One
plan entry stands for as many equal bins as the counts allow. Pieces are dealt
to the plan by their rank among pieces of equal length; ranks come from counts
per (length, bucket), so a length that many pieces share is split over tasks.

Defined cases: a NULL or empty text is a document of the end id alone. Repeated
rows are packed each. Equal lengths are ranked by bucket, then by the piece's
columns, so results do not depend on partitioning (rows equal in all columns
may swap places). An empty table gives no sequences. Only the id and text
columns are read; other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridect.llm.frames import make_room, small_batches, stored
from veridect.llm.tokens import encoder, tokenizer_path


def token_pieces(
    docs: DataFrame,
    tokenizer: str | None = None,
    max_tokens: int = 4096,
    end_id: int = 1,
    keep_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of each piece of at most ``max_tokens``."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    end = np.array([end_id], dtype="<u4").tobytes()
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            *([T.StructField("ids", T.ArrayType(T.LongType()))] if keep_ids else []),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("tokens")
        for batch in small_batches(batches, "t"):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, coded in enumerate(encoder(path)(batch.column("t").to_pylist())):
                coded += end
                for k, at in enumerate(range(0, len(coded), 4 * max_tokens)):
                    part = coded[at : at + 4 * max_tokens]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            columns = [
                batch.column("doc_id").take(pa.array(rows, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
                *([pa.array(ids, pa.list_(pa.int64()))] if keep_ids else []),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(cut, schema)


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins as (pattern, repetitions); a pattern is [(length, copies), ...], longest first."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = np.arange(size + 1)
    # the longest available length up to each place, 0 if none
    below = np.maximum.accumulate(np.where(left > 0, lengths, 0))
    bins = []
    while below[size]:
        pattern: dict[int, int] = {}
        room = size
        length = int(below[room])
        while length and room:
            copies = min(int(left[length]), room // length)
            pattern[length] = copies
            room -= copies * length
            length = int(below[min(room, length - 1)])
        if room and len(pattern) + max(pattern.values()) > 2:
            short = min(pattern)
            gap = room + short
            free = left.copy()
            for used, copies in pattern.items():
                free[used] -= copies
            fits = np.where(free[: gap + 1] > 0, lengths[: gap + 1], 0)
            reach = np.maximum.accumulate(fits)
            first = np.flatnonzero(fits)
            second = reach[gap - first]
            # two of one length need two free pieces; else the next shorter length
            twice = (second == first) & (free[first] < 2)
            second[twice] = reach[np.maximum(first[twice] - 1, 0)]
            sums = np.where(second > 0, first + second, 0)
            if len(sums) and sums.max() > short:
                best = int(sums.argmax())
                pattern[short] -= 1
                for new in (int(first[best]), int(second[best])):
                    pattern[new] = pattern.get(new, 0) + 1
                pattern = {used: copies for used, copies in pattern.items() if copies}
        repeat = min(int(left[used]) // copies for used, copies in pattern.items())
        gone = False
        for used, copies in pattern.items():
            left[used] -= repeat * copies
            gone |= left[used] == 0
        if gone:
            below = np.maximum.accumulate(np.where(left > 0, lengths, 0))
        bins.append((sorted(pattern.items(), reverse=True), repeat))
    return bins


def _segments(bins: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """For each length, consecutive ranges of ranks: first rank, first sequence, copies per sequence, offset of the first copy."""
    taken: dict[int, int] = {}
    rows = []
    sequence = 0
    for pattern, repeat in bins:
        offset = 0
        for length, copies in pattern:
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence, copies, offset))
            taken[length] = rank + repeat * copies
            offset += length * copies
        sequence += repeat
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "rank", "sequence", "copies", "offset"), table.T, strict=True))


def pack_pieces(pieces: DataFrame, max_tokens: int = 4096, bucket_rows: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to the pieces. ``pieces`` should be stored, as it is read three times."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_tokens rows at most
    plan = _segments(best_two_fit(counts, max_tokens))
    held = spark.sparkContext.broadcast(plan)  # bounded by the number of lengths, not of documents

    buckets = max(64, sum(counts.values()) // bucket_rows)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = (
        dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    )
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = (
        dealt.withColumn("place", place)
        .join(starts, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("place") - 1)
        .select(*pieces.columns, "rank")
    )
    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        key = (p["length"] << 44) + p["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            step, copy = np.divmod(rank - p["rank"][at], p["copies"][at])
            columns = [batch.column(c) for c in names]
            columns += [pa.array(p["sequence"][at] + step), pa.array(p["offset"][at] + copy * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return ranked.mapInArrow(assign, schema)


def pack_documents(docs: DataFrame, max_tokens: int = 4096, keep_ids: bool = True, **options) -> DataFrame:
    """Pieces of all documents with their ids and their place in a sequence."""
    pieces = stored(token_pieces(docs, max_tokens=max_tokens, keep_ids=keep_ids, **options), "pieces")
    return pack_pieces(pieces, max_tokens)
