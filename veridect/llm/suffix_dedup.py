"""Exact removal of long repeated byte strings, by suffix buckets and a difference cover.

Two suffixes that agree on ``length`` bytes also agree, somewhere in the first
v bytes, at a place that lies in the difference cover modulo v for both of
them, and there on the next length - v + 1 bytes. So

1. the cover sample: every suffix at a cover place is ranked by its first
   length - v + 1 bytes; ranks shared by two suffixes are the long ties;
2. only suffixes up to v - 1 bytes before a tied sample can tie on ``length``
   bytes; they are ranked by all ``length`` bytes.

Ranking deals suffixes to buckets by the leading bits of a hash of their bytes
(only equality matters, so the hash order serves as suffix order), and a task
sorts one bucket at a time; the number of buckets follows the input, so a
bucket has a bounded size. Equal suffixes within a batch of texts are tied at
once and only one of them goes to its bucket, so a passage that a third of all
documents share is one entry per batch.

Ranks of step 1 have 32 bits plus the bucket; a chance tie there only costs
time, and as buckets have a bounded size, their share does not grow. Ranks of
step 2 have 56 bits plus the bucket: with 10**8 candidates the chance that any
two different strings meet is below one in a hundred.

Defined cases: a NULL text counts as empty; nothing is removed from texts
shorter than ``length``. Rows with equal texts are copies of each other, also
if their ids are equal. An empty table gives an empty result. Only the id and
text columns are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridect.llm.frames import release, small_batches, stored
from veridect.llm.hashing import ByteHashes

# multipliers' orbits that make perfect difference sets, modulus -> (multiplier, orbit starts).
ORBITS = {7: (2, (1,)), 73: (2, (1,)), 273: (2, (1, 91, 117))}
RANK_BYTES = "bucket int, docs binary, counts binary, places binary, ranks binary"
BUCKET_BYTES = 24 << 20


def difference_cover(length: int) -> tuple[int, np.ndarray]:
    """Modulus v and places such that any two shifts meet in a place; v is the largest that suits ``length``."""
    v = max(m for m in ORBITS if 10 * m <= 7 * length or m == min(ORBITS))
    step, starts = ORBITS[v]
    places = set()
    for start in starts:
        x = start
        while x not in places:
            places.add(x)
            x = x * step % v
    return v, np.array(sorted(places))


def _planes(values: np.ndarray) -> bytes:
    """Differences of 32-bit values, byte planes apart, so that the shuffle's compression sees the zeros."""
    return np.diff(values.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32)


def _ranked(doc: np.ndarray, place: np.ndarray, hashed: np.ndarray, buckets: int, width: int) -> Iterator[dict]:
    """Rows for the buckets; suffixes tied within the batch also go out as known (negative bucket)."""
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    tied = np.zeros(len(order), dtype=bool)
    tied[1:] |= same
    tied[:-1] |= same
    first = np.ones(len(order), dtype=bool)
    first[1:] = ~same
    known = np.sort(order[tied])
    sent = np.sort(order[first])
    if len(known):
        yield _row(-1 - int(hashed[known[0]] % np.uint64(buckets)), doc[known], place[known], np.zeros(0, np.uint64), width)
    bucket = ((hashed[sent] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)):
        mine = sent[by[bounds[b] : bounds[b + 1]]]
        yield _row(int(b), doc[mine], place[mine], hashed[mine], width)


def _row(bucket: int, doc: np.ndarray, place: np.ndarray, hashed: np.ndarray, width: int) -> dict:
    start = np.flatnonzero(np.diff(doc, prepend=doc[0] + 1 if len(doc) else 0))
    return {
        "bucket": bucket,
        "docs": doc[start].astype("<i8").tobytes(),
        "counts": np.diff(np.append(start, len(doc))).astype("<u4").tobytes(),
        "places": _planes(place),
        "ranks": np.ascontiguousarray(hashed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes(),
    }


def _ties(width: int):
    """Of one bucket, the places of suffixes whose rank another suffix shares, per document."""

    def tie(rows: pd.DataFrame) -> pd.DataFrame:
        doc = np.concatenate([np.repeat(np.frombuffer(d, "<i8"), np.frombuffer(c, "<u4")) for d, c in zip(rows["docs"], rows["counts"], strict=True)])
        place = np.concatenate([_unplanes(p) for p in rows["places"]])
        if rows["bucket"].iloc[0] >= 0:
            raw = np.concatenate([np.frombuffer(r, np.uint8).reshape(-1, width) for r in rows["ranks"]])
            rank = np.zeros((len(raw), 8), dtype=np.uint8)
            rank[:, :width] = raw
            rank = rank.view("<u8").ravel()
            order = np.argsort(rank, kind="stable")
            same = rank[order[1:]] == rank[order[:-1]]
            some = np.zeros(len(order), dtype=bool)
            some[1:] |= same
            some[:-1] |= same
            some = order[some]
            # copies of one text send equal rows: a tie needs two different places
            some = some[np.lexsort((place[some], doc[some], rank[some]))]
            new = np.ones(len(some), dtype=bool)
            new[1:] = (rank[some[1:]] != rank[some[:-1]]) | (doc[some[1:]] != doc[some[:-1]]) | (place[some[1:]] != place[some[:-1]])
            some = some[new]
            run = np.cumsum(np.diff(rank[some], prepend=rank[some[:1]]) != 0)
            some = some[np.bincount(run, minlength=1)[run] > 1] if len(some) else some
            doc, place = doc[some], place[some]
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        start = np.flatnonzero(np.diff(doc, prepend=doc[0] + 1)) if len(doc) else np.zeros(0, np.int64)
        ends = np.append(start[1:], [len(doc)] * (len(doc) > 0)).astype(np.int64)
        return pd.DataFrame({"text_key": doc[start], "places": [_planes(place[a:b]) for a, b in zip(start, ends, strict=True)]})

    return tie


def _tied_places(texts: DataFrame, suffixes, size: int, width: int, buckets: int) -> DataFrame:
    """text_key and lists of the places whose next ``size`` bytes occur at another place, among those ``suffixes`` names."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t", 2 << 20):
            keys = batch.column("text_key").to_numpy()
            once = np.sort(np.unique(keys, return_index=True)[1])
            batch, keys = batch.take(pa.array(once)), keys[once]
            data = [t.encode() for t in batch.column("t").to_pylist()]
            places = suffixes(data, batch)
            counts = [len(p) for p in places]
            if not sum(counts):
                continue
            first = np.cumsum([0] + [len(d) for d in data[:-1]])
            place = np.concatenate(places)
            start = place + np.repeat(first, counts)
            hashed = ByteHashes(np.frombuffer(b"".join(data), dtype=np.uint8)).ranges(start, start + size)
            rows = list(_ranked(np.repeat(keys, counts), place, hashed, buckets, width))
            yield pa.RecordBatch.from_pylist(
                rows, schema=pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("docs", "counts", "places", "ranks"))])
            )

    ranked = texts.mapInArrow(rank, RANK_BYTES)
    return ranked.groupBy("bucket").applyInPandas(_ties(width), "text_key long, places binary").groupBy("text_key").agg(F.collect_list("places").alias("places"))


def _merged(parts: list[bytes] | None) -> np.ndarray:
    return np.unique(np.concatenate([_unplanes(p) for p in parts])).astype(np.int64) if parts else np.zeros(0, np.int64)


def remove_repeated_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (first and last byte + 1 of each removed run), clean_bytes where bytes went."""
    v, cover = difference_cover(length)
    window = length - v + 1
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("text_key", F.xxhash64("t"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    total = plain.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    least = plain.sparkSession.sparkContext.defaultParallelism

    def sample(data: list[bytes], batch: pa.RecordBatch) -> list[np.ndarray]:
        out = []
        for d in data:
            n = max(len(d) - window + 1, 0) if len(d) >= length else 0
            at = (np.arange(-(-n // v))[:, None] * v + cover).ravel()
            out.append(at[at < n])
        return out

    long = plain.filter(F.octet_length("t") >= length).select("text_key", "t")
    tied = _tied_places(long, sample, window, 4, max(2 * least, int(total * len(cover) / v * 8) // BUCKET_BYTES))
    copies = plain.groupBy("text_key").agg(F.count("*").alias("n")).filter("n > 1")
    side = tied.join(copies, "text_key", "full")
    suspect = F.col("places").isNotNull()
    staged = stored(
        plain.join(side, "text_key", "left").select(
            "doc_id",
            "text_key",
            F.octet_length("t").cast("long").alias("n_bytes"),
            F.sha2("t", 256).alias("sha"),
            (F.coalesce("n", F.lit(1)) > 1).alias("copied"),
            F.when(suspect, F.col("t")).alias("t"),
            "places",
        ),
        "suspects",
        drop_shuffles=True,
    )

    # what step 1 shuffled is of no more use
    del tied, side, copies, long
    release(plain.sparkSession)

    def candidates(data: list[bytes], batch: pa.RecordBatch) -> list[np.ndarray]:
        out = []
        for d, parts in zip(data, batch.column("places").to_pylist(), strict=True):
            edge = np.zeros(max(len(d) - length + 1, 0) + 1, dtype=np.int32)
            at = _merged(parts)
            np.add.at(edge, np.clip(at - v + 1, 0, len(edge) - 1), 1)
            np.add.at(edge, np.clip(at + 1, 0, len(edge) - 1), -1)
            out.append(np.flatnonzero(np.cumsum(edge[:-1]) > 0))
        return out

    suspects = staged.filter("t is not null")
    # written first, so that the buckets' shuffle and that of the texts do not lie on disk together
    found = _tied_places(suspects.select("text_key", "t", "places"), candidates, length, 7, max(2 * least, total // BUCKET_BYTES))
    found = stored(found, "found", drop_shuffles=True)
    release(plain.sparkSession)
    matched = suspects.select("doc_id", "text_key", "t", "copied").join(found, "text_key", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_removed", "n_spans", "kept_sha256", "spans", "clean_bytes"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
        for batch in small_batches(batches, "t"):
            out: list[list] = [[] for _ in names]
            for t, copied, parts in zip(*(batch.column(c).to_pylist() for c in ("t", "copied", "places")), strict=True):
                data = np.frombuffer(t.encode(), dtype=np.uint8)
                edge = np.zeros(len(data) + 1, dtype=np.int32)
                if copied:
                    edge[0] = 1
                at = _merged(parts)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                kept = data[~gone].tobytes()
                for column, value in zip(out, (int(gone.sum()), len(turn), hashlib.sha256(kept).hexdigest(), turn.tolist(), kept), strict=True):
                    column.append(value)
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            size = pa.array([len(t.encode()) for t in batch.column("t").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, *columns], names=["doc_id", "n_bytes", *names])

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>, clean_bytes binary"
    whole = F.col("copied") & (F.col("n_bytes") >= length)
    none = F.expr("cast(array() as array<array<bigint>>)")
    rest = staged.filter("t is null").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.lit(0)).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(none).alias("spans"),
        F.when(whole, F.lit(b"")).alias("clean_bytes"),
    )
    return matched.mapInArrow(cut, schema).union(rest)
