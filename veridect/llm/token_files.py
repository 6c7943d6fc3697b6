"""Token files: the ids of all documents in order of their id, Simple-8b coded, in shards.

Documents are range-partitioned by id; each task writes its range as one or
more files under a name of its own and returns one row per file. Only files
named in the returned manifest count, so a task that is run twice leaves an
unused file and no wrong result. A file is cut after ``file_tokens`` ids, which
bounds memory. Files are read back with Spark's binary reader.

File: magic, header (number of ids, words, blocks, escapes, documents), then
the arrays words, block offsets, escape places, escape values, document ids,
document id is set (bytes), tokens per document; all little-endian.

Defined cases: a NULL or empty text is the end id alone. Rows with a NULL id
come first; equal ids are ordered by text. Repeated rows are written each. An
empty table writes no file and reads back as no rows. Only the id (an integer)
and text columns are read; other columns may have any name.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridect.llm import simple8b
from veridect.llm.frames import small_batches, stored
from veridect.llm.tokens import encoder, tokenizer_path
from veridect.session import scratch_path

MAGIC = b"S8BTOK01"
HEADER = struct.Struct("<5q")
MANIFEST = "range int, part int, file string, n_tokens long, n_documents long, n_bytes long"
ROWS = "file string, place int, doc_id long, start_in_file long, n_tokens long, ids_crc32 long"


def pack_file(ids: np.ndarray, doc_ids: np.ndarray, is_set: np.ndarray, tokens: np.ndarray) -> bytes:
    arrays = [*simple8b.encode(ids), doc_ids.astype("<i8"), is_set.astype(np.uint8), tokens.astype("<i8")]
    words, offsets, places, _ = arrays[:4]
    return MAGIC + HEADER.pack(len(ids), len(words), len(offsets), len(places), len(doc_ids)) + b"".join(a.tobytes() for a in arrays)


def unpack_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, document ids, whether they are set, tokens per document."""
    if content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    n, n_words, n_blocks, n_escapes, n_docs = HEADER.unpack_from(content, len(MAGIC))
    at = len(MAGIC) + HEADER.size
    out = []
    kinds = [("<u8", n_words), ("<u8", n_blocks), ("<u8", n_escapes), ("<u8", n_escapes), ("<i8", n_docs), ("u1", n_docs), ("<i8", n_docs)]
    for kind, count in kinds:
        out.append(np.frombuffer(content, kind, count, at))
        at += out[-1].nbytes
    words, offsets, places, escaped, doc_ids, is_set, tokens = out
    return simple8b.decode(words, offsets, n, places, escaped), doc_ids, is_set, tokens


def _target(folder: str):
    from pyarrow import fs

    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:") :]
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str | None = None,
    end_id: int = 0,
    file_tokens: int = 4_000_000,
    range_bytes: int = 64 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Writes the files into ``folder``, which all executors reach; returns the manifest."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    end = np.array([end_id], dtype="<u4").tobytes()
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // range_bytes))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        target, base = _target(folder)
        target.create_dir(base, recursive=True)
        held: list[bytes] = []
        keys: list[int | None] = []
        part = size = 0

        def flush() -> pa.RecordBatch:
            name = f"tokens-{number:06d}-{part:04d}-{uuid.uuid4().hex}.s8b"
            is_set = np.array([k is not None for k in keys])
            doc_ids = np.array([k or 0 for k in keys], dtype=np.int64)
            tokens = np.array([len(h) // 4 for h in held], dtype=np.int64)
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            content = pack_file(ids, doc_ids, is_set, tokens)
            with target.open_output_stream(f"{base}/{name}") as out:
                out.write(content)
            row = {"range": number, "part": part, "file": name, "n_tokens": len(ids), "n_documents": len(keys), "n_bytes": len(content)}
            kinds = {"range": pa.int32(), "part": pa.int32(), "file": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()], names=list(row))

        for batch in small_batches(batches, "t"):
            coded = encoder(path)(batch.column("t").to_pylist())
            for key, ids in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                held.append(ids + end)
                keys.append(key)
                size += len(ids) // 4 + 1
                if size >= file_tokens:
                    yield flush()
                    held, keys, part, size = [], [], part + 1, 0
        if keys:
            yield flush()

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
        .repartitionByRange(int(ranges), "doc_id")
        .sortWithinPartitions("doc_id", "t")
    )
    return stored(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                ids, doc_ids, is_set, tokens = unpack_file(content.as_buffer().to_pybytes())
                coded = ids.astype("<u4").tobytes()
                ends = np.cumsum(tokens)
                crc = [zlib.crc32(coded[4 * (e - t) : 4 * e]) for e, t in zip(ends.tolist(), tokens.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * len(tokens), pa.string()),
                        pa.array(np.arange(len(tokens), dtype=np.int32)),
                        pa.array(doc_ids, pa.int64(), mask=is_set == 0),
                        pa.array(ends - tokens),
                        pa.array(tokens, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["file", "place", "doc_id", "start_in_file", "n_tokens", "ids_crc32"],
                )

    # one row per file: small beside the corpus, so one ordered window is enough
    before = F.sum("n_tokens").over(Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1))
    starts = manifest.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option(
        "pathGlobFilter", "*.s8b"
    ).load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(read, ROWS)
    return rows.join(starts, "file").select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32", "file", "place")


def token_file_digest(docs: DataFrame, **options) -> DataFrame:
    """Writes the files of ``docs`` into a new shared folder and reads them back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    manifest = write_token_files(docs, folder, **options)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string, place int")
    return read_token_files(spark, folder, manifest)
