"""Helpers that the operators of this package share: folders, written intermediates, byte-bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse, islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from veridect.session import scratch_path


#: Lets Spark remove the shuffle files of a query as soon as it has ended, and not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    Cuts the lineage, and a lost executor costs a re-read instead of a
    recomputation. With ``drop_shuffles`` the shuffle files behind the rows go
    as soon as these are written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    if drop_shuffles:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets the driver collect what nobody refers to, upon which Spark's cleaner removes its shuffle files."""
    spark.sparkContext._jvm.System.gc()


#: How to forget what an operator remembers in a worker process, by operator.
_FORGET: dict[str, Callable[[], None]] = {}


def remembers(operator: str, forget: Callable[[], None]) -> None:
    _FORGET[operator] = forget


def make_room(operator: str) -> None:
    """Forgets what other operators remember in this worker, which Spark uses again for one stage after another."""
    for other, forget in _FORGET.items():
        if other != operator:
            forget()
    pa.default_memory_pool().release_unused()


class ByteBoundCache(dict):
    """A dictionary of strings or bytes that forgets what was not asked for lately.

    ``unknown`` says which of the wanted keys are missing and brings the others
    to the front; ``settle`` sets all entries back once they outgrow half of
    ``limit`` bytes, and those that were back then go. In between, as while one
    batch is worked on, nothing is dropped.
    """

    #: What an entry takes besides its contents, about.
    OVERHEAD = 200

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit
        self.back: dict[str | bytes, bytes] = {}
        self.held = self._counted = 0

    @staticmethod
    def contents(items: Iterable[tuple[str | bytes, bytes]]) -> list[int]:
        return [len(key) + len(value) for key, value in items]

    def unknown(self, wanted: set) -> list:
        # a set's own difference would go through all entries of a subclass
        missing = list(filterfalse(self.__contains__, wanted))
        if not self.back:
            return missing
        out = []
        for key in missing:
            value = self.back.get(key)
            if value is None:
                out.append(key)
            else:
                self[key] = value
        return out

    def settle(self) -> None:
        new = self.contents(islice(reversed(self.items()), len(self) - self._counted))
        self.held += sum(new) + self.OVERHEAD * len(new)
        if self.held > self.limit // 2:
            self.back = dict(self)
            self.clear()
            self.held = 0
        self._counted = len(self)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that ``column`` holds about ``max_bytes`` each, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if batch.column(column).nbytes <= max_bytes:
            yield batch
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for row, length in enumerate(lengths):
            if row > start and size + length > max_bytes:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += int(length)
        yield batch.slice(start, n - start)
