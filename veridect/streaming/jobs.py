"""Starting streams over file sources and reading what they produced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from veridect.session import scratch_path


def read_parquet_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """The table at ``path`` as a stream: one file, or a folder of part files.

    Spark's file stream reads folders. A single file is read as its folder,
    limited to the file's name; the check asks the file system Spark uses.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


class BoundedInput:
    """A table as a stream that is known to end.

    ``frame`` is the table followed by a heartbeat that ``finish`` writes: one
    row far in the future, which moves the watermark past every open run. Its
    own run stays open, so it never shows in the output. ``values`` fill
    columns that a filter before the watermark needs.
    """

    FAR = "2200-01-01 00:00:00"  # within what nanoseconds since 1970 can hold

    def __init__(self, spark: SparkSession, path: str, schema: StructType, event_time: str = "ts", **values: object):
        self.spark, self.schema, self.event_time, self.values = spark, schema, event_time, values
        self.folder = scratch_path(spark, "heartbeat")
        self._write("0 = 1")
        self.frame = read_parquet_stream(spark, path, schema).unionByName(read_parquet_stream(spark, self.folder, schema))

    def _write(self, condition: str = "true") -> None:
        held = {self.event_time: self.FAR, **self.values}
        row = self.spark.range(1).select(*[F.lit(held.get(f.name)).cast(f.dataType).alias(f.name) for f in self.schema])
        row.filter(condition).write.mode("append").parquet(self.folder)

    def finish(self) -> None:
        self._write()


class Run:
    """What a stream did: rows behind the watermark, summed over all its batches."""

    def __init__(self) -> None:
        self.dropped: dict[tuple[str, int], int] = {}

    @property
    def dropped_late(self) -> int:
        return sum(self.dropped.values())

    def follow(self, query: StreamingQuery) -> None:
        """Waits for the end; Spark keeps the last 100 progress reports only, so they are read along the way."""
        done = False
        while not done:
            done = query.awaitTermination(1)
            for progress in query.recentProgress:
                late = sum(int(operator["numRowsDroppedByWatermark"]) for operator in progress["stateOperators"])
                self.dropped[str(progress["runId"]), progress["batchId"]] = late


def run_append(stream: DataFrame, name: str, bounded: BoundedInput | None = None) -> tuple[DataFrame, Run]:
    """Runs a stream over all available input into parquet and reads it back.

    With ``bounded``, the end of the input is announced by its heartbeat, and
    the runs that were still open come out as well.
    """
    spark = stream.sparkSession
    root = scratch_path(spark, name)
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
    )
    run = Run()
    run.follow(writer.start())
    if bounded is not None:
        bounded.finish()
        run.follow(writer.start())
    return spark.read.schema(stream.schema).parquet(f"{root}/out"), run


def run_update(stream: DataFrame, keys: list[str], name: str, version: str = "version") -> DataFrame:
    """Runs an update-mode aggregate; of every key the row with the largest version wins.

    Each micro-batch writes its changed keys under its batch number, so a
    repeated batch overwrites itself.
    """
    spark = stream.sparkSession
    root = scratch_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    # the schema is given, as an empty input leaves no folder to infer it from
    if not _exists(spark, f"{root}/out"):
        return spark.createDataFrame([], stream.schema)
    written = spark.read.schema(stream.schema).parquet(f"{root}/out")
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), version).alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}") for c in values])


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Items scored as they arrive, by the same function as in batch."""
    return score(stream)
