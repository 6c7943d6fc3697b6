"""Folders listed and files looked into by tasks, so that no index of files forms in the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridect.session import scratch_path

ENTRIES = "name string, length bigint, is_folder boolean"
#: Entries of one batch that a task hands on.
BATCH_ENTRIES = 10_000


def file_system(root: str) -> tuple[Any, str]:
    """The file system of ``root`` as tasks see it, and the path of ``root`` in it."""
    from pyarrow import fs

    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root.removeprefix("file:")


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file below ``root``, in folders of any depth.

    A table of folders is listed level by level: each task lists its folders,
    and the folders found are the next level's table. The driver learns how many
    there are, and no names. All files count, also those whose names Spark
    skips; links to folders are not followed. A missing ``root`` fails.

    Folders are listed through Arrow's file systems. For stores that only Spark
    can read, use :func:`veridect.sources.manifests.list_files`.
    """
    out = scratch_path(spark, "listing")
    base = root.rstrip("/")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyarrow import fs

        system, top = file_system(base)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch.column("name").to_pylist():
                inside = f"{top}/{folder}" if folder else top
                found = system.get_file_info(fs.FileSelector(inside))
                for start in range(0, len(found), BATCH_ENTRIES):
                    part = [
                        i
                        for i in found[start : start + BATCH_ENTRIES]
                        if i.type == fs.FileType.File or i.type == fs.FileType.Directory and not (local and os.path.islink(i.path))
                    ]
                    names = [f"{folder}/{i.base_name}" if folder else i.base_name for i in part]
                    is_folder = [i.type == fs.FileType.Directory for i in part]
                    sizes = [None if d else i.size for i, d in zip(part, is_folder, strict=True)]
                    columns = [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(is_folder, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, ["name", "length", "is_folder"])

    folders, count, level = spark.createDataFrame([("",)], "name string"), 1, 0
    while count:
        tasks = min(count, 4 * spark.sparkContext.defaultParallelism)
        folders.repartition(tasks, "name").mapInArrow(entries, ENTRIES).write.parquet(f"{out}/level={level}")
        listed = spark.read.schema(ENTRIES).parquet(f"{out}/level={level}")
        folders = listed.filter("is_folder").select("name")
        count, level = folders.count(), level + 1
    every = spark.read.schema(f"{ENTRIES}, level int").parquet(out)
    return every.filter("NOT is_folder").select(F.concat(F.lit(f"{base}/"), "name").alias("path"), "length")


def look_into(files: DataFrame, root: str, path: str, result: str, look: Callable[[Any, int], tuple]) -> DataFrame:
    """Adds what ``look(file, size)`` finds in each file below ``root``, opened for reads at any place.

    ``result`` is the schema of its tuples; a file that cannot be read gives NULLs.
    """
    names = [part.strip().split(" ")[0] for part in result.split(",")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + f", {result}"
    kinds = {f.name: f.dataType for f in files.sparkSession.createDataFrame([], result).schema.fields}
    base = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        system, top = file_system(base)
        for batch in batches:
            rows = []
            for place in batch.column(path).to_pylist():
                try:
                    with system.open_input_file(top + place.removeprefix(base)) as file:
                        rows.append(look(file, file.size()))
                except (OSError, AttributeError):
                    rows.append((None,) * len(names))
            found = [pa.array([r[i] for r in rows], to_arrow_type(kinds[n])) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *names])

    return files.mapInArrow(run, schema)
