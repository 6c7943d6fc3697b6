"""Outputs of several tables that readers see whole or not at all.

A writer puts its tables below ``versions/<name>`` and, when all of them are
written, a manifest named by its number beside them. The manifest is written
under another name and renamed, so it is there as a whole or not. Readers take
the tables of the highest manifest; a job that dies leaves files that nobody
reads, and a rerun writes a version of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFESTS = "manifests"


def _folder(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, root: str) -> list[int]:
    system, at = _folder(spark, f"{root}/{MANIFESTS}")
    if not system.exists(at):
        return []
    names = [status.getPath().getName() for status in system.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def commit(spark: SparkSession, root: str, write: Mapping[str, Callable[[str], None]]) -> dict[str, Any]:
    """Runs every writer on a folder of the new version, then publishes the version; returns its manifest.

    Of two jobs that end at once, both publish, and the higher number counts.
    """
    root = root.rstrip("/")
    version = uuid.uuid4().hex
    for part, writer in write.items():
        writer(f"{root}/versions/{version}/{part}")
    jvm = spark.sparkContext._jvm
    while True:
        number = max(_numbers(spark, root), default=0) + 1
        manifest = {"number": number, "version": version, "parts": sorted(write)}
        system, target = _folder(spark, f"{root}/{MANIFESTS}/{number:012d}.json")
        system.mkdirs(target.getParent())
        draft = jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFESTS}/draft-{version}")
        out = system.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not system.exists(target) and system.rename(draft, target):
            return manifest


def current(spark: SparkSession, root: str) -> dict[str, Any] | None:
    """The manifest of the version to read, or None if nothing has been published."""
    root = root.rstrip("/")
    numbers = _numbers(spark, root)
    if not numbers:
        return None
    text = spark.read.text(f"{root}/{MANIFESTS}/{numbers[-1]:012d}.json", wholetext=True).first()[0]
    return json.loads(text)


def part_path(spark: SparkSession, root: str, part: str) -> str:
    """The folder of a published table."""
    manifest = current(spark, root)
    if manifest is None or part not in manifest["parts"]:
        raise FileNotFoundError(f"no published {part} below {root}")
    return f"{root.rstrip('/')}/versions/{manifest['version']}/{part}"


def read_part(spark: SparkSession, root: str, part: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A published Parquet table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(part_path(spark, root, part))
