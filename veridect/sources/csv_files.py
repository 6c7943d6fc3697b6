"""CSV files read by the names in their own headers, with the records that do not fit set aside."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridect.operators.ordered import join_bounded
from veridect.session import cut_lineage

QUOTED = '"([^"]|"")*"'


@dataclass
class NamedCsv:
    """``rows`` in the schema asked for; ``rejected``: file, record and reason of every other record."""

    rows: DataFrame
    rejected: DataFrame


def _plain_cells(line: Column) -> Column:
    """Cells of a header line: column names hold no commas."""
    return F.transform(F.split(F.regexp_replace(line, "^﻿", ""), ","), lambda c: F.btrim(F.btrim(c), F.lit('"')))


def _wide(line: Column, width: int) -> Column:
    """The cells of a record with quotes as an array of ``width`` texts."""
    names = [f"c{i}" for i in range(width)]
    cells = F.from_csv(line, ", ".join(f"{n} string" for n in names), {"escape": '"', "mode": "PERMISSIVE"})
    # the lambda reads the parsed record once for all its cells
    return F.get(F.transform(F.array(cells), lambda c: F.array(*[c[n] for n in names])), F.lit(0))


def read_named_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, required: Sequence[str]) -> NamedCsv:
    """All CSV files below ``path`` in the columns of ``schema``, which are found by name.

    A file's header is the line that holds all ``required`` names, so files of
    one folder may differ in order and number of columns. Names that a file does
    not have are NULL, and others are not read. Records with more or fewer cells than their
    header, with an open quote, with text where ``schema`` wants a number, or in
    files without a header or with two different ones are rejected, never
    shifted. Text columns take any cell. A record ends at the end of its line.

    Headers are found in the tasks and come back as one row a file.
    """
    lines = spark.read.text(path).select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("file"))
    lines = lines.filter(F.btrim("record") != "")
    names = _plain_cells(F.col("record"))
    # most lines lack one of the names, which a plain search tells before their cells are looked at
    tests = [F.col("record").contains(r) for r in required] + [F.array_contains(names, r) for r in required]
    is_header = reduce(and_, tests)
    headers = cut_lineage(
        lines.filter(is_header)
        .groupBy("file")
        .agg(F.min(names).alias("header"), (F.min(names) != F.max(names)).alias("several"))
        .select(
            "file",
            "several",
            F.size("header").alias("width"),
            *[F.array_position("header", F.lit(f.name)).cast("int").alias(f"_at_{f.name}") for f in schema.fields],
        )
    )
    files, width = headers.agg(F.count(F.lit(1)), F.max("width")).first()
    found = join_bounded(lines.filter(~is_header), headers, ["file"], files, "left")
    quoted = F.col("record").contains('"')
    cells = F.when(quoted, _wide(F.col("record"), max(width or 1, 1))).otherwise(F.split("record", ","))
    # behind a generator a record is cut once; as a plain column it would be cut again wherever a filter asks for a cell
    texts = found.withColumn("cells", F.explode(F.array(cells)))
    count = F.when(quoted, F.regexp_count(F.regexp_replace("record", QUOTED, ""), F.lit(",")) + 1).otherwise(F.size("cells"))

    def cell(name: str) -> Column:
        """The text of a cell; empty ones are NULL, as are names that the header does not have (place 0)."""
        return F.nullif(F.get("cells", F.col(f"_at_{name}") - 1), F.lit(""))

    texts = texts.withColumns({f"_text_{f.name}": cell(f.name) for f in schema.fields})
    reason = (
        F.when(F.col("width").isNull(), F.lit(f"no header with {', '.join(required)}"))
        .when(F.col("several"), "two different headers")
        .when(quoted & F.regexp_replace("record", QUOTED, "").contains('"'), "open quote")
        .when(count != F.col("width"), F.concat(count.cast("string"), F.lit(" cells where the header has "), F.col("width").cast("string")))
    )
    for field in schema.fields:
        if field.dataType != T.StringType():
            text = F.col(f"_text_{field.name}")
            misfit = text.isNotNull() & (F.btrim(text) != "") & F.btrim(text).try_cast(field.dataType).isNull()
            reason = reason.when(misfit, F.concat(F.lit(f"{field.name} is no {field.dataType.simpleString()}: "), text))
    judged = texts.withColumn("reason", reason)

    def value(field: T.StructField) -> Column:
        text = F.col(f"_text_{field.name}")
        return text if field.dataType == T.StringType() else F.btrim(text).try_cast(field.dataType)

    return NamedCsv(
        judged.filter("reason IS NULL").select(*[value(f).alias(f.name) for f in schema.fields]),
        judged.filter("reason IS NOT NULL").select("file", "record", "reason"),
    )
