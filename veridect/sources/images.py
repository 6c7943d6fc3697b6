"""Image metadata from encoded bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridect.sources.listing import look_into

METADATA_TYPE = T.StructType(
    [
        T.StructField("format", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
    ]
)
_PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
_JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}


def _jpeg_header(data: bytes | None) -> tuple[str | None, str | None, int | None, int | None]:
    """Format, colour mode and size from the first frame header; all None if there is none."""
    nothing = (None, None, None, None)
    at = 2
    while data and at + 9 < len(data):
        if data[at] != 0xFF:
            return nothing
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack(">HHB", data[at + 5 : at + 10])
            return "JPEG", _JPEG_MODES.get(parts), width, height
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return nothing


@F.pandas_udf(METADATA_TYPE)
def jpeg_header(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in contents:
        yield pd.DataFrame([_jpeg_header(c) for c in batch], columns=["format", "mode", "width", "height"]).astype(
            {"width": "Int32", "height": "Int32"}
        )


def _png_header(content: Column) -> Column:
    """The fields stand at fixed places of a PNG."""

    def number(first: int, size: int) -> Column:
        return F.conv(F.hex(F.substring(content, first, size)), 16, 10).cast("bigint")

    depth, kind = number(25, 1), number(26, 1)
    grey = F.when(depth == 1, "1").when(depth == 16, "I;16").otherwise("L")
    mode = F.when(kind == 0, grey)
    for code, name in _PNG_MODES.items():
        if code:
            mode = mode.when(kind == code, name)
    return F.struct(
        F.lit("PNG").alias("format"),
        mode.alias("mode"),
        number(17, 4).try_cast("int").alias("width"),
        number(21, 4).try_cast("int").alias("height"),
    )


def image_metadata(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds format, mode, width and height; unreadable images get ``valid = false``.

    PNG headers are read by column expressions. Only JPEG files, whose header
    has no fixed place, go to Python.
    """
    data = F.col(content)
    is_png = (
        (F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A")
        & (F.hex(F.substring(data, 13, 4)) == "49484452")
        & (F.octet_length(data) >= 26)
    )
    is_jpeg = F.hex(F.substring(data, 1, 2)) == "FFD8"
    read = df.withColumn("_meta", F.when(is_png, _png_header(data)).otherwise(jpeg_header(F.when(is_jpeg, data))))
    return read.select(*[c for c in df.columns if c != content], "_meta.*").withColumn("valid", F.col("format").isNotNull())


HEADER = "format string, mode string, width int, height int, bytes_read bigint"
#: Segments before the frame header that are stepped over; a file with more is not taken for an image.
MAX_SEGMENTS = 4_096


def _header_by_ranges(file: Any, size: int) -> tuple[str | None, str | None, int | None, int | None, int]:
    """Format, colour mode, size and the bytes it took: a few at each segment of a JPEG, 26 of a PNG."""
    taken = 0

    def at(place: int, length: int) -> bytes:
        nonlocal taken
        data = bytes(file.read_at(length, place)) if place < size else b""
        taken += len(data)
        return data

    head = at(0, 26)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) == 26:
        width, height, depth, kind = struct.unpack(">IIBB", head[16:26])
        grey = {1: "1", 16: "I;16"}.get(depth, "L")
        fits = max(width, height) < 2**31
        return ("PNG", grey if kind == 0 else _PNG_MODES.get(kind), width if fits else None, height if fits else None, taken)
    place, steps = 2, 0
    while head[:2] == b"\xff\xd8" and steps < MAX_SEGMENTS:
        part, steps = at(place, 10), steps + 1
        if len(part) < 10 or part[0] != 0xFF:
            break
        marker = part[1]
        if marker == 0xFF:
            place += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            place += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack(">HHB", part[5:10])
            return ("JPEG", _JPEG_MODES.get(parts), width, height, taken)
        else:
            place += 2 + struct.unpack(">H", part[2:4])[0]
    return (None, None, None, None, taken)


def read_headers(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """``HEADER`` columns and ``valid`` of image files below ``root``, from a listing.

    Files are opened in the tasks and read at the places the header needs, so a
    large one costs no more than a small one.
    """
    return look_into(files, root, path, HEADER, _header_by_ranges).withColumn("valid", F.col("format").isNotNull())


def invalid_count(metadata: DataFrame) -> DataFrame:
    return metadata.agg(F.count(F.lit(1)).alias("images"), F.count_if(~F.col("valid")).alias("invalid"))
