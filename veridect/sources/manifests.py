"""Manifests from directory listings.

A listing is a relation with a ``path`` column. :func:`list_files` makes one
from a directory; any inventory table serves as well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes, split names and directory layout of the corpora.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png")
AUDIO_SUFFIXES = ("wav", "mp3", "flac")
MUSIC_SUFFIXES = ("mp3", "wav", "flac", "m4a", "ogg")
NAMED_SPLITS = {"training": "training", "validation": "validation", "testing": "testing"}
SHORT_SPLITS = {"train": "training", "dev": "validation", "eval": "testing"}
NAMED_SPLIT_BASE = "for-2sec/for-2seconds"


class EmptyManifest(ValueError):
    """Raised when a source yields no rows."""


class UnlabelledPath(ValueError):
    """Raised when no label directory matches."""


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, length) of every file below ``root``; contents are never read.

    Spark skips names that start with ``_`` or ``.``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select("path", "length")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def has_suffix(path: Column, suffixes: Sequence[str], ignore_case: bool = True) -> Column:
    """True if the name has one of the suffixes after a non-empty stem."""
    flag = "(?i)" if ignore_case else ""
    return path.rlike(rf"{flag}[^/]\.({'|'.join(suffixes)})$")


def image_manifest(listing: DataFrame, order_by_name: bool = False) -> DataFrame:
    """Image files with the key they sort by: lower-cased path, or name."""
    path = F.col("path")
    key = F.lower(file_name(path)) if order_by_name else F.lower(path)
    return listing.filter(has_suffix(path, IMAGE_SUFFIXES)).withColumn("sort_key", key)


def flat_image_manifest(listing: DataFrame, root: str, uniform_case: bool = False) -> DataFrame:
    """Images directly in ``root``; ``uniform_case`` accepts only suffixes that
    are all lower or all upper case."""
    path = F.col("path")
    below = F.expr("substring(path, length(:root) + 1)".replace(":root", "'" + root.rstrip("/").replace("'", "\\'") + "/'"))
    direct = path.startswith(root.rstrip("/") + "/") & ~below.contains("/")
    if uniform_case:
        names = list(IMAGE_SUFFIXES) + [s.upper() for s in IMAGE_SUFFIXES]
        return listing.filter(direct & has_suffix(path, names, ignore_case=False))
    return listing.filter(direct & has_suffix(path, IMAGE_SUFFIXES))


def child_dir(path: Column, root: str) -> Column:
    """Name of the directory directly below ``root`` that holds the file."""
    prefix = root.rstrip("/") + "/"
    rest = F.substring(path, F.lit(len(prefix) + 1), F.length(path))
    return F.when(path.startswith(prefix) & rest.contains("/"), F.element_at(F.split(rest, "/"), 1))


def labels_from_dir(
    listing: DataFrame, root: str, labels: Sequence[str] = ("real", "fake"), columns: Mapping[str, bool] | None = None
) -> DataFrame:
    """Labels of each file by the directories chosen for them below ``root``.

    For every label the directory with exactly that name (any case) is chosen,
    else, unless strict, the first whose name contains it. ``columns`` names the
    results and says which are strict; by default ``label`` and ``strict_label``.
    Rows of other directories get NULL; see :func:`require_labels`. The listing
    is read for its directories and once more for its rows.
    """
    columns = columns or {"label": False, "strict_label": True}
    below = listing.withColumn("_dir", child_dir(F.col("path"), root))
    names = below.filter(F.col("_dir").isNotNull()).select("_dir").distinct()
    place = {label.lower(): i for i, label in enumerate(labels)}
    asked = F.explode(F.array(*[F.struct(F.lit(label).alias("_label"), F.lit(i).alias("_place")) for label, i in place.items()]))
    fits = names.select("_dir", F.lower("_dir").alias("_low"), asked.alias("_asked")).select("_dir", "_low", "_asked.*")
    exact = F.col("_low") == F.col("_label")
    first = F.struct(F.when(exact, 0).otherwise(1), F.col("_dir"))
    chosen = fits.filter(F.contains("_low", "_label")).groupBy("_label", "_place").agg(
        *[F.min_by(F.when(exact | F.lit(not strict), F.col("_dir")), first).alias(f"_dir_{name}") for name, strict in columns.items()]
    )
    # one directory may serve several labels; the exact name decides, then the order of the labels
    owned = chosen.select("_label", "_place", F.inline(F.array(*[F.struct(F.lit(n).alias("_as"), F.col(f"_dir_{n}").alias("_dir")) for n in columns])))
    rank = F.struct(F.when(F.lower("_dir") == F.col("_label"), 0).otherwise(1), F.col("_place"))
    owner = owned.filter(F.col("_dir").isNotNull()).groupBy("_dir").agg(
        *[F.min_by(F.when(F.col("_as") == name, F.col("_label")), F.when(F.col("_as") == name, rank)).alias(name) for name in columns]
    )
    # at most a row per label and column
    return below.drop(*columns).join(F.broadcast(owner), "_dir", "left").select(*[c for c in listing.columns if c not in columns], *columns)


def label_from_dir(
    listing: DataFrame, root: str, labels: Sequence[str] = ("real", "fake"), strict: bool = False
) -> DataFrame:
    """:func:`labels_from_dir` for one way of choosing."""
    return labels_from_dir(listing, root, labels, {"label": strict})


def require_labels(labelled: DataFrame, labels: Sequence[str] = ("real", "fake")) -> DataFrame:
    """Fails in the job if a file carries none of the labels."""
    known = F.coalesce(F.col("label").isin(*labels), F.lit(False))
    message = F.concat(F.lit("no label directory for "), F.col("path"))
    return labelled.withColumn("label", F.when(known, F.col("label")).otherwise(F.raise_error(message).cast("string")))


def corpus_manifest(listing: DataFrame, base: str, splits: Mapping[str, str], source: str) -> DataFrame:
    """``<base>/<split>/<label>/<file>`` as (file_path, label, split, source).

    Suffixes are matched in lower case only, labels and split folders exactly;
    everything else, deeper folders included, is ignored.
    """
    prefix = base.rstrip("/") + "/"
    rest = F.split(F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path")), "/")
    names = F.create_map(*[F.lit(x) for pair in splits.items() for x in pair])
    return (
        listing.filter(F.col("path").startswith(prefix) & F.col("path").rlike(rf"\.({'|'.join(AUDIO_SUFFIXES)})$"))
        .withColumn("_rest", rest)
        .filter((F.size("_rest") == 3) & F.get("_rest", F.lit(1)).isin("real", "fake"))
        .select(
            F.col("path").alias("file_path"),
            F.get("_rest", F.lit(1)).alias("label"),
            F.try_element_at(names, F.get("_rest", F.lit(0))).alias("split"),
            F.lit(source).alias("source"),
        )
        .filter(F.col("split").isNotNull())
    )


def audio_manifest(listing: DataFrame, named_root: str, short_root: str) -> DataFrame:
    """Union of the corpus with full split names and the one with short names."""
    named = corpus_manifest(listing, f"{named_root.rstrip('/')}/{NAMED_SPLIT_BASE}", NAMED_SPLITS, "FakeOrReal")
    short = corpus_manifest(listing, short_root, SHORT_SPLITS, "SceneFake")
    return named.unionByName(short)


def audio_discovery(listing: DataFrame, suffixes: Sequence[str] = MUSIC_SUFFIXES) -> DataFrame:
    """Every audio file below a directory; sort by path where order matters."""
    return listing.filter(has_suffix(F.col("path"), suffixes, ignore_case=False))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raises if there is no row; reads until the first one."""
    if df.isEmpty():
        raise EmptyManifest(f"no rows in {what}")
    return df
