"""Seeded sampling, splitting and balancing.

All randomness is ``md5(id ':' seed)``, so a sample depends on the ids and
the seed alone. Small samples are the rows of the lowest keys, of which each task
keeps its own before they meet. Other exact counts come from cut keys: hash buckets are counted, the
bucket that holds the wanted rank is searched, and one key per class, which is
broadcast, decides for every row. Rows are not shuffled for it. If a cut falls
among rows of equal ids, these are numbered in the order of a hash of the whole
row, so counts stay exact. A NULL id is an id of its own.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridect.operators.ordered import join_bounded, join_on, row_positions, running_totals
from veridect.session import cut_lineage

FIRST_DIGITS, BUCKET_ROWS = 3, 2_000_000
#: Rows a class up to which samples are the lowest keys of each task, merged; and the groups of tasks that merge first.
LOWEST_ROWS, MERGE_GROUPS = 100_000, 64


@dataclass(frozen=True)
class Buckets:
    """Rows per class and leading hash digits, (classes..., _bucket, _n)."""

    counts: DataFrame
    digits: int
    rows: int
    classes: int

def _text_id(id_column: Column) -> Column:
    return F.coalesce(id_column.cast("string"), F.lit(""))


def hash_key(id_column: Column, seed: int) -> Column:
    return F.md5(F.concat(_text_id(id_column), F.lit(f":{seed}")))


def order_key(id_column: Column, seed: int) -> Column:
    """Order of the shuffle: the hash, then the id."""
    return F.concat(hash_key(id_column, seed), F.lit(":"), _text_id(id_column))


def _keyed(df: DataFrame, id_col: str, seed: int, digits: int) -> DataFrame:
    keyed = df.withColumn("_key", order_key(F.col(id_col), seed))
    return keyed.withColumn("_bucket", F.substring("_key", 1, digits))


def bucket_counts(df: DataFrame, classes: Sequence[str], id_col: str, seed: int) -> Buckets:
    """Counts hash buckets, finer ones if the first are large.

    The counts are materialised because several steps need them. Hashes are
    even, so the largest bucket tells how many more digits keep every bucket
    small enough to sort in one task.
    """

    def count(digits: int) -> DataFrame:
        keyed = _keyed(df.select(*classes, id_col), id_col, seed, digits)
        return cut_lineage(keyed.groupBy(*classes, "_bucket").agg(F.count(F.lit(1)).alias("_n")))

    counts, digits = count(FIRST_DIGITS), FIRST_DIGITS
    kinds = F.count_distinct(F.struct(*classes))
    size = counts.agg(F.max("_n").alias("largest"), F.count(F.lit(1)).alias("rows"), kinds.alias("classes")).first()
    rows = size["rows"]
    if (size["largest"] or 0) > BUCKET_ROWS:
        digits += math.ceil(math.log(size["largest"] / BUCKET_ROWS, 16))
        counts = count(digits)
        rows = counts.count()
    return Buckets(counts, digits, rows, size["classes"])


def class_sizes(buckets: Buckets, classes: Sequence[str]) -> DataFrame:
    return buckets.counts.groupBy(*classes).agg(F.sum("_n").alias("available"))


def cut_keys(
    df: DataFrame, buckets: Buckets, classes: Sequence[str], id_col: str, seed: int, ranks: DataFrame
) -> tuple[DataFrame, int, bool]:
    """The order key at each wanted rank, materialised, the row count, and
    whether a cut falls among rows of one key.

    ``ranks`` holds (classes..., <tag>...), one row per class and a rank per
    tag column. The result has the same classes and ``_cut_<tag>`` columns: NULL
    where the class is shorter than the rank, so that all of it lies below, and
    the empty string for ranks of zero or less, so that nothing does.
    ``_take_<tag>`` says how many rows of the cut's own key lie below it.
    """
    classes = list(classes)
    tags = [c for c in ranks.columns if c not in classes]
    long = ranks.unpivot(classes, tags, "tag", "rank")
    running = Window.partitionBy(*classes).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ladder = buckets.counts.withColumn("_upto", F.sum("_n").over(running)).withColumn(
        "_before", F.col("_upto") - F.col("_n")
    )
    wanted = (
        join_on(ladder, long, classes)
        .filter((F.col("_before") < F.col("rank")) & (F.col("rank") <= F.col("_upto")))
        .select(*classes, "_bucket", "tag", (F.col("rank") - F.col("_before")).alias("_inner"))
    )
    inside = Window.partitionBy(*classes, "_bucket", "tag").orderBy("_key")
    keyed = _keyed(df.select(*classes, id_col), id_col, seed, buckets.digits)
    # one row per class and tag
    near = join_bounded(keyed, wanted, [*classes, "_bucket"], buckets.classes * len(tags))
    alike = Window.partitionBy(*classes, "_bucket", "tag", "_key")
    found = (
        near.withColumns(
            {"_rn": F.row_number().over(inside), "_first": F.rank().over(inside), "_alike": F.count(F.lit(1)).over(alike)}
        )
        .filter(F.col("_rn") == F.col("_inner"))
        .groupBy(*classes)
        .agg(
            *[F.max(F.when(F.col("tag") == t, F.col("_key"))).alias(f"_cut_{t}") for t in tags],
            *[F.max(F.when(F.col("tag") == t, F.col("_rn") - F.col("_first") + 1)).alias(f"_take_{t}") for t in tags],
            F.max("_alike").alias("_alike"),
        )
    )
    cuts = join_on(ranks, found, classes, "left").withColumns(
        {f"_cut_{t}": F.when(F.col(t) <= 0, F.lit("")).otherwise(F.col(f"_cut_{t}")) for t in tags}
    )
    cuts = cut_lineage(cuts.drop(*tags))
    size = cuts.agg(F.count(F.lit(1)).alias("rows"), F.max("_alike").alias("alike")).first()
    return cuts.drop("_alike"), size["rows"], (size["alike"] or 0) > 1


def _same_ranks(buckets: Buckets, classes: Sequence[str], ranks: Mapping[str, int]) -> DataFrame:
    every = buckets.counts.select(*classes).distinct()
    return every.withColumns({tag: F.lit(rank).cast("bigint") for tag, rank in ranks.items()})


def _with_cuts(
    df: DataFrame, buckets: Buckets, classes: Sequence[str], id_col: str, seed: int, ranks: DataFrame
) -> DataFrame:
    """Rows of the classes in ``ranks`` with their order key and cut keys.

    Only if a cut falls among rows of equal keys, rows are numbered within
    their key, and keys and cuts get that number at their end.
    """
    cuts, rows, tied = cut_keys(df, buckets, classes, id_col, seed, ranks)
    tags = [c for c in ranks.columns if c not in classes]
    keyed = df.withColumn("_key", order_key(F.col(id_col), seed))
    if tied:
        number = F.row_number().over(Window.partitionBy(*classes, "_key").orderBy(F.xxhash64(*df.columns)))
        keyed = keyed.withColumn("_key", F.concat("_key", F.lit(":"), F.lpad(number.cast("string"), 19, "0")))
        # the empty cut, which nothing lies below, has no number to take and stays
        last = {t: F.lpad(F.coalesce(F.col(f"_take_{t}"), F.lit(0)).cast("string"), 19, "0") for t in tags}
        cuts = cuts.withColumns(
            {f"_cut_{t}": F.when(F.col(f"_cut_{t}") == "", "").otherwise(F.concat(f"_cut_{t}", F.lit(":"), last[t])) for t in tags}
        )
    return join_bounded(keyed, cuts.drop(*[f"_take_{t}" for t in tags]), list(classes), rows)


def _within(key: Column, cut: Column) -> Column:
    return F.coalesce(key <= cut, F.lit(True))


def _lowest(df: DataFrame, classes: Sequence[str], id_col: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows of every class that come first in its shuffled order, with their rank from 1.

    One scan: every task keeps its own first ``n`` rows a class before the
    shuffle (Spark's window group limit), groups of tasks merge theirs, and the
    groups' survivors meet in the end.
    """
    spark, limit = df.sparkSession, "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(spark.conf.get(limit)) < n:
        spark.conf.set(limit, n)
    # equal keys follow a hash of the whole row, so counts stay exact
    order = [order_key(F.col(id_col), seed), F.xxhash64(*df.columns)]
    keyed = df.withColumns({"_key": order[0], "_tie": order[1], "_task": F.spark_partition_id() % MERGE_GROUPS})
    first = Window.partitionBy(*classes, "_task").orderBy("_key", "_tie")
    last = Window.partitionBy(*classes).orderBy("_key", "_tie")
    merged = keyed.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= n)
    return merged.withColumn("_rank", F.row_number().over(last)).filter(F.col("_rank") <= n).drop("_key", "_tie", "_task")


def sample_per_class(df: DataFrame, classes: Sequence[str], id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``min(n, available)`` rows of every class, without replacement.

    Beyond ``LOWEST_ROWS`` rows a class, a cut key per class is searched instead.
    """
    if n <= LOWEST_ROWS:
        return _lowest(df, classes, id_col, n, seed).drop("_rank")
    buckets = bucket_counts(df, classes, id_col, seed)
    keyed = _with_cuts(df, buckets, classes, id_col, seed, _same_ranks(buckets, classes, {"n": n}))
    return keyed.filter(_within(F.col("_key"), F.col("_cut_n"))).select(*df.columns)


def train_val_per_class(
    df: DataFrame, classes: Sequence[str], id_col: str, train: int = 3000, val: int = 500, seed: int = 42
) -> DataFrame:
    """Disjoint training and validation slices per class.

    The validation slice starts after ``train`` rows also when the class is
    short, so it may be empty. Unused rows are dropped, as the slices ask for.
    """
    if train + val <= LOWEST_ROWS:
        lowest = _lowest(df, classes, id_col, train + val, seed)
        return lowest.withColumn("subset", F.when(F.col("_rank") <= train, "train").otherwise("val")).drop("_rank")
    buckets = bucket_counts(df, classes, id_col, seed)
    ranks = _same_ranks(buckets, classes, {"train": train, "val": train + val})
    keyed = _with_cuts(df, buckets, classes, id_col, seed, ranks)
    subset = F.when(_within(F.col("_key"), F.col("_cut_train")), "train").when(
        _within(F.col("_key"), F.col("_cut_val")), "val"
    )
    return keyed.withColumn("subset", subset).filter(F.col("subset").isNotNull()).select(*df.columns, "subset")


def sample_by_quota(
    df: DataFrame, classes: Sequence[str], id_col: str, quotas: DataFrame, seed: int = 42, buckets: Buckets | None = None
) -> DataFrame:
    """Per-class quotas from a table (classes..., quota); classes not in it give no rows.

    ``buckets`` are the bucket counts of the same rows, ids and seed, if they are at hand.
    """
    buckets = buckets or bucket_counts(df, classes, id_col, seed)
    ranks = quotas.select(*classes, F.col("quota").cast("bigint").alias("quota"))
    keyed = _with_cuts(df, buckets, classes, id_col, seed, ranks)
    return keyed.filter(_within(F.col("_key"), F.col("_cut_quota"))).select(*df.columns)


def sample_uniform(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``min(n, rows)`` rows of the whole table."""
    whole = df.withColumn("_all", F.lit(0))
    return sample_per_class(whole, ["_all"], id_col, n, seed).drop("_all")


def stratified_quotas(sizes: DataFrame, label: str, val_ratio: float = 0.2) -> DataFrame:
    """Validation rows per class from (label, available): exact total, largest
    remainders first.

    The total is ``n - ceil((1 - val_ratio) * n)``; ties between remainders go
    to the smaller label. Works on one row per class.
    """
    every = Window.partitionBy(F.lit(0))
    sized = sizes.withColumn("_n", F.sum("available").over(every)).withColumn(
        "_total", F.col("_n") - F.ceil(F.lit(1.0 - val_ratio) * F.col("_n"))
    )
    # share * _n = available * _total; integers keep the remainders exact
    sized = sized.withColumns(
        {
            "_base": F.expr("div(cast(available as decimal(19, 0)) * _total, _n)"),
            "_left": F.expr("(cast(available as decimal(19, 0)) * _total) % _n"),
        }
    )
    spare = F.col("_total") - F.sum("_base").over(every)
    place = F.row_number().over(every.orderBy(F.desc("_left"), F.asc(label)))
    return sized.withColumn(
        "quota", F.col("_base") + F.when(place <= spare, 1).otherwise(0)
    ).select(label, "available", "quota")


def stratified_split(
    df: DataFrame, label: str, id_col: str, val_ratio: float = 0.2, seed: int = 42, name: str = "split"
) -> DataFrame:
    """Every row marked ``val`` or ``test``, with exact class quotas."""
    buckets = bucket_counts(df, [label], id_col, seed)
    quotas = stratified_quotas(class_sizes(buckets, [label]), label, val_ratio)
    ranks = quotas.select(label, F.col("quota").cast("bigint").alias("val"))
    keyed = _with_cuts(df, buckets, [label], id_col, seed, ranks)
    split = F.when(_within(F.col("_key"), F.col("_cut_val")), "val").otherwise("test")
    return keyed.withColumn(name, split).select(*df.columns, name)


def hash_positions(
    df: DataFrame, buckets: Buckets, classes: Sequence[str], id_col: str, seed: int, name: str
) -> DataFrame:
    """0-based rank of every row in the shuffled order of its class.

    Hash buckets are even by construction and stable under recomputation, so
    the two-level rank needs no range partitioning.
    """
    classes = list(classes)
    keyed = _keyed(df, id_col, seed, buckets.digits)
    before = Window.partitionBy(*classes).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.counts.select(*classes, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_bucket", *classes).orderBy("_key")
    ranked = join_bounded(
        keyed.withColumn("_rn", F.row_number().over(inside)), offsets, [*classes, "_bucket"], buckets.rows
    )
    return ranked.withColumn(name, F.col("_off") + F.col("_rn") - 1).select(*df.columns, name)


def shuffled(df: DataFrame, id_col: str, seed: int = 42, name: str = "position") -> DataFrame:
    """A full shuffle as a column; sort by it only where a sink needs the order."""
    whole = df.withColumn("_all", F.lit(0))
    buckets = bucket_counts(whole, ["_all"], id_col, seed)
    return hash_positions(whole, buckets, ["_all"], id_col, seed, name).drop("_all")


def oversample(df: DataFrame, label: str, id_col: str, seed: int = 42, draws_per_key: int = 100_000) -> DataFrame:
    """Every class drawn with replacement up to the largest class.

    Draw ``k`` of a class takes the row at ``md5(class:k:seed) mod n_class``. A
    small class would send all its draws to few join keys, so its rows are
    copied over salts until no key gets more than about ``draws_per_key``.
    """
    buckets = bucket_counts(df, [label], id_col, seed)
    every = Window.partitionBy(F.lit(0))
    sizes = class_sizes(buckets, [label]).withColumnRenamed("available", "_n").withColumn("_max", F.max("_n").over(every)).withColumn(
        "_salts", F.ceil(F.col("_max") / (F.col("_n") * F.lit(float(draws_per_key)))).cast("bigint")
    )
    indexed = hash_positions(df, buckets, [label], id_col, seed, "_index")
    sources = join_bounded(indexed, sizes.select(label, "_salts"), [label], buckets.classes).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1))
    )
    # one chunk row per 10,000 draws, so no row expands without bound; the task
    # count is explicit because chunk rows are too small to be kept apart by size
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = 10_000
    chunks = sizes.withColumn("_super", F.explode(F.expr(f"sequence(0L, div(_max - 1, {chunk * 1000}L))"))).withColumn(
        "_part", F.explode(F.expr(f"sequence(_super * 1000L, least(_super * 1000L + 999L, div(_max - 1, {chunk}L)))"))
    )
    draws = (
        chunks.repartition(tasks, label, "_part")
        .withColumn("draw", F.explode(F.expr(f"sequence(_part * {chunk}L, least(_part * {chunk}L + {chunk - 1}L, _max - 1))")))
        .withColumn(
            "_hash",
            F.conv(
                F.substring(F.md5(F.concat(F.coalesce(F.col(label).cast("string"), F.lit("")), F.lit(":"), F.col("draw").cast("string"), F.lit(f":{seed}"))), 1, 15),
                16,
                10,
            ).cast("bigint"),
        )
        .select(label, "draw", (F.col("_hash") % F.col("_n")).alias("_index"), (F.col("draw") % F.col("_salts")).alias("_salt"))
    )
    # the draws come from a few chunk rows, by whose size Spark would take all of them for a broadcast; a sort goes by
    # the leading bytes of its first key, so that is the index
    return join_on(draws.hint("merge"), sources, ["_index", "_salt", label]).select(*df.columns, "draw")


def quota_check(
    df: DataFrame, classes: Sequence[str], delivered: DataFrame, requested: DataFrame, sizes: DataFrame | None = None
) -> DataFrame:
    """Requested, available and delivered rows per class, with the shortfall flag.

    ``sizes`` (classes..., available) saves a scan of ``df`` where they are known.
    """
    available = df.groupBy(*classes).agg(F.count(F.lit(1)).alias("available")) if sizes is None else sizes
    got = delivered.groupBy(*classes).agg(F.count(F.lit(1)).alias("delivered"))
    return (
        join_on(join_on(requested, available, list(classes), "left"), got, list(classes), "left")
        .fillna(0, ["available", "delivered"])
        .withColumn("short", F.col("available") < F.col("requested"))
        .select(*classes, "requested", "available", "delivered", "short")
    )


def class_mapping(df: DataFrame, name: str) -> DataFrame:
    """Class names in alphabetical order and their 0-based index."""
    positions = row_positions(df.select(name).distinct().filter(F.col(name).isNotNull()), [name])
    return positions.select(name, (F.col("position") - 1).cast("int").alias("class_index"))


def collision_free_names(df: DataFrame, path: str, folders: Sequence[str] = ()) -> DataFrame:
    """Target file names for an export that flattens directories.

    The first file of a name (by path) keeps it; copies take the smallest free
    ``stem_k``. First files are placed before copies, so a copy only has to
    avoid numbers that some first file already owns. The i-th copy therefore
    gets i plus the number of owned numbers k_j with k_j - j < i, which is a
    running count over copies and owned numbers together.
    """
    folders = list(folders)
    base = F.element_at(F.split(F.col(path), "/"), -1)
    named = df.withColumn("_name", base).withColumns(
        {
            "_stem": F.when(F.col("_name").rlike(r"^.+\.[^.]+$"), F.regexp_replace("_name", r"\.[^.]+$", "")).otherwise(
                F.col("_name")
            ),
        }
    )
    named = named.withColumn("_ext", F.expr("substring(_name, length(_stem) + 1)"))
    ranked = row_positions(named, [path], [*folders, "_name"], "_copy")
    firsts = named.select(*folders, "_name", "_stem", "_ext").distinct()
    owned_number = F.regexp_extract("_stem", r"^.+_([1-9][0-9]{0,17})$", 1)
    owned = (
        firsts.withColumn("_k", F.nullif(owned_number, F.lit("")).cast("bigint"))
        .filter(F.col("_k").isNotNull())
        .withColumn("_parent", F.concat(F.regexp_replace("_stem", r"_[0-9]+$", ""), F.col("_ext")))
    )
    owned = row_positions(owned.select(*folders, F.col("_parent").alias("_name"), "_k"), ["_k"], [*folders, "_name"], "_j")
    copies = ranked.filter(F.col("_copy") > 1).withColumn("_i", F.col("_copy") - 1)
    steps = copies.select(
        *folders, "_name", F.col("_i").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_owned"), path
    ).unionByName(
        owned.select(
            *folders,
            "_name",
            (F.col("_k") - F.col("_j") + 1).alias("_at"),
            F.lit(0).alias("_kind"),
            F.lit(1).cast("bigint").alias("_owned"),
            F.lit(None).cast("string").alias(path),
        )
    )
    skipped = running_totals(steps, [*folders, "_name"], ["_at", "_kind", path], ["_owned"]).filter(F.col("_kind") == 1)
    shifts = skipped.select(*folders, "_name", F.col(path), (F.col("_at") + F.col("cum__owned")).alias("_number"))
    keys = [*folders, "_name", path]
    return (
        join_on(ranked, shifts, keys, "left")
        .withColumn(
            "target_name",
            F.when(F.col("_copy") == 1, F.col("_name")).otherwise(
                F.concat("_stem", F.lit("_"), F.col("_number").cast("string"), "_ext")
            ),
        )
        .select(*df.columns, "target_name")
    )
