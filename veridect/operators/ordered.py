"""Order-dependent aggregates that stay distributed.

A window without a selective partition key runs in one task. The functions
here replace it by two levels: even slabs of the sort order, whose totals are
few, and a window inside each slab.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridect.session import cut_lineage


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that matches NULL keys too, so that no group is lost."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


BROADCAST_ROWS = 100_000


def join_bounded(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: int, how: str = "inner") -> DataFrame:
    """:func:`join_on` for a right side of ``rows`` rows, known and not estimated.

    Few rows are broadcast, which keeps a large left side with few distinct
    keys from being shuffled onto them. Beyond the bound it is an ordinary
    join, whose hot keys AQE splits.
    """
    return join_on(left, F.broadcast(right) if rows <= BROADCAST_ROWS else right, keys, how)


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """The columns of a one-row result next to every row, as a scalar subquery."""
    names = one_row.columns
    attached = df.withColumn("_one_row", one_row.select(F.struct(*names)).scalar())
    return attached.select(*df.columns, *[F.col(f"_one_row.{n}").alias(n) for n in names])


#: Rows of a group that one task sorts.
GROUP_ROWS = 100_000


def totals_of_counts(df: DataFrame, groups: Sequence[str], order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """:func:`running_totals` of counts of distinct values, which are stored first.

    Where no group has more than ``GROUP_ROWS`` of them, a window per group does
    without range partitions.
    """
    groups, stored = list(groups), cut_lineage(df)
    largest = stored.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) > GROUP_ROWS:
        return running_totals(stored, groups, order, sums)
    whole = Window.partitionBy(*groups)
    upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return stored.withColumns({f"cum_{s}": F.sum(s).over(upto) for s in sums} | {f"tot_{s}": F.sum(s).over(whole) for s in sums})


def running_totals(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], sums: Sequence[str]
) -> DataFrame:
    """Inclusive running sums ``cum_<s>`` and group totals ``tot_<s>``.

    ``df`` should hold one row per (groups, order); equal rows are allowed but
    share no order. Range partitioning makes the slabs even for any value
    distribution, also when one group holds most rows. The partition number is
    stored with the rows and the result is checkpointed before it is used
    twice, so both uses see the same slabs.
    """
    groups, order, sums = list(groups), list(order), list(sums)
    slabbed = cut_lineage(df.repartitionByRange(*groups, *order).withColumn("_slab", F.spark_partition_id()))

    slab_sums = slabbed.groupBy(*groups, "_slab").agg(*[F.sum(s).alias(f"_part_{s}") for s in sums])
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    # one leading row per slab carries what precedes it, so no join is needed
    leading = slab_sums.select(
        *groups,
        "_slab",
        F.lit(0).alias("_kind"),
        *[F.coalesce(F.sum(f"_part_{s}").over(before), F.lit(0)).alias(f"_in_{s}") for s in sums],
        *[F.sum(f"_part_{s}").over(whole).alias(f"tot_{s}") for s in sums],
    )
    rows = slabbed.withColumn("_kind", F.lit(1)).withColumns({f"_in_{s}": F.col(s) for s in sums})
    upto = Window.partitionBy(*groups, "_slab").orderBy("_kind", *order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.unionByName(leading, allowMissingColumns=True)
        .withColumns(
            {f"cum_{s}": F.sum(f"_in_{s}").over(upto) for s in sums}
            | {f"tot_{s}": F.max(f"tot_{s}").over(upto) for s in sums}
        )
        .filter(F.col("_kind") == 1)
        .select(*df.columns, *[f"cum_{s}" for s in sums], *[f"tot_{s}" for s in sums])
    )


def row_positions(df: DataFrame, order: Sequence[str], groups: Sequence[str] = (), name: str = "position") -> DataFrame:
    """1-based position of every row in its group; ``order`` must be unique there."""
    counted = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), groups, order, ["_one"])
    return counted.withColumnRenamed("cum__one", name).drop("_one", "tot__one")


def value_counts(df: DataFrame, groups: Sequence[str], value: str, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per distinct value and group; ties collapse before any sort."""
    aggregates = [F.count(F.lit(1)).alias("n")] + [c.alias(k) for k, c in (extra or {}).items()]
    return df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(*aggregates)


#: Values of one cell that a window sorts; cells with more are split into as many buckets.
CELL_VALUES, CELL_BUCKETS = 100_000, 4_096


def _positions(quantiles: Mapping[str, float]) -> list[Column]:
    """0-based ranks of the rows on either side of each quantile."""
    exact = [(F.col("_total") - 1).cast("double") * F.lit(q) for q in quantiles.values()]
    return [side for x in exact for side in (F.floor(x), F.ceil(x))]


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def percentiles_of_counts(
    counts: DataFrame, groups: Sequence[str], value: str, quantiles: Mapping[str, float], carried: Mapping[str, Column] | None = None
) -> DataFrame:
    """Linear-interpolation percentiles per group from (groups..., value, n), a row per distinct finite value.

    Only cells that hold a wanted rank are sorted. A group starts as one cell;
    while a cell has too many distinct values, the values of all cells are
    counted in buckets between the cell's ends, and the buckets with a wanted
    rank are the next cells. ``counts`` is read once a round and should be
    stored. ``carried`` are aggregates of a group's counts to return with them.
    """
    groups, v = list(groups), F.col(value)
    cells = counts.groupBy(*groups).agg(
        F.min(v).alias("_low"),
        F.max(v).alias("_high"),
        F.lit(0).cast("bigint").alias("_before"),
        F.sum("n").alias("_total"),
        F.count(F.lit(1)).alias("_values"),
        F.lit(0).alias("_cell"),
        *[c.alias(k) for k, c in (carried or {}).items()],
    )
    kept = ["_total", *(carried or {})]
    while True:
        cells = cut_lineage(cells)
        size = cells.agg(F.count(F.lit(1)).alias("cells"), F.max("_values").alias("largest")).first()
        placed = join_bounded(counts.select(*groups, value, "n"), cells, groups, size["cells"]).filter(v.between(F.col("_low"), F.col("_high")))
        if (size["largest"] or 0) <= CELL_VALUES:
            break
        share = (v - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
        bucket = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * F.lit(float(CELL_BUCKETS))), F.lit(CELL_BUCKETS - 1))
        buckets = placed.groupBy(*groups, "_cell", bucket.alias("_bucket")).agg(
            F.min(v).alias("_low"),
            F.max(v).alias("_high"),
            F.min("_before").alias("_start"),
            F.sum("n").alias("_n"),
            F.count(F.lit(1)).alias("_values"),
            *[F.first(c).alias(c) for c in kept],
        )
        upto = F.col("_start") + F.sum("_n").over(Window.partitionBy(*groups, "_cell").orderBy("_bucket"))
        counted = buckets.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
        wanted = _any([(F.col("_before") <= r) & (r < F.col("_upto")) for r in _positions(quantiles)])
        number = F.row_number().over(Window.partitionBy(*groups).orderBy("_low"))
        cells = counted.filter(wanted).select(*groups, "_low", "_high", "_before", "_values", number.alias("_cell"), *kept)
    last = F.col("_before") + F.sum("n").over(Window.partitionBy(*groups, "_cell").orderBy(value))
    ranked = placed.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("n"))
    sides = [F.max(F.when((F.col("_first") <= r) & (r < F.col("_last")), v)) for r in _positions(quantiles)]
    found = ranked.groupBy(*groups).agg(
        *[s.alias(f"_side{i}") for i, s in enumerate(sides)], *[F.first(c).alias(c) for c in kept]
    )
    columns = []
    for i, (name, q) in enumerate(quantiles.items()):
        exact, low, high = (F.col("_total") - 1).cast("double") * F.lit(q), F.col(f"_side{2 * i}"), F.col(f"_side{2 * i + 1}")
        columns.append((low + (high - low) * (exact - F.floor(exact).cast("double"))).alias(name))
    return found.select(*groups, *columns, *(carried or {}))


def percentiles(df: DataFrame, groups: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """Exact percentiles per group in one scan, without sorting the rows."""
    return percentiles_of_counts(cut_lineage(value_counts(df, groups, value)), groups, value, quantiles)
