"""Exact ordered aggregates without a one-task window.

Rows are first collapsed to distinct values with counts and dealt out by value
ranges. Running sums are taken within each range; the ranges' totals, a row a
(key, range), are summed up and added. The ranges come from a sample and are
fixed by writing the dealt rows, so every later step sees the same ones; they
change which task does what and no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.store import cut_lineage


def ordered_sums(groups: DataFrame, keys: list[str], order: str, values: list[str], parts: int | None = None) -> DataFrame:
    """``groups`` with, for each of ``values``, ``before_<v>``, its sum over
    the rows of the key whose ``order`` is less, and ``total_<v>``, its sum
    over the key. ``order`` must be distinct within a key. ``parts`` fixes the
    number of ranges; by default it adapts to the size."""
    ranged = groups.repartitionByRange(parts, *keys, order) if parts else groups.repartitionByRange(*keys, order)
    cut = cut_lineage(ranged.withColumn("_cut", F.spark_partition_id()), "ordered")
    within = Window.partitionBy(*keys, "_cut").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_in_{v}") for v in values])
    sums = cut.groupBy(*keys, "_cut").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    over = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = sums.select(*keys, "_cut", *[c for v in values for c in (F.coalesce(F.sum(f"_t_{v}").over(over), F.lit(0)).alias(f"_off_{v}"), F.sum(f"_t_{v}").over(whole).alias(f"total_{v}"))])
    joined = inner.join(offsets, [*keys, "_cut"])
    return joined.select(*groups.columns, *[c for v in values for c in ((F.col(f"_in_{v}") + F.col(f"_off_{v}")).alias(f"before_{v}"), F.col(f"total_{v}"))])


def quantiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float], parts: int | None = None) -> DataFrame:
    """For each key the linearly interpolated quantiles of ``value``: a column
    for each name of ``at``. Null values are left out. The result is a written
    table, so that joins with it are planned by its true size."""
    groups = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = ordered_sums(groups, keys, value, ["_n"], parts)

    def held(place: Column) -> Column:
        return F.max(F.when((F.col("before__n") <= place) & (place < F.col("before__n") + F.col("_n")), F.col(value)))

    parts_of = []
    for name, q in at.items():
        h = (F.col("total__n") - 1) * F.lit(float(q))
        parts_of += [held(F.floor(h)).alias(f"_lo_{name}"), held(F.ceil(h)).alias(f"_hi_{name}"), F.max(h - F.floor(h)).alias(f"_f_{name}")]
    found = ranked.groupBy(*keys).agg(*parts_of)
    return cut_lineage(found.select(*keys, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in at]), "quantiles")


def rank_percentile(rows: DataFrame, keys: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with the average-tie rank of ``value`` over the number of rows
    of the key; a single row has 0.5."""
    groups = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = ordered_sums(groups, keys, value, ["_n"], parts)
    share = F.when(F.col("total__n") == 1, 0.5).otherwise((F.col("before__n") + (F.col("_n") + 1) / 2) / F.col("total__n"))
    return rows.join(ranked.select(*keys, value, share.alias(name)), [*keys, value]).select(*rows.columns, name)


def rank_percentiles(rows: DataFrame, unit: str, columns: dict[str, Column]) -> DataFrame:
    """unit and, for each name of ``columns``, the rank percentile of its
    value over all rows: all columns are ranked in one pass, unpivoted."""
    pairs = F.array(*[F.struct(F.lit(n).alias("_name"), c.cast("double").alias("_value")) for n, c in columns.items()])
    long = rows.select(unit, F.inline(pairs))
    ranked = rank_percentile(long, ["_name"], "_value", "_rank")
    return ranked.groupBy(unit).pivot("_name", list(columns)).agg(F.first("_rank"))
