"""Exact ranks, quantiles and running sums over ranges of values, so that no task sorts a whole column.

All start from counts per distinct value. Splitters are a sample of the distinct values: of each of a fixed number of
hash buckets the value with the least hash, which is the same whenever it is computed. Values are dealt into the
ranges between splitters, the ranges' totals are summed up in order (a short list per group), and only inside a
range are values sorted. Quantiles sort the ranges that hold a wanted rank and no others.

Null values are left out; groups may be null; NaN counts as the largest value; an empty table gives no groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges are SIDE times SIDE: a value's range is found by two short comparisons.
SIDE = 16


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on ``keys``, where null equals null."""
    if not keys:
        return left.crossJoin(right)  # one row
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(named, on, how).drop(*(f"_{k}" for k in keys))


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, c): how often each value occurs."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))


def ranged(values: DataFrame, keys: list[str], value: str, side: int = SIDE) -> DataFrame:
    """``values`` (distinct per group) with ``range``: how many of the group's splitters lie below."""
    h, others = F.xxhash64(value), [c for c in values.columns if c not in (*keys, value)]
    # With all columns, so that this is the same exchange as the one below and runs once.
    sample = values.groupBy(*keys, F.pmod(h, F.lit(side * side)).alias("_h")).agg(F.min_by(F.struct(F.col(value).alias("v"), *others), F.xxhash64(h)).alias("_v"))
    cuts = sample.groupBy(*keys).agg(F.array_sort(F.collect_list("_v.v")).alias("_cuts"))
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda _, i: i % side == side - 1))

    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda c: c < F.col(value)))

    rows = joined(values, cuts, keys).withColumn("_at", below(F.col("_coarse")) * side)
    return rows.withColumn("range", F.col("_at") + below(F.slice("_cuts", F.col("_at") + 1, F.lit(side)))).drop("_cuts", "_coarse", "_at")


def _range_starts(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """(keys, range, n_<sum> of the range, start_<sum> before it, total_<sum>) from a list of up to SIDE * SIDE + 1 ranges per group."""
    own = rows.groupBy(*keys, "range").agg(*(F.sum(s).alias(s) for s in sums))
    lists = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("range", *sums))).alias("_r"))

    def total(s: str, upto: Column) -> Column:
        zero = F.lit(0).cast(rows.schema[s].dataType if rows.schema[s].dataType.simpleString() == "double" else "bigint")
        return F.aggregate(F.filter("_r", lambda r: r["range"] < upto), zero, lambda a, r: a + r[s])

    each = lists.select(*keys, "_r", F.explode("_r").alias("r"))
    every = F.lit(1 << 30)
    return each.select(*keys, "r.range", *(c for s in sums for c in (F.col(f"r.{s}").alias(f"n_{s}"), total(s, F.col("r.range")).alias(f"start_{s}"), total(s, every).alias(f"total_{s}"))))


def running_sums(values: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """``values`` (distinct per group) with ``<sum>_below``, over all smaller values, and ``<sum>_total`` of each sum."""
    rows = ranged(values, keys, value)
    rows = joined(rows, _range_starts(rows, keys, sums), [*keys, "range"])
    before = Window.partitionBy(*keys, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"{s}_below": F.coalesce(F.sum(s).over(before), F.lit(0)) + F.col(f"start_{s}") for s in sums})
    return out.select(*values.columns, *(F.col(f"{s}_below") for s in sums), *(F.col(f"total_{s}").alias(f"{s}_total") for s in sums))


def quantiles(values: DataFrame, keys: list[str], value: str, of: dict[str, float]) -> DataFrame:
    """A row per group: the linear quantiles ``of`` {name: share}, from ``counted`` values."""
    rows = ranged(values, keys, value)
    starts = _range_starts(rows, keys, ["c"])
    ranks = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), (F.lit(q) * (F.col("total_c") - 1)).alias("at")) for k, q in of.items()))).alias("w")
    low, at = F.floor("at").cast("long"), F.explode(F.array(F.lit(0), F.lit(1))).alias("up")
    wanted = starts.select("*", ranks).select(*keys, "range", "start_c", "n_c", "total_c", "w.*").withColumn("low", low).select("*", at)
    wanted = wanted.withColumn("rank", F.least(F.col("low") + F.col("up"), F.col("total_c") - 1))
    wanted = wanted.where((F.col("rank") >= F.col("start_c")) & (F.col("rank") < F.col("start_c") + F.col("n_c")))
    held = joined(rows, wanted.select(*keys, "range").distinct(), [*keys, "range"], "left_semi") if keys else rows.join(wanted.select("range").distinct(), "range", "left_semi")
    before = Window.partitionBy(*keys, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    met = joined(held, wanted, [*keys, "range"]).where((F.col("rank") >= F.col("start_c") + F.col("before")) & (F.col("rank") < F.col("start_c") + F.col("before") + F.col("c")))
    v = F.col(value).cast("double")
    found = met.groupBy(*keys, "name").agg(F.max(F.when(F.col("up") == 0, v)).alias("a"), F.max(F.when(F.col("up") == 1, v)).alias("b"), F.max(F.col("at") - F.col("low")).alias("share"))
    linear = F.when(F.col("share") == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("share"))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == k, linear)).alias(k) for k in of))


def quantiles_of(df: DataFrame, column: Column | str, of: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """``quantiles`` of one column's rows."""
    c = F.col(column) if isinstance(column, str) else column
    rows = df.select(*(by or []), c.cast("double").alias("x"))
    return quantiles(counted(rows, by or [], "x"), by or [], "x", of)
