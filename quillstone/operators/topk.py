"""The first row, or the first k, of each key, combined before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def first_rows(df: DataFrame, keys: list[Column], order: list[str | Column]) -> DataFrame:
    """One row for each key: the least in ``order`` (nulls first). An aggregate with partial results, so that a task sends one
    row of a key, however many copies it has. Null keys are a key; of equal rows any stays."""
    best = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_best")
    return df.groupBy(*(k.alias(f"_key{i}") for i, k in enumerate(keys))).agg(best).select("_best.*")


def smallest(df: DataFrame, keys: list[str], order: list[str | Column], k: int, place: str = "place", buckets: int = BUCKETS) -> DataFrame:
    """The first k rows of each key with their ``place`` from 1. The k of each of a key's hash buckets go on to the last
    comparison, so that no task sorts a hot key."""
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    near = spread.withColumn(place, F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))).where(F.col(place) <= k).drop("_bucket", place)
    return near.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= k)
