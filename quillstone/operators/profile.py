"""Profiles: numeric summaries, missing values, distributions, calendar counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.lexicons import GROUP_SIZE_EDGES
from quillstone.functions.text import is_removed, strip, word_count
from quillstone.operators.clean import valid_time
from quillstone.operators.ranks import counted, joined, quantiles, quantiles_of
from quillstone.operators.splits import sample_n

QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p995": 0.995}


def numeric_summary(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """One row per column (and group): moments, linear quantiles, counts of signs.

    All from one count per distinct value of each column and group; ranks are found in ranges of values.
    """
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("c")).select(*by, "c.*")
    keys = [*by, "column"]
    x, n = F.col("x"), F.count("x")
    fit = F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2)
    out = long.groupBy(*keys).agg(
        n.alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.when(n > 2, fit).alias("skewness"), F.count_if(x < 0).alias("n_negative"), F.count_if(x == 0).alias("n_zero"),
    )
    return joined(out, quantiles(counted(long, keys, "x"), keys, "x", QUANTILES), keys, "left")


def lengths(df: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """Characters and words of title, body and both."""
    t, b = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    words = {"title_words": word_count(t), "body_words": word_count(b)}
    return df.select(F.length(t).alias("title_chars"), F.length(b).alias("body_chars"), *(c.alias(k) for k, c in words.items()), (words["title_words"] + words["body_words"]).alias("pair_words"))


def engagement_ratio(df: DataFrame) -> DataFrame:
    """Summary of comments / (upvotes + 1) over all rows and per label (column part)."""
    part = F.explode(F.array_compact(F.array(F.lit("all"), F.col("label").cast("string")))).alias("part")
    rows = df.select((F.col("num_comments") / (F.col("upvotes") + 1)).alias("ratio"), "label").select("ratio", part)
    return numeric_summary(rows, ["ratio"], ("part",))


def emptiness(df: DataFrame) -> DataFrame:
    """Removed bodies and empty titles: numbers and per cents."""
    counts = {"body_removed": F.count_if(is_removed(F.col("body"))), "title_empty": F.count_if(strip(F.coalesce("title", F.lit(""))) == "")}
    return df.agg(F.count("*").alias("n_rows"), *(c.alias(k) for k, c in counts.items()), *(F.try_divide(c * 100.0, F.count("*")).alias(f"{k}_pct") for k, c in counts.items()))


def scatter_sample(df: DataFrame, n: int = 50_000) -> DataFrame:
    """A sample of n rows for a plot on logarithmic axes: upvotes and comments are 1 at least."""
    one = {c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(1)) for c in ("upvotes", "num_comments")}
    return sample_n(df, n).select("id", "label", *(c.alias(k) for k, c in one.items()))


def missing(df: DataFrame) -> DataFrame:
    counts = df.agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in df.columns))).alias("m")
    return counts.select("n_rows", rows).select("m.*", F.try_divide(F.col("m.n_missing") * 100.0, "n_rows").alias("pct"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), F.col(column).asc_nulls_first()).limit(top) if top else out


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Per label n and per cent, with the number of labels and whether they are 0 and 1 alone."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    facts = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("n_unique"), F.bool_and(F.col(label).cast("string").isin("0", "1")).alias("is_binary"))
    return counts.crossJoin(F.broadcast(facts)).select(label, "n", (F.col("n") * 100.0 / F.col("_all")).alias("pct"), "n_unique", "is_binary")  # one row of facts


def category_summary(df: DataFrame, column: str, rare: int = 50) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    low = F.col("n") < rare
    rows = F.coalesce(F.sum(F.when(low, F.col("n"))), F.lit(0))
    return counts.agg(F.count("*").alias("n_unique"), F.count_if(low).alias("n_rare"), rows.alias("rare_rows"), F.sum("n").alias("n_rows"), F.try_divide(rows * 100.0, F.sum("n")).alias("rare_pct"))


def top_categories(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """The most frequent values (null is one) with their per cent of all rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_all"))
    return counts.orderBy(F.desc("n"), F.col(column).asc_nulls_first()).limit(top).crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") * 100.0 / F.col("_all")).alias("pct"))


def right_closed_bin(x: Column, edges: tuple[float, ...]) -> Column:
    """Number of the bin (edges[i], edges[i + 1]] from 0; null outside."""
    out = F.when((x <= edges[0]) | (x > edges[-1]), None)
    for i, e in enumerate(edges[1:]):
        out = out.when(x <= e, i)
    return out


def group_size_histogram(df: DataFrame, column: str, edges: tuple[int, ...] = GROUP_SIZE_EDGES) -> DataFrame:
    """How many groups have a size in each right-closed bin; empty bins count 0."""
    sizes = df.groupBy(column).agg(F.count("*").alias("n")).select(right_closed_bin(F.col("n"), edges).alias("bin")).groupBy("bin").agg(F.count("*").alias("n_groups"))
    bins = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(sizes, "bin", "left").select("bin", F.coalesce("n_groups", F.lit(0)).alias("n_groups"))


def histogram(df: DataFrame, column: str, bins: int = 60, clip: float = 0.99, by: tuple[str, ...] = (), log: bool = False) -> DataFrame:
    """Equal bins from the least value to the clip quantile; with ``by``, the density in each group too."""
    x = F.col(column).cast("double")
    x = F.log10(F.greatest(x, F.lit(1.0))) if log else x
    rows = df.where(x.isNotNull()).select(*by, x.alias("x"))
    limits = quantiles_of(rows, "x", {"lo": 0.0, "hi": clip})  # one row
    binned = rows.crossJoin(F.broadcast(limits)).where("x <= hi")
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    counts = binned.groupBy(*by, at.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    if by:
        total = F.sum("n").over(Window.partitionBy(*by))
        counts = counts.withColumn("density", F.try_divide(F.col("n"), total * (F.col("hi") - F.col("lo")) / bins))
    return counts


def box_by_group(df: DataFrame, column: str, by: str, clip: float = 0.99) -> DataFrame:
    """Quartiles, and the furthest values within 1.5 interquartile ranges."""
    x = F.col(column).cast("double")
    rows = df.select(by, x.alias("x")).crossJoin(F.broadcast(quantiles_of(df, x, {"hi": clip}))).where("x <= hi").drop("hi")
    q = quantiles_of(rows, "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, [by])
    spread = (F.col("q3") - F.col("q1")) * 1.5
    inside = joined(rows, q, [by]).where(F.col("x").between(F.col("q1") - spread, F.col("q3") + spread))
    return inside.groupBy(by, "q1", "median", "q3").agg(F.min("x").alias("low_whisker"), F.max("x").alias("high_whisker"))


def time_validity(df: DataFrame, ts: str = "created_utc") -> DataFrame:
    good = F.when(valid_time(F.col(ts)), F.col(ts))
    iso = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss")
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(ts).isNull()).alias("n_null"), F.count_if(~valid_time(F.col(ts))).alias("n_invalid"), iso(F.min(good)).alias("first"), iso(F.max(good)).alias("last"))


def calendar_counts(df: DataFrame, ts: str = "created_utc") -> DataFrame:
    """(unit, value, n) for years, months, hours and weekdays (Monday 0), in one pass."""
    at = F.timestamp_seconds(ts)
    units = {"year": F.year(at).cast("string"), "month": F.date_format(at, "yyyy-MM"), "hour": F.hour(at).cast("string"), "weekday": F.weekday(at).cast("string")}
    rows = df.where(valid_time(F.col(ts))).select(F.explode(F.array(*(F.struct(F.lit(k).alias("unit"), v.alias("value")) for k, v in units.items()))).alias("u"))
    return rows.select("u.*").groupBy("unit", "value").agg(F.count("*").alias("n"))


def label_rate_by_year(df: DataFrame, least: int = 100, ts: str = "created_utc") -> DataFrame:
    """Years with enough labelled rows, and the range of their rates."""
    years = df.where(valid_time(F.col(ts)) & F.col("label").isNotNull()).groupBy(F.year(F.timestamp_seconds(ts)).alias("year")).agg(F.count("*").alias("n"), F.avg("label").alias("rate")).where(F.col("n") >= least)
    rates = years.agg((F.max("rate") - F.min("rate")).alias("drift"))
    return years.crossJoin(F.broadcast(rates))  # one row
