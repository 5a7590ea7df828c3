"""How columns relate to the label: rates, concentration, correlations, mutual information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.features import length_bucket
from quillstone.functions.text import is_removed
from quillstone.operators.clean import valid_time
from quillstone.operators.ranks import counted, quantiles, quantiles_of, running_sums
from quillstone.sources.scratch import materialised


def label_rate_by(df: DataFrame, by: str, top: int | None = None) -> DataFrame:
    out = df.groupBy(by).agg(F.count("label").alias("n"), F.sum("label").alias("n_positive"), F.avg("label").alias("rate")).where("n > 0")
    return out.orderBy(F.desc("n"), by).limit(top) if top else out


def leaky_categories(df: DataFrame, by: str, least: int = 1000, high: float = 0.98, low: float = 0.02, top: int = 50) -> DataFrame:
    """Categories whose label rate gives the label away, the largest of them, and how many there are."""
    rates = label_rate_by(df, by).where((F.col("n") >= least) & ((F.col("rate") >= high) | (F.col("rate") <= low)))
    return rates.orderBy(F.desc("n"), by).limit(top).crossJoin(F.broadcast(rates.agg(F.count("*").alias("n_leaky"))))  # one row


def concentration(df: DataFrame, by: str, least: int = 50, shares: tuple[float, ...] = (0.5, 0.8, 0.95)) -> DataFrame:
    """The fewest groups that hold each share of the positives, from running sums over ranges of groups."""
    groups = label_rate_by(df, by).where(F.col("n") >= least)
    ordered = groups.select(F.struct((-F.col("n_positive")).alias("n"), F.col(by).alias("name")).alias("order"), "n_positive")
    run = running_sums(ordered, [], "order", ["n_positive"]).withColumn("share", (F.col("n_positive_below") + F.col("n_positive")) / F.col("n_positive_total"))
    return run.agg(*((F.count_if(F.col("share") < s) + 1).alias(f"groups_{round(s * 100)}") for s in shares))


def label_rate_on_grid(df: DataFrame, value: Column, size: int, name: str) -> DataFrame:
    """Rate for each of the values 0 to size - 1, 0 where there are no rows."""
    rates = df.where("label is not null").groupBy(value.alias(name)).agg(F.count("*").alias("n"), F.avg("label").alias("rate"))
    grid = df.sparkSession.range(size).select(F.col("id").cast("int").alias(name))
    return grid.join(rates, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rate", F.lit(0.0)).alias("rate"))


def means_by_label(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and median of each column per label; the medians of all columns by ranges of their values."""
    known = df.where("label is not null")
    means = known.groupBy("label").agg(*(F.avg(c).alias(f"{c}_mean") for c in columns))
    long = known.select("label", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))))
    keys = ["label", "column"]
    medians = quantiles(counted(long, keys, "x"), keys, "x", {"median": 0.5})
    wide = medians.groupBy("label").agg(*(F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"{c}_median") for c in columns))
    return means.join(wide, "label", "left")


def _long(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("x")) for c in columns)))
    return df.where("label is not null").select(pairs.alias("p"), F.col("label").cast("double").alias("y")).select("p.*", "y").where("x is not null")


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation with the label over rows where both are known; null without variance."""
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return _long(df, columns).groupBy("feature").agg(F.count("*").alias("n"), r.alias("pearson"))


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation with average ranks: ranks of distinct values from counts, then a weighted Pearson."""
    cells = _long(df, columns).groupBy("feature", "x", "y").agg(F.count("*").alias("c"))

    def ranked(value: str, name: str) -> DataFrame:
        sums = cells.groupBy("feature", value).agg(F.sum("c").alias("n"))
        return running_sums(sums, ["feature"], value, ["n"]).select("feature", value, (F.col("n_below") + (F.col("n") + 1) / 2).alias(name))

    ranks, label_ranks = ranked("x", "rx"), ranked("y", "ry")
    r = cells.join(ranks, ["feature", "x"]).join(label_ranks, ["feature", "y"])
    n = F.sum("c")
    mx, my = F.sum(F.col("c") * F.col("rx")) / n, F.sum(F.col("c") * F.col("ry")) / n
    cov = F.sum(F.col("c") * F.col("rx") * F.col("ry")) / n - mx * my
    vx, vy = F.sum(F.col("c") * F.col("rx") ** 2) / n - mx * mx, F.sum(F.col("c") * F.col("ry") ** 2) / n - my * my
    return r.groupBy("feature").agg(n.alias("n"), F.when((vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(vx * vy)).alias("spearman"))


def weekday_hour_grid(df: DataFrame, ts: str = "created_utc", least: int = 50) -> DataFrame:
    """(weekday, hour, n, rate) of cells with enough rows, and the range over them."""
    at = F.timestamp_seconds(ts)
    cells = df.where("label is not null").groupBy(F.weekday(at).alias("weekday"), F.hour(at).alias("hour")).agg(F.count("*").alias("n"), F.avg("label").alias("rate")).where(F.col("n") >= least)
    return cells.crossJoin(F.broadcast(cells.agg((F.max("rate") - F.min("rate")).alias("range"))))  # 168 cells at the most, and one row


def category_by_year(df: DataFrame, by: str, top: int = 15, least: int = 30, ts: str = "created_utc") -> DataFrame:
    labelled = df.where("label is not null")
    biggest = labelled.groupBy(by).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), by).limit(top).select(by)
    cells = labelled.join(F.broadcast(biggest), by, "left_semi").groupBy(by, F.year(F.timestamp_seconds(ts)).alias("year")).agg(F.count("*").alias("n"), F.avg("label").alias("rate")).where(F.col("n") >= least)
    own = Window.partitionBy(by)
    return cells.withColumn("drift", F.when(F.count("*").over(own) >= 2, F.max("rate").over(own) - F.min("rate").over(own)))


def rate_by_bucket(df: DataFrame, bucket: Column, size: int) -> DataFrame:
    rates = df.where("label is not null").groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.avg("label").alias("rate"))
    return df.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket")).join(rates, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "rate")


def quantile_edges(df: DataFrame, column: str, q: int = 10) -> DataFrame:
    """One row: the distinct quantiles of the column, least and greatest value included."""
    names = {f"e{i}": i / q for i in range(q + 1)}
    return quantiles_of(df, column, names).select(F.array_distinct(F.array(*names)).alias("_edges"))


def quantile_bins(df: DataFrame, column: str, q: int = 10, out: str = "bin", edges: DataFrame | None = None) -> DataFrame:
    """Adds the quantile bin: right-closed, the least value included, equal edges merged. ``edges`` are found in ``df`` unless given."""
    edges = quantile_edges(df, column, q) if edges is None else edges
    x = F.col(column).cast("double")
    place = F.size(F.filter("_edges", lambda e: e < x)) - 1
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(x.isNotNull(), F.greatest(place, F.lit(0)))).drop("_edges")


def mutual_information(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bits that each categorical column shares with the label, from one contingency count of all columns.

    n I = sum c log c - sum cx log cx - sum cy log cy + n log n, over cells, values and labels: sums, no windows.
    """
    cells = materialised(_long(df, columns, "string").groupBy("feature", "x", "y").agg(F.count("*").alias("c")), "cells")

    def sums(*keys: str) -> DataFrame:
        counts = cells.groupBy("feature", *keys).agg(F.sum("c").alias("c"))
        return counts.groupBy("feature").agg(F.sum(F.col("c") * F.log2("c")).alias("h_" + "".join(keys)))

    n = cells.groupBy("feature").agg(F.sum("c").alias("n"))
    for more in (sums("x", "y"), sums("x"), sums("y")):
        n = n.join(more, "feature")
    return n.select("feature", F.greatest((F.col("h_xy") - F.col("h_x") - F.col("h_y")) / F.col("n") + F.log2("n"), F.lit(0.0)).alias("mutual_information"))


def information_columns() -> list[Column]:
    """The eight columns of a post that information_ranking compares, two of them to be binned."""
    at = F.when(valid_time(F.col("created_utc")), F.timestamp_seconds("created_utc"))
    body = F.coalesce("body", F.lit(""))
    return [
        F.coalesce("subreddit", F.lit("nan")).alias("category"), F.hour(at).alias("hour"), F.weekday(at).alias("weekday"), F.year(at).alias("year"),
        (~is_removed(body)).alias("has_body"), length_bucket(F.length(body)).alias("body_length_bucket"), F.col("upvotes"), F.col("num_comments"),
    ]


def ranked_information(rows: DataFrame, bins: int = 10) -> DataFrame:
    """``rows``, a written table, has label and information_columns. Edges are found in it, not in what is joined to it."""
    edges = {c: materialised(quantile_edges(rows, c, bins), "edges") for c in ("upvotes", "num_comments")}  # a row each
    for c, own in edges.items():
        rows = quantile_bins(rows, c, bins, f"{c}_bucket", own)
    names = ["category", "hour", "weekday", "year", "has_body", "body_length_bucket", "upvotes_bucket", "num_comments_bucket"]
    # Eight rows: ranked in one task.
    return mutual_information(rows, names).withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("mutual_information", 9)), "feature")))


def information_ranking(posts: DataFrame, bins: int = 10) -> DataFrame:
    """Eight columns of a post by the bits that each shares with the label, the most telling first. Texts are read once."""
    return ranked_information(materialised(posts.select("label", *information_columns()), "information"), bins)
