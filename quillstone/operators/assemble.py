"""Joins and unions of score tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.evaluate import confusion, smoothed_metrics
from quillstone.operators.topk import first_rows


def join_splits(df: DataFrame, splits: DataFrame) -> DataFrame:
    return df.join(splits, "id", "inner")


def with_labels(scores: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Rows that come without labels get theirs; rows that have none go."""
    return scores.join(labels, key, "inner")


def first_source(sources: list[DataFrame]) -> DataFrame:
    """One score per id: of ids in several sources, the earliest source's."""
    tagged = reduce(DataFrame.unionByName, (s.select("id", "p_text").withColumn("_source", F.lit(i)) for i, s in enumerate(sources)))
    return first_rows(tagged, [F.col("id")], ["_source", "p_text"]).drop("_source")


def attach_scores(df: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their score, and the number of rows without one by split."""
    joined = df.join(scores, "id", "left")
    return joined.where("p_text is not null"), joined.where("p_text is null").groupBy("time_split").agg(F.count("*").alias("n_missing"))


def mean_of_folds(folds: list[DataFrame]) -> DataFrame:
    """The mean of an id's scores over the folds that have it: a union and one aggregate for a chain of outer joins."""
    return reduce(DataFrame.unionByName, (f.select("id", "p_text") for f in folds)).groupBy("id").agg(F.avg("p_text").alias("p_text"), F.count("p_text").alias("n_folds"))


def out_of_fold(folds: list[DataFrame]) -> DataFrame:
    """All fold outputs with their fold and how often each id occurs (1 if the folds are disjoint)."""
    rows = reduce(DataFrame.unionByName, (f.withColumn("fold", F.lit(i)) for i, f in enumerate(folds)))
    return rows.withColumn("n_seen", F.count("*").over(Window.partitionBy("id")))


def alignment_gap(scores: DataFrame, least: float | None = None, score: str = "p_text") -> DataFrame:
    """Mean score of positives less that of negatives; with ``least``, a smaller gap is an error."""
    gap = F.avg(F.when(F.col("label") == 1, F.col(score))) - F.avg(F.when(F.col("label") == 0, F.col(score)))
    out = scores.agg(gap.alias("gap"), F.count("*").alias("n"))
    return out if least is None else out.withColumn("gap", F.when(F.col("gap") >= least, F.col("gap")).otherwise(F.raise_error(F.lit("scores do not follow the labels"))))


def repeated_scores(runs: DataFrame) -> DataFrame:
    """id, mean, population deviation and confidence over (id, run, score)."""
    return runs.groupBy("id").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")).withColumn("confidence", F.greatest(F.lit(0.0), 1 - 2 * F.col("std")))


def prediction_summary(predictions: DataFrame, threshold: float = 0.5, score: str = "p_text") -> DataFrame:
    """Totals of a batch; its metrics only where every row is labelled, else null."""
    yes = F.col(score) >= threshold
    totals = predictions.agg(F.count("*").alias("n"), F.count_if(yes).alias("n_positive"), F.try_divide(F.count_if(yes) * 100.0, F.count("*")).alias("pct_positive"), (F.count("label") == F.count("*")).alias("_every"))
    metrics = smoothed_metrics(confusion(predictions, threshold, (), score))  # a row each
    names = ("accuracy", "precision", "recall", "specificity", "f1")
    return totals.crossJoin(metrics).select("n", "n_positive", "pct_positive", *(F.when(F.col("_every"), F.col(m)).alias(m) for m in names))
