"""Evaluation of scores. Everything starts from counts per distinct score or per threshold step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.ranks import joined, running_sums
from quillstone.operators.relations import quantile_bins
from quillstone.operators.topk import first_rows


#: Fixed value: what the smoothed metrics add to their denominators.
SMOOTHING = 1e-8


def confusion(df: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = (), score: str = "p") -> DataFrame:
    yes, y = F.col(score) >= threshold, F.col("label") == 1
    return df.groupBy(*by).agg(F.count_if(~yes & ~y).alias("tn"), F.count_if(yes & ~y).alias("fp"), F.count_if(~yes & y).alias("fn"), F.count_if(yes & y).alias("tp"))


def with_metrics(counts: DataFrame) -> DataFrame:
    """Metrics of tn, fp, fn, tp; an empty denominator gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    out = {
        "accuracy": ratio(tn + tp, tn + fp + fn + tp), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp),
        "f1_pos": ratio(2 * tp, 2 * tp + fp + fn), "f1_neg": ratio(2 * tn, 2 * tn + fp + fn),
    }
    out |= {"f1_macro": (out["f1_pos"] + out["f1_neg"]) / 2, "recall_macro": (out["recall"] + out["specificity"]) / 2}
    return counts.withColumns(out)


def smoothed_metrics(counts: DataFrame) -> DataFrame:
    """The older form: SMOOTHING in each denominator but accuracy's, which is null without rows; F1 from the smoothed precision and recall."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    out = counts.withColumns({"accuracy": F.try_divide((tn + tp).cast("double"), tn + fp + fn + tp), "precision": tp / (tp + fp + SMOOTHING), "recall": tp / (tp + fn + SMOOTHING), "specificity": tn / (tn + fp + SMOOTHING)})
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + SMOOTHING))


def curve(df: DataFrame, by: tuple[str, ...] = (), score: str = "p") -> DataFrame:
    """Per distinct score: tp and fp of the threshold there, totals, tpr, fpr, precision.

    The running sums go over ranges of scores, so that no task sorts all of a group's.
    """
    steps = df.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    out = running_sums(steps.where("threshold is not null"), list(by), "threshold", ["pos", "neg"])
    out = out.withColumns({"tp": F.col("pos_total") - F.col("pos_below"), "fp": F.col("neg_total") - F.col("neg_below")}).withColumnsRenamed({"pos_total": "n_pos", "neg_total": "n_neg"})
    out = out.select(*by, "threshold", "pos", "neg", "tp", "fp", "n_pos", "n_neg")
    return out.withColumns({"tpr": F.try_divide("tp", "n_pos"), "fpr": F.try_divide("fp", "n_neg"), "precision": F.col("tp") / (F.col("tp") + F.col("fp"))})


def curve_points(df: DataFrame, by: tuple[str, ...] = (), score: str = "p") -> DataFrame:
    """The corners of the ROC curve: a distinct score whose step goes on in its neighbour's direction is left out.

    A point lies on the straight line between its neighbours just where its own step and the next lower score's step
    have the same ratio of positives to negatives. Neighbours are looked up by rank among the distinct scores.
    """
    c = running_sums(curve(df, by, score).withColumn("one", F.lit(1)), list(by), "threshold", ["one"]).withColumnRenamed("one_below", "rank")
    lower = c.select(*by, (F.col("rank") + 1).alias("rank"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg"))
    met = joined(c, lower, [*by, "rank"], "left")
    corner = F.col("next_pos").isNull() | (F.col("pos") * F.col("next_neg") != F.col("neg") * F.col("next_pos"))
    return met.where(corner).select(*by, "threshold", "tp", "fp", "tpr", "fpr", "precision")


def areas(df: DataFrame, by: tuple[str, ...] = (), score: str = "p") -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step sum); null where one class is missing."""
    c = curve(df, by, score)
    pairs = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    n_pos, n_neg = F.max("n_pos"), F.max("n_neg")
    return c.groupBy(*by).agg((pairs / F.nullif(n_pos * n_neg, F.lit(0))).alias("roc_auc"), (F.sum(F.col("pos") * F.col("precision")) / F.nullif(n_pos, F.lit(0))).alias("pr_auc"))


def threshold_sweep(df: DataFrame, low: float = 0.05, high: float = 0.95, points: int = 91, by: tuple[str, ...] = (), score: str = "p") -> DataFrame:
    """Metrics at every grid point: rows are counted by how many points lie at or below their score, then summed from above."""
    step = (high - low) / (points - 1)
    grid = [low + i * step for i in range(points)]
    # The division may be off by one at an edge: the neighbours decide.
    guess = F.greatest(F.lit(0), F.least(F.lit(points), F.floor((F.col(score) - low) / step).cast("int") + 1))
    edges = F.array(*(F.lit(g) for g in grid))
    at = F.when(F.get(edges, guess) <= F.col(score), guess + 1).when((guess > 0) & (F.get(edges, guess - 1) > F.col(score)), guess - 1).otherwise(guess)
    counts = df.groupBy(*by, at.alias("bin")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    own = counts.groupBy(*by).agg(F.collect_list(F.struct("bin", "pos", "neg")).alias("bins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    rows = own.select(*by, "bins", "n_pos", "n_neg", F.posexplode(edges).alias("i", "threshold"))
    above = lambda c: F.aggregate(F.filter("bins", lambda b: b["bin"] > F.col("i")), F.lit(0).cast("long"), lambda s, b: s + b[c])
    rows = rows.withColumns({"tp": above("pos"), "fp": above("neg")}).withColumns({"fn": F.col("n_pos") - F.col("tp"), "tn": F.col("n_neg") - F.col("fp")})
    return with_metrics(rows.drop("bins", "n_pos", "n_neg", "i"))


def best_threshold(df: DataFrame, by: tuple[str, ...] = (), score: str = "p", **grid) -> DataFrame:
    """The lowest threshold of the best macro F1."""
    swept = threshold_sweep(df, by=by, score=score, **grid)
    best = F.min_by(F.struct("threshold", "f1_macro"), F.struct(-F.round("f1_macro", 12), "threshold")).alias("b")
    return swept.groupBy(*by).agg(best).select(*by, "b.*")


def fold_summary(metrics: DataFrame, by: tuple[str, ...], columns: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(*(f for c in columns for f in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))))


def metrics_matrix(df: DataFrame, by: tuple[str, ...], score: str = "p") -> DataFrame:
    """Per group and mode (at 0.50, at the best threshold): n, rate of positives, threshold, metrics and areas."""
    best = threshold_sweep(df, by=by, score=score)
    best = first_rows(best, [F.col(c) for c in by], [-F.round("f1_macro", 12), "threshold"]).withColumn("mode", F.lit("best"))
    half = with_metrics(confusion(df, 0.5, by, score)).withColumns({"threshold": F.lit(0.5), "mode": F.lit("half")})
    facts = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg("label").alias("pos_rate")).join(areas(df, by, score), list(by))
    return half.unionByName(best).join(facts, list(by))


def stacked(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row per model and row: model, label, p, from score columns side by side."""
    models = F.array(*(F.struct(F.lit(c).alias("model"), F.col(c).alias("p")) for c in columns))
    return df.select("label", F.inline(models))


def model_comparison(df: DataFrame, by: tuple[str, ...] = ("model",), score: str = "p") -> DataFrame:
    """metrics_matrix per model, with the metrics of its probabilities and its calibration error."""
    return metrics_matrix(df, by, score).join(probability_metrics(df, by, score), list(by)).join(calibration_error(df, by=by, score=score), list(by))


def ablation(df: DataFrame, columns: tuple[str, ...], whole: str, threshold: float = 0.5) -> DataFrame:
    """f1_macro and f1_pos of each score column, and what it lacks of the column ``whole``."""
    m = with_metrics(confusion(stacked(df, columns), threshold, ("model",))).select("model", "f1_macro", "f1_pos")
    return m.withColumn("loss", F.col("f1_macro") - F.max(F.when(F.col("model") == whole, F.col("f1_macro"))).over(Window.partitionBy()))


def calibration_error(df: DataFrame, bins: int = 10, by: tuple[str, ...] = (), score: str = "p") -> DataFrame:
    """Expected calibration error over equal bins [lo, hi), 1.0 in the last."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    own = df.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("p"), F.avg("label").alias("y"))
    return own.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def reliability(df: DataFrame, bins: int = 10, score: str = "p") -> DataFrame:
    """Per quantile bin of the score: rows, mean score, rate of positives."""
    return quantile_bins(df, score, bins).groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_p"), F.avg("label").alias("rate"))


def probability_metrics(df: DataFrame, by: tuple[str, ...] = (), score: str = "p", clip: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(clip)), F.lit(1 - clip))
    loss = -F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"), F.avg((F.col(score) - F.col("label")) ** 2).alias("brier"), F.avg(score).alias("mean_p"))


def score_histogram(df: DataFrame, bins: int = 50, score: str = "p") -> DataFrame:
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    counts = df.groupBy("label", at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.col("n") * bins / F.sum("n").over(Window.partitionBy("label")))


def recall_at_precision(df: DataFrame, precision: float = 0.9, score: str = "p") -> DataFrame:
    return curve(df, (), score).where(F.col("precision") >= precision).agg(F.max("tpr").alias("recall"))


def precision_at_recall(df: DataFrame, recall: float = 0.9, score: str = "p") -> DataFrame:
    return curve(df, (), score).where(F.col("tpr") >= recall).agg(F.max("precision").alias("precision"))


def normalised_importance(importance: DataFrame) -> DataFrame:
    total = importance.agg(F.sum("gain").alias("_all"))
    return importance.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide(F.col("gain").cast("double"), "_all")).drop("_all")


def slices(df: DataFrame, category: str = "subreddit", largest: int = 5, small: int = 10_000, short: int = 20) -> DataFrame:
    """``df`` (category, label, hit, body, p) with ``slice``, a row for each slice that it lies in.

    Slices: all; the rows of each of the largest categories; of all categories under ``small`` rows; negatives with a
    keyword (hit), the likely false positives; positives with an empty or short body, the likely false negatives.
    """
    sizes = df.groupBy(category).agg(F.count("*").alias("_n"))
    top = sizes.orderBy(F.desc("_n"), category).limit(largest).select(F.col(category).alias("_top"))  # the limit bounds the broadcast
    sized = joined(df, sizes, [category]).join(F.broadcast(top), F.col(category) == F.col("_top"), "left")
    short_body = F.length(F.coalesce("body", F.lit(""))) < short
    names = F.array(
        F.lit("all"), F.when(F.col("_top").isNotNull(), F.concat(F.lit("category:"), "_top")), F.when(F.col("_n") < small, "small categories"),
        F.when((F.col("label") == 0) & F.col("hit"), "negatives with keyword"), F.when((F.col("label") == 1) & short_body, "positives with short body"),
    )
    return sized.withColumn("slice", F.explode(F.array_compact(names))).drop("_n", "_top")


def slice_metrics(df: DataFrame, by: str = "slice", threshold: float = 0.5, precision: float = 0.9, score: str = "p") -> DataFrame:
    """Per slice or category: n, confusion counts, metrics, and the recall at a precision (null where it is not reached)."""
    counts = with_metrics(confusion(df, threshold, (by,), score)).withColumn("n", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    reached = curve(df, (by,), score).where(F.col("precision") >= precision).groupBy(by).agg(F.max("tpr").alias("recall_at_precision"))
    return joined(counts, reached, [by], "left")
