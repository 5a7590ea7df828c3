"""Time, random and fold splits; samples of exact size. All draws are ranks of a hash, so that they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.ranks import joined as joined_on, running_sums


def time_split(ts: Column, train_until: int = 2020, val: int = 2021, test: int = 2022) -> Column:
    year = F.year(F.timestamp_seconds(ts))
    return F.when(year <= train_until, "train").when(year == val, "val").when(year == test, "test").otherwise("unknown")


def split_report(df: DataFrame, split: str = "time_split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n"), F.avg("label").alias("label_rate"))


def hash_rank(df: DataFrame, seed: int, by: tuple[str, ...] = ("label",), key: str = "id", out: str = "rank", digits: int = 2) -> DataFrame:
    """Adds each row's place, from 0, in its stratum by the order of a hash, and the stratum's size ``n``.

    No task sorts a whole stratum: rows are ranked inside (stratum, first digits of the hash), and the
    counts of those buckets, at most strata * 16 ** digits rows, are summed and joined back.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    drawn = df.withColumn("_draw", draw).withColumn("_bucket", F.left("_draw", F.lit(digits)))
    counts = drawn.groupBy(*by, "_bucket").agg(F.count("*").alias("_c"))
    stratum = Window.partitionBy(*by)
    starts = counts.select(
        *by, "_bucket", F.coalesce(F.sum("_c").over(stratum.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_c").over(stratum).alias("n")
    )
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_draw", key))
    # AQE broadcasts the starts while they are small.
    placed = joined_on(drawn.withColumn("_in", inside), starts, [*by, "_bucket"])
    return placed.withColumn(out, F.col("_start") + F.col("_in") - 1).drop("_draw", "_bucket", "_in", "_start")


def stratified_split(df: DataFrame, parts: dict[str, float], seed: int = 42, rest: str = "train", out: str = "random_split") -> DataFrame:
    """Each part takes round(share * n) rows of every label; the rest stays."""
    ranked = hash_rank(df, seed)
    label, before = None, F.lit(0)
    for name, share in parts.items():
        until = before + F.floor(F.col("n") * share + 0.5)
        label = F.when(F.col("rank") < until, name) if label is None else label.when(F.col("rank") < until, name)
        before = until
    return ranked.withColumn(out, label.otherwise(rest)).drop("rank", "n")


def stratified_folds(df: DataFrame, k: int = 3, seed: int = 2024, train: Column | None = None) -> DataFrame:
    """fold 0 to k - 1 on the train rows, sizes within one of each other per label; -1 elsewhere."""
    part = df.withColumn("_train", F.coalesce(train, F.lit(False)) if train is not None else F.lit(True))
    ranked = hash_rank(part, seed, ("label", "_train"))
    return ranked.withColumn("fold", F.when(F.col("_train"), F.col("rank") % k).otherwise(-1).cast("tinyint")).drop("rank", "n", "_train")


def category_folds(df: DataFrame, category: str, k: int = 3, strata: int = 4) -> DataFrame:
    """Whole categories in k folds: (category, n, n_positive, fold), so that a model meets none of its test categories in training.

    Categories of a similar label rate (``strata`` equal ranges of it; without labels the lowest) are dealt out from the largest to the smallest, forth
    and back over the folds (0, 1, 2, 2, 1, 0, ...), ties by name. In each stratum the rows of two folds then differ by no
    more than its largest category. Only the table of categories is ranked, in ranges.
    """
    counts = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("n_positive"), F.coalesce(F.avg("label"), F.lit(0.0)).alias("rate"))
    stratum = F.least(F.floor(F.col("rate") * strata), F.lit(strata - 1)).cast("int")
    placed = counts.select(category, "n", "n_positive", stratum.alias("stratum"), F.struct((-F.col("n")).alias("n"), F.col(category).alias("name")).alias("order"), F.lit(1).alias("one"))
    turn = running_sums(placed, ["stratum"], "order", ["one"]).withColumn("turn", F.col("one_below") % (2 * k))
    return turn.select(category, "n", "n_positive", F.when(F.col("turn") < k, F.col("turn")).otherwise(2 * k - 1 - F.col("turn")).cast("int").alias("fold"))


def split_slice(df: DataFrame, name: str, split: str = "time_split") -> DataFrame:
    """The rows of one split; a null split belongs to none."""
    return df.where(F.col(split) == name)


def fold_slices(df: DataFrame, held_out: int) -> tuple[DataFrame, DataFrame]:
    """The rows to train on (all other folds) and those of the fold held out; rows outside the folds (-1, null) are in neither."""
    inside = df.where("fold >= 0")
    return inside.where(F.col("fold") != held_out), inside.where(F.col("fold") == held_out)


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """Exactly min(n, rows) rows, the same each time."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def sample_per_class(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    return hash_rank(df, seed).where(F.col("rank") < k).drop("rank", "n")


def undersample_negatives(df: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Every positive and floor(share * n) negatives."""
    return hash_rank(df, seed).where((F.col("label") != 0) | (F.col("rank") < F.floor(F.col("n") * share))).drop("rank", "n")


def eval_subsets(df: DataFrame, first: int, second: int, seed: int = 42) -> DataFrame:
    """Two disjoint stratified subsets: ``subset`` 1 or 2, by ranges of one order."""
    ranked = hash_rank(df, seed)
    total = df.agg(F.count("*").alias("t")).scalar()
    a = F.floor(F.col("n") * first / total + 0.5)
    b = a + F.floor(F.col("n") * second / total + 0.5)
    return ranked.withColumn("subset", F.when(F.col("rank") < a, 1).when(F.col("rank") < b, 2)).where("subset is not null").drop("rank", "n")


def holdout(df: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Adds is_holdout, a stratified share of the rows."""
    return hash_rank(df, seed).withColumn("is_holdout", F.col("rank") < F.floor(F.col("n") * share + 0.5)).drop("rank", "n")


def class_weights(df: DataFrame) -> DataFrame:
    """pos_weight = negatives / positives (1 without positives), and the balanced weight of each class."""
    n1, n = F.sum("label"), F.count("label")
    return df.agg(F.coalesce(F.try_divide(n - n1, n1), F.lit(1.0)).alias("pos_weight"), F.try_divide(n, 2 * (n - n1)).alias("weight_0"), F.try_divide(n, 2 * n1).alias("weight_1"))
