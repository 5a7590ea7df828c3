"""Text and meta models on Spark ML, fold by fold."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import IDF, HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import simple_words
from quillstone.operators.assemble import out_of_fold
from quillstone.operators.evaluate import confusion, with_metrics
from quillstone.operators.splits import fold_slices
from quillstone.sources.scratch import materialised


def balanced(df: DataFrame) -> DataFrame:
    """Adds the class weight n / (2 n_c)."""
    totals = df.agg(F.count("*").alias("n"), F.sum("label").alias("n1"))
    n, n1 = totals.select("n").scalar(), totals.select("n1").scalar()
    return df.withColumn("weight", F.when(F.col("label") == 1, F.try_divide(n, 2 * n1)).otherwise(F.try_divide(n, 2 * (n - n1))))


def term_frequencies(features: int = 1 << 16) -> HashingTF:
    return HashingTF(inputCol="words", outputCol="tf", numFeatures=features)


def fitted_stages(regularisation: float = 0.01, iterations: int = 20) -> list:
    """The stages over term frequencies that are fitted."""
    regression = LogisticRegression(featuresCol="tfidf", labelCol="label", weightCol="weight", regParam=regularisation, maxIter=iterations)
    return [IDF(inputCol="tf", outputCol="tfidf", minDocFreq=2), regression]


def text_pipeline(features: int = 1 << 16, **params) -> Pipeline:
    return Pipeline(stages=[term_frequencies(features), *fitted_stages(**params)])


def with_words(posts: DataFrame) -> DataFrame:
    return posts.withColumn("words", simple_words(F.concat_ws(" ", "title", "body")))


def _score(model, df: DataFrame, out: str = "p_text") -> DataFrame:
    return model.transform(df).select("id", vector_to_array("probability")[1].cast("float").alias(out), "label")


def fold_scores(posts: DataFrame, k: int = 3, features: int = 1 << 16, **params) -> DataFrame:
    """Out-of-fold text scores: for each fold, fit on the others and score it. ``posts`` has fold and label.

    Term frequencies are the same in every fold: they are written once, and no pass reads words.
    """
    words = with_words(posts.where("label is not null")).select("id", "label", "fold", "words")
    rows = materialised(term_frequencies(features).transform(words).drop("words"), "frequencies")
    scored = []
    for i in range(k):
        train, held_out = fold_slices(rows, i)
        scored.append(_score(Pipeline(stages=fitted_stages(**params)).fit(balanced(train)), held_out))
    return out_of_fold(scored)


def full_scores(train: DataFrame, others: DataFrame, **params) -> DataFrame:
    return _score(text_pipeline(**params).fit(balanced(with_words(train.where("label is not null")))), with_words(others))


def term_weights(rows: DataFrame, k: int = 3, alpha: float = 1.0) -> DataFrame:
    """The text model as a table (fold, term, weight): smoothed log-odds of each term among positives and negatives of all
    other folds; with a null term the fold's log-odds of the classes. ``rows`` has words, label and fold.

    Counts per (fold, term) are made once; those of the other folds are the totals less the fold's own.
    """
    each = rows.where("label is not null and fold >= 0").select("fold", "label", F.explode("words").alias("term"))
    own = each.groupBy("term", "fold").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    folds = rows.sparkSession.range(k).select(F.col("id").cast("tinyint").alias("fold"))
    totals = own.groupBy("term").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    left = totals.crossJoin(F.broadcast(folds)).join(own, ["term", "fold"], "left")  # k rows a term
    left = left.select("fold", "term", *((F.col(f"all_{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in ("pos", "neg"))).where("pos + neg > 0")
    sizes = left.groupBy("fold").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.count("*").alias("v"))
    odds = lambda c: F.log((F.col(c) + alpha) / (F.col(f"n_{c}") + alpha * F.col("v")))
    weights = left.join(F.broadcast(sizes), "fold").select("fold", "term", (odds("pos") - odds("neg")).alias("weight"))  # k rows
    labels = rows.where("label is not null and fold >= 0").crossJoin(F.broadcast(folds.withColumnRenamed("fold", "_f"))).where("fold <> _f")
    bias = labels.groupBy(F.col("_f").alias("fold")).agg(F.log(F.sum("label") / F.sum(1 - F.col("label"))).alias("weight"))
    return weights.unionByName(bias.select("fold", F.lit(None).cast("string").alias("term"), "weight"))


def weighted_scores(rows: DataFrame, weights: DataFrame, key: str = "id", out: str = "p_text") -> DataFrame:
    """(key, label, fold, p_text): the mean weight of a row's words by its fold's model, with the classes' log-odds, as a probability.

    A sparse dot product: words are counted in their row, joined to the fold's weights and summed up. A mean, as a
    sum over a long text would end at 0 or 1.
    """
    each = rows.select(key, "fold", F.explode("words").alias("term")).groupBy(key, "fold", "term").agg(F.count("*").alias("tf"))
    summed = each.join(weights.where("term is not null"), ["fold", "term"]).groupBy(key).agg((F.sum(F.col("tf") * F.col("weight")) / F.sum("tf")).alias("_sum"))
    bias = weights.where("term is null").select("fold", F.col("weight").alias("_bias"))
    scored = rows.select(key, "label", "fold").join(F.broadcast(bias), "fold").join(summed, key, "left")  # a row for each fold
    return scored.select(key, "label", "fold", (1 / (1 + F.exp(-(F.col("_bias") + F.coalesce("_sum", F.lit(0.0)))))).alias(out))


def fit_meta(features: DataFrame, columns: list[str], trees: int = 50, depth: int = 5, seed: int = 42):
    """Boosted trees with early stopping on the rows where is_holdout."""
    vectors = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error")
    trees_ = GBTClassifier(
        labelCol="label", weightCol="weight", validationIndicatorCol="is_holdout", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8,
        featureSubsetStrategy="0.8", minInstancesPerNode=20, seed=seed,
    )
    numeric = features.withColumns({c: F.col(c).cast("double") for c in columns} | {"label": F.col("label").cast("double")})
    return Pipeline(stages=[vectors, trees_]).fit(balanced(numeric))


class MacroF1(Evaluator):
    """Macro F1 of the predicted class at a threshold on its probability."""

    def __init__(self, threshold: float = 0.5):
        super().__init__()
        self.threshold = threshold

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = dataset.select("label", vector_to_array("probability")[1].alias("p"))
        return with_metrics(confusion(rows, self.threshold)).first()["f1_macro"]

    def isLargerBetter(self) -> bool:
        return True


def tune_meta(features: DataFrame, columns: list[str], grid: dict[str, list], folds: int = 3, parallelism: int = 2):
    """Mean macro F1 of every parameter combination over the fixed folds in column ``fold``; the fitted CrossValidator model."""
    vectors = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error")
    model = GBTClassifier(labelCol="label", weightCol="weight", seed=42)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(model.getParam(name), values)
    rows = features.where("fold >= 0").withColumns({c: F.col(c).cast("double") for c in columns} | {"label": F.col("label").cast("double"), "fold": F.col("fold").cast("int")})
    search = CrossValidator(estimator=model, estimatorParamMaps=builder.build(), evaluator=MacroF1(), numFolds=folds, foldCol="fold", parallelism=parallelism)
    return search.fit(vectors.transform(balanced(rows)))


def meta_scores(model, features: DataFrame, columns: list[str]) -> DataFrame:
    return _score(model, features.withColumns({c: F.col(c).cast("double") for c in columns}), "p_final")


def importance(spark: SparkSession, model, columns: list[str]) -> DataFrame:
    """(feature, gain) of a fitted meta-model; one row a feature."""
    gains = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(columns, gains, strict=True)), "feature string, gain double")


def isotonic(scores: DataFrame, others: DataFrame, score: str = "p_final") -> DataFrame:
    """Scores calibrated on a disjoint holdout."""
    cast = lambda df: df.withColumns({score: F.col(score).cast("double"), "label": F.col("label").cast("double")})
    model = IsotonicRegression(featuresCol=score, labelCol="label", predictionCol="calibrated").fit(cast(scores))
    return model.transform(cast(others))
