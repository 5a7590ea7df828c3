"""The post tables that the operators read, derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text as title (its first line) and body (the rest): id, subreddit, title, body, upvotes, created_utc, num_comments, label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    n = F.col("doc_id")
    return docs.join(labels, "doc_id", "left").select(
        n.cast("string").alias("id"),
        F.col("source").alias("subreddit"),
        first.alias("title"),
        F.substr("text", F.length(first) + 2).alias("body"),
        F.when(n % 97 == 0, None).otherwise((n * 7919 % 2003).cast("int")).alias("upvotes"),
        (1199145600 + n * 1234577 % 473385600).alias("created_utc"),
        F.when(n % 23 == 0, None).otherwise((n * 104729 % 211 - 3).cast("int")).alias("num_comments"),
        "label",
    )


def scores(spark: SparkSession, sf_dir: str, factor: int = 2654435761) -> DataFrame:
    """id, label and a deterministic score that follows the label."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"), (F.col("quality") * F.lit(0.4) + F.col("doc_id") * factor % 1000 * F.lit(0.0006)).alias("p_text")
    )


#: The same tables in SQL, for the oracle.
POSTS_SQL = """
posts AS (
  SELECT cast(d.doc_id AS varchar) AS id, d.source AS subreddit, split_part(d.text, chr(10), 1) AS title,
    substring(d.text, length(split_part(d.text, chr(10), 1)) + 2) AS body,
    CASE WHEN d.doc_id % 97 = 0 THEN NULL ELSE cast((d.doc_id * 7919) % 2003 AS int) END AS upvotes,
    cast(1199145600 + (d.doc_id * 1234577) % 473385600 AS bigint) AS created_utc,
    CASE WHEN d.doc_id % 23 = 0 THEN NULL ELSE cast((d.doc_id * 104729) % 211 - 3 AS int) END AS num_comments,
    l.quality AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
SCORES_SQL = """
scores AS (SELECT doc_id AS id, quality AS label, cast(quality AS double) * 0.4 + cast((doc_id * 2654435761) % 1000 AS double) * 0.0006 AS p_text FROM labels)"""
