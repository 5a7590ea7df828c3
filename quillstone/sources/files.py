"""File sources and sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.functions.text import strip

RAW_SCHEMA = "id string, subreddit string, title string, body string, upvotes int, created_utc bigint, num_comments int, label tinyint"


def read_csv(spark: SparkSession, path: str, schema: str | StructType = RAW_SCHEMA, columns: list[str] | None = None) -> DataFrame:
    """Typed CSV with a header; quoted fields may hold line ends. A file is then read by one task: convert it once."""
    df = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', mode="PERMISSIVE").csv(path)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, made_by: str = "") -> DataFrame:
    """Parquet with column pruning; a missing input says which step makes it."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise FileNotFoundError(f"{path} is missing" + (f": run {made_by} first" if made_by else "")) from e
        raise
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """One file; for report tables that are small by construction."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def convert_with_provenance(spark: SparkSession, csv_path: str, parquet_path: str, schema: str | StructType = RAW_SCHEMA) -> DataFrame:
    """CSV to Parquet; one row: bytes of both, rows, columns and their names."""
    write_table(read_csv(spark, csv_path, schema), parquet_path)
    done = spark.read.parquet(parquet_path)

    def size(path: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return files.select("length").agg(F.sum("length").alias("n"))

    return done.agg(F.count("*").alias("n_rows")).select(
        size(csv_path).scalar().alias("csv_bytes"), size(parquet_path).scalar().alias("parquet_bytes"), "n_rows",
        F.lit(len(done.columns)).alias("n_columns"), F.array(*(F.lit(c) for c in done.columns)).alias("columns"),
    )


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """text and label of a CSV: byte order mark stripped, blank texts skipped, bad labels null."""
    df = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    label = F.expr("try_cast(label as int)") if "label" in df.columns else F.lit(None).cast("int")
    return df.select("text", label.alias("label")).where(strip(F.col("text")) != "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "text").where(strip(F.col("text")) != "")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Replace the sections that ``metrics`` (section, metric, key, value) holds; others stay."""
    metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section").parquet(path)


def flatten_metrics(metrics: DataFrame) -> DataFrame:
    """(metric path, value), sorted."""
    return metrics.select(F.concat_ws(".", "section", "metric", F.nullif("key", F.lit(""))).alias("metric"), "value").orderBy("metric")


def union_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All of ``paths`` that exist; an error if none does."""
    found = []
    for path in paths:
        try:
            found.append(spark.read.parquet(path))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if not found:
        raise FileNotFoundError(f"none of {paths} exists")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A hash of the names, sizes and times of all files at ``paths``."""
    found = []
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
        found.append(files.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", F.unix_micros("modificationTime")))).first())
    return hashlib.sha256(repr([tuple(x) for x in found]).encode()).hexdigest()


def content_hash_of(spark: SparkSession, path: str) -> str:
    """A hash of the bytes of the file at ``path`` (a tokenizer's), read where it lies."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).orderBy("path").agg(F.sha2(F.concat_ws(",", F.collect_list("h")), 256)).first()[0]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, folder: str, make: Callable[[], DataFrame], **of: object) -> DataFrame:
    """The table that ``make`` makes, kept in ``folder`` under a key made of all that it depends on (``of``: hashes of inputs and
    of the tokenizer's file, parameters).

    A table counts as kept when its writer has committed it: the marker that the write leaves at its end. Without
    the marker (a crash between write and commit) it is made again; any other error is the caller's.
    """
    key = hashlib.sha256(json.dumps(of, sort_keys=True, default=str).encode()).hexdigest()[:32]
    path = f"{folder.rstrip('/')}/{key}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", True).parquet(path)
    return spark.read.parquet(path)
