import pytest
from pyspark.sql import functions as F

from quillstone.sources import files
from quillstone.sources.posts import posts
from quillstone.streaming.score import dedup_stream, linear_score, prepared, score, score_stream
from tests.conftest import SMALL


def test_csv_with_line_ends(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('id,subreddit,title,body,upvotes,created_utc,num_comments,label\n1,a,t,"two\nlines ""quoted""",3,1500000000,,1\n')
    r = files.read_csv(spark, str(path)).first()
    assert r.body == 'two\nlines "quoted"' and r.upvotes == 3 and r.num_comments is None
    p = files.convert_with_provenance(spark, str(path), str(tmp_path / "raw.parquet")).first()
    assert p.n_rows == 1 and p.n_columns == 8 and p.csv_bytes == path.stat().st_size and p.parquet_bytes > 0
    assert files.read_table(spark, str(tmp_path / "raw.parquet"), ["id"]).columns == ["id"]
    with pytest.raises(FileNotFoundError, match="run convert first"):
        files.read_table(spark, str(tmp_path / "none"), made_by="convert")


def test_text_csv_and_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿text,label\nhello,1\n  ,0\nbad,x\n".encode())
    assert [(r.text, r.label) for r in files.read_text_csv(spark, str(tmp_path / "t.csv")).collect()] == [("hello", 1), ("bad", None)]
    (tmp_path / "t.txt").write_text("one\n\n \ntwo\n")
    assert [r.text for r in files.read_lines(spark, str(tmp_path / "t.txt")).collect()] == ["one", "two"]


def test_metrics_sections(spark, tmp_path):
    path = str(tmp_path / "m")
    make = lambda rows: spark.createDataFrame(rows, "section string, metric string, key string, value double")
    files.write_metrics(make([("a", "x", "", 1.0), ("b", "y", "k", 2.0)]), path)
    files.write_metrics(make([("a", "x", "", 3.0)]), path)
    assert [(r.metric, r.value) for r in files.flatten_metrics(spark.read.parquet(path)).collect()] == [("a.x", 3.0), ("b.y.k", 2.0)]


def test_union_existing_and_cache(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    assert files.union_existing(spark, [str(tmp_path / "a"), str(tmp_path / "none")]).count() == 3
    with pytest.raises(FileNotFoundError):
        files.union_existing(spark, [str(tmp_path / "none")])
    made = []
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "c"), lambda: made.append(1) or spark.range(2)).count() == 2
    assert made == [1]
    files.write_report_csv(spark.range(2), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2


REQUEST = "id string, url string, title string, body string, upvotes bigint, num_comments bigint, created_utc bigint"


def test_requests(spark):
    rows = [("1", None, "t", "I am [x](https://a.b) sad", 1, 2, None), ("2", "", "", "", 0, 0, 0), ("3", "u", "t", "b", -1, 0, 0), ("4", "u", "", "&nbsp;", None, None, 5)]
    got = {r.id: r for r in prepared(spark.createDataFrame(rows, REQUEST), F.lit(77)).collect()}
    assert got["1"].body == "I am x sad" and got["1"].created_utc == 77 and got["1"].reject is None
    assert got["2"].reject == "no url and no text" and got["3"].reject == "negative count" and got["4"].reject == "nothing left after cleaning"


def test_batch_equals_stream(spark, tmp_path):
    model = linear_score({"num_words": 0.01, "first_person_rate": 3.0}, -1.0)
    requests = posts(spark, SMALL).select("id", F.lit(None).cast("string").alias("url"), "title", "body", F.abs("upvotes").cast("bigint").alias("upvotes"), F.abs("num_comments").cast("bigint").alias("num_comments"), "created_utc")
    requests.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, score(requests, model).collect()))


def test_stream_dedup(spark, tmp_path):
    rows = [("1", "u", "t", "Same  body", 1, 1, 1500000000), ("2", "u", "T", "same body", 1, 1, 1500000060), ("3", "u", "t", "other", 1, 1, 1500000000)]
    spark.createDataFrame(rows, REQUEST).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = dedup_stream(spark.readStream.schema(REQUEST).parquet(str(tmp_path / "in")))
    stream.drop("at").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
