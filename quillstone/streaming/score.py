"""Scoring of posts: one function for tables and for streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.features import meta_features, with_rates
from quillstone.functions.text import clean_text


def validated(requests: DataFrame) -> DataFrame:
    """Adds ``reject``: null, or why the request is refused."""
    text = F.concat(F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    reason = F.when((F.coalesce("url", F.lit("")) == "") & (text == ""), "no url and no text").when((F.col("upvotes") < 0) | (F.col("num_comments") < 0), "negative count")
    return requests.withColumn("reject", reason)


def prepared(requests: DataFrame, now: Column | None = None, entities: bool = True) -> DataFrame:
    """Scraped values (scraped_*, where there are such columns) override given ones; texts cleaned, counts clamped."""
    def pick(c: str) -> Column:
        return F.coalesce(f"scraped_{c}", c) if f"scraped_{c}" in requests.columns else F.col(c)

    counts = {c: F.greatest(F.coalesce(pick(c), F.lit(0)), F.lit(0)).cast("bigint") for c in ("upvotes", "num_comments")}
    out = validated(requests).withColumns({f"_{c}": clean_text(pick(c), entities) for c in ("title", "body")} | counts | {"created_utc": F.coalesce(pick("created_utc"), now if now is not None else F.unix_timestamp())})
    # Made by a generator of one row, through which no filter is pushed: each text is cleaned once.
    out = out.select(*(c for c in out.columns if c not in ("title", "body", "_title", "_body")), F.inline(F.array(F.struct(F.col("_title").alias("title"), F.col("_body").alias("body")))))
    out = out.withColumns({"has_title": F.length("title") > 0, "has_body": F.length("body") > 0})
    return out.withColumn("reject", F.coalesce("reject", F.when(~F.col("has_title") & ~F.col("has_body"), "nothing left after cleaning")))


def linear_score(weights: dict[str, float], bias: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """A logistic score over feature columns; any model's transform fits in its place."""
    total = F.lit(bias)
    for name, w in weights.items():
        total = total + F.col(name).cast("double") * w
    return lambda df: df.withColumn("p_final", 1 / (1 + F.exp(-total)))


def score(requests: DataFrame, model: Callable[[DataFrame], DataFrame], threshold: float = 0.5, now: Column | None = None, entities: bool = True) -> DataFrame:
    """id, p_final and predicted of every accepted request. Row-local, so that it runs on a stream as it is."""
    ready = prepared(requests, now, entities).where("reject is null")
    if "label" not in ready.columns:
        ready = ready.withColumn("label", F.lit(None).cast("tinyint"))
    scored = model(with_rates(meta_features(ready)))
    return scored.select("id", "p_final", (F.col("p_final") >= threshold).cast("int").alias("predicted"))


def score_stream(requests: DataFrame, model: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **options):
    """Start scoring a stream into Parquet; ends when what is there now has been scored."""
    return score(requests, model, **options).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def dedup_stream(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a content hash that arrive within ``delay`` of event time."""
    from quillstone.functions.text import content_hash, dedup_form

    keyed = requests.withColumn("content", content_hash(F.concat(dedup_form(F.col("title")), F.lit(" || "), dedup_form(F.col("body"))), 16))
    return keyed.withColumn("at", F.timestamp_seconds("created_utc")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["content"])


def distinct_stream(events: DataFrame, keys: list[str], at: str, delay: str, out: str, checkpoint: str):
    """Start writing the first event of each key (repeats within ``delay`` of event time) to Parquet; ends when what is there now is
    written. The checkpoint remembers the input that was read and the keys seen: started again, it writes only what is new.
    """
    once = events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
    return once.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
