"""Row filters, numeric repair and deduplication of posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.lexicons import TIME_RANGE
from quillstone.functions.text import clean_text, content_hash, dedup_form, is_removed, strip
from quillstone.operators.ranks import counted, quantiles
from quillstone.operators.topk import first_rows, smallest
from quillstone.sources.scratch import materialised

NUMERIC = ("upvotes", "num_comments")


def valid_time(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint").between(*TIME_RANGE), F.lit(False))


def flagged(raw: DataFrame) -> DataFrame:
    """Rule flags of each raw row, so that one aggregate can count them all."""
    return raw.withColumns(
        {
            "no_key": F.col("label").isNull() | F.col("id").isNull(),
            "bad_time": ~valid_time(F.col("created_utc")),
            "title_removed": is_removed(F.col("title")),
            "body_removed": is_removed(F.col("body")),
        }
    )


def keep_first_id(df: DataFrame) -> DataFrame:
    """One row per id: the oldest, then by content, as a table has no file order."""
    return first_rows(df, [F.col("id")], ["created_utc", F.xxhash64("title", "body")])


def clean_texts(df: DataFrame, entities: bool = True) -> DataFrame:
    """Removed bodies blanked, title and body cleaned, has_* set afterwards, rows with neither dropped."""
    title, body = clean_text(F.col("title"), entities), F.when(is_removed(F.col("body")), "").otherwise(clean_text(F.col("body"), entities))
    # Made by a generator of one row, through which no filter is pushed: each text is cleaned once.
    df = df.select(*(c for c in df.columns if c not in ("title", "body")), F.inline(F.array(F.struct(title.alias("title"), body.alias("body")))))
    return df.withColumns({"has_title": F.length("title") > 0, "has_body": F.length("body") > 0}).where("has_title or has_body")


def numeric_caps(df: DataFrame, quantile: float = 0.995) -> DataFrame:
    """One row: the cap of each numeric column over repaired values, from ranges of values."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), _repaired(c).alias("x")) for c in NUMERIC))))
    caps = quantiles(counted(long, ["column"], "x"), ["column"], "x", {"cap": quantile})
    return caps.agg(*(F.max(F.when(F.col("column") == c, F.col("cap"))).alias(f"{c}_cap") for c in NUMERIC))


def _repaired(c: str) -> Column:
    return F.greatest(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0))


def repair_numbers(df: DataFrame, quantile: float = 0.995) -> DataFrame:
    """Null and negative to 0, capped at the quantile, truncated to bigint. ``df`` is read twice: give it materialised."""
    rows = df.crossJoin(F.broadcast(numeric_caps(df, quantile)))  # one row of caps
    return rows.withColumns({c: F.least(_repaired(c), F.col(f"{c}_cap")).cast("bigint") for c in NUMERIC}).drop(*(f"{c}_cap" for c in NUMERIC))


def normal_category(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit("nan"))))


def content_key(least: int = 40) -> Column:
    form = F.concat(dedup_form(F.col("title")), F.lit(" || "), dedup_form(F.col("body")))
    return F.when(F.length("body") >= least, content_hash(form, 16)).otherwise(F.concat(F.lit("id:"), F.col("id")))


def dedup_content(df: DataFrame, least: int = 40) -> DataFrame:
    """Of rows with equal title and body in normal form, the oldest by (created_utc, id); short bodies all stay.

    A short body is hashed with its id, so that one shuffle does for both kinds.
    """
    return first_rows(df, [content_key(least)], ["created_utc", "id"])


def clean_posts(raw: DataFrame, entities: bool = True) -> DataFrame:
    """Raw posts to the clean table. The cleaned texts are written once; caps and the rest are read from them."""
    df = flagged(raw).where("not no_key and not bad_time").drop("no_key", "bad_time", "title_removed", "body_removed")
    df = repair_numbers(materialised(clean_texts(keep_first_id(df), entities), "cleaned"))
    df = dedup_content(df.withColumn("subreddit", normal_category(F.col("subreddit"))))
    return df.select("id", "subreddit", "title", "body", "has_title", "has_body", "upvotes", "num_comments", F.col("created_utc").cast("bigint"), F.col("label").cast("tinyint"))


def audit(raw: DataFrame) -> DataFrame:
    """Rows that each rule touches, in one pass."""
    f = flagged(raw)
    return f.agg(
        F.count("*").alias("n_rows"),
        F.count_if("no_key").alias("no_key"),
        F.count_if("bad_time").alias("bad_time"),
        F.count_if("title_removed").alias("title_removed"),
        F.count_if("body_removed").alias("body_removed"),
        F.count_if(F.col("upvotes").isNull()).alias("upvotes_null"),
        F.count_if(F.col("num_comments") < 0).alias("comments_negative"),
    )


def audit_steps(raw: DataFrame, quantile: float = 0.995) -> DataFrame:
    """Rows that each step of clean_posts drops or caps, and the per cent that all drop together.

    Each step is a count: ids, cleaned texts and content keys are written once as a narrow table.
    """
    ok = flagged(raw).where("not no_key and not bad_time")
    unique = keep_first_id(ok.drop("no_key", "bad_time", "title_removed", "body_removed"))
    texts = clean_texts(unique.select("id", "title", "body", "created_utc", *NUMERIC))
    narrow = materialised(texts.select(content_key().alias("key"), *(_repaired(c).alias(c) for c in NUMERIC)), "audited")
    caps = narrow.crossJoin(F.broadcast(numeric_caps(narrow, quantile)))
    full = caps.agg(F.count("*").alias("n_full"), *(F.count_if(F.col(c) > F.col(f"{c}_cap")).alias(f"{c}_capped") for c in NUMERIC))
    kept = narrow.groupBy("key").agg(F.count("*").alias("n")).agg(F.count("*").alias("kept"))
    ids = ok.groupBy("id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_unique"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_ok"))
    one = raw.agg(F.count("*").alias("n_rows")).crossJoin(ids).crossJoin(full).crossJoin(kept)  # a row each
    n = F.col("n_rows")
    return one.select(
        "n_rows", (n - F.col("n_ok")).alias("no_key_or_time"), (F.col("n_ok") - F.col("n_unique")).alias("repeated_ids"), (F.col("n_unique") - F.col("n_full")).alias("both_empty"),
        (F.col("n_full") - F.col("kept")).alias("repeated_content"), "kept", F.try_divide((n - F.col("kept")) * 100.0, n).alias("pct_dropped"), *(f"{c}_capped" for c in NUMERIC),
    )


def text_and_label(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text and label alone (and ``keep``); the label may be called class."""
    label = "label" if "label" in df.columns else "class"
    return df.select(*keep, "text", F.col(label).alias("label"))


def binary_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label).isin(0, 1))


def duplicates_by_label(df: DataFrame, order: tuple[str, ...], text: str = "text") -> DataFrame:
    """Per label its rows, and those beyond the first of their text: all but as many as the label has first rows."""
    rows = df.where(F.col(text).isNotNull())
    first = rows.groupBy(F.md5(F.col(text).cast("binary")).alias("key")).agg(F.min_by(F.struct("label"), F.struct(*order)).alias("f"))
    counts = rows.groupBy("label").agg(F.count("*").alias("n_rows"), F.lit(0).cast("long").alias("n_first"))
    both = counts.unionByName(first.groupBy("f.label").agg(F.lit(0).cast("long").alias("n_rows"), F.count("*").alias("n_first")))
    return both.groupBy("label").agg(F.sum("n_rows").alias("n_rows"), (F.sum("n_rows") - F.sum("n_first")).alias("duplicates"))


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows beyond the first of their id, with their per cent; nulls count as equal."""
    n = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_ids"))
    extra = F.col("n_rows") - F.col("n_ids")
    return n.select(extra.alias("duplicates"), "n_rows", F.try_divide(extra * 100.0, "n_rows").alias("pct"))


def dedup_hash(body: Column, least: int = 40) -> Column:
    """The hash of a body in normal form; null for short ones."""
    return F.when(F.length(body) >= least, content_hash(dedup_form(body)))


def hash_groups(hashed: DataFrame) -> DataFrame:
    """hash and size of groups of rows with equal ``hash``."""
    return hashed.where("hash is not null").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_groups(df: DataFrame, least: int = 40) -> DataFrame:
    """hash and size of groups of equal bodies in normal form."""
    return hash_groups(df.select(dedup_hash(F.col("body"), least).alias("hash")))


def duplicate_pct(hashed: DataFrame) -> DataFrame:
    """One row: the per cent of all rows that repeat another's ``hash``."""
    extra = hash_groups(hashed).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))
    return extra.crossJoin(hashed.agg(F.count("*").alias("n_rows"))).select(F.try_divide(F.col("extra") * 100.0, "n_rows").alias("duplicate_pct"))  # a row each


def duplicate_report(df: DataFrame, least: int = 40, top: int = 10) -> DataFrame:
    """Groups of equal bodies: their number, rows beyond the first with their per cent of all rows, and the largest sizes."""
    groups = duplicate_groups(df, least)
    sizes = groups.orderBy(F.desc("n")).limit(top).agg(F.sort_array(F.collect_list("n"), asc=False).alias("biggest_sizes"))
    found = groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"), F.max("n").alias("biggest"))
    rows = df.agg(F.count("*").alias("n_rows"))
    return found.crossJoin(sizes).crossJoin(rows).select("n_groups", "extra_rows", "biggest", F.try_divide(F.col("extra_rows") * 100.0, "n_rows").alias("extra_pct"), "biggest_sizes")  # a row each


def duplicate_samples(df: DataFrame, groups: int = 20, rows: int = 3, least: int = 40) -> DataFrame:
    """The largest groups, a few rows of each, with a preview."""
    top = duplicate_groups(df, least).orderBy(F.desc("n"), "hash").limit(groups)
    hashed = df.where(F.length("body") >= least).select("id", F.substring("body", 1, 200).alias("preview"), content_hash(dedup_form(F.col("body"))).alias("hash"))
    return smallest(hashed.join(F.broadcast(top), "hash"), ["hash"], ["id"], rows).select("hash", "n", "place", "id", "preview")  # the limit bounds the broadcast


def dedup_exact(df: DataFrame, text: str = "text", order: tuple[str, ...] = ("id",)) -> DataFrame:
    return first_rows(df, [F.md5(F.col(text).cast("binary"))], list(order))
