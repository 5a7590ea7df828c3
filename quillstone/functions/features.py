"""Row-local features of a cleaned post. Words are extracted once, in a select of their own."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import lexicons as L
from quillstone.functions.text import count_in, has_stem, simple_words, strip, word_count

RATES = {
    "first_person_rate": "num_first_person", "negative_word_rate": "num_negative_words", "exclamation_rate": "num_exclamations", "question_rate": "num_questions",
    "caps_word_rate": "num_caps_words", "ellipsis_rate": "num_ellipsis", "absolutist_rate": "num_absolutist", "second_person_rate": "num_second_person",
}


def length_bucket(n: Column, edges: tuple[int, ...] = L.LENGTH_EDGES) -> Column:
    """0 for the first right-closed bin (up to edges[0]) and so on; the last is open-ended."""
    out = F.when(n <= edges[0], 0)
    for i, edge in enumerate(edges[1:], 1):
        out = out.when(n <= edge, i)
    return F.when(n.isNotNull(), out.otherwise(len(edges))).cast("tinyint")


def calendar(ts: Column) -> dict[str, Column]:
    """Cyclic and boolean calendar features of epoch seconds, in UTC."""
    at = F.timestamp_seconds(ts)
    hour, day = F.hour(at), F.weekday(at)
    turn = lambda x, n: F.lit(2 * math.pi) * x / n
    return {
        "hour_sin": F.sin(turn(hour, 24)).cast("float"), "hour_cos": F.cos(turn(hour, 24)).cast("float"),
        "dow_sin": F.sin(turn(day, 7)).cast("float"), "dow_cos": F.cos(turn(day, 7)).cast("float"),
        "is_weekend": day >= 5, "is_night_us_eastern": hour.between(4, 9),
    }


def meta_features(posts: DataFrame) -> DataFrame:
    """id, the 29 features and the label of cleaned posts (id, title, body, has_*, upvotes, num_comments, created_utc, label)."""
    both = strip(F.concat_ws(" ", "title", "body"))
    base = posts.withColumn("_text", both).withColumn("_words", simple_words(F.col("_text")))
    words, text = F.col("_words"), F.col("_text")
    n = F.size(words)
    title, body = F.length("title"), F.length("body")
    up, com = F.col("upvotes"), F.col("num_comments")
    return base.select(
        "id",
        title.alias("title_len_chars"),
        body.alias("body_len_chars"),
        (body / (title + 1)).cast("float").alias("body_to_title_ratio"),
        length_bucket(body).alias("body_length_bucket"),
        F.log1p(up).cast("float").alias("upvotes_log"),
        F.log1p(com).cast("float").alias("num_comments_log"),
        (com / (up + 1)).cast("float").alias("comments_per_upvote"),
        "has_title",
        "has_body",
        F.regexp_count(text, F.lit("!")).alias("num_exclamations"),
        F.regexp_count(text, F.lit(r"\?")).alias("num_questions"),
        F.regexp_count(text, F.lit(r"(?U)\b[A-Z]{2,}\b")).alias("num_caps_words"),
        F.regexp_count(text, F.lit(r"\.\.\.")).alias("num_ellipsis"),
        n.alias("num_words"),
        count_in(words, L.FIRST_PERSON).alias("num_first_person"),
        count_in(words, L.NEGATIVE_AFFECT).alias("num_negative_words"),
        count_in(words, L.ABSOLUTIST).alias("num_absolutist"),
        count_in(words, L.SECOND_PERSON).alias("num_second_person"),
        F.when(n == 0, 0.0).otherwise(F.size(F.array_distinct(words)) / n).cast("float").alias("type_token_ratio"),
        F.when(n == 0, 0.0).otherwise(F.length(F.array_join(words, "")) / n).cast("float").alias("avg_word_len"),
        F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1)).alias("num_sentences"),
        (F.regexp_count(text, F.lit("[A-Z]")) / (F.regexp_count(text, F.lit("[A-Za-z]")) + 1)).cast("float").alias("uppercase_ratio"),
        has_stem(text, L.KEYWORD_STEMS).alias("has_mh_keyword"),
        *(c.alias(k) for k, c in calendar(F.col("created_utc")).items()),
        F.col("label").cast("tinyint").alias("label"),
    )


def with_rates(features: DataFrame) -> DataFrame:
    """The eight per-word rates and the average sentence length."""
    per = F.greatest("num_words", F.lit(1))
    rates = {k: (F.col(c) / per).cast("float") for k, c in RATES.items()}
    return features.withColumns(rates | {"avg_sentence_len": (F.col("num_words") / F.greatest("num_sentences", F.lit(1))).cast("float")})


def word_feature(text: Column, most: int = 1000, weight: float = 0.1) -> Column:
    """The share of ``most`` words that a text has, 1 at the most, times ``weight``."""
    return F.least(word_count(text) / F.lit(most), F.lit(1.0)) * weight


def category_table(df: DataFrame, *more: str) -> DataFrame:
    """id and category of each row, kept beside the features for evaluation by category."""
    return df.select("id", "subreddit", *more)


def neutralise(features: DataFrame, url: Column, hosts: tuple[str, ...] = L.AUTHOR_TITLE_HOSTS, by_host: bool = False) -> DataFrame:
    """Fixed medians for features that mean something else out of the home domain, or lack a title.

    Host names are sought anywhere in the url, as the published scores were made: x.com also fits netflix.com and any
    path with it. ``by_host`` looks at the url's host and its domains alone.
    """
    names = "|".join(h.replace(".", r"\.") for h in hosts)
    away = F.lower(url).rlike(rf"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?(?:{names})(?:[:/?#]|$)" if by_host else names)
    untitled = F.col("title_len_chars") == 0
    out = {c: F.when(untitled, F.lit(L.NEUTRAL[c])).otherwise(F.col(c)) for c in ("title_len_chars", "body_to_title_ratio")}
    out |= {c: F.when(F.coalesce(away, F.lit(False)), F.lit(L.NEUTRAL[c])).otherwise(F.col(c)) for c in ("upvotes_log", "num_comments_log", "comments_per_upvote")}
    return features.withColumns(out)
