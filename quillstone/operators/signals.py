"""Text signals, distinctive terms and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import lexicons as L
from quillstone.functions.text import count_in, has_stem, is_english, simple_words, strip, word_count
from quillstone.operators.clean import dedup_hash, duplicate_pct
from quillstone.operators.profile import label_rate_by_year
from quillstone.operators.relations import information_columns, leaky_categories, ranked_information, weekday_hour_grid
from quillstone.operators.topk import smallest
from quillstone.sources.scratch import materialised

SIGNALS = ("has_keyword", "exclamations", "questions", "ellipses", "caps_words", "first_person_rate", "negation_rate", "negative_affect_rate")


def signals(posts: DataFrame, *more: Column) -> DataFrame:
    """id, label, ``more`` columns and the signals of title and body joined by a stop."""
    text = strip(F.concat(F.coalesce("title", F.lit("")), F.lit(" . "), F.coalesce("body", F.lit(""))))
    base = posts.select("id", "label", *more, text.alias("t"))
    kept = base.columns[:-1]
    base = base.withColumn("w", simple_words(F.col("t")))
    n = F.greatest(F.size("w"), F.lit(1))
    count = lambda p: F.regexp_count("t", F.lit(p))
    return base.select(
        *kept, has_stem(F.col("t"), L.KEYWORD_STEMS).cast("int").alias("has_keyword"), count("!").alias("exclamations"), count(r"\?").alias("questions"),
        count(r"\.\.\.").alias("ellipses"), count(r"(?U)\b[A-Z]{2,}\b").alias("caps_words"),
        *((count_in(F.col("w"), lex) / n).alias(k) for k, lex in (("first_person_rate", L.FIRST_PERSON), ("negation_rate", L.NEGATION), ("negative_affect_rate", L.NEGATIVE_AFFECT))),
    )


def signal_lift(signals_: DataFrame) -> DataFrame:
    """signal, its mean for label 0 and 1, and their ratio (null where label 0 has none)."""
    means = signals_.where("label is not null").select("label", F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("x")) for s in SIGNALS))).alias("s"))
    mean = lambda y: F.avg(F.when(F.col("label") == y, F.col("s.x")))
    out = means.groupBy(F.col("s.signal").alias("signal")).agg(mean(0).alias("mean_0"), mean(1).alias("mean_1"))
    return out.withColumn("lift", F.col("mean_1") / F.nullif("mean_0", F.lit(0.0)))


def term_counts(df: DataFrame, group: str, text: str, bigrams: bool = False, stop_words: tuple[str, ...] = L.ENGLISH_STOP_WORDS) -> DataFrame:
    """(group, term, n) of words over two characters outside the stop list, or of pairs of neighbours among them."""
    stops = F.array(*(F.lit(w) for w in stop_words))
    words = F.filter(simple_words(F.col(text)), lambda w: ~F.array_contains(stops, w) & (F.length(w) > 2))
    rows = df.where(F.col(group).isNotNull()).select(group, words.alias("w"))
    if bigrams:
        n = F.greatest(F.size("w") - 1, F.lit(0))
        rows = rows.select(group, F.zip_with(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n), lambda a, b: F.concat_ws("_", a, b)).alias("w"))
    return rows.select(group, F.explode("w").alias("term")).groupBy(group, "term").agg(F.count("*").alias("n"))


def distinctive_terms(counts: DataFrame, group: str, a, b, alpha: float = 0.01, min_frequency: int = 25, top: int = 60) -> DataFrame:
    """Terms that set group ``a`` apart from ``b``: z-scores of smoothed log-odds."""
    wide = counts.groupBy("term").agg(F.sum(F.when(F.col(group) == a, F.col("n")).otherwise(0)).alias("n_a"), F.sum(F.when(F.col(group) == b, F.col("n")).otherwise(0)).alias("n_b")).where("n_a + n_b > 0")
    totals = wide.agg(F.sum("n_a").alias("ta"), F.sum("n_b").alias("tb"), F.count("*").alias("v"))
    wide = wide.withColumns({k: totals.select(k).scalar() for k in ("ta", "tb", "v")}).where(F.col("n_a") + F.col("n_b") >= min_frequency)
    xa, xb = F.col("n_a") + alpha, F.col("n_b") + alpha
    odds = lambda x, t: F.log(x / (F.col(t) + alpha * F.col("v") - x))
    z = (odds(xa, "ta") - odds(xb, "tb")) / F.sqrt(1 / xa + 1 / xb)
    return wide.select("term", z.alias("z"), "n_a", "n_b").orderBy(F.desc("z"), "term").limit(top)


def noise(posts: DataFrame) -> DataFrame:
    """Counts of noisy bodies, in one pass."""
    t = F.coalesce("body", F.lit(""))
    n = F.length(t)
    url_only = (n > 0) & (F.regexp_count(t, F.lit("[a-zA-Z]{2,}")) <= 2) & (F.regexp_count(t, F.lit(r"(?U)https?://\S+|www\.\S+")) >= 1)
    symbols = (n > 10) & (F.regexp_count(t, F.lit(r"(?U)[^\w\s.,!?'\"-]")) / n > 0.5)
    same = F.lower(strip(F.coalesce("title", F.lit("")))) == F.lower(strip(t))
    return posts.agg(
        F.count("*").alias("n_rows"), F.count_if(url_only).alias("url_only"), F.count_if(symbols).alias("symbol_heavy"), F.count_if(n > 20000).alias("very_long"),
        F.count_if((n > 0) & (n < 5)).alias("very_short"), F.count_if(same).alias("title_is_body"), F.count_if(n == 0).alias("empty_body"),
    )


def language_share(posts: DataFrame, text: str = "body") -> DataFrame:
    return posts.where(F.col(text).isNotNull()).groupBy(F.when(is_english(F.col(text)), "en").otherwise("non-en").alias("language")).agg(F.count("*").alias("n"))


def extreme_positives(posts: DataFrame, k: int = 25, least: int = 5) -> DataFrame:
    """The k longest and the k shortest (over ``least`` characters) positive bodies."""
    rows = posts.where((F.col("label") == 1) & F.col("body").isNotNull()).select("id", F.length("body").alias("n_chars"))
    longest = rows.orderBy(F.desc("n_chars"), "id").limit(k).withColumn("kind", F.lit("longest"))
    return longest.unionByName(rows.where(F.col("n_chars") > least).orderBy("n_chars", "id").limit(k).withColumn("kind", F.lit("shortest")))


def label_mismatches(posts: DataFrame, k: int = 25) -> DataFrame:
    """Positives without a keyword and negatives with one, k of each by hash order."""
    text = F.concat_ws(" ", "title", "body")
    found = posts.where("label is not null").withColumn("hit", has_stem(text, L.SAMPLE_KEYWORD_STEMS)).where((F.col("label") == 1) != F.col("hit"))
    return smallest(found.select("label", "id"), ["label"], [F.md5("id"), F.col("id")], k).select("label", "place", "id")


# Fixed values: (chain, severity, metric, from, more than, to, less than, text). A rule fires where its metric is known, at
# least ``from``, over ``more than``, at most ``to`` and under ``less than``; of a chain's rules the first that fires.
INSIGHT_RULES = (
    ("language", "CRITICAL", "english_pct", None, None, None, 90.0, "few texts are English: filter before training"),
    ("language", "WARNING", "english_pct", None, None, None, 98.0, "some texts are not English"),
    ("language", "GOOD", "english_pct", 98.0, None, None, None, "almost all texts are English"),
    ("duplicates", "GOOD", "duplicate_pct", None, None, 1.0, None, "few duplicates"),
    ("duplicates", "WARNING", "duplicate_pct", None, 1.0, None, 5.0, "duplicates: drop them before splitting"),
    ("duplicates", "CRITICAL", "duplicate_pct", 5.0, None, None, None, "many duplicates: drop them before splitting"),
    ("leakage", "WARNING", "n_leaky", None, 0.0, None, None, "categories that give the label away"),
    ("balance", "CRITICAL", "minority_pct", None, None, None, 10.0, "severe class imbalance"),
    ("balance", "WARNING", "minority_pct", None, None, None, 30.0, "moderate class imbalance"),
    ("balance", "GOOD", "minority_pct", 30.0, None, None, None, "classes are balanced"),
    ("coverage", "GOOD", "coverage_256", 95.0, None, None, None, "256 tokens cover almost all texts"),
    ("coverage", "INFO", "coverage_384", 95.0, None, None, None, "384 tokens cover almost all texts, 256 do not"),
    ("coverage", "WARNING", "coverage_512", 95.0, None, None, None, "512 tokens, or head and tail, are needed"),
    ("coverage", "WARNING", "coverage_256", None, None, None, None, "512 tokens miss many texts: split long ones"),
    ("keyword", "GOOD", "keyword_lift", 2.0, None, None, None, "strong text signal"),
    ("keyword", "INFO", "keyword_lift", 1.3, None, None, None, "moderate text signal"),
    ("keyword", "WARNING", "keyword_lift", None, None, None, 1.3, "weak text signal"),
    ("first person", "INFO", "first_person_lift", 1.2, None, None, None, "first person is more frequent among positives"),
    ("drift", "WARNING", "label_drift", None, 0.10, None, None, "the label rate drifts: split by time"),
    ("information", "INFO", "best_feature_bits", None, None, None, None, "the column that tells most about the label"),
    ("calendar", "INFO", "grid_range", None, 0.05, None, None, "calendar features carry signal"),
    ("links", "INFO", "url_only", None, 5000.0, None, None, "many posts are only a link"),
)
SEVERITIES = ("CRITICAL", "WARNING", "INFO", "GOOD")


def insights(metrics: DataFrame) -> DataFrame:
    """(severity, chain, metric, key, value, text) of the rules that fire over rows (metric, key, value), the gravest first.

    The rules are a fixed list of some twenty rows, the side that is broadcast.
    """
    metrics = metrics if "key" in metrics.columns else metrics.withColumn("key", F.lit(""))
    names = ("from_", "over", "upto", "under")
    rows = [F.struct(F.lit(i).alias("place"), F.lit(SEVERITIES.index(s)).alias("rank"), F.lit(c).alias("chain"), F.lit(s).alias("severity"), F.lit(m).alias("metric"), *(F.lit(v).cast("double").alias(k) for k, v in zip(names, limits, strict=True)), F.lit(t).alias("text")) for i, (c, s, m, *limits, t) in enumerate(INSIGHT_RULES)]
    rules = metrics.sparkSession.range(1).select(F.inline(F.array(*rows)))
    v = F.col("value")
    fires = v.isNotNull() & F.coalesce(v >= F.col("from_"), F.lit(True)) & F.coalesce(v > F.col("over"), F.lit(True)) & F.coalesce(v <= F.col("upto"), F.lit(True)) & F.coalesce(v < F.col("under"), F.lit(True))
    fired = metrics.join(F.broadcast(rules), "metric").where(fires)
    first = fired.groupBy("chain").agg(F.min_by(F.struct("rank", "place", "severity", "metric", "key", "value", "text"), "place").alias("f"))
    return first.select("chain", "f.*").orderBy("rank", "place").select("severity", "chain", "metric", "key", "value", "text")


def profile_metrics(posts: DataFrame, leaky: int = 1000, yearly: int = 100, cell: int = 50) -> DataFrame:
    """(section, metric, key, value): what the insight rules ask of a table of posts.

    Texts are read once: what any metric asks of them goes to a written table of short columns.
    """
    body = F.coalesce("body", F.lit(""))
    words = word_count(F.coalesce("title", F.lit(""))) + word_count(body)
    url_only = (F.length(body) > 0) & (F.regexp_count(body, F.lit("[a-zA-Z]{2,}")) <= 2) & (F.regexp_count(body, F.lit(r"(?U)https?://\S+|www\.\S+")) >= 1)
    facts = signals(
        posts, F.col("subreddit"), F.col("created_utc"), is_english(F.col("body")).alias("english"), F.col("body").isNotNull().alias("known"),
        url_only.alias("url_only"), words.alias("n_words"), dedup_hash(F.col("body")).alias("hash"), *information_columns(),
    )
    rows = materialised(facts, "profile")
    n = F.count("*")
    wide = rows.agg(
        F.try_divide(F.count_if("english") * 100.0, F.count_if("known")).alias("quality.english_pct"), F.count_if("url_only").cast("double").alias("quality.url_only"),
        F.try_divide(F.least(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)) * 100.0, F.count("label")).alias("basic.minority_pct"),
        *(F.try_divide(F.count_if(F.col("n_words") <= size) * 100.0, n).alias(f"text.coverage_{size}") for size in (256, 384, 512)),
    )

    def long(df: DataFrame, **columns: str) -> DataFrame:
        """Columns of a table of one row as metrics; names as metric=section.column."""
        return df.select(F.inline(F.array(*(F.struct(F.lit(c.split(".")[0]).alias("section"), F.lit(m).alias("metric"), F.lit("").alias("key"), F.col(f"`{m if m in df.columns else c}`").cast("double").alias("value")) for m, c in columns.items()))))

    out = long(wide, **{c.split(".")[1]: c for c in wide.columns})
    lifts = signal_lift(rows).agg(*(F.max(F.when(F.col("signal") == s, F.col("lift"))).alias(k) for s, k in (("has_keyword", "keyword_lift"), ("first_person_rate", "first_person_lift"))))
    out = out.unionByName(long(lifts, keyword_lift="text_signals.keyword_lift", first_person_lift="text_signals.first_person_lift"))
    out = out.unionByName(long(duplicate_pct(rows), duplicate_pct="quality.duplicate_pct"))
    leaks = leaky_categories(rows, "subreddit", leaky).agg(F.coalesce(F.max("n_leaky"), F.lit(0)).alias("n_leaky"))
    out = out.unionByName(long(leaks, n_leaky="relations.n_leaky"))
    out = out.unionByName(long(label_rate_by_year(rows, yearly).agg(F.max("drift").alias("label_drift")), label_drift="temporal.label_drift"))
    out = out.unionByName(long(weekday_hour_grid(rows, least=cell).agg(F.max("range").alias("grid_range")), grid_range="interactions.grid_range"))
    best = ranked_information(rows).where("place = 1").select(F.lit("interactions").alias("section"), F.lit("best_feature_bits").alias("metric"), F.col("feature").alias("key"), F.col("mutual_information").alias("value"))
    return out.unionByName(best)
