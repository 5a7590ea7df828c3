"""Registered queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.features import category_table, length_bucket, meta_features, neutralise, with_rates, word_feature
from quillstone.functions import lexicons
from quillstone.functions.text import clean_text, clean_text_simple, has_stem, preview, simple_words, word_count
from quillstone.operators import assemble, calibrate, clean, evaluate, extract, profile, relations, signals, splits, tokens
from quillstone.sources.files import read_table, write_metrics
from quillstone.sources.posts import POSTS_SQL, SCORES_SQL, posts, scores, table
from quillstone.sources.scratch import materialised, scratch_dir
from quillstone.streaming.score import distinct_stream, linear_score, score

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles and floats rounded, so that sums in another order compare equal."""
    return df.select(*(F.round(F.col(c).cast("double"), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+', ''), '[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+$', '')"


def sql_strip(x: str) -> str:
    return STRIP.format(x)


def sql_clean(x: str) -> str:
    """The cleaning chain but for entities, in RE2, which has no lookbehind: a mention keeps the space before it."""
    steps = (
        (r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}]", "", "g"), (r"\[([^\]]+)\]\(\s*https?://[^\)]+\)", r"\1", "g"), (r"\[([^\]]+)\]\[\d+\]", r"\1", "g"),
        (r"https?://\S+|www\.\S+", " [URL] ", "g"), (r"(^|\s)/?u/[A-Za-z0-9_\-]+", r"\1 [USER] ", "gi"), (r"(^|\s)/?r/[A-Za-z0-9_\-]+", r"\1 [SUB] ", "gi"),
        (r"\*+([^*\n]+?)\*+", r"\1", "g"), (r"~~([^~\n]+?)~~", r"\1", "g"), (r"`([^`\n]+?)`", r"\1", "g"), (r"(?m)^#{1,6}\s*", "", "g"), (r"(?m)^>+\s?", "", "g"),
        (r"(?m)^[-*_]{3,}\s*$", "", "g"), (r"&\w+;", " ", "g"), (r"\n{3,}", "\n\n", "g"), (r"[ \t]{2,}", " ", "g"),
    )
    out = f"coalesce({x}, '')"
    for pattern, replacement, flags in steps:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', '{flags}')"
    return sql_strip(out)


def sql_removed(x: str) -> str:
    marks = ", ".join(f"'{m}'" for m in clean.is_removed.__defaults__[0])
    return f"(lower({sql_strip(f'coalesce({x}, chr(32))')}) IN ({marks}))"


def sql_form(x: str) -> str:
    return sql_strip(rf"regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g')")


CLEAN_SQL = f"""{POSTS_SQL},
valid AS (SELECT * FROM posts WHERE label IS NOT NULL AND id IS NOT NULL AND created_utc BETWEEN 1104537600 AND 1893456000),
texts AS (
  SELECT id, lower({sql_strip("subreddit")}) AS subreddit, {sql_clean("title")} AS title, CASE WHEN {sql_removed("body")} THEN '' ELSE {sql_clean("body")} END AS body,
    greatest(coalesce(upvotes, 0), 0)::double AS up, greatest(coalesce(num_comments, 0), 0)::double AS com, created_utc, label FROM valid),
nonempty AS (SELECT * FROM texts WHERE title <> '' OR body <> ''),
caps AS (SELECT quantile_cont(up, 0.995) AS up_cap, quantile_cont(com, 0.995) AS com_cap FROM nonempty),
keyed AS (
  SELECT *, CASE WHEN length(body) >= 40 THEN substring(md5({sql_form("title")} || ' || ' || {sql_form("body")}), 1, 16) ELSE 'id:' || id END AS k FROM nonempty),
clean AS (
  SELECT id, subreddit, title, body, title <> '' AS has_title, body <> '' AS has_body, trunc(least(up, up_cap))::bigint AS upvotes, trunc(least(com, com_cap))::bigint AS num_comments,
    created_utc, label FROM keyed, caps QUALIFY row_number() OVER (PARTITION BY k ORDER BY created_utc, id) = 1)"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_posts(posts(spark, sf_dir))


@register("clean_label_rate", f"WITH {CLEAN_SQL} SELECT subreddit, count(label) AS n, sum(label)::bigint AS n_positive, round(avg(label), 9) AS rate FROM clean GROUP BY 1")
def clean_label_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.label_rate_by(cleaned(spark, sf_dir), "subreddit"))


@register("clean_posts", f"WITH {CLEAN_SQL} SELECT id, subreddit, md5(title) AS title, md5(body) AS body, has_title, has_body, upvotes, num_comments, created_utc, label FROM clean")
def clean_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).withColumns({"title": F.md5("title"), "body": F.md5("body"), "label": F.col("label").cast("int")})


@register("clean_text_all", f"WITH {POSTS_SQL} SELECT id, {sql_clean('title')} AS title, {sql_clean('body')} AS body FROM posts")
def clean_text_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).select("id", clean_text(F.col("title")).alias("title"), clean_text(F.col("body")).alias("body"))


@register("row_audit", f"""WITH {POSTS_SQL} SELECT count(*) AS n_rows, count_if(label IS NULL OR id IS NULL) AS no_key, count_if(NOT coalesce(created_utc BETWEEN 1104537600 AND 1893456000, false)) AS bad_time,
  count_if({sql_removed('title')}) AS title_removed, count_if({sql_removed('body')}) AS body_removed, count_if(upvotes IS NULL) AS upvotes_null, count_if(num_comments < 0) AS comments_negative FROM posts""")
def row_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.audit(posts(spark, sf_dir))


@register("duplicate_ids", "SELECT count(*) - count(DISTINCT l_orderkey) AS duplicates, count(*) AS n_rows, round((count(*) - count(DISTINCT l_orderkey)) * 100.0 / count(*), 9) AS pct FROM lineitem")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.duplicate_ids(table(spark, sf_dir, "lineitem"), "l_orderkey"))


DUP_SQL = f"WITH {POSTS_SQL}, g AS (SELECT md5({sql_form('body')}) AS hash, count(*) AS n FROM posts WHERE length(body) >= 40 GROUP BY 1 HAVING count(*) > 1)"


@register("duplicate_report", f"""{DUP_SQL} SELECT count(*) AS n_groups, coalesce(sum(n - 1), 0)::bigint AS extra_rows, max(n) AS biggest, round(coalesce(sum(n - 1), 0) * 100.0 / (SELECT count(*) FROM posts), 9) AS extra_pct,
 coalesce((SELECT string_agg(n::varchar, ',' ORDER BY n DESC) FROM (SELECT n FROM g ORDER BY n DESC LIMIT 10)), '') AS biggest_sizes FROM g""")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.duplicate_report(posts(spark, sf_dir)).withColumn("biggest_sizes", F.array_join(F.col("biggest_sizes").cast("array<string>"), ",")))


@register("duplicate_samples", f"""{DUP_SQL}, top AS (SELECT * FROM g ORDER BY n DESC, hash LIMIT 20)
SELECT hash, n, row_number() OVER (PARTITION BY hash ORDER BY id) AS place, id, substring(body, 1, 200) AS preview FROM (SELECT *, md5({sql_form('body')}) AS hash FROM posts WHERE length(body) >= 40) JOIN top USING (hash)
QUALIFY place <= 3""")
def duplicate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.duplicate_samples(posts(spark, sf_dir))


@register("dedup_exact", "SELECT min(doc_id) AS doc_id, md5(text) AS text FROM documents GROUP BY 2")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.dedup_exact(table(spark, sf_dir, "documents"), "text", ("doc_id",)).select("doc_id", F.md5("text").alias("text"))


TIME_SPLIT = "CASE WHEN year(to_timestamp(created_utc) AT TIME ZONE 'UTC') <= 2020 THEN 'train' WHEN year(to_timestamp(created_utc) AT TIME ZONE 'UTC') = 2021 THEN 'val' WHEN year(to_timestamp(created_utc) AT TIME ZONE 'UTC') = 2022 THEN 'test' ELSE 'unknown' END"


@register("time_split_report", f"WITH {POSTS_SQL} SELECT {TIME_SPLIT} AS time_split, count(*) AS n, round(avg(label), 9) AS label_rate FROM posts GROUP BY 1")
def time_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(splits.split_report(posts(spark, sf_dir).withColumn("time_split", splits.time_split(F.col("created_utc")))))


def ranked_sql(seed: int, by: str = "label", extra: str = "") -> str:
    return f"""WITH {POSTS_SQL}, r AS (SELECT id, label{extra}, row_number() OVER (PARTITION BY {by} ORDER BY md5('{seed}:' || id), id) - 1 AS rank, count(*) OVER (PARTITION BY {by}) AS n FROM posts)"""


@register("random_split", f"{ranked_sql(42)} SELECT id, label, CASE WHEN rank < floor(n * 0.1 + 0.5) THEN 'val' WHEN rank < floor(n * 0.1 + 0.5) + floor(n * 0.1 + 0.5) THEN 'test' ELSE 'train' END AS random_split FROM r")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(posts(spark, sf_dir).select("id", "label"), {"val": 0.1, "test": 0.1})


@register("folds", f"""{ranked_sql(2024, f"label, ({TIME_SPLIT} = 'train')", f", ({TIME_SPLIT} = 'train') AS t")} SELECT id, label, CASE WHEN t THEN (rank % 3)::tinyint ELSE (-1)::tinyint END AS fold FROM r""")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = posts(spark, sf_dir).select("id", "label", splits.time_split(F.col("created_utc")).alias("time_split"))
    return splits.stratified_folds(df, 3, 2024, F.col("time_split") == "train").drop("time_split")


@register("sample_per_class", f"{ranked_sql(42)} SELECT id, label FROM r WHERE rank < 25")
def sample_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sample_per_class(posts(spark, sf_dir).select("id", "label"), 25)


@register("undersampled", f"{ranked_sql(45)} SELECT id, label FROM r WHERE label = 1 OR (label = 0 AND rank < floor(n * 0.5))")
def undersampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.undersample_negatives(posts(spark, sf_dir).select("id", "label").where("label is not null"), 0.5, 45)


@register("sample_n", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 500")
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sample_n(table(spark, sf_dir, "documents").select("doc_id"), 500, key="doc_id")


@register("class_weights", "SELECT (count(quality) - sum(quality)) / sum(quality) AS pos_weight, count(quality) / (2 * (count(quality) - sum(quality))) AS weight_0, count(quality) / (2 * sum(quality)) AS weight_1 FROM labels")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.class_weights(table(spark, sf_dir, "labels").select(F.col("quality").alias("label")))


WORDS_SQL = "regexp_extract_all(lower({0}), '[a-zA-Z'']+')"
LEX = {"num_first_person": "FIRST_PERSON", "num_negative_words": "NEGATIVE_AFFECT", "num_absolutist": "ABSOLUTIST", "num_second_person": "SECOND_PERSON"}


def _count_sql(pattern: str, x: str = "t") -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _lex_sql(name: str) -> str:
    from quillstone.functions import lexicons

    words = ", ".join(f"'{w}'" for w in getattr(lexicons, name))
    return f"len(list_filter(w, lambda x: x IN ({words})))"


def _stem_sql(x: str, name: str = "KEYWORD_STEMS") -> str:
    from quillstone.functions import lexicons

    return f"regexp_matches(lower({x}), '{'|'.join(getattr(lexicons, name))}')"


# RE2's word boundary is ASCII: other letters are mapped to an ASCII one before capitals are counted.
CAPS_SQL = r"len(regexp_extract_all(regexp_replace(t, '[À-ÖØ-öø-ɏ]', 'z', 'g'), '\b[A-Z]{2,}\b'))"
BUCKET_SQL = "CASE WHEN {0} <= 0 THEN 0 WHEN {0} <= 50 THEN 1 WHEN {0} <= 200 THEN 2 WHEN {0} <= 500 THEN 3 WHEN {0} <= 1000 THEN 4 WHEN {0} <= 2000 THEN 5 WHEN {0} <= 5000 THEN 6 ELSE 7 END"
FEATURES_SQL = f"""{CLEAN_SQL},
base AS (SELECT *, {sql_strip("title || ' ' || body")} AS t FROM clean), words AS (SELECT *, {WORDS_SQL.format('t')} AS w, to_timestamp(created_utc) AT TIME ZONE 'UTC' AS ts FROM base),
feats AS (
SELECT id, length(title) AS title_len_chars, length(body) AS body_len_chars, length(body) / (length(title) + 1) AS body_to_title_ratio, {BUCKET_SQL.format('length(body)')} AS body_length_bucket,
  ln(1 + upvotes) AS upvotes_log, ln(1 + num_comments) AS num_comments_log, num_comments / (upvotes + 1) AS comments_per_upvote, has_title, has_body,
  {_count_sql('!')} AS num_exclamations, {_count_sql(chr(92) + '?')} AS num_questions, {CAPS_SQL} AS num_caps_words, {_count_sql(chr(92) + '.' + chr(92) + '.' + chr(92) + '.')} AS num_ellipsis, len(w) AS num_words,
  {', '.join(f'{_lex_sql(v)} AS {k}' for k, v in LEX.items())},
  CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(w)) / len(w) END AS type_token_ratio, CASE WHEN len(w) = 0 THEN 0 ELSE length(array_to_string(w, '')) / len(w) END AS avg_word_len,
  greatest({_count_sql('[.!?]+')}, 1) AS num_sentences, {_count_sql('[A-Z]')} / ({_count_sql('[A-Za-z]')} + 1) AS uppercase_ratio, {_stem_sql('t')} AS has_mh_keyword,
  sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos, sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos,
  isodow(ts) >= 6 AS is_weekend, hour(ts) BETWEEN 4 AND 9 AS is_night_us_eastern, label FROM words)"""
FEATURE_COLUMNS = (
    "body_to_title_ratio upvotes_log num_comments_log comments_per_upvote type_token_ratio avg_word_len uppercase_ratio hour_sin hour_cos dow_sin dow_cos"
).split()
INTEGER_FEATURES = (
    "title_len_chars body_len_chars body_length_bucket num_exclamations num_questions num_caps_words num_ellipsis num_words num_first_person num_negative_words num_absolutist num_second_person num_sentences label"
).split()
BOOLEAN_FEATURES = "has_title has_body has_mh_keyword is_weekend is_night_us_eastern".split()


@register("meta_features", f"WITH {FEATURES_SQL} SELECT id, {', '.join(f'{c}::bigint AS {c}' for c in INTEGER_FEATURES)}, {', '.join(BOOLEAN_FEATURES)}, {', '.join(f'round({c}::float::double, 4) + 0 AS {c}' for c in FEATURE_COLUMNS)} FROM feats")
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = meta_features(cleaned(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("bigint") for c in INTEGER_FEATURES} | {c: F.round(F.col(c).cast("double"), 4) + 0 for c in FEATURE_COLUMNS})


@register("feature_summary", f"WITH {FEATURES_SQL} SELECT count(*) AS n_rows, round(avg(has_mh_keyword::int) * 100, 6) AS keyword_pct, round(avg(has_body::int) * 100, 6) AS body_pct, sum(num_words)::bigint AS num_words FROM feats")
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = with_rates(meta_features(cleaned(spark, sf_dir)))
    pct = lambda c: F.round(F.avg(F.col(c).cast("int")) * 100, 6)
    return f.agg(F.count("*").alias("n_rows"), pct("has_mh_keyword").alias("keyword_pct"), pct("has_body").alias("body_pct"), F.sum("num_words").alias("num_words"))


@register("word_length_filter", r"""SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), '\s+')) END AS n_words FROM documents WHERE len(regexp_split_to_array(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), '\s+')) >= 5""")
def word_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("n_words")).where("n_words >= 5")


@register("vocabulary", f"""WITH t AS (SELECT unnest({WORDS_SQL.format('text')}) AS term FROM documents), c AS (SELECT term, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 2),
b AS (SELECT term, n, (row_number() OVER (ORDER BY n DESC, term) + 3)::int AS term_id FROM c ORDER BY n DESC, term LIMIT 4996)
SELECT * FROM b UNION ALL SELECT * FROM (VALUES ('[PAD]', 0, 0), ('[UNK]', 0, 1), ('[CLS]', 0, 2), ('[SEP]', 0, 3))""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.vocabulary(table(spark, sf_dir, "documents").select(simple_words(F.col("text")).alias("w")), "w", 5000).select("term", "n", F.col("term_id").cast("int"))


@register("head_tail", f"""WITH {POSTS_SQL}, w AS (SELECT id, {WORDS_SQL.format('title')}[1:62] AS a, {WORDS_SQL.format('body')} AS b FROM posts WHERE body IS NOT NULL),
k AS (SELECT *, 124 - len(a) AS room, greatest(1, floor((124 - len(a) - 1) * 0.35))::int AS h FROM w),
c AS (SELECT id, a, CASE WHEN len(b) <= room THEN b ELSE list_concat(list_concat(b[1:h], ['...']), b[len(b) - (room - 1 - h) + 1:]) END AS b FROM k)
SELECT id, len(a) + len(b) + 4 AS n, md5(array_to_string(list_concat(list_concat(list_concat(['<s>'], a), ['</s>', '</s>']), list_concat(b, ['</s>'])), ' ')) AS seq FROM c""")
def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir).where("body is not null").select("id", simple_words(F.col("title")).alias("a"), simple_words(F.col("body")).alias("b"))
    return p.select("id", tokens.head_tail(F.col("a"), F.col("b"), 128).alias("s")).select("id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", " ")).alias("seq"))


@register("token_coverage", f"SELECT {', '.join(f'round(avg((len({WORDS_SQL.format(chr(116) + chr(101) + chr(120) + chr(116))}) <= {t})::int * 100), 9) AS coverage_{t}' for t in (128, 256, 384, 512))} FROM documents")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tokens.coverage(table(spark, sf_dir, "documents").select(F.size(simple_words(F.col("text"))).alias("n")), "n"))


LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _summary_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max, skewness(x) AS skewness, count_if(x < 0) AS n_negative, count_if(x = 0) AS n_zero,
  {', '.join(f'quantile_cont(x, {q}) AS {k}' for k, q in profile.QUANTILES.items())} FROM (SELECT {c}::double AS x FROM lineitem)"""


@register("numeric_summary", f"""SELECT "column", n, n_negative, n_zero, {', '.join(f'round({c}, 5) AS {c}' for c in ('mean', 'std', 'min', 'max', 'skewness', *profile.QUANTILES))} FROM ({' UNION ALL '.join(map(_summary_sql, LINE_COLUMNS))})""")
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.numeric_summary(table(spark, sf_dir, "lineitem"), list(LINE_COLUMNS)), 5)


def _words_sql(x: str) -> str:
    return rf"CASE WHEN {sql_strip(x)} = '' THEN 0 ELSE len(regexp_split_to_array({sql_strip(x)}, '[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+')) END"


def _described_sql(rows: str, columns: tuple[str, ...], by: str = "") -> str:
    """numeric_summary in SQL over ``rows``, with the group columns ``by``."""
    one = """SELECT {by}'{c}' AS "column", count(x) AS n, count_if(x < 0) AS n_negative, count_if(x = 0) AS n_zero, round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS std, round(min(x), 5) AS min, round(max(x), 5) AS max, round(skewness(x), 5) AS skewness, {q} FROM (SELECT {by}{c}::double AS x FROM {rows}) {group}"""
    q = ", ".join(f"round(quantile_cont(x, {v}), 5) AS {k}" for k, v in profile.QUANTILES.items())
    return " UNION ALL ".join(one.format(by=f"{by}, " if by else "", c=c, q=q, rows=rows, group=f"GROUP BY {by}" if by else "") for c in columns)


LENGTHS = ("title_chars", "body_chars", "title_words", "body_words", "pair_words")


@register("length_summary", f"""WITH {POSTS_SQL}, l AS (SELECT length(coalesce(title, '')) AS title_chars, length(coalesce(body, '')) AS body_chars, {_words_sql("coalesce(title, '')")} AS title_words, {_words_sql("coalesce(body, '')")} AS body_words, title_words + body_words AS pair_words FROM posts)
{_described_sql("l", LENGTHS)}""")
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.numeric_summary(profile.lengths(posts(spark, sf_dir)), list(LENGTHS)), 5)


@register("engagement_ratio", f"""WITH {POSTS_SQL}, r AS (SELECT num_comments / (upvotes + 1)::double AS ratio, 'all' AS part FROM posts UNION ALL SELECT num_comments / (upvotes + 1)::double, label::varchar FROM posts WHERE label IS NOT NULL)
{_described_sql("r", ("ratio",), "part")}""")
def engagement_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.engagement_ratio(posts(spark, sf_dir)), 5)


@register("emptiness", f"""WITH {POSTS_SQL} SELECT count(*) AS n_rows, count_if({sql_removed('body')}) AS body_removed, count_if({sql_strip("coalesce(title, '')")} = '') AS title_empty,
 round(count_if({sql_removed('body')}) * 100.0 / count(*), 9) AS body_removed_pct, round(count_if({sql_strip("coalesce(title, '')")} = '') * 100.0 / count(*), 9) AS title_empty_pct FROM posts""")
def emptiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.emptiness(posts(spark, sf_dir)))


@register("length_feature", f"WITH {POSTS_SQL}, w AS (SELECT id, subreddit, {_words_sql("coalesce(body, '')")} AS n FROM posts) SELECT id, subreddit, round(least(n / 1000, 1) * 0.1, 9) AS length_feat FROM w")
def length_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(category_table(posts(spark, sf_dir).withColumn("length_feat", word_feature(F.col("body"))), "length_feat"))


@register("duplicates_by_label", "WITH t AS (SELECT d.doc_id, d.text, l.quality AS label, row_number() OVER (PARTITION BY d.text ORDER BY d.doc_id) AS n FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IN (0, 1) AND d.text IS NOT NULL) SELECT label, count(*) AS n_rows, count_if(n > 1) AS duplicates FROM t GROUP BY 1")
def duplicates_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older table's loader: a column class for the label, binary labels alone, copies counted per label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("class"))
    older = clean.text_and_label(assemble.with_labels(table(spark, sf_dir, "documents"), labels, "doc_id"), ("doc_id",))
    return clean.duplicates_by_label(clean.binary_labels(older), ("doc_id",))


@register("audit_steps", f"""WITH {CLEAN_SQL} SELECT (SELECT count(*) FROM posts) AS n_rows, (SELECT count(*) FROM posts) - (SELECT count(*) FROM valid) AS no_key_or_time, (SELECT count(*) - count(DISTINCT id) FROM valid) AS repeated_ids,
 (SELECT count(*) FROM valid) - (SELECT count(*) FROM nonempty) - (SELECT count(*) - count(DISTINCT id) FROM valid) AS both_empty, (SELECT count(*) FROM nonempty) - (SELECT count(*) FROM clean) AS repeated_content, (SELECT count(*) FROM clean) AS kept,
 (SELECT count_if(up > up_cap) FROM nonempty, caps) AS upvotes_capped, (SELECT count_if(com > com_cap) FROM nonempty, caps) AS num_comments_capped, round(((SELECT count(*) FROM posts) - (SELECT count(*) FROM clean)) * 100.0 / (SELECT count(*) FROM posts), 9) AS pct_dropped""")
def audit_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.audit_steps(posts(spark, sf_dir)))


@register("missing_values", f"""WITH {POSTS_SQL} SELECT "column", n_missing, round(n_missing * 100.0 / n, 9) AS pct FROM (SELECT count(*) AS n, {', '.join(f'count(*) - count({c}) AS {c}' for c in ('upvotes', 'num_comments', 'label'))} FROM posts)
UNPIVOT (n_missing FOR "column" IN (upvotes, num_comments, label))""")
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.missing(posts(spark, sf_dir).select("upvotes", "num_comments", "label")))


@register("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(table(spark, sf_dir, "events"), "event_type")


@register("label_distribution", "SELECT quality, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 9) AS pct, count(*) OVER () AS n_unique, bool_and(quality IN (0, 1)) OVER () AS is_binary FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.label_distribution(table(spark, sf_dir, "labels"), "quality"))


@register("category_summary", "SELECT count(*) AS n_unique, count_if(n < 50) AS n_rare, coalesce(sum(n) FILTER (n < 50), 0)::bigint AS rare_rows, sum(n)::bigint AS n_rows, round(coalesce(sum(n) FILTER (n < 50), 0) * 100.0 / sum(n), 9) AS rare_pct FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.category_summary(table(spark, sf_dir, "events"), "user_id"))


@register("top_categories", f"WITH {POSTS_SQL} SELECT subreddit, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM posts), 9) AS pct FROM posts GROUP BY 1 ORDER BY n DESC, subreddit NULLS FIRST LIMIT 20")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.top_categories(posts(spark, sf_dir), "subreddit"))


@register("density_by_label", """WITH r AS (SELECT l_returnflag, ln(greatest(l_extendedprice::double, 1)) / ln(10) AS x FROM lineitem), l AS (SELECT min(x) AS lo, quantile_cont(x, 0.99) AS hi FROM r)
SELECT l_returnflag, least(floor((x - lo) / ((hi - lo) / 60)), 59)::int AS bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY l_returnflag) * (any_value(hi) - any_value(lo)) / 60), 6) AS density FROM r, l WHERE x <= hi GROUP BY 1, 2""")
def density_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities per group on a logarithmic axis, all with the same bins."""
    return rounded(profile.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", by=("l_returnflag",), log=True).drop("lo", "hi"), 6)


@register("group_sizes", """WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), e(bin, lo, hi) AS (VALUES (0, 0, 10), (1, 10, 50), (2, 50, 100), (3, 100, 500), (4, 500, 1000), (5, 1000, 5000), (6, 5000, 10000), (7, 10000, 100000), (8, 100000, 10000000))
SELECT bin, count(n) AS n_groups FROM e LEFT JOIN s ON n > lo AND n <= hi GROUP BY 1""")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.group_size_histogram(table(spark, sf_dir, "orders"), "o_custkey")


@register("calendar_counts", f"""WITH {POSTS_SQL}, t AS (SELECT to_timestamp(created_utc) AT TIME ZONE 'UTC' AS ts FROM posts)
SELECT unit, value, count(*) AS n FROM (SELECT 'year' AS unit, year(ts)::varchar AS value FROM t UNION ALL SELECT 'month', strftime(ts, '%Y-%m') FROM t UNION ALL SELECT 'hour', hour(ts)::varchar FROM t UNION ALL SELECT 'weekday', (isodow(ts) - 1)::varchar FROM t) GROUP BY 1, 2""")
def calendar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.calendar_counts(posts(spark, sf_dir))


@register("time_validity", f"""WITH {POSTS_SQL} SELECT count(*) AS n_rows, count_if(created_utc IS NULL) AS n_null, count_if(NOT coalesce(created_utc BETWEEN 1104537600 AND 1893456000, false)) AS n_invalid, strftime(to_timestamp(min(created_utc)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS first, strftime(to_timestamp(max(created_utc)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS last FROM posts""")
def time_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.time_validity(posts(spark, sf_dir))


@register("label_rate_by_year", f"""WITH {POSTS_SQL}, y AS (SELECT year(to_timestamp(created_utc) AT TIME ZONE 'UTC') AS year, count(*) AS n, avg(label) AS rate FROM posts WHERE label IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)
SELECT year, n, round(rate, 9) AS rate, round(max(rate) OVER () - min(rate) OVER (), 9) AS drift FROM y""")
def label_rate_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.label_rate_by_year(posts(spark, sf_dir), 10))


@register("histogram", """WITH l AS (SELECT min(o_totalprice) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders)
SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 60)), 59)::int AS bin, count(*) AS n FROM orders, l WHERE o_totalprice <= hi GROUP BY 1""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(table(spark, sf_dir, "orders"), "o_totalprice").select("bin", "n")


@register("box_by_group", """WITH h AS (SELECT quantile_cont(o_totalprice, 0.99) AS hi FROM orders), r AS (SELECT o_orderpriority, o_totalprice AS x FROM orders, h WHERE o_totalprice <= hi),
q AS (SELECT o_orderpriority, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM r GROUP BY 1)
SELECT o_orderpriority, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(min(x), 6) AS low_whisker, round(max(x), 6) AS high_whisker FROM r JOIN q USING (o_orderpriority)
WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1""")
def box_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.box_by_group(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority"), 6)


@register("leaky_categories", f"""WITH {POSTS_SQL}, r AS (SELECT subreddit, count(label) AS n, sum(label)::bigint AS n_positive, avg(label) AS rate FROM posts GROUP BY 1)
SELECT subreddit, n, n_positive, round(rate, 9) AS rate, count(*) OVER () AS n_leaky FROM r WHERE n >= 5 AND (rate >= 0.9 OR rate <= 0.1)""")
def leaky_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.leaky_categories(posts(spark, sf_dir), "subreddit", 5, 0.9, 0.1))


@register("concentration", f"""WITH {POSTS_SQL}, r AS (SELECT subreddit, sum(label) AS p FROM posts WHERE label IS NOT NULL GROUP BY 1 HAVING count(*) >= 5),
c AS (SELECT sum(p) OVER (ORDER BY p DESC, subreddit ROWS UNBOUNDED PRECEDING) / sum(p) OVER () AS s FROM r) SELECT count_if(s < 0.5) + 1 AS groups_50, count_if(s < 0.8) + 1 AS groups_80, count_if(s < 0.95) + 1 AS groups_95 FROM c""")
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.concentration(posts(spark, sf_dir), "subreddit", 5)


@register("label_rate_by_hour", f"""WITH {POSTS_SQL}, r AS (SELECT hour(to_timestamp(created_utc) AT TIME ZONE 'UTC') AS hour, count(*) AS n, avg(label) AS rate FROM posts WHERE label IS NOT NULL GROUP BY 1)
SELECT h.hour::int AS hour, coalesce(n, 0) AS n, round(coalesce(rate, 0), 9) AS rate FROM range(24) h(hour) LEFT JOIN r USING (hour)""")
def label_rate_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.label_rate_on_grid(posts(spark, sf_dir), F.hour(F.timestamp_seconds("created_utc")), 24, "hour"))


@register("means_by_label", f"""WITH {POSTS_SQL} SELECT label, {', '.join(f'round(avg({c}), 9) AS {c}_mean, quantile_cont({c}::double, 0.5) AS {c}_median' for c in ('upvotes', 'num_comments'))} FROM posts WHERE label IS NOT NULL GROUP BY 1""")
def means_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.means_by_label(posts(spark, sf_dir), ["upvotes", "num_comments"]))


@register("pearson", f"""WITH {POSTS_SQL} {' UNION ALL '.join(f"SELECT '{c}' AS feature, count({c}) AS n, round(corr({c}, label), 8) AS pearson FROM posts WHERE label IS NOT NULL AND {c} IS NOT NULL" for c in ('upvotes', 'num_comments'))}""")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.pearson(posts(spark, sf_dir), ["upvotes", "num_comments"]), 8)


@register("spearman", f"""WITH {POSTS_SQL} {' UNION ALL '.join(f"SELECT '{c}' AS feature, count(*) AS n, round(corr(rx, ry), 8) AS spearman FROM (SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS rx, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2 AS ry FROM posts WHERE label IS NOT NULL AND {c} IS NOT NULL)" for c in ('upvotes', 'num_comments'))}""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.spearman(posts(spark, sf_dir), ["upvotes", "num_comments"]), 8)


@register("weekday_hour_grid", f"""WITH {POSTS_SQL}, c AS (SELECT (isodow(to_timestamp(created_utc) AT TIME ZONE 'UTC') - 1)::int AS weekday, hour(to_timestamp(created_utc) AT TIME ZONE 'UTC')::int AS hour, count(*) AS n, avg(label) AS rate FROM posts WHERE label IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT weekday, hour, n, round(rate, 9) AS rate, round(max(rate) OVER () - min(rate) OVER (), 9) AS range FROM c""")
def weekday_hour_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.weekday_hour_grid(posts(spark, sf_dir), least=2))


@register("category_by_year", f"""WITH {POSTS_SQL}, top AS (SELECT subreddit, count(*) AS m FROM posts WHERE label IS NOT NULL GROUP BY 1 ORDER BY m DESC, subreddit LIMIT 15),
c AS (SELECT subreddit, year(to_timestamp(created_utc) AT TIME ZONE 'UTC') AS year, count(*) AS n, avg(label) AS rate FROM posts JOIN top USING (subreddit) WHERE label IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT subreddit, year::int AS year, n, round(rate, 9) AS rate, CASE WHEN count(*) OVER (PARTITION BY subreddit) >= 2 THEN round(max(rate) OVER (PARTITION BY subreddit) - min(rate) OVER (PARTITION BY subreddit), 9) END AS drift FROM c""")
def category_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.category_by_year(posts(spark, sf_dir), "subreddit", least=2))


@register("rate_by_length", f"""WITH {POSTS_SQL}, r AS (SELECT {BUCKET_SQL.format("length(coalesce(body, ''))")} AS bucket, count(*) AS n, avg(label) AS rate FROM posts WHERE label IS NOT NULL GROUP BY 1)
SELECT b.bucket::int AS bucket, coalesce(n, 0) AS n, round(rate, 9) AS rate FROM range(8) b(bucket) LEFT JOIN r USING (bucket)""")
def rate_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.rate_by_bucket(posts(spark, sf_dir), length_bucket(F.length(F.coalesce("body", F.lit("")))), 8))


@register("decile_rates", """WITH e AS (SELECT list_distinct(quantile_cont(l_extendedprice, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1.0])) AS e FROM lineitem)
SELECT greatest(len(list_filter(e, lambda x: x < l_extendedprice)) - 1, 0)::int AS bin, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem, e GROUP BY 1""")
def decile_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = relations.quantile_bins(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return rounded(binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean")), 6)


@register("mutual_information", f"""WITH {POSTS_SQL}, l AS (SELECT 'subreddit' AS feature, subreddit AS x, label AS y FROM posts WHERE label IS NOT NULL UNION ALL SELECT 'weekday', isodow(to_timestamp(created_utc) AT TIME ZONE 'UTC')::varchar, label FROM posts WHERE label IS NOT NULL),
c AS (SELECT feature, x, y, count(*) AS c FROM l WHERE x IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT feature, c / sum(c) OVER (PARTITION BY feature) AS p, sum(c) OVER (PARTITION BY feature, x) / sum(c) OVER (PARTITION BY feature) AS px, sum(c) OVER (PARTITION BY feature, y) / sum(c) OVER (PARTITION BY feature) AS py FROM c)
SELECT feature, round(sum(p * log2(p / (px * py))), 9) AS mutual_information FROM p GROUP BY 1""")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.mutual_information(posts(spark, sf_dir).withColumn("weekday", F.weekday(F.timestamp_seconds("created_utc")) + 1), ["subreddit", "weekday"]))


SIGNAL_SQL = f"""{POSTS_SQL}, b AS (SELECT id, label, {sql_strip("coalesce(title, '') || ' . ' || coalesce(body, '')")} AS t FROM posts), s AS (SELECT *, {WORDS_SQL.format('t')} AS w FROM b),
sig AS (SELECT id, label, {_stem_sql('t')}::int AS has_keyword, {_count_sql('!')} AS exclamations, {_count_sql(chr(92) + '?')} AS questions, {_count_sql(chr(92) + '.' + chr(92) + '.' + chr(92) + '.')} AS ellipses, {CAPS_SQL} AS caps_words,
 {_lex_sql('FIRST_PERSON')} / greatest(len(w), 1) AS first_person_rate, {_lex_sql('NEGATION')} / greatest(len(w), 1) AS negation_rate, {_lex_sql('NEGATIVE_AFFECT')} / greatest(len(w), 1) AS negative_affect_rate FROM s)"""


@register("signal_lift", f"""WITH {SIGNAL_SQL} {' UNION ALL '.join(f"SELECT '{s}' AS signal, round(avg({s}) FILTER (label = 0), 9) AS mean_0, round(avg({s}) FILTER (label = 1), 9) AS mean_1, round((avg({s}) FILTER (label = 1)) / nullif(avg({s}) FILTER (label = 0), 0), 9) AS lift FROM sig" for s in signals.SIGNALS)}""")
def signal_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.signal_lift(signals.signals(posts(spark, sf_dir))))


def _terms_sql(bigrams: bool) -> str:
    from quillstone.functions import lexicons

    stops = ", ".join(f"'{w}'" for w in lexicons.ENGLISH_STOP_WORDS)
    words = f"list_filter({WORDS_SQL.format('text')}, lambda x: x NOT IN ({stops}) AND length(x) > 2)"
    if bigrams:
        words = f"list_transform(range(1, len({words})), lambda i: ({words})[i] || '_' || ({words})[i + 1])"
    return f"terms AS (SELECT role, term, count(*) AS n FROM (SELECT role, unnest({words}) AS term FROM conversations WHERE role IS NOT NULL) GROUP BY 1, 2)"


@register("bigram_counts", f"WITH {_terms_sql(True)} SELECT * FROM terms")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.term_counts(table(spark, sf_dir, "conversations"), "role", "text", True)


@register("distinctive_terms", f"""WITH {_terms_sql(False)}, w AS (SELECT term, coalesce(sum(n) FILTER (role = 'user'), 0) AS n_a, coalesce(sum(n) FILTER (role = 'assistant'), 0) AS n_b FROM terms GROUP BY 1 HAVING n_a + n_b > 0),
t AS (SELECT sum(n_a) AS ta, sum(n_b) AS tb, count(*) AS v FROM w), z AS (SELECT term, (ln((n_a + 0.01) / (ta + 0.01 * v - n_a - 0.01)) - ln((n_b + 0.01) / (tb + 0.01 * v - n_b - 0.01))) / sqrt(1 / (n_a + 0.01) + 1 / (n_b + 0.01)) AS z, n_a, n_b FROM w, t WHERE n_a + n_b >= 5)
SELECT term, round(z, 6) AS z, n_a::bigint AS n_a, n_b::bigint AS n_b FROM z ORDER BY z.z DESC, term LIMIT 60""")
def distinctive_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = signals.term_counts(table(spark, sf_dir, "conversations"), "role", "text")
    return rounded(signals.distinctive_terms(counts, "role", "user", "assistant", min_frequency=5), 6)


@register("noise", rf"""WITH {POSTS_SQL}, b AS (SELECT coalesce(title, '') AS title, coalesce(body, '') AS t FROM posts) SELECT count(*) AS n_rows,
 count_if(t <> '' AND len(regexp_extract_all(t, '[a-zA-Z]{{2,}}')) <= 2 AND regexp_matches(t, 'https?://\S+|www\.\S+')) AS url_only,
 count_if(length(t) > 10 AND len(regexp_extract_all(t, '[^\pL\pM\pN_\s.,!?''"-]')) / length(t) > 0.5) AS symbol_heavy, count_if(length(t) > 20000) AS very_long, count_if(length(t) BETWEEN 1 AND 4) AS very_short,
 count_if(lower({sql_strip('title')}) = lower({sql_strip('t')})) AS title_is_body, count_if(t = '') AS empty_body FROM b""")
def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.noise(posts(spark, sf_dir))


@register("language_share", f"""WITH d AS (SELECT text AS t, {WORDS_SQL.format('text')}[1:50] AS w FROM documents), c AS (SELECT CASE WHEN length(t) < 10 THEN true WHEN length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) / length(t) < 0.85 THEN false WHEN len(w) = 0 THEN true
 ELSE len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in 'the and to of a is in that it for i you my with this have be on are'.split())}))) / len(w) >= 0.05 END AS en FROM d) SELECT CASE WHEN en THEN 'en' ELSE 'non-en' END AS language, count(*) AS n FROM c GROUP BY 1""")
def language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.language_share(table(spark, sf_dir, "documents"), "text")


@register("extreme_positives", f"""WITH {POSTS_SQL}, r AS (SELECT id, length(body) AS n_chars FROM posts WHERE label = 1 AND body IS NOT NULL)
(SELECT id, n_chars, 'longest' AS kind FROM r ORDER BY n_chars DESC, id LIMIT 25) UNION ALL (SELECT id, n_chars, 'shortest' FROM r WHERE n_chars > 5 ORDER BY n_chars, id LIMIT 25)""")
def extreme_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.extreme_positives(posts(spark, sf_dir))


FOLDS_SQL = """parted AS (SELECT doc_id, (row_number() OVER (PARTITION BY quality ORDER BY md5('2024:' || doc_id), doc_id) - 1) % 4 AS fold FROM labels),
f0 AS (SELECT doc_id AS id, (doc_id * 7919 % 1000) * 0.001 AS p FROM parted WHERE fold <> 0), f1 AS (SELECT doc_id AS id, (doc_id * 104729 % 1000) * 0.001 AS p FROM parted WHERE fold <> 1)"""


def _fold(spark: SparkSession, sf_dir: str, factor: int, own: int) -> DataFrame:
    """What a model trained on one fold scores: all rows of the others."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return splits.stratified_folds(labels, 4).where(F.col("fold") != own).select(F.col("doc_id").alias("id"), (F.col("doc_id") * factor % 1000 * F.lit(0.001)).alias("p_text"))


@register("mean_of_folds", f"WITH {FOLDS_SQL} SELECT id, round(avg(p), 9) AS p_text, count(p) AS n_folds FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1) GROUP BY 1")
def mean_of_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assemble.mean_of_folds([_fold(spark, sf_dir, 7919, 0), _fold(spark, sf_dir, 104729, 1)]))


@register("first_source", f"WITH {FOLDS_SQL} SELECT id, round(p, 9) AS p_text FROM f0 UNION ALL SELECT id, round(p, 9) FROM f1 WHERE id NOT IN (SELECT id FROM f0)")
def first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assemble.first_source([_fold(spark, sf_dir, 7919, 0), _fold(spark, sf_dir, 104729, 1)]))


@register("alignment_gap", f"WITH {SCORES_SQL} SELECT round(avg(p_text) FILTER (label = 1) - avg(p_text) FILTER (label = 0), 9) AS gap, count(*) AS n FROM scores")
def alignment_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assemble.alignment_gap(scores(spark, sf_dir), 0.05))


METRIC_SQL = """SELECT *, (tn + tp) / (tn + fp + fn + tp) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity,
 coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_pos, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f1_neg, (f1_pos + f1_neg) / 2 AS f1_macro, (recall + specificity) / 2 AS recall_macro"""
METRICS = ("accuracy", "precision", "recall", "specificity", "f1_pos", "f1_neg", "f1_macro", "recall_macro")


def _p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).withColumnRenamed("p_text", "p")


@register("metrics_at_half", f"WITH {SCORES_SQL}, c AS (SELECT count_if(p_text < .5 AND label = 0) AS tn, count_if(p_text >= .5 AND label = 0) AS fp, count_if(p_text < .5 AND label = 1) AS fn, count_if(p_text >= .5 AND label = 1) AS tp FROM scores), m AS ({METRIC_SQL} FROM c) SELECT tn, fp, fn, tp, {', '.join(f'round({m}, 9) AS {m}' for m in METRICS)} FROM m")
def metrics_at_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.with_metrics(evaluate.confusion(_p(spark, sf_dir))))


@register("areas", f"""WITH {SCORES_SQL}, g AS (SELECT p_text AS p, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY 1), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(neg * (tp - pos + pos / 2)) / (sum(pos) * sum(neg)), 9) AS roc_auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 9) AS pr_auc FROM c""")
def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.areas(_p(spark, sf_dir)))


CURVE_SQL = f"""{SCORES_SQL}, g AS (SELECT p_text AS threshold, sum(label)::bigint AS pos, sum(1 - label)::bigint AS neg FROM scores GROUP BY 1),
c AS (SELECT threshold, pos, neg, (sum(pos) OVER w)::bigint AS tp, (sum(neg) OVER w)::bigint AS fp, sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg FROM g WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""


@register("curve_points", f"""WITH {CURVE_SQL} SELECT round(threshold, 9) AS threshold, tp, fp, round(tp / n_pos, 9) AS tpr, round(fp / n_neg, 9) AS fpr, round(tp / (tp + fp), 9) AS precision FROM c WHERE next_pos IS NULL OR pos * next_neg <> neg * next_pos""")
def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of the ROC curve, with the precision there."""
    return rounded(evaluate.curve_points(_p(spark, sf_dir)))


@register("operating_points", f"WITH {CURVE_SQL} SELECT (SELECT round(max(tp / n_pos), 9) FROM c WHERE tp / (tp + fp) >= 0.9) AS recall_at_precision, (SELECT round(max(tp / (tp + fp)), 9) FROM c WHERE tp / n_pos >= 0.9) AS precision_at_recall")
def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _p(spark, sf_dir)
    recall, precision = (f(df).toDF(name) for f, name in ((evaluate.recall_at_precision, "recall_at_precision"), (evaluate.precision_at_recall, "precision_at_recall")))
    return rounded(recall.crossJoin(precision))  # a row each


@register("prediction_summary", f"""WITH {SCORES_SQL}, c AS (SELECT count(*) AS n, count_if(p_text >= .5) AS n_positive, count_if(p_text < .5 AND label = 0) AS tn, count_if(p_text >= .5 AND label = 0) AS fp, count_if(p_text < .5 AND label = 1) AS fn, count_if(p_text >= .5 AND label = 1) AS tp FROM scores),
m AS (SELECT *, (tn + tp) / n AS accuracy, tp / (tp + fp + 1e-8) AS precision, tp / (tp + fn + 1e-8) AS recall, tn / (tn + fp + 1e-8) AS specificity FROM c)
SELECT n, n_positive, round(n_positive * 100.0 / n, 9) AS pct_positive, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(specificity, 9) AS specificity, round(2 * precision * recall / (precision + recall + 1e-8), 9) AS f1 FROM m""")
def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assemble.prediction_summary(scores(spark, sf_dir)))


@register("reliability", f"""WITH {SCORES_SQL}, e AS (SELECT list_distinct(quantile_cont(p_text, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1.0])) AS e FROM scores)
SELECT greatest(len(list_filter(e, lambda x: x < p_text)) - 1, 0)::int AS bin, count(*) AS n, round(avg(p_text), 9) AS mean_p, round(avg(label), 9) AS rate FROM scores, e GROUP BY 1""")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.reliability(_p(spark, sf_dir)))


@register("category_folds", f"""WITH {POSTS_SQL}, c AS (SELECT subreddit, count(*) AS n, coalesce(sum(label), 0)::bigint AS n_positive, least(floor(coalesce(avg(label), 0) * 4), 3) AS stratum FROM posts WHERE subreddit IS NOT NULL GROUP BY 1),
r AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY n DESC, subreddit) - 1) % 6 AS turn FROM c) SELECT subreddit, n, n_positive, CASE WHEN turn < 3 THEN turn ELSE 5 - turn END::int AS fold FROM r""")
def category_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.category_folds(posts(spark, sf_dir), "subreddit")


def _scored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with their score and fold by category: (id, subreddit, body, label, hit, p, fold)."""
    given = posts(spark, sf_dir).where("label is not null")
    folds_ = splits.category_folds(given, "subreddit").select("subreddit", "fold")
    p = scores(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.col("p_text").alias("p"))
    hit = has_stem(F.concat_ws(" ", "title", "body"), lexicons.SAMPLE_KEYWORD_STEMS)
    return assemble.join_splits(given.join(folds_, "subreddit"), p).select("id", "subreddit", "body", "label", hit.alias("hit"), "p", "fold")


SCORED_SQL = f"""{POSTS_SQL}, {SCORES_SQL}, c AS (SELECT subreddit, count(*) AS n, least(floor(avg(label) * 4), 3) AS stratum FROM posts WHERE label IS NOT NULL AND subreddit IS NOT NULL GROUP BY 1),
turns AS (SELECT subreddit, n AS size, (row_number() OVER (PARTITION BY stratum ORDER BY n DESC, subreddit) - 1) % 6 AS turn FROM c), top AS (SELECT subreddit AS top FROM c ORDER BY n DESC, subreddit LIMIT 5),
scored AS (SELECT p.id, subreddit, top, size, body, p.label, regexp_matches(lower(concat_ws(' ', title, body)), '{'|'.join(lexicons.SAMPLE_KEYWORD_STEMS)}') AS hit, p_text AS p, CASE WHEN turn < 3 THEN turn ELSE 5 - turn END::int AS fold FROM posts p JOIN turns USING (subreddit) JOIN scores s ON s.id::varchar = p.id LEFT JOIN top ON top = subreddit WHERE p.label IS NOT NULL)"""


def _sliced_sql(rows: str, by: str) -> str:
    return f"""rows AS ({rows}), k AS (SELECT {by}, count_if(p < .5 AND label = 0) AS tn, count_if(p >= .5 AND label = 0) AS fp, count_if(p < .5 AND label = 1) AS fn, count_if(p >= .5 AND label = 1) AS tp, count(*) AS n FROM rows GROUP BY 1), m AS ({METRIC_SQL} FROM k),
g AS (SELECT {by}, p, sum(label) AS pos, sum(1 - label) AS neg FROM rows GROUP BY 1, 2), d AS (SELECT {by}, sum(pos) OVER w AS up, sum(neg) OVER w AS down, sum(pos) OVER (PARTITION BY {by}) AS n_pos FROM g WINDOW w AS (PARTITION BY {by} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
r AS (SELECT {by}, max(up / nullif(n_pos, 0)) AS recall_at_precision FROM d WHERE up / (up + down) >= 0.9 GROUP BY 1)
SELECT {by}, n, tn, fp, fn, tp, {', '.join(f'round({m}, 9) AS {m}' for m in METRICS)}, round(recall_at_precision, 9) AS recall_at_precision FROM m LEFT JOIN r USING ({by})"""


SLICES_SQL = """SELECT *, unnest(list_filter(['all', 'category:' || top, CASE WHEN size < 12 THEN 'small categories' END, CASE WHEN label = 0 AND hit THEN 'negatives with keyword' END, CASE WHEN label = 1 AND length(coalesce(body, '')) < 20 THEN 'positives with short body' END], lambda x: x IS NOT NULL)) AS slice FROM scored"""


@register("test_subsets", f"WITH {SCORED_SQL}, {_sliced_sql(SLICES_SQL, 'slice')}")
def test_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of overlapping slices of the scored posts, from one count."""
    return rounded(evaluate.slice_metrics(evaluate.slices(_scored_posts(spark, sf_dir), small=12)))


@register("metrics_by_category", f"WITH {SCORED_SQL}, {_sliced_sql('SELECT * FROM scored', 'subreddit')}")
def metrics_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.slice_metrics(_scored_posts(spark, sf_dir), "subreddit"))


@register("cross_category", f"WITH {SCORED_SQL}, {_sliced_sql('SELECT * FROM scored', 'fold')}")
def cross_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics on each fold of categories that the other folds don't have."""
    return rounded(evaluate.slice_metrics(_scored_posts(spark, sf_dir), "fold"))


@register("fold_metrics", f"""WITH {SCORED_SQL}, k AS (SELECT fold, count_if(p < .5 AND label = 0) AS tn, count_if(p >= .5 AND label = 0) AS fp, count_if(p < .5 AND label = 1) AS fn, count_if(p >= .5 AND label = 1) AS tp FROM scored GROUP BY 1), m AS ({METRIC_SQL} FROM k)
SELECT 'text' AS model, {', '.join(f'round(avg({m}), 9) AS {m}_mean, round(stddev_pop({m}), 9) AS {m}_std' for m in ('f1_macro', 'f1_pos', 'accuracy'))} FROM m""")
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the metrics over the folds of categories."""
    folds_ = evaluate.with_metrics(evaluate.confusion(_scored_posts(spark, sf_dir), 0.5, ("fold",))).withColumn("model", F.lit("text"))
    return rounded(evaluate.fold_summary(folds_, ("model",), ["f1_macro", "f1_pos", "accuracy"]))


@register("threshold_sweep", f"""WITH {SCORES_SQL}, t AS (SELECT 0.05::double + i * ((0.95::double - 0.05::double) / 90) AS threshold FROM range(91) r(i)),
c AS (SELECT threshold, count_if(p_text < threshold AND label = 0) AS tn, count_if(p_text >= threshold AND label = 0) AS fp, count_if(p_text < threshold AND label = 1) AS fn, count_if(p_text >= threshold AND label = 1) AS tp FROM t, scores GROUP BY 1),
m AS ({METRIC_SQL} FROM c) SELECT round(threshold, 9) AS threshold, tn, fp, fn, tp, {', '.join(f'round({m}, 9) AS {m}' for m in METRICS)} FROM m""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.threshold_sweep(_p(spark, sf_dir)))


@register("calibration_error", f"""WITH {SCORES_SQL}, b AS (SELECT least(floor(p_text * 10), 9) AS bin, count(*) AS n, avg(p_text) AS p, avg(label) AS y FROM scores GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 9) AS ece FROM b""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.calibration_error(_p(spark, sf_dir)))


@register("probability_metrics", f"""WITH {SCORES_SQL}, s AS (SELECT *, least(greatest(p_text, 1e-15), 1 - 1e-15) AS q FROM scores) SELECT round(avg(CASE WHEN label = 1 THEN -ln(q) ELSE -ln(1 - q) END), 9) AS log_loss, round(avg((p_text - label) * (p_text - label)), 9) AS brier, round(avg(p_text), 9) AS mean_p FROM s""")
def probability_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.probability_metrics(_p(spark, sf_dir)))


@register("score_histogram", f"""WITH {SCORES_SQL}, b AS (SELECT label, least(floor(p_text * 50), 49)::int AS bin, count(*) AS n FROM scores GROUP BY 1, 2) SELECT label, bin, n, round(n * 50 / sum(n) OVER (PARTITION BY label), 9) AS density FROM b""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.score_histogram(_p(spark, sf_dir)))


def _matrix_sql(by: str, rows: str) -> str:
    """Metrics at 0.5 and at the best threshold, with areas, of ``rows`` (by, label, p)."""
    counts = ", ".join(f"count_if({p} AND label = {y}) AS {k}" for k, p, y in (("tn", "p < threshold", 0), ("fp", "p >= threshold", 0), ("fn", "p < threshold", 1), ("tp", "p >= threshold", 1)))
    return f"""rows AS ({rows}), grid AS (SELECT 0.05::double + i * ((0.95::double - 0.05::double) / 90) AS threshold FROM range(91) r(i)),
c AS (SELECT {by}, threshold, 'best' AS mode, {counts} FROM grid, rows GROUP BY {by}, threshold UNION ALL SELECT {by}, 0.5::double AS threshold, 'half', {counts} FROM (SELECT *, 0.5::double AS threshold FROM rows) GROUP BY {by}, threshold),
m AS ({METRIC_SQL} FROM c), picked AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY {by}, mode ORDER BY round(f1_macro, 12) DESC, threshold) = 1),
g AS (SELECT {by}, p, sum(label) AS pos, sum(1 - label) AS neg FROM rows GROUP BY {by}, p), d AS (SELECT *, sum(pos) OVER w AS up, sum(neg) OVER w AS down FROM g WINDOW w AS (PARTITION BY {by} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
areas AS (SELECT {by}, sum(neg * (up - pos + pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc, sum(pos * up / (up + down)) / sum(pos) AS pr_auc FROM d GROUP BY {by}), facts AS (SELECT {by}, count(*) AS n, avg(label) AS pos_rate FROM rows GROUP BY {by})"""


MATRIX_COLUMNS = f"mode, round(threshold, 9) AS threshold, tn, fp, fn, tp, {', '.join(f'round({m}, 9) AS {m}' for m in METRICS)}, n, round(pos_rate, 9) AS pos_rate, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc"


@register("metrics_matrix", f"WITH {SCORES_SQL}, {_matrix_sql('split', "SELECT CASE WHEN id % 3 = 0 THEN 'test' ELSE 'val' END AS split, label, p_text AS p FROM scores")} SELECT split, {MATRIX_COLUMNS} FROM picked JOIN facts USING (split) JOIN areas USING (split)")
def metrics_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _p(spark, sf_dir).withColumn("split", F.when(F.col("id") % 3 == 0, "test").otherwise("val"))
    return rounded(evaluate.metrics_matrix(df, ("split",)))


MODELS_SQL = """SELECT id, label, 'text' AS model, p_text AS p FROM scores UNION ALL SELECT id, label, 'meta', cast((id * 7919) % 1000 AS double) * 0.001 FROM scores UNION ALL SELECT id, label, 'both', (p_text + cast((id * 7919) % 1000 AS double) * 0.001) / 2 FROM scores"""


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of the text, a score that knows nothing of the label, and their mean, side by side."""
    df = scores(spark, sf_dir).withColumn("meta", F.col("id") * 7919 % 1000 * F.lit(0.001))
    return df.withColumn("both", (F.col("p_text") + F.col("meta")) / 2).withColumnRenamed("p_text", "text")


@register("model_comparison", f"""WITH {SCORES_SQL}, {_matrix_sql('model', MODELS_SQL)}, l AS (SELECT model, avg(CASE WHEN label = 1 THEN -ln(q) ELSE -ln(1 - q) END) AS log_loss, avg((p - label) * (p - label)) AS brier, avg(p) AS mean_p FROM (SELECT *, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM rows) GROUP BY 1),
e AS (SELECT model, sum(n * abs(p - y)) / sum(n) AS ece FROM (SELECT model, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS p, avg(label) AS y FROM rows GROUP BY 1, 2) GROUP BY 1)
SELECT model, {MATRIX_COLUMNS}, round(log_loss, 9) AS log_loss, round(brier, 9) AS brier, round(mean_p, 9) AS mean_p, round(ece, 9) AS ece FROM picked JOIN facts USING (model) JOIN areas USING (model) JOIN l USING (model) JOIN e USING (model)""")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.model_comparison(evaluate.stacked(_models(spark, sf_dir), ("text", "meta", "both"))))


@register("ablation", f"""WITH {SCORES_SQL}, rows AS ({MODELS_SQL}), c AS (SELECT model, count_if(p < .5 AND label = 0) AS tn, count_if(p >= .5 AND label = 0) AS fp, count_if(p < .5 AND label = 1) AS fn, count_if(p >= .5 AND label = 1) AS tp FROM rows GROUP BY 1),
m AS ({METRIC_SQL} FROM c) SELECT model, round(f1_macro, 9) AS f1_macro, round(f1_pos, 9) AS f1_pos, round(f1_macro - max(f1_macro) FILTER (model = 'both') OVER (), 9) AS loss FROM m""")
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.ablation(_models(spark, sf_dir), ("text", "meta", "both"), "both"))


@register("page_fields", r"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '') AS title,
 md5(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '')) AS article, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", extract.tag_text(F.col("html"), "title").alias("title"), F.md5(extract.tag_text(F.col("html"), "article")).alias("article"), extract.host(F.col("url")).alias("host"))


@register("scraped_pages", r"""SELECT page_id, md5(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '')) AS title,
 regexp_matches(html, '(?i)property=["'']og:description["''][^>]+content=["''][^"'']+') AS has_content FROM pages""")
def scraped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.scraped_posts(table(spark, sf_dir, "pages"), entities=False)
    return found.select("page_id", F.md5("title").alias("title"), "has_content")


@register("page_hosts", r"""SELECT page_id, lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1)) AS host, regexp_replace(url, 'https?://(www\.|np\.|new\.)?example\.com', 'https://old.example.com', 'g') AS normal_url,
 coalesce(regexp_matches(lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1)), '(^|\.)(example\.com|example\.net)$'), false) AS author_titled FROM pages""")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host rules with hosts that the pages have: an address in its normal form, and whether titles are authors there."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", extract.host(url).alias("host"), extract.normal_forum_url(url, "example.com", "old.example.com").alias("normal_url"), extract.author_titled(url, ("example.com", "example.net")).alias("author_titled"))


@register("older_clean", rf"""SELECT doc_id, md5({sql_strip(r"regexp_replace(regexp_replace(regexp_replace(" + sql_strip("coalesce(text, '')") + r", '\[([^\]]+)\]\([^\)]+\)', '\1', 'g'), 'https?://\S+|www\.\S+', '', 'g'), '[\s\x{A0}\x{2000}-\x{200A}\x{3000}]+', ' ', 'g')")}) AS text FROM documents""")
def older_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean_text_simple(F.col("text"))).alias("text"))


@register("previews", f"WITH {POSTS_SQL} SELECT id, CASE WHEN length(title) > 45 THEN left(title, 20) || '...' || right(title, 20) ELSE title END AS preview FROM posts")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).select("id", preview(F.col("title")).alias("preview"))


RATE_COLUMNS = ("first_person_rate", "negative_word_rate", "exclamation_rate", "question_rate", "caps_word_rate", "ellipsis_rate", "absolutist_rate", "second_person_rate")
RATE_COUNTS = ("num_first_person", "num_negative_words", "num_exclamations", "num_questions", "num_caps_words", "num_ellipsis", "num_absolutist", "num_second_person")


@register("feature_rates", f"WITH {FEATURES_SQL} SELECT id, {', '.join(f'round(({c} / greatest(num_words, 1))::float::double, 4) + 0 AS {r}' for c, r in zip(RATE_COUNTS, RATE_COLUMNS, strict=True))}, round((num_words / greatest(num_sentences, 1))::float::double, 4) + 0 AS avg_sentence_len FROM feats")
def feature_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight rates and the mean sentence length of each clean post."""
    rates = with_rates(meta_features(cleaned(spark, sf_dir)))
    return rates.select("id", *((F.round(F.col(c).cast("double"), 4) + 0).alias(c) for c in (*RATE_COLUMNS, "avg_sentence_len")))


@register("neutral_features", f"""WITH {FEATURES_SQL}, u AS (SELECT *, subreddit_url AS url FROM feats JOIN (SELECT id, 'https://' || subreddit || '/' || CASE WHEN upvotes > 1000 THEN 'x.com' ELSE 'post' END AS subreddit_url FROM clean) USING (id))
SELECT id, round(CASE WHEN title_len_chars = 0 THEN 38.0 ELSE title_len_chars END::double, 4) AS title_len_chars, round(CASE WHEN title_len_chars = 0 THEN 2.96 ELSE body_to_title_ratio::float END::double, 4) + 0 AS body_to_title_ratio,
 {', '.join(f"round(CASE WHEN regexp_matches(url, 'facebook.com|instagram.com|twitter.com|x[.]com|threads.net|threads.com|tiktok.com') THEN {v} ELSE {c}::float END::double, 4) + 0 AS {c}" for c, v in (('upvotes_log', 2.08), ('num_comments_log', 1.95), ('comments_per_upvote', 0.64)))} FROM u""")
def neutral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement and title features with medians where the url names another domain, or the title is missing."""
    clean_ = materialised(cleaned(spark, sf_dir), "clean")
    url = F.concat(F.lit("https://"), F.col("subreddit"), F.lit("/"), F.when(F.col("upvotes") > 1000, "x.com").otherwise("post"))
    rows = meta_features(clean_).join(clean_.select("id", url.alias("url")), "id")
    names = ("title_len_chars", "body_to_title_ratio", "upvotes_log", "num_comments_log", "comments_per_upvote")
    return neutralise(rows, F.col("url")).select("id", *((F.round(F.col(c).cast("double"), 4) + 0).alias(c) for c in names))


@register("cut_by_ratio", f"""WITH w AS (SELECT doc_id, {WORDS_SQL.format("text")} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(array_to_string(CASE WHEN len(w) <= 100 THEN w ELSE list_concat(w[1:67], w[len(w) - 32:]) END, ' ')) AS words FROM w""")
def cut_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", simple_words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.md5(F.array_join(tokens.cut_by_ratio(F.col("w"), 100, 0.67), " ")).alias("words"))


@register("scatter_sample", f"WITH {POSTS_SQL} SELECT id, label, greatest(coalesce(upvotes, 0), 1) AS upvotes, greatest(coalesce(num_comments, 0), 1) AS num_comments FROM posts ORDER BY md5('42:' || id), id LIMIT 300")
def scatter_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.scatter_sample(posts(spark, sf_dir), 300)


@register("label_mismatches", f"""WITH {POSTS_SQL}, f AS (SELECT id, label, regexp_matches(lower(concat_ws(' ', title, body)), '{'|'.join(lexicons.SAMPLE_KEYWORD_STEMS)}') AS hit FROM posts WHERE label IS NOT NULL)
SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5(id), id) AS place, id FROM f WHERE (label = 1) <> hit QUALIFY place <= 25""")
def label_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives without a keyword and negatives with one."""
    return signals.label_mismatches(posts(spark, sf_dir))


@register("eval_subsets", f"""{ranked_sql(42, 'label')}, q AS (SELECT *, (SELECT count(*) FROM posts) AS t FROM r) SELECT id, label, CASE WHEN rank < floor(n * 100 / t + 0.5) THEN 1 ELSE 2 END AS subset FROM q WHERE rank < floor(n * 100 / t + 0.5) + floor(n * 60 / t + 0.5)""")
def eval_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two disjoint subsets of about 100 and 60 rows with the labels' shares."""
    return splits.eval_subsets(posts(spark, sf_dir).select("id", "label"), 100, 60)


@register("holdout", f"{ranked_sql(42)} SELECT id, label, rank < floor(n * 0.05 + 0.5) AS is_holdout FROM r")
def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.holdout(posts(spark, sf_dir).select("id", "label"), 0.05)


@register("fold_slices", f"""{ranked_sql(2024, f"label, ({TIME_SPLIT} = 'train')", f", ({TIME_SPLIT} = 'train') AS t")}, f AS (SELECT label, CASE WHEN t THEN rank % 3 ELSE -1 END AS fold FROM r)
SELECT part, count(*) AS n, round(avg(label), 9) AS label_rate FROM (SELECT 'train' AS part, label FROM f WHERE fold IN (1, 2) UNION ALL SELECT 'held out', label FROM f WHERE fold = 0) GROUP BY 1""")
def fold_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is trained on, and what is held out, of the train split's first fold."""
    rows = posts(spark, sf_dir).select("id", "label", splits.time_split(F.col("created_utc")).alias("time_split"))
    parts = splits.fold_slices(splits.stratified_folds(rows, 3, 2024, F.col("time_split") == "train"), 0)
    train, held_out = (df.withColumn("part", F.lit(name)) for df, name in zip(parts, ("train", "held out"), strict=True))
    return rounded(splits.split_report(train.unionByName(held_out), "part"))


@register("out_of_fold", f"WITH {FOLDS_SQL}, o AS (SELECT id, p, 0 AS fold FROM f0 UNION ALL SELECT id, p, 1 FROM f1) SELECT id, round(p, 9) AS p_text, fold, count(*) OVER (PARTITION BY id) AS n_seen FROM o")
def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assemble.out_of_fold([_fold(spark, sf_dir, 7919, 0), _fold(spark, sf_dir, 104729, 1)]))


@register("repeated_scores", f"WITH {FOLDS_SQL}, o AS (SELECT id, p FROM f0 UNION ALL SELECT id, p FROM f1) SELECT id, round(avg(p), 9) AS mean, round(stddev_pop(p), 9) AS std, round(greatest(0, 1 - 2 * stddev_pop(p)), 9) AS confidence FROM o GROUP BY 1")
def repeated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = assemble.out_of_fold([_fold(spark, sf_dir, 7919, 0), _fold(spark, sf_dir, 104729, 1)])
    return rounded(assemble.repeated_scores(runs.select("id", F.col("fold").alias("run"), F.col("p_text").alias("score"))))


@register("missing_scores", f"WITH {POSTS_SQL}, {FOLDS_SQL} SELECT {TIME_SPLIT} AS time_split, count(*) AS n_missing FROM posts p LEFT JOIN f0 ON f0.id::varchar = p.id WHERE f0.id IS NULL GROUP BY 1")
def missing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts by split that a fold's scores leave out."""
    rows = posts(spark, sf_dir).select("id", splits.time_split(F.col("created_utc")).alias("time_split"))
    return assemble.attach_scores(rows, _fold(spark, sf_dir, 7919, 0).withColumn("id", F.col("id").cast("string")))[1]


WEIGHTS, BIAS = {"first_person_rate": 4.0, "negative_word_rate": 6.0, "has_mh_keyword": 1.0, "body_length_bucket": 0.1}, -1.0


@register("score_posts", f"""WITH {POSTS_SQL}, clean AS (SELECT id, {sql_clean('title')} AS title, {sql_clean('body')} AS body FROM posts),
t AS (SELECT id, body, {sql_strip("title || ' ' || body")} AS t FROM clean WHERE title <> '' OR body <> ''), w AS (SELECT *, {WORDS_SQL.format('t')} AS w FROM t),
z AS (SELECT id, {BIAS} + ({_lex_sql('FIRST_PERSON')} / greatest(len(w), 1))::float::double * 4.0 + ({_lex_sql('NEGATIVE_AFFECT')} / greatest(len(w), 1))::float::double * 6.0 + {_stem_sql('t')}::int * 1.0 + {BUCKET_SQL.format('length(body)')} * 0.1 AS z FROM w)
SELECT id, round(1 / (1 + exp(-z)), 9) AS p_final, (1 / (1 + exp(-z)) >= 0.5)::int AS predicted FROM z""")
def score_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All posts as requests: validated, cleaned, featured and scored by a linear model."""
    requests = posts(spark, sf_dir).withColumn("url", F.lit(None).cast("string"))
    return rounded(score(requests.withColumns({c: F.greatest(c, F.lit(0)) for c in ("upvotes", "num_comments")}), linear_score(WEIGHTS, BIAS)))


@register("text_scores")
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of the text model over all labelled posts."""
    from quillstone.operators.models import fold_scores

    return fold_scores(splits.stratified_folds(posts(spark, sf_dir).where("label is not null")), 3)


@register("term_scores", f"""WITH {POSTS_SQL}, folded AS (SELECT id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('2024:' || id), id) - 1) % 3 AS fold, {WORDS_SQL.format("concat_ws(' ', title, body)")} AS w FROM posts WHERE label IS NOT NULL),
each AS (SELECT id, label, fold, unnest(w) AS term FROM folded), own AS (SELECT term, fold, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM each GROUP BY 1, 2),
c AS (SELECT f.fold, term, sum(pos) AS pos, sum(neg) AS neg FROM range(3) f(fold) JOIN own ON own.fold <> f.fold GROUP BY 1, 2), s AS (SELECT fold, sum(pos) AS n_pos, sum(neg) AS n_neg, count(*) AS v FROM c GROUP BY 1),
weights AS (SELECT fold, term, ln((pos + 1) / (n_pos + v)) - ln((neg + 1) / (n_neg + v)) AS weight FROM c JOIN s USING (fold)),
bias AS (SELECT f.fold, ln(sum(label) / sum(1 - label)) AS bias FROM range(3) f(fold) JOIN folded ON folded.fold <> f.fold GROUP BY 1),
tf AS (SELECT id, fold, term, count(*) AS tf FROM each GROUP BY 1, 2, 3), d AS (SELECT id, sum(tf * weight) / sum(tf) AS z FROM tf JOIN weights USING (fold, term) GROUP BY 1)
SELECT id, label, fold::tinyint AS fold, round(1 / (1 + exp(-(bias + coalesce(z, 0)))), 9) AS p_text FROM folded JOIN bias USING (fold) LEFT JOIN d USING (id)""")
def term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of the text model that is a table of term weights."""
    from quillstone.operators.models import term_weights, weighted_scores, with_words

    rows = with_words(splits.stratified_folds(posts(spark, sf_dir).where("label is not null"))).select("id", "label", "fold", "words")
    rows = materialised(rows, "words")
    return rounded(weighted_scores(rows, term_weights(rows)))


def _pav_sql(rows: str) -> str:
    """(p, n, y) of distinct scores: the largest over all starts of the smallest mean that reaches over the score."""
    return f"""g AS (SELECT p, count(*) AS n, sum(label) AS pos FROM ({rows}) GROUP BY 1), k AS (SELECT p, n, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM g WINDOW w AS (ORDER BY p ROWS UNBOUNDED PRECEDING)),
starts AS (SELECT i AS a, cn - n AS bn, cp - (SELECT pos FROM g WHERE g.p = k.p) AS bp FROM k), spans AS (SELECT a, k.i AS b, (cp - bp) / (cn - bn) AS mean FROM starts JOIN k ON k.i >= a),
floors AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS least FROM spans), curve AS (SELECT p, n, (SELECT max(least) FROM floors WHERE b = i AND a <= i) AS y FROM k)"""


@register("isotonic_calibration", f"WITH {SCORES_SQL}, {_pav_sql('SELECT p_text AS p, label FROM scores')} SELECT round(p, 9) AS p, n, round(y, 9) AS calibrated FROM curve")
def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated value of every distinct score, fitted on all of them."""
    df = _p(spark, sf_dir)
    blocks = calibrate.isotonic_blocks(df)
    return rounded(df.groupBy("p").agg(F.count("*").alias("n")).withColumn("calibrated", calibrate.calibrated(blocks, F.col("p"))))


@register("calibration_gain", f"""WITH {SCORES_SQL}, held AS (SELECT label, p_text AS p, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) - 1 < floor(count(*) OVER (PARTITION BY label) * 0.4 + 0.5) AS is_holdout FROM scores), {_pav_sql('SELECT * FROM held WHERE is_holdout')},
rest AS (SELECT label, h.p, lo.p AS lo, lo.y AS lo_y, hi.p AS hi, hi.y AS hi_y FROM (SELECT * FROM held WHERE NOT is_holdout) h ASOF LEFT JOIN curve lo ON h.p >= lo.p ASOF LEFT JOIN curve hi ON h.p <= hi.p),
turned AS (SELECT 'before' AS score, label, p FROM rest UNION ALL SELECT 'after', label, CASE WHEN lo IS NULL THEN hi_y WHEN hi IS NULL OR hi = lo THEN lo_y ELSE lo_y + (hi_y - lo_y) * (p - lo) / (hi - lo) END FROM rest),
b AS (SELECT score, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS p, avg(label) AS y FROM turned GROUP BY 1, 2), e AS (SELECT score, sum(n * abs(p - y)) / sum(n) AS ece FROM b GROUP BY 1)
SELECT score, round(avg(CASE WHEN label = 1 THEN -ln(q) ELSE -ln(1 - q) END), 6) AS log_loss, round(avg((p - label) * (p - label)), 6) AS brier, round(avg(p), 6) AS mean_p, round(any_value(ece), 6) AS ece FROM (SELECT *, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM turned) JOIN e USING (score) GROUP BY 1""")
def calibration_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error and log loss before and after a fit on a disjoint holdout."""
    return rounded(calibrate.calibration_gain(splits.holdout(_p(spark, sf_dir), 0.4)), 6)


MI_SQL = f"""info AS (SELECT label AS y, coalesce(subreddit, 'nan') AS category, hour(ts)::varchar AS hour, (isodow(ts) - 1)::varchar AS weekday, year(ts)::varchar AS year, (NOT removed)::varchar AS has_body, {BUCKET_SQL.format("length(coalesce(body, ''))")}::varchar AS body_length_bucket,
  CASE WHEN upvotes IS NOT NULL THEN greatest(len(list_filter(up, lambda x: x < upvotes)) - 1, 0)::varchar END AS upvotes_bucket, CASE WHEN num_comments IS NOT NULL THEN greatest(len(list_filter(com, lambda x: x < num_comments)) - 1, 0)::varchar END AS num_comments_bucket
  FROM (SELECT *, to_timestamp(created_utc) AT TIME ZONE 'UTC' AS ts, {sql_removed('body')} AS removed FROM posts), (SELECT list_distinct(quantile_cont(upvotes::double, [{', '.join(f'{i / 10}' for i in range(11))}])) AS up, list_distinct(quantile_cont(num_comments::double, [{', '.join(f'{i / 10}' for i in range(11))}])) AS com FROM posts)),
mi_long AS (UNPIVOT (SELECT * FROM info WHERE y IS NOT NULL) ON category, hour, weekday, year, has_body, body_length_bucket, upvotes_bucket, num_comments_bucket INTO NAME feature VALUE x), mi_c AS (SELECT feature, x, y, count(*) AS c FROM mi_long GROUP BY 1, 2, 3),
mi_p AS (SELECT feature, c / sum(c) OVER (PARTITION BY feature) AS p, sum(c) OVER (PARTITION BY feature, x) / sum(c) OVER (PARTITION BY feature) AS px, sum(c) OVER (PARTITION BY feature, y) / sum(c) OVER (PARTITION BY feature) AS py FROM mi_c),
mi AS (SELECT feature, round(sum(p * log2(p / (px * py))), 9) AS mutual_information FROM mi_p GROUP BY 1)"""


@register("information_ranking", f"WITH {POSTS_SQL}, {MI_SQL} SELECT feature, mutual_information, row_number() OVER (ORDER BY mutual_information DESC, feature)::int AS place FROM mi")
def information_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.information_ranking(posts(spark, sf_dir)))


def _metrics_sql() -> str:
    """The profile as (metric, key, value), and the rules as values."""
    pair = f"{_words_sql(chr(39) * 2 + ' || coalesce(title, ' + chr(39) * 2 + ')')} + {_words_sql(chr(39) * 2 + ' || coalesce(body, ' + chr(39) * 2 + ')')}"
    common = ", ".join(repr(x) for x in lexicons.COMMON_ENGLISH)
    english = f"""CASE WHEN length(body) < 10 THEN true WHEN length(regexp_replace(body, '[^\\x00-\\x7F]', '', 'g')) / length(body) < 0.85 THEN false WHEN len(b50) = 0 THEN true ELSE len(list_filter(b50, lambda x: x IN ({common}))) / len(b50) >= 0.05 END"""
    lift = lambda s: f"(SELECT (avg({s}) FILTER (label = 1)) / nullif(avg({s}) FILTER (label = 0), 0) FROM sig)"
    rules = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in (i, signals.SEVERITIES.index(r[1]), *r)) + ")" for i, r in enumerate(signals.INSIGHT_RULES))
    return f"""{SIGNAL_SQL}, {MI_SQL}, g AS (SELECT md5({sql_form('body')}) AS hash, count(*) AS n FROM posts WHERE length(body) >= 40 GROUP BY 1 HAVING count(*) > 1),
lang AS (SELECT *, {WORDS_SQL.format('body')}[1:50] AS b50 FROM posts), yr AS (SELECT avg(label) AS r FROM posts WHERE label IS NOT NULL GROUP BY year(to_timestamp(created_utc) AT TIME ZONE 'UTC') HAVING count(*) >= 10),
cell AS (SELECT avg(label) AS r FROM posts WHERE label IS NOT NULL GROUP BY isodow(to_timestamp(created_utc) AT TIME ZONE 'UTC'), hour(to_timestamp(created_utc) AT TIME ZONE 'UTC') HAVING count(*) >= 2),
leaks AS (SELECT avg(label) AS r FROM posts WHERE label IS NOT NULL GROUP BY subreddit HAVING count(*) >= 5 AND (r >= 0.98 OR r <= 0.02)),
m(metric, key, value) AS (
 SELECT 'english_pct', '', count_if({english}) * 100.0::double / count(body) FROM lang UNION ALL
 SELECT 'url_only', '', count_if(coalesce(body, '') <> '' AND len(regexp_extract_all(body, '[a-zA-Z]{{2,}}')) <= 2 AND regexp_matches(body, 'https?://\\S+|www\\.\\S+')) FROM posts UNION ALL
 SELECT 'minority_pct', '', least(count_if(label = 1), count_if(label = 0)) * 100.0::double / count(label) FROM posts UNION ALL
 {' UNION ALL '.join(f"SELECT 'coverage_{n}', '', count_if({pair} <= {n}) * 100.0::double / count(*) FROM posts" for n in (256, 384, 512))} UNION ALL
 SELECT 'keyword_lift', '', {lift('has_keyword')} UNION ALL SELECT 'first_person_lift', '', {lift('first_person_rate')} UNION ALL
 SELECT 'duplicate_pct', '', (SELECT coalesce(sum(n - 1), 0) FROM g) * 100.0::double / count(*) FROM posts UNION ALL SELECT 'n_leaky', '', count(*) FROM leaks UNION ALL
 SELECT 'label_drift', '', max(r) - min(r) FROM yr UNION ALL SELECT 'grid_range', '', max(r) - min(r) FROM cell UNION ALL
 (SELECT 'best_feature_bits', feature, mutual_information FROM mi ORDER BY mutual_information DESC, feature LIMIT 1)),
rules(place, rank, chain, severity, metric, from_, over_, upto, under, text) AS (VALUES {rules})"""


@register("profile_metrics", f"WITH {_metrics_sql()} SELECT metric, key, round(value, 6) AS value FROM m")
def profile_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.profile_metrics(posts(spark, sf_dir), 5, 10, 2), 6).select("metric", "key", "value")


@register("insights", f"""WITH {_metrics_sql()} SELECT severity, chain, m.metric, key, round(value, 6) AS value, text FROM m JOIN rules USING (metric) WHERE value IS NOT NULL AND coalesce(value >= from_, true) AND coalesce(value > over_, true) AND coalesce(value <= upto, true) AND coalesce(value < under, true)
QUALIFY row_number() OVER (PARTITION BY chain ORDER BY place) = 1 ORDER BY rank, place""")
def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the profile of the posts says, from a metrics store that the rules read."""
    store = f"{scratch_dir(spark).rstrip('/')}/metrics-{uuid.uuid4().hex}"
    write_metrics(signals.profile_metrics(posts(spark, sf_dir), 5, 10, 2), store)
    return rounded(signals.insights(read_table(spark, store)), 6)


@register("encoded_pairs", f"""WITH {POSTS_SQL}, t AS (SELECT unnest({WORDS_SQL.format('text')}) AS term FROM documents), c AS (SELECT term, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 2), v AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) + 3 AS term_id FROM c ORDER BY n DESC, term LIMIT 4996),
names AS (SELECT map(list(term), list(term_id)) AS ids FROM v), w AS (SELECT id, list_transform({WORDS_SQL.format("coalesce(title, '')")}, lambda x: coalesce(ids[x], 1)) AS a, list_transform({WORDS_SQL.format("coalesce(body, '')")}, lambda x: coalesce(ids[x], 1)) AS b FROM posts, names),
s AS (SELECT id, list_concat(list_concat(a, [3]), b)[1:128] AS x, least(len(a) + 1, 128) AS n_a FROM w)
SELECT id, md5(array_to_string(list_concat(x, list_transform(range(128 - len(x)), lambda i: 0)), ' ')) AS input_ids, len(x)::int AS n_ids, n_a::int AS n_title, len(list_filter(x, lambda i: i = 1))::int AS n_unknown FROM s""")
def encoded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and body words as ids of one length; digests and counts of ids, mask and segments."""
    vocab = tokens.vocabulary(table(spark, sf_dir, "documents").select(simple_words(F.col("text")).alias("w")), "w", 5000)
    rows = posts(spark, sf_dir).select("id", *(simple_words(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "body")))
    found = tokens.encoded_pairs(rows, vocab, "title", "body", 128)
    total = lambda c, keep: F.size(F.filter(c, keep))
    n = total("attention_mask", lambda m: m == 1)
    n_title = n - total("segment_ids", lambda x: x == 1)
    return found.select("id", F.md5(F.array_join(F.col("input_ids").cast("array<string>"), " ")).alias("input_ids"), n.alias("n_ids"), n_title.alias("n_title"), total("input_ids", lambda i: i == 1).alias("n_unknown"))


@register("event_stream", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1")
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream, repeats of an id dropped within a watermark, written by a checkpointed sink and read back.

    The stream's path is a pattern, as a table may be one file, which a stream does not take as its folder.
    """
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{scratch_dir(spark).rstrip('/')}/events-{uuid.uuid4().hex}"
    distinct_stream(events, ["event_id"], "ts", "10000 days", f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")), 4)


@register("importance_share", "SELECT event_type AS feature, sum(value) AS gain, round(sum(value) / sum(sum(value)) OVER (), 9) AS share FROM events GROUP BY 1".replace("sum(value) AS gain", "round(sum(value), 4) AS gain"))
def importance_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type's share of all value."""
    gains = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("feature")).agg(F.sum("value").alias("gain"))
    return evaluate.normalised_importance(gains).select("feature", F.round("gain", 4).alias("gain"), F.round("share", 9).alias("share"))
