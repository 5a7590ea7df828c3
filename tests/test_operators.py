import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstone.operators import assemble, clean, evaluate, extract, profile, relations, signals, splits, tokens
from quillstone.sources.posts import posts
from tests.conftest import SMALL

POST = "id string, subreddit string, title string, body string, upvotes int, created_utc bigint, num_comments int, label int"


@pytest.fixture(scope="module")
def some(spark):
    long = "the same body in more than forty characters"
    rows = [
        ("1", "A", "t", long, 5, 1500000005, 1, 1), ("2", " a ", "T", long.upper() + " ", -5, 1500000003, None, 0), ("3", "b", "t", "short", 1, 1500000000, 2, 1), ("4", "b", "t", "short", 1, 1500000000, 2, 1),
        ("5", "c", "t", "x", 1, 1, 0, 1), ("6", None, "[deleted]", "[removed]", 1, 1500000000, 0, 0), (None, "a", "t", "b", 1, 1500000000, 0, 0), ("7", "a", "", "deleted", 9, 1500000000, 0, 1), ("1", "A", "t", "later copy of the id", 5, 1600000005, 1, 1),
    ]
    return spark.createDataFrame(rows, POST)


def test_clean_posts(some):
    rows = {r.id: r for r in clean.clean_posts(some).collect()}
    assert set(rows) == {"2", "3", "4", "6"}  # of the two long ones the older stays, both short ones do
    assert rows["2"].subreddit == "a" and rows["2"].upvotes == 0 and rows["2"].num_comments == 0
    assert not rows["6"].has_body and rows["6"].subreddit == "nan"
    a = clean.audit(some).first()
    assert (a.n_rows, a.no_key, a.bad_time, a.body_removed, a.comments_negative) == (9, 1, 1, 2, 0)


def test_clean_empty(some):
    assert clean.clean_posts(some.limit(0)).count() == 0


def test_duplicate_ids_counts_nulls_as_equal(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "id string")
    assert clean.duplicate_ids(df).first().duplicates == 2


def test_quantile_and_skewness(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 10, 50)], "x double")
    r = profile.numeric_summary(df, ["x"]).first()
    assert abs(r.skewness - 2.3022814) < 1e-6 and abs(r.p995 - 49.0) < 1e-9


def test_splits_are_exact(spark):
    df = posts(spark, SMALL).select("id", "label")
    n = Counter(r.label for r in df.collect())
    got = Counter((r.label, r.random_split) for r in splits.stratified_split(df, {"val": 0.1, "test": 0.1}).collect())
    for label, size in n.items():
        assert got[label, "val"] == got[label, "test"] == math.floor(size * 0.1 + 0.5)
    folds = Counter((r.label, r.fold) for r in splits.stratified_folds(df, 3).collect())
    for label in n:
        sizes = [folds[label, k] for k in range(3)]
        assert max(sizes) - min(sizes) <= 1
    subsets = splits.eval_subsets(df.where("label is not null"), 20, 20).collect()
    assert len({r.id for r in subsets}) == len(subsets) and abs(sum(r.subset == 1 for r in subsets) - 20) <= 2
    kept = splits.undersample_negatives(df.where("label is not null"), 0.5).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in kept} == {1: n[1], 0: math.floor(n[0] * 0.5)}
    assert splits.sample_n(df, 10).collect() == splits.sample_n(df, 10).collect() and splits.sample_n(df, 10**6).count() == df.count()
    assert sum(r.is_holdout for r in splits.holdout(df.where("label is not null"), 0.05).collect()) == sum(math.floor(n[k] * 0.05 + 0.5) for k in (0, 1))


def test_folds_outside_train(spark):
    df = posts(spark, SMALL).select("id", "label")
    out = splits.stratified_folds(df, 3, train=F.col("id").cast("int") % 2 == 0).collect()
    assert all((r.fold == -1) == (int(r.id) % 2 == 1) for r in out)


def python_head_tail(title, body, max_length, share=0.35):
    room = max_length - 4
    title = title[: max(8, room // 2)]
    budget = room - len(title)
    if len(body) > budget:
        if budget <= 5:
            body = body[:budget]
        else:
            head = max(1, int((budget - 1) * share))
            body = body[:head] + ["..."] + body[-max(1, budget - 1 - head) :]
    return (["<s>", *title, "</s>", "</s>", *body, "</s>"])[:max_length]


@pytest.mark.parametrize("max_length", [12, 16, 40, 64])
def test_head_tail(spark, max_length):
    cases = [(list("ab"), [str(i) for i in range(n)]) for n in (0, 1, 5, 30, 100)] + [([str(i) for i in range(90)], list("xyz") * 9), ([], [])]
    df = spark.createDataFrame(cases, "a array<string>, b array<string>")
    assert [r.s for r in df.select(tokens.head_tail(F.col("a"), F.col("b"), max_length).alias("s")).collect()] == [python_head_tail(a, b, max_length) for a, b in cases]


def test_token_arrays(spark):
    df = spark.createDataFrame([("d", ["a", "b", "a", "z"]), ("e", [])], "id string, w array<string>")
    vocab = tokens.vocabulary(df, "w", 100, 2)
    assert {r.term: r.term_id for r in vocab.collect()} == {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "a": 4}
    assert {r.id: r.ids for r in tokens.to_ids(df, "id", "w", vocab).collect()} == {"d": [4, 1, 4, 1], "e": []}
    cols = tokens.fixed_length(F.array(*(F.lit(i) for i in (5, 6, 7))), F.lit(2), 5)
    r = spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()
    assert (r.input_ids, r.attention_mask, r.segment_ids) == ([5, 6, 7, 1, 1], [1, 1, 1, 0, 0], [0, 0, 1, 0, 0])
    cut = tokens.cut_by_ratio(F.array(*(F.lit(i) for i in range(10))), 4, 0.5)
    assert spark.range(1).select(cut.alias("c")).first().c == [0, 1, 8, 9]


def test_metrics(spark):
    counts = spark.createDataFrame([(151038, 6307, 1872, 53465)], "tn long, fp long, fn long, tp long")
    assert round(evaluate.with_metrics(counts).first().f1_macro, 4) == 0.9513
    zero = spark.createDataFrame([(3, 0, 0, 0)], "tn long, fp long, fn long, tp long")
    assert evaluate.with_metrics(zero).first().f1_pos == 0
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (0, 0.8)], "label int, p double")
    r = evaluate.areas(df).first()
    assert abs(r.pr_auc - 0.5) < 1e-9 and abs(r.roc_auc - 3.5 / 6) < 1e-9
    assert evaluate.areas(df.where("label = 1")).first().roc_auc is None
    moved = evaluate.areas(df.withColumn("p", F.exp("p") * 7)).first()
    assert abs(moved.roc_auc - r.roc_auc) < 1e-12
    swept = evaluate.threshold_sweep(df, 0.05, 0.95, 91).collect()
    for s in swept:
        assert (s.tp, s.fp) == (sum(y == 1 and p >= s.threshold for y, p in ((0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (0, 0.8))), sum(y == 0 and p >= s.threshold for y, p in ((0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (0, 0.8))))
    best = evaluate.best_threshold(df).first()
    assert best.threshold == min(s.threshold for s in swept if abs(s.f1_macro - max(x.f1_macro for x in swept)) < 1e-12)
    assert evaluate.recall_at_precision(df, 0.5).first().recall == 1.0 and evaluate.precision_at_recall(df, 0.9).first().precision == 0.5
    assert evaluate.reliability(df, 2).agg(F.sum("n")).first()[0] == 5
    assert evaluate.metrics_matrix(df.withColumn("split", F.lit("a")), ("split",)).count() == 2


def test_assembly(spark):
    a = spark.createDataFrame([(1, 0.2), (2, 0.4)], "id int, p_text double")
    b = spark.createDataFrame([(2, 0.8), (3, None)], "id int, p_text double")
    assert {r.id: r.p_text for r in assemble.mean_of_folds([a, b]).collect()} == {1: 0.2, 2: pytest.approx(0.6), 3: None}
    assert {r.id: r.p_text for r in assemble.first_source([a, b]).collect()} == {1: 0.2, 2: 0.4, 3: None}
    assert {(r.id, r.fold, r.n_seen) for r in assemble.out_of_fold([a, b]).collect()} == {(1, 0, 1), (2, 0, 2), (2, 1, 2), (3, 1, 1)}
    kept, lost = assemble.attach_scores(spark.createDataFrame([(1, "val"), (9, "test")], "id int, time_split string"), a)
    assert kept.count() == 1 and lost.collect()[0].n_missing == 1
    bad = spark.createDataFrame([(1, 0.1), (0, 0.9)], "label int, p_text double")
    with pytest.raises(Exception, match="do not follow"):
        assemble.alignment_gap(bad, 0.05).collect()
    r = assemble.repeated_scores(spark.createDataFrame([("x", 1, 0.4), ("x", 2, 0.6)], "id string, run int, score double")).first()
    assert r["mean"] == pytest.approx(0.5) and r.confidence == pytest.approx(0.8)
    assert assemble.prediction_summary(bad).first().accuracy == 0.0


def test_relations(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 0, "a"), (3, 1, "b"), (3, 1, "b"), (5, None, "b")], "x int, label int, c string")
    assert relations.mutual_information(df, ["c"]).first().mutual_information >= 0
    assert relations.pearson(df.withColumn("x", F.lit(1)), ["x"]).first().pearson is None
    assert relations.label_rate_on_grid(df, F.col("x"), 6, "x").count() == 6
    binned = relations.quantile_bins(spark.range(100).select(F.col("id").alias("v")), "v", 10)
    assert [r["count"] for r in binned.groupBy("bin").count().orderBy("bin").collect()] == [10] * 10


def test_signals(spark):
    df = spark.createDataFrame([("a", "dog dog cat"), ("b", "cat cat fox"), (None, "none")], "g string, t string")
    counts = signals.term_counts(df, "g", "t")
    assert Counter({(r.g, r.term): r.n for r in counts.collect()}) == {("a", "dog"): 2, ("a", "cat"): 1, ("b", "cat"): 2, ("b", "fox"): 1}
    top = signals.distinctive_terms(counts, "g", "a", "b", min_frequency=1).collect()
    assert [t.term for t in top][0] == "dog" and all(t.z < 0 for t in top[1:])
    metrics = spark.createDataFrame([("english_pct", 80.0), ("keyword_lift", 4.2), ("label_drift", 0.05)], "metric string, value double")
    assert [(r.severity, r.metric) for r in signals.insights(metrics).collect()] == [("CRITICAL", "english_pct"), ("GOOD", "keyword_lift")]
    p = posts(spark, SMALL)
    assert signals.label_mismatches(p, 5).groupBy("label").count().where("count > 5").count() == 0
    assert signals.noise(p).first().n_rows == p.count()


def test_extraction(spark):
    page = """<meta property="og:title" content="A &amp; B"><meta content='Body text' property='og:description'>"reaction_count":{"count":12} "comment_rendering_instance":{"comments":{"total_count":5}} "creation_time":1500000000
<div class="score unvoted" id=s title="31"> <span data-comments-count="7" data-timestamp="1600000000000">"""
    filled = """<meta property="og:description" content="x">"""
    bare = "<title> Plain\n title </title><article><p>One</p> two</article>"
    rows = [("https://old.forum.org/x", page), ("https://m.facebook.com/y", page), ("https://z.org", page), ("https://notforum.org/", page), ("https://z.org", bare), (None, None), (None, filled)]
    a, b, other, c, d, e, f = extract.scraped_posts(spark.createDataFrame(rows, "url string, html string"), forums=("forum.org",)).collect()
    assert (a.title, a.body, a.upvotes, a.num_comments, a.created_utc) == ("A & B", "Body text", 31, 7, 1600000000)
    assert (b.title, b.upvotes, b.num_comments, b.created_utc) == (None, 12, 5, 1500000000)
    assert [(x.upvotes, x.num_comments, x.created_utc) for x in (other, c)] == [(None, None, None)] * 2
    assert (d.title, d.body) == ("Plain title", "One two") and e.title is None
    assert [x.has_content for x in (a, d, e, f)] == [False, False, False, True]
    url = extract.normal_forum_url(F.lit("https://www.forum.com/r/x"), "forum.com", "old.forum.com")
    assert spark.range(1).select(url.alias("u")).first().u == "https://old.forum.com/r/x"


def test_models(spark):
    from quillstone.operators import models

    p = splits.stratified_folds(posts(spark, SMALL).where("label is not null"))
    scored = models.fold_scores(p, 3, features=1 << 10, iterations=5)
    assert scored.count() == p.count() and scored.where("p_text between 0 and 1 and n_seen = 1").count() == p.count()
    data = splits.holdout(p.withColumns({"a": F.length("body"), "b": F.col("upvotes") % 7}).na.fill(0), 0.2)
    model = models.fit_meta(data, ["a", "b"], trees=3, depth=2)
    out = models.meta_scores(model, data, ["a", "b"])
    gains = evaluate.normalised_importance(models.importance(spark, model, ["a", "b"])).collect()
    assert {r.feature for r in gains} == {"a", "b"} and abs(sum(r.share for r in gains) - 1) < 1e-6
    assert models.full_scores(p.where("fold > 0"), p.where("fold = 0"), features=1 << 10, iterations=3).where("p_text between 0 and 1").count() == p.where("fold = 0").count()
    tuned = models.tune_meta(data, ["a", "b"], {"maxDepth": [1, 2], "maxIter": [2]})
    assert len(tuned.avgMetrics) == 2 and all(0 <= m <= 1 for m in tuned.avgMetrics)
    fitted, rest = (out.join(data.where(F.col("is_holdout") == x).select("id"), "id") for x in (True, False))
    assert models.isotonic(fitted, rest).where("calibrated between 0 and 1").count() == rest.count() > 0


def test_posts_hold_the_whole_text(spark):
    from quillstone.sources.posts import posts
    from tests.conftest import SMALL

    texts = {str(r.doc_id): r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in posts(spark, SMALL).collect():
        assert r.title + ("\n" + r.body if "\n" in texts[r.id] else "") == texts[r.id]


def test_older_table_and_scatter_sample(spark):
    from quillstone.operators import clean, profile

    older = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 0, "y"), (3, "b", 7, "z"), (4, None, 0, "z"), (5, "c", None, "z")], "k int, text string, class int, other string")
    made = clean.binary_labels(clean.text_and_label(older, ("k",)))
    assert made.columns == ["k", "text", "label"] and {r.k for r in made.collect()} == {1, 2, 4}
    assert {tuple(r) for r in clean.duplicates_by_label(made, ("k",)).collect()} == {(1, 1, 0), (0, 1, 1)}
    rows = spark.createDataFrame([(i, i % 2, None if i == 3 else i - 5, 0) for i in range(20)], "id int, label int, upvotes int, num_comments int")
    got = profile.scatter_sample(rows, 10).collect()
    assert len(got) == 10 and all(r.upvotes == max(1, (r.id - 5) if r.id != 3 else 1) and r.num_comments == 1 for r in got)


def test_slices(spark):
    df = spark.createDataFrame([("a", "train", 0), ("b", "train", 1), ("c", "val", -1), ("d", None, None)], "id string, time_split string, fold int")
    assert [r.id for r in splits.split_slice(df, "val").collect()] == ["c"]
    train, held_out = splits.fold_slices(df, 1)
    assert [r.id for r in train.collect()] == ["a"] and [r.id for r in held_out.collect()] == ["b"]
