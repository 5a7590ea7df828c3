"""What has to hold at any size: ranks in ranges, partial aggregation, plans without a task for everything."""

import html
from html.entities import html5

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions.text import unescape_entities
from quillstone.operators import calibrate, clean, evaluate, ranks, splits, tokens, topk
from quillstone.plans.queries import QUERIES
from quillstone.sources import files
from quillstone.sources.posts import posts
from quillstone.streaming.score import distinct_stream
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    kinds = {
        "tail": (rng.pareto(0.5, 3000) * 10).tolist(), "ties": rng.integers(0, 7, 3000).astype(float).tolist(), "one": [5.0] * 50, "two": [1.0, 2.0], "single": [3.5],
        "cluster": [0.0] * 10 + (1000 + rng.random(2000) * 1e-6).tolist(), None: rng.normal(size=500).tolist(),
    }
    return kinds, spark.createDataFrame([(k, v) for k, vs in kinds.items() for v in [*vs, None]], "g string, v double").repartition(7)


def test_quantiles(values):
    kinds, df = values
    of = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.995, "e": 1.0}
    got = {r.g: r for r in ranks.quantiles_of(df, "v", of, ["g"]).collect()}
    assert set(got) == set(kinds)
    for g, vs in kinds.items():
        assert [got[g][k] for k in of] == pytest.approx(np.quantile(vs, list(of.values())).tolist(), rel=1e-12, abs=1e-12)
    whole = ranks.quantiles_of(df, "v", of).first()
    assert [whole[k] for k in of] == pytest.approx(np.quantile([v for vs in kinds.values() for v in vs], list(of.values())).tolist(), rel=1e-12, abs=1e-12)
    assert list(ranks.quantiles_of(df.where("false"), "v", of).first()) == [None] * 5 and ranks.quantiles_of(df.where("false"), "v", of, ["g"]).count() == 0


def test_running_sums(values):
    kinds, df = values
    got = ranks.running_sums(ranks.counted(df, ["g"], "v"), ["g"], "v", ["c"]).collect()
    for r in got:
        vs = np.array(kinds[r.g])
        assert (r.c_below, r.c, r.c_total) == ((vs < r.v).sum(), (vs == r.v).sum(), len(vs))
    assert len(got) == sum(len(set(vs)) for vs in kinds.values())


def test_ranges_are_small(spark):
    """Whatever the distribution, a range holds a small share of the distinct values."""
    df = spark.range(40_000).select((F.exp(F.col("id") / 900.0)).alias("v"))
    sizes = [r["count"] for r in ranks.ranged(ranks.counted(df, [], "v"), [], "v").groupBy("range").count().collect()]
    assert max(sizes) < 40_000 / 20 and len(sizes) > 100


@pytest.mark.parametrize("name", ["numeric_summary", "clean_posts", "histogram", "box_by_group", "decile_rates", "means_by_label", "length_summary", "engagement_ratio"])
def test_no_map_of_all_values(spark, name):
    assert "percentile(" not in plan(QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("name", ["areas", "spearman", "metrics_matrix", "concentration", "curve_points", "mutual_information"])
def test_no_window_over_everything(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for line in text.split("== Optimized Logical Plan ==")[-1].splitlines():
        assert "windowspecdefinition" not in line or "range" in line


def test_posts_run_in_the_jvm(spark):
    for name in ("clean_posts", "clean_text_all", "score_posts", "meta_features"):
        assert "ArrowEvalPython" not in plan(QUERIES[name](spark, SMALL))


def test_first_rows_of_a_hot_key(spark):
    rows = spark.range(1_000_000).select("id", F.lit("one text that a million rows have, word for word").alias("text")).unionByName(spark.createDataFrame([(-1, "another"), (-2, None), (-3, None)], "id long, text string"))
    out = clean.dedup_exact(rows)
    assert "Window" not in plan(out)
    assert {(r.id, r.text) for r in out.collect()} == {(0, "one text that a million rows have, word for word"), (-1, "another"), (-3, None)}
    got = topk.smallest(rows.select(F.length("text").alias("k"), "id"), ["k"], ["id"], 3).collect()
    assert sorted((str(r.k), r.place, r.id) for r in got) == sorted([("48", i + 1, i) for i in range(3)] + [("7", 1, -1), ("None", 1, -3), ("None", 2, -2)])


def test_entities_equal_the_standard(spark):
    cases = [f"a &{k} b" for k in html5] + [f"&{k}x;" for k in html5] + [f"&{k.rstrip(';')}=1" for k in html5]
    numbers = [0, 1, 8, 9, 10, 11, 13, 31, 32, 127, 128, 129, 141, 159, 160, 255, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**7 - 1, 10**30]
    cases += [c for n in numbers for c in (f"&#{n};", f"&#{n}", f"&#x{n:x};", f"&#X{n:X} z", f"&#00000000{n};")]
    cases += ["", "&", "&&", "&;", "&amp;amp;", "&#;", "&#x;", "a&b&c", "&notit;", "&notin;", "&AMP", "&" + "a" * 40 + ";", "&lt&gt", "&é;", "&\n", "x&#65&#66;y", "&#٥;", "&😀;lt;"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, c string")
    got = {r.i: r.v for r in df.select("i", unescape_entities(F.col("c")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [html.unescape(c) for c in cases]
    assert spark.sql("select cast(null as string) as c").select(unescape_entities(F.col("c"))).first()[0] is None


def brute_isotonic(points):
    """Pooling from left to right over (score, label)."""
    blocks = []
    for p in sorted({p for p, _ in points}):
        ys = [y for q, y in points if q == p]
        blocks.append([sum(ys), len(ys), [p]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, ps = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + ps]
    return {p: s / n for s, n, ps in blocks for p in ps}


@pytest.mark.parametrize("parts", [1, 5])
def test_isotonic(spark, parts):
    rng = np.random.default_rng(parts)
    points = [(float(p), int(rng.random() < p**2)) for p in np.round(rng.random(700), 3)]
    df = spark.createDataFrame([*points, (None, 1), (0.5, None)], "p double, label int").repartition(parts)
    blocks = calibrate.isotonic_blocks(df)
    got = {r.p: r.y for r in df.where("p is not null").select("p", calibrate.calibrated(blocks, F.col("p")).alias("y")).distinct().collect()}
    want = brute_isotonic(points)
    assert all(got[p] == pytest.approx(y) for p, y in want.items())
    ordered = [got[p] for p in sorted(got)]
    assert all(a <= b + 1e-12 for a, b in zip(ordered, ordered[1:], strict=False))
    ends = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "p double").select(calibrate.calibrated(blocks, F.col("p")).alias("y")).collect()
    assert [r.y for r in ends] == [min(want.values()), max(want.values()), None]


def test_category_folds(spark):
    p = posts(spark, SMALL)
    rows = splits.category_folds(p, "subreddit", 3, 4).collect()
    assert len(rows) == len({r.subreddit for r in rows}) == p.select("subreddit").distinct().count()
    sizes = [sum(r.n for r in rows if r.fold == f) for f in range(3)]
    assert sum(sizes) == p.count() and max(sizes) - min(sizes) <= 4 * max(r.n for r in rows)


def test_curve_points_keep_the_area(spark):
    df = spark.createDataFrame([(int(i % 3 == 0 or i > 60), (i // 4) / 30) for i in range(100)], "label int, p double")
    whole, corners = ([(0.0, 0.0), *sorted((r.fpr, r.tpr) for r in f(df).collect())] for f in (evaluate.curve, evaluate.curve_points))
    area = lambda c: np.trapezoid([y for _, y in c], [x for x, _ in c])
    assert len(corners) < len(whole) and corners[-1] == (1.0, 1.0)
    assert area(corners) == pytest.approx(area(whole)) == pytest.approx(evaluate.areas(df).first().roc_auc)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_ids_keep_rows_apart(spark, most):
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "term string, term_id int")
    rows = [("k", ["a", "b", "z"]), ("k", ["b"]), (None, ["a"]), (None, []), ("n", None), ("m", ["a", None, "a"])]
    got = tokens.to_ids(spark.createDataFrame(rows, "k string, w array<string>"), "k", "w", vocab, most=most).collect()
    assert sorted((str(r.k), str(r.ids)) for r in got) == sorted([("k", "[4, 5, 1]"), ("k", "[5]"), ("None", "[4]"), ("None", "[]"), ("n", "None"), ("m", "[4, 1, 4]")])
    assert tokens.to_ids(spark.createDataFrame([], "k string, w array<string>"), "k", "w", vocab, most=most).count() == 0


def test_cached_tables_are_keyed_and_committed(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    folder, tokenizer = tmp_path / "cache", tmp_path / "tokenizer.txt"

    def table(words, length=128):
        tokenizer.write_text(words)
        return files.cached(spark, str(folder), make, tokenizer=files.content_hash_of(spark, str(tokenizer)), length=length)

    assert table("a b").count() == table("a b").count() == 3 and len(made) == 1
    (first,) = folder.iterdir()
    table("a b c")  # another tokenizer, or other parameters, are another table
    table("a b", 64)
    assert len(made) == 3
    (first / "_SUCCESS").unlink()  # a crash between write and commit
    assert table("a b").count() == 3 and len(made) == 4
    assert table("a b").count() == 3 and len(made) == 4
    with pytest.raises(ZeroDivisionError):
        files.cached(spark, str(folder), lambda: 1 // 0, other=1)
    before = files.fingerprint(spark, str(folder))
    (folder / "more").write_text("x")
    assert files.fingerprint(spark, str(folder)) != before


def test_stream_started_again_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i % 40, i) for i in range(60)], "event_id long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_600_000_000))
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        events = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        distinct_stream(events, ["event_id"], "ts", "1 day", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 40
    rows.withColumn("event_id", F.col("event_id") + 20).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    distinct_stream(events, ["event_id"], "ts", "1 day", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def _scans(spark, run, name):
    """How many of the plans that ``run`` executes, or writes, read the table ``name``; by its files' access through materialised and actions."""
    from quillstone.operators import relations, signals, tokens

    plans = []
    with pytest.MonkeyPatch.context() as patch:
        for module in (relations, signals, tokens):
            own = module.materialised
            patch.setattr(module, "materialised", lambda df, title, own=own: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, title))
        out = run()
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    return sum(p.count(f"{name}.parquet") for p in plans)


@pytest.mark.parametrize(("query", "most"), [("profile_metrics", 1), ("insights", 1), ("information_ranking", 1), ("encoded_pairs", 2)])
def test_texts_are_read_once(spark, query, most):
    """The profile reads documents once; encoded pairs once for the vocabulary and once for the ids."""
    assert _scans(spark, lambda: QUERIES[query](spark, SMALL), "documents") <= most


def test_vocabulary_is_counted_once(spark, monkeypatch):
    """Both look-ups of encoded pairs read a written vocabulary, of arrays no longer than the result's."""
    seen = []
    own = tokens._looked_up
    monkeypatch.setattr(tokens, "_looked_up", lambda df, words, terms, unknown, out: seen.append((df, words, plan(terms))) or own(df, words, terms, unknown, out))
    QUERIES["encoded_pairs"](spark, SMALL)
    assert len(seen) == 2 and all("vocabulary-" in p and "documents.parquet" not in p for _, _, p in seen)
    assert seen[0][0].agg(F.max(F.size("body"))).first()[0] == 128


def test_text_counts_as_before(spark):
    rows = [("",), (None,), (" a b\tc ",), (" ",), ("Depressed",), ("x  y\nz",), ("I am the one; you're not",)]
    from quillstone.functions.text import has_stem, strip, word_count

    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", word_count(F.col("t")).alias("n"), strip(F.col("t")).alias("s"), has_stem(F.col("t"), ("depress", r"y.?z", "a b")).alias("h")).collect()
    for r in got:
        assert r.n == len((r.t or "").split()) and r.s == (None if r.t is None else r.t.strip())
        assert r.h == (None if r.t is None else "depress" in r.t.lower() or "a b" in r.t.lower())


def test_folds_read_term_frequencies(spark, monkeypatch):
    """No fold's fit reads words: their frequencies are written once."""
    from quillstone.operators import models

    seen = []
    own = models.materialised
    monkeypatch.setattr(models, "materialised", lambda df, title: seen.append(df.columns) or own(df, title))
    rows = spark.createDataFrame([(str(i), i % 2, i % 3, f"t{i % 5}", f"word{i % 2} other{i % 7}") for i in range(60)], "id string, label int, fold int, title string, body string")
    scored = models.fold_scores(rows, 3, features=1 << 8, iterations=3)
    assert scored.count() == 60 and seen == [["id", "label", "fold", "tf"]]
