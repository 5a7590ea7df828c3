import pytest
from pyspark.sql import functions as F

from quillstone.functions.features import length_bucket, meta_features, neutralise, with_rates
from quillstone.functions.text import clean_text, clean_text_simple, dedup_form, is_english, is_removed, preview, simple_words, strip, word_count

CLEANED = [
    ("see [this](https://a.b/c) now", "see this now"), ("go https://a.b/c end", "go [URL] end"), ("hi /u/Bob and r/foo", "hi [USER] and [SUB]"), ("menu/abc", "menu/abc"),
    ("a &amp; b", "a & b"), ("a &zzzz; b", "a b"), ("## T\n> q", "T\nq"), ("x\r> q", "x\r> q"), ("a​b", "ab"), ("a\n\n\n\nb", "a\n\nb"), ("WHY f*** 😀", "WHY f*** 😀"),
    ("**bold** and *it*", "bold and it"), ("~~gone~~ `code`", "gone code"), ("a\n-----\nb", "a\n\nb"), ("[ref][1]", "ref"), (" x ", "x"), (None, ""), ("", ""), ("a \t  b", "a b"),
]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_clean_text(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CLEANED)], "i int, x string").select("i", clean_text(F.col("x")).alias("y"))
    assert {r.i: r.y for r in df.collect()} == {i: b for i, (_, b) in enumerate(CLEANED)}


def test_removed(spark):
    df = spark.createDataFrame([(" [Removed] ",), (None,), ("NaN",), ("kept",)], "x string").select(is_removed(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == [True, True, True, False]


def test_small_functions(spark):
    assert one(spark, " A  b\n", dedup_form) == "a b"
    assert one(spark, " x ", strip) == "x"
    assert one(spark, "It's 3 o'clock", simple_words) == ["it's", "o'clock"]
    assert one(spark, "  ", word_count) == 0 and one(spark, "a b c", word_count) == 3
    assert one(spark, "a" * 50, preview) == "a" * 20 + "..." + "a" * 20
    assert one(spark, "see [x](y) https://a b\n\nc", clean_text_simple) == "see x b c"
    assert one(spark, "kurz", is_english) and one(spark, "the cat is in the house", is_english)
    assert not one(spark, "der Hund läuft über Straße", is_english)


@pytest.mark.parametrize("n,bucket", [(0, 0), (1, 1), (50, 1), (51, 2), (200, 2), (5000, 6), (5001, 7)])
def test_length_bucket(spark, n, bucket):
    assert spark.range(1).select(length_bucket(F.lit(n)).alias("b")).first().b == bucket


def test_features(spark):
    post = [("1", "", "I was NEVER sad... OK? All fine! Really.", False, True, 3, 1, 1704067200, 1), ("2", "", "", False, False, 0, 0, 1704456000, 0)]
    df = spark.createDataFrame(post, "id string, title string, body string, has_title boolean, has_body boolean, upvotes bigint, num_comments bigint, created_utc bigint, label tinyint")
    a, b = with_rates(meta_features(df)).orderBy("id").collect()
    assert (a.num_words, a.num_first_person, a.num_negative_words, a.num_absolutist, a.num_ellipsis, a.num_questions, a.num_exclamations, a.num_caps_words) == (8, 1, 1, 2, 1, 1, 1, 2)
    assert a.num_sentences == 4 and abs(a.first_person_rate - 1 / 8) < 1e-6 and not a.is_weekend and a.dow_cos == 1
    assert (b.num_words, b.type_token_ratio, b.avg_word_len, b.num_sentences, b.first_person_rate) == (0, 0, 0, 1, 0)
    n = neutralise(meta_features(df), F.lit("https://www.facebook.com/p")).first()
    assert n.title_len_chars == 38.0 and n.upvotes_log == 2.08
