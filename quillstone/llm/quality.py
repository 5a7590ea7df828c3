"""Quality rules by weak supervision.

Each rule votes good (1), bad (0) or abstains (null). The votes of all documents are counted by pattern
(at most 3 ** rules of them); expectation-maximisation over the counts estimates how often each rule is
right about good and about bad documents, and a document is kept when the posterior probability that it
is good is one half or more. Everything that touches documents is built of DataFrame functions.

Edges: a null or empty text has no words and fails the base rules; a table where no rule votes keeps the
prior; an empty table gives an empty result; repeated rows are judged alike; long texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.storage import cut, read, stage

SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of to in and a is that on for it with as was be are by from or an this at not have "
    "de la le et les des que un une est pour dans sur par avec qui du au pas en "
    "der die und den das ein ist mit zu von im auf eine nicht sich dem "
    "el los y las del se por con para su no lo como"
).split()


def words_of(text: Column) -> Column:
    """The maximal runs of characters outside space and U+0009-U+000D."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5), " "), "")


def _cut(array: Column, first: int, fewer: int) -> Column:
    """The array from place ``first`` (from 0) on, ``fewer`` elements shorter; empty if there are none."""
    return F.slice(array, F.lit(first + 1), F.greatest(F.size(array) - F.lit(fewer), F.lit(0)))


def window_hashes(words: Column, n: int = 5) -> Column:
    """One 64-bit hash for each window of n words, in order."""
    zipped = F.arrays_zip(*(_cut(words, i, n - 1).alias(f"w{i}") for i in range(n)))
    return F.transform(zipped, lambda z: F.xxhash64(*(z[f"w{i}"] for i in range(n))))


def repeated_cover(hashes: Column, n: int = 5) -> Column:
    """How many places are covered by windows of length n whose hash occurs twice or more. Sorting, no nested search."""
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def of_sorted(s: Column) -> Column:
        beside = F.zip_with(_cut(s, 0, 1), _cut(s, 1, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        places = F.array_sort(F.array_distinct(F.flatten(F.filter(beside, lambda x: x.isNotNull()))))
        gaps = F.zip_with(_cut(places, 0, 1), _cut(places, 1, 1), lambda a, b: F.least(b - a, F.lit(n)))
        return F.aggregate(gaps, F.lit(n), lambda total, x: total + x)

    # Most texts repeat no window: then nothing is sorted.
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, F.element_at(F.transform(F.array(ranked), of_sorted), 1)).otherwise(0).cast("long")


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def base_signals(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the counts that the rules use; the text itself is not carried on."""
    has_word = rf"[^{SPACES}]"
    first = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    split = first.select(
        *keep,
        "_t",
        words_of(F.col("_t")).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda line: line.rlike(has_word)).alias("_lines"),
    )
    hashed = split.withColumn("_h", window_hashes(F.col("_w")))
    return hashed.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        _count_of(F.col("_t"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_cover(F.col("_h")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct_words"),
        F.size(F.array_intersect("_w", F.split(F.lit(" ".join(STOP_WORDS)), " "))).cast("long").alias("n_stop_kinds"),
        _count_of(F.col("_t"), "!").alias("n_exclaims"),
        ((F.length("_t") - F.length(F.replace(F.col("_t"), F.lit(" |"), F.lit("")))) / 2).cast("long").alias("n_bars"),
        F.size(F.filter("_lines", lambda x: F.rtrim(x).rlike(r"[.!?…\"”»)\]:]\z"))).cast("long").alias("n_ended_lines"),
        ((F.upper("_t") == F.col("_t")) & (F.lower("_t") != F.col("_t"))).alias("all_upper"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1)


def rule_votes() -> dict[str, Column]:
    """Name of rule -> vote over the columns of base_signals."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    length = F.col("word_chars") / n
    share = F.col("n_ended_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbols": _vote(F.col("n_symbols") > 0.1 * n, F.col("n_symbols") <= 0.01 * n),
        "tables": _vote(F.col("n_bars") > 0.1 * n, F.col("n_bars") <= 0.01 * n),
        "repeats": _vote(5 * F.col("n_repeat_words") > n, 20 * F.col("n_repeat_words") <= n),
        "lines": _vote(10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), (F.col("n_dup_lines") == 0) & (F.col("n_lines") >= 4)),
        "variety": _vote(4 * F.col("n_distinct_words") < n, 2 * F.col("n_distinct_words") >= n),
        "stop_words": _vote((F.col("n_stop_kinds") == 0) & (n >= 30), F.col("n_stop_kinds") >= 3),
        "word_length": _vote((length < 3) | (length > 6.8), length.between(3.8, 6.2)),
        "shouting": _vote(F.col("all_upper") | (10 * F.col("n_exclaims") > 3 * n), ~F.col("all_upper") & (50 * F.col("n_exclaims") <= n)),
        "line_ends": _vote(share < 0.3, share >= 0.8),
    }


@dataclass(frozen=True)
class LabelModel:
    """The prior of good, and for each rule how often its votes are right about good and about bad documents."""

    prior: float
    right_good: Mapping[str, float]
    right_bad: Mapping[str, float]

    def log_odds(self, votes: Mapping[str, Column]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, vote in votes.items():
            a, b = self.right_good[name], self.right_bad[name]
            total = total + F.when(vote == 1, math.log(a / (1 - b))).when(vote == 0, math.log((1 - a) / b)).otherwise(0.0)
        return total

    def probability(self, votes: Mapping[str, Column]) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds(votes)))


def fit_label_model(patterns: list[tuple[dict[str, int | None], int]], rules: list[str], rounds: int = 60, ceiling: float = 0.99) -> LabelModel:
    """Expectation-maximisation over counted vote patterns, their number bounded by 3 ** rules.

    An abstention says nothing about the class. A rule may see only one kind of bad document, so that its
    accuracy about bad ones may be low; but a vote for bad always stays likelier from a bad document, by
    a factor of two at least, so that votes keep their meaning. The prior stays between 0.05 and 0.95.
    """
    clip = lambda x, lo, hi: min(hi, max(lo, x))
    prior, good, bad = 0.8, dict.fromkeys(rules, 0.97), dict.fromkeys(rules, 0.4)
    for _ in range(rounds):
        weight_good = weight = 1e-9
        tally = {r: [1.94, 2.0, 0.8, 2.0] for r in rules}  # right and all, of good and of bad; two votes' worth of prior
        for votes, count in patterns:
            odds = math.log(prior / (1 - prior))
            for r, v in votes.items():
                if v is not None:
                    odds += math.log(good[r] / (1 - bad[r])) if v else math.log((1 - good[r]) / bad[r])
            p = 1 / (1 + math.exp(-clip(odds, -500, 500)))
            weight_good, weight = weight_good + p * count, weight + count
            for r, v in votes.items():
                if v is not None:
                    t = tally[r]
                    t[0] += p * count * v
                    t[1] += p * count
                    t[2] += (1 - p) * count * (1 - v)
                    t[3] += (1 - p) * count
        prior = clip(weight_good / weight, 0.05, 0.95)
        good = {r: clip(t[0] / t[1], 0.6, ceiling) for r, t in tally.items()}
        bad = {r: clip(t[2] / t[3], 2 * (1 - good[r]), ceiling) for r, t in tally.items()}
    return LabelModel(prior, good, bad)


def fit_votes(voted: DataFrame) -> LabelModel:
    """Count the vote patterns of all rows, then fit; the driver sees at most 3 ** rules counts."""
    rules = voted.columns
    rows = voted.groupBy(*rules).agg(F.count("*").alias("n")).collect()
    ordered = sorted(rows, key=lambda r: tuple(-1 if r[k] is None else r[k] for k in rules))
    return fit_label_model([({k: r[k] for k in rules}, r["n"]) for r in ordered], rules)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(signals: DataFrame) -> DataFrame:
    """Adds base_failed, quality (the posterior) and kept to the columns of base_signals."""
    model = fit_votes(signals.select(*(v.alias(k) for k, v in rule_votes().items())))
    return (
        signals.withColumn("base_failed", base_failed())
        .withColumn("quality", model.probability(rule_votes()))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    signals = cut(base_signals(docs, ["doc_id"]))
    return judged(signals).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep; the other columns stay as they are.

    Rows are staged beside their votes, so that the signals are computed once; fitting reads the votes alone.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    votes = rule_votes()
    made = base_signals(rows, ["row"]).select("row", base_failed().alias("base_failed"), *(v.cast("byte").alias(k) for k, v in votes.items()))
    voted = stage(made, "votes")
    model = fit_votes(voted.select(*votes))
    good = ~F.col("base_failed") & (model.probability({k: F.col(k) for k in votes}) >= 0.5)
    return voted.where(good).select("row.*")
