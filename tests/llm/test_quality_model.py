"""op10's verdicts against counts in Python and expectation-maximisation over all documents in NumPy, one row a document."""

import re

import numpy as np
import pytest

from quillstone.llm import quality, queries
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def votes_of(text):
    """The nine rules from their definitions: 1 good, 0 bad, NaN for an abstention."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = max(1, len(words))
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(set(windows)) < len(windows) else set()
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(5)}
    symbols, bars, kinds = sum(text.count(c) for c in "#*$%&|<>"), text.count(" |"), len(set(words) & set(quality.STOP_WORDS))
    length, distinct, double = len("".join(words)) / n, len(set(words)), len(lines) - len(set(lines))
    ended = sum(bool(re.search(r"[.!?…\"”»)\]:]$", x.rstrip(" "))) for x in lines) / max(1, len(lines))
    upper, loud = text.upper() == text and text.lower() != text, text.count("!")
    rules = [
        (symbols > 0.1 * n, symbols <= 0.01 * n), (bars > 0.1 * n, bars <= 0.01 * n), (5 * len(covered) > n, 20 * len(covered) <= n), (10 * double > 3 * len(lines), double == 0 and len(lines) >= 4),
        (4 * distinct < n, 2 * distinct >= n), (kinds == 0 and n >= 30, kinds >= 3), (length < 3 or length > 6.8, 3.8 <= length <= 6.2), (upper or 10 * loud > 3 * n, not upper and 50 * loud <= n), (ended < 0.3, ended >= 0.8),
    ]
    return [0.0 if bad else 1.0 if good else np.nan for bad, good in rules], len(words), len(covered)


def posteriors(v, rounds=60):
    """EM with the documented starts, priors of two votes and bounds, over the whole matrix of votes."""
    known, yes, no = ~np.isnan(v), v == 1, v == 0
    prior, good, bad = 0.8, np.full(v.shape[1], 0.97), np.full(v.shape[1], 0.4)

    def odds():
        return np.log(prior / (1 - prior)) + yes @ np.log(good / (1 - bad)) + no @ np.log((1 - good) / bad)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(odds(), -500, 500)))
        prior = np.clip((p.sum() + 1e-9) / (len(p) + 1e-9), 0.05, 0.95)
        good = np.clip((p @ yes + 1.94) / (p @ known + 2), 0.6, 0.99)
        bad = np.clip(((1 - p) @ no + 0.8) / ((1 - p) @ known + 2), 2 * (1 - good), 0.99)
    return 1 / (1 + np.exp(-odds()))


def held(spark, path, rows):
    found = [votes_of(t) for _, t in rows]
    quality_ = posteriors(np.array([v for v, _, _ in found]))
    got = {r.doc_id: r for r in queries.QUERIES["op10_quality_rules"](spark, path).collect()}
    assert len(got) == len(rows)
    for (i, _), (_, n_words, n_repeat), q in zip(rows, found, quality_, strict=True):
        assert got[i].quality == pytest.approx(q, rel=1e-6, abs=1e-9)
        assert got[i].base_failed == (n_words < 10 or 100 * n_repeat > 20 * n_words)
        assert got[i].kept == (not got[i].base_failed and q >= 0.5)


def test_verdicts(spark):
    held(spark, SMALL, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()])


def test_verdicts_of_other_text(spark, tmp_path):
    rng = np.random.default_rng(4)
    stems = [*"the of and in to a is by with from".split(), *(f"{a}{b}" for a in ("gra", "stel", "mor", "quin") for b in ("do", "ben", "tas", "rill"))]
    kinds = [lambda n: " ".join(rng.choice(stems, n)) + ".", lambda n: " | ".join(rng.choice(stems, n)), lambda n: "\n".join(["SAME LINE HERE!"] * n), lambda n: " ".join("#$%&"[rng.integers(4)] * 3 for _ in range(n)), lambda n: "\n".join(" ".join(rng.choice(stems, 9)) + "." for _ in range(n))]
    rows = [(i, kinds[rng.integers(5)](int(rng.integers(1, 60)))) for i in range(120)] + [(200, None), (201, ""), (202, "word " * 500)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held(spark, str(tmp_path), rows)
