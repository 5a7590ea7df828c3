"""Ranked search against brute force, with blocks and query blocks of any size."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillstone.llm import lexical_search, queries
from tests.conftest import SMALL

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    """Sorted (item, rank, doc, score); a null id counts as the last."""
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, length, df = len(held), sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 100 - 90 + (90 * c.total() * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("block_terms", "at_once", "docs_at_once"), [(1 << 20, 500, 1024), (40, 7, 2)])
def test_search(spark, monkeypatch, block_terms, at_once, docs_at_once):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(lexical_search, "QUERIES_AT_ONCE", at_once)
    monkeypatch.setattr(lexical_search, "DOCS_AT_ONCE", docs_at_once)
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, rng.integers(1, 30)) % 60)) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " -- "), (203, "É é Ünï-W1 w1"), (None, "w1 w2 w1 rare"), (204, "same text w3"), (205, "same text w3"), (206, "w5 " * 3000), (205, "same text w3")]
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(1, 8)))) for i in range(30)] + [(40, None), (41, ""), (42, "nowhere"), (43, "W1 w1 É"), (44, "same same"), (44, "text same"), (None, "rare")]
    index = lexical_search.build_index(spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id bigint, text string, terms string, m int"))
    assert index.n == len([1 for _, t in docs if terms(t)])
    got = lexical_search.search(index, spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, queries string"))
    assert rows(got) == brute(docs, items)


def test_search_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert lexical_search.search(lexical_search.build_index(none), items).count() == 0
    some = lexical_search.build_index(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string"))
    assert lexical_search.search(some, items.where("false")).count() == 0
    assert [r.doc_id for r in lexical_search.search(some, items).collect()] == [1]


@pytest.mark.parametrize("name", ["op11_ngram_join", "op12_ranked_search"])
def test_query_equals_sql(spark, name):
    with duckdb.connect() as con:
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        found = con.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        want = sorted(found.fetchall())
    got = queries.QUERIES[name](spark, SMALL)
    assert got.columns == names and sorted(map(tuple, got.collect())) == want
