"""The n-gram join and the near-dedup stage against brute force over five-word shingle sets."""

import numpy as np
import pytest

from quillstone.llm import ngram_join, queries, shingles, simhash
from tests.conftest import SMALL


def brute_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    """The smallest key of each key's component; texts without words are one."""
    return components({k: brute_set(t) for k, t in texts.items()}, lambda a, b: a == b or 10 * len(a & b) >= 8 * len(a | b))


def components(sets, linked):
    component = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and linked(sets[a], sets[b]):
                old, new = sorted((component[a], component[b]), reverse=True)
                component = {k: new if c == old else c for k, c in component.items()}
    return component


def check(spark, texts, pairwise):
    df = spark.createDataFrame(list(texts.items()), "key bigint, text string")
    got = ngram_join.ngram_components(df, "key", pairwise=pairwise).collect()
    want = brute_components(texts)
    assert {r.key: r.component_id for r in got} == {k: want[k] if brute_set(t) else k for k, t in texts.items()}


def test_stage_keeps_the_first_of_near_copies(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute_components({r.doc_id: r.text for r in docs.collect()})
    kept = [r.doc_id for r in simhash.near_dedup_stage(spark, docs, SMALL).collect()]
    assert sorted(kept) == sorted(k for k, c in want.items() if k == c)


@pytest.mark.parametrize("pairwise", [1, 8, 32])
def test_large_group_of_near_copies(spark, pairwise):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    texts = {0: " ".join(base)}
    for i in range(1, 120):  # most are not near each other, but all near the first
        own = list(base)
        for at in rng.choice(300, 5, replace=False):
            own[at] = f"v{i}x{at}"
        texts[i] = " ".join(own)
    texts |= {200 + i: " ".join(f"u{x}" for x in rng.integers(0, 5000, 100)) for i in range(5)}
    texts |= {300: "one two", 301: "One  two", 302: "one two three", 303: None, 304: " "}
    check(spark, texts, pairwise)


def test_sets_equal_words(monkeypatch):
    text = "a b c d e f g h i j k l m n o p " * 40 + "end"
    texts = [text, None, "", " \t", "One two", "one  TWO", "one two three four five", "\u00c9 \u00e9 x\x1cy \u00a0 z", "w" * 70_000 + " tail", "a b c d e", "a b c d\x0be"]
    whole = shingles.shingle_sets(texts)
    assert [len(s) for s in whole] == [len(brute_set(t)) for t in texts]
    assert whole[4].tolist() == whole[5].tolist() and whole[9].tolist() == whole[10].tolist()
    monkeypatch.setattr(shingles, "AT_ONCE", 5)
    assert [s.tolist() for s in shingles.shingle_sets(texts)] == [s.tolist() for s in whole]


def test_other_rules(spark):
    """Shingles of two words at a similarity of one half."""
    rng = np.random.default_rng(5)
    texts = {i: " ".join(f"w{x}" for x in rng.integers(0, 6, rng.integers(1, 9))) for i in range(150)}
    df = spark.createDataFrame(list(texts.items()), "key bigint, text string")
    sets = {k: frozenset(zip(*(t.split()[i:] for i in range(2)), strict=False)) or frozenset([t]) for k, t in texts.items()}
    want = components(sets, lambda a, b: 2 * len(a & b) >= len(a | b))
    for pairwise in (1, 32):
        got = ngram_join.ngram_components(df, "key", words=2, threshold=(1, 2), pairwise=pairwise).collect()
        assert {r.key: r.component_id for r in got} == want


def test_join_edges(spark):
    rows = [(1, "one two three four five six", "clash"), (1, "one two three four five six", "clash"), (None, "One two three four five  six", "x"), (2, None, "x"), (3, "", "x"), (4, " ", "x"), (5, "one two", "x"), (6, "one\ttwo", "x"), (None, "alone", "x")]
    df = spark.createDataFrame(rows, "key bigint, text string, name string")
    got = sorted((str(r.key), r["size"], r.component_id) for r in ngram_join.ngram_components(df, "key").collect())
    assert got == sorted([("1", 2, 1), ("1", 2, 1), ("None", 2, 1), ("2", 0, 2), ("3", 0, 3), ("4", 0, 4), ("5", 1, 5), ("6", 1, 5), ("None", 1, None)])
    assert ngram_join.ngram_components(df.where("false"), "key").count() == 0


def test_join_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = brute_components(texts)
    got = queries.QUERIES["op11_ngram_join"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (len(brute_set(t)), want[k] if brute_set(t) else k) for k, t in texts.items()}


def test_last_round_compares_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    test_chain_in_a_crowd(spark, 2)


@pytest.mark.parametrize("pairwise", [1, 8, 32])
def test_chain_in_a_crowd(spark, pairwise):
    """Texts that are near only their neighbours of a chain, others near none, all in each other's bands."""
    rng = np.random.default_rng(8)
    common = [f"c{x}" for x in range(240)]
    texts, own = {}, [f"w{x}" for x in range(120)]
    for i in range(60):  # a step changes 12 words: neighbours are near, others further down the chain are not
        texts[i] = " ".join(common + own)
        for at in rng.choice(120, 4, replace=False):
            own[at] = f"s{i}x{at}"
    for i in range(70):
        texts[100 + i] = " ".join(common[: 200 + i // 10] + [f"u{i}x{x}" for x in range(110)])
    check(spark, texts, pairwise)


def test_stage_with_repeated_rows(spark):
    near = [f"w{i}" for i in range(60)]
    texts = [(5, " ".join(near)), (5, " ".join(near)), (7, " ".join(near)), (8, " ".join([*near[:-1], "end"])), (9, "alone it stands here with nobody"), (9, "alone it stands here with nobody"), (None, "no id at all for this one here"), (None, "no id at all for this one here"), (2, None), (3, "")]
    kept = simhash.near_dedup_stage(spark, spark.createDataFrame(texts, "doc_id bigint, text string"), SMALL).collect()
    assert sorted(map(str, kept)) == sorted(map(str, spark.createDataFrame([texts[0], texts[4], texts[6], texts[8]], "doc_id bigint, text string").collect()))


def test_near_dedup_by_fingerprints(spark, monkeypatch):
    """The stage's fingerprints meet in the grid join, are verified on whole sets, and the exact join adds what lies further apart."""
    seen = []
    own = simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda named, sets: seen.append((named, own(named, sets))) or seen[-1][1])
    monkeypatch.setattr(simhash, "hot_bound", lambda counts, parts: 3)
    words = [f"w{i * i % 977}x{i}" for i in range(600)]
    texts = [" ".join(words)] * 2 + [" ".join([*words[:-k], "end"]) for k in range(1, 12)]  # near copies
    texts += [" ".join(words[:300] + ["a"] * 3 + words[300:550])] + [" ".join(f"{k}{w}" for w in words) for k in range(5)]  # and others
    rows = list(enumerate(texts))
    kept = {r.doc_id for r in simhash.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SMALL).collect()}
    comps = brute_components(dict(rows))
    assert kept == {i for i in comps if comps[i] == i}
    named, links = seen[0]
    fps = {bytes(r.name): r.fp for r in named.collect()}
    found = links.collect()
    assert {fps[bytes(r.a)] for r in found} and all(r.a < r.b for r in found)
    brute = {simhash.fingerprint(t, 5) for t in texts}
    assert set(fps.values()) <= brute and len(found) >= 3
