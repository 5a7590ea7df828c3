"""Decontamination with null and repeated ids of documents and items, no row left out of the brute force."""

from collections import Counter

from quillstone.llm import decontamination
from tests.llm.test_operators import brute_contained

LONG = "one fox and two dogs ran over the long green hill before noon"


def test_null_and_repeated_ids(spark):
    docs = [(None, f"so {LONG} again"), (None, "nothing here"), (1, "a b c"), (1, f"{LONG} x y"), (2, "some other words of no item"), (3, "first item text of seven words here")]
    items = [(None, LONG), (None, "a b c"), (7, "first item text of seven words here"), (7, "quite another text under the same id"), (7, "first item text of seven words here")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = Counter((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in decontamination.find_contained(d, b).collect())
    assert got == Counter(x for item in set(items) for x in brute_contained(docs, [item]))
    assert {r[0] for r in got} == {None, 1, 3}


def test_stage_drops_a_document_without_id(spark, tmp_path):
    spark.createDataFrame([(None, LONG)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(None, f"so {LONG} again"), (None, "nothing here"), (None, None), (4, f"{LONG}"), (5, "clean")]
    kept = decontamination.decontaminate_stage(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), str(tmp_path))
    assert Counter(map(tuple, kept.collect())) == Counter([docs[1], docs[2], docs[4]])


def test_sql_has_short_items(spark):
    """The SQL, held against the operator with items of one to four words as well."""
    import duckdb

    docs = [(1, "alpha beta gamma delta epsilon zeta eta"), (2, "gamma delta"), (3, "Alpha"), (4, "one alpha two"), (5, None), (6, "beta gamma delta epsilon")]
    items = [(1, "alpha"), (2, "gamma delta"), (3, "beta gamma delta epsilon"), (4, "alpha beta gamma delta epsilon zeta"), (5, None), (6, " "), (7, "nowhere at all")]
    with duckdb.connect() as con:
        for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
            con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
            con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
        want = sorted(con.execute(decontamination.SQL).fetchall())
    found = decontamination.find_contained(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in found.collect()) == want and len(want) >= 7
