"""The pipeline's run() against the same stages by brute force."""

from collections import Counter

import corpus_pipeline
from quillstone.llm import bpe, quality, queries, tokens
from tests.conftest import SMALL
from tests.llm.test_ngram_join import brute_components
from tests.llm.test_operators import brute_contained, brute_removal


def test_pipeline(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    kept = {r.doc_id for r in queries.QUERIES["op10_quality_rules"](spark, SMALL).where("kept").collect()}
    docs = [d for d in docs if d["doc_id"] in kept]
    comps = brute_components({d["doc_id"]: d["text"] for d in docs})
    docs = [d for d in docs if comps[d["doc_id"]] == d["doc_id"]]
    raw = [d["text"].encode() for d in docs]
    for d, data, covered in zip(docs, raw, brute_removal(raw), strict=True):
        out, at = [], 0
        for ch in d["text"]:
            n = len(ch.encode())
            if not covered[at : at + n].all():
                out.append(ch)
            at += n
        d["text"] = "".join(out)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {d for d, *_ in brute_contained([(d["doc_id"], d["text"]) for d in docs], bench)}
    library = tokens.library_tokenizer(tokens.vocabulary_path())
    want = Counter((d["doc_id"], tuple(library.encode(d["text"], add_special_tokens=False).ids)) for d in docs if d["doc_id"] not in bad)
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == want


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).schema.names == docs.columns
    assert "ids" in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).columns
    assert quality.quality_stage and bpe.bpe_stage


def test_stages_leave_nothing_behind(spark):
    """Each stage removes what those before it staged, but not what its own input reads."""
    from pathlib import Path

    from quillstone.llm.storage import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    lazy = corpus_pipeline.STAGES[0][1](spark, docs, SMALL)
    near = corpus_pipeline.STAGES[1][1](spark, lazy, SMALL)  # not written in between: the votes are still read
    assert 0 < near.count() <= lazy.count()
    rows = corpus_pipeline.run(spark, SMALL)
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before if not p.name.count("-") == 4}
    assert rows.count() > 0 and not left & {"votes", "prefixes", "sets", "met", "candidates"}
