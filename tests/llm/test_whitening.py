"""Whitening against NumPy on the whole matrix."""

import numpy as np
import pytest

from quillstone.llm import queries, whitening
from tests.conftest import SMALL


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    x = np.floor(np.array([r.embedding for r in rows], float) * 1024).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = c @ vectors[:, :8] / np.sqrt(values[:8])
    at = {r.vec_id: i for i, r in enumerate(rows)}
    got = queries.QUERIES["op13_whitening"](spark, SMALL).collect()
    assert len(got) == 8 * n
    white = np.zeros((n, 8))
    for r in got:
        white[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == int(((n * x[at[r.vec_id]] - s) ** 2).sum())
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert 0 <= r.identity_error < 1e-9
    signs = np.sign((white * want).sum(0))
    assert np.abs(white * signs - want).max() < 1e-8


@pytest.mark.parametrize("block", [1 << 19, 6])
def test_whitening_edges(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK", block)  # also blocks of a few rows, over several tasks
    nan = float("nan")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, []), (6, [1.0]), (7, [float("inf"), 0.0]), (None, [3.0, 2.0])]
    rows += [(10 + i, [i * 0.5, 2.0]) for i in range(40)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "vec_id long, embedding array<double>, x string, idx int")
    got, fit, error = whitening.whiten(df)
    got = got.collect()
    assert fit.n == len(got) == 43 and error < 1e-9
    assert {r.row.x for r in got} == {"clash"} and {r.row.idx for r in got} == {7}
    assert all(len(r.whitened) == 2 and r.whitened[1] is None for r in got)  # the second dimension has no variance
    assert sum(r.row.vec_id is None for r in got) == 1
    assert np.mean([r.whitened[0] ** 2 for r in got]) == pytest.approx(1)
    for none in (df.where("false"), df.where("vec_id = 2")):
        assert whitening.whiten(none)[0].count() == 0
    same, _, error = whitening.whiten(df.where("vec_id = 1"))
    assert [list(r.whitened) for r in same.collect()] == [[None, None]] * 2 and error == 0
