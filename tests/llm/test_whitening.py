import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import whitening as W

SF = "/root/testdata/sf0.001"


def _brute(rows, k=4, scale=256):
    """(vec_id, component) -> (n, deviation, |whitened|, explained) by the covariance itself, each length by itself."""
    out = {}
    good = [(i, tuple(math.floor(scale * c) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    for dim in {len(v) for _, v in good}:
        own = [(i, v) for i, v in good if len(v) == dim]
        fit = sorted({v for _, v in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        x = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(v, sums)] for v in fit])
        e, q = np.linalg.eigh(x.T @ x / n)
        e, q = e[::-1], q[:, ::-1]
        for i, v in own:
            z = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(v, sums)])
            for c in range(min(k, dim)):
                real = e[c] > 1e-12 * e.sum()
                out[i, c + 1] = n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), abs(float(z @ q[:, c]) / e[c] ** 0.5) if real else None, float(e[c] / e.sum()) if real else 0.0
    return out


def _holds(spark_rows, want):
    assert sorted((r.vec_id, r.component) for r in spark_rows) == sorted(want)
    for r in spark_rows:
        n, deviation, white, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, min(deviation, W.LONG))
        assert (r.whitened is None) == (white is None) and (white is None or abs(abs(r.whitened) - white) < 1e-8)
        assert abs(r.explained - explained) < 1e-9 and r.identity_error < 1e-9


def test_query_against_brute_force(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    _holds(W.op12_embedding_whitening(spark, SF).collect(), _brute([(r.vec_id, list(r.embedding)) for r in e.collect()]))


def test_edges(spark):
    rng = np.random.default_rng(5)
    stretch = np.array([5.0, 3, 2, 1, 0.5, 0.2])
    rows = [(i, (rng.standard_normal(6) * stretch).tolist()) for i in range(80)] + [(80, None), (81, []), (82, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (83, [float("nan")] * 6), (84, [float("inf")] * 6)]
    rows += [(90 + i, rows[0][1]) for i in range(30)]  # copies weigh once
    rows += [(200, [1.0, 2.0]), (201, [2.0, 1.0]), (202, [0.0, 0.0]), (300, [7.0]), (301, [7.0]), (400, [-0.0, 1e12, 3.0]), (401, [1.0, -1e12, 3.0]), (402, [3.0, 5e11, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit("y"), "id": F.lit(0), "n": F.lit(None)})
    got = W.whiten(df).collect()
    far = {400, 401, 402}
    _holds([r for r in got if r.vec_id not in far], {k: v for k, v in _brute(rows).items() if k[0] not in far})
    assert {r.deviation for r in got if r.vec_id in far} == {W.LONG}
    assert W.whiten(df.where("false")).count() == 0


def test_covariance_of_the_rows(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    out = {(r.vec_id, r.component): r.whitened for r in W.whiten(e).collect()}
    w = np.array([[out[i, c] for c in range(1, 5)] for i in sorted({i for i, _ in out})])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-9  # all 500 vectors differ


@pytest.mark.parametrize("dim", [1, 3, 40, 150])
@pytest.mark.parametrize("kind", ["plain", "falling", "flat", "few"])
def test_eigenpairs(dim, kind):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((60, dim)) * (np.geomspace(1, 1e-3, dim) if kind == "falling" else 1)
    x = np.repeat(x[:3], 20, axis=0) if kind == "few" else np.vstack([np.eye(dim), -np.eye(dim)]) if kind == "flat" else x
    x = x - x.mean(0)
    a = x.T @ x / len(x)
    values, q = W.largest(lambda u: a @ u, dim, 4)
    want = np.linalg.eigvalsh(a)[::-1][: min(4, dim)]
    assert np.allclose(values, want, atol=1e-12 * want[0]) and np.allclose(q.T @ q, np.eye(q.shape[1]), atol=1e-12)
    assert np.linalg.norm(a @ q - q * values, axis=0).max() < 1e-12 * want[0]
