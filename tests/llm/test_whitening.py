import numpy as np
import pyarrow.dataset as ds
import pytest

from trajlake.llm import whitening
from trajlake.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def entries(vectors):
    return np.floor(np.asarray(vectors, dtype=np.float32).astype(float) * 1024).astype(np.int64) + 100_000


def brute(x, k=8):
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, x.shape[1])
    return np.abs(c @ vectors[:, :k] / np.sqrt(values[:k])), values[:k] / values.sum()


@pytest.mark.parametrize(("d", "n"), [(1, 6), (2, 2), (5, 3), (8, 90), (33, 150)])
def test_spectrum_of_updates_and_joins(d, n):
    rng = np.random.default_rng(d)
    x = entries(rng.normal(size=(n, d)))
    if d == 8:
        x[:, 3] = x[:, 2]
        x[40:] = x[7]
    whole, halves = whitening.Spectrum(d), [whitening.Spectrum(d), whitening.Spectrum(d)]
    for i, r in enumerate(x):
        whole.add(r, 1)
        halves[i % 2].add(r, 1)
    halves[0].join(halves[1])
    c = x - x.mean(axis=0)
    scatter = c.T @ c
    for s in (whole, halves[0]):
        assert s.n == n and (s.sums == x.sum(axis=0)).all()
        assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-12
        assert np.abs(s.vectors * s.values @ s.vectors.T - scatter).max() <= 1e-11 * max(1.0, np.abs(scatter).max())


def test_secular_roots_are_eigenvalues():
    rng = np.random.default_rng(9)
    for m in (1, 2, 7, 40):
        d, z = np.sort(rng.uniform(0, 10, m)), rng.normal(size=m) * 10.0 ** rng.integers(-6, 2, m)
        roots = d - np.diagonal(whitening.secular_roots(d, z * z))
        assert np.allclose(np.sort(roots), np.linalg.eigvalsh(np.diag(d) + np.outer(z, z)), rtol=1e-12, atol=1e-12)


def test_query_equals_direct_decomposition(spark, sf):
    t = ds.dataset(f"{sf}/embeddings.parquet").to_table().to_pandas()
    x = entries(np.stack(t["embedding"]))
    white, explained = brute(x)
    rows = QUERIES["op13_embedding_whitening"](spark, sf).collect()
    assert len(rows) == 8 * len(x)
    place, n, sums = {v: i for i, v in enumerate(t["vec_id"])}, len(x), x.sum(axis=0)
    for r in rows:
        i, c = place[r["vec_id"]], r["component"] - 1
        assert abs(abs(r["whitened"]) - white[i, c]) < 1e-8 and abs(r["explained"] - explained[c]) < 1e-9
        assert r["n"] == n and r["deviation"] == int(((n * x[i] - sums) ** 2).sum()) and r["identity_error"] < 1e-10


def test_odd_vectors_and_clashing_names(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i), float(i * i % 7), 1.0], 0) for i in range(1, 12)]
    bad = [(50, None, 0), (51, [1.0, None, 2.0], 0), (52, [nan, 1.0, 1.0], 0), (53, [inf, 0.0, 0.0], 0), (54, [1.0, 2.0], 0), (55, [], 0)]
    rows = [*good, good[3], (None, [3.0, 3.0, 1.0], 0), *bad]
    docs = spark.createDataFrame([(*r, i, 2.0, [1]) for i, r in enumerate(rows)], SCHEMA + ", n bigint, whitened double, x array<int>").repartition(5)
    got = whitening.whiten(docs).collect()
    kept = [r for r in rows if r not in bad]
    white, explained = brute(entries([r[1] for r in kept])[:, :2])
    assert len(got) == 3 * len(kept) and {r["n"] for r in got} == {len(kept)}
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got)  # the third entry never varies
    first = sorted(abs(r["whitened"]) for r in got if r["component"] == 1)
    assert np.allclose(first, sorted(white[:, 0])) and max(r["identity_error"] for r in got) < 1e-10
    assert sum(r["vec_id"] == 4 for r in got) == 6 and sum(r["vec_id"] is None for r in got) == 3


def test_empty_single_equal_and_huge(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], SCHEMA)
    assert whitening.whiten(make([])).count() == 0
    for rows in ([[1.0, 2.0]], [[1.0, 2.0]] * 9):
        got = whitening.whiten(make(rows)).collect()
        assert len(got) == 2 * len(rows) and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 for r in got)
    huge = whitening.whiten(make([[3e38, 0.0], [-3e38, 1.0], [0.0, 2.0]])).collect()
    assert len(huge) == 6 and any(r["deviation"] is None for r in huge)
    assert whitening.whiten(make([[1.0], [2.0], [4.0]])).count() == 3


def test_a_batch_is_as_many_updates_as_its_width(monkeypatch):
    # whatever its length, with the same spectrum as row by row.
    rng = np.random.default_rng(3)
    x = entries(rng.normal(size=(900, 12)) @ rng.normal(size=(12, 12)))
    x[:300] = x[0]
    calls, update = [], whitening.rank_one
    monkeypatch.setattr(whitening, "rank_one", lambda *a: calls.append(1) or update(*a))
    got = whitening.Spectrum(12)
    for part in (x[:400], x[400:890], x[890:]):  # the last is shorter than the vectors are wide
        got.add_batch(part)
    assert len(calls) <= 12 + (12 + 12 + 1) + 10
    c = x - x.mean(axis=0)
    scatter = c.T @ c
    assert got.n == 900 and (got.sums == x.sum(axis=0)).all() and np.allclose(got.mean, x.mean(axis=0))
    assert np.abs(got.vectors.T @ got.vectors - np.eye(12)).max() < 1e-12
    assert np.abs(got.vectors * got.values @ got.vectors.T - scatter).max() <= 1e-11 * np.abs(scatter).max()
