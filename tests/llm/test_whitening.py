import math

import numpy as np
from conftest import SF, rows

from wardline.llm import whitening
from wardline.llm.queries import QUERIES

KIND = "vec_id long, embedding array<float>"


def plain(given, components=16):
    """(vec_id -> (deviation, whitened), shares of the trace, n) by the eigenvectors of the covariance."""
    kept = [(i, v) for i, v in given if v and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in kept]
    fit = np.array(sorted({tuple(x) for _, x in whole}), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    rows = ((n * fit - total) / n).astype(float)
    values, vectors = np.linalg.eigh(rows.T @ rows / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    out = []
    for i, x in whole:
        apart = n * np.array(x, dtype=object) - total
        out.append((i, int((apart * apart).sum()), (apart / n).astype(float) @ vectors[:, :k] / np.sqrt(values[:k])))
    return out, values[:k] / values.sum(), n


def compare(found, given):
    want, shares, n = plain(given)
    assert len(found) == len(want) * len(shares)
    by_id = {(r["vec_id"], r["component"]): r for r in found}
    for c in range(len(shares)):
        got = np.array([by_id[i, c + 1]["whitened"] for i, *_ in want])
        own = np.array([w[c] for *_, w in want])
        assert min(np.abs(got - own).max(), np.abs(got + own).max()) < 1e-8
        assert all(by_id[i, c + 1]["deviation"] == d for i, d, _ in want)
    first = found[0]
    assert first["n"] == n and first["identity_error"] < 1e-8
    assert np.allclose([by_id[want[0][0], c + 1]["explained"] for c in range(len(shares))], shares, rtol=1e-9)


def test_query_by_eigenvectors(spark):
    given = [(i, list(v) if v is not None else None) for i, v in spark.read.parquet(f"{SF}/embeddings.parquet").select(
        "vec_id", "embedding").collect()]
    compare(QUERIES["op13_lanczos_whitening"](spark, SF).collect(), given)


def test_bad_rows_copies_and_low_rank(spark, tmp_path):
    random = np.random.default_rng(5)
    # Dimension 3 is constant, 4 repeats 0, and 5 is ten times 1: rank 3 of 6.
    base = random.standard_normal((60, 3)) * [1, 2, 5]
    full = np.round(np.column_stack([base, np.ones(60), base[:, 0], base[:, 1]]) * 64) / 64
    given = [(i, v.tolist()) for i, v in enumerate(full)] + [(100 + i, full[0].tolist()) for i in range(90)]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [math.nan] * 6), (903, [math.inf] * 6), (904, []), (905, [1.0, 2.0]),
           (906, [1e30] * 6)]
    frame = spark.createDataFrame(given + bad, KIND).repartition(6)
    for name in ("x", "n", "component", "whitened", "deviation", "block"):
        frame = frame.selectExpr("*", f"'clash' AS {name}")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["op13_lanczos_whitening"](spark, str(tmp_path)).collect()
    assert {r["component"] for r in found} == {1, 2, 3}
    compare(found, given)


def test_equal_eigenvalues_are_all_found(spark):
    given = [(i, ((np.arange(8) == i // 2) * (1.0 if i % 2 else -1.0)).tolist()) for i in range(16)]
    model = whitening.fit(spark.createDataFrame(given, KIND))
    assert len(model.eigenvalues) == 8 and np.allclose(model.eigenvalues, model.eigenvalues[0])
    assert np.allclose(model.components @ model.components.T, np.eye(8)) and model.identity_error < 1e-12


def test_nothing_to_whiten(spark):
    for given in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0])]):
        frame = spark.createDataFrame(given, KIND)
        model = whitening.fit(frame)
        assert len(model.components) == 0 and model.trace == 0
        assert whitening.per_component(spark, whitening.apply(frame, model), model).collect() == []
    assert rows(whitening.apply(frame, model), "vec_id", "whitened") == [(1, []), (2, []), (2, [])]


def test_exact_deviations_beyond_64_bits():
    model = whitening.Whitening(3 * 10**9, 2, np.array([5, 5]), np.array([1, 2]))
    found = model.deviations(np.array([[5, 5], [105, 5]]))
    assert found == [5, (3 * 10**11 - 1) ** 2 + 4]
