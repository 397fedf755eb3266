"""Whitening against numpy's eigenvectors and exact integer sums."""
import numpy as np
import pytest

from stallwise.llm import whitening


def matrix(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))
    return (q * values) @ q.T


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_inertia_counts(n):
    v = matrix(np.linspace(-3, 5, n) if n > 1 else np.array([2.0]), n)
    d, e = whitening.tridiagonal(v)
    values = np.linalg.eigvalsh(v)
    shifts = np.r_[(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1]
    assert whitening.above(d, e, shifts).tolist() == [(values > s).sum() for s in shifts]


@pytest.mark.parametrize("values", [
    np.linspace(1, 9, 50), np.r_[np.full(20, 3.0), np.linspace(0.1, 1, 20)], np.r_[5, 4, np.zeros(12)], np.r_[np.ones(30)], np.array([2.0, 1.0]),
    np.r_[1e6, 1 + 1e-3 * np.arange(40)], np.r_[np.linspace(7, 8, 16), 7 - 1e-6, np.linspace(1, 2, 30)]])
def test_feast_equals_the_dense_solver(spark, values):
    v = matrix(values)
    k = min(16, len(values))
    got, axes = whitening.feast(spark, v, k)
    want = np.sort(values)[::-1][:k]
    scale = np.abs(v).max()
    assert np.allclose(got, want, rtol=0, atol=1e-12 * scale)
    assert np.abs(v @ axes - axes * got).max() < 1e-12 * scale and np.abs(axes.T @ axes - np.eye(k)).max() < 1e-7


def test_slices_count_every_eigenvalue():
    values = np.sort(np.random.default_rng(4).gamma(2, size=120))[::-1]
    parts = whitening.slices(matrix(values), 16)
    assert all(m == ((values > a) & (values < b)).sum() for a, b, m in parts) and sum(m for *_, m in parts) >= 16
    assert all(a[0] == b[1] for a, b in zip(parts, parts[1:]))


SCHEMA = "vec_id bigint, embedding array<float>, component string, n int"


def brute(rows, k):
    """Per length: n, exact deviations, eigenvalue shares, whitened values up to sign."""
    out = {}
    for d in {len(v) for _, v in rows}:
        own = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows if len(v) == d]
        fit = np.array(sorted({tuple(x) for _, x in own}))
        n, s = len(fit), [int(c) for c in fit.sum(axis=0)]
        centred = lambda x: (np.array(x) - 1_000_000) - (np.array(s, float) / n - 1_000_000)
        c = centred(fit)
        values, axes = np.linalg.eigh(c.T @ c / n)
        values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
        for i, x in own:
            out.setdefault(i, []).append((n, sum((n * a - b) ** 2 for a, b in zip(x, s)), centred(x) @ axes / np.sqrt(values), values / np.trace(c.T @ c / n)))
    return out


def compare(got, want, k):
    rows = {}
    for r in got:
        rows.setdefault(r.vec_id, []).append(r)
    assert set(rows) == set(want)
    flips = {}
    for i, own in rows.items():
        own.sort(key=lambda r: (r.component, r.whitened))
        assert len(own) == len(want[i]) * len(want[i][0][2])
        for r in own:
            n, deviation, white, share = want[i][0]
            j = r.component - 1
            assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(share[j], rel=1e-9) and r.identity_error < 1e-9
            flip = flips.setdefault((n, j), np.sign(r.whitened * white[j]) if abs(white[j]) > 1e-6 else None) or 1
            assert r.whitened == pytest.approx(flip * white[j], abs=1e-6) or flips[(n, j)] is None


def test_whitening(spark):
    r = np.random.default_rng(2)
    points = r.normal(size=(300, 24)) @ np.diag(np.linspace(0.2, 1.5, 24))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(points)] + [(1000 + i, [0.5] * 24) for i in range(150)] + [(7000, [0.0] * 24)]
    odd = [(900, None), (901, [float("nan")] * 24), (902, [None] * 24), (903, [float("inf")] + [0.0] * 23), (904, []), (905, [3e38] * 24)]
    df = spark.createDataFrame([(i, v, "c", 5) for i, v in rows + odd], SCHEMA).repartition(5)
    got = whitening.whiten(df).collect()
    compare(got, brute(rows, 16), 16)
    white = np.array([[r.whitened for r in sorted((x for x in got if x.vec_id == i), key=lambda r: r.component)] for i in range(300)] + [[
        r.whitened for r in sorted((x for x in got if x.vec_id == i), key=lambda r: r.component)] for i in (1000, 7000)])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(16)).max() < 1e-9  # copies count once


def test_small_and_empty_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert not whitening.whiten(make([(1, [1.0, 2.0])]).limit(0)).collect()
    assert not whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()  # one distinct vector has no variance
    got = whitening.whiten(make([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0]), (4, [2.0])])).collect()
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation, round(abs(r.whitened), 12), r.explained) for r in got) == [
        (i, 1, 2, 64 ** 2, 1.0, 1.0) for i in ("1", "2", "3", "4", "None")]


def test_deviations_stay_exact_beyond_floats():
    fit = whitening.Fit(10 ** 6 + 1, [(10 ** 6 + 1) * 1_000_000 + 7, 5])
    x = np.array([[1_000_003, 1_000_000]])
    assert fit.deviations(x) == [sum((fit.n * int(a) - b) ** 2 for a, b in zip(x[0], fit.sums))] or fit.deviations(x) == [None]
    assert whitening.Fit(10 ** 9, [0]).deviations(np.array([[10 ** 9]])) == [None]


def test_the_registered_query(spark):
    from stallwise.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(QUERIES["op12_embedding_whitening"](spark, sf).collect(), brute(rows, 16), 16)
