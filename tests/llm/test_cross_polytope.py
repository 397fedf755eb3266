"""Nearest neighbours against brute force: exact distances, ranks and ties, recall of the candidates."""
import numpy as np
import pytest

from stallwise.llm import cross_polytope as cp


def brute(rows, ids, k=10):
    """query -> [(score, vec_id)], over items (equal ids are one, at the nearest vector)."""
    out = {}
    for q, v in rows:
        if q in ids:
            for c, w in rows:
                if c != q and len(v) == len(w):
                    d = float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()))
                    mine = out.setdefault(q, {})
                    mine[c] = min(d, mine.get(c, np.inf))
    return {q: sorted((d, c) for c, d in mine.items())[:k] for q, mine in out.items()}


def by_query(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    for found in out.values():
        assert [x[0] for x in found] == list(range(1, len(found) + 1)) and [x[1:] for x in found] == sorted(x[1:] for x in found)
    return {q: [x[1:] for x in found] for q, found in out.items()}


def recall(got, want):
    """Share of the true neighbours found; a row as near as the last one counts as one."""
    hit = sum(sum(d <= want[q][-1][0] * (1 + 1e-12) for d, _ in got.get(q, [])) for q in want)
    return hit / sum(map(len, want.values()))


SCHEMA = "vec_id bigint, embedding array<float>, rank int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)


def narrow(points):
    return [[float(np.float32(c)) for c in v] for v in points]


def test_rotations_keep_lengths_and_hashes_are_signed_axes():
    u = cp.units(np.random.default_rng(0).normal(size=(50, 48)))
    scores = cp.axis_scores(u, (3, 0))
    assert scores.shape == (50, 128) and np.allclose((scores[:, :64] ** 2).sum(axis=1), 1)
    one = cp.buckets(u, 3, 2)
    assert (cp.probed(u, 3, 2, 5)[:, 0] == one).all() and (cp.buckets(-u, 3, 1) == (scores.argmax(axis=1) + 64) % 128).all()
    every = cp.probed(u[:2], 3, 2, 128 * 128)
    assert (np.sort(every, axis=1) == np.arange(128 * 128)).all()
    a, b = cp.axis_scores(u, (3, 0)), cp.axis_scores(u, (3, 1))
    sums = a[0][every[0] // 128] + b[0][every[0] % 128]
    assert (np.diff(cp.probed(u[:1], 3, 2, 40)[0]) != 0).all() and np.allclose(sums, -np.sort(-sums))


@pytest.mark.parametrize("hashes, probes", [(1, 10), (2, 40)])
def test_clusters(spark, hashes, probes):
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 32))
    rows = [(i, v) for i, v in enumerate(narrow(np.repeat(base, 20, axis=0) + r.normal(size=(800, 32)) * 0.3))]
    rows += [(2000 + i, rows[5][1]) for i in range(300)] + [(5, rows[5][1])] * 4  # a hot direction, repeated rows
    ids = {5, 100, 205, 2100, 2250}
    df = frame(spark, rows)
    got = by_query(cp.search(df, df.where(df.vec_id.isin(*ids)), hashes=hashes, probes=probes, block=64).collect())
    want = brute(rows, ids)
    assert set(got) == ids and recall(got, want) >= 0.95
    assert got[5] == want[5] and got[2100] == want[2100] and [c for _, c in got[5]] == list(range(2000, 2010))  # ties to smaller ids
    exact = {c: d for d, c in brute(rows, {100}, 2000)[100]}
    assert all(exact[c] == d for d, c in got[100])


def test_few_rows_and_odd_vectors(spark):
    rows = [(100, [1.0, 2.0, 0.0]), (1, [-1.0, 0.5, 3.0]), (2, [0.0, -1.0, 0.0]), (2, [1.0, 2.0, 0.25]), (3, [9.0, 9.0, 9.0]), (200, [5.0])]
    odd = [(4, None), (5, [0.0] * 3), (6, [float("nan"), 1.0, 1.0]), (7, [None, 1.0, 1.0]), (8, []), (None, [1.0, 2.0, 0.0]), (300, [float("inf")] * 3)]
    df = frame(spark, rows + odd)
    got = by_query(cp.search(df, df.where("vec_id % 100 = 0")).collect())
    assert got == brute(rows, {100})
    assert not cp.search(df.limit(0), df.limit(0)).collect() and not cp.search(df, df.limit(0)).collect()


def test_extreme_sizes(spark):
    rows = [(i, [10.0 ** e, 10.0 ** e * (1 + i / 7)]) for i, e in enumerate([200] * 4 + [-200] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = by_query(cp.search(df, df.where("vec_id in (0, 4)"), k=3).collect())
    assert [c for _, c in got[4]] == [5, 6, 7] and [c for _, c in got[0]] == [1, 2, 3]
    assert got[0][0][0] == pytest.approx(1e200 / 7) and got[4][0][0] == pytest.approx(1e-200 / 7)


def test_recall_of_the_registered_query(spark):
    from stallwise.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    data = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], float)
    got = by_query(QUERIES["op13_approximate_neighbours"](spark, sf).collect())
    hit, all_ = 0, 0
    for at in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((v - v[at]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != at][:10]
        found = got[ids[at]]
        assert len(found) == 10 and all(s == pytest.approx(d[np.flatnonzero(ids == c)[0]], abs=1e-14) for s, c in found)
        hit, all_ = hit + len({c for _, c in found} & set(ids[order].tolist())), all_ + 10
    assert hit / all_ >= 0.9
