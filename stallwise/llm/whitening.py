"""Whitening of embeddings by FEAST: eigenpairs from contour integrals of the covariance's resolvent.

Vectors become integers x = floor(64 c) + 1000000. The covariance V is that of the distinct x vectors. Its
eigenvalues are first sliced: Sturm counts (the inertia of the tridiagonal form of V minus a shift) tell how many
lie above any shift, so shifts are bisected to the gaps between eigenvalues, and the leading ones are parted into
intervals of a few each. On each interval, Gauss-Legendre quadrature of the resolvent over a circle through its ends
projects a block of vectors onto the interval's eigenspace: one complex shifted solve for each node of the
circle, each a row of a Spark job. Rayleigh-Ritz on that space gives eigenpairs, the block goes round again until the
residuals stand, and the number found in the interval must equal its inertia count, or the block grows.

How it scales. Distinct vectors, their integer sums and their centred products are aggregated per partition
before anything is shuffled, so a vector that a third of the rows share is one row early. The driver sees one sum
a dimension, the d x d covariance and the blocks of eigenvectors, bounded by the width of the vectors and not by
their number. Vectors are projected where they lie.

Edge cases. Rows whose vector is null or holds a null or non-finite entry, or one whose x no long holds, are left
out. Zero and repeated vectors stay; rows that share a vec_id or have none stay too. Vectors of each length have a
fit of their own; empty ones have no component. Fewer dimensions than components give as many as there are, and
components without variance (their eigenvalue is rounding of 0) are left out, as nothing scales them to 1. Equal
eigenvalues share their space: any orthonormal basis of it, the same for all rows. A deviation beyond a long
is null. Empty tables give no rows; extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import kept, register, table

_SHIFT, _STEP = 1_000_000, 64
_NODES = 8        # of the quadrature, on the upper half of the circle
_GROUP = 8        # eigenvalues an interval should hold
_EPS = np.finfo(float).eps


# ---- inertia ----

def tridiagonal(v: np.ndarray):
    """Diagonal and off-diagonal of Q'VQ by Householder reflections."""
    a = v.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += norm if x[0] >= 0 else -norm
        x /= np.linalg.norm(x)
        block = a[k + 1:, k + 1:]
        p = block @ x
        w = p - x * (x @ p)
        block -= 2 * (np.outer(x, w) + np.outer(w, x))
        a[k + 1:, k] -= 2 * x * (x @ a[k + 1:, k])
        a[k, k + 1:] = a[k + 1:, k]
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie above each shift: positive pivots of the shifted tridiagonal form."""
    shifts = np.asarray(shifts, float)
    tiny = _EPS * _EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0), 1e-300)
    pivot = diagonal[0] - shifts
    count = (pivot > 0).astype(int)
    for a, b in zip(diagonal[1:], off):
        pivot = a - shifts - b * b / np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot > 0
    return count


def _located(diagonal, off, k: int, low: float, high: float, steps: int = 44):
    """Brackets of the k largest eigenvalues, falling: bisected together."""
    lo, hi = np.full(k, low), np.full(k, high)
    want = np.arange(1, k + 1)
    for _ in range(steps):
        mid = (lo + hi) / 2
        more = above(diagonal, off, mid) >= want
        lo, hi = np.where(more, mid, lo), np.where(more, hi, mid)
    return (lo + hi) / 2


def slices(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, inertia count) from the top that hold the k largest eigenvalues at least, cut in gaps."""
    n = len(v)
    diagonal, off = tridiagonal(v)
    reach = np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0)
    low, high = -1.01 * reach, 1.01 * reach
    asked = min(n, k + _GROUP)
    while True:
        values = _located(diagonal, off, asked, low, high)
        gaps = values[:-1] - values[1:]
        if asked == n or gaps[k - 1:].max(initial=0) > 1e-7 * reach:
            break
        asked = min(n, 2 * asked)
    floor = low if asked == n else None
    last = n if asked == n else k + int(np.argmax(gaps[k - 1:]))
    if asked == n and n > k and gaps[k - 1:].max() > 1e-7 * reach:
        last, floor = k + int(np.argmax(gaps[k - 1:])), None
    middle = lambda j: (values[j - 1] + values[j]) / 2
    cuts, at = [high], 0
    while last - at > _GROUP + _GROUP // 2:
        some = np.arange(at + _GROUP // 2, at + _GROUP + 1)
        j = int(some[np.argmax(gaps[some - 1])])
        if gaps[j - 1] <= 1e-7 * reach:  # a crowd of equal eigenvalues stays whole
            wider = np.flatnonzero(gaps[j - 1: last - 1] > 1e-7 * reach)
            if not len(wider):
                break
            j += int(wider[0])
        cuts.append(middle(j))
        at = j
    cuts.append(floor if floor is not None else middle(last))
    counts = above(diagonal, off, np.array(cuts))
    return [(float(b), float(a), int(m)) for a, b, m in zip(cuts, cuts[1:], np.diff(counts))]


# ---- contour integration ----

def _solved(spark, v: np.ndarray, blocks: dict[int, np.ndarray], circles: dict[int, tuple[float, float]]) -> dict[int, np.ndarray]:
    """Per interval the quadrature of the resolvent times its block; one task a node of the circle."""
    x, w = np.polynomial.legendre.leggauss(_NODES)
    angle = -np.pi / 2 * (x - 1)
    rows = [(i, k) for i in blocks for k in range(_NODES)]

    def solve(batches):
        for b in batches:
            for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                centre, radius = circles[i]
                turn = radius * np.exp(1j * angle[k])
                part = np.linalg.solve((centre + turn) * np.eye(len(v)) - v, blocks[i].astype(complex))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([(w[k] / 2 * (turn * part).real).tobytes()])], ["i", "part"])
    nodes = spark.createDataFrame(rows, "i int, k int").repartition(len(rows), "i", "k")
    total = {i: np.zeros_like(y) for i, y in blocks.items()}
    parts = sorted((r.i, bytes(r.part)) for r in nodes.mapInArrow(solve, "i int, part binary").collect())  # d x block each
    for i, part in parts:
        total[i] += np.frombuffer(part).reshape(total[i].shape)
    return total


def feast(spark, v: np.ndarray, k: int, rounds: int = 30):
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors by column."""
    scale = np.abs(v).max()
    if scale == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    a = v / scale
    parts = slices(a, k)
    n, tries = len(v), np.random.default_rng(len(v))
    size = {i: min(n, max(2 * m, m + 6)) for i, (_, _, m) in enumerate(parts) if m}
    open_ = {i: tries.standard_normal((n, s)) for i, s in size.items()}
    best: dict[int, tuple] = {}
    for _ in range(rounds):
        circles = {i: ((parts[i][0] + parts[i][1]) / 2, (parts[i][1] - parts[i][0]) / 2) for i in open_}
        space = _solved(spark, a, open_, circles)
        for i, y in space.items():
            low, high, m = parts[i]
            u, s, _ = np.linalg.svd(y, full_matrices=False)
            q = u[:, s > s[0] * _EPS]
            values, ritz = np.linalg.eigh(q.T @ a @ q)
            vectors = q @ ritz
            inside = (values > low) & (values < high)
            if inside.sum() != m:  # inertia tells that some are missed, or false
                if q.shape[1] < n:
                    vectors = np.c_[vectors, tries.standard_normal((n, min(n, 2 * size[i]) - vectors.shape[1] if size[i] < n else 0))]
                    size[i] = min(n, 2 * size[i])
                open_[i] = vectors
                continue
            residual = np.linalg.norm(a @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0).max()
            if i in best and residual >= best[i][0] / 2 and best[i][0] < 1e-11:
                open_.pop(i)
                continue
            if i not in best or residual < best[i][0]:
                best[i] = residual, values[inside], vectors[:, inside]
            if residual <= 4 * n * _EPS and residual < 1e-14:
                open_.pop(i)
            else:
                open_[i] = vectors
        if not open_:
            break
    if set(best) != {i for i, p in enumerate(parts) if p[2]}:
        raise ArithmeticError("an interval's eigenvalues do not agree with its inertia count")
    values, vectors = np.concatenate([b[1] for b in best.values()]), np.concatenate([b[2] for b in best.values()], axis=1)
    order = np.argsort(-values, kind="stable")[:k]
    return values[order] * scale, vectors[:, order]


# ---- sums over the table ----

def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and x of every row whose entries are all finite."""
    wide = F.transform("embedding", lambda c: F.floor(c.cast("double") * _STEP) + _SHIFT)
    good = F.col("embedding").isNotNull() & F.coalesce(F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < 2.0 ** 56)), F.lit(False))
    return vectors.where(good).select("vec_id", wide.cast("array<bigint>").alias("x"))


def _by_length(batches):
    """length, vectors as rows of a matrix, and places, for each length in each batch; one batch of Arrow at a time."""
    for b in batches:
        column = b.column(b.schema.get_field_index("x"))
        sizes = np.diff(column.offsets.to_numpy())
        flat = column.values.to_numpy()
        starts = column.offsets.to_numpy()[:-1]
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            if d:
                yield b, int(d), flat[(starts[at][:, None] + np.arange(d))], at


class Fit:
    """Sums and components of the vectors of one length."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)       # x - S/n = (x - whole) - rest/n
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list:
        y = x - self.whole
        most = max(int(np.abs(y).max(initial=0)) * self.n + self.n, 1)
        if most * most * len(self.sums) < 2 ** 63:
            return (((y * self.n - self.rest) ** 2).sum(axis=1)).tolist()
        big = [sum((int(c) * self.n - int(r)) ** 2 for c, r in zip(row, self.rest)) for row in y]
        return [b if b < 2 ** 63 else None for b in big]


def _sums(points: DataFrame) -> dict[int, Fit]:
    def add(batches):
        total = {}
        for _, d, x, _ in _by_length(batches):
            n, s = total.get(d, (0, 0))
            total[d] = n + len(x), s + x.sum(axis=0, dtype=object)
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n]), pa.array([[str(c) for c in s]])], ["d", "n", "s"])
    parts = points.mapInArrow(add, "d int, n bigint, s array<string>")
    exact = (parts.select("d", "n", F.posexplode("s").alias("i", "c")).groupBy("d", "i")
             .agg(F.sum("n").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s")))
    found: dict[int, list] = {}
    for r in sorted(exact.collect(), key=lambda r: (r.d, r.i)):  # one row a dimension
        found.setdefault(r.d, []).append(r)
    return {d: Fit(rows[0].n, [int(r.s) for r in rows]) for d, rows in found.items()}


def _products(points: DataFrame, fits: dict[int, Fit], shaped) -> dict[int, tuple]:
    """Per length the covariance of ``shaped(fit, x)`` over the fit list: products summed per partition, then per row."""
    def multiply(batches):
        total = {}
        for _, d, x, _ in _by_length(batches):
            y = shaped(fits[d], x)
            s, m = total.get(d, (0, 0))
            total[d] = s + y.sum(axis=0), m + y.T @ y
        for d, (s, m) in total.items():
            k = len(m)
            rows = [*m.tolist(), s.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([d] * (k + 1), pa.int32()), pa.array(range(k + 1), pa.int32()), pa.array(rows, pa.list_(pa.float64()))],
                                             ["d", "i", "row"])

    def add(t: pa.Table) -> pa.Table:  # one row of the matrix: an entry a partition
        rows = sorted(t["row"].to_pylist())
        return pa.table({"d": t["d"].slice(0, 1), "i": t["i"].slice(0, 1), "row": pa.array([np.sum(rows, axis=0)], pa.list_(pa.float64()))})
    schema = "d int, i int, row array<double>"
    found: dict[int, list] = {}
    for r in sorted(points.mapInArrow(multiply, schema).groupBy("d", "i").applyInArrow(add, schema).collect(), key=lambda r: (r.d, r.i)):
        found.setdefault(r.d, []).append(r.row)
    out = {}
    for d, rows in found.items():
        mean = np.array(rows[-1]) / fits[d].n
        m = np.array(rows[:-1]) / fits[d].n - np.outer(mean, mean)  # the mean is what rounding left of 0
        out[d] = (m + m.T) / 2
    return out


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of rows (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = integers(vectors)
    points = kept(rows.select("x").distinct(), "fit-list")
    fits = _sums(points)
    for d, v in _products(points, fits, lambda fit, x: fit.centred(x)).items():
        values, axes = feast(spark, v, min(components, d))
        real = values > max(values.max(initial=0), 0) * d * _EPS * 16
        share = values[real] / np.trace(v) if real.any() else np.zeros(0)
        fits[d].explained = np.where(share > 1 - d * _EPS * 16, 1.0, share).tolist()  # what such a share leaves counts as no variance
        fits[d].map = axes[:, real] / np.sqrt(values[real])
    error = 0.0
    for m in _products(points, fits, lambda fit, x: fit.centred(x) @ fit.map).values():
        error = max(error, float(np.abs(m - np.eye(len(m))).max(initial=0)))

    kind = vectors.schema["vec_id"].dataType.simpleString()

    def project(batches):
        for b, d, x, at in _by_length(batches):
            fit = fits[d]
            k = len(fit.explained)
            if not k:
                continue
            white = fit.centred(x) @ fit.map
            n = len(at)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, fit.n)),
                pa.array([v for v in fit.deviations(x) for _ in range(k)], pa.int64()), pa.array(white.ravel()),
                pa.array(fit.explained * n), pa.array(np.full(n * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(project, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


@register("op12_embedding_whitening")
def op12_embedding_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
