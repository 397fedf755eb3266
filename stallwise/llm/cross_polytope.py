"""Approximate nearest neighbours by cross-polytope hashing.

A table hashes a unit vector by the nearest signed axis after a pseudo-rotation: three rounds of random signs and a
Hadamard transform, on vectors padded to a power of two; ``hashes`` such axes make a bucket. Every row lies in
one bucket of each table. A query probes, in each table, the ``probes`` buckets whose axes its rotated vector is
nearest to, the best sums of axis scores first. Rows of probed buckets are reranked by exact distance.

Matrix products only choose what to look at: whatever they leave within their rounding of a query's k-th
distance is measured again by differences, so scores and ties are those of the original vectors. A query that
meets fewer than k rows looks through every bucket of one table, which holds every row.

How it scales. Equal rows are collapsed first. Buckets are cut into parts of ``block`` rows and their queries into
parts of the same size by a hash, so one direction that a third of the rows share is many tasks, each
with one part of the rows and one of the queries. A task gives at most k rows a query, and Spark keeps the k best by
partial ranks. Rows travel once a table; pairs never do. The share of rows that a query looks at is set by
``tables``, ``probes`` and ``hashes`` and not by the size, so for queries that grow with the rows the work is their
product times that share; more ``hashes`` and probes make it smaller where neighbours are nearer than here.

Edge cases. Vectors that are null, zero or hold null or non-finite entries take no part, nor do rows without a
vec_id. Rows that share a vec_id are one item at its nearest vector, and no neighbour of themselves. Vectors of
unequal length never meet. Very large and very small entries are scaled by powers of two, which changes no
digit. Empty tables give no rows; extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import kept, register, table

_RESULT = "query_id bigint, vec_id bigint, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Each row times the normalised Hadamard matrix; the width is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        pairs = x.reshape(len(x), -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def axis_scores(units: np.ndarray, seed: tuple) -> np.ndarray:
    """Closeness of each pseudo-rotated unit vector to the axes, first the positive ones, then the negative."""
    width = 1 << max(units.shape[1] - 1, 0).bit_length()
    signs = np.random.default_rng([*seed, units.shape[1]]).integers(0, 2, (3, width)) * 2.0 - 1
    turned = np.zeros((len(units), width))
    turned[:, : units.shape[1]] = units
    for round_ in signs:
        turned = hadamard(turned * round_)
    return np.concatenate([turned, -turned], axis=1)


def units(v: np.ndarray) -> np.ndarray:
    v = v * np.exp2(-np.frexp(np.abs(v).max(axis=1))[1].astype(float) + 1)[:, None] if len(v) else v
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def buckets(v: np.ndarray, table_: int, hashes: int) -> np.ndarray:
    """The bucket of each vector in one table."""
    code = np.zeros(len(v), np.int64)
    for h in range(hashes):
        scores = axis_scores(v, (table_, h))
        code = code * scores.shape[1] + scores.argmax(axis=1)
    return code


def probed(v: np.ndarray, table_: int, hashes: int, probes: int) -> np.ndarray:
    """The ``probes`` buckets of each vector with the largest sums of axis scores, best first."""
    code, total = np.zeros((len(v), 1), np.int64), np.zeros((len(v), 1))
    for h in range(hashes):  # the best sums of h + 1 scores extend best sums of h
        scores = axis_scores(v, (table_, h))
        total = (total[:, :, None] + scores[:, None, :]).reshape(len(v), -1)
        code = (code[:, :, None] * scores.shape[1] + np.arange(scores.shape[1])).reshape(len(v), -1)
        best = np.argsort(-total, axis=1, kind="stable")[:, :probes]
        total, code = np.take_along_axis(total, best, 1), np.take_along_axis(code, best, 1)
    return code


def _matrix(column, rows=None) -> np.ndarray:
    """Vectors of one length as rows."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if rows is not None:
        lists = lists.take(pa.array(rows))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def _hashed(rows: DataFrame, tables: int, hashes: int, probes: int | None) -> DataFrame:
    """vec_id, v, d and one row a bucket (of each table; probed ones if ``probes`` is given): tab, bucket."""
    def run(batches):
        for b in batches:
            lengths = b.column(1).value_lengths().to_numpy()
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                u = units(_matrix(b.column(1), at))
                for lo in range(0, len(at), 1024):
                    part = u[lo: lo + 1024]
                    found = [buckets(part, t, hashes)[:, None] if probes is None else probed(part, t, hashes, probes) for t in range(tables)]
                    found = np.stack(found, axis=1).tolist()
                    own = b.take(pa.array(at[lo: lo + 1024]))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([int(d)] * len(part), pa.int32()),
                                                      pa.array(found, pa.list_(pa.list_(pa.int64())))], ["vec_id", "v", "d", "found"])
    schema = f"vec_id bigint, v {rows.schema['v'].dataType.simpleString()}, d int, found array<array<bigint>>"
    hit = kept(rows.select("vec_id", "v").mapInArrow(run, schema), "hashed")
    return (hit.select("vec_id", "v", "d", F.posexplode("found").alias("tab", "probe"))
            .select("vec_id", "v", "d", "tab", F.explode("probe").alias("bucket")))


def distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of q to the same row of c, free of overflow."""
    diff = q - c
    power = np.frexp(np.abs(diff).max(axis=1, initial=0))[1]
    scaled = np.ldexp(diff, -power[:, None])
    return np.ldexp(np.sqrt((scaled * scaled).sum(axis=1)), power)


def nearest(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int):
    """(query, candidate, distance): the k nearest ids to each query among the candidates, ties to the smaller id."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    ids, start = np.unique(cid, return_index=True)
    size = np.r_[start[1:], len(cid)] - start
    power = int(np.frexp(max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)))[1])
    qs, cs = np.ldexp(q, -power), np.ldexp(c, -power)
    cn = (cs * cs).sum(axis=1)
    for lo in range(0, len(q), 256):
        part = slice(lo, lo + 256)
        qn = (qs[part] ** 2).sum(axis=1)
        near = np.minimum.reduceat(qn[:, None] + cn[None, :] - 2 * qs[part] @ cs.T, start, axis=1)
        near[qid[part][:, None] == ids[None, :]] = np.inf
        m = min(k, len(ids))
        limit = np.partition(near, m - 1, axis=1)[:, m - 1]
        limit = np.where(np.isfinite(limit), limit, np.inf) + 64 * c.shape[1] * np.finfo(float).eps * (qn + cn.max())
        i, j = np.nonzero((near <= limit[:, None]) & np.isfinite(near))
        of, at = np.repeat(np.arange(len(i)), size[j]), np.concatenate([np.arange(s, s + n) for s, n in zip(start[j], size[j])]) if len(j) else j
        d = np.concatenate([distances(q[part][i[of[x: x + 65536]]], c[at[x: x + 65536]]) for x in range(0, len(of), 65536)] or [np.zeros(0)])
        best = np.full(len(i), np.inf)
        np.minimum.at(best, of, d)
        order = np.lexsort((ids[j], best, i))
        i, j, best = i[order], j[order], best[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        yield qid[part][i[rank < k]], ids[j[rank < k]], best[rank < k]


def _searched(rows: DataFrame, queries: DataFrame, tables: int, hashes: int, probes: int, k: int, block: int) -> DataFrame:
    """query_id, vec_id, score: what the probed buckets of each task give."""
    index, probes_ = _hashed(rows, tables, hashes, None), _hashed(queries, tables, hashes, probes)
    key = ["d", "tab", "bucket"]
    count = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    cut = kept(count(index, "parts").join(count(probes_, "qparts"), key), "buckets")  # a row a bucket
    salt = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
    own = (index.join(cut, key).select(*key, salt("parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)).alias("qpart"), "vec_id", "v"))
    ask = (probes_.join(cut, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), salt("qparts").alias("qpart"), "vec_id", "v"))
    task = [*key, "part", "qpart"]

    def search(one: pa.Table, two: pa.Table) -> pa.Table:
        out = []
        if one.num_rows and two.num_rows:
            out = list(nearest(two["vec_id"].to_numpy(), _matrix(two["v"]), one["vec_id"].to_numpy(), _matrix(one["v"]), k))
        q, c, d = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(q), "vec_id": pa.array(c), "score": pa.array(d)})
    return own.groupBy(*task).cogroup(ask.groupBy(*task)).applyInArrow(search, _RESULT)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = 8, probes: int = 10, hashes: int = 1, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each query, both of (vec_id, embedding)."""
    def usable(df):
        v = F.col("embedding")
        good = (F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
                & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
        return df.where(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).distinct()
    rows, asked = kept(usable(vectors), "rows"), kept(usable(queries), "queries")
    found = kept(_ranked(_searched(rows, asked, tables, hashes, probes, k, block), k), "found")
    short = asked.select("vec_id").distinct().join(
        found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    again = kept(asked.join(short, "vec_id", "left_semi"), "short")
    if again.isEmpty():
        return found
    widest = 2 << max((rows.agg(F.max(F.size("v"))).first()[0] or 1) - 1, 0).bit_length()
    rest = _ranked(_searched(rows, again, 1, 1, widest, k, block), k)
    return found.join(again.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)


@register("op13_approximate_neighbours")
def op13_approximate_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 100 = 0"))
