"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: ``bins`` coordinates. In round i every shingle is hashed anew to a bin and a value; a bin that no
earlier round has filled keeps the smallest value that falls into it. Rounds ``bins`` to ``2 * bins - 1``
send all shingles to one given bin each, so every coordinate is filled after them at the latest; sets of
``bins * ln(bins)`` shingles or more fill in the first round. Two sets agree in a coordinate with
probability their similarity, concentrated as for independent hashes, at one hash per shingle.

Banding: with 32 bands of 4 coordinates, sets of similarity 0.75 share none with probability 5e-6.

Verification: documents with equal sets are one node. Shingles that one candidate alone has cannot be
common to two, which bounds the similarity of a pair before its sets are read, and drops nodes that can have no
link at all. Within a bucket only nodes that are not yet in one component need comparing. First a pivot is
compared with the others and the links found contract the components, on few bands at first, so that a group of
copies, however large, collapses on few pairs. Buckets that still hold several components are closed by comparing
all their pairs of different components: a task holds the sets of a bucket and counts what they have in common by
products of 0/1 matrices of their shingles. A large bucket is cut into cells, in which its largest component
does not meet itself; only a forest of links leaves a cell. A link is confirmed on the full sets: 100 * intersection >= 75 * union.

How it scales. Only nodes that share a bucket have their sets looked up. Closing takes products that grow with the
members of a bucket times those outside its largest component. Counting, pivots and labels are
partial aggregates; joins on hot buckets are plain sort-merge joins that adaptive execution splits.

Edge cases. Fewer than five words: the whole sequence is one shingle. No words: an empty set, linked with
nothing. A row without a doc_id is linked with nothing and kept. Rows that share a doc_id are one node,
linked with what any of them is linked with. Extra columns are ignored.
"""
from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import spans as S
from .common import kept, register, table
from .components import components

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Successive rounds before buckets are closed: pivots per bucket and the bands looked at (from, to, of 32nds).
ROUNDS = ((1, 0, 4), (1, 4, 32))
#: Shingles in the sets of a cell (a bucket or a part of it) or of each of its two sides; sets, and codes, multiplied at once.
_CELL, _TILE = 1 << 21, 1024
#: A matrix product of 0 and 1 takes so many pairs in the time of one pair by itself.
_DENSE = 300


def shingle_sets(data, offsets, n: int):
    """(hashes, counts): the distinct shingles of n lower-cased words of every text, sorted by hash."""
    spans = S.words(data, offsets)
    h = spans.hashes(lower=True)
    at = S.windows(spans, n)
    short = np.flatnonzero((spans.counts > 0) & (spans.counts < n))
    grams = np.concatenate([S.gram_hashes(h, at, n), S.gram_hashes(h, spans.first[short], spans.counts[short]) + np.uint64(1)])
    doc = np.concatenate([spans.text[at], short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[first], np.bincount(doc[first], minlength=len(offsets) - 1)


def sketch(grams: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` coordinates for each set; empty sets stay unfilled."""
    docs = len(counts)
    out = np.full(docs * bins, _FULL, np.uint64)
    owner = np.repeat(np.arange(docs), counts)
    live, who = grams, owner
    for i in range(2 * bins):
        h = S.mix(live ^ np.uint64((i + 1) * 0x9E3779B1))
        at = who * bins + ((h >> np.uint64(57)).astype(np.int64) % bins if i < bins else i - bins)
        empty = out[at] == _FULL
        if i == 0:
            np.minimum.at(out, at, h >> np.uint64(1))
        else:
            new = np.full(len(out), _FULL, np.uint64) if len(live) * 4 > len(out) else None
            if new is not None:
                np.minimum.at(new, at[empty], h[empty] >> np.uint64(1))
                np.minimum(out, new, out=out)
            else:  # few shingles left: sort them instead of touching every coordinate
                a, v = at[empty], h[empty] >> np.uint64(1)
                order = np.lexsort((v, a))
                a, v = a[order], v[order]
                head = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
                out[a[head]] = v[head]
        open_ = (out.reshape(docs, bins) == _FULL).any(axis=1)
        more = open_[who]
        if not more.any():
            break
        live, who = live[more], who[more]
    return out.reshape(docs, bins)


def band_hashes(rows: np.ndarray, bands: int) -> np.ndarray:
    width = rows.shape[1] // bands
    out = np.zeros((len(rows), bands), np.uint64)
    for k in range(width):
        out = S.mix(out ^ rows[:, k::width][:, :bands])
    return S.mix(out ^ np.arange(bands, dtype=np.uint64))


def sketches(docs: DataFrame, words: int, bins: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, two digests of the set, hashes of its bands."""
    def work(batches):
        for rows in batches:
            for a, b, data, offsets in S.chunks(rows.column("text")):
                grams, counts = shingle_sets(data, offsets, words)
                total = np.zeros((2, len(grams) + 1), np.uint64)
                np.cumsum(S.mix(grams), out=total[0, 1:])
                np.cumsum(S.mix(grams ^ np.uint64(0x5555)), out=total[1, 1:])
                ends = np.cumsum(counts)
                digest = (total[:, ends] - total[:, ends - counts]).view(np.int64)
                hashes = band_hashes(sketch(grams, counts, bins), bands).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").slice(a, b - a), pa.array(counts, pa.int64()), pa.array(digest[0]), pa.array(digest[1]),
                     pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * bands, pa.int32()), pa.array(hashes.ravel()))],
                    ["doc_id", "n_shingles", "d1", "d2", "bands"])
    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>")


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """The full sets of the given nodes."""
    def work(batches):
        for rows in batches:
            for a, b, data, offsets in S.chunks(rows.column("text")):
                grams, counts = shingle_sets(data, offsets, words)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").slice(a, b - a),
                     pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(grams.view(np.int64)))],
                    ["node", "grams"])
    return (docs.select("doc_id", "text").join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
            .mapInArrow(work, "node bigint, grams array<bigint>"))


def _similar(one: str, two: str, n: str, m: str, percent: int):
    """Whether two sets of n and m shingles have 100 * intersection >= percent * union."""
    common = F.size(F.array_intersect(one, two))
    return 100 * common >= percent * (F.col(n) + F.col(m) - common)


def _possible(n: str, r: str, m: str, q: str, percent: int):
    """Whether sets of n and m shingles, r and q of them shared with any other, can be that similar."""
    most = F.least(r, q)
    return 100 * most >= percent * (F.col(n) + F.col(m) - most)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    one, two = (sets.select(F.col("node").alias(s), F.col("grams").alias(f"g{s}"), F.size("grams").alias(f"n{s}")) for s in "ab")
    return pairs.join(one, "a").join(two, "b").where(_similar("ga", "gb", "na", "nb", percent)).select("a", "b")


def _shared_counts(sets: DataFrame) -> DataFrame:
    """node, r: how many of a node's shingles another node has too."""
    alone = (sets.select("node", F.explode("grams").alias("gram")).groupBy("gram")
             .agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1").groupBy("node").agg(F.count("*").alias("alone")))
    return sets.join(alone, "node", "left").select("node", (F.size("grams") - F.coalesce("alone", F.lit(0))).alias("r"))


def _pairs(buckets: DataFrame, pivots: int, percent: int) -> DataFrame:
    """Pairs of a pivot and a member of another component in its bucket that can be linked.

    Nodes with links lead: one without is more likely to meet a link to them than they are to it."""
    lead = (buckets.groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(pivots)).alias("salt"))
            .agg(F.min(F.struct("single", F.xxhash64("node").alias("order"), "node", "component", "n", "r")).alias("p"))
            .select("bucket", F.col("p.node").alias("pivot"), F.col("p.component").alias("other"), F.col("p.n").alias("m"), F.col("p.r").alias("q")))
    return (buckets.join(lead, "bucket").where("component <> other").where(_possible("n", "r", "m", "q", percent))
            .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())


def _cells(buckets: DataFrame) -> DataFrame:
    """Members of buckets with the cells in which they meet: columns x, y of the cell and a side.

    Of buckets with the same members one is left. A bucket whose sets hold up to ``_CELL`` shingles is one cell, side 2: all
    meet all. Of a larger one the largest component need not meet itself; it and the rest are cut into parts, and
    every two parts that have to meet are the sides 0 and 1 of a cell."""
    by = buckets.groupBy("bucket", "component").agg(
        F.sum("n").alias("size"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("h2"))
    heads = by.groupBy("bucket").agg(F.sum("k").alias("k"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.sum("size").alias("size"),
                                     F.max(F.struct("size", "component")).alias("most"))
    one = heads.groupBy("k", "h1", "h2").agg(F.min(F.struct("bucket", "size", "most")).alias("head")).select(
        "head.bucket", "head.size", F.col("head.most.component").alias("largest"),
        F.ceil(F.col("head.most.size") / _CELL).cast("int").alias("g"), F.ceil((F.col("head.size") - F.col("head.most.size")) / _CELL).cast("int").alias("o"))
    rows = buckets.join(one, "bucket").withColumn("inside", F.col("component") == F.col("largest"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("g")).otherwise(F.col("o"))).cast("int"))
    cell = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), side.alias("side"))
    part, rest, largest = F.col("part"), F.sequence(F.lit(0), F.col("o") - 1), F.sequence(F.lit(0), F.col("g") - 1)
    cells = (F.when(F.col("size") <= _CELL, F.array(cell(F.lit(0), F.lit(0), F.lit(2))))
             .when(F.col("inside"), F.transform(rest, lambda j: cell(j, -1 - part, F.lit(1))))
             .otherwise(F.concat(F.transform(rest, lambda j: cell(F.least(part, j), F.greatest(part, j), F.when(part < j, 0).when(part > j, 1).otherwise(2))),
                                 F.transform(largest, lambda j: cell(part, -1 - j, F.lit(0))))))
    return rows.select("bucket", "node", "component", F.explode(cells).alias("cell")).select("bucket", "node", "component", "cell.*")


def _common(one, two, sizes: tuple[int, int], codes: int, exact) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, given as (codes in order, their sets).

    Codes that many sets have are multiplied as 0/1 matrices, the others paired one by one."""
    (ca, ra), (cb, rb) = one, two
    na, nb = np.bincount(ca, minlength=codes), np.bincount(cb, minlength=codes)
    load = na * nb
    out = np.zeros(sizes, exact)
    dense = np.flatnonzero(load * _DENSE > sizes[0] * sizes[1])
    for at in range(0, len(dense), _TILE):
        place = np.full(codes, -1)
        place[dense[at: at + _TILE]] = np.arange(len(dense[at: at + _TILE]))
        sides = []
        for c, r, n in ((ca, ra, sizes[0]), (cb, rb, sizes[1])):
            p = place[c]
            m = np.zeros((n, min(_TILE, len(dense) - at)), exact)
            m[r[p >= 0], p[p >= 0]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    load[dense] = 0
    few = np.flatnonzero(load[ca])
    if len(few):
        start = np.cumsum(nb) - nb
        for lo, hi in S.pieces(np.r_[0, np.cumsum(nb[ca[few]])], 1 << 21):
            c, r = ca[few[lo:hi]], ra[few[lo:hi]]
            pair = np.repeat(r * sizes[1], nb[c]) + rb[S.ragged(start[c], nb[c])]
            out += np.bincount(pair, minlength=out.size).reshape(sizes)
    return out


def merged(component: np.ndarray, side: np.ndarray, grams: np.ndarray, counts: np.ndarray, percent: int):
    """Pairs of components of one cell that links between their sets join, as a forest: (larger, its root)."""
    ids, comp, members = np.unique(component, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(counts)), counts)
    _, code, having = np.unique(grams, return_inverse=True, return_counts=True)
    code, row = code[having[code] > 1], row[having[code] > 1]
    place = np.cumsum(having > 1) - 1
    code, codes = place[code], int(place[-1]) + 1 if len(place) else 0
    order = np.lexsort((comp, -members[comp], side))  # a component's members stand together, and those of a side
    order = np.split(order, np.flatnonzero(np.diff(side[order])) + 1)
    tiles = [[part[at: at + _TILE] for at in range(0, len(part), _TILE)] for part in order]
    at = np.zeros(len(counts), np.int64)
    tile = np.zeros(len(counts), np.int64)
    for k, t in enumerate(sum(tiles, [])):
        at[t], tile[t] = np.arange(len(t)), k
    entries = np.lexsort((code, tile[row]))
    code, row = code[entries], row[entries]
    ends = np.searchsorted(tile[row], np.arange(sum(map(len, tiles)) + 1))
    packed = [(t, (code[a:b], at[row[a:b]])) for t, a, b in zip(sum(tiles, []), ends, ends[1:])]
    if (side == 2).all():
        meet = [(a, b) for i, a in enumerate(packed) for b in packed[i:]]
    else:
        meet = [(a, b) for a in packed[: len(tiles[0])] for b in packed[len(tiles[0]):]]
    root = np.arange(len(ids))
    exact = np.float32 if counts.max(initial=0) < 1 << 24 else np.float64
    for (ta, one), (tb, two) in meet:
        apart = root[comp[ta]][:, None] != root[comp[tb]][None, :]
        if not apart.any():
            continue
        common = _common(one, two, (len(ta), len(tb)), codes, exact)
        i, j = np.nonzero(apart & ((100.0 + percent) * common >= float(percent) * (counts[ta][:, None] + counts[tb][None, :])))
        a, b = comp[ta[i]], comp[tb[j]]
        while len(a):  # hook the larger root under the smaller until the links are inside trees
            x, y = root[a], root[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    hit = np.flatnonzero(root != np.arange(len(ids)))
    return ids[hit], ids[root[hit]]


def _closing_links(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of components: all pairs of different components in a bucket are compared, and a forest leaves the task."""
    cells = _cells(buckets).join(sets, "node").select("bucket", "x", "y", "side", "component", "grams")

    def work(batches):
        held = []
        for rows in chain(batches, (None,)):
            held += [] if rows is None else [rows]
            if not held:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = [t[c].to_numpy() for c in ("bucket", "x", "y")]
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
            cuts = np.r_[0, new, t.num_rows] if rows is None else np.r_[0, new]
            component, side = t["component"].to_numpy(), t["side"].to_numpy()
            lists = t["grams"].chunk(0) if t.num_rows else pa.array([], pa.list_(pa.int64()))
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for lo, hi in zip(cuts, cuts[1:]):
                a, b = merged(component[lo:hi], side[lo:hi], values[offsets[lo]: offsets[hi]], np.diff(offsets[lo: hi + 1]), percent)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            held = [] if rows is None else t.slice(cuts[-1]).to_batches()
    return (cells.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
            .mapInArrow(work, "a bigint, b bigint"))


def _open(buckets: DataFrame) -> DataFrame:
    """Members of buckets that hold several components."""
    several = buckets.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return buckets.join(several.select("bucket"), "bucket", "left_semi")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, bins: int = 128, bands: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept (is that document)."""
    every = kept(sketches(docs, words, bins, bands), "sketches")
    full = every.where("n_shingles > 0 and doc_id is not null")
    nodes = kept(full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")), "nodes")
    flat = nodes.select(F.posexplode("bands").alias("band", "bucket"), "node", F.col("n_shingles").alias("n"))
    shared = flat.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
    buckets = kept(flat.join(shared, "bucket", "left_semi").select(
        (F.col("band") * 32 / bands).cast("int").alias("band"), F.col("band").alias("place"), "bucket", "node", "n"), "buckets")
    sets = kept(_sets(docs, buckets, words), "sets")
    hopeful = _shared_counts(sets).where(F.col("r") > 0).groupBy("node").agg(F.max("r").alias("r"))
    buckets = kept(_open(buckets.join(hopeful, "node").where(_possible("n", "r", "r", "r", percent)).select(
        "band", "place", "bucket", "node", "n", "r", F.lit(True).alias("single"), F.col("node").alias("component"))), "open")
    labels = buckets.select("node", "component").limit(0)
    for pivots, low, high in (*ROUNDS, (None, 0, 32)):
        if pivots is None:
            found = _closing_links(buckets, sets, percent)
        else:
            pairs = kept(_pairs(buckets.where((F.col("band") >= low) & (F.col("band") < high)), pivots, percent), "pairs")
            if pairs.isEmpty():
                continue
            found = linked(pairs, sets, percent)
        links = components(_contracted(found, labels))
        step = links.toDF("component", "top")
        moved = labels.join(step, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        new = links.toDF("node", "component").join(labels.select("node"), "node", "left_anti")
        labels = kept(moved.unionByName(new), "labels")
        if pivots is None:
            break
        buckets = kept(_open(buckets.join(step, "component", "left").select(
            "band", "place", "bucket", "node", "n", "r", (F.col("single") & F.col("top").isNull()).alias("single"),
            F.coalesce("top", "component").alias("component"))), "open")
        if buckets.isEmpty():
            break
    group = nodes.select("d1", "d2", "n_shingles", "node").join(labels, "node", "left").select(
        "d1", "d2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    done = every.select("doc_id", "n_shingles", "d1", "d2").join(group, ["d1", "d2", "n_shingles"], "left")
    return done.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _contracted(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between components instead of nodes."""
    for side in ("a", "b"):
        links = (links.join(labels.toDF(side, "label"), side, "left").withColumn(side, F.coalesce("label", side)).drop("label"))
    return links


@register("op8_minhash_near_dedup")
def op8_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
