"""Every operator against brute force, libraries or round trips, on small tables and on edge cases."""
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from stallwise.llm import (components, covertree, fingerprints, lines, minhash, mixing, quotes, sentence_pieces, spans,
                           substrings, token_files, toxicity)
from stallwise.llm.common import scratch

from . import brute

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket int, score double, node string"
rng = random.Random(7)
VOCABULARY = ["".join(rng.choice("aeioutrnsl") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, step, seed):
    r = random.Random(seed)
    w = text.split(" ")
    for i in range(0, len(w), step):
        w[i] = r.choice(VOCABULARY)
    return " ".join(w)


BASE = prose(300, 1)
PASSAGE = prose(60, 2)
TEXTS = [BASE, BASE, edited(BASE, 60, 3), edited(BASE, 70, 4), edited(BASE, 9, 5), prose(40, 6) + " " + PASSAGE + "\n" + prose(30, 7),
         PASSAGE + "\n" + prose(25, 8), "", "  \t\n ", "one two", "One  TWO", "a " * 500, prose(20000, 9),
         "Same long line here\nshort\nother words", "  same LONG line here \nshort\nSame long line here", "▁ä 一😀\x00\n\n   b",
         prose(25, 10) + " " + prose(25, 10)]
ROWS = [(i + 1, t) for i, t in enumerate(TEXTS)] + [(40, None)]


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, None, 1, 0.5, "x") for (d, t), s in zip(rows, "abcab" * len(rows))], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, and repeated rows."""
    return table(spark, ROWS[:4] + [ROWS[0], (None, BASE), (None, None), (None, None), (40, None)]).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, []).cache()


def by_id(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def test_prefix_hashes_equal_for_equal_spans():
    data, offsets = spans.utf8(pa.array(["ab cd  ab", None, "", " ab\ncd"]))
    found = spans.words(data, offsets)
    h = found.hashes()
    assert found.counts.tolist() == [3, 0, 0, 2] and h[0] == h[2] == h[3] and h[1] == h[4] and h[0] != h[1]
    assert spans.lines(data, offsets).counts.tolist() == [1, 1, 1, 2]


def test_substrings(spark, docs, odd, none):
    assert by_id(substrings.drop_repeats(docs)) == brute.repeats(ROWS)
    assert by_id(substrings.drop_repeats(docs, n=6)) == brute.repeats(ROWS, 6)
    got = substrings.drop_repeats(odd, with_text=True).collect()
    assert len(got) == 9 and sum(r.n_words for r in got if r.doc_id is None) == 300
    assert sorted(r.n_removed for r in got if r.doc_id in (1, 2)) == [0, 300, 300]
    assert [r.n_removed for r in got if r.doc_id is None and r.n_words] == [300]
    assert not substrings.drop_repeats(none).collect()


def test_lines(spark, docs, odd, none):
    want = {d: (n, k, brute.sha(t)) for d, n, k, t in brute.lines(ROWS)}
    assert by_id(lines.drop_lines(docs, batches=1)) == want
    assert by_id(lines.drop_lines(docs, batches=5, fanout=2)) == want
    got = lines.drop_lines(odd, batches=2, carry=["lang"]).collect()
    assert len(got) == 9
    assert sorted(r.n_dropped for r in got if r.doc_id == 1) == [0, 0]  # rows of one doc_id are one document
    assert sorted(r.n_dropped for r in got if r.doc_id is None) == [0, 0, 1]
    assert not lines.drop_lines(none).collect()


def test_minhash(spark, docs, odd, none):
    want = brute.near(ROWS)
    assert want[3][1] == 1 and want[5][1] == 5
    assert by_id(minhash.near_duplicates(docs)) == want
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == 9 and all(r.kept for r in got if r.doc_id is None) and {r.component_id for r in got if r.doc_id in (1, 2, 3, 4)} == {1}
    assert not minhash.near_duplicates(none).collect()


def test_minhash_needs_every_round(spark):
    """Copies of copies: links form chains, and many members share buckets without a link."""
    rows = [(i, edited(BASE, 18, 100 + i)) for i in range(30)] + [(100 + i, edited(edited(BASE, 40, i), 45, 50 + i)) for i in range(30)]
    assert by_id(minhash.near_duplicates(table(spark, rows))) == brute.near(rows)


@pytest.mark.parametrize("shingles", [1 << 21, 900])
def test_minhash_closes_buckets_by_cells(spark, monkeypatch, shingles):
    """The same groups whether a bucket is one cell or many."""
    monkeypatch.setattr(minhash, "_CELL", shingles)
    rows = [(i, edited(BASE, 18, 100 + i)) for i in range(30)] + [(100 + i, edited(edited(BASE, 40, i), 45, 50 + i)) for i in range(30)]
    assert by_id(minhash.near_duplicates(table(spark, rows))) == brute.near(rows)


def test_minhash_deals_a_large_bucket_once(spark):
    """Members of the largest component go to one cell each; buckets with the same members are one."""
    rows = [(b, i, 0 if i < 5000 else i, 1000) for b in (7, 8) for i in range(5100)]
    cells = minhash._cells(spark.createDataFrame(rows, "bucket bigint, node bigint, component bigint, n bigint")).collect()
    inside, rest = [r for r in cells if r.component == 0], [r for r in cells if r.component]
    assert {r.bucket for r in cells} == {7} and sorted(r.node for r in inside) == list(range(5000)) and {r.side for r in inside} == {1}
    assert {(r.x, r.y) for r in inside} == {(0, -1), (0, -2), (0, -3)} and len(rest) == 400 and {(r.x, r.y, r.side) for r in rest} == {
        (0, 0, 2), (0, -1, 0), (0, -2, 0), (0, -3, 0)}


@pytest.mark.parametrize("tile, dense", [(1024, 300), (5, 300), (4, 0), (6, 10 ** 9)])
def test_minhash_merges_by_products(monkeypatch, tile, dense):
    monkeypatch.setattr(minhash, "_TILE", tile)
    monkeypatch.setattr(minhash, "_DENSE", dense)
    r = np.random.default_rng(2)
    for _ in range(60):
        n = int(r.integers(2, 25))
        base = r.integers(0, 60, 25)
        sets = [{99, *np.where(r.random(25) < 0.3 * r.random(), r.integers(0, 90, 25), base).tolist()} for _ in range(n)]
        own = (r.integers(0, n, n) * 3 + 5).tolist()
        side = [2] * n if r.random() < 0.5 else [0, 1, *r.integers(0, 2, n - 2).tolist()]
        pairs = [(own[i], own[j]) for i in range(n) for j in range(i) if (side[i] == 2 or side[i] != side[j])
                 and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
        a, b = minhash.merged(np.array(own), np.array(side), np.concatenate([sorted(x) for x in sets]), np.array([*map(len, sets)]), 75)
        assert brute.groups(own, zip(a.tolist(), b.tolist())) == brute.groups(own, pairs)


def test_sketch_estimates_similarity():
    a = spans.mix(np.arange(3000)) >> np.uint64(1)
    both = np.concatenate([a[:2000], a[1000:]])
    rows = minhash.sketch(both, np.array([2000, 2000]), 1024)
    assert abs((rows[0] == rows[1]).mean() - 1 / 3) < 0.06
    tiny = minhash.sketch(a[:3], np.array([1, 0, 2]), 128)
    assert (tiny[0] != minhash._FULL).all() and (tiny[1] == minhash._FULL).all() and (tiny[2] != minhash._FULL).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


PATH = public_tokenizers.path("piece_bpe_32k.model")


def _library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_pieces_equal_the_library(spark, docs, odd, none):
    lib, r = _library(), random.Random(3)
    texts = ["".join(r.choice("abcdetshrin ▁  \n\té一😀'.,-=0123ABCS") for _ in range(r.randrange(60))) for _ in range(1500)]
    texts += ["x" * 400 + "é" * 150, " " * 40, "====" * 40, "", "a"] + [t for _, t in ROWS if t]
    got = []
    for _, _, ids, counts in sentence_pieces.encode_column(PATH, pa.array(texts)):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == lib.encode(texts)
    rows = {x.doc_id: x for x in sentence_pieces.encode(docs, PATH, ["doc_id"]).collect()}
    for d, t in ROWS:
        ids = lib.encode(t or "")
        assert rows[d].ids == ids and rows[d].decoded_sha256 == brute.sha(lib.decode(ids))
        assert rows[d].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    back = {x.doc_id: x.text for x in sentence_pieces.decode(sentence_pieces.encode(docs, PATH, ["doc_id"]), PATH).collect()}
    assert all(back[d] == (t or "").replace("▁", " ") for d, t in ROWS)
    assert sentence_pieces.encode(odd, PATH, ["doc_id"]).count() == 9 and not sentence_pieces.encode(none, PATH).collect()


def test_token_files(spark, docs, odd, none):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    def write(df):
        path = scratch(spark, "test-ids")
        token_files.write_ids(df, path, public_tokenizers.path("word_bpe_49k.json"), 2)
        return token_files.read_ids(spark, path, with_ids=True)
    got, start = {r.doc_id: r for r in write(docs).collect()}, 0
    for d, t in sorted(ROWS):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        r = got[d]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    rows = sorted(write(odd).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [1, 1, 2, 3, 4, 40, None, None, None]
    assert not write(none).collect()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_elias_fano(n):
    r = np.random.default_rng(n)
    values = np.sort(r.integers(0, 10 ** r.integers(1, 12), n))
    code = token_files.EliasFano.from_bytes(token_files.EliasFano.of(values).to_bytes())
    assert (code.values() == values).all() and (code.select(np.arange(n)) == values).all()
    assert all(code.select(i) == values[i] for i in range(0, n, 7))
    if n == 1000:
        assert len(token_files.EliasFano.of(values).to_bytes()) < 8 * n * 0.8


def test_fingerprints(spark, docs, odd, none):
    got = {r.doc_id: r for r in fingerprints.fingerprint_neighbours(docs).collect()}
    ordered = sorted(ROWS)
    one = lambda t: fingerprints.fingerprints(*spans.utf8(pa.array([t], pa.large_string())))[0]
    for k, (d, t) in enumerate(ordered):
        t, u = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), brute.sha(e))
        assert got[d].near_edited == pytest.approx(fingerprints.likeness(one(t), one(e)))
        assert got[d].near_next == pytest.approx(fingerprints.likeness(one(t), one(u)))
    assert got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1 and got[2].near_next > 0.7
    assert got[13].near_edited > 0.3 > 0.1 > got[13].near_next
    assert fingerprints.fingerprint_neighbours(odd).count() == 9 and not fingerprints.fingerprint_neighbours(none).collect()
    alone = fingerprints.fingerprint_neighbours(table(spark, [(1, BASE)])).first()
    assert alone.near_next == 1


def test_entropy_sums():
    data = np.random.default_rng(0).integers(97, 110, 400).astype(np.uint8)
    sums = fingerprints._entropy_sums(data)
    for i in range(fingerprints.WINDOW - 1, 400, 17):
        counts = np.bincount(data[i - fingerprints.WINDOW + 1: i + 1])
        assert sums[i] == fingerprints._SUM[counts].sum()


def test_mix(spark, docs, odd, none):
    got = mixing.mix(docs).collect()
    sizes, source = {d: len(brute.WORD.findall(t or "")) for d, t in ROWS}, dict(zip((d for d, _ in ROWS), "abcab" * len(ROWS)))
    whole = {s: sum(n for d, n in sizes.items() if source[d] == s) for s in "abc"}
    weight, total, capped = dict(a=5, b=2, c=1), sum(sizes.values()), set()
    while True:
        left = total - sum(3 * whole[s] for s in capped)
        target = {s: 3 * whole[s] if s in capped else left * w / sum(weight[x] for x in "abc" if x not in capped) for s, w in weight.items()}
        more = {s for s in "abc" if target[s] > 3 * whole[s]}
        if not more - capped:
            break
        capped |= more
    for r in got:
        assert r.size == sizes[r.doc_id] and r.source_size == whole[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken <= 3 * r.size and r.taken == sum(s.words for s in r.shares)
    for s in "abc":
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 1
    first = [r.shares[0].position for r in got if r.shares]
    assert first == sorted(first) and got == mixing.mix(docs).collect()
    assert mixing.mix(odd).count() == 9 and not mixing.mix(none).collect()


def test_mix_of_sources_without_words(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    blank = [(10, None, "b"), (11, "", "b"), (12, " \n", None)]
    got = {r.doc_id: r for r in mixing.mix(make([(i, prose(20, i), "a") for i in range(4)] + blank)).collect()}
    assert len(got) == 7 and sum(r.taken for r in got.values()) == 80 and all(got[i].taken == 20 for i in range(4))
    assert all((got[i].target, got[i].taken, got[i].shares) == (0, 0, []) for i in (10, 11, 12))
    assert [(r.target, r.taken, r.shares) for r in mixing.mix(make(blank)).collect()] == [(0, 0, [])] * 3


def test_mix_schedule_inverts(spark):
    rows = [(i, prose(50, i)) for i in range(300)]
    df = spark.createDataFrame([(d, t, s) for (d, t), s in zip(rows, "ab" * 150)], "doc_id bigint, text string, source string")
    got = [(r.source, s.position, s.words) for r in mixing.mix(df, (1, 1), (-0.9, 0.9)).collect() for s in r.shares]
    total = sum(w for *_, w in got)
    for s, a in (("a", -0.9), ("b", 0.9)):
        own = sum(w for x, p, w in got if x == s and p < total / 2)
        t = 0.5  # both sources have equal targets, so half of the positions are half of the time
        assert own / sum(w for x, _, w in got if x == s) == pytest.approx(t + a * (t * t - t), abs=0.03)


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there\nHow are  you?"), (1, 1, "assistant", "> hello there\n> how are you?\nFine."),
            (1, 2, "user", "On Monday X wrote:\n>> Hello there\n>> How are you?\n> Fine.\nGood!\n\nAnd now?"),
            (1, 3, "user", "> how are you?\nme too"), (1, 4, None, "> And now?\nlater"), (1, 5, "user", "> nothing known\n"),
            (2, 0, "user", None), (2, 1, "user", "> Hello there\nx"), (None, 0, "user", "> a\nb"), (3, 1, "user", "> self\nself"), (3, 1, "user", "dup")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, parent int")
    got = [tuple(r)[:7] for r in quotes.conversations_by_reply(df).collect()]
    assert got == [
        (None, 0, "user", "b", None, 0, 0), (1, 0, "user", "Hello there\nHow are  you?", None, 0, 0), (1, 1, "assistant", "Fine.", 0, 0, 1),
        (1, 2, "user", "Good!\n\nAnd now?", 1, 0, 2), (1, 3, "user", "me too", 0, 0, 1), (1, 4, None, "later", 2, 0, 3),
        (1, 5, "user", "", None, 5, 0), (2, 0, "user", None, None, 0, 0), (2, 1, "user", "x", None, 1, 0),
        (3, 1, "user", "dup", None, 1, 0), (3, 1, "user", "self", None, 1, 0)]
    assert not quotes.conversations_by_reply(df.limit(0)).collect()
    wrapped = [(5, 1, "user", "one two\nthree four"), (5, 2, "assistant", "> one two three\n> four\nyes"), (5, 2, "assistant", "> one two three\n> four\nyes")]
    twice = quotes.conversations_by_reply(spark.createDataFrame(wrapped, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert [(r.turn, r.parent_turn) for r in twice] == [(1, None), (2, 1), (2, 1)]  # lines of a repeated row do not interleave
    long = spark.createDataFrame([(7, 0, "user", "word 0")] + [(7, i, "user", f"> word {i - 1}\nword {i}") for i in range(1, 40)],
                                 "conv_id bigint, turn bigint, role string, text string")
    assert [(r.turn, r.depth) for r in quotes.conversations_by_reply(long).collect()] == [(i, i) for i in range(40)]


def vectors(seed=0, families=30):
    r = np.random.default_rng(seed)
    base = r.normal(size=(families, 16))
    rows = [b + r.normal(size=16) * s for b in base for s in (0, 0, 0.05, 0.1, 0.2, 0.3)]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("leaf", [4096, 25])
def test_cover_tree(spark, leaf):
    rows = vectors()
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    link = v @ v.T >= 0.95
    np.fill_diagonal(link, False)
    want = brute.groups(range(len(rows)), zip(*np.nonzero(link)))
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (905, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows + odd], "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(df, leaf=leaf).collect()}
    assert all(got[i] == (link[i].sum(), want[i], want[i] == i) for i in range(len(rows)))
    assert all(got[i] == (0, i, True) for i in range(900, 906)) and got[None] == (0, None, True)
    assert not covertree.near_vectors(df.limit(0)).collect()


def against_brute_force(spark, points, leaf):
    v = points.astype(np.float32).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    v = v / np.linalg.norm(v, axis=1)[:, None]
    link = v @ v.T >= 0.95
    np.fill_diagonal(link, False)
    want = brute.groups(range(len(rows)), zip(*np.nonzero(np.triu(link))))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_vectors(df, leaf=leaf).collect()}
    assert got == {i: (link[i].sum(), want[i]) for i in range(len(rows))}
    return df


def test_cover_tree_of_unequal_depth(spark):
    """A crowded cluster is split further than the leaves beside it that hold its neighbours."""
    r = np.random.default_rng(5)
    base = r.normal(size=(4, 16))
    points = np.concatenate([base[0] + r.normal(size=(900, 16)) * 0.1, base[0] + r.normal(size=(60, 16)) * 0.25,
                             *(b + r.normal(size=(20, 16)) * 0.3 for b in base[1:])])
    df = against_brute_force(spark, r.permutation(points), 25)
    split = covertree._split(df.selectExpr("vec_id AS node", "1L AS copies", "cast(embedding AS array<double>) AS v"), 25)[0]
    depths = {next(d for d in range(11) if path < 64 ** d) for path, in split.select("path").distinct().collect()}
    assert max(depths) - min(depths) >= 2


def test_a_leaf_links_each_pair_once():
    """One loose cluster, wider than a net, with more candidates than a chunk holds."""
    r = np.random.default_rng(6)
    v = covertree._units(r.normal(size=16) + r.normal(size=(3000, 16)) * 0.15)
    link = v @ v.T >= 0.95
    np.fill_diagonal(link, False)
    assert link.sum() > 2 << 20
    ids = np.arange(3000)
    row = {"a": 1, "b": 1, "width": 8, "ids_a": ids.tobytes(), "copies_a": np.ones(3000, np.int64).tobytes(), "raw_a": v.tobytes(),
           "nets_a": covertree.nest(v).tobytes()}
    got, links, root = covertree._link(row, 0.95)
    want = brute.groups(ids.tolist(), zip(*(x.tolist() for x in np.nonzero(np.triu(link)))))
    assert (got == ids[link.any(axis=1)]).all() and (links == link.sum(axis=1)[got]).all()
    assert root.tolist() == [want[i] for i in got.tolist()]
    nets = covertree.Nets(v, covertree.nest(v).reshape(3, -1))
    assert len(nets.levels[-1][0]) > 1
    for limit in (5000, 1 << 22):
        i, j = map(np.concatenate, zip(*covertree.traverse(nets, nets, 0.95, True, limit)))
        assert (i != j).all() and len(np.unique(np.minimum(i, j) * 3000 + np.maximum(i, j))) == len(i)


def test_pairs_of_leaves_are_never_shuffled(spark, monkeypatch):
    """Leaves go to the tasks in groups, so that disk does not grow with their pairs; any groups give the same links."""
    plans, write = [], covertree.kept
    monkeypatch.setattr(covertree, "_GROUP", 20_000)

    def kept(df, purpose):
        plans.extend([df._jdf.queryExecution().toString()] * (purpose == "links"))
        return write(df, purpose)
    monkeypatch.setattr(covertree, "kept", kept)
    r = np.random.default_rng(9)
    base = r.normal(size=(60, 16))
    against_brute_force(spark, r.permutation(np.concatenate([b + r.normal(size=(20, 16)) * s for b, s in zip(base, r.choice([0.05, 0.2, 1], 60))])), 100)
    assert len(plans) > 3 and not any("Exchange" in p or "Repartition" in p for p in plans)


def test_products_bound_like_distances():
    """The bound in single precision keeps all pairs of nodes that may hold a link."""
    r = np.random.default_rng(10)
    v = covertree._units(r.normal(size=(60, 8))[r.integers(0, 60, 900)] + r.normal(size=(900, 8)) * r.choice([0.05, 0.2, 0.6], (900, 1)))
    one, two = (covertree.Nets(x, covertree.nest(x).reshape(3, -1)) for x in (v[:500], v[500:]))
    for nets in ((one, two), (two, one)):
        a, b = nets[0].points, nets[1].points
        want = {tuple(x) for x in np.argwhere(a @ b.T >= 0.95).tolist()}
        for start in range(3):
            one.start = two.start = start
            i, j = map(np.concatenate, zip(*covertree.traverse(*nets, 0.95, False)))
            assert len(want) > 100 and want <= set(zip(i.tolist(), j.tolist())) and len(set(zip(i.tolist(), j.tolist()))) == len(i)


def test_paths_stay_within_64_bits(spark):
    """Vectors of one direction are never parted, so the split goes as deep as it may."""
    df = spark.createDataFrame([(i, 1, [3.0 * 2.0 ** i, 2.0 ** i]) for i in range(40)], "node bigint, copies bigint, v array<double>")
    rows, nodes = covertree._split(df, 25)
    assert {r.path for r in rows.collect()} == {sum(64 ** k for k in range(10))} and nodes.count() == 10


def test_toxicity(spark, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.Toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in model.score(docs, ["doc_id"]).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(got[r.doc_id].predicted == r.toxic for r in held) / len(held) > 0.94
    assert not any(got[r.doc_id].predicted for r in held if not r.toxic)
    extra = table(spark, [(1, None), (None, ""), (3, "you idiot, you moron! " + prose(30, 1)), (4, prose(40, 2)), (4, prose(40, 2))])
    rows = model.score(extra, ["doc_id"]).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows) and rows[0].score == rows[1].score
    assert not model.score(none, ["doc_id"]).collect()
    unlabelled = toxicity.Toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in unlabelled.score(extra, ["doc_id"]).collect()} == {0.0}
