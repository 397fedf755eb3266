"""Parts of any size in vectors, gaps in Elias-Fano codes, single documents of a file set, samples of huge label tables."""
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stallwise.llm import covertree, mixing, token_files
from stallwise.llm.common import scratch

from . import brute


@pytest.mark.parametrize("leaf", [4096, 25])
def test_vectors_of_any_size_link_by_direction(spark, leaf):
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 8))
    points = np.repeat(base, 6, axis=0) + 0.05 * r.normal(size=(72, 8))
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    want = brute.groups(range(72), zip(*np.nonzero(np.triu(link))))
    sizes = [1.0, 1e200, 1e-200, 1e307, 1e-300, 3e150]
    rows = [(i, (x * sizes[i % 6]).tolist()) for i, x in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_vectors(df, leaf=leaf).collect()}
    assert got == {i: (link[i].sum(), want[i]) for i in range(72)} and link.sum() > 72
    least = spark.createDataFrame([(1, [5e-324, 0.0]), (2, [1.7e308, 0.0]), (3, [0.0, 5e-324])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in covertree.near_vectors(least).orderBy("vec_id").collect()] == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_select_crosses_wide_gaps():
    for values in ([0] * 200 + [10 ** 12] * 200, list(range(500)) + [1 << 40], [7], [0] * 64, [5] * 65 + [6, 900, 901, 10 ** 6]):
        code = token_files.EliasFano.from_bytes(token_files.EliasFano.of(values).to_bytes())
        assert code.select(np.arange(len(values))).tolist() == values and code.select(len(values) - 1).tolist() == values[-1:]


def test_single_documents_of_a_file_set(spark):
    path, folder = public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "ids")
    rows = [(i, None if i % 50 == 3 else f"text number {i} of many " * (i % 9)) for i in range(0, 900, 3)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    token_files.write_ids(docs, folder, path, 2)
    library = Tokenizer.from_file(path)
    wanted = [0, 3, 9, 450, 897, 898, None, 3]
    got = token_files.fetch_ids(spark.createDataFrame([(w,) for w in wanted], "doc_id bigint"), folder).collect()
    want = {d: [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows if d in (0, 3, 9, 450, 897)}
    assert {r.doc_id: r.ids for r in got} == want and len(got) == 5 and all(r.n_tokens == len(r.ids) for r in got)


def test_op5_positions_invert_the_schedules(spark, tmp_path):
    """The words due by a position, over all sources, are about that position; nothing taken has none."""
    rows = [(i, "w " * (1 + i % 40), "abc"[i % 3]) for i in range(600)] + [(900, None, "a"), (901, "", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in mixing.op5_source_mix(spark, str(tmp_path)).collect()}
    assert all((r.first_position is None) == (r.taken == 0) and (r.taken == 0 or r.first_position <= r.last_position) for r in got.values())
    total = sum(r.taken for r in got.values())
    single = [(r.first_position, r.taken) for r in got.values() if 0 < r.taken <= r.size]
    again = [(p, r.taken / 2) for r in got.values() if r.taken > r.size for p in (r.first_position, r.last_position)]
    due = sorted(single + again)
    done = np.cumsum([w for _, w in due])
    assert max(abs(done - [p for p, _ in due])) < 0.05 * total
