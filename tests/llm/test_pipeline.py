"""The pipeline stage by stage, and the registered queries against their SQL."""
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from catalog.check import compare, duck
from stallwise.llm.common import kept

from . import brute
from .test_operators import BASE, PASSAGE, edited, prose

SF = "/root/testdata/sf0.001"
SQL = sorted(n for n in entry.oracle_sql() if n.startswith("op"))


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, name):
    ok, message = compare(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, message


def test_stages(spark):
    rows = [(1, BASE), (2, edited(BASE, 60, 1)), (3, "A line of some length\n" + prose(80, 3)), (4, "a line of some length\n" + prose(70, 4)),
            (5, None), (6, "you stupid moron, you worthless idiot! scum trash loser " + prose(40, 5)), (7, PASSAGE), (7, PASSAGE), (None, prose(30, 6))]
    docs = spark.createDataFrame([(d, t, "en", s, None, "x") for (d, t), s in zip(rows, "ababababa")],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    tables = []
    for name, stage in pipeline.STAGES:
        docs = kept(stage(spark, docs, SF), "test-stage")
        tables.append(docs.collect())
        if name != "sentence_pieces":
            assert docs.columns == pipeline.COLUMNS
    tox, cut, near, mixed, ids = tables
    assert len(tox) >= 7
    left = [(r.doc_id, r.text) for r in tox]
    known = [(d, t) for d, t in left if d is not None]
    want = sorted((d, t) for d, _, _, t in brute.lines(known))
    assert sorted((r.doc_id, r.text) for r in cut if r.doc_id is not None) == want
    keep = {d for d, (_, _, ok) in brute.near(want).items() if ok}
    assert sorted(r.doc_id for r in near if r.doc_id is not None) == sorted(keep) and sum(r.doc_id is None for r in near) == 1
    words = lambda t: len(brute.WORD.findall(t))
    assert abs(sum(words(r.text) for r in mixed) - sum(words(r.text) for r in near if r.doc_id is not None)) <= 2
    assert all(r.n_chars == len(r.text) for r in mixed) and len(ids) == len(mixed)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = kept(stage(spark, docs, SF), "test-stage")
        assert docs.count() == 0
