"""Texts cleaned joined equal texts cleaned one by one; pages are split once."""
import pytest
from pyspark.sql import functions as F

from stallwise import vocab
from stallwise.functions import text
from stallwise.operators import pages

ODD = [["a &amp; b", " <b>x</b>\n y ", ""], [], None, ["&#1;", "cut\x01here", "<x \x01 y>z"], [None, "a\x01b"], ["1 < 2", "3 > 2 &lt"], ["&notit", "; &am", "p;"],
       [" x ", "ΟΔΟΣ", "a ́"], ["Suprafața ", "Valoarea\testimată"], [""], ["", ""], ["&nbsp;", "&#32;&frac12x"], ["<", ">"], [None]]


@pytest.mark.parametrize("joined, single", [(text.html_clean_all, text.html_clean), (text.plain_all, text.plain)])
def test_joined_as_one_by_one(spark, joined, single):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, t array<string>")
    rows = joined(df, "got", "t").withColumn("want", F.transform("t", single)).collect()
    assert len(rows) == len(ODD) and all(r.got == r.want for r in rows)


def test_pages_are_split_once(spark, capsys):
    html = "<summary><strong> 1.1 </strong></summary><li>Adresa: <strong>a</strong></li><summary><strong>1.2</strong></summary><li>Tipul: <strong>b</strong></li>"
    df = spark.createDataFrame([(html, "{}"), (html.split("<summary>")[0], None), (None, None)], "html string, geometry string")
    assert [(u.code, u.building, u.kind) for u in pages.parse_units(df).collect()] == [("1.2", "1.1", "b")]
    assert [(b.code, b.address) for b in pages.parse_buildings(df).collect()] == [("1.1", "a")]
    pages.html_segments(df, "html", vocab.REGISTER_MARK).explain()
    # no filter derived from the explosion splits the pages again
    assert capsys.readouterr().out.count("split(html") == 1
    pages.parse_buildings(df).explain()
    assert "posexplode" not in capsys.readouterr().out
