"""Entities and printed values against Python's own."""
import html
import random

from stallwise.functions import payload, text


def test_entities_decode_as_in_python(spark):
    rng = random.Random(5)
    names = sorted(html.entities.html5)
    samples = ["", "a & b", "&", "&&amp;", "&amp;lt;", "&ampx &notit; &notin; &copy2 &#x41;&#65 &#0;&#128;&#x81; &#xD800; &#1114112; &#99999999999999; &#11;x",
               "&unknown; &;", "é &eacute;&Eacute;&nbsp;|", "&#x1F600; &#xFFFE;", "&CounterClockwiseContourIntegral;", "&lt&gt", "&am; &amp"]
    samples += ["".join(rng.choice(["&" + rng.choice(names), "&" + rng.choice(names).rstrip(";"), " text ", ";", "&#%d;" % rng.randrange(1, 70000)])
                        for _ in range(8)) for _ in range(300)]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    for r in df.select("t", text.unescape("t").alias("u")).collect():
        assert r.u == html.unescape(r.t), r.t


def test_values_print_as_in_python(spark):
    cases = {"true": "True", "false": "False", "null": "", "12": "12", '"x"': "x", "[true,null,1]": "True, None, 1", '["true", false]': "true, False",
             '{"value": true}': "True", '{"value": null, "unit": "m3"}': "None m3", '{"value": 5, "unit": "m3", "bargain": true}': "5 m3 (торг)"}
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    for r in df.select("v", payload.feature_text("v").alias("t")).collect():
        assert r.t == cases[r.v], r.v


def test_white_space_is_stripped(spark):
    df = spark.createDataFrame([("name", "a@b.cd", "\n" * 11), ("\t name ", "a@b.cd", "\n long enough text \t")], "n string, e string, b string")
    rows = df.select(text.first_problem("n", "e", "b").alias("p"), text.message_fields("n", "e", "b")["body"].alias("body")).collect()
    assert rows[0].p == "body too short" and rows[1].p is None and rows[1].body == "long enough text"
