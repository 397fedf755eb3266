"""Raw payload files and register pages, end to end. All values are invented."""
import json

from pyspark.sql import functions as F

from stallwise import vocab
from stallwise.functions import payload
from stallwise.operators import cards, pages, privacy
from stallwise.sources import listings, sinks, urls

LISTINGS = [
    {"id": "100", "title": "Flat", "price": {"id": 2, "value": {"value": 50000, "unit": "UNIT_EUR"}},
     "oldPrice": {"id": 1640, "value": {"value": None, "measurement": "UNIT_USD"}}, "street": {"id": 10, "value": "Long"},
     "mapPoint": {"id": 3, "value": {"lat": 47.0, "lon": 28.9}}, "subCategory": {"id": 1404, "title": {"translated": "Flats"}}},
    {"id": "101", "title": None, "price": {"id": 2, "value": 700}, "oldPrice": None, "street": None, "mapPoint": None, "subCategory": None},
    {"id": "102", "title": "Text price", "price": {"id": 2, "value": {"value": "700"}}},
]


def write_lines(tmp_path, name, rows):
    path = tmp_path / name
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    return str(path)


def test_listing_payloads(spark, tmp_path):
    raw = listings.read_listings(spark, write_lines(tmp_path, "l.json", LISTINGS))
    flat = {r.id: r for r in listings.flatten_listings(raw, "u/").collect()}
    assert (flat["100"].price, flat["100"].currency, flat["100"].old_price, flat["100"].old_currency) == ("50000", "EUR", "", "USD")
    assert (flat["101"].title, flat["101"].price, flat["101"].currency, flat["101"].street, flat["101"].lat, flat["101"].url) == ("", "700", "", "", None, "u/101")
    rows = {r.id: r for r in listings.snapshot_rows(raw, "apartments", "r").collect()}
    assert rows["100"].price == 50000.0 and rows["101"].price == 700.0 and rows["102"].price is None


def control(fid, title, value):
    return {"type": "x", "title": title, "feature": {"id": fid, "type": "t", "value": value}}


CARD = {
    "id": "55", "state": "open", "title": "Nice", "isExpired": False, "posted": "2024-01-02 03:04:05",
    "subCategory": {"id": 1404, "title": {"translated": "Flats"}, "parent": {"id": 1, "title": {"translated": "Homes"}, "parent": None}},
    "owner": {"id": "9", "login": "someone", "business": {"id": "b"}, "verification": {"isVerified": True}},
    "views": {"total": 12, "today": 1},
    "groups": [
        {"title": "A", "controls": [
            control(1, "Type", {"translated": "Sell"}), control(241, "Rooms", {"translated": "Студия"}),
            control(244, "Area", {"value": 30.5, "unit": "UNIT_METER_SQUARE"}), control(248, "Floor", {"translated": "4 of 9"}),
            control(2, "Price", {"value": 41000, "unit": "UNIT_EUR", "bargain": True})]},
        {"title": "B", "controls": [
            control(9, "Сектор", {"translated": "Окраина"}), control(13, "", {"translated": "Vând în rate, tel 060123456"}),
            control(14, "Photos", ["a.jpg", "b.jpg"]), control(16, "Контакты", {"phone_numbers": ["060123456", "079000000"]}),
            control(None, "Loose", "free text"), control(3, "Map", {"lat": 47.1, "lon": 28.8}), control(241, "Rooms", {"translated": "3 rooms"})]},
        {"title": "Empty", "controls": []}],
}


def test_card_payload(spark, tmp_path):
    raw = listings.read_cards(spark, write_lines(tmp_path, "c.json", [CARD, {"id": "56"}]))
    parsed = cards.parse_cards(raw, "https://media.example")
    r = parsed.where("id = 55").first()
    assert (r.rooms, r.area, r.area_unit, r.price, r.currency, r.bargain, r.category, r.district) == (
        "3 rooms", "30.5", "m²", 41000.0, "EUR", "true", "Homes / Flats", "Пригород")
    assert r.photos == ["https://media.example/900x900/a.jpg", "https://media.example/900x900/b.jpg"]
    assert r.features["Area"] == "30.5 m²" and r.features["Price"] == "41000 EUR (торг)" and r.features["Loose"] == "free text"
    assert r.features["Сектор"] == "Пригород" and r.features["Контакты"] == "060123456, 079000000" and "" not in r.features
    typed = {x.id: x for x in cards.typed_details(parsed, F.current_timestamp()).collect()}
    t = typed["55"]
    assert (t.rooms_n, t.area, t.floor, t.terms_flag, t.photos_count, t.phones) == (3, 30.5, 4, 1, 2, "060123456, 079000000")
    assert t.owner_is_business and t.owner_verified
    assert (typed["56"].rooms_n, typed["56"].area, typed["56"].photos_count, typed["56"].owner_is_business) == (None, None, 0, False)
    row = cards.export_rows(parsed, "https://x.example/").where("id = 55").first()
    assert (row.area, row.phones, row.photos_count, row.url) == ("30.5 m²", "060123456, 079000000", 2, "https://x.example/55")
    clean = privacy.strip_private(parsed).where("id = 55").first()
    assert clean.phones is None and clean.owner_login is None and "Контакты" not in clean.features
    assert clean.description == "Vând în rate, tel " + vocab.PHONE_MASK


PAGE = """<div><summary class="x">Cod <strong> 01.02.3 </strong></summary><ul>
<li>Adresa: <strong>mun. Oraș, sect. Centru str. Lungă, 12/A</strong></li><li>Anul construcției: <strong>1975</strong></li>
<li>Numărul de etaje : <strong>9</strong></li><li>Apă: <strong>da</strong></li><li>Alt câmp: <strong>ceva &amp; altceva</strong></li>
<li>Valoarea estimată: <strong>1 234 567 lei</strong></li></ul>
<summary>U <strong>01.02.3.001</strong></summary><li>Adresa: <strong>str. Lungă 12/A ap. 7</strong></li>
<li>Suprafața: <strong>45,6</strong></li><li>Etajul: <strong>3</strong></li><li>Ultimul etaj: <strong>Nu</strong></li>
<li>Valoarea estimată: <strong>500 000</strong></li><summary><strong>01.02.3.002</strong></summary>Data actualizării: 05.06.2024</div>"""


def test_register_pages(spark):
    df = spark.createDataFrame([(PAGE, "{}"), ("<p>nothing</p>", None)], "html string, geometry string")
    rows = pages.parse_buildings(df).collect()
    assert len(rows) == 1
    b = rows[0]
    assert (b.code, b.street, b.house, b.year_built, b.floors, b.water, b.value_lei, b.updated) == (
        "01.02.3", "str. Lungă", "12/A", 1975, 9, "da", 1234567, "05.06.2024")
    assert b.props == {"Alt câmp": "ceva & altceva"}
    units = {u.code: u for u in pages.parse_units(df).collect()}
    u = units["01.02.3.001"]
    assert (u.building, u.apt, u.area, u.floor, u.last_floor, u.value_lei) == ("01.02.3", "7", 45.6, 3, 0, 500000)
    assert units["01.02.3.002"].area is None


def test_request_url(spark):
    url = "https://x.example/map?o_16_1=776&o_16_1=777&from_9_2=50&to_9_2=95&unit_9_2=eur&spec=1404&o_3_4=5&junk=1"
    df = spark.createDataFrame([(1, url), (2, "https://x.example/")], "id int, url string")
    heads, rows = urls.filter_specs(df, "id", url="url")
    assert {(h.id, h.category, h.spec) for h in heads.collect()} == {(1, 270, 1404), (2, 270, None)}
    got = {(r.filter_id, r.feature_id): (r.option_ids, r.min, r.max, r.unit) for r in rows.collect()}
    assert got == {(16, 1): ([776, 777], None, None, None), (3, 4): ([5], None, None, None), (9, 2): ([], "50", "95", "UNIT_EUR")}


def test_csv_and_partitioned_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, 'quote "x", comma', 2.5)], "profile string, run int, title string, price double")
    sinks.write_csv(df, str(tmp_path / "csv"), ["title", "price"])
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert (back.title, back.price) == ('quote "x", comma', "2.5")
    sinks.write_snapshots(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).where("run = 1").count() == 1


def test_texts_of_all_values_equal_the_text_of_each(spark):
    odd = ['{"translated":"x"}', '{"translated":""}', '{"translated":"a \\"b\\""}', '{"translated":"x"}\n', '{"translated":"x","value":1}', None, "", "null",
           "true", '"quoted"', "7", "{}", "[]", '["a",true,null,1.50]', "[broken", "{broken", '{"value":1.50,"unit":"UNIT_EUR","bargain":true}',
           '{"v\\u0061lue":3}', '{"value":null,"measurement":"m"}', '{"lat":1,"lon":2}', '{"phone_numbers":["1","2"]}', " {\"translated\":\"y\"} "]
    rows = [(1, odd), (2, []), (3, odd + ["\x01"]), (4, ["\x02a", '{"translated":"\x02"}', '{"translated":"p\x01q"}']), (5, [None]), (6, ['{"translated":"$1"}'])]
    df = spark.createDataFrame(rows, "id int, vals array<string>")
    got = payload.feature_texts(df, "texts", "vals").withColumn("single", F.transform("vals", lambda v: payload.feature_text(v))).collect()
    assert len(got) == 6 and all(r.texts == r.single for r in got)
    assert got[0].texts[:9] == ["x", "", 'a "b"', "x", "x", "", "", "", "True"]


def test_last_of_repeated_titles_counts(spark, tmp_path):
    text = lambda t: {"translated": t}
    groups = [{"title": "A", "controls": [control(1, "F", text("1")), control(2, "", text("2")), control(3, "G", text("3")), control(4, None, text("4"))]},
              {"title": "B", "controls": [control(1, "Сектор", text("Окраина")), control(1, "F", text("5")), control(5, "Сектор", text("Centru")), control(6, "F", text("6"))]}]
    lone = [{"title": "A", "controls": [control(1, "F", text("1"))]}, {"title": "B"}]
    raw = listings.read_cards(spark, write_lines(tmp_path, "r.json", [{"id": "1", "groups": groups}, {"id": "2", "groups": lone}, {"id": "3"}]))
    parsed = cards.parse_cards(raw).select("id", "offer_type", F.map_keys("features").alias("names"), F.map_values("features").alias("texts"))
    got = {r.id: (r.names, r.texts, r.offer_type) for r in parsed.collect()}
    assert got == {"1": (["G", "Сектор", "F"], ["3", "Centru", "6"], "5"), "2": ([], [], ""), "3": ([], [], "")}
