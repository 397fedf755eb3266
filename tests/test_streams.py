"""Stream state: what epochs write, repeated and failed epochs, hot keys, equality with plain Python."""
import os
import random

import pytest
from pyspark.sql import functions as F

from stallwise.operators import snapshots
from stallwise.session import work_dir
from stallwise.streaming import cycle, price_changes, rate_limit, runner
from stallwise.streaming.versioned import VersionedTable


def as_set(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def test_versioned_table_equals_a_dictionary(spark):
    r = random.Random(5)
    table, model, history = VersionedTable(spark, work_dir(spark, "versions"), ["id"], buckets=4), {}, []
    for epoch in range(7):
        changed = {r.randrange(60): f"v{epoch}-{i}" for i in range([40, 3, 0, 25, 2, 1, 30][epoch])}
        gone = [k for k in sorted(model) if k not in changed][: epoch % 3]
        model = {k: v for k, v in {**model, **changed}.items() if k not in gone}
        history.append(dict(model))
        rows = spark.createDataFrame(list(changed.items()), "id long, v string")
        table.apply(epoch, rows, spark.createDataFrame([(k,) for k in gone], "id long"))
        assert as_set(table.changes(epoch)) == sorted(changed.items())
    for epoch, want in enumerate(history):  # earlier epochs stay readable
        assert as_set(table.read(epoch)) == sorted(want.items())
    assert any(p.kind == "whole" for p in table.pieces(6)) and table.read(-1) is None


def test_an_epoch_writes_what_changes(spark):
    table = VersionedTable(spark, work_dir(spark, "versions"), ["id"], buckets=8)
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id long, v long")
    assert table.apply(0, rows(range(2000), 0)) == 2000
    spent = [table.apply(e, rows(range(e, 2000, 200), e)) for e in range(1, 12)]
    assert all(n == 10 for n in spent)
    assert table.apply(12, rows(range(1500), 12)) < 1500 + 2 * 2000
    assert table.read(12).where("v = 12").count() == 1500 and table.read(12).count() == 2000


def snapshot(spark, run, prices, **more):
    rows = [("p", i, run, float(p), "EUR", f"t{i}") for i, p in prices.items()]
    return spark.createDataFrame(rows, "profile string, id long, run int, price double, currency string, title string")


def cards(ids):
    return ids.withColumn("fetched_at", F.lit(9)).withColumn("top", F.col("id") * 2)


def test_cycle_writes_changes_and_repeats_epochs(spark):
    """Thousands of listings seen again cost nothing; latest and first columns come along."""
    tables = cycle.CycleTables(spark, work_dir(spark, "cycle"))
    options = {"latest": ["title"], "first": ["currency0"]}
    with_first = lambda df: df.withColumn("currency0", F.col("currency"))
    base = {i: 100 + i for i in range(1500)}
    runs = [base, {**base, 3: 90}, {k: v for k, v in {**base, 3: 90, 2000: 5}.items() if k != 7}, {**base, 3: 90, 2000: 5}]
    whole = None
    for epoch, prices in enumerate(runs):
        batch = with_first(snapshot(spark, epoch, prices))
        whole = batch if whole is None else whole.unionByName(batch)
        if epoch == 2:  # an epoch that failed before its record
            with pytest.raises(RuntimeError):
                cycle.cycle_step(batch.where("id % 3 = 0"), epoch, tables, lambda ids: (_ for _ in ()).throw(RuntimeError("lost")), **options)
            assert tables.last_epoch() == 1
        cycle.cycle_step(batch, epoch, tables, cards, **options)
    written = {r.epoch: (r.state_rows, r.detail_rows) for r in tables.commits().collect()}
    assert written == {0: (1500, 1500), 1: (1, 0), 2: (2, 1), 3: (1, 0)}
    want = snapshots.replay(whole, ["profile", "id"], ["profile"], **options)
    got = cycle.results(tables)
    columns = ["id", "price", "prev_price", "price_changed_at", "first_price", "first_seen", "last_seen", "gone_at", "title", "currency0"]
    assert as_set(got["state"].fillna(-1), *columns) == as_set(want.state.fillna(-1), *columns)
    assert as_set(got["audit"]) == as_set(want.audit.select(*got["audit"].columns))
    assert as_set(got["history"].fillna(-1), "id", "run", "price", "prev_price") == as_set(want.history.fillna(-1), "id", "run", "price", "prev_price")
    before = {n: as_set(df.fillna(-1)) for n, df in got.items()}
    cycle.cycle_step(with_first(snapshot(spark, 3, runs[3])), 3, tables, cards, **options)
    assert {n: as_set(df.fillna(-1)) for n, df in cycle.results(tables).items()} == before


def folded(rows, tol=0.5):
    out, stored = [], None
    for run, price, currency in rows:
        if stored is None:
            stored = (price, currency)
            out.append((run, price, None))
        elif price is not None and stored[0] is not None and (abs(price - stored[0]) > tol or currency != stored[1]):
            out.append((run, price, stored[0]))
            stored = (price, currency)
    return out


def listings_that_drift(seed, n=120):
    r, data = random.Random(seed), {}
    for i in range(n):
        price, rows = 100.0, []
        for run in range(r.randrange(1, 200 if i < 4 else 40)):
            price += r.choice([0, 0.2, 0.3, -0.4, 0.5, 0.6, 1.0, 1.25, 1.3, -3, 10])
            rows.append((run, None if r.random() < 0.15 else round(price, 3), r.choice(["EUR"] * 12 + ["USD"])))
        data[i] = rows
    return data


def test_fold_equals_the_loop(spark):
    data = listings_that_drift(1)
    df = spark.createDataFrame([(i, *x) for i, rows in data.items() for x in rows], "id long, run int, price double, currency string")
    got = {}
    for x in snapshots.price_history(snapshots.fold_prices(df)).collect():
        got.setdefault(x.id, []).append((x.run, x.price, x.prev_price))
    assert {i: sorted(v) for i, v in got.items()} == {i: folded(rows) for i, rows in data.items()}


def test_fold_of_one_long_listing(spark):
    slow = spark.range(10_000).selectExpr("1L AS id", "cast(id AS int) AS run", "id * 0.6 AS price", "'EUR' AS currency")
    points = snapshots.price_history(snapshots.fold_prices(slow))
    assert points.count() == 10_000 and points.where("prev_price < price").count() == 9_999


def feed(spark, rows, schema, parts):
    """A folder with one file a part, in order, read one file a trigger."""
    folder = work_dir(spark, "feed")
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size: (i + 1) * size], schema).coalesce(1).write.parquet(os.path.join(folder, f"in{i:02d}"))
        [name] = [f for f in os.listdir(os.path.join(folder, f"in{i:02d}")) if f.endswith(".parquet")]
        target = os.path.join(folder, f"{i:02d}.parquet")
        os.link(os.path.join(folder, f"in{i:02d}", name), target)
        os.utime(target, (1_700_000_000 + i,) * 2)
    return runner.file_stream(spark, folder, "*.parquet", files_per_trigger=1)


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_of_prices_equals_the_loop(spark, parts):
    data = listings_that_drift(2, 30)

    rows = sorted(((run, i, price, currency) for i, own in data.items() for run, price, currency in own), key=lambda x: x[:2])
    stream = feed(spark, rows, "run_us long, id long, price double, currency string", parts)
    got = {}
    for x in price_changes.price_changes(stream, work_dir(spark, "prices")).collect():
        got.setdefault(x.id, []).append((x.run_us, x.price, x.prev_price))
    assert {i: sorted(v) for i, v in got.items()} == {i: folded(own) for i, own in data.items()}


@pytest.mark.parametrize("parts", [1, 5])
def test_rate_limit_with_a_hot_key(spark, parts):
    r = random.Random(4)
    rows, t = [], 0
    for i in range(3000):
        t += r.choice([0, 1, 1, 2, 30]) * 1_000_000
        rows.append(("hot" if r.random() < 0.5 else f"k{r.randrange(40)}", t, i))
    want, recent = {}, {}
    for key, t, i in rows:
        live = [x for x in recent.get(key, []) if x > t - 60_000_000]
        want[i] = len(live) < 3
        recent[key] = live + [t] if want[i] else live
    stream = feed(spark, rows, "k string, t long, i long", parts)
    root = work_dir(spark, "rates")
    got = {x.id: x.accepted for x in rate_limit.rate_limit(stream, root, "k", "t", "i", limit=3, window_seconds=60).collect()}
    assert got == want
    kept = VersionedTable(spark, os.path.join(root, "rings"), ["k"]).read(parts - 1)
    assert all(len(x.times) <= 3 for x in kept.collect())
