"""The drawdown controller against a plain loop, values worked out by hand, and its stream against its table."""

import datetime as dt
import random

import pytest

from crosspanel.streaming import drawdown as Z

START = dt.datetime(2024, 1, 1)
SCHEMA = "k string, t timestamp, v double, r string"


def hours(n):
    return START + dt.timedelta(hours=n)


def found(df):
    return sorted(((r.k, r.t, r.event, r.breaker, r.value, r.fired, r.active, r.action, r.exposure, r.halted, r.days_in_drawdown) for r in df.collect()), key=str)


def test_by_hand(spark):
    """Peak 100.  -2 % alerts for 4 hours; at hour 3 it still cools; at hour 5 it was released at 4 and fires again.  -21 % fires the five
    others, of which the last stays until a reset.  A reset of all sets the peak to the current value."""
    rows = [(0, 100.0, None), (0.5, 98.0, None), (3, 98.0, None), (5, 98.0, None), (6, 79.0, None), (200, 100.0, None), (201, None, "drawdown_20pct"), (202, 90.0, None), (203, None, "all"), (204, 90.0, None)]
    df = spark.createDataFrame([("p", hours(h), v, r) for h, v, r in rows], SCHEMA)
    out = Z.controlled(df, ["k"], "t", "v", "r").orderBy("t", "event").collect()
    got = [((r.t - START).total_seconds() / 3600, r.event, r.breaker or r.fired, r.active.count("pct") if r.active is not None else None, r.exposure, r.halted) for r in out]
    five = "daily_loss_3pct,daily_loss_5pct,drawdown_10pct,drawdown_15pct,drawdown_20pct"
    assert got == [
        (0, "value", "", 0, 1.0, False), (0.5, "value", "daily_loss_2pct", 1, 1.0, False), (3, "value", "", 1, 1.0, False),
        (4.5, "release", "daily_loss_2pct", None, None, None), (5, "value", "daily_loss_2pct", 1, 1.0, False), (6, "value", five, 6, 0.25, True),
        (9, "release", "daily_loss_2pct", None, None, None), (14, "release", "daily_loss_3pct", None, None, None), (30, "release", "daily_loss_5pct", None, None, None),
        (54, "release", "drawdown_10pct", None, None, None), (78, "release", "drawdown_15pct", None, None, None),
        (200, "value", "", 1, 0.25, True), (201, "reset", "drawdown_20pct", 0, 1.0, False),
        (202, "value", "daily_loss_2pct,daily_loss_3pct,daily_loss_5pct,drawdown_10pct", 4, 0.5, True), (203, "reset", "all", 0, 1.0, False), (204, "value", "", 0, 1.0, False),
    ]
    last = {r.t: r for r in out if r.event == "value"}
    assert last[hours(6)].drawdown == pytest.approx(-0.21) and last[hours(6)].action == "full_deleverage" and last[hours(6)].recovery == pytest.approx(100 / 79 - 1)
    assert last[hours(200)].days_in_drawdown == 0 and last[hours(204)].peak == 90.0


def test_latched_breaker_fires_again_after_its_cool_down(spark):
    df = spark.createDataFrame([("p", hours(h), v, None) for h, v in ((0, 100.0), (1, 70.0), (100, 70.0), (169, 70.0), (400, 99.0))], SCHEMA)
    got = {(r.t - START).total_seconds() // 3600: ("drawdown_20pct" in r.fired, "drawdown_20pct" in r.active) for r in Z.controlled(df, ["k"], "t", "v", "r").filter("event = 'value'").collect()}
    assert got == {0: (False, False), 1: (True, True), 100: (False, True), 169: (True, True), 400: (False, True)}


def series(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for k in "abc":
        value, h = 100.0, 0.0
        for _ in range(n):
            value, h = value * (1 + rng.uniform(-0.03, 0.029)), h + rng.choice([0.25, 1, 5, 30])
            rows.append((k, hours(h), value, None))
            if rng.random() < 0.04:
                rows.append((k, hours(h), None, rng.choice(["all", "drawdown_20pct", "drawdown_10pct"])))
    return rows


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def test_stream_equals_table(rocks, tmp_path):
    """Rows in batches, out of order within the watermark's delay, some twice, some again after they were taken; with a restart between."""
    spark, rows = rocks, series(1)
    rng = random.Random(2)
    delay = dt.timedelta(hours=40)
    order = sorted(rows, key=lambda r: r[1] + delay * rng.random() * 0.9)
    batches = [order[i : i + 90] for i in range(0, len(order), 90)]
    for i, b in enumerate(batches[1:], 1):
        b += rng.sample(batches[i - 1], 10) + rng.sample(batches[0], 10)
    batches.append([("zz", max(r[1] for r in rows) + dt.timedelta(hours=300), 1.0, None)])  # moves the watermark on
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = Z.controlled_stream(stream, ["k"], "t", "v", "40 hours", "r")

    def run(files):
        for i, b in files:
            spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        q = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").start()
        q.processAllAvailable()
        q.stop()

    numbered = list(enumerate(batches))
    for b in numbered[:3]:
        run([b])
    run(numbered[3:])
    got = found(spark.read.parquet(f"file://{tmp_path}/out").filter("k <> 'zz'"))
    end = batches[-1][0][1] - delay
    want = found(Z.controlled(spark.createDataFrame(rows, SCHEMA), ["k"], "t", "v", "r", until=end))
    assert sorted(set(want) - set(got), key=str)[:3] == [] and sorted(set(got) - set(want), key=str)[:3] == [] and len(got) == len(want) > len(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([("p", START, None, None), ("p", None, 1.0, None), (None, START, 5.0, None), (None, START, 5.0, None), ("q", START, None, "all"), ("q", hours(1), 0.0, None)], SCHEMA)
    out = sorted(((r.k, r.event, r.value, r.drawdown, r.recovery) for r in Z.controlled(df, ["k"], "t", "v", "r").collect()), key=str)
    assert out == [("q", "reset", None, None, None), ("q", "value", 0.0, 0.0, 0.0), (None, "value", 5.0, 0.0, 0.0)]
    assert Z.controlled(df.limit(0), ["k"], "t", "v", "r").count() == 0
