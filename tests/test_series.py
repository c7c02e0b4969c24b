import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators import series as T
from pulsegrid.operators import windows as W
from pulsegrid.plans.columns import plan
from pulsegrid.streaming import folds

NOW = 1_700_000_000


@pytest.mark.parametrize(
    ("seconds", "tier", "columns", "width"),
    [(3600, "t0", 360, 10), (21600, "t0", 720, 30), (86400, "t1", 720, 120), (604800, "t1", 504, 1200), (2592000, "t2", 1440, 1800), (31536000, "t2", 1460, 21600)],
)
def test_plan(seconds, tier, columns, width):
    p = plan(seconds, NOW)
    assert (p.tier, p.columns, p.seconds) == (tier, columns, width)


def test_plan_widens():
    assert (plan(2592000, NOW, 400).per_column, plan(2592000, NOW, 400).columns) == (4, 360)
    assert plan(2592000, NOW, 1).columns == 1
    p = plan(86400, NOW, tiers=("t0",))
    assert (p.tier, p.per_column, p.columns) == ("t0", 12, 720)
    p = plan(2592000, NOW, tiers=("t0",))
    assert (p.per_column, p.columns, p.retained_columns(NOW // 10)) == (180, 1440, 48)
    assert [plan(3600, NOW).column_at(t) for t in (NOW, NOW - 3590, NOW - 3600, NOW + 10)] == [359, 0, None, None]


def samples(spark, rows):
    return spark.createDataFrame([(i, "a", int(t * 1_000_000), float(v), float(k)) for i, (t, v, k) in enumerate(rows)], "seq long, lane string, us long, value double, interval_s double")


def test_rates(spark):
    got = T.rates(samples(spark, [(NOW, 1000, 1), (NOW + 1, 1500, 1), (NOW + 6, 7500, 5), (NOW + 8, 3000, 5), (NOW + 108, 7500, 5)])).orderBy("seq")
    assert [r["value"] for r in got.collect()] == [1000, 1500, 1500, 1500, 1500]


def test_finite_only(spark):
    got = T.accepted(samples(spark, [(NOW, float("nan"), 1), (NOW, float("inf"), 1), (NOW, 1e300, 1), (NOW, 42, 1), (-5, 1, 1)]))
    assert [r["value"] for r in got.collect()] == [42]


def test_span_attribution(spark):
    start = NOW // 10 * 10
    got = {r["bucket"] - start // 10: r for r in T.attribute_spans(samples(spark, [(start, 10, 60), (start + 60, 20, 60)]), 10).collect()}
    assert sorted(got) == list(range(-6, 7))
    assert (got[0]["count"], got[0]["min"], got[0]["max"], got[0]["sum"]) == (2, 10, 20, 30)
    assert all(got[k]["count"] == 1 for k in got if k)


def test_hold(spark):
    got = T.hold(samples(spark, [(1_700_000_005, 82, 0), (1_700_000_055, 81, 0)]), 10, (1_700_000_005 + 50) * 1_000_000).orderBy("bucket").collect()
    assert [(r["bucket"] - 170_000_000, r["sum"], r["reason"]) for r in got] == [(0, 82, 1), (1, 82, 5), (2, 82, 5), (3, 82, 5), (4, 82, 5), (5, 81, 1)]
    got = T.hold(samples(spark, [(1_700_000_005, 82, 0)]), 10, (1_700_000_005 + 2400) * 1_000_000)
    assert got.where("reason = 5").count() == 90


def test_rollup_reasons(spark):
    slots = spark.createDataFrame([("a", 0, 3, 1.0, 9.0, 15.0, 1), ("a", 2, 0, None, None, None, 0), ("a", 3, 2, 4.0, 6.0, 10.0, 1), ("a", 5, 1, 5.0, 5.0, 5.0, 5), ("b", 0, 0, None, None, None, 2), ("c", 1, 1, 5.0, 5.0, 5.0, 5)], "lane string, bucket long, count long, min double, max double, sum double, reason long")
    got = {r["lane"]: r for r in T.rollup(slots, 6).collect()}
    assert (got["a"]["count"], got["a"]["min"], got["a"]["max"], got["a"]["sum"], got["a"]["reason"]) == (6, 1, 9, 30, 1)
    assert got["b"]["reason"] == 2
    assert got["c"]["reason"] == 5


def test_gap_precedence(spark):
    slots = spark.createDataFrame([("a", 1006, 1)], "lane string, bucket long, count long")
    spine = spark.createDataFrame([("a", b) for b in range(1000, 1040)], "lane string, bucket long")
    spans = spark.createDataFrame([(10100, 10200, 3), (10120, 10160, 2), (10120, 10120, 4)], "from_s long, to_s long, reason long")
    got = {r["bucket"] - 1000: r["reason"] for r in T.gap_reasons(slots, spine, spans, 10, 1030).collect()}
    assert [got[k] for k in (0, 6, 8, 11, 13, 31)] == [0, 1, 0, 3, 2, 3]


def test_counter_rate(spark):
    rows = spark.createDataFrame([(1, "a", 0, 1000), (2, "a", 1_000_000, 50), (3, "a", 2_000_000, 100)], "seq long, k string, us long, c long")
    assert [r["rate"] for r in W.counter_rate(rows, "k", "c").orderBy("seq").collect()] == [0, 0, 50]


def test_speed(spark):
    rows = spark.createDataFrame([(999.0,), (2.5e6,), (150e6,), (2e12,), (-5.0,)], "v double")
    assert [r[0] for r in rows.select(S.speed(F.col("v"))).collect()] == ["0 KB/s", "2.5 MB/s", "150 MB/s", "2.0 TB/s", "0 KB/s"]


def test_top_line(spark):
    rows = spark.createDataFrame([("3127  lldb-rpc-server  611M",), ("1  x  1819M",), ("2  y  11G",), ("3  z  1442M+",), ("7163* Some App 2023  11G",)], "l string")
    parts = S.top_line(F.col("l"))
    got = rows.select(*[c.alias(n) for n, c in parts.items()]).collect()
    assert got[0]["bytes"] == 611e6 and got[2]["bytes"] == 11 * 1024e6 and got[4]["name"] == "Some App 2023"
    assert abs(got[1]["bytes"] - 1819 / 1024 * 1000 * 1e6) < 1


def test_streams_order_a_large_lane(spark, tmp_path):
    n = 25_000
    value = F.when(F.col("id") % 7 < 3, 60.0 + F.col("id")).otherwise(-F.col("id").cast("double"))
    rows = spark.range(n).select(F.lit("hot").alias("lane"), F.timestamp_seconds("id").alias("ts"), value.alias("value"), F.col("id").alias("at"))
    rows.orderBy(F.xxhash64("id")).select("lane", "ts", "value").repartition(6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("lane string, ts timestamp, value double").parquet(f"{tmp_path}/in")
    values = [60.0 + i if i % 7 < 3 else -float(i) for i in range(n)]
    held = sorted(folds.drain(folds.stream_hold(stream), "hold", str(tmp_path)).collect(), key=lambda r: r["ts"])
    assert [r["value"] for r in held] == values and [r["previous"] for r in held] == [None, *values[:-1]]
    alerts = folds.drain(folds.stream_streaks(stream, 50.0, 2), "alerts", str(tmp_path)).collect()
    assert sorted(r["value"] for r in alerts) == [values[i] for i in range(n) if i % 7 == 1]
