"""Operators that SQL can't hold against an oracle, and their edges: brute force, damage, large keys, saturation."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.engine import Engine
from pulsegrid.model import TIERS
from pulsegrid.operators import relational as R
from pulsegrid.operators import sensors as P
from pulsegrid.operators import series as T
from pulsegrid.operators import store as K
from pulsegrid.operators import windows as W
from pulsegrid.operators.flatten import numbers
from pulsegrid.sources import archive
from pulsegrid.streaming import folds, steps


def samples(spark, values, lane="a"):
    return spark.createDataFrame([(i, lane, 10_000_000 + i, float(v)) for i, v in enumerate(values)], "seq long, lane string, us long, value double")


def test_fold_keeps_small_and_large_sums(spark):
    got = T.fold(samples(spark, [0.004] * 10), 10).first()
    assert (got["count"], got["sum"]) == (10, 0.04)
    got = T.fold(samples(spark, [1e17, 1.0, -1e17]), 10).first()
    assert got["count"] == 3 and got["max"] == 1e17


def test_full_buckets_stand_still(spark):
    ones = spark.range(70_000).select(F.col("id").alias("seq"), F.lit("a").alias("lane"), (10_000_000 + F.col("id")).alias("us"), F.when(F.col("id") < 65_535, 1.0).otherwise(F.col("id").cast("double")).alias("value"))
    got = T.fold(ones, 10).first()
    assert (got["count"], got["sum"], got["min"], got["max"]) == (65_535, 65_535.0, 1.0, 69_999.0)


def columns_of(spark, slots, gaps, per=2, n=3):
    from pulsegrid.plans.columns import ColumnPlan

    s = spark.createDataFrame(slots, "lane string, bucket long, count long, min double, max double, sum double, reason long")
    g = spark.createDataFrame(gaps, "lane string, bucket long, reason long")
    return T.columns(s, ColumnPlan("t0", 10, 1000, 1000 + per * n, per, n), g).orderBy("column").collect()


def test_columns_with_reasons(spark):
    got = columns_of(spark, [("a", 1000, 1, 100.0, 100.0, 100.0, 1), ("a", 1001, 9, 10.0, 10.0, 90.0, 1), ("a", 1004, 1, 50.0, 50.0, 50.0, 5)], [("a", 1005, 0)])
    assert [(r["avg"], r["count"], r["reason"]) for r in got] == [(19.0, 10, 1), (None, None, None), (50.0, 1, 5)]
    got = columns_of(spark, [("a", 1000, 8, 1.0, 1.0, 8.0, 1)], [("a", 1002, 2), ("a", 1003, 3), ("a", 1004, 0), ("a", 1005, 0)])
    assert [(r["count"], r["reason"]) for r in got] == [(8, 1), (0, 2), (None, None)]


def test_engine_reads_lanes_without_data(spark):
    slots = spark.createDataFrame([("a", 1_700_000_000 // 1800, 4, 1.0, 3.0, 8.0)], "lane string, bucket long, count long, min double, max double, sum double")
    lanes = spark.createDataFrame([("a", 0), ("b", 1)], "lane string, pos int")
    e = Engine({"t2": slots}, lanes, spark.createDataFrame([], "from_s long, to_s long, reason long"))
    got = e.query(2592000, 1_700_000_000).collect()
    assert len(got) == 2 * 1440
    assert [(r["column"], r["avg"], r["reason"]) for r in got if r["count"]] == [(1439, 2.0, 1)]
    assert e.query(2592000, 1_700_000_000, ["none"]).count() == 0
    assert e.status().first()["bytes"] == 4096 + 128 + 17520 * 20


def rows_of(spark, values):
    return spark.createDataFrame([(i, k, us, v) for i, (k, us, v) in enumerate(values)], "seq long, k string, us long, v string")


def test_confirmed_changes(spark):
    rng = random.Random(1)
    values = [(rng.choice("xy"), us, rng.choice(["a", "b", None])) for us in range(400)]
    got = {(r["k"], r["us"], r["before"], r["after"]) for r in W.confirmed_changes(rows_of(spark, values).repartition(5), "k", "v", 3).collect()}
    want = set()
    for key in "xy":
        known, seen, first = None, 0, True
        for k, us, v in values:
            if k != key or v is None:
                continue
            if first:
                known, first = v, False
            elif v == known:
                seen = 0
            else:
                seen += 1
                if seen == 3:
                    want.add((key, us, known, v))
                    known, seen = v, 0
    assert got == want and want


def test_throttled_across_batches(spark):
    """A key with more rows than an Arrow batch."""
    rows = spark.range(30_000).select(F.lit("k").alias("k"), (F.col("id") * 1_000_000).alias("us"), F.col("id").alias("seq")).repartition(7)
    assert sorted(r["seq"] for r in W.throttled(rows, "k", 7).collect()) == list(range(0, 30_000, 7))


def test_failure_policy(spark):
    rng = random.Random(2)
    rows = [("l", t * 60, rng.random() < 0.6) for t in range(500)]
    got = sorted(r["at_s"] for r in K.allowed_after_failures(spark.createDataFrame(rows, "lane string, at_s long, failed boolean").repartition(4), 3, 3600).collect())
    want, streak, until = [], 0, -1
    for _, at, failed in rows:
        if at >= until:
            want.append(at)
            streak = streak + 1 if failed else 0
            if streak == 3:
                streak, until = 0, at + 3600
    assert got == want


def test_first_unused(spark):
    left = spark.createDataFrame([(1, "ab"), (2, "a"), (3, "b"), (4, "c")], "l int, t string")
    right = spark.createDataFrame([(1, "xab"), (2, "ya"), (3, "zb")], "r int, u string")
    got = {r["l"]: r["r"] for r in R.first_unused(left, right, F.col("u").contains(F.col("t")), "l", "r").collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: None}


def test_hierarchy_with_cycle(spark):
    nodes = spark.createDataFrame([("r", None, 0), ("a", "r", 2), ("b", "r", 1), ("c", "a", 1_000_001), ("d", "a", 7), ("x", "y", 0), ("y", "x", 0)], "id string, parent string, ord long")
    assert [r["id"] for r in R.hierarchy(nodes).orderBy("path").collect()] == ["r", "b", "a", "d", "c"]


def test_accessory_resolution(spark):
    devices = [(1, "aa-bb", "Mouse", 1, 1), (2, "cc-dd", "Keys", 2, 2), (3, "ee-ff", "Keys", 3, 3), (4, "", "Pad", 9, 9)]
    items = [(1, " AA:BB ", "Keys", 5, 5), (2, "no", "mouse", 5, 5), (3, "no", "Keys", 5, 5), (4, "no", "x", 9, 9), (5, "no", "Pencil", None, None)]
    hid = [("pencil", "cc:dd")]
    schema = "address string, name string, vendor int, product int"
    got = R.resolve_accessories(spark.createDataFrame(items, "item_id int, " + schema), spark.createDataFrame(devices, "target_id int, " + schema), spark.createDataFrame(hid, "name string, address string"))
    assert {r["item_id"]: r["target_id"] for r in got.collect()} == {1: 1, 2: None, 3: None, 4: 4, 5: 2}


def test_flatten():
    doc = {"a/b~": 1, "t": True, "l": [1, "x", {"id": "q", "v": 2}, {"id": "q", "v": 3}, {"uuid": "u", "n": {"m": 4.5}}], "nan": float("nan"), "big": 10**400}
    assert dict(numbers(doc)) == {"/field:a~1b~0": 1.0, "/field:l/index:0": 1.0, "/field:l/item:uuid:u/field:n/field:m": 4.5}


def a_file(last=20_000):
    rng = np.random.default_rng(0)
    lanes = [{"identity": f"{k:032x}", "module": "net", "unit": "bytes", "kind": "rate", "flags": 0, "first_valid": last - 50, "last_used": 7, "label": "é" * 50} for k in range(3)]
    slots = np.zeros(60, np.dtype([("lane", "<i4"), *[(n, archive.SLOT[n]) for n in archive.SLOT.names]]))
    slots["lane"], slots["bucket"], slots["count"], slots["reason"] = np.arange(60) % 3, last - np.arange(60) // 3 * 3, 2, 1
    slots["sum"] = rng.random(60)
    return archive.encode_archive("t0", lanes, slots, last), slots


def test_archive_damage():
    data, slots = a_file()
    assert archive.damage_of(data) is None and len(archive.decode_slots(data)) == sum(slots["bucket"] >= 20_000 - 50)
    assert archive.decode_lanes(data)[0][-1] == "é" * 44
    assert [archive.damage_of(x) for x in (b"", data[:100], b"X" + data[1:], data[:4] + b"\2" + data[5:], data[:8] + b"\0" + data[9:], data[:4100] + b"?" + data[4101:], data[:-1])] == [
        "shortHeader", "shortHeader", "badMagic", "badVersion", "geometryMismatch", "badChecksum", "truncated",
    ]
    rng = random.Random(4)
    for _ in range(40):
        bad = bytearray(data)
        for _ in range(4):
            at = rng.randrange(len(bad) * 8)
            bad[at // 8] ^= 1 << at % 8
        ring = np.frombuffer(bytes(bad), archive.SLOT, offset=4096 + 3 * 128) if archive.damage_of(bytes(bad)) is None else None
        for s in archive.decode_slots(bytes(bad)):  # each stands at the place that its stamp names, within the newest ring
            assert ring[(int(s["bucket"]) % TIERS["t0"][1]) * 3 + s["lane"]]["bucket"] == s["bucket"] and 20_000 - TIERS["t0"][1] < s["bucket"] <= 20_000


def test_archive_ring(spark):
    """A bucket a ring later takes the place of the older one; the files go through Spark and back."""
    base = 100_000
    rows = [("m", 0, base, 1, 1.0, 1.0, 1.0, 1), ("m", 0, base + 8640, 2, 2.0, 2.0, 4.0, 1), ("m", 0, base + 1, 3, 3.0, 3.0, 9.0, 1), ("m", 1, base + 8640, 1, 5.0, 5.0, 5.0, 5)]
    slots = spark.createDataFrame(rows, "shard string, lane int, bucket long, count long, min double, max double, sum double, reason int")
    lanes = spark.createDataFrame([("m", k, f"{k:032x}", "cpu", "percent", "gauge", 0, base, 0, f"lane {k}") for k in range(2)], "shard string, lane int, identity string, module string, unit string, kind string, flags int, first_valid long, last_used long, label string")
    files = archive.archive_files(slots, lanes, "t0", "shard")
    got = sorted((r["lane"], r["bucket"], r["sum"], r["reason"]) for r in archive.slots_of(files).collect())
    assert got == [(0, base + 1, 9.0, 1), (0, base + 8640, 4.0, 1), (1, base + 8640, 5.0, 5)]
    assert [(r["lane"], r["label"], r["damage"]) for r in archive.lanes_of(files).orderBy("lane").collect()] == [(0, "lane 0", None), (1, "lane 1", None)]
    torn = spark.createDataFrame([("x", bytearray(b"nonsense"))], "path string, content binary")
    assert [(r["lane"], r["damage"]) for r in archive.lanes_of(torn).collect()] == [(None, "shortHeader")] and archive.slots_of(torn).count() == 0


def test_side_files(spark):
    spans = [(500, 900, 2), (100, 200, 3), (50, 50, 2)]
    data = archive.encode_spans(spans)
    files = spark.createDataFrame([("s", bytearray(data)), ("t", bytearray(data[:-30])), ("g", bytearray(b"??"))], "path string, content binary")
    got = archive.spans_of(files)
    assert [tuple(r)[1:] for r in got.where("path = 's'").collect()] == [(50, 50, 2), (100, 200, 3), (500, 900, 2)]
    assert got.where("path = 't'").count() == 1 and got.where("path = 'g'").count() == 0
    assert [r["from_s"] for r in K.loaded_spans(got.where("path = 's'"), 800, 500).collect()] == [500]
    daily = archive.encode_daily([(20260101, 10, 20), (20260102, 1, 2), (20260101, 15, 25)])
    damaged = bytearray(daily)
    damaged[16 + 48 + 5] ^= 1
    files = spark.createDataFrame([("d", bytearray(daily + b"torn")), ("e", damaged)], "path string, content binary")
    days = lambda p: {r["day"]: (r["upload"], r["download"]) for r in K.compacted(archive.daily_of(files).where(F.col("path") == p)).collect()}
    assert days("d") == {20260101: (15, 25), 20260102: (1, 2)} and days("e") == {20260101: (10, 20), 20260102: (1, 2)}
    assert archive.is_torn(daily + b"torn") and archive.is_torn(bytes(damaged)) and not archive.is_torn(daily) and struct.unpack_from("<I", daily, 16)[0] == 20260101


def test_status(spark):
    rows = [("a", "up"), ("a", "up"), ("b", "up"), ("b", None), ("c", "down"), ("c", "down"), ("d", None), ("d", "down"), ("e", None)]
    hosts = spark.createDataFrame(rows, "g string, s string")
    got = {r["g"]: r["colour"] for r in R.status_rollup(hosts, "g", F.col("s") == "up", F.col("s") == "down").collect()}
    assert got == {"a": "green", "b": "orange", "c": "red", "d": "orange", "e": "orange"}


def test_registration_by_turns(spark):
    directory = spark.createDataFrame([(f"k{i}", i, f"old{i}", "cpu", "percent", "gauge", 1, 5, 1000 * i) for i in range(4)], "identity string, lane long, label string, module string, unit string, kind string, flags int, first_valid long, last_used long")
    des = spark.createDataFrame([("k1", 0), ("n1", 1), ("n2", 2), ("n3", 3), ("n4", 4), ("n1", 9)], "identity string, ord long").selectExpr("identity", "ord", "concat('l', ord) AS label", "'bytes' AS unit", "'step' AS kind")
    got = {r["identity"]: (r["outcome"], r["lane"], r["displaced"]) for r in K.registration(directory, des, 3000 + 86_400 - 1, 5).collect()}
    assert got == {"k1": ("existing", 1, None), "n1": ("registered", 4, None), "n2": ("reclaimed", 0, "k0"), "n3": ("reclaimed", 2, "k2"), "n4": ("refused", None, None)}
    after = {r["identity"]: (r["lane"], r["flags"], r["label"]) for r in K.registered(directory, des, 3000 + 86_400 - 1, 5).collect()}
    assert after == {"k1": (1, 0, "l0"), "k3": (3, 1, "old3"), "n1": (4, 0, "l1"), "n2": (0, 2, "l2"), "n3": (2, 2, "l3")}


def test_templates_and_levels(spark):
    entries = [(0, "Pods", 80, "x1", "Combined", "g", None, True, [("Left", 70, True), ("Right", None, False)]), (1, "Case", 60, "x2", "Case", "g", None, False, None), (2, "Solo", 5, "x3", None, None, None, False, None), (3, "Pair", 9, "x4", None, "h", "Audio Battery Case", False, None), (4, "Bud", 8, "x5", None, "h", None, True, None)]
    rows = spark.createDataFrame(entries, "ord int, name string, capacity int, address string, part string, grp string, category string, charging boolean, parts array<struct<part:string,capacity:int,charging:boolean>>")
    got = {r["name"]: (r["address"], [tuple(x) for x in r["levels"]]) for r in P.accessory_levels(rows).collect()}
    assert got == {"Pods": ("x1", [("case", "60", "discharging"), ("left", "70", "charging")]), "Solo": ("x3", [("battery", "5", "discharging")]), "Bud": ("x4", [("case", "9", "discharging")])}


@pytest.mark.parametrize("parts", [1, 6])
def test_step_lanes_of_a_large_key(spark, tmp_path, parts):
    """A lane with more rows than an Arrow batch, in files of any order: the stream gives the batch's slots up to the last sample's bucket."""
    n = 24_000
    rows = spark.range(n).select(F.lit("hot").alias("lane"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 3 + F.floor(F.col("id") / 5000) * 4000).alias("ts"), (F.col("id") % 101).cast("double").alias("value"))
    rows.orderBy(F.xxhash64("ts")).repartition(parts).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("lane string, ts timestamp, value double").parquet(f"{tmp_path}/in")
    got = {r["bucket"]: (r["count"], r["sum"], r["reason"]) for r in folds.drain(steps.stream_step_lanes(stream, 10, "1 hour"), "steps", str(tmp_path)).collect()}
    batch = rows.select("lane", F.unix_micros("ts").alias("us"), "value", F.unix_micros("ts").alias("seq"), F.lit(0).alias("interval_s"))
    last = batch.agg(F.max("us")).first()[0] // 10_000_000
    want = {r["bucket"]: (r["count"], r["sum"], r["reason"]) for r in T.hold(batch, 10, last * 10_000_000).collect() if r["bucket"] < last}
    assert {k: v for k, v in got.items() if k < last} == want and sum(v[2] == 5 for v in want.values()) == 4 * 90


def test_poll_stream(spark, tmp_path):
    from pulsegrid.sources.poll import PollSource

    spark.dataSource.register(PollSource)
    stream = spark.readStream.format("poll").option("reader", "pulsegrid.sources.poll:replay").option("start_s", 1_700_000_000).option("interval_s", 10).option("ticks", 40).load()
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 80 and got.select("tick").distinct().count() == 40


def test_saturating_sum_of_numbers_beyond_64_bits(spark):
    values = [("a", "450560000000000000000"), ("a", "-7"), ("b", "99999999999999999999999999999999999999"), ("b", "99999999999999999999999999999999999999"), ("c", "9223372036854775806"), ("c", None), ("d", "-1")]
    rows = spark.createDataFrame(values, "k string, v string").withColumn("v", F.col("v").cast("decimal(38,0)"))
    got = dict(rows.groupBy("k").agg(R.saturating_sum(F.col("v"))).collect())
    assert got == {"a": 2**63 - 1, "b": 2**63 - 1, "c": 2**63 - 2, "d": 0}
    assert rows.groupBy("k").agg(R.saturating_sum(F.col("v").try_cast("long")).alias("x")).where("k = 'c'").first()["x"] == 2**63 - 2
