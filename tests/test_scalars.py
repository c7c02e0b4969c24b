"""Scalar functions against literal vectors."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.sources import text as X
from pulsegrid.sources.export import quoted, row_reason, stamp, token, two_places


def run(spark, f, rows, schema="v double"):
    columns = [c.split()[0] for c in schema.split(",")]
    data = [r if isinstance(r, tuple) else (r,) for r in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, " + schema)
    return [r["x"] for r in df.select("i", f(*[F.col(c.strip()) for c in columns]).alias("x")).orderBy("i").collect()]


def test_speed(spark):
    values = [999.0, 2.5e6, 150e6, 2e12, -5.0, 2.56e6, 150.9e6, 999_499.0, 1e3]
    assert run(spark, S.speed, values) == ["0 KB/s", "2.5 MB/s", "150 MB/s", "2.0 TB/s", "0 KB/s", "2.6 MB/s", "151 MB/s", "999 KB/s", "1 KB/s"]
    assert run(spark, lambda v: S.speed(v, "bit"), [125.0, 1e6, None]) == ["1 Kb/s", "8.0 Mb/s", None]
    assert run(spark, lambda v: S.speed(v, unit="mb"), [2.5e6, 0.0]) == ["2.50 MB/s", "0.00 MB/s"]
    assert run(spark, lambda v: S.speed(v, "bit", "GB"), [1e9]) == ["8.00 Gb/s"]


def test_duration(spark):
    values = [300.0, 7200.0, 7500.0, 0.0, None, -30.0, -60.0, -7200.0, 36_600.0]
    assert run(spark, S.duration_text, values) == ["05min", "2h", "2h 05min", "n/a", "n/a", "00min", "n/a", "n/a", "10h 10min"]
    assert run(spark, lambda v: S.duration_text(v, short=True), [7500.0, 60.0]) == ["2:05", "0:01"]


@pytest.mark.parametrize(
    ("current", "latest", "newer"),
    [
        ("v2.10.0", "v2.11.0", True), ("2.11", "2.11.1", True), ("2.11.1", "2.11", False), ("1.0.0", "1.0.0", False), ("2.0.0", "1.9.9", False), ("1.2.3", "1.2.3.1", True), ("1.2.3.1", "1.2.3", False), ("1.2.3.1", "1.2.4", True),
        ("1.0.0-beta1", "1.0.0", True), ("1.0.0-beta1", "1.0.0-beta2", True), ("1.0.0", "1.0.1-beta1", False), ("1.0.1-beta1", "1.0.0", False), ("x", "0.0.1", True), ("1.x.2", "1.0.3", True), (" 1.2.0 ", "1.3", True),
    ],
)
def test_versions(spark, current, latest, newer):
    assert run(spark, S.is_newer, [(current, latest)], "a string, b string") == [newer]


def test_version_parts(spark):
    got = run(spark, S.version_parts, ["v2.11", "1.2.3-beta4", "1.2.3.7", "junk"], "v string")
    assert [tuple(x) for x in got] == [(2, 11, 0, 0, None), (1, 2, 3, 0, 4), (1, 2, 3, 7, None), (0, 0, 0, 0, None)]
    keys = run(spark, S.version_key, ["1.0.0-beta2", "1.0.0", "1.0.0.1", "1.0.1-beta1", "1.0.10"], "v string")
    assert keys == sorted(keys)


def test_smc(spark):
    little = struct.pack("<f", 36.5).hex()
    rows = [("ui8", "FF", ""), ("ui16", "1234", ""), ("ui32", "12345678", ""), ("sp78", "1234", ""), ("sp1e", "1234", ""), ("spf0", "1234", ""), ("fpe2", "0005", ""), ("flt", little, ""), ("????", "1234", ""), ("ui8", "00", ""), ("ui8", "00", "F0Md"), ("ui16", "", ""), ("fp2e", "1234", ""), ("ui32", "FFFFFFFF", "")]
    got = run(spark, S.smc_decode, rows, "k string, h string, key string")
    assert got == [255, 4660, 305419896, 4660 / 256, 4660 / 16384, 4660, 1, 36.5, None, None, 0, None, None, 4294967295]


def test_float_of_bits(spark):
    values = [0.0, 1.0, -2.5, 3.4e38, 1e-40, -1e-45, 123.456]
    bits = [struct.unpack("<I", struct.pack("<f", v))[0] for v in values]
    assert run(spark, S.float_of_bits, bits, "v long") == [struct.unpack("<f", struct.pack("<f", v))[0] for v in values]
    assert run(spark, S.float_of_bits, [0x7F800000, 0x7FC00000], "v long") == [None, None]


def test_nice(spark):
    values = [0.0, 1.0, 1.2, 2.4, 3.0, 7.0, 99.0, -1.2, -7.0, 0.03, math.inf]
    assert run(spark, S.nice_bound, values) == pytest.approx([0, 1, 2, 2.5, 5, 10, 100, -1, -5, 0.05, 0])
    assert run(spark, lambda v: S.nice_bound(v, up=False), values) == pytest.approx([0, 1, 1, 2, 2.5, 5, 50, -2, -10, 0.025, 0])


def test_units(spark):
    assert run(spark, lambda v: S.unit_text(v, "percent"), [0.2, 0.005, math.nan, 1e300]) == ["20%", "1%", "—", "9223372036854775807%"]
    assert run(spark, lambda v: S.unit_text(v, "watts"), [12.5, 120.0, -math.inf, None]) == ["12.50 W", "120 W", "—", "—"]
    assert run(spark, lambda v: S.unit_text(v, "volts"), [11.25]) == ["11.250 V"]
    assert run(spark, lambda v: S.unit_text(v, "rpm"), [2000.9]) == ["2000 RPM"]
    assert run(spark, lambda v: S.unit_text(v, "bytesPerSec"), [2.5e6, -3.0]) == ["2.5 MB/s", "0 KB/s"]


def test_two_places(spark):
    assert run(spark, two_places, [2.675, 0.005, 0.015, -0.5, 2000.0, math.nan, math.inf, None, 0.0, 1e15]) == ["%.2f" % x if x is not None and math.isfinite(x) else "" for x in [2.675, 0.005, 0.015, -0.5, 2000.0, math.nan, math.inf, None, 0.0, 1e15]]
    assert run(spark, lambda v: two_places(v, F.lit("percent")), [0.105]) == ["10.50"]


def test_csv_parts(spark):
    assert run(spark, quoted, ["plain", "a,b", 'a"b', "a\nb", "a\r\nb"], "v string") == ["plain", '"a,b"', '"a""b"', '"a\nb"', '"a\r\nb"']
    assert run(spark, lambda v: stamp(v, "Europe/Berlin"), [1_700_000_000, 1_690_000_000], "v long") == ["2023-11-14T23:13:20+01:00", "2023-07-22T06:26:40+02:00"]
    assert run(spark, stamp, [1_700_000_000], "v long") == ["2023-11-14T22:13:20+00:00"]
    assert run(spark, token, [0, 1, 2, 3, 4, 5, None], "v int") == ["no_data", "", "asleep", "not_running", "clock_step", "held", "no_data"]
    rows = [[(5, 1), (2, 0)], [(5, 1), (1, 3)], [(None, None), (3, 0)], [(0, 0), (2, 0)], [(None, None)], []]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, v array<struct<reason:int,count:int>>")
    assert [r[0] for r in df.orderBy("i").select(row_reason(F.col("v"))).collect()] == [5, 1, 3, 2, 0, 0]


def test_texts(spark):
    assert run(spark, S.digits, ["a1b22٣", ""], "v string") == ["122٣", ""]
    assert run(spark, S.condensed, ["  a \t b\n\nc "], "v string") == ["a b c"]
    assert run(spark, S.trimmed, ["\x01 a b \x00\n", "  "], "v string") == ["a b", ""]
    assert run(spark, S.without_blanks, ["a b\tc\nd"], "v string") == ["abc\nd"]
    assert run(spark, S.truncated, ["x" * 90, "é" * 44, "é" * 45, "a" + "日" * 30, ""], "v string") == ["x" * 88, "é" * 44, "é" * 44, "a" + "日" * 29, ""]
    assert run(spark, S.country_flag, ["de", "DEU", ""], "v string") == ["🇩🇪", None, None]
    assert run(spark, S.ipv4, ["1.2.3.4", "1.2.3", "1.2.3.256", "1..2.3.4", "a.b.c.d", "1.2.3.4."], "v string") == [True, False, False, True, False, True]
    assert run(spark, S.zone_id, ["local", "Europe/Berlin", "UTC", "3", "-3:30", "+5:45", "x", "99"], "v string") == ["UTC", "Europe/Berlin", "UTC", "+03:00", "-03:30", "+05:45", "UTC", "UTC"]


def test_voltage(spark):
    blob = struct.pack("<II", 600_000_000, 9) + struct.pack("<II", 3_200_000_000, 9) + b"\x01\x02\x03"
    assert run(spark, S.voltage_states, [blob.hex()], "v string") == [[600, 3200]]
    assert run(spark, lambda v: S.voltage_states(v, 1000), [struct.pack("<II", 600_000, 9).hex()], "v string") == [[600]]
    assert run(spark, S.voltage_states, [""], "v string") == [[]]


def test_keys(spark):
    times = [-(2**62), -5, 0, 7, 2**62]
    keys = run(spark, lambda t: S.bucket_key(F.lit("CPU@x"), t), times, "v long")
    assert keys == sorted(keys) and keys[3] == "history@v2@Q1BVQHg=@" + f"{2**63 + 7:020d}"
    df = spark.createDataFrame([(k,) for k in [*keys, "other"]], "k string")
    name, ts = S.bucket_key_parts(F.col("k"))
    assert [tuple(r) for r in df.select(name, ts).collect()] == [*[("CPU@x", t) for t in times], (None, None)]


def test_day_bounds(spark):
    spring, autumn = "2026-03-29 10:00:00", "2026-10-25 10:00:00"
    df = spark.createDataFrame([(spring,), (autumn,)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    a, b = S.day_bounds(F.col("t"), "Europe/Berlin")
    assert [(r[1] - r[0]).total_seconds() / 3600 for r in df.select(a, b).collect()] == [23, 25]
    assert [r[0] for r in df.select(S.day_key(F.expr("timestamp_ntz'2026-05-11 22:00:30'"), "Europe/Berlin")).collect()] == [20260512] * 2


def test_zones_do_not_follow_the_session(spark):
    df = spark.createDataFrame([("2026-05-11 21:59:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.select(S.day_key(F.col("t"), "Europe/Berlin"), stamp(F.lit(1_700_000_000), "Europe/Berlin")).first()[:] == (20260511, "2023-11-14T23:13:20+01:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_text_sources(spark):
    assert run(spark, X.load_averages, ["up 1 day, load averages: 1.50 2,25 3.00", "nothing", "1 2.0 3.0"], "v string") == [[1.5, 2.25, 3.0], None, None]
    frames, rest = X.sse_frames(F.col("v"))
    df = spark.createDataFrame([("data: a\ndata:b\n\n: x\n\n data: c ",)], "v string").select(F.transform(frames, X.sse_data), rest)
    assert df.first()[:] == ([["a", "b"], []], " data: c ")
    assert run(spark, X.retry_delay, [0, 1, 5, 6, 20], "v int") == [1, 2, 32, 60, 60]
    got = run(spark, lambda v: F.struct(*[c.alias(k) for k, c in X.nettop_line(v).items()]), ["name.with.dots.12,5,7", "12,5,7", "x.y,5", "a.3,z,9"], "v string")
    assert [tuple(r) for r in got] == [(12, "name.with.dots", 5, 7), (12, "12", 5, 7), (None, None, None, None), (3, "a", 0, 9)]


def test_voltage_of_several_chips(spark):
    rows = [(struct.pack("<II", 600_000_000, 9).hex(), 1_000_000), (struct.pack("<II", 4_512_000, 9).hex(), 1_000)]
    assert run(spark, S.voltage_states, rows, "v string, d long") == [[600], [4512]]


@pytest.mark.parametrize("places", [0, 1, 2, 3, 4])
def test_fixed_as_c_prints_it(spark, places):
    ties = [(2 * k + 1) * 5 / 10 ** (places + 1) for k in [0, 1, 2, 3, 7, 49, 499, 4999, 123_456, 10**9, 10**11]]
    near = [x for t in ties for x in (t, math.nextafter(t, 0), math.nextafter(t, math.inf))]
    values = [0.0, 0.0005, 0.99995, 9.9999, 2.0**62, 2.0**52 - 0.5, 5e-324, 1.005, 0.375, 1e15, *near]
    values += [-x for x in values]
    assert run(spark, lambda v: S.fixed(v, places), values) == [f"{x:.{places}f}" for x in values]
