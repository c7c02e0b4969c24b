"""Registered queries of the stored history: lanes, slots, spans, daily counters, keyed records, joins, orders and sets, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import _FOLD, EV, NOW, SPANS, _ev, _fold, _t, fold_sql, query, sig
from .functions import scalars as S
from .model import ASLEEP
from .operators import relational as R
from .operators import series as T
from .operators import store as K
from .operators import windows as W

_SPAN_SQL = ", ".join(str(x) for x in SPANS)

# lane directory: customers are the lanes, a hundred and fifty or more; the limit is what the tables have
_DIR = """dir AS (SELECT 'c' || c_custkey AS identity, c_custkey - 1 AS lane, c_name AS label, c_mktsegment AS module, CASE c_nationkey % 3
    WHEN 0 THEN 'percent' WHEN 1 THEN 'bytes' ELSE 'rpm' END AS unit, 'gauge' AS kind,
    (c_nationkey % 4)::INT AS flags, (c_custkey * 10)::BIGINT AS first_valid, (c_custkey * 5000)::BIGINT AS last_used FROM customer WHERE c_custkey <= 250)"""
_REG_NOW, _REG_MOST = 1_000_000, 256


def _directory(s, d):
    c = _t(s, d, "customer").where("c_custkey <= 250")  # a directory has 256 lanes at most: the limit is the feature
    unit = F.expr("CASE c_nationkey % 3 WHEN 0 THEN 'percent' WHEN 1 THEN 'bytes' ELSE 'rpm' END")
    return c.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("identity"), (F.col("c_custkey") - 1).alias("lane"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("module"), unit.alias("unit"), F.lit("gauge").alias("kind"),
        (F.col("c_nationkey") % 4).cast("int").alias("flags"), (F.col("c_custkey") * 10).alias("first_valid"), (F.col("c_custkey") * 5000).alias("last_used"),
    )


def _descriptors(s, d):
    e = _t(s, d, "events")
    name = F.when(F.col("event_type") == "view", F.concat(F.lit("c"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("n"), F.col("user_id").cast("string")))
    return e.where("value > 20").select(name.alias("identity"), F.col("event_id").alias("ord"), F.col("event_type").alias("label"), F.lit("volts").alias("unit"), F.lit("step").alias("kind"))


_REG = f"""{_DIR}, des AS (SELECT CASE WHEN event_type = 'view' THEN 'c' ELSE 'n' END || user_id AS identity, event_id AS ord, event_type AS label
    FROM events WHERE value > 20),
  w AS (SELECT identity, min(ord) AS ord, arg_min(label, ord) AS label FROM des GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS n
    FROM w WHERE identity NOT IN (SELECT identity FROM dir)),
  cold AS (SELECT lane, identity, row_number() OVER (ORDER BY last_used, lane) - 1 AS turn FROM dir WHERE identity NOT IN (SELECT identity
    FROM w) AND last_used <= {_REG_NOW - 86400}),
  size AS (SELECT count(*) AS size FROM dir),
  r AS (SELECT w.identity, 'existing' AS outcome, dir.lane, NULL AS displaced, w.label FROM w JOIN dir USING (identity) UNION ALL
    SELECT n.identity, CASE WHEN size + n < {_REG_MOST} THEN 'registered' WHEN cold.lane IS NOT NULL THEN 'reclaimed' ELSE 'refused' END, CASE
    WHEN size + n < {_REG_MOST} THEN size + n ELSE cold.lane END,
      CASE WHEN size + n >= {_REG_MOST} THEN cold.identity END, n.label FROM n, size LEFT JOIN cold ON cold.turn = n.n - greatest({_REG_MOST} - size, 0))"""


@query(f"WITH {_REG} SELECT identity, outcome, lane, displaced FROM r")
def lane_registration(s, d):
    return K.registration(_directory(s, d), _descriptors(s, d), _REG_NOW, _REG_MOST)


@query(f"""WITH {_REG} SELECT identity, lane, label, unit, kind, flags, first_valid, last_used FROM dir WHERE lane NOT IN (SELECT lane FROM r
    WHERE outcome <> 'refused') UNION ALL
  SELECT r.identity, r.lane, r.label, 'volts', 'step', CASE r.outcome WHEN 'existing' THEN dir.flags & ~1
    WHEN 'reclaimed' THEN 2 ELSE 0 END::INT, CASE r.outcome WHEN 'existing' THEN dir.first_valid ELSE 4294967295 END, greatest(dir.last_used, {_REG_NOW})
  FROM r LEFT JOIN dir USING (identity) WHERE r.outcome <> 'refused'""")
def lane_directory_after(s, d):
    return K.registered(_directory(s, d), _descriptors(s, d), _REG_NOW, _REG_MOST)


@query(f"""WITH {_DIR}, u AS (SELECT user_id AS lane, max(event_id * 300) AS used FROM events GROUP BY 1) SELECT identity, greatest(last_used, used) AS last_used
    FROM dir LEFT JOIN u USING (lane)""")
def lane_touch(s, d):
    uses = _t(s, d, "events").select(F.col("user_id").alias("lane"), (F.col("event_id") * 300).alias("used"))
    return K.touched(_directory(s, d), uses).select("identity", "last_used")


@query(f"""WITH {_DIR}, f AS (SELECT user_id AS lane, min(event_id) AS b FROM events WHERE event_type = 'signup' GROUP BY 1)
  SELECT identity, CASE WHEN b IS NOT NULL THEN flags & ~2 ELSE flags END::INT AS flags, coalesce(b, first_valid) AS first_valid FROM dir
    LEFT JOIN f USING (lane)""")
def lane_first_valid(s, d):
    firsts = _t(s, d, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("lane")).agg(F.min("event_id").alias("first_bucket"))
    return K.carried_back(_directory(s, d), firsts).select("identity", "flags", "first_valid")


@query(f"""WITH {_DIR} SELECT identity, CASE WHEN lane IN (SELECT user_id FROM events WHERE value > 100) THEN flags ELSE flags | 1 END::INT AS flags FROM dir""")
def lane_orphans(s, d):
    return K.orphaned(_directory(s, d), _t(s, d, "events").where("value > 100").select(F.col("user_id").alias("lane"))).select("identity", "flags")


@query(f"""WITH {_DIR} SELECT identity FROM dir WHERE contains(lower(label), '5') OR contains(lower(module), '5') UNION ALL SELECT 'm' || identity FROM dir
    WHERE contains(lower(label), 'build') OR contains(lower(module), 'build')""")
def lane_search(s, d):
    x = _directory(s, d)
    return K.searched(x, " 5").select("identity").unionByName(K.searched(x, "BUILD ").select(F.concat(F.lit("m"), "identity").alias("identity")))


@query(f"""WITH {_DIR}, l AS (SELECT *, unit = 'rpm' AS main FROM dir WHERE module = 'BUILDING' AND flags & 1 = 0), p AS (SELECT * FROM l
    WHERE main OR NOT (SELECT coalesce(bool_or(main), false) FROM l))
  SELECT identity FROM p ORDER BY lane LIMIT 8""")
def lane_default_selection(s, d):
    return K.default_lanes(_directory(s, d), "BUILDING", "rpm").select("identity")


@query(f"WITH {_DIR} SELECT identity, (row_number() OVER (PARTITION BY module ORDER BY lane) - 1)::INT AS \"offset\" FROM dir")
def lane_colour_offset(s, d):
    return K.colour_offset(_directory(s, d)).select("identity", F.col("offset").cast("int").alias("offset"))


# slots
@query(f"""WITH {EV}, {_FOLD}, a AS (SELECT lane, bucket, count, min, max, sum FROM fold),
    n AS (SELECT lane, bucket + 7 AS bucket, count + 1 AS count, min, max + 1 AS max, sum FROM fold WHERE min < 20),
  u AS (SELECT * FROM n UNION ALL SELECT * FROM a WHERE (lane, bucket) NOT IN (SELECT (lane, bucket) FROM n)) SELECT * FROM u
    WHERE bucket > (SELECT max(bucket) FROM u) - 900""")
def commit_rows(s, d):
    a = _fold(s, d, 1800)
    n = a.where("min < 20").select("lane", (F.col("bucket") + 7).alias("bucket"), (F.col("count") + 1).alias("count"), "min", (F.col("max") + 1).alias("max"), "sum")
    return K.commit(a, n, 900)


@query(f"WITH {EV}, {_FOLD} SELECT lane, min(bucket) AS first_bucket, max(bucket) AS last_bucket, count(*) AS slots FROM fold GROUP BY 1")
def slot_coverage(s, d):
    return K.coverage(_fold(s, d, 1800))


@query(f"""WITH {EV}, {_FOLD}, m AS (SELECT bucket, max(count) AS n FROM fold GROUP BY 1 ORDER BY n DESC, bucket LIMIT 1) SELECT lane, bucket, count, sum
    FROM fold WHERE bucket = (SELECT bucket FROM m)""")
def archive_row(s, d):
    f = _fold(s, d, 1800)
    top = f.groupBy("bucket").agg(F.max("count").alias("n")).orderBy(F.desc("n"), "bucket").limit(1).first()
    return K.row_of(f, top["bucket"] if top else 0).select("lane", "bucket", "count", "sum")


_FROM = (NOW - 86_400 * 5) // 1800


@query(f"""WITH {EV}, {_FOLD} SELECT lane, bucket, count, sum, false AS one FROM fold WHERE lane = 'view' AND bucket BETWEEN {_FROM} AND {_FROM + 100}
    UNION ALL SELECT lane, bucket, count, sum, true FROM fold WHERE lane = 'view' AND bucket = {_FROM + 3}""")
def archive_series(s, d):
    f = _fold(s, d, 1800)
    return K.series_of(f, "view", _FROM, _FROM + 100).withColumn("one", F.lit(False)).unionByName(K.point(f, "view", _FROM + 3).withColumn("one", F.lit(True))).select("lane", "bucket", "count", "sum", "one")


@query(f"WITH {EV}, {_FOLD} SELECT lane, bucket % 500 AS place, max(bucket) AS stamp FROM fold GROUP BY 1, 2")
def archive_stamps(s, d):
    return K.stamps(_fold(s, d, 1800), 500)


@query(f"WITH {EV}, {_FOLD}, m AS (SELECT max(bucket) AS m FROM fold) SELECT lane, bucket, sum FROM fold, m WHERE abs(m - {NOW // 1800}) < 17520")
def tier_reset(s, d):
    """The ring at its own time keeps all; a ring's length later (the other branch) it is empty."""
    f = _fold(s, d, 1800)
    kept = K.without_stranded(f, NOW // 1800, 17520)
    return kept.unionByName(K.without_stranded(f, NOW // 1800 + 17520, 17520)).select("lane", "bucket", "sum")


_HIGH = (NOW - 86_400 * 10) // 1800


@query(f"""WITH {EV}, {_FOLD}, n AS (SELECT lane, bucket + 1 AS bucket, sum FROM fold) SELECT * FROM n
    WHERE (lane, bucket) NOT IN (SELECT (lane, bucket) FROM fold WHERE bucket <= {_HIGH})""")
def backward_step(s, d):
    f = _fold(s, d, 1800)
    return K.clear_of_era(f.select("lane", (F.col("bucket") + 1).alias("bucket"), "sum"), f, _HIGH)


_T0 = NOW // 10


@query(f"""WITH {EV}, fold AS ({fold_sql(10)}), o AS (SELECT * FROM fold WHERE bucket > {_T0 - 260000}), m AS (SELECT max(bucket) AS m FROM o)
  SELECT lane, count(*) FILTER (bucket > m - 100000) AS waiting, count(*) FILTER (bucket <= m - 100000) AS dropped FROM o, m GROUP BY 1""")
def staging_bound(s, d):
    kept, dropped = K.staged(_fold(s, d, 10), _T0 - 260_000, 100_000)
    return dropped.join(kept.groupBy("lane").agg(F.count(F.lit(1)).alias("waiting")), "lane", "left").select("lane", F.coalesce("waiting", F.lit(0)).alias("waiting"), "dropped")


@query(f"""WITH {EV}, fold AS ({fold_sql(10)}) SELECT lane, bucket, count FROM fold WHERE bucket > {_T0 - 100000 - 1 - 5000} AND bucket < {_T0 - 100000}""")
def drain_once(s, d):
    return K.drained(_fold(s, d, 10), _T0 - 200_000, _T0 - 100_000, 5000).select("lane", "bucket", "count")


@query("""SELECT n AS lanes, 3 * 4096 + 3 * n * 128 + (8640 + 21600 + 17520) * n * 20 AS standard, 4096 + n * 128 + 8640 * n * 20 AS minimal FROM (SELECT DISTINCT n_nationkey::BIGINT AS n
    FROM nation)""")
def projected_size(s, d):
    """From the sizes for no lane and for one: they grow by the same for each."""
    none, one, low, low1 = K.projected_bytes(0), K.projected_bytes(1), K.projected_bytes(0, ("t0",)), K.projected_bytes(1, ("t0",))
    n = F.col("n_nationkey").cast("long")
    return _t(s, d, "nation").select(n.alias("lanes"), (none + n * (one - none)).alias("standard"), (low + n * (low1 - low)).alias("minimal")).distinct()


@query(f"""WITH {EV}, {_FOLD} SELECT 't2' AS tier, count(DISTINCT lane) AS lanes, count(*) AS slots, min(bucket) AS first_bucket, max(bucket) AS last_bucket, 4096 + count(DISTINCT lane) * (128 + 17520 * 20) AS bytes
    FROM fold""")
def store_status(s, d):
    from .engine import Engine

    f = _fold(s, d, 1800)
    return Engine({"t2": f}, f.select("lane").distinct(), s.createDataFrame(SPANS, "from_s long, to_s long, reason long")).status()


@query("""SELECT n_nationkey, list_filter(['t0', 't1', 't2'], lambda x: NOT list_contains(list_slice(['t0', 't1', 't2'], 1, 1 + n_regionkey % 3), x)).array_to_string(',') AS gone
    FROM nation""")
def preset_change(s, d):
    """Tiers that go when the preset of three becomes one of so many."""
    n = _t(s, d, "nation")
    tiers = ["t0", "t1", "t2"]
    out = None
    for k in (1, 2, 3):
        gone, _ = K.preset_change(tiers, tiers[:k])
        part = n.where(F.col("n_regionkey") % 3 == k - 1).select("n_nationkey", F.lit(",".join(gone)).alias("gone"))
        out = part if out is None else out.unionByName(part)
    return out


# spans
@query(f"""WITH sp(f, t, r) AS (VALUES {_SPAN_SQL}),
    x AS (SELECT l_orderkey * 7200 + 1690000000 AS from_s, l_orderkey * 7200 + 1690000000 + (l_linenumber - 2) * 300 AS to_s, 2::BIGINT AS reason
    FROM lineitem) SELECT from_s, to_s, reason FROM x WHERE to_s > from_s AND to_s >= {NOW - 365 * 86400 + 86400 * 180}""")
def spans_loaded(s, d):
    x = _t(s, d, "lineitem").select((F.col("l_orderkey") * 7200 + 1690000000).alias("from_s"), (F.col("l_orderkey") * 7200 + 1690000000 + (F.col("l_linenumber") - 2) * 300).alias("to_s"), F.lit(ASLEEP).cast("long").alias("reason"))
    return K.loaded_spans(x, NOW, 365 * 86400 - 86400 * 180)


@query(f"""WITH sp(f, t, r) AS (VALUES {_SPAN_SQL}), m AS (SELECT event_id, epoch_us(ts) // 1000000 AS at_s, CASE
    WHEN value > 50 THEN 2 ELSE 3 END::BIGINT AS reason FROM events)
  SELECT event_id, at_s, reason, min(f) AS from_s, arg_min(t, f) AS to_s FROM m LEFT JOIN sp ON r = reason AND at_s >= f AND at_s < t
    GROUP BY 1, 2, 3""")
def span_sentence(s, d):
    moments = _ev(s, d).select(F.col("seq").alias("event_id"), F.floor(F.col("us") / 1_000_000).alias("at_s"), F.when(F.col("value") > 50, 2).otherwise(3).cast("long").alias("reason"))
    return K.span_at(s.createDataFrame(SPANS, "from_s long, to_s long, reason long"), moments)


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 1000 + 1 AS b, (o_orderkey % 1000 + 2) * 10 AS last, (o_orderkey % 1000 + 2) * 10 + o_custkey - 50 AS now, CASE
    WHEN o_orderstatus = 'F' THEN 0 ELSE 500 END AS anchor, 500 + o_custkey - 50 + CASE WHEN o_orderstatus = 'P' THEN 100 ELSE 5 END AS mono FROM orders),
  g AS (SELECT *, now - last AS gap FROM x)
  SELECT o_orderkey, least(last, now) AS from_s, greatest(last, now) AS to_s, CASE WHEN gap <= 0 THEN 4
    WHEN anchor > 0 AND mono >= anchor AND abs(gap - (mono - anchor)) > 72 THEN 4 ELSE 3 END::BIGINT AS reason FROM g WHERE (gap < 0 OR gap > 20)""")
def down_time(s, d):
    o = _t(s, d, "orders")
    b = F.col("o_orderkey") % 1000 + 1
    starts = o.select(
        "o_orderkey", b.alias("last_bucket"), F.lit(10).alias("step"), ((b + 1) * 10 + F.col("o_custkey") - 50).alias("now_s"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(500).alias("anchor_s"),
        (450 + F.col("o_custkey") + F.when(F.col("o_orderstatus") == "P", 100).otherwise(5)).alias("mono_s"),
    )
    return K.down_time(starts)


@query("""SELECT event_id, CASE WHEN s > 0 THEN a - s ELSE a END AS from_s, CASE
    WHEN s > 0 THEN a ELSE a - s END AS to_s FROM (SELECT event_id, epoch_us(ts) // 1000000 AS a, floor(value)::BIGINT - 60 AS s FROM events)""")
def clock_step_spans(s, d):
    e = _ev(s, d).select(F.col("seq").alias("event_id"), F.floor(F.col("us") / 1_000_000).alias("at_s"), (F.floor("value").cast("long") - 60).alias("step_s"))
    spans = K.step_spans(e.select("at_s", "step_s"))
    both = e.select("event_id", F.when(F.col("step_s") > 0, F.col("at_s") - F.col("step_s")).otherwise(F.col("at_s")).alias("from_s"), "at_s", "step_s").dropDuplicates(["event_id"])
    return both.join(spans.distinct(), "from_s").where(F.col("to_s") - F.col("from_s") == F.abs("step_s")).select("event_id", "from_s", "to_s").distinct()


# daily counters and keyed records
@query("""SELECT user_id AS day, arg_max(event_id * 2, event_id) AS upload, arg_max(event_id * 3, event_id) AS download FROM events
    WHERE event_type <> 'error' AND user_id > 0 GROUP BY 1""")
def daily_compacted(s, d):
    x = _t(s, d, "events").select(F.col("user_id").alias("day"), F.col("event_id").alias("seq"), (F.col("event_id") * 2).alias("upload"), (F.col("event_id") * 3).alias("download"), (F.col("event_type") != "error").alias("valid"))
    return K.compacted(x)


@query("""WITH t AS (SELECT strftime(ts, '%Y%m%d')::INT AS day, sum((value * 100)::BIGINT)::BIGINT AS up, sum(user_id)::BIGINT AS down FROM events
    GROUP BY 1)
  SELECT coalesce(sum(up) FILTER (day = 20240115), 0)::BIGINT AS upload, coalesce(sum(down) FILTER (day = 20240115), 0)::BIGINT AS download, coalesce(sum(up) FILTER (day = 20240114), 0)::BIGINT AS upload_before, coalesce(sum(down) FILTER (day = 20240114), 0)::BIGINT AS download_before
    FROM t""")
def two_days(s, d):
    totals = R.daily_totals(_t(s, d, "events"), F.col("ts"), "UTC", F.round(F.col("value") * 100).cast("long"), F.col("user_id"))
    return R.two_days(totals, 20240115, 20240114)


@query("SELECT user_id, least(sum(greatest(event_id::HUGEINT * 10000000000000000, 0)), 9223372036854775807)::BIGINT AS total FROM events GROUP BY 1")
def saturating_totals(s, d):
    x = _t(s, d, "events").groupBy("user_id")
    return x.agg(R.saturating_sum(F.col("event_id").cast("decimal(20,0)") * F.lit(10_000_000_000_000_000).cast("decimal(20,0)")).alias("total"))


def _records(s, d):
    return K.minute_records(_ev(s, d).select(F.col("event_type").alias("name"), (F.floor(F.col("us") / 60_000_000) * 60 - 1_705_000_000).cast("long").alias("minute_s"), F.col("value")))


_REC = "rec AS (SELECT event_type AS name, (epoch_us(ts) // 60000000) * 60 - 1705000000 AS m, value FROM events)"


@query(f"WITH {_REC} SELECT name, m AS minute_s, value FROM rec")
def keyed_store_decode(s, d):
    r = _records(s, d)
    name, ts = S.bucket_key_parts(F.col("key"))
    return r.select(name.alias("name"), ts.alias("minute_s"), "value")


@query(f"""WITH {_REC} SELECT 'prefix' AS scan, name, m, value FROM rec WHERE name = 'view' UNION ALL SELECT 'range', name, m, value FROM rec
    WHERE name = 'click' AND m >= -600000 AND m < 100000 UNION ALL SELECT 'last', name, max(m), arg_max(value, m) FROM rec WHERE name = 'signup'
    GROUP BY 1, 2""")
def keyed_store_scans(s, d):
    r = _records(s, d)
    front = lambda name: s.range(1).select(S.bucket_key(F.lit(name), F.lit(0).cast("long")).alias("k")).first()["k"][:-20]
    key = lambda name, ts: front(name) + f"{ts + S.KEY_BIAS:020d}"
    parts = [("prefix", K.prefix_scan(r, front("view"))), ("range", K.range_scan(r, key("click", -600_000), key("click", 100_000))), ("last", K.last_of(r, front("signup")))]
    name, ts = S.bucket_key_parts(F.col("key"))
    out = None
    for scan, rows in parts:
        part = rows.select(F.lit(scan).alias("scan"), name.alias("name"), ts.alias("m"), "value")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_REC} SELECT name, m, value FROM rec WHERE m >= 200000")
def keyed_store_deleted(s, d):
    name, ts = S.bucket_key_parts(F.col("key"))
    return K.deleted_before(_records(s, d), 200_000).select(name.alias("name"), ts.alias("m"), "value")


@query("""WITH x AS (SELECT event_type || '@' || user_id AS name, epoch_us(ts) // 1000000 AS t, value
    FROM events) SELECT name, max(t) AS at_s, arg_max(value, t) AS value FROM x WHERE t >= 1706500000 - 36000 GROUP BY 1""")
def snapshot_restore(s, d):
    e = _ev(s, d).select(F.concat_ws("@", "event_type", "user_id", F.floor(F.col("us") / 1_000_000)).alias("key"), "value")
    return K.restored(e, 1_706_500_000, 36_000)


@query("""WITH x AS (SELECT c_custkey, c_name, c_mktsegment FROM customer) SELECT c_custkey, 'kept=' || c_name AS exported, 'kept=' || c_name || CASE
    WHEN c_custkey % 2 = 0 THEN ',access_token=own' ELSE ',access_token=' || c_mktsegment END || ',remote_id=' || c_mktsegment AS imported FROM x""")
def settings_transfer(s, d):
    c = _t(s, d, "customer")
    settings = F.create_map(F.lit("kept"), F.col("c_name"), F.lit("remote_id"), F.col("c_mktsegment"), F.lit("access_token"), F.col("c_mktsegment"))
    own = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("access_token"), F.lit("own"), F.lit("other"), F.lit("x"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    shown = lambda m: F.array_join(F.transform(F.sort_array(F.filter(F.map_entries(m), lambda e: e["key"] == "kept")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    rest = lambda m: F.concat(shown(m), F.lit(",access_token="), m["access_token"], F.lit(",remote_id="), m["remote_id"])
    out, back = K.exported_settings(settings), K.imported_settings(settings, own)
    return c.select("c_custkey", F.array_join(F.transform(F.map_entries(out), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("exported"), rest(back).alias("imported"))


_WALK = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, event_id AS seq FROM events), w AS (SELECT user_id, min(us) AS us FROM e
    GROUP BY 1
    UNION ALL SELECT w.user_id, (SELECT min(e.us) FROM e WHERE e.user_id = w.user_id AND e.us >= w.us + {gap}) FROM w WHERE w.us IS NOT NULL)"""


@query(_WALK.format(gap=86_400_000_000) + " SELECT w.user_id, w.us, e.seq FROM w JOIN e USING (user_id, us)")
def throttled_writes(s, d):
    return W.throttled(_ev(s, d), "user_id", 86_400)


@query(_WALK.format(gap=86_400_000_000) + """, x AS (SELECT user_id, us AS o, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS n FROM w
    WHERE us IS NOT NULL)
  SELECT x.user_id, x.o AS opened_us, arg_max(e.seq, e.us) AS last, count(*) AS merged
    FROM x JOIN e ON e.user_id = x.user_id AND e.us >= x.o AND e.us < x.o + 86400000000 GROUP BY 1, 2""")
def conflate_from_first(s, d):
    """A window opens with the first value that waits, not on a grid."""
    return W.conflate_from_first(_ev(s, d), "user_id", "seq", 86_400).select("user_id", "opened_us", F.col("seq").alias("last"), "merged")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id AS lane, epoch_us(ts) // 1000000 AS t FROM events), w AS (SELECT lane, min(t) AS t FROM e
    GROUP BY 1
    UNION ALL SELECT w.lane, (SELECT min(e.t) FROM e WHERE e.lane = w.lane AND e.t >= w.t + 3600) FROM w WHERE w.t IS NOT NULL)
  SELECT e.lane, e.t AS at_s, w.t IS NOT NULL AS fetched FROM e LEFT JOIN w ON w.lane = e.lane AND w.t = e.t""")
def ttl_cache(s, d):
    reads = _ev(s, d).select(F.col("user_id").alias("lane"), F.floor(F.col("us") / 1_000_000).cast("long").alias("at_s")).distinct()
    return K.cached(reads, 3600)


@query()
def failure_policy(s, d):
    e = _ev(s, d).select(F.col("event_type").alias("lane"), F.floor(F.col("us") / 1_000_000).alias("at_s"), (F.col("value") > 15).alias("failed"))
    return K.allowed_after_failures(e, 3, 36_000)


@query()
def confirmed_changes(s, d):
    return W.confirmed_changes(_ev(s, d), "user_id", "event_type", 2)


# binary files
_F32 = "SELECT lane, bucket, count, min::FLOAT::DOUBLE AS min, max::FLOAT::DOUBLE AS max, sum::FLOAT::DOUBLE AS sum"


@query(f"""WITH {EV}, fold AS ({fold_sql(1800, "user_id")}),
    x AS (SELECT 'm' || (lane::BIGINT // 40) AS shard, (lane::BIGINT % 40)::INT AS lane, bucket, count, min, max, sum FROM fold)
  SELECT shard || '/t2' AS path, lane, bucket, count, min::FLOAT::DOUBLE AS min, max::FLOAT::DOUBLE AS max, sum::FLOAT::DOUBLE AS sum, 1 AS reason
    FROM x""")
def archive_round_trip(s, d):
    """Each forty users are a machine: their slots go to an archive's bytes and come back from them."""
    from .sources import archive

    f = _fold(s, d, 1800, "user_id")
    lane = F.col("lane").cast("long")
    shard = F.concat(F.lit("m"), F.floor(lane / 40).cast("string"))
    slots = f.select(shard.alias("shard"), (lane % 40).cast("int").alias("lane"), "bucket", "count", "min", "max", "sum", F.lit(1).alias("reason"))
    every = slots.groupBy("shard").agg(F.max("lane").alias("top")).select("shard", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("lane"))
    lanes = every.join(slots.groupBy("shard", "lane").agg(F.min("bucket").alias("first_valid"), F.max("bucket").alias("last_used")), ["shard", "lane"], "left")
    lanes = lanes.select("shard", "lane", F.substring(F.sha2(F.col("lane").cast("string"), 256), 1, 32).alias("identity"), F.lit("cpu").alias("module"), F.lit("percent").alias("unit"), F.lit("gauge").alias("kind"), F.lit(0).alias("flags"), F.coalesce("first_valid", F.lit(4294967295)).alias("first_valid"), F.coalesce("last_used", F.lit(0)).alias("last_used"), F.concat(F.lit("user "), F.col("lane").cast("string")).alias("label"))
    return archive.slots_of(archive.archive_files(slots, lanes, "t2", "shard"))


# joins, orders, sets
@query("""WITH it AS (SELECT c_custkey AS item_id, upper(c_name) AS n, ' ' || (c_custkey * 2) || ':AA ' AS a, c_nationkey AS v, 7 AS p FROM customer),
    dev AS (SELECT s_suppkey AS target_id, CASE
    WHEN s_suppkey % 3 = 0 THEN 'customer#' || lpad(s_suppkey::VARCHAR, 9, '0') ELSE s_name END AS n, (s_suppkey * 4) || '-aa' AS a, s_nationkey AS v, 7 AS p
    FROM supplier),
  i AS (SELECT item_id, lower(n) AS n, lower(replace(trim(a), ':', '-')) AS a, v, p FROM it),
    x AS (SELECT target_id, lower(n) AS n, lower(a) AS a, v, p FROM dev), nn AS (SELECT n, min(target_id) AS t FROM x GROUP BY 1 HAVING count(*) = 1),
    vv AS (SELECT v, p, min(target_id) AS t FROM x GROUP BY 1, 2 HAVING count(*) = 1), aa AS (SELECT a, min(target_id) AS t FROM x GROUP BY 1),
  m AS (SELECT item_id, coalesce(aa.t, nn.t, vv.t) AS t, CASE WHEN aa.t IS NOT NULL THEN 0 WHEN nn.t IS NOT NULL THEN 2 ELSE 3 END AS r FROM i
    LEFT JOIN aa USING (a) LEFT JOIN nn ON nn.n = i.n LEFT JOIN vv ON vv.v = i.v AND vv.p = i.p),
  k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r, item_id) AS k FROM m) SELECT item_id, CASE
    WHEN t IS NOT NULL AND k = 1 THEN t END AS target_id FROM k""")
def accessory_resolution(s, d):
    items = _t(s, d, "customer").select(F.col("c_custkey").alias("item_id"), F.concat(F.lit(" "), (F.col("c_custkey") * 2).cast("string"), F.lit(":AA ")).alias("address"), F.upper("c_name").alias("name"), F.col("c_nationkey").alias("vendor"), F.lit(7).alias("product"))
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))).otherwise(F.col("s_name"))
    devices = _t(s, d, "supplier").select(F.col("s_suppkey").alias("target_id"), F.concat((F.col("s_suppkey") * 4).cast("string"), F.lit("-aa")).alias("address"), name.alias("name"), F.col("s_nationkey").alias("vendor"), F.lit(7).alias("product"))
    hid = s.createDataFrame([], "name string, address string")
    return R.resolve_accessories(items, devices, hid)


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1")
def first_wins(s, d):
    return R.first_of(_t(s, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("""SELECT c_custkey AS k, c_name AS n FROM customer UNION ALL SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey
    FROM customer)""")
def union_new_keys(s, d):
    return R.append_new(_t(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n")), _t(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("n")), "k")


@query("""SELECT p_brand FROM part GROUP BY 1 UNION ALL SELECT 'missing ' || p_type FROM (SELECT p_type FROM part EXCEPT SELECT p_type FROM part
    WHERE p_size < 20)""")
def distinct_and_missing(s, d):
    p = _t(s, d, "part")
    missing = p.select("p_type").subtract(p.where("p_size < 20").select("p_type")).select(F.concat(F.lit("missing "), "p_type").alias("p_brand"))
    return p.select("p_brand").dropDuplicates().unionByName(missing)


@query("""WITH u AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal, max(CASE
    WHEN o_orderstatus = 'P' THEN o_orderpriority END) AS c_mktsegment FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
  SELECT c.c_custkey, c.c_name, coalesce(u.c_acctbal, c.c_acctbal) AS c_acctbal, coalesce(u.c_mktsegment, c.c_mktsegment) AS c_mktsegment
    FROM customer c LEFT JOIN u USING (c_custkey)""")
def patch_merge(s, d):
    u = _t(s, d, "orders").where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("c_mktsegment"))
    return R.patch(_t(s, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), u, "c_custkey")


@query("""WITH a AS (SELECT user_id, value, 2 AS n, 1.5::DOUBLE AS dur FROM events WHERE event_type = 'view'
    UNION ALL SELECT user_id, value * 2, 1, 0.5 FROM events WHERE event_type = 'click')
  SELECT user_id, """ + sig("sum(value * dur) / sum(dur)") + """ AS average, min(value) AS minimum, max(value) AS maximum, sum(n)::BIGINT AS count, sum(dur)::DOUBLE AS duration
    FROM a GROUP BY 1""")
def stored_and_memory_merge(s, d):
    e = _t(s, d, "events")
    row = lambda v, n, dur: [v.alias("average"), v.alias("minimum"), v.alias("maximum"), F.lit(n).cast("long").alias("count"), F.lit(dur).alias("duration")]
    stored = e.where("event_type = 'view'").select("user_id", *row(F.col("value"), 2, 1.5))
    memory = e.where("event_type = 'click'").select("user_id", *row(F.col("value") * 2, 1, 0.5))
    return R.duration_weighted(stored.unionByName(memory), "user_id").withColumn("average", T.significant(F.col("average")))


@query("""SELECT p_partkey, (i - 1)::INT AS ord, list_extract(string_split(p_name, ' '), i) AS word FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i
    FROM part)""")
def order_index(s, d):
    return _t(s, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("ord", "word"))


@query("SELECT user_id, " + sig("sum(value)") + " AS usage FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def topk_gpu(s, d):
    return R.grouped_top(_t(s, d, "events"), "user_id", "value", 5)


@query("""WITH g AS (SELECT user_id, arg_min(event_type, event_id) AS event_type, """ + sig("sum(value)") + """ AS usage, count(*) AS members
    FROM events GROUP BY 1) SELECT * FROM g ORDER BY usage DESC, user_id LIMIT 8""")
def topk_responsible(s, d):
    return R.responsible_top(_t(s, d, "events"), "user_id", "event_type", "value", "event_id", 8)


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS down, l_suppkey AS up
    FROM lineitem ORDER BY greatest(l_partkey, l_suppkey) DESC, least(l_partkey, l_suppkey) DESC, l_shipdate DESC, id DESC LIMIT 10""")
def topk_network(s, d):
    x = _t(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("down"), F.col("l_suppkey").alias("up"), "l_shipdate")
    return R.network_top(x, "down", "up", "l_shipdate", "id", 10).select("id", "down", "up")


@query("SELECT * FROM (SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 6)")
def topk_power(s, d):
    return R.top(_t(s, d, "events").select("event_id", "value"), "value", "event_id", 6)


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal < 0, s_suppkey)::INT AS volume, row_number() OVER (ORDER BY s_acctbal >= 1000, s_suppkey)::INT AS gpu
    FROM supplier""")
def flag_order(s, d):
    """Removable volumes (negative balances here) come last, powered-off GPUs (small ones) first."""
    x = R.flag_ranked(_t(s, d, "supplier"), F.col("s_acctbal") < 0, "s_suppkey", "volume")
    return R.flag_ranked(x, F.col("s_acctbal") >= 1000, "s_suppkey", "gpu").select("s_suppkey", "volume", "gpu")


@query("""WITH m AS (SELECT c_mktsegment AS g, min(c_custkey) AS f FROM customer GROUP BY 1) SELECT g, row_number() OVER (ORDER BY CASE g
    WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END, f)::INT AS position FROM m""")
def display_order(s, d):
    """Groups in a given order, then in that of their first appearance."""
    return R.group_order(_t(s, d, "customer"), "c_mktsegment", "c_custkey", ["MACHINERY", "BUILDING"]).select(F.col("c_mktsegment").alias("g"), "position")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_size > 10 AND p_retailprice > 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def active_gpus(s, d):
    return R.active_by(_t(s, d, "part"), (F.col("p_size") > 10) & (F.col("p_retailprice") > 0), "p_retailprice", "p_partkey").limit(20).select("p_partkey", "p_retailprice")


@query()
def first_unused_match(s, d):
    n, r = _t(s, d, "nation").select("n_nationkey", "n_name"), _t(s, d, "supplier").select("s_suppkey", "s_nationkey")
    return R.first_unused(n, r, F.col("s_nationkey") <= F.col("n_nationkey"), "n_nationkey", "s_suppkey").select("n_nationkey", "s_suppkey")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal * 10000 END IS NULL OR c_acctbal * 10000 >= 50000000 AS may_write,
    CASE WHEN c_nationkey = 3 AND c_custkey % 2 = 0 THEN 'compact' WHEN c_custkey % 2 = 0 AND (c_nationkey = 5 OR c_custkey % 600 >= 300) AND c_custkey * 20 > 2000 THEN 'compact'
         WHEN c_custkey % 2 = 0 AND (c_nationkey = 5 OR c_custkey % 600 >= 300) THEN 'append' ELSE 'nothing' END AS action FROM customer""")
def write_guards(s, d):
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    free = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") * 10000)
    return _t(s, d, "customer").select("c_custkey", K.may_write(free).alias("may_write"), K.daily_action(k * 20, n == 3, k % 2 == 0, k % 600, n == 5).alias("action"))


@query("""SELECT 'p' || o_orderkey AS path, CASE WHEN o_orderstatus = 'P' THEN 'acquired'
    WHEN o_custkey > 100 THEN 'held' ELSE 'taken over' END AS outcome, CASE
    WHEN o_orderstatus <> 'P' AND o_custkey > 100 THEN o_custkey ELSE 220 END AS until_s FROM orders""")
def writer_lock(s, d):
    owner = F.when(F.col("o_orderstatus") != "P", F.lit("x"))
    return K.writer_lock(_t(s, d, "orders").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path"), owner.alias("owner"), F.col("o_custkey").alias("until_s")), 100)


@query("""SELECT o_orderkey, k::INT AS ord, CASE k WHEN 0 THEN 'GPU' ELSE 'g' || o_custkey END AS id, CASE
    WHEN k = 0 OR o_orderstatus = 'F' THEN least((o_custkey % 130) / 100, 1) END AS utilization, CASE k WHEN 0 THEN NULL ELSE 0.25 END AS render
  FROM orders, (SELECT unnest(range(2)) AS k)""")
def gpu_scan(s, d):
    u = (F.col("o_custkey") % 130).cast("double")
    one = lambda name, state, render: F.struct(name.alias("id"), state.alias("state"), u.alias("utilization"), F.lit(render).cast("double").alias("render"))
    gpus = F.array(one(F.lit(""), F.lit(True), None), one(F.concat(F.lit("g"), F.col("o_custkey").cast("string")), F.col("o_orderstatus") == "F", 25.0))
    return K.gpu_rows(_t(s, d, "orders").select("o_orderkey", gpus.alias("gpus")), "gpus")


@query("""SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS ord, 'T' || l_linenumber AS key
    FROM lineitem QUALIFY l_tax > 0.01""")
def key_enumeration(s, d):
    x = _t(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_tax") > 0.01, F.concat(F.lit("T"), F.col("l_linenumber").cast("string"))).alias("key")).alias("k"))
    lists = x.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list("k")), lambda v: v["key"]).alias("keys"))
    return K.readable_keys(lists, "keys")


@query(f"""WITH {EV}, p AS (SELECT seq, user_id, us, event_type <> 'error' AS status, value FROM ev),
  b AS (SELECT *, last_value(CASE
    WHEN status THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM p)
  SELECT seq, user_id AS key, status, value AS latency, CASE WHEN status THEN abs(value - before) END AS step FROM b""")
def connectivity_steps(s, d):
    e = _ev(s, d).select(F.col("user_id").alias("key"), "us", "seq", (F.col("event_type") != "error").alias("status"), F.col("value").alias("latency"))
    return K.connectivity(e).select("seq", "key", "status", "latency", "step")


@query("""SELECT 'm' || k AS path, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'badMagic'
    WHEN 2 THEN 'truncated' ELSE 'badChecksum' END AS damage FROM (SELECT DISTINCT user_id // 10 AS k FROM events)""")
def archive_damage(s, d):
    """Archives of ten users each, some of them spoilt; what is wrong with each decides whether it is kept aside."""
    from .sources import archive

    users = _t(s, d, "events").select("user_id").distinct()
    shard = F.concat(F.lit("m"), F.floor(F.col("user_id") / 10).cast("string"))
    slots = users.select(shard.alias("shard"), (F.col("user_id") % 10).cast("int").alias("lane"), F.lit(1000).alias("bucket"), F.lit(1).alias("count"), F.lit(1.0).alias("min"), F.lit(1.0).alias("max"), F.lit(1.0).alias("sum"), F.lit(1).alias("reason"))
    lanes = slots.select("shard").distinct().select("shard", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("lane"))
    lanes = lanes.select("shard", "lane", F.substring(F.sha2(F.col("lane").cast("string"), 256), 1, 32).alias("identity"), F.lit("cpu").alias("module"), F.lit("percent").alias("unit"), F.lit("gauge").alias("kind"), F.lit(0).alias("flags"), F.lit(1000).alias("first_valid"), F.lit(0).alias("last_used"), F.lit("l").alias("label"))
    files = archive.archive_files(slots, lanes, "t0", "shard")
    kind = F.regexp_extract("path", "^m([0-9]+)/", 1).cast("int") % 4
    spoilt = F.when(kind == 0, F.col("content")).when(kind == 1, F.concat(F.lit(b"X"), F.expr("substr(content, 2)"))).when(kind == 2, F.expr("substr(content, 1, octet_length(content) - 1)")).otherwise(F.concat(F.expr("substr(content, 1, 4200)"), F.lit(b"?"), F.expr("substr(content, 4202)")))
    lanes_found = archive.lanes_of(files.select(F.regexp_replace("path", "/.*", "").alias("path"), spoilt.alias("content")))
    return lanes_found.select("path", "damage").distinct()


@query(f"""WITH {EV}, d AS ({fold_sql(10, "user_id")}) SELECT lane, bucket, count, min, max, sum FROM d
  WHERE bucket * 10 + 10 <= (SELECT epoch_us(max(ts)) // 1000000 - 3600 FROM events)""")
def stream_commits(s, d):
    """Closed windows of the stream, committed batch by batch to a table kept by day; each batch also goes to a table of the newest slot of each lane."""
    import uuid

    from .catalogue import _stream
    from .sources.shared import shared_folder
    from .streaming import commits
    from .streaming.folds import stream_fold

    folder = f"{shared_folder(s)}/commits-{uuid.uuid4().hex}"
    slots = stream_fold(_stream(s, d), 10, "1 hour").select("lane", F.floor(F.unix_seconds("start") / 10).alias("bucket"), "count", "min", "max", "sum")
    commits.start(slots, f"{folder}/state", commits.table_sink(f"{folder}/t0", 8640), commits.snapshot_sink(f"{folder}/latest", "lane", "bucket"), seconds=None).awaitTermination()
    return s.read.parquet(f"{folder}/t0").drop("part").withColumn("sum", T.significant(F.col("sum")))
