"""Registered queries of the hardware projections, with their DuckDB SQL. Rows of the test tables play the readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import _W, EV, _ev, _t, query, sig
from .functions import scalars as S
from .operators import relational as R
from .operators import sensors as P
from .operators import windows as W

_LINE = "l_orderkey * 10 + l_linenumber AS id"


def _lines(s, d):
    return _t(s, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


@query(f"""WITH x AS (SELECT {_LINE}, CASE l_returnflag WHEN 'A' THEN 'temperature'
    WHEN 'N' THEN 'current' ELSE 'voltage' END AS kind, floor(l_quantity / 2) * 5 AS value FROM lineitem)
  SELECT id, kind, value, value >= 0 AND value < 300 AS hid FROM x
  WHERE NOT (kind = 'temperature' AND (value = 0 OR value > 110)) AND NOT (kind = 'current' AND value > 100)""")
def sensor_plausible(s, d):
    x = _lines(s, d).select("id", F.when(F.col("l_returnflag") == "A", "temperature").when(F.col("l_returnflag") == "N", "current").otherwise("voltage").alias("kind"), (F.floor(F.col("l_quantity") / 2) * 5).cast("double").alias("value"))
    return x.where(P.plausible(F.col("kind"), F.col("value"))).withColumn("hid", P.plausible_hid(F.col("value")))


_SENSOR = """sensor AS (SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'TA' || (p_partkey % 10) || 'P' WHEN 1 THEN 'Average CPU'
    WHEN 2 THEN 'TB1T' WHEN 3 THEN 'TA' || (p_partkey % 10) || 'X' ELSE p_brand END AS key,
    CASE p_partkey % 4 WHEN 0 THEN 'temperature' WHEN 1 THEN 'fan' WHEN 2 THEN 'voltage' ELSE 'current' END AS type, (p_size - 25)::DOUBLE AS value, p_size % 2 = 0 AS computed FROM part)"""


def _sensors(s, d):
    key = F.expr("CASE p_size % 5 WHEN 0 THEN concat('TA', p_partkey % 10, 'P') WHEN 1 THEN 'Average CPU' WHEN 2 THEN 'TB1T' WHEN 3 THEN concat('TA', p_partkey % 10, 'X') ELSE p_brand END")
    kind = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'temperature' WHEN 1 THEN 'fan' WHEN 2 THEN 'voltage' ELSE 'current' END")
    return _t(s, d, "part").select(F.col("p_partkey").alias("id"), key.alias("key"), kind.alias("type"), (F.col("p_size") - 25).cast("double").alias("value"), (F.col("p_size") % 2 == 0).alias("computed"))


@query(f"""WITH {_SENSOR} SELECT id, key FROM sensor
    WHERE key IN ('Average CPU', 'Average GPU', 'TB1T', 'TB2T') OR (key LIKE 'TA_P' AND substr(key, 3, 1) BETWEEN '0' AND '9')""")
def curated_keys(s, d):
    x = _sensors(s, d)
    return x.where(P.curated(F.col("key"))).select("id", "key")


@query(f"""WITH {_SENSOR} SELECT id, key, value FROM sensor WHERE (type = 'fan' AND NOT computed)
  OR (type = 'temperature' AND value > 0 AND (key IN ('Average CPU', 'TB1T') OR (key LIKE 'TA_P' AND substr(key, 3, 1) BETWEEN '0' AND '9')))
  OR (type IN ('temperature', 'voltage', 'power') AND value <> 0 AND key IN (SELECT p_brand FROM part WHERE p_retailprice > 1500))""")
def recorded_sensors(s, d):
    enabled = _t(s, d, "part").where("p_retailprice > 1500").select(F.col("p_brand").alias("key"))
    return P.recorded(_sensors(s, d), enabled).select("id", "key", "value")


@query(f"""WITH x AS (SELECT {_LINE}, CASE l_linestatus WHEN 'O' THEN 'VD0R' ELSE 'ID0R' END AS key, l_discount * 6 AS value FROM lineitem)
  SELECT id, CASE WHEN key = 'VD0R' AND value < 0.4 THEN 0 WHEN key = 'ID0R' AND value < 0.05 THEN 0 ELSE value END AS value FROM x""")
def sensor_dead_band(s, d):
    key = F.when(F.col("l_linestatus") == "O", "VD0R").otherwise("ID0R")
    return _lines(s, d).select("id", P.dead_band(key, F.col("l_discount") * 6).alias("value"))


@query("SELECT event_id, least(greatest(value / 100, 0), 1) AS share, least(value, 100) AS percent FROM events")
def sensor_clamps(s, d):
    v = F.col("value")
    return _t(s, d, "events").select("event_id", P.clamped(v / 100, 0.0, 1.0).alias("share"), F.least(v, F.lit(100.0)).alias("percent"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' AND user_id < 100 THEN (value * 100)::BIGINT // 2 ELSE (value * 100)::BIGINT END AS bytes FROM events""")
def vpn_halving(s, d):
    bytes_ = F.round(F.col("value") * 100).cast("long")
    return _t(s, d, "events").select("event_id", P.halved_in_tunnel(bytes_, F.col("event_type") == "view", F.col("user_id") < 100).alias("bytes"))


_PAGES = "l_partkey AS active, l_suppkey AS inactive, l_linenumber AS speculative, l_orderkey % 1000 AS wired, l_quantity::BIGINT AS compressed, l_partkey % 7 AS purgeable, l_suppkey % 5 AS external"


@query(f"""WITH x AS (SELECT {_LINE}, {_PAGES} FROM lineitem),
    u AS (SELECT *, (active + inactive + speculative + wired + compressed - purgeable - external) * 4096.0::DOUBLE AS used FROM x)
  SELECT id, used, 17179869184 - used AS free, used - (wired + compressed) * 4096 AS app, (purgeable + external) * 4096::DOUBLE AS cache,
    CASE active % 5 WHEN 2 THEN 'warning' WHEN 4 THEN 'critical' ELSE 'normal' END AS pressure FROM u""")
def memory_columns(s, d):
    pages = "l_partkey AS active|l_suppkey AS inactive|l_linenumber AS speculative|l_orderkey % 1000 AS wired|cast(l_quantity as bigint) AS compressed|l_partkey % 7 AS purgeable|l_suppkey % 5 AS external"
    x = _lines(s, d).select("id", *[F.expr(e) for e in pages.split("|")], F.lit(17179869184).alias("total"))
    return P.memory_columns(x).select("id", "used", "free", "app", "cache", P.pressure_level(F.col("active") % 5).alias("pressure"))


@query("""SELECT o_orderkey, CASE
    WHEN size = 0 THEN 0 ELSE greatest(size - free, 0) / size END::DOUBLE AS used FROM (SELECT o_orderkey, o_custkey % 50 AS size, o_orderkey % 70 AS free
    FROM orders)""")
def disk_used(s, d):
    return _t(s, d, "orders").select("o_orderkey", P.disk_used(F.col("o_custkey") % 50, F.col("o_orderkey") % 70).alias("used"))


@query(f"""WITH x AS (SELECT {_LINE}, l_partkey % 300 AS capacity, l_suppkey % 40 + 200 AS design, l_quantity AS ma, l_discount AS v FROM lineitem)
  SELECT id, least(round_even(100.0::DOUBLE * capacity / design, 0), 100)::INT AS health, v * (ma / 1000) AS power FROM x""")
def battery_health(s, d):
    return _lines(s, d).select("id", P.battery_health(F.col("l_partkey") % 300, F.col("l_suppkey") % 40 + 200).alias("health"), P.battery_power(F.col("l_discount"), F.col("l_quantity")).alias("power"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey END, -1)::DOUBLE AS charge
    FROM customer""")
def fallback_chain(s, d):
    c = _t(s, d, "customer")
    return c.select("c_custkey", F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey").cast("double")), F.lit(-1.0)).alias("charge"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 OR (c_nationkey < 10 AND length(c_mktsegment) > 8)")
def active_devices(s, d):
    levels = F.when(F.length("c_mktsegment") > 8, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>"))
    return _t(s, d, "customer").where(P.active_device(F.col("c_acctbal") > 5000, F.col("c_nationkey") < 10, levels)).select("c_custkey")


@query("""WITH x AS (SELECT event_id, user_id * 3 AS a, event_id % 300 AS b FROM events)
  SELECT event_id, CASE event_id % 4 WHEN 3 THEN false ELSE a < 256 AND b < 256 END AS valid, CASE event_id % 3 WHEN 0 THEN '10.0.0.' || b
    WHEN 1 THEN NULL ELSE '2001:db8::' || b END AS shown FROM x""")
def address_validity(s, d):
    b = F.col("event_id") % 300
    tail = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 3, ".x").otherwise(".")
    text = F.concat_ws(".", F.lit("10"), F.col("user_id") * 3, F.lit("7"), b)
    v4 = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("10.0.0."), b)).otherwise("")
    v6 = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("fe80::"), b)).otherwise(F.concat(F.lit("2001:db8::"), b))
    return _t(s, d, "events").select("event_id", S.ipv4(F.concat(text, tail)).alias("valid"), S.local_address(v4, v6).alias("shown"))


@query(f"""WITH {EV}, c AS (SELECT seq, user_id, us AS up, us + CASE WHEN value > 60 THEN 4000000000 ELSE 0 END AS wall FROM ev),
  l AS (SELECT seq, user_id, (up - lag(up) OVER w) / 1000000 AS elapsed, (wall - lag(wall) OVER w) / 1000000 AS walled FROM c
    WINDOW w AS (PARTITION BY user_id ORDER BY seq))
  SELECT seq, user_id, elapsed AS elapsed_s FROM l WHERE elapsed > 0 AND elapsed <= 3 * 3600 AND abs(walled - elapsed) < 3600""")
def legacy_acceptance(s, d):
    e = _ev(s, d).withColumn("wall", F.col("us") + F.when(F.col("value") > 60, 4_000_000_000).otherwise(0))
    return W.accepted_for_minutes(e, "user_id", "wall", "us", 3600).select("seq", "user_id", "elapsed_s")


@query(f"WITH {EV}, p AS (SELECT *, lag(event_type) OVER w AS p FROM ev {_W}) SELECT seq, user_id, value FROM p WHERE p = event_type")
def first_after_change(s, d):
    return W.unchanged_key(_ev(s, d), "user_id", "event_type").select("seq", "user_id", "value")


@query("SELECT event_id FROM events WHERE (event_type = 'view' AND user_id < 75) OR (event_type = 'click' AND user_id >= 75)")
def reader_dispatch(s, d):
    e = _t(s, d, "events").withColumn("reader", F.when(F.col("user_id") < 75, "capacity").otherwise("activity"))
    return P.emitted_by(e, "reader", "event_type", {"view": "capacity", "click": "activity"}).select("event_id")


_TICKS = """SELECT seq, user_id, us, (seq * 2654435761) % 4294967296 AS u, (seq * 40503) % 4294967296 AS y, (seq * 97) % 4294967296 AS i, 0::BIGINT AS n FROM ev"""


@query(f"""WITH {EV}, t AS ({_TICKS}),
    l AS (SELECT seq, user_id, us, (u - lag(u) OVER w + 4294967296) % 4294967296 AS u, (y - lag(y) OVER w + 4294967296) % 4294967296 AS y,
    (i - lag(i) OVER w + 4294967296) % 4294967296 AS i FROM t {_W})
  SELECT seq, user_id, u / (u + y + i) + y / (u + y + i) AS usage, i / (u + y + i) AS idle FROM l""")
def cpu_ratio(s, d):
    """User, system, idle and nice ticks of 32 bits; nice counts in the total and not in the usage."""
    e = _ev(s, d)
    for name, k in (("u", 2654435761), ("y", 40503), ("i", 97)):
        e = e.withColumn(name, F.col("seq") * F.lit(k) % F.lit(1 << 32))
    return W.counter_ratio(e.withColumn("n", F.lit(0).cast("long")), "user_id", ["u", "y", "i", "n"], ["u", "y"]).select("seq", "user_id", "usage", F.col("share_i").alias("idle"))


@query("SELECT l_orderkey, (l_linenumber - 1) // 2 AS pair, sum(l_discount) / 2 AS usage FROM lineitem GROUP BY 1, 2 HAVING count(*) = 2")
def core_pairs(s, d):
    x = _t(s, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).cast("long").alias("core"), F.col("l_discount").alias("usage"))
    return P.pair_mean(x, "l_orderkey")


@query(f"SELECT l_returnflag, {sig('avg(l_discount)')} AS mean FROM lineitem GROUP BY 1")
def core_type_mean(s, d):
    return P.group_mean(_t(s, d, "lineitem"), "l_returnflag", value="l_discount")


@query(f"""WITH x AS (SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN 'IDLE'
    WHEN 2 THEN 'DOWN' ELSE 'V' || l_linenumber END AS state, l_quantity AS r, l_partkey % 40 * 100 AS mhz FROM lineitem)
  SELECT l_orderkey, greatest({sig("sum(r * mhz) / sum(r)")}, 600) AS mhz FROM x WHERE state NOT IN ('IDLE', 'DOWN', 'OFF') GROUP BY 1""")
def residency_frequency(s, d):
    state = F.when(F.col("l_linenumber") == 1, "IDLE").when(F.col("l_linenumber") == 2, "DOWN").otherwise(F.concat(F.lit("V"), F.col("l_linenumber").cast("string")))
    x = _t(s, d, "lineitem").select("l_orderkey", state.alias("state"), F.col("l_quantity").alias("residency"), (F.col("l_partkey") % 40 * 100).alias("mhz"))
    return P.residency_frequency(x, "l_orderkey", floor_mhz=F.lit(600.0))


@query(f"""WITH x AS (SELECT l_orderkey, l_returnflag AS c, avg(l_partkey) AS mhz, CASE l_returnflag WHEN 'A' THEN 4 WHEN 'N' THEN 6 ELSE 2 END AS n
    FROM lineitem GROUP BY 1, 2)
  SELECT l_orderkey, {sig("sum(mhz * n) / sum(n)")} AS mhz FROM x GROUP BY 1""")
def weighted_frequency(s, d):
    x = _t(s, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("cluster")).agg(F.avg("l_partkey").alias("mhz"))
    return P.weighted_frequency(x, "l_orderkey", clusters={"A": 4, "N": 6, "R": 2})


@query(f"""WITH x AS (SELECT l_orderkey, 'k' || l_linenumber AS key, CASE l_returnflag WHEN 'A' THEN 'CPU'
    WHEN 'N' THEN 'GPU' ELSE 'SOC' END AS g, CASE
    WHEN l_linenumber > 4 THEN 'fan' ELSE 'temperature' END AS type, l_quantity AS value, l_tax > 0.02 AS averaged FROM lineitem),
  a AS (SELECT l_orderkey, g, {sig("avg(value)")} AS mean, max(value) AS top FROM x WHERE type = 'temperature' AND averaged GROUP BY 1, 2)
  SELECT l_orderkey, key, type, value FROM x UNION ALL SELECT l_orderkey, 'Average ' || g, 'temperature', mean FROM a
    UNION ALL SELECT l_orderkey, 'Hottest ' || g, 'temperature', top FROM a
  UNION ALL SELECT l_orderkey, 'Fastest fan', 'fan', max(value) FROM x WHERE type = 'fan' GROUP BY 1 HAVING count(*) > 1""")
def computed_sensors(s, d):
    group = F.when(F.col("l_returnflag") == "A", "CPU").when(F.col("l_returnflag") == "N", "GPU").otherwise("SOC")
    x = _t(s, d, "lineitem").select("l_orderkey", F.concat(F.lit("k"), F.col("l_linenumber").cast("string")).alias("key"), group.alias("group"), F.when(F.col("l_linenumber") > 4, "fan").otherwise("temperature").alias("type"), F.col("l_quantity").alias("value"), (F.col("l_tax") > 0.02).alias("averaged"))
    return P.computed_rows(x, "l_orderkey")


@query(f"""WITH {EV}, c AS (SELECT seq, user_id, us, (value * 100)::BIGINT AS c FROM ev),
    l AS (SELECT seq, user_id, c - lag(c) OVER w AS dc, (us - lag(us) OVER w) / 1000000 AS dt FROM c {_W})
  SELECT seq, user_id, CASE WHEN dc >= 0 AND dt > 0 THEN dc / dt END AS fps FROM l""")
def frame_rate(s, d):
    e = _ev(s, d).withColumn("c", F.round(F.col("value") * 100).cast("long"))
    return W.frame_rate(e, "user_id", "c").select("seq", "user_id", "fps")


@query(f"""WITH {EV}, c AS (SELECT seq, user_id, us, floor(value / 10)::BIGINT AS c FROM ev), l AS (SELECT seq, user_id, c, lag(c) OVER w AS p
    FROM c {_W})
  SELECT seq, user_id, CASE WHEN p IS NULL THEN 0 WHEN p = 0 THEN greatest(c, 0) ELSE greatest(c - p, 0) END AS step FROM l""")
def network_step(s, d):
    e = _ev(s, d).withColumn("c", F.floor(F.col("value") / 10).cast("long"))
    return W.step_per_row(e, "user_id", "c").select("seq", "user_id", F.col("step").cast("long").alias("step"))


@query(f"""WITH {EV}, r AS (SELECT seq, user_id, us, value, us // 259200000000 AS run
    FROM ev) SELECT seq, user_id, value - lag(value) OVER (PARTITION BY user_id, run ORDER BY us, seq) AS step FROM r""")
def run_bases(s, d):
    e = _ev(s, d).withColumn("run", F.floor(F.col("us") / 259_200_000_000))
    return W.run_bases(e, "user_id", "value", "run").select("seq", "user_id", "step")


_CLIENTS = """c AS (SELECT user_id AS client, user_id % 40 AS pid, 'p' || user_id AS name, CASE
    WHEN value > 90 THEN 2 ELSE 1 END AS queues, event_id * 1000000 + (value * 1000)::BIGINT AS gpu_ns,
    (us // 3600000000) * 1000000000 AS tick_ns, row_number() OVER (PARTITION BY user_id, us // 3600000000 ORDER BY us) AS k FROM (SELECT *, epoch_us(ts) AS us
    FROM events))"""


@query(f"""WITH {_CLIENTS}, o AS (SELECT * EXCLUDE (k) FROM c WHERE k = 1),
    t AS (SELECT tick_ns, lag(tick_ns) OVER (ORDER BY tick_ns) AS before FROM (SELECT DISTINCT tick_ns FROM o)),
  u AS (SELECT *, tick_ns - before AS elapsed FROM t WHERE tick_ns - before >= 250000000 AND tick_ns - before <= 3000000000)
  SELECT o.tick_ns, o.pid, arg_min(o.name, o.client) AS name, {sig("sum((o.gpu_ns - p.gpu_ns) / u.elapsed * 100)")} AS usage
  FROM o JOIN u ON o.tick_ns = u.tick_ns JOIN o p ON p.client = o.client AND p.tick_ns = u.before AND p.pid = o.pid AND p.queues = o.queues AND o.gpu_ns >= p.gpu_ns GROUP BY 1, 2""")
def gpu_usage_by_pid(s, d):
    e = _ev(s, d)
    tick = (F.floor(F.col("us") / 3_600_000_000) * 1_000_000_000).cast("long")
    c = e.select(F.col("user_id").alias("client"), (F.col("user_id") % 40).alias("pid"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("name"), F.when(F.col("value") > 90, 2).otherwise(1).alias("queues"), (F.col("seq") * 1_000_000 + F.round(F.col("value") * 1000).cast("long")).alias("gpu_ns"), tick.alias("tick_ns"), "us")
    one = R.first_of(c.withColumn("key", F.concat_ws("|", "client", "tick_ns")), "key", "us").drop("key", "us")
    return R.usage_by_pid(one, 1.0)


@query("""WITH e AS (SELECT o_orderkey AS ord, o_orderpriority AS name, o_custkey AS capacity, 'a' || o_orderkey AS address, CASE
    WHEN o_orderstatus = 'F' THEN 'Case' WHEN o_totalprice > 200000 THEN 'Combined' END AS part,
    CASE WHEN o_custkey % 9 > 0 THEN o_custkey % 200 END AS grp, o_orderstatus = 'O' AS charging FROM orders),
  g AS (SELECT grp, arg_min(name, ord) FILTER (part = 'Combined') AS cn, arg_min(address, ord) FILTER (part = 'Combined') AS ca, arg_min(capacity, ord) FILTER (part = 'Combined') AS cc, arg_min(charging, ord) FILTER (part = 'Combined') AS cg,
     arg_min(capacity, ord) FILTER (part = 'Case') AS kc, arg_min(charging, ord) FILTER (part = 'Case') AS kg, arg_min(name, ord) AS an, arg_min(address, ord) AS aa, arg_min(capacity, ord) AS ac, arg_min(charging, ord) AS ag FROM e WHERE grp IS NOT NULL GROUP BY 1)
  SELECT name, address, 'battery=' || capacity || '=' || CASE WHEN charging THEN 'charging' ELSE 'discharging' END AS levels FROM e WHERE grp IS NULL
  UNION ALL SELECT coalesce(cn, an), CASE WHEN cn IS NOT NULL THEN ca ELSE aa END,
    CASE WHEN kc IS NOT NULL THEN 'case=' || kc || '=' || CASE WHEN kg THEN 'charging' ELSE 'discharging' END
         ELSE 'battery=' || coalesce(cc, ac) || '=' || CASE WHEN coalesce(cg, ag) THEN 'charging' ELSE 'discharging' END END FROM g""")
def accessory_groups(s, d):
    part = F.when(F.col("o_orderstatus") == "F", "Case").when(F.col("o_totalprice") > 200000, "Combined")
    e = _t(s, d, "orders").select(
        F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").cast("int").alias("capacity"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("address"), part.alias("part"),
        F.when(F.col("o_custkey") % 9 > 0, F.col("o_custkey") % 200).alias("grp"), F.lit(None).cast("string").alias("category"), (F.col("o_orderstatus") == "O").alias("charging"), F.lit(None).cast("array<struct<part:string,capacity:int,charging:boolean>>").alias("parts"),
    )
    levels = F.array_join(F.transform("levels", lambda x: F.concat_ws("=", x["key"], x["value"], x["state"])), ",")
    return P.accessory_levels(e).select("name", "address", levels.alias("levels"))


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, max(l_discount) AS v FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, {sig("avg(v)")} AS mean
    FROM l GROUP BY 1""")
def machine_cpu_mean(s, d):
    x = _t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("v"))
    m = x.groupBy("l_orderkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("l_linenumber", "v")))).alias("m"))
    from .operators.series import significant

    return m.select("l_orderkey", significant(P.map_mean(F.col("m"))).alias("mean"))


_TEMPLATES = [(0, "TC0P", "CPU proximity", "temperature"), (1, "T%P", "Sensor %", "temperature"), (2, "VC0C", "CPU core", "voltage"), (3, "TC%C", "Core %", "temperature"), (4, "T0P", "Again", "temperature")]
_AVAILABLE = """SELECT DISTINCT substr('TVPIX', (p_partkey % 5 + 1)::INT, 1) || CASE p_size % 3 WHEN 0 THEN 'C' || (p_partkey % 12) || 'C'
    WHEN 1 THEN (p_partkey % 10) || 'P' ELSE 'C0P' END AS key FROM part"""
_TEMPLATE_SQL = ", ".join(str(t) for t in _TEMPLATES)


@query(f"""WITH a AS (SELECT key FROM ({_AVAILABLE}) WHERE substr(key, 1, 1) IN ('T', 'V', 'P', 'I')),
    t(pos, key, name, type) AS (VALUES {_TEMPLATE_SQL}),
  x AS (SELECT pos, 0 AS d, key, name, type FROM t WHERE NOT contains(key, '%')
    UNION ALL SELECT pos + 1000, d, replace(key, '%', d::VARCHAR), name, type FROM t, (SELECT unnest(range(10)) AS d) WHERE contains(key, '%')),
  f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos, d) AS k FROM x WHERE key IN (SELECT key FROM a)),
    g AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY d) AS i FROM f WHERE k = 1)
  SELECT key, replace(name, '%', i::VARCHAR) AS name, type FROM g
  UNION ALL SELECT key, key, CASE substr(key, 1, 1) WHEN 'T' THEN 'temperature' WHEN 'V' THEN 'voltage' WHEN 'P' THEN 'power' ELSE 'current' END
    FROM a WHERE key NOT IN (SELECT key FROM g)""")
def sensor_templates(s, d):
    key = F.concat(F.expr("substr('TVPIX', cast(p_partkey % 5 + 1 as int), 1)"), F.expr("CASE p_size % 3 WHEN 0 THEN concat('C', p_partkey % 12, 'C') WHEN 1 THEN concat(p_partkey % 10, 'P') ELSE 'C0P' END"))
    templates = s.createDataFrame(_TEMPLATES, "pos int, key string, name string, type string")
    return P.expand_templates(templates, _t(s, d, "part").select(key.alias("key")))


@query("""WITH known AS (SELECT c_custkey AS bsd, c_acctbal AS p, c_nationkey * 10 AS m FROM customer),
    mounted AS (SELECT o_custkey AS bsd, max(o_totalprice) AS size, min(o_totalprice) AS free, count(*)::DOUBLE AS p FROM orders GROUP BY 1)
  SELECT x.bsd, x.size, x.free, CASE WHEN 100 - k.m < 60 THEN k.p ELSE x.p END AS purgeable, CASE
    WHEN 100 - k.m < 60 THEN k.m ELSE 100 END AS measured_s FROM mounted x LEFT JOIN known k USING (bsd)""")
def volume_upsert(s, d):
    known = _t(s, d, "customer").select(F.col("c_custkey").alias("bsd"), F.col("c_acctbal").alias("purgeable"), (F.col("c_nationkey") * 10).alias("measured_s"))
    mounted = _t(s, d, "orders").groupBy(F.col("o_custkey").alias("bsd")).agg(F.max("o_totalprice").alias("size"), F.min("o_totalprice").alias("free"), F.count(F.lit(1)).cast("double").alias("purgeable"))
    return P.upsert_volumes(known, mounted, 100)


@query("""WITH v AS (SELECT o_orderkey AS tick, o_custkey AS driver, 'd' || o_orderkey AS bsd FROM orders), 
  l AS (SELECT *, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS ord FROM lineitem),
  r AS (SELECT l_orderkey AS tick, arg_min(l_partkey, ord) AS read, arg_min(l_suppkey, ord) AS written, min(ord) AS ord FROM l GROUP BY 1)
  SELECT v.tick, v.driver, v.bsd, r.ord, r.read, r.written FROM v JOIN r USING (tick)""")
def driver_counters(s, d):
    o = _t(s, d, "orders")
    volumes = o.select(F.col("o_orderkey").alias("tick"), F.col("o_custkey").alias("driver"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("bsd"))
    readings = _t(s, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("driver")), "l_orderkey")
    readings = readings.select(F.col("l_orderkey").alias("tick"), "driver", (F.col("l_linenumber") * 1_000_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("ord"), F.col("l_partkey").alias("read"), F.col("l_suppkey").alias("written"))
    return P.driver_counters(volumes, readings).select("tick", "driver", "bsd", "ord", "read", "written")
