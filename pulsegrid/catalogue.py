"""Registered telemetry queries, each with the DuckDB SQL of the same result. `events` plays the sample stream: the event type or the user is the lane."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import relational as R
from .operators import series as T
from .operators import windows as W
from .plans.columns import plan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EV = "ev AS (SELECT event_id AS seq, epoch_us(ts) AS us, ts, user_id, event_type, value, props FROM events)"
NOW = 1_706_659_200  # 2024-01-31 00:00 UTC, the end of the events
SPANS = [(1704412800, 1704441600, 2), (1704430000, 1704450000, 3), (1705276800, 1705300000, 4), (1706000000, 1706100000, 2)]
_SPAN_SQL = ", ".join(str(s) for s in SPANS)
MONTH = plan(2592000, NOW - 1)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ev(spark: SparkSession, d: str, lane: str = "event_type") -> DataFrame:
    e = _t(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), T.micros("ts").alias("us"), "ts", "user_id", "event_type", "value", "props", F.col(lane).cast("string").alias("lane"))


def sig(x: str) -> str:
    """DuckDB SQL of a double with 12 significant digits."""
    return f"printf('%.11e', {x})::DOUBLE"


def fold_sql(step: int, lane: str = "event_type") -> str:
    """Slots of the events: counts stop at 65,535 and sums with them; the envelope goes on."""
    return f"""SELECT lane, bucket, least(count(*), 65535)::BIGINT AS count, min(value) AS min, max(value) AS max,
        {sig("sum(value) FILTER (k <= 65535)")} AS sum
      FROM (SELECT {lane}::VARCHAR AS lane, us // {step * 1_000_000} AS bucket, value,
                   row_number() OVER (PARTITION BY {lane}, us // {step * 1_000_000} ORDER BY us, seq) AS k
            FROM ev WHERE isfinite(value) AND us > 0)
      GROUP BY 1, 2"""


_FOLD = f"fold AS ({fold_sql(1800)})"


def _fold(s: SparkSession, d: str, step: int, lane: str = "event_type") -> DataFrame:
    return T.fold(_ev(s, d, lane), step, ("us", "seq"))


@query(f"WITH {EV}, {_FOLD} SELECT * FROM fold")
def bucket_fold_t2(s, d):
    return _fold(s, d, 1800)


@query(f"""WITH {EV}, fine AS ({fold_sql(120)})
  SELECT lane, bucket // 15 AS bucket, sum(count)::BIGINT AS count, min(min) AS min, max(max) AS max, {sig("sum(sum)")} AS sum
  FROM fine GROUP BY 1, 2""")
def rollup_t1_t2(s, d):
    return T.rollup(_fold(s, d, 120), 15)


@query(f"""WITH {EV},
    few AS (SELECT *, us // 86400000000 AS bucket, row_number() OVER (PARTITION BY event_type, us // 86400000000 ORDER BY us, seq) AS k FROM ev)
  SELECT event_type AS lane, bucket, least(count(*), 30)::BIGINT AS count, min(value) AS min, max(value) AS max, {sig("sum(value) FILTER (k <= 30)")} AS sum
  FROM few GROUP BY 1, 2""")
def bucket_fold_saturating(s, d):
    """The rule of full buckets, with 30 in place of 65,535 so that small tables reach it."""
    return T.fold(_ev(s, d), 86_400, ("us", "seq"), most=30)


_COLUMNS = f"""cols AS (SELECT l.lane, c.c AS "column", (c.c * {MONTH.per_column} + {MONTH.lower}) * {MONTH.step} AS start_s, f.count, f.min, f.sum / f.count AS avg, f.max
  FROM (SELECT DISTINCT lane FROM fold) l CROSS JOIN (SELECT unnest(range({MONTH.columns})) AS c) c
    LEFT JOIN fold f ON f.lane = l.lane AND f.bucket = {MONTH.lower} + c.c)"""


@query(f"WITH {EV}, {_FOLD}, {_COLUMNS} SELECT * FROM cols")
def column_resample_month(s, d):
    return T.columns(_fold(s, d, 1800), MONTH)


@query(f"""WITH {EV}, {_FOLD}, {_COLUMNS} SELECT lane, sum(count)::BIGINT AS count, min(min) AS min, max(max) AS max, {sig('sum(avg * count) / sum(count)')} AS avg
    FROM cols WHERE count > 0 GROUP BY lane""")
def lane_summary(s, d):
    return T.summary(T.columns(_fold(s, d, 1800), MONTH))


@query("""SELECT strftime(ts::TIMESTAMP AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin', '%Y%m%d')::INT AS day, sum(greatest((value * 100)::BIGINT, 0))::BIGINT AS upload, sum(greatest(user_id, 0))::BIGINT AS download
    FROM events GROUP BY 1""")
def daily_totals_local(s, d):
    return R.daily_totals(_t(s, d, "events"), F.col("ts"), "Europe/Berlin", F.round(F.col("value") * 100).cast("long"), F.col("user_id"))


@query(f"""WITH {EV}, {_FOLD}, spans(f, t, r) AS (VALUES {_SPAN_SQL}), spine AS (SELECT lane, b FROM (SELECT DISTINCT lane
    FROM fold) CROSS JOIN (SELECT unnest(range({MONTH.lower}, {MONTH.upper})) AS b)),
  cover AS (SELECT b, arg_max(r, CASE r WHEN 4 THEN 3 WHEN 2 THEN 2 ELSE 1 END) AS r FROM (SELECT DISTINCT b
    FROM spine) JOIN spans ON b * 1800 < t AND b * 1800 + 1800 > f GROUP BY b), firsts AS (SELECT lane, min(bucket) AS fb FROM fold GROUP BY lane)
  SELECT s.lane, s.b AS bucket, CASE WHEN f.bucket IS NOT NULL THEN 1 WHEN s.b < x.fb THEN 0 WHEN c.r IS NOT NULL THEN c.r
    WHEN s.b > {MONTH.upper - 20} THEN 3 ELSE 0 END::BIGINT AS reason
  FROM spine s LEFT JOIN fold f ON f.lane = s.lane AND f.bucket = s.b LEFT JOIN firsts x ON x.lane = s.lane LEFT JOIN cover c ON c.b = s.b""")
def gap_reasons(s, d):
    slots = _fold(s, d, 1800)
    spine = slots.select("lane").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(MONTH.lower).cast("long"), F.lit(MONTH.upper - 1).cast("long"))))
    spans = s.createDataFrame(SPANS, "from_s long, to_s long, reason long")
    return T.gap_reasons(slots, spine, spans, 1800, MONTH.upper - 20)


@query(f"""WITH {EV}, r AS (SELECT *, us - lag(us) OVER w AS d FROM ev
    WINDOW w AS (PARTITION BY user_id ORDER BY us, seq)) SELECT seq, user_id::VARCHAR AS lane, value / CASE
    WHEN d IS NULL THEN 60 ELSE least(d / 1000000, 60) END AS rate FROM r WHERE d IS NULL OR d > 0""")
def rate_from_counter(s, d):
    return T.rates(_ev(s, d, "user_id").withColumn("interval_s", F.lit(60))).select("seq", "lane", F.col("value").alias("rate"))


_ATTR = """attr AS (SELECT user_id::VARCHAR AS lane, us, seq, value, greatest((us - 60000000) // 10000000, coalesce(lag(us) OVER w // 10000000, 0)) AS lo, us // 10000000 AS hi
    FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, seq))"""
_SPREAD = "SELECT lane, b AS bucket, count(*) AS count, min(value) AS min, max(value) AS max, " + sig("sum(value)") + " AS sum FROM (SELECT lane, value, unnest(range(lo, hi + 1)) AS b FROM attr) GROUP BY 1, 2"


@query(f"WITH {EV}, {_ATTR} {_SPREAD}")
def span_attribution(s, d):
    return T.attribute_spans(_ev(s, d, "user_id").withColumn("interval_s", F.lit(60)), 10)


@query(f"""WITH {EV}, {_ATTR}, nx AS (SELECT *, coalesce(lead(lo) OVER (PARTITION BY lane ORDER BY us, seq), {NOW} // 10) AS n FROM attr),
    held AS (SELECT lane, value, unnest(range(hi + 1, least(n - 1, (us + 899999999) // 10000000) + 1)) AS b FROM nx)
  SELECT *, 1::BIGINT AS reason FROM ({_SPREAD}) UNION ALL SELECT lane, b, 1, value, value, value, 5 FROM held""")
def step_hold(s, d):
    return T.hold(_ev(s, d, "user_id").withColumn("interval_s", F.lit(60)), 10, NOW * T.MICRO)


@query("SELECT DISTINCT user_id, event_type, substr(sha256('events|' || user_id::VARCHAR || '|' || event_type), 1, 32) AS lane FROM events")
def lane_identity(s, d):
    e = _t(s, d, "events").select("user_id", "event_type").distinct()
    return e.withColumn("lane", R.lane_identity(F.lit("events"), F.col("user_id").cast("string"), F.col("event_type")))


@query(f"""WITH {EV}, a AS (SELECT user_id AS pos, 'l' || user_id AS lane, min(us // 10000000) AS first_bucket FROM ev GROUP BY 1),
  b AS (SELECT user_id AS pos, CASE WHEN max(value) > 300 THEN 'x' ELSE 'l' END || user_id AS lane, min(us // 1800000000) AS first_bucket
        FROM ev WHERE event_type = 'signup' GROUP BY 1)
  SELECT a.pos, a.lane, CASE WHEN a.lane = b.lane THEN b.first_bucket ELSE a.first_bucket END AS first_bucket FROM a LEFT JOIN b USING (pos)""")
def directory_reconcile(s, d):
    """The coarse tier's directory knows the lanes that signed up; a large value there stands for another identity at the position."""
    e, lane = _ev(s, d), F.col("user_id").cast("string")
    fine = e.groupBy(F.col("user_id").alias("pos")).agg(F.min(T.bucket("us", 10)).alias("first_bucket")).withColumn("lane", F.concat(F.lit("l"), F.col("pos").cast("string")))
    coarse = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("pos"), lane.alias("u")).agg(F.max("value").alias("top"), F.min(T.bucket("us", 1800)).alias("first_bucket"))
    return R.reconcile(fine, coarse.withColumn("lane", F.concat(F.when(F.col("top") > 300, "x").otherwise("l"), "u")))


@query("SELECT strftime(ts, '%Y%m%d')::INT AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 14")
def retention_days(s, d):
    days = _t(s, d, "events").groupBy(F.date_format("ts", "yyyyMMdd").cast("int").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return R.newest(days, "day", 14)


@query(f"""WITH {EV}, {_FOLD}, m AS (SELECT lane, max(bucket) AS m FROM fold GROUP BY 1) SELECT fold.* FROM fold JOIN m USING (lane) WHERE bucket > m - 100""")
def ring_retention(s, d):
    return T.retained(_fold(s, d, 1800), 100)


@query("SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def last_record_wins(s, d):
    return R.last_wins(_t(s, d, "events").select("user_id", "value", "event_id"), "user_id", "event_id")


_SHUFFLED = "late AS (SELECT event_type AS lane, us - (seq % 7) * 600000000 AS us, seq FROM ev)"


@query(f"""WITH {EV}, {_SHUFFLED},
    m AS (SELECT *, max(us // 10000000) OVER (PARTITION BY lane ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
    FROM late) SELECT seq, lane, us FROM m WHERE m IS NULL OR us // 10000000 >= m - 16""")
def late_data_drop(s, d):
    e = _ev(s, d).withColumn("us", F.col("us") - (F.col("seq") % 7) * 600_000_000)
    return T.drop_late(e, 10, 16).select("seq", "lane", "us")


@query(f"""WITH {EV}, c AS (SELECT seq, user_id, (us + CASE WHEN seq % 50 < 25 THEN 0 ELSE 5000000 END) AS wall, us AS mono FROM ev),
    s AS (SELECT *, (wall - lag(wall) OVER w) - (mono - lag(mono) OVER w) AS step_us FROM c
    WINDOW w AS (PARTITION BY user_id ORDER BY seq)) SELECT seq, user_id, step_us FROM s WHERE abs(step_us) > 2000000""")
def clock_steps(s, d):
    e = _ev(s, d).withColumn("wall", F.col("us") + F.when(F.col("seq") % 50 < 25, 0).otherwise(5_000_000))
    return W.clock_steps(e, "user_id", "wall", "us").select("seq", "user_id", "step_us")


@query(f"""WITH {EV}, k AS (SELECT user_id, us, seq, CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' THEN 0 END AS kind FROM ev),
    e AS (SELECT *, lag(kind) OVER w AS p FROM k WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY us, seq)),
  c AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us, seq) AS to_us FROM e WHERE p IS DISTINCT
    FROM kind) SELECT user_id, us AS from_us, to_us FROM c WHERE kind = 1 AND to_us IS NOT NULL AND us // 1000000 < to_us // 1000000""")
def sleep_spans(s, d):
    return W.session_spans(_ev(s, d), "user_id", F.col("event_type") == "signup", F.col("event_type") == "error")


@query(f"""WITH {EV}, {_FOLD}, done AS (SELECT lane, min(bucket) + 700 AS done FROM fold GROUP BY 1) SELECT fold.* FROM fold JOIN done USING (lane)
    WHERE bucket >= done""")
def catchup_rollup(s, d):
    fine = _fold(s, d, 120)
    done = fine.groupBy("lane").agg((F.floor(F.min("bucket") / 15) + 700).cast("long").alias("done"))
    return T.catch_up(fine, done, 15)


@query(f"""WITH {EV}, {_FOLD}, p AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY bucket) - 1 AS i, count(*) OVER (PARTITION BY lane) AS n
    FROM fold), c AS (SELECT DISTINCT lane, n, unnest(range(400)) AS c FROM p)
  SELECT c.lane, c.c AS "column", sum(p.count)::BIGINT AS count, min(p.min) AS min, {sig("sum(p.sum)")} / sum(p.count) AS avg, max(p.max) AS max
    FROM c LEFT JOIN p ON p.lane = c.lane AND p.i >= c.c * c.n // 400 AND p.i < (c.c + 1) * c.n // 400 GROUP BY 1, 2""")
def resample_fractional(s, d):
    return T.resample_fractional(_fold(s, d, 1800), 400)


@query("""SELECT * FROM (VALUES (3600, 't0', 360, 10), (21600, 't0', 720, 30), (86400, 't1', 720, 120), (604800, 't1', 504, 1200), (2592000, 't2', 1440, 1800), (31536000, 't2', 1460, 21600)) AS t(range_s, tier, columns, seconds)""")
def column_plan_table(s, d):
    rows = [(r, p.tier, p.columns, p.seconds) for r in (3600, 21600, 86400, 604800, 2592000, 31536000) for p in [plan(r, 1_700_000_000)]]
    return s.createDataFrame(rows, "range_s int, tier string, columns int, seconds int")


# ordered operators
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY us, seq)"
_COUNTER = "(value * 100)::BIGINT"


@query(f"""WITH {EV}, c AS (SELECT seq, user_id, us, {_COUNTER} AS c FROM ev), l AS (SELECT *, lag(c) OVER w AS p, (us - lag(us) OVER w) / 1000000 AS dt
    FROM c {_W}) SELECT seq, user_id, CASE WHEN c >= p AND dt > 0 THEN trunc((c - p) / dt)::BIGINT ELSE 0 END AS rate FROM l""")
def counter_rate_rebaseline(s, d):
    e = _ev(s, d).withColumn("c", F.round(F.col("value") * 100).cast("long"))
    return W.counter_rate(e, "user_id", "c").select("seq", "user_id", "rate")


@query(f"""WITH {EV}, c AS (SELECT seq, user_id, us, (seq * 2654435761) % 4294967296 AS c
    FROM ev) SELECT seq, user_id, (c - lag(c) OVER w + 4294967296) % 4294967296 AS delta FROM c {_W}""")
def counter_wrap(s, d):
    e = _ev(s, d).withColumn("c", F.col("seq") * F.lit(2654435761) % F.lit(1 << 32))
    return W.wrapped_delta(e, "user_id", "c").select("seq", "user_id", "delta")


@query("""SELECT event_id, CASE WHEN value * 1000000 > (CASE
    WHEN user_id % 2 > 0 THEN 1000 * 1e6 / 8 * 1.5 ELSE 12.5e9 END) * 1 OR value < 0 THEN 0 ELSE value * 1000000 END AS guarded FROM events""")
def outlier_guard(s, d):
    e = _t(s, d, "events").withColumn("delta", F.col("value") * 1000000)
    return W.outlier_guard(e, "delta", (F.col("user_id") % 2) * 1000, F.lit(1)).select("event_id", "guarded")


@query(f"""WITH {EV}, p AS (SELECT seq, user_id, us, coalesce(value * (us - lag(us) OVER w) / 3600000000, 0) AS p, us - min(us) OVER w AS since
    FROM ev {_W}),
  t AS (SELECT *, {sig("sum(p) OVER (PARTITION BY user_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING)")} AS watt_hours FROM p)
  SELECT seq, user_id, watt_hours, CASE WHEN since > 0 THEN {sig("watt_hours * 3600 / (since / 1000000)")} END AS average_watts FROM t""")
def energy_integral(s, d):
    return W.energy_integral(_ev(s, d), "user_id", "value").select("seq", "user_id", "watt_hours", "average_watts")


@query(f"""WITH {EV} SELECT seq, user_id, coalesce((value - lag(value) OVER w) / ((us - lag(us) OVER w) / 1000000) / (CASE seq % 5 WHEN 0 THEN 1e3::DOUBLE
    WHEN 1 THEN 1e6::DOUBLE WHEN 2 THEN 1e9::DOUBLE WHEN 3 THEN 1e12::DOUBLE END), 0) AS watts FROM ev {_W}""")
def energy_to_power(s, d):
    e = _ev(s, d).withColumn("unit", F.expr("element_at(array('mJ', 'uJ', 'nJ', 'pJ', '?'), cast(seq % 5 + 1 as int))"))
    return W.energy_to_power(e, "user_id", "value", "unit").select("seq", "user_id", "watts")


@query(f"""WITH {EV}, a AS (SELECT user_id, us, seq, abs(value - lag(value) OVER w) AS a FROM ev {_W}), l AS (SELECT user_id, list(a ORDER BY us, seq) AS l
    FROM a WHERE a IS NOT NULL GROUP BY 1) SELECT user_id, round(list_reduce(l, lambda j, x: j + (x - j) / 16), 6) AS jitter, len(l) AS steps FROM l""")
def ewma_jitter(s, d):
    return W.ewma_jitter(_ev(s, d), "user_id", "value")


@query(f"SELECT user_id, {sig('sum(value * (event_id % 10)) / sum(event_id % 10)')} AS mean FROM events GROUP BY 1")
def weighted_mean(s, d):
    e = _t(s, d, "events").withColumn("w", F.col("event_id") % 10)
    return e.groupBy("user_id").agg(T.significant(F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("mean"))


@query(f"""WITH {EV}, p AS (SELECT user_id, value, us, us - (seq % 200 + 1) * 1000000 AS st FROM ev),
    m AS (SELECT *, unnest(range(st // 60000000, (us - 1) // 60000000 + 1)) AS minute FROM p),
    x AS (SELECT user_id, minute, value, (least(us, (minute + 1) * 60000000) - greatest(st, minute * 60000000)) / 1000000 AS sec FROM m)
  SELECT user_id, minute, sum((value * sec)::DECIMAL(28,8))::DOUBLE / nullif(sum(sec::DECIMAL(28,8))::DOUBLE, 0) AS average, min(value) AS minimum, max(value) AS maximum, count(*) AS count, sum(sec::DECIMAL(28,8))::DOUBLE AS duration
    FROM x GROUP BY 1, 2""")
def duration_weighted_minutes(s, d):
    x = R.split_minutes(_ev(s, d), F.col("seq") % 200 + 1)
    x = x.select("user_id", "minute", F.col("value").alias("average"), F.col("value").alias("minimum"), F.col("value").alias("maximum"), F.lit(1).alias("count"), F.col("seconds").alias("duration"))
    return R.duration_weighted(x, "user_id", "minute").withColumn("count", F.col("count").cast("long"))


@query("SELECT event_id, '/field:k' AS path, (props->>'k')::DOUBLE AS number FROM events WHERE props->>'k' IS NOT NULL")
def json_flatten(s, d):
    e = _t(s, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return e.select("event_id", F.concat(F.lit("/field:"), F.replace(F.replace("k", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))).alias("path"), F.col("v").try_cast("double").alias("number")).where("number is not null")


@query(f"""WITH {EV}, m AS (SELECT seq, user_id, event_type, {sig("avg(value) OVER w")} AS m
    FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, seq ROWS BETWEEN 89 PRECEDING AND CURRENT ROW))
  SELECT seq, user_id, CASE WHEN event_type <> 'error' THEN floor(m * 100 + 0.5) / 100 END AS rolling FROM m""")
def rolling_mean_90(s, d):
    return W.rolling_mean(_ev(s, d), "user_id", "value", 90, F.col("event_type") != "error").select("seq", "user_id", "rolling")


@query(f"""WITH {EV}, b AS (SELECT user_id, value, us, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, seq DESC) AS b FROM ev),
    sp AS (SELECT DISTINCT user_id, unnest(range(1, 121)) AS slot FROM ev) SELECT sp.user_id, sp.slot::INT AS slot, us, value FROM sp
    LEFT JOIN b ON b.user_id = sp.user_id AND 121 - b.b = sp.slot""")
def ring_last_n(s, d):
    return W.ring(_ev(s, d).select("user_id", "us", "seq", "value"), "user_id", 120).select("user_id", "slot", "us", "value")


@query(f"""WITH {EV}, g AS (SELECT seq, user_id, us, (us - lag(us) OVER w) / 1000000 AS dd FROM ev {_W}),
    r AS (SELECT user_id, dd, row_number() OVER (PARTITION BY user_id ORDER BY dd) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM g WHERE dd > 0),
    t AS (SELECT user_id, dd AS t FROM r WHERE n >= 2 AND r = n // 2 + 1)
  SELECT seq, user_id, CASE WHEN dd >= 2 AND dd > 1.5 * t THEN least(round(dd / t) - 1, 119) ELSE 0 END::BIGINT AS empty_before FROM g
    LEFT JOIN t USING (user_id)""")
def gap_insertion(s, d):
    return W.gap_insertion(_ev(s, d), "user_id", 120).select("seq", "user_id", "empty_before")


@query(f"""WITH {EV}, e AS (SELECT seq, user_id, least(coalesce(lead(us) OVER w, {NOW}000000), us + 10000000) AS end_us FROM ev {_W})
  SELECT * FROM e WHERE end_us >= {NOW - 864000}000000""")
def sample_lifetime(s, d):
    """The last ten days of a chart whose samples live ten seconds."""
    return W.sample_lifetime(_ev(s, d), "user_id", 10, NOW * T.MICRO, 864_000).select("seq", "user_id", "end_us")


_ISLAND = """i AS (SELECT *, (lag(state) OVER w IS DISTINCT FROM state)::INT AS c FROM st WINDOW w AS (PARTITION BY user_id ORDER BY us, seq)),
    r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS run FROM i)"""


@query(f"""WITH {EV}, st AS (SELECT *, value > 20 AS state
    FROM ev), {_ISLAND} SELECT user_id, any_value(state) AS state, min(us) AS from_us, max(us) AS to_us, count(*) AS rows FROM r GROUP BY user_id, run""")
def empty_runs(s, d):
    return W.islands(_ev(s, d).withColumn("state", F.col("value") > 20), "user_id", "state")


@query(f"""WITH {EV}, sp AS (SELECT user_id, seq, us AS start_us, CASE WHEN seq % 3 > 0 THEN lead(us) OVER w ELSE us + 1 END AS end_us FROM ev {_W}),
    n AS (SELECT *, CASE WHEN lag(end_us) OVER v = start_us THEN 0 ELSE 1 END AS n FROM sp WHERE end_us IS NOT NULL
    WINDOW v AS (PARTITION BY user_id ORDER BY start_us, end_us)),
  r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS run
    FROM n) SELECT user_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS parts FROM r GROUP BY user_id, run""")
def coalesce_intervals(s, d):
    nxt = F.expr("lead(us) over (partition by user_id order by us, seq)")
    spans = _ev(s, d).select("user_id", F.col("us").alias("start_us"), F.when(F.col("seq") % 3 > 0, nxt).otherwise(F.col("us") + 1).alias("end_us")).where("end_us is not null")
    return W.coalesce_intervals(spans, "user_id")


@query(f"""WITH {EV}, p AS (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM ev {_W}) SELECT seq, user_id, event_type FROM p
    WHERE n = 1 OR p IS DISTINCT FROM event_type""")
def change_only(s, d):
    return W.change_only(_ev(s, d), "user_id", "event_type").select("seq", "user_id", "event_type")


@query(f"""WITH {EV} SELECT seq, user_id,
    {sig("sum(value) OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY us, seq ROWS UNBOUNDED PRECEDING)")} AS total FROM ev""")
def running_total_reset(s, d):
    return W.running_total(_ev(s, d), "user_id", "value", F.weekofyear("ts")).select("seq", "user_id", "total")


@query(f"""WITH {EV} SELECT seq, user_id, last_value(CASE
    WHEN value BETWEEN 10 AND 120 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS held FROM ev""")
def hold_previous(s, d):
    return W.hold_previous(_ev(s, d), "user_id", "value", 10, 120).select("seq", "user_id", "held")


@query(f"""WITH {EV}, st AS (SELECT *, value >= 50 AS state FROM ev), {_ISLAND},
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY us, seq) AS k FROM r WHERE state) SELECT seq, user_id, value FROM k WHERE k = 2""")
def alert_streak(s, d):
    return W.alert_streak(_ev(s, d), "user_id", "value", 50.0).select("seq", "user_id", "value")


@query(f"""WITH {EV}, i AS (SELECT seq, user_id, us, value, value <= 30 AS bad, (us - lag(us) OVER w) / 1000000 AS gap, lag(value <= 30) OVER w AS was
    FROM ev {_W}),
  g AS (SELECT *, last_value(CASE
    WHEN gap >= 0.5 THEN gap END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM i),
  c AS (SELECT *, (was IS DISTINCT FROM bad)::INT AS turned, (was IS DISTINCT
    FROM bad OR coalesce(before IS NOT NULL AND gap > greatest(5, before * 2.5), false))::INT AS fresh FROM g),
  r AS (SELECT *, sum(fresh) OVER w AS run, sum(turned) OVER w AS stretch FROM c
    WINDOW w AS (PARTITION BY user_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING)),
  t AS (SELECT *, min(us) OVER (PARTITION BY user_id, run) AS start FROM r WHERE bad),
  k AS (SELECT *, row_number() OVER (PARTITION BY user_id, stretch ORDER BY us, seq) AS k FROM t WHERE us - start >= 3600000000)
  SELECT seq, user_id, value FROM k WHERE k = 1""")
def alert_sustained(s, d):
    return W.alert_sustained(_ev(s, d), "user_id", "value", 30.0, 3600, less=True).select("seq", "user_id", "value")


@query(f"""WITH {EV}, st AS (SELECT *, value <= 20 AS state FROM ev), {_ISLAND},
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY us, seq) AS k FROM r WHERE state) SELECT seq, user_id, value FROM k WHERE k = 3""")
def alert_streak_less(s, d):
    return W.alert_streak(_ev(s, d), "user_id", "value", 20.0, 3, less=True).select("seq", "user_id", "value")


# relational
@query(f"WITH {EV} SELECT event_type, us // 3600000000 AS \"window\", arg_max(value, seq) AS value, count(*) AS merged FROM ev GROUP BY 1, 2")
def conflate_latest(s, d):
    return R.conflate(_ev(s, d), "event_type", "value", 3_600_000_000)


@query(f"SELECT user_id, {sig('sum(value)')} AS usage FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def topk_mem_grouped(s, d):
    return R.grouped_top(_t(s, d, "events"), "user_id", "value", 8)


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 8")
def topk_cpu(s, d):
    return _t(s, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(8)


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity, l_discount * 100 AS disc
    FROM lineitem ORDER BY greatest(l_quantity, l_discount * 100) DESC, least(l_quantity, l_discount * 100) DESC, id LIMIT 12""")
def topk_disk(s, d):
    x = _t(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", (F.col("l_discount") * 100).alias("disc"))
    return R.pair_top(x, "id", "l_quantity", "disc", 12)


@query(f"""WITH {EV}, l AS (SELECT user_id AS lane, max(us) AS last_us FROM ev GROUP BY 1) SELECT lane, last_us FROM l
    WHERE last_us <= {NOW}000000 - 86400000000 ORDER BY last_us, lane LIMIT 1""")
def lru_victim(s, d):
    lanes = _ev(s, d).groupBy(F.col("user_id").alias("lane")).agg(F.max("us").alias("last_us"))
    return R.lru_victim(lanes, NOW * T.MICRO, 86_400_000_000)


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 55), b AS (SELECT DISTINCT user_id FROM events
    WHERE event_type = 'error' AND value > 65)
  (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def symmetric_difference(s, d):
    e = _t(s, d, "events")
    return R.symmetric_difference(e.where("event_type = 'signup' and value > 55").select("user_id"), e.where("event_type = 'error' and value > 65").select("user_id"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""")
def anti_join_removed(s, d):
    gone = _t(s, d, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    return R.without(_t(s, d, "customer").select("c_custkey"), gone.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join_live(s, d):
    live = _t(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return R.only(_t(s, d, "customer").select("c_custkey"), live, "c_custkey")


@query("""WITH a AS (SELECT c_custkey AS k, c_name AS n, NULL AS v FROM customer), b AS (SELECT s_suppkey AS k, 'b' || s_name AS n, s_acctbal AS v
    FROM supplier),
  c AS (SELECT o_orderkey AS k, NULL AS n, o_totalprice AS v FROM orders)
  SELECT coalesce(a.k, b.k, c.k) AS k, coalesce(a.n, b.n, c.n) AS n, coalesce(a.v, b.v, c.v) AS v
    FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k""")
def full_outer_upsert(s, d):
    a = _t(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"), F.lit(None).cast("double").alias("v"))
    b = _t(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("b"), "s_name").alias("n"), F.col("s_acctbal").alias("v"))
    c = _t(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(None).cast("string").alias("n"), F.col("o_totalprice").alias("v"))
    return R.upsert([a, b, c], "k", ["n", "v"])


_RESOLVE = """t AS (SELECT p_partkey AS target_id, p_name AS a, p_brand || p_type AS b FROM part), it AS (SELECT p_partkey AS item_id, CASE
    WHEN p_retailprice > 1000 THEN p_name END AS a, p_brand || p_type AS b FROM part)"""


@query(f"""WITH {_RESOLVE}, ua AS (SELECT a, min(target_id) AS x FROM t WHERE a IS NOT NULL GROUP BY a HAVING count(*) = 1),
    ub AS (SELECT b, min(target_id) AS x FROM t WHERE b IS NOT NULL GROUP BY b HAVING count(*) = 1),
  m AS (SELECT item_id, coalesce(ua.x, ub.x) AS x, CASE WHEN ua.x IS NOT NULL THEN 0 WHEN ub.x IS NOT NULL THEN 1 END AS r FROM it
    LEFT JOIN ua USING (a) LEFT JOIN ub ON ub.b = it.b), k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY r, item_id) AS k
    FROM m) SELECT item_id, CASE WHEN x IS NOT NULL AND k = 1 THEN x END AS target_id FROM k""")
def entity_resolution(s, d):
    p = _t(s, d, "part").select("p_partkey", "p_retailprice", F.col("p_name").alias("a"), F.concat("p_brand", "p_type").alias("b"))
    items = p.select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_retailprice") > 1000, F.col("a")).alias("a"), "b")
    return R.resolve(items, p.withColumnRenamed("p_partkey", "target_id"), ["a", "b"])


@query("""SELECT s_suppkey, coalesce(g.n_name, 'ungrouped') AS grp
  FROM supplier LEFT JOIN (SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
    WHERE r_name LIKE 'A%') g ON s_nationkey = g.n_nationkey""")
def group_membership(s, d):
    """Members of groups that aren't there any more (nations of other regions) count as ungrouped; a group without members has no row."""
    n, r = _t(s, d, "nation"), _t(s, d, "region").where("r_name like 'A%'")
    groups = n.join(r, n["n_regionkey"] == r["r_regionkey"], "left_semi")
    return R.grouped(_t(s, d, "supplier"), groups, "s_nationkey", "n_nationkey", "n_name").select("s_suppkey", "grp")


@query("""WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_regionkey AS ord FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey FROM supplier),
  h AS (SELECT id, 0::BIGINT AS depth, [ord::BIGINT] AS path FROM n WHERE parent IS NULL
    UNION ALL SELECT n.id, h.depth + 1, list_append(h.path, n.ord::BIGINT) FROM n JOIN h ON n.parent = h.id)
  SELECT id, depth, array_to_string(path, '/') AS path FROM h""")
def hierarchy_dfs(s, d):
    r = _t(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("ord"))
    n = _t(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.col("n_nationkey").cast("long").alias("ord"))
    p = _t(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("parent"), F.col("s_suppkey").alias("ord"))
    return R.hierarchy(r.unionByName(n).unionByName(p)).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "/"))


@query("""WITH n AS (SELECT s_nationkey, count(*) FILTER (s_acctbal > 0) AS up, count(*) FILTER (s_acctbal < -300) AS down, count(*) AS total
    FROM supplier GROUP BY 1)
  SELECT *, CASE WHEN up = total THEN 'green' WHEN down = total THEN 'red' ELSE 'orange' END AS colour FROM n""")
def status_rollup(s, d):
    """Suppliers between -300 and 0 are neither up nor down."""
    return R.status_rollup(_t(s, d, "supplier"), "s_nationkey", F.col("s_acctbal") > 0, F.col("s_acctbal") < -300)


@query("""SELECT n_nationkey, row_number() OVER (ORDER BY CASE
    WHEN n_name < 'J' THEN 100 - n_nationkey ELSE 2147483647 END, lower(n_name), n_nationkey)::INT AS position FROM nation""")
def custom_order(s, d):
    n = _t(s, d, "nation")
    order = n.where("n_name < 'J'").select("n_nationkey", (100 - F.col("n_nationkey")).alias("idx"))
    return R.custom_order(n.select("n_nationkey", "n_name"), order, "n_nationkey", "n_name").select("n_nationkey", "position")


@query("""WITH c AS (SELECT user_id, floor(value / 25)::BIGINT AS code, count(*) AS n FROM events
    GROUP BY 1, 2) SELECT user_id, code, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, code) AS k FROM c) WHERE k = 1""")
def mode_tiebreak(s, d):
    return R.mode(_t(s, d, "events").select("user_id", F.floor(F.col("value") / 25).cast("long").alias("code")), "user_id", "code")


# scalars
@query("""SELECT event_id, CASE WHEN v < 1e3 THEN '0 KB/s' WHEN v < 1e6 THEN printf('%.0f KB/s', v / 1e3)
    WHEN v < 1e8 THEN printf('%.1f MB/s', v / 1e6) WHEN v < 1e9 THEN printf('%.0f MB/s', v / 1e6)
    WHEN v < 1e12 THEN printf('%.1f GB/s', v / 1e9) ELSE printf('%.1f TB/s', v / 1e12) END AS speed,
  CASE WHEN b < 1e3 THEN '0 Kb/s' WHEN b < 1e6 THEN printf('%.0f Kb/s', b / 1e3) WHEN b < 1e8 THEN printf('%.1f Mb/s', b / 1e6) WHEN b < 1e9 THEN printf('%.0f Mb/s', b / 1e6)
    WHEN b < 1e12 THEN printf('%.1f Gb/s', b / 1e9) ELSE printf('%.1f Tb/s', b / 1e12) END AS bits, printf('%.2f M', v / 1e6) || 'B/s' AS fixed
  FROM (SELECT event_id, v, v * 8 AS b FROM (SELECT event_id, floor(value * pow(10, event_id % 11)) - 5 AS v FROM events))""")
def units_speed(s, d):
    v = F.floor(F.col("value") * F.pow(F.lit(10.0), F.col("event_id") % 11)).cast("double") - 5
    return _t(s, d, "events").select("event_id", S.speed(v).alias("speed"), S.speed(v, "bit").alias("bits"), S.speed(v, unit="MB").alias("fixed"))


@query("""WITH t AS (SELECT event_id, s, trunc(s / 3600)::BIGINT AS h, trunc((s % 3600) / 60)::BIGINT AS m FROM (SELECT event_id, event_id * 7 - 2000 AS s
    FROM events)),
  x AS (SELECT *, CASE WHEN m > 9 THEN '' ELSE '0' END || m AS mm, s = 0 OR h < 0 OR m < 0 AS none FROM t)
  SELECT event_id, CASE WHEN none THEN 'n/a' WHEN h = 0 THEN mm || 'min' WHEN m = 0 THEN h || 'h' ELSE h || 'h ' || mm || 'min' END AS text, CASE
    WHEN none THEN 'n/a' ELSE h || ':' || mm END AS short FROM x""")
def duration_text(s, d):
    v = F.col("event_id") * 7 - 2000
    return _t(s, d, "events").select("event_id", S.duration_text(v).alias("text"), S.duration_text(v, short=True).alias("short"))


@query("""WITH l AS (SELECT p_partkey, p_partkey || '  ' || p_name || '  ' || (p_size * 40) || ['K','M','G'][p_partkey % 3 + 1] AS line, (p_size * 40)::VARCHAR AS sz, p_partkey % 3 AS u, p_name
    FROM part) SELECT p_partkey AS pid, trim(p_name) AS name, CASE WHEN u = 2 THEN sz::DOUBLE * 1024 WHEN u = 0 THEN sz::DOUBLE / 1024
    WHEN length(sz) = 4 THEN sz::DOUBLE / 1024 * 1000 ELSE sz::DOUBLE END * 1e6 AS bytes FROM l""")
def parse_top_line(s, d):
    line = F.concat(F.col("p_partkey").cast("string"), F.lit("  "), "p_name", F.lit("  "), (F.col("p_size") * 40).cast("string"), F.expr("element_at(array('K','M','G'), cast(p_partkey % 3 + 1 as int))"))
    return _t(s, d, "part").select(*[c.alias(n) for n, c in S.top_line(line).items()])


def _version_sql(k: str) -> str:
    """major, minor, patch, fork and beta that _version() spells."""
    return f"p_size % 3 AS major{k}, ({k} // 2) % 4 AS minor{k}, p_size % 5 AS patch{k}, CASE WHEN {k} % 3 = 1 THEN {k} % 7 ELSE 0 END AS fork{k}, CASE WHEN {k} % 3 = 2 THEN {k} % 4 END AS beta{k}"


def _version(k: Column) -> Column:
    tail = F.when(k % 3 == 1, F.concat(F.lit("."), (k % 7).cast("string"))).when(k % 3 == 2, F.concat(F.lit("-beta"), (k % 4).cast("string"))).otherwise("")
    return F.concat(F.when(k % 2 == 0, "v").otherwise(""), F.concat_ws(".", F.col("p_size") % 3, F.floor(k / 2) % 4, F.col("p_size") % 5), tail)


@query(f"""WITH k AS (SELECT p_partkey, p_size, p_partkey AS a, p_partkey * 7 + p_size AS b FROM part),
    v AS (SELECT p_partkey, {_version_sql("a")}, {_version_sql("b")} FROM k),
  j AS (SELECT *, majorb > majora AS m1, minorb > minora AND majorb >= majora AS m2, patchb > patcha AND minorb >= minora AND majorb >= majora AS m3,
               patchb >= patcha AND minorb >= minora AND majorb >= majora AS m4 FROM v)
  SELECT p_partkey, CASE WHEN betaa IS NULL AND betab IS NULL THEN m1 OR m2 OR m3 OR (forkb > forka AND m4)
    WHEN betaa IS NULL THEN false ELSE m1 OR m2 OR m4 END AS newer FROM j""")
def version_compare(s, d):
    k = F.col("p_partkey")
    return _t(s, d, "part").select("p_partkey", S.is_newer(_version(k), _version(k * 7 + F.col("p_size"))).alias("newer"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 100 WHEN 1 THEN p_size * 1000 ELSE 0 END::BIGINT AS mbit FROM part")
def media_rate(s, d):
    text = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(p_size * 100, 'Base-T') WHEN 1 THEN concat(p_size, 'GbaseT') ELSE 'none' END")
    return _t(s, d, "part").select("p_partkey", S.media_mbit(text).alias("mbit"))


@query("""WITH x AS (SELECT p_partkey, p_partkey % 8 AS k, (p_size - 1) % 256 AS hi, p_partkey % 256 AS lo FROM part)
  SELECT p_partkey, CASE WHEN hi = 0 AND lo = 0 THEN NULL WHEN k = 0 THEN hi * 256 + lo WHEN k = 1 THEN (hi * 256 + lo) / 256
    WHEN k = 2 THEN hi * 64 + lo // 4 WHEN k = 3 THEN hi
    WHEN k = 4 THEN (hi * 256 + lo) / 16384 WHEN k = 5 THEN (hi * 256 + lo) * 65536 WHEN k = 6 THEN (hi * 256 + lo) / 32 END::DOUBLE AS value FROM x""")
def smc_decode(s, d):
    kind = F.expr("element_at(array('ui16', 'sp78', 'fpe2', 'ui8', 'sp1e', 'ui32', 'spa5', '????'), cast(p_partkey % 8 + 1 as int))")
    raw = F.concat(F.lpad(F.hex((F.col("p_size") - 1) % 256), 2, "0"), F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0"))
    return _t(s, d, "part").select("p_partkey", S.smc_decode(kind, F.when(kind == "ui32", F.concat(raw, F.lit("0000"))).otherwise(raw)).alias("value"))


@query("""WITH v AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN -value / 1000 ELSE floor(value / 100) * 0 END AS v FROM events),
  n AS (SELECT event_id, v, pow(10, floor(log10(abs(v)))) AS p, round(abs(v) / pow(10, floor(log10(abs(v)))), 12) AS x FROM v WHERE v <> 0),
  o AS (SELECT event_id, v, p, CASE WHEN x <= 1 THEN 1 WHEN x <= 2 THEN 2 WHEN x <= 2.5 THEN 2.5 WHEN x <= 5 THEN 5 ELSE 10 END::DOUBLE AS up,
               CASE WHEN x >= 10 THEN 10 WHEN x >= 5 THEN 5 WHEN x >= 2.5 THEN 2.5 WHEN x >= 2 THEN 2 ELSE 1 END::DOUBLE AS down FROM n)
  SELECT event_id, sign(v) * CASE WHEN v > 0 THEN up ELSE down END * p AS upper, sign(v) * CASE WHEN v < 0 THEN up ELSE down END * p AS lower FROM o
  UNION ALL SELECT event_id, 0, 0 FROM v WHERE v = 0""")
def axis_scale(s, d):
    v = F.expr("CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN -value / 1000 ELSE 0D END")
    return _t(s, d, "events").select("event_id", S.nice_bound(v).alias("upper"), S.nice_bound(v, up=False).alias("lower"))


@query("SELECT event_id, value * 9 / 5 + 32 AS fahrenheit FROM events")
def temperature(s, d):
    return _t(s, d, "events").select("event_id", S.fahrenheit(F.col("value")).alias("fahrenheit"))


@query("SELECT event_id, CASE WHEN value / 100 < 0.6 THEN 'normal' WHEN value / 100 < 0.8 THEN 'warning' ELSE 'critical' END AS band FROM events")
def bands(s, d):
    return _t(s, d, "events").select("event_id", S.band(F.col("value") / 100).alias("band"))


@query("SELECT event_id, CASE WHEN value / 200 < 0.2 THEN 'critical' WHEN value / 200 < 0.4 THEN 'warning' ELSE 'normal' END AS band FROM events")
def battery_bands(s, d):
    return _t(s, d, "events").select("event_id", S.battery_band(F.col("value") / 200).alias("band"))


@query(f"""WITH {EV}, {_FOLD}, done AS (SELECT lane, max(bucket) AS done FROM fold GROUP BY 1)
    SELECT fold.* FROM fold JOIN done USING (lane) WHERE bucket >= done OR bucket >= {(NOW - 86400 * 4) // 1800}""")
def catchup_rebuild(s, d):
    """All is rolled up to the newest bucket; the last four days are made again."""
    fine = _fold(s, d, 120)
    done = fine.groupBy("lane").agg(F.floor(F.max("bucket") / 15).cast("long").alias("done"))
    return T.catch_up(fine, done, 15, (NOW - 86400 * 4) // 120)


@query("""SELECT event_id, list_filter([CASE WHEN event_id & 1 > 0 THEN 'spare' END, CASE WHEN event_id & 2 > 0 THEN 'temperature' END, CASE
    WHEN event_id & 4 > 0 THEN 'reliability' END], lambda x: x IS NOT NULL).array_to_string(',') AS flags FROM events""")
def bitmask(s, d):
    return _t(s, d, "events").select("event_id", S.flag_names(F.col("event_id"), ["spare", "temperature", "reliability"]).alias("flags"))


@query("SELECT p_partkey, replace(replace(replace(p_type || ',$%', '%', '%25'), ',', '%2C'), '$', '%24') AS field FROM part")
def escape_codec(s, d):
    return _t(s, d, "part").select("p_partkey", S.escape_field(F.concat("p_type", F.lit(",$%"))).alias("field"))


@query("""SELECT event_id, 'history@v2@' || base64(encode(event_type)) || '@' || lpad((event_id::HUGEINT - 500 + 9223372036854775808)::VARCHAR, 20, '0') AS key
    FROM events""")
def keyed_store_codec(s, d):
    return _t(s, d, "events").select("event_id", S.bucket_key(F.col("event_type"), F.col("event_id") - 500).alias("key"))


@query("""SELECT event_id, date_trunc('day', ts) + INTERVAL 1 DAY AS next_day, date_trunc('week', ts) + INTERVAL 7 DAY AS next_week, date_trunc('month', ts) + INTERVAL 1 MONTH AS next_month
    FROM events""")
def local_boundaries(s, d):
    return _t(s, d, "events").select("event_id", *[F.expr(f"cast(date_trunc('{u}', ts) + INTERVAL {n} as timestamp_ntz) AS next_{u}") for u, n in (("day", "1 DAY"), ("week", "7 DAY"), ("month", "1 MONTH"))])


# streaming
def _stream(s: SparkSession, d: str) -> DataFrame:
    schema = s.read.parquet(f"{d}/events.parquet").schema
    e = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)  # a streaming source reads a folder
    return e.select(F.col("user_id").cast("string").alias("lane"), F.col("ts").cast("timestamp").alias("ts"), "value")


def _drained(s: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    import uuid

    from .sources.shared import shared_folder
    from .streaming.folds import drain

    return drain(stream, name, f"{shared_folder(s)}/stream-{uuid.uuid4().hex}")
