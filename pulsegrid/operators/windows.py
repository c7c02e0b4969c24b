"""Ordered operators by key: counters, rings, runs, alerts. `order` columns make a total order in each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_away, whole
from .series import significant

MICRO = 1_000_000


def _by(key: str, *order: str) -> Window:
    return Window.partitionBy(key).orderBy(*order)


def counter_rate(rows: DataFrame, key: str, counter: str) -> DataFrame:
    """Rate of a counter in whole units a second, at most the largest 64-bit integer; a first value, a step back or no time gives 0 and a new base."""
    w = _by(key, "us", "seq")
    dt, back = (F.col("us") - F.lag("us").over(w)) / MICRO, F.lag(counter).over(w)
    return rows.withColumn("rate", F.when((F.col(counter) >= back) & (dt > 0), whole((F.col(counter) - back).cast("double") / dt)).otherwise(F.lit(0)).cast("long"))


def wrapped_delta(rows: DataFrame, key: str, counter: str, bits: int = 32) -> DataFrame:
    """Difference of a counter of so many bits that starts again at 0; NULL for the first."""
    step = F.col(counter) - F.lag(counter).over(_by(key, "us", "seq"))
    return rows.withColumn("delta", F.pmod(step, F.lit(1 << bits)))


def outlier_guard(rows: DataFrame, delta: str, link_mbit: Column, interval_s: Column) -> DataFrame:
    """More than half again of what the link can carry (12.5e9 bytes a second where it is unknown) counts as 0; so does less than 0."""
    cap = F.when(link_mbit > 0, link_mbit * 1e6 / 8 * 1.5).otherwise(F.lit(12.5e9)) * interval_s
    return rows.withColumn("guarded", F.when((F.col(delta) > cap) | (F.col(delta) < 0), 0.0).otherwise(F.col(delta)))


def energy_integral(rows: DataFrame, key: str, watts: str) -> DataFrame:
    """Running watt-hours (each positive value over the time since the one before) and average_watts since the key's first row (NULL in that)."""
    w = _by(key, "us", "seq")
    part = F.coalesce(F.when(F.col(watts) > 0, F.col(watts) * (F.col("us") - F.lag("us").over(w)) / (3600 * MICRO)), F.lit(0.0))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("__part", part).withColumn("watt_hours", significant(F.sum("__part").over(so_far)))
    since = (F.col("us") - F.min("us").over(so_far)) / MICRO
    return summed.withColumn("average_watts", F.when(since > 0, significant(F.col("watt_hours") * 3600 / since))).drop("__part")


def energy_to_power(rows: DataFrame, key: str, energy: str, unit: str) -> DataFrame:
    """Power from an energy counter in mJ, uJ, nJ or pJ (else 0)."""
    w = _by(key, "us", "seq")
    scale = F.when(F.col(unit) == "mJ", 1e3).when(F.col(unit) == "uJ", 1e6).when(F.col(unit) == "nJ", 1e9).when(F.col(unit) == "pJ", 1e12)
    return rows.withColumn("watts", F.coalesce((F.col(energy) - F.lag(energy).over(w)) / ((F.col("us") - F.lag("us").over(w)) / MICRO) / scale, F.lit(0.0)))


def running_total(rows: DataFrame, key: str, value: str, epoch: Column) -> DataFrame:
    """Running sum that starts again with each epoch (a day, a month)."""
    w = Window.partitionBy(key, epoch).orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", significant(F.sum(value).over(w)))


def hold_previous(rows: DataFrame, key: str, value: str, low: float, high: float) -> DataFrame:
    """Values outside [low, high] give way to the last one inside."""
    good = F.when(F.col(value).between(low, high), F.col(value))
    return rows.withColumn("held", F.last(good, ignorenulls=True).over(_by(key, "us", "seq").rowsBetween(Window.unboundedPreceding, 0)))


def rolling_mean(rows: DataFrame, key: str, value: str, n: int, shown: Column | None = None) -> DataFrame:
    """Mean of the last n values with two places; NULL in rows where `shown` is false (a host that is down keeps counting and shows nothing)."""
    w = _by(key, "us", "seq").rowsBetween(1 - n, 0)
    return rows.withColumn("rolling", F.when(shown if shown is not None else F.lit(True), half_away(significant(F.avg(value).over(w)), 2)))


def ring(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The newest n rows of each key, by position from the back; NULL in front where there are fewer."""
    back = rows.withColumn("__back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("us"), F.desc("seq")))).where(F.col("__back") <= n)
    spine = rows.select(key).distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return spine.join(back.withColumn("slot", n + 1 - F.col("__back")).drop("__back"), [key, "slot"], "left")


def gap_insertion(rows: DataFrame, key: str, n: int, typical_s: Column | None = None) -> DataFrame:
    """Rows, and how many empty ones belong before each: none for a short gap, else round(gap / typical) - 1, below n. typical: by default
    the upper median of the key's positive steps (two at least)."""
    w = _by(key, "us", "seq")
    step = rows.withColumn("__d", (F.col("us") - F.lag("us").over(w)) / MICRO)
    if typical_s is None:  # the steps of a key, by rank, without a list of them in one row
        ranked = step.where("__d > 0").withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("__d"))).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
        typical = ranked.where((F.col("__n") >= 2) & (F.col("__r") == F.expr("__n div 2 + 1"))).select(key, F.col("__d").alias("__typical"))
        step = step.join(typical, key, "left")
    else:
        step = step.withColumn("__typical", typical_s)
    long = (F.col("__d") >= 2) & (F.col("__d") > 1.5 * F.col("__typical"))
    return step.withColumn("empty_before", F.when(long, F.least(F.round(F.col("__d") / F.col("__typical")) - 1, F.lit(n - 1))).otherwise(0).cast("long")).drop("__d", "__typical")


def sample_lifetime(rows: DataFrame, key: str, seconds: int, now_us: int, horizon_s: int | None = None) -> DataFrame:
    """end_us: when the next sample comes, `seconds` later at most; now for the last. Samples after now are left out, and those that ended before the horizon."""
    rows = rows.where(F.col("us") <= now_us)
    nxt = F.coalesce(F.lead("us").over(_by(key, "us", "seq")), F.lit(now_us))
    ended = rows.withColumn("end_us", F.least(nxt, F.col("us") + seconds * MICRO).cast("long"))
    return ended if horizon_s is None else ended.where(F.col("end_us") >= now_us - horizon_s * MICRO)


def islands(rows: DataFrame, key: str, state: str) -> DataFrame:
    """Runs of equal state: key, state, from_us, to_us, rows."""
    w = _by(key, "us", "seq")
    change = (~F.lag(state).over(w).eqNullSafe(F.col(state))).cast("long")
    run = rows.withColumn("__c", change).withColumn("__run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key, "__run").agg(F.first(state).alias(state), F.min("us").alias("from_us"), F.max("us").alias("to_us"), F.count(F.lit(1)).alias("rows")).drop("__run")


def coalesce_intervals(spans: DataFrame, key: str) -> DataFrame:
    """Intervals (start_us, end_us) that touch become one."""
    w = Window.partitionBy(key).orderBy("start_us", "end_us")
    new = (~F.coalesce(F.lag("end_us").over(w) == F.col("start_us"), F.lit(False))).cast("long")
    run = spans.withColumn("__n", new).withColumn("__run", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key, "__run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count(F.lit(1)).alias("parts")).drop("__run")


def change_only(rows: DataFrame, key: str, value: str) -> DataFrame:
    w = _by(key, "us", "seq")
    return rows.withColumn("__p", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | ~F.col("__p").eqNullSafe(F.col(value))).drop("__p", "__n")


def alert_streak(rows: DataFrame, key: str, value: str, threshold: float, streak: int = 2, less: bool = False) -> DataFrame:
    """The sample at which `streak` samples in a row are at or over the threshold (less: at or under it); once for each run of them."""
    runs = rows.withColumn("__bad", F.col(value) <= threshold if less else F.col(value) >= threshold)
    w = _by(key, "us", "seq")
    change = (~F.lag("__bad").over(w).eqNullSafe(F.col("__bad"))).cast("long")
    runs = runs.withColumn("__c", change).withColumn("__run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("__bad").withColumn("__i", F.row_number().over(Window.partitionBy(key, "__run").orderBy("us", "seq"))).where(F.col("__i") == streak).drop("__bad", "__c", "__run", "__i")


def alert_sustained(rows: DataFrame, key: str, value: str, threshold: Column | float, duration_s: float, floor_s: float = 5, tolerance: float = 2.5, least_s: float = 0.5, less: bool = False) -> DataFrame:
    """The first sample, in each stretch at or over (less: at or under) the threshold, that lies duration_s after the start of its run.

    A run starts anew when the value comes back, when the threshold changes, and at an interruption: a gap beyond floor_s and `tolerance` times the
    last gap of least_s or more before it. Only a value that comes back ends the stretch, and so makes way for another alert.
    """
    w = _by(key, "us", "seq")
    rows = rows.withColumn("__level", F.lit(threshold) if not isinstance(threshold, Column) else threshold)
    rows = rows.withColumn("__bad", F.col(value) <= F.col("__level") if less else F.col(value) >= F.col("__level"))
    gap = (F.col("us") - F.lag("us").over(w)) / MICRO
    rows = rows.withColumn("__gap", gap)
    before = F.last(F.when(F.col("__gap") >= least_s, F.col("__gap")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    broken = (F.col("__gap") < 0) | F.coalesce(F.col("__gap") > F.greatest(F.lit(float(floor_s)), before * tolerance), F.lit(False)) & before.isNotNull()
    turned = ~F.lag("__bad").over(w).eqNullSafe(F.col("__bad"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    fresh = turned | (~F.lag("__level").over(w).eqNullSafe(F.col("__level"))) | broken
    runs = rows.withColumn("__c", F.coalesce(fresh, F.lit(True)).cast("long")).withColumn("__t", turned.cast("long"))
    runs = runs.withColumn("__run", F.sum("__c").over(so_far)).withColumn("__stretch", F.sum("__t").over(so_far)).where("__bad")
    start = F.min("us").over(Window.partitionBy(key, "__run"))
    due = runs.withColumn("__start", start).where((F.col("us") - F.col("__start")) >= duration_s * MICRO)
    first = due.withColumn("__i", F.row_number().over(Window.partitionBy(key, "__stretch").orderBy("us", "seq"))).where("__i = 1")
    return first.drop("__bad", "__level", "__gap", "__c", "__t", "__run", "__stretch", "__i", "__start")


def ewma_jitter(rows: DataFrame, key: str, value: str, share: float = 1 / 16) -> DataFrame:
    """key, jitter: J moves by `share` of (|step| - J) with each sample; the first step sets it. The fold in closed form."""
    w = _by(key, "us", "seq")
    # in closed form: J_n = sum of weights times |step|, with weights that fade by (1 - share) a step, summed from the newest back
    step = rows.withColumn("__a", F.abs(F.col(value) - F.lag(value).over(w))).where("__a is not null")
    back = step.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("us"), F.desc("seq"))) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    weight = F.when(F.col("__k") == F.col("__n") - 1, F.pow(F.lit(1 - share), F.col("__k"))).otherwise(share * F.pow(F.lit(1 - share), F.col("__k")))
    return back.groupBy(key).agg(F.round(F.sum(F.col("__a") * weight), 6).alias("jitter"), F.count(F.lit(1)).alias("steps"))


def clock_steps(rows: DataFrame, key: str, wall_us: str, mono_us: str, tolerance_s: float = 2.0) -> DataFrame:
    """Readings where the wall clock went otherwise than the steady clock by more than the tolerance; step_us: by how much."""
    w = _by(key, "seq")
    step = (F.col(wall_us) - F.lag(wall_us).over(w)) - (F.col(mono_us) - F.lag(mono_us).over(w))
    return rows.withColumn("step_us", step).where(F.abs("step_us") > tolerance_s * MICRO)


def session_spans(rows: DataFrame, key: str, opens: Column, closes: Column) -> DataFrame:
    """from_us, to_us: from an opening event to the next closing one; a second opening is ignored, and what ends in the second it began is dropped."""
    kind = F.when(opens, F.lit(1)).when(closes, F.lit(0))
    edges = change_only(rows.withColumn("__kind", kind).where("__kind is not null"), key, "__kind")
    w = _by(key, "us", "seq")
    paired = edges.withColumn("to_us", F.lead("us").over(w)).where("__kind = 1 and to_us is not null")
    return paired.where(F.expr("us div 1000000 < to_us div 1000000")).select(key, F.col("us").alias("from_us"), "to_us")


def counter_ratio(rows: DataFrame, key: str, parts: list[str], busy: list[str], bits: int = 32) -> DataFrame:
    """share_<part> of each counter's step in the steps of all, and usage, the sum of the busy ones; from counters that start again at 0.

    A step without any ticks keeps the shares before it; the first row of a key has none.
    """
    w = _by(key, "us", "seq")
    stepped = rows
    for p in parts:
        stepped = stepped.withColumn(f"__{p}", F.pmod(F.col(p) - F.lag(p).over(w), F.lit(1 << bits)))
    ticks = sum((F.col(f"__{p}") for p in parts[1:]), F.col(f"__{parts[0]}"))
    stepped = stepped.withColumn("__ticks", ticks)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    for p in parts:
        share = F.when(F.col("__ticks") > 0, F.col(f"__{p}") / F.col("__ticks"))
        stepped = stepped.withColumn(f"share_{p}", F.last(share, ignorenulls=True).over(so_far))
    usage = sum((F.col(f"share_{p}") for p in busy[1:]), F.col(f"share_{busy[0]}"))
    return stepped.withColumn("usage", usage).drop("__ticks", *[f"__{p}" for p in parts])


def frame_rate(rows: DataFrame, key: str, counter: str) -> DataFrame:
    """fps: steps of a frame counter a second; NULL for a first value, a step back or no time."""
    w = _by(key, "us", "seq")
    step, dt = F.col(counter) - F.lag(counter).over(w), (F.col("us") - F.lag("us").over(w)) / MICRO
    return rows.withColumn("fps", F.when((step >= 0) & (dt > 0), step / dt))


def step_per_row(rows: DataFrame, key: str, counter: str) -> DataFrame:
    """step: difference to the value before, none below 0; a value before of 0 is no base (the counter itself is the step), nor is a key's first row."""
    before = F.lag(counter).over(_by(key, "us", "seq"))
    step = F.when(F.coalesce(before, F.lit(0)) == 0, F.col(counter)).otherwise(F.col(counter) - before)
    return rows.withColumn("step", F.when(before.isNull(), F.lit(0)).otherwise(F.greatest(step, F.lit(0))))


def unchanged_key(rows: DataFrame, key: str, state: str) -> DataFrame:
    """Rows whose state is that of the row before: the first row after a change (and of a key) is left out, as its difference spans two sources."""
    before = F.lag(state).over(_by(key, "us", "seq"))
    return rows.withColumn("__b", before).where(F.col("__b") == F.col(state)).drop("__b")


def accepted_for_minutes(rows: DataFrame, key: str, wall_us: str, uptime_us: str, interval_s: float) -> DataFrame:
    """Rows with elapsed_s, the uptime since the row before, where that is above 0, at most three intervals, and agrees with the wall clock to less than an interval (a second at least)."""
    w = _by(key, "seq")
    elapsed = (F.col(uptime_us) - F.lag(uptime_us).over(w)) / MICRO
    wall = (F.col(wall_us) - F.lag(wall_us).over(w)) / MICRO
    timed = rows.withColumn("elapsed_s", elapsed).withColumn("__wall", wall)
    good = (F.col("elapsed_s") > 0) & (F.col("elapsed_s") <= 3 * interval_s) & (F.abs(F.col("__wall") - F.col("elapsed_s")) < max(interval_s, 1))
    return timed.where(good).drop("__wall")


def run_bases(rows: DataFrame, key: str, counter: str, run: str) -> DataFrame:
    """step: difference to the value before in the same run of the reader; a pause or sleep begins a new run, whose first row has none."""
    w = Window.partitionBy(key, run).orderBy("us", "seq")
    return rows.withColumn("step", F.col(counter) - F.lag(counter).over(w))


def throttled(rows: DataFrame, key: str, seconds: float) -> DataFrame:
    """key, us, seq of the rows that a writer lets through which writes a key again only `seconds` after its last write.

    Each write depends on the one before: a key's times come sorted, in Arrow batches, to one task that keeps one number a key.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, due = object(), 0
        for batch in batches:
            keep, us = np.zeros(batch.num_rows, bool), batch.column(1).to_numpy()
            for i, k in enumerate(batch.column(0).to_pylist()):
                if k != now or us[i] >= due:
                    now, due, keep[i] = k, us[i] + seconds * MICRO, True
            yield batch.filter(pa.array(keep))

    narrow = rows.select(key, F.col("us").cast("long").alias("us"), F.col("seq").cast("long").alias("seq"))
    return narrow.repartition(key).sortWithinPartitions(key, "us", "seq").mapInArrow(walk, narrow.schema)


def confirmed_changes(rows: DataFrame, key: str, value: str, times: int) -> DataFrame:
    """key, us, seq, before, after: a change is told once a value other than the known one has been seen `times` times since the known one was last seen.

    The known value is that of a key's first row, then the one of the last change told. NULL values are not looked at.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    kind = rows.schema[value].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, seen = object(), None, 0
        for batch in batches:
            out: list[tuple] = []
            for k, us, seq, v in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != now:
                    now, known, seen = k, v, 0
                elif v == known:
                    seen = 0
                else:
                    seen += 1
                    if seen >= times:
                        out.append((k, us, seq, known, v))
                        known, seen = v, 0
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [batch.schema.field(i).type for i in (0, 1, 2, 3, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "us", "seq", "before", "after"])

    narrow = rows.where(F.col(value).isNotNull()).select(key, F.col("us").cast("long").alias("us"), F.col("seq").cast("long").alias("seq"), value)
    told = narrow.repartition(key).sortWithinPartitions(key, "us", "seq").mapInArrow(walk, f"key {narrow.schema[key].dataType.simpleString()}, us long, seq long, before {kind}, after {kind}")
    return told.withColumnRenamed("key", key)


def conflate_from_first(rows: DataFrame, key: str, value: str, seconds: float) -> DataFrame:
    """key, opened_us, value (the last), merged of windows that each open with the first row that waits and close `seconds` later."""
    opened = throttled(rows, key, seconds).select(key, F.col("us").alias("us"), "seq").withColumn("__open", F.col("us"))
    marked = rows.join(opened, [key, "us", "seq"], "left")
    window = F.last("__open", ignorenulls=True).over(_by(key, "us", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("opened_us", window).groupBy(key, "opened_us").agg(F.max_by(value, F.struct("us", "seq")).alias(value), F.count(F.lit(1)).alias("merged"))
