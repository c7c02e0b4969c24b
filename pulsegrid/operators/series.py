"""Samples to slots to columns. Samples: lane, us (microseconds since 1970), value, and where needed interval_s and a tie-break.

Everything here is grouped aggregation, equi-joins and windows by lane; nothing is collected. Sums are of doubles, given with DIGITS significant digits, so
that the order in which partitions arrive doesn't show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CLOCK_STEP, ASLEEP, HELD, HOLD_SECONDS, MAX_COUNT, MEASURED, NODATA, NOT_RUNNING, SPAN_BUCKETS
from ..plans.columns import ColumnPlan

MICRO = 1_000_000


def micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', {ts})")


def accepted(samples: DataFrame, value: str = "value") -> DataFrame:
    """Finite as double and as float, at a time after 1970."""
    v = F.col(value)
    return samples.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("float")) < float("inf")) & (F.col("us") > 0))


def bucket(us: Column | str, step: int) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    return F.when(us > 0, F.floor(us / (step * MICRO))).otherwise(0).cast("long")


DIGITS = 12


def significant(value: Column) -> Column:
    """value with DIGITS significant digits."""
    return F.when(value.isNotNull(), F.format_string(f"%.{DIGITS - 1}e", value)).cast("double")


def total(value: Column | str) -> Column:
    return significant(F.sum(value))


def _frozen(slots: DataFrame, rows: DataFrame, order: tuple[str, ...], most: int) -> DataFrame:
    """slots(lane, bucket, count, min, max, sum) of rows(lane, bucket, value): counts stop at `most`, and sums with them, after the first so many in `order`.

    Only rows of buckets over `most` are ordered; the list of those buckets has a row for each `most` rows of input at most.
    """
    over = slots.where(F.col("count") > most).select("lane", "bucket")
    place = F.row_number().over(Window.partitionBy("lane", "bucket").orderBy(*order))
    first = rows.join(F.broadcast(over), ["lane", "bucket"], "left_semi").withColumn("__place", place).where(F.col("__place") <= most)
    sums = first.groupBy("lane", "bucket").agg(total("value").alias("__frozen"))
    out = slots.join(sums, ["lane", "bucket"], "left").withColumn("sum", F.coalesce("__frozen", "sum"))
    return out.withColumn("count", F.least("count", F.lit(most)).cast("long")).drop("__frozen")


def fold(samples: DataFrame, step: int, order: tuple[str, ...] = ("us",), most: int = MAX_COUNT) -> DataFrame:
    """lane, bucket, count, min, max, sum. From `most` samples of a bucket on (in order), count and sum stand still and min and max go on."""
    rows = accepted(samples).withColumn("bucket", bucket("us", step))
    slots = rows.groupBy("lane", "bucket").agg(F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), total("value").alias("sum"))
    return _frozen(slots, rows, order, most).select("lane", "bucket", "count", "min", "max", "sum")


def rollup(slots: DataFrame, factor: int) -> DataFrame:
    """Coarser slots from fine ones; reason measured over held over the first gap reason, where the slots have reasons."""
    reasons = []
    if "reason" in slots.columns:
        data = F.col("count") > 0
        reasons = [
            F.when(F.max(F.when(data & (F.col("reason") == MEASURED), 1)) == 1, MEASURED)
            .when(F.max(F.when(data & (F.col("reason") == HELD), 1)) == 1, HELD)
            .otherwise(F.coalesce(F.min_by(F.when(F.col("reason") != MEASURED, F.col("reason")), F.when((F.col("reason") != MEASURED) & (F.col("reason") != NODATA), F.col("bucket"))), F.lit(NODATA)))
            .cast("long")
            .alias("reason")
        ]
    return slots.groupBy("lane", F.floor(F.col("bucket") / factor).cast("long").alias("bucket")).agg(F.sum("count").cast("long").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), total("sum").alias("sum"), *reasons)


def catch_up(fine: DataFrame, coarse_done: DataFrame, factor: int, rebuild_from: int | None = None) -> DataFrame:
    """Coarse slots that the high-water mark of each lane (lane, done) does not cover yet; the mark's own bucket is made again.

    rebuild_from: a fine bucket from which on all are made again, as after a start (the last day); fine slots that are gone make nothing.
    """
    coarse = F.floor(F.col("bucket") / factor)
    due = coarse >= F.coalesce("done", F.lit(0))
    if rebuild_from is not None:
        due = due | (coarse >= rebuild_from // factor)
    return rollup(fine.join(coarse_done, "lane", "left").where(due), factor)


def rates(samples: DataFrame) -> DataFrame:
    """Counter steps (value) to rates: over the time since the sample before, an interval at most. Rows before a lane's first interval > 0 have no base."""
    order = Window.partitionBy("lane").orderBy("us", "seq")
    begun = F.sum((F.col("interval_s") > 0).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    timed = accepted(samples).withColumn("__begun", begun).where("__begun > 0").withColumn("__dt", (F.col("us") - F.lag("us").over(order)) / MICRO)
    dt = F.when(F.col("__dt").isNull(), F.col("interval_s")).when(F.col("interval_s") > 0, F.least("__dt", "interval_s")).otherwise(F.col("__dt"))
    return timed.withColumn("__d", dt).where("__d > 0").withColumn("value", F.col("value") / F.col("__d")).drop("__begun", "__dt", "__d")


def _attributed(samples: DataFrame, step: int) -> DataFrame:
    order = Window.partitionBy("lane").orderBy("us", "seq")
    span = F.least(F.greatest("interval_s", F.lit(0)), F.lit(SPAN_BUCKETS * step)) * MICRO
    lo = F.greatest(bucket(F.col("us") - span, step), F.coalesce(bucket(F.lag("us").over(order), step), F.lit(0)))
    return accepted(samples).withColumn("lo", lo).withColumn("hi", bucket("us", step))


def attribute_spans(samples: DataFrame, step: int) -> DataFrame:
    """Each sample counts in every bucket that [t - interval, t] touches, from the lane's open bucket on."""
    spread = _attributed(samples, step).where("lo <= hi").withColumn("bucket", F.explode(F.sequence("lo", "hi")))
    slots = spread.groupBy("lane", "bucket").agg(F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), total("value").alias("sum"))
    return _frozen(slots, spread, ("us", "seq"), MAX_COUNT).select("lane", "bucket", "count", "min", "max", "sum")


def hold(samples: DataFrame, step: int, now_us: int) -> DataFrame:
    """Step lanes: measured slots, and held ones in empty buckets that begin within HOLD_SECONDS of the last sample."""
    order = Window.partitionBy("lane").orderBy("us", "seq")
    rows = _attributed(samples, step)
    nxt = F.coalesce(F.lead("lo").over(order), F.lit(now_us // (step * MICRO))).cast("long")
    rows = rows.withColumn("__next", nxt)
    last = F.least(F.col("__next") - 1, F.floor((F.col("us") + HOLD_SECONDS * MICRO - 1) / (step * MICRO))).cast("long")
    held = rows.withColumn("__last", last).where(F.col("__last") > F.col("hi")).select("lane", "value", F.explode(F.sequence(F.col("hi") + 1, F.col("__last"))).alias("bucket"))
    held = held.select("lane", "bucket", F.lit(1).cast("long").alias("count"), F.col("value").alias("min"), F.col("value").alias("max"), F.col("value").alias("sum"), F.lit(HELD).cast("long").alias("reason"))
    measured = attribute_spans(samples, step).withColumn("reason", F.lit(MEASURED).cast("long"))
    return measured.unionByName(held)


def drop_late(samples: DataFrame, step: int, delay_buckets: int) -> DataFrame:
    """Samples whose bucket was not closed yet when they arrived (order of seq): within delay_buckets of the newest bucket before them."""
    order = Window.partitionBy("lane").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max(bucket("us", step)).over(order)
    return samples.withColumn("__newest", newest).where(F.col("__newest").isNull() | (bucket("us", step) >= F.col("__newest") - delay_buckets)).drop("__newest")


def retained(slots: DataFrame, buckets: int) -> DataFrame:
    """What a ring of so many buckets still holds."""
    newest = slots.groupBy("lane").agg(F.max("bucket").alias("__newest"))
    return slots.join(newest, "lane").where(F.col("bucket") > F.col("__newest") - buckets).drop("__newest")


def covered_reasons(spans: DataFrame, step: int) -> DataFrame:
    """bucket, reason: the most specific reason of the spans (from_s, to_s, reason) that touch each bucket. Spans become buckets, so that what follows is an equi-join."""
    rank = F.when(F.col("reason") == CLOCK_STEP, 3).when(F.col("reason") == ASLEEP, 2).when(F.col("reason") == NOT_RUNNING, 1).otherwise(0)
    touched = spans.where("to_s > from_s").withColumn("bucket", F.explode(F.expr(f"sequence(from_s div {step}, (to_s - 1) div {step})")))
    return touched.groupBy("bucket").agg(F.max_by("reason", F.struct(rank, -F.col("from_s"))).alias("reason"))


def gap_reasons(slots: DataFrame, spine: DataFrame, spans: DataFrame, step: int, last_commit: int) -> DataFrame:
    """lane, bucket, reason of every bucket of spine(lane, bucket): the slot's own, else by coverage, the lane's first bucket and the last commit."""
    first = slots.groupBy("lane").agg(F.min("bucket").alias("__first"))
    own = slots.select("lane", "bucket", F.lit(MEASURED).alias("__own"))
    out = spine.join(own, ["lane", "bucket"], "left").join(first, "lane", "left").join(covered_reasons(spans, step), "bucket", "left")
    reason = (
        F.when(F.col("__own").isNotNull(), F.col("__own"))
        .when(F.col("__first").isNull() | (F.col("bucket") < F.col("__first")), NODATA)
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("bucket") > last_commit, NOT_RUNNING)
        .otherwise(NODATA)
    )
    return out.select("lane", "bucket", reason.cast("long").alias("reason"))


def columns(slots: DataFrame, plan: ColumnPlan, gaps: DataFrame | None = None) -> DataFrame:
    """lane, column, start_s, count, min, avg, max for every lane and column of the plan; NULL, not zero, where there is nothing.

    With gaps(lane, bucket, reason) of every bucket (gap_reasons), also reason: MEASURED or HELD where there is data (slots may have a reason column; without
    one all are measured), else the first reason by position that isn't NODATA, with a count of zero; NULL throughout where no bucket has a reason.
    """
    inside = slots.where(F.col("bucket").between(plan.lower, plan.upper - 1))
    column = F.floor((F.col("bucket") - plan.lower) / plan.per_column).cast("long").alias("column")
    data = F.max(F.when(F.col("reason") == HELD, 0).otherwise(1)) if "reason" in slots.columns else F.max(F.lit(1))
    filled = inside.where("count > 0").groupBy("lane", column).agg(F.sum("count").cast("long").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), total("sum").alias("__sum"), data.alias("__measured"))
    spine = slots.select("lane").distinct().withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(plan.columns - 1)))).withColumn("column", F.col("column").cast("long"))
    out = spine.join(filled, ["lane", "column"], "left")
    start = ((F.col("column") * plan.per_column + plan.lower) * plan.step).cast("long").alias("start_s")
    if gaps is None:
        return out.select("lane", "column", start, "count", "min", (F.col("__sum") / F.col("count")).alias("avg"), "max")
    holes = gaps.where(F.col("bucket").between(plan.lower, plan.upper - 1) & ~F.col("reason").isin(NODATA, MEASURED, HELD))
    holes = holes.groupBy("lane", column).agg(F.min_by("reason", "bucket").alias("__gap"))
    reason = F.when(F.col("__measured") == 1, MEASURED).when(F.col("__measured") == 0, HELD).otherwise(F.col("__gap")).cast("long")
    count = F.coalesce("count", F.when(F.col("__gap").isNotNull(), 0)).cast("long")
    out = out.join(holes, ["lane", "column"], "left")
    return out.select("lane", "column", start, count.alias("count"), "min", (F.col("__sum") / F.col("count")).alias("avg"), "max", reason.alias("reason"))


def summary(cols: DataFrame) -> DataFrame:
    """lane, count, min, max, avg over columns with data, weighted by count."""
    data = cols.where("count > 0")
    return data.groupBy("lane").agg(F.sum("count").cast("long").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), significant(F.sum(F.col("avg") * F.col("count")) / F.sum("count")).alias("avg"))


def resample_fractional(slots: DataFrame, n: int) -> DataFrame:
    """Each lane's slots, by position, in n columns with bounds c * len / n; empty columns are NULL."""
    order = Window.partitionBy("lane").orderBy("bucket")
    placed = slots.withColumn("__i", F.row_number().over(order) - 1).withColumn("__len", F.count(F.lit(1)).over(Window.partitionBy("lane")))
    # column c holds positions from c * len div n to (c + 1) * len div n - 1
    spread = placed.withColumn("column", F.expr(f"((__i + 1) * {n} - 1) div __len"))
    spread = spread.where(F.expr(f"(column * __len) div {n} <= __i and __i < ((column + 1) * __len) div {n}"))
    filled = spread.groupBy("lane", "column").agg(F.sum("count").cast("long").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), total("sum").alias("__sum"))
    spine = slots.select("lane").distinct().withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return spine.join(filled, ["lane", "column"], "left").select("lane", "column", "count", "min", (F.col("__sum") / F.col("count")).alias("avg"), "max")
