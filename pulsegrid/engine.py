"""Reading the history: which tier, which buckets, which columns, and why some are empty."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import DAYS_KEPT, MEASURED, NODATA, REFRESH, TIERS
from .operators import relational, series, store
from .plans.columns import ColumnPlan, plan


@dataclass
class Engine:
    """The tables of a history. tiers: name to slots(lane, bucket, count, min, max, sum[, reason]); lanes: lane, pos, module, unit, label; spans: from_s, to_s, reason."""

    tiers: dict[str, DataFrame]
    lanes: DataFrame
    spans: DataFrame
    daily: DataFrame | None = None
    last_commit: dict[str, int] = field(default_factory=dict)

    def plan(self, seconds: int, now: int, max_columns: int = 1460) -> ColumnPlan:
        return plan(seconds, now, max_columns, tuple(self.tiers))

    def query(self, seconds: int, now: int, lanes: list[str] | None = None, max_columns: int = 1460) -> DataFrame:
        """lane, column, start_s, count, min, avg, max, reason of a range that ends at `now`, for the lanes named (unknown ones are left out) or all.

        Only buckets of the plan that the tier's ring still holds are read: the filter on bucket reaches the scan of a table that is kept by bucket.
        """
        p = self.plan(seconds, now, max_columns)
        slots = self.tiers[p.tier]
        directory = self.lanes if lanes is None else self.lanes.where(F.col("lane").isin(lanes))
        known = F.broadcast(directory.select("lane"))
        slots = slots.join(known, "lane", "left_semi")
        newest = self.last_commit.get(p.tier, p.upper - 1)
        read = slots.where((F.col("bucket") >= p.retained_from(newest)) & (F.col("bucket") < p.upper))
        gaps = self._gaps(slots, read, directory, p, newest)
        out = series.columns(read, p, gaps)
        # lanes without a slot in the range have columns too
        spine = directory.select("lane").withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p.columns - 1).cast("long"))))
        start = ((F.col("column") * p.per_column + p.lower) * p.step).cast("long").alias("start_s")
        return spine.join(out.drop("start_s"), ["lane", "column"], "left").select("lane", "column", start, "count", "min", "avg", "max", "reason")

    def _gaps(self, slots: DataFrame, read: DataFrame, directory: DataFrame, p: ColumnPlan, newest: int) -> DataFrame:
        """lane, bucket, reason of the buckets that have no data but a reason, without a row for every bucket: covered buckets, and those after the last commit."""
        first = slots.groupBy("lane").agg(F.min("bucket").alias("__first"))
        covered = series.covered_reasons(self.spans.where((F.col("to_s") > p.lower * p.step) & (F.col("from_s") < p.upper * p.step)), p.step)
        after = self.spans.sparkSession.range(max(newest + 1, p.lower), p.upper).select(F.col("id").alias("bucket"), F.lit(3).cast("long").alias("reason")) if newest + 1 < p.upper else None
        every = covered.select("bucket", F.col("reason").cast("long").alias("reason"))
        if after is not None:
            every = every.unionByName(after.join(covered.select("bucket"), "bucket", "left_anti"))
        every = every.where(F.col("bucket").between(p.lower, p.upper - 1) & ~F.col("reason").isin(NODATA, MEASURED))
        lanes = directory.select("lane").join(first, "lane")
        return lanes.join(F.broadcast(every), F.col("bucket") >= F.col("__first")).select("lane", "bucket", "reason").join(read.select("lane", "bucket"), ["lane", "bucket"], "left_anti")

    def summary(self, seconds: int, now: int, lanes: list[str] | None = None) -> DataFrame:
        return series.summary(self.query(seconds, now, lanes))

    def sentences(self, columns: DataFrame) -> DataFrame:
        """column, start_s, reason, from_s, to_s of each column of some lanes: measured if a lane has data, else the first lane's reason and the span it comes from."""
        order = self.lanes.select("lane", "pos")
        why = columns.join(F.broadcast(order), "lane").groupBy("column", "start_s").agg(F.max(F.coalesce(F.col("count"), F.lit(0))).alias("__n"), F.min_by(F.coalesce("reason", F.lit(NODATA)), "pos").alias("__r"))
        told = why.select("column", "start_s", F.when(F.col("__n") > 0, MEASURED).otherwise(F.col("__r")).cast("long").alias("reason"), F.col("start_s").alias("at_s"))
        return store.span_at(self.spans, told).drop("at_s")

    def refresh_seconds(self, seconds: int) -> int:
        """How often a view of the range that follows the clock is read again; one that is pinned keeps its `now`."""
        return REFRESH[seconds]

    def traffic(self, today: int, yesterday: int) -> DataFrame:
        """Upload and download of two days (YYYYMMDD), from the newest days kept."""
        if self.daily is None:
            raise ValueError("this history has no daily counters")
        return relational.two_days(relational.newest(self.daily, "day", DAYS_KEPT), today, yesterday)

    def status(self) -> DataFrame:
        """tier, lanes, slots, first_bucket, last_bucket, bytes (of the files that the tier would take)."""
        out = None
        for name, slots in self.tiers.items():
            one = slots.agg(F.count_distinct("lane").alias("lanes"), F.count(F.lit(1)).alias("slots"), F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"))
            size = F.lit(4096) + F.col("lanes") * (128 + TIERS[name][1] * 20)
            one = one.select(F.lit(name).alias("tier"), "lanes", "slots", "first_bucket", "last_bucket", size.cast("long").alias("bytes"))
            out = one if out is None else out.unionByName(one)
        return out
