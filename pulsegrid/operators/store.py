"""The stored history as tables: lane directory, slots by tier, spans, daily counters, keyed records. Each operator gives the next state of a table from the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket_key, bucket_key_parts
from ..model import ASLEEP, CLOCK_STEP, MAX_LANES, NO_BUCKET, NOT_RUNNING, ORPHAN, RECLAIM_IDLE, RECLAIMED, SLOT_BYTES, SPAN_RETENTION, TIERS

ENTRY = ["identity", "lane", "label", "unit", "kind", "flags", "first_valid", "last_used"]


# lane directory: identity, lane, label, unit, kind, flags, first_valid, last_used; MAX_LANES rows at most
def registration(directory: DataFrame, descriptors: DataFrame, now_s: int, most: int = MAX_LANES, idle_s: int = RECLAIM_IDLE) -> DataFrame:
    """identity, outcome, lane, displaced of each descriptor(identity, ord, ...): existing; registered while there is room; reclaimed from the lane used
    longest ago (idle_s or more; the least lane of several) in turn; refused. Descriptors count once, with their least ord."""
    wanted = descriptors.groupBy("identity").agg(F.min("ord").alias("ord"))
    known = F.broadcast(directory.select("identity", "lane"))
    existing = wanted.join(known, "identity").select("identity", F.lit("existing").alias("outcome"), "lane", F.lit(None).cast("string").alias("displaced"))
    fresh = wanted.join(known, "identity", "left_anti").orderBy("ord").limit(2 * most)  # more can't be registered or reclaimed
    one = Window.partitionBy(F.lit(0))  # over MAX_LANES rows
    numbered = fresh.withColumn("n", F.row_number().over(one.orderBy("ord")) - 1)
    size = directory.agg(F.count(F.lit(1))).scalar()
    touched = wanted.select("identity").withColumn("__seen", F.lit(True))
    cold = directory.join(F.broadcast(touched), "identity", "left").where(F.col("__seen").isNull() & (F.col("last_used") <= now_s - idle_s))
    cold = cold.withColumn("turn", F.row_number().over(one.orderBy("last_used", "lane")) - 1).select("turn", F.col("lane").alias("victim"), F.col("identity").alias("displaced"))
    placed = numbered.withColumn("size", size).withColumn("turn", F.col("n") - F.greatest(F.lit(most) - F.col("size"), F.lit(0))).join(cold, "turn", "left")
    room = F.col("size") + F.col("n") < most
    outcome = F.when(room, "registered").when(F.col("victim").isNotNull(), "reclaimed").otherwise("refused")
    lane = F.when(room, F.col("size") + F.col("n")).otherwise(F.col("victim")).cast("long")
    new = placed.select("identity", outcome.alias("outcome"), lane.alias("lane"), F.when(~room, F.col("displaced")).alias("displaced"))
    late = wanted.join(directory.select("identity"), "identity", "left_anti").join(fresh.select("identity"), "identity", "left_anti")
    refused = late.select("identity", F.lit("refused").alias("outcome"), F.lit(None).cast("long").alias("lane"), F.lit(None).cast("string").alias("displaced"))
    return existing.select("identity", "outcome", F.col("lane").cast("long").alias("lane"), "displaced").unionByName(new).unionByName(refused)


def registered(directory: DataFrame, descriptors: DataFrame, now_s: int, most: int = MAX_LANES, idle_s: int = RECLAIM_IDLE) -> DataFrame:
    """The directory after registration(): known lanes take the descriptor's label, unit and kind, and are orphans no more; reclaimed ones begin anew."""
    outcome = registration(directory, descriptors, now_s, most, idle_s).where("outcome <> 'refused'")
    first = descriptors.groupBy("identity").agg(F.min_by(F.struct("label", "unit", "kind"), "ord").alias("d"))
    told = outcome.join(first, "identity").select("identity", "outcome", "lane", "d.label", "d.unit", "d.kind")
    before = directory.select("identity", F.col("flags").alias("__flags"), F.col("first_valid").alias("__first"), F.col("last_used").alias("__used"))
    joined = told.join(F.broadcast(before), "identity", "left")
    old = F.col("outcome") == "existing"
    flags = F.when(old, F.col("__flags").bitwiseAND(F.lit(~ORPHAN))).when(F.col("outcome") == "reclaimed", RECLAIMED).otherwise(0)
    made = joined.select(
        "identity", "lane", "label", "unit", "kind", flags.cast("int").alias("flags"), F.when(old, F.col("__first")).otherwise(F.lit(NO_BUCKET)).cast("long").alias("first_valid"), F.greatest("__used", F.lit(now_s)).cast("long").alias("last_used")
    )
    rest = directory.join(F.broadcast(told.select("lane")), "lane", "left_anti")
    return rest.select(*ENTRY).unionByName(made.select(*ENTRY))


def touched(directory: DataFrame, uses: DataFrame) -> DataFrame:
    """last_used moves on to that of uses(lane, used)."""
    u = uses.groupBy("lane").agg(F.max("used").alias("__used"))
    return directory.join(F.broadcast(u), "lane", "left").withColumn("last_used", F.greatest("last_used", "__used").cast("long")).select(*directory.columns)


def carried_back(directory: DataFrame, firsts: DataFrame) -> DataFrame:
    """first_valid becomes that of firsts(lane, first_bucket); a lane that has a bucket of its own is no longer marked as reclaimed."""
    f = F.broadcast(firsts.select("lane", F.col("first_bucket").alias("__first")))
    joined = directory.join(f, "lane", "left")
    own = F.col("__first").isNotNull() & (F.col("__first") != NO_BUCKET)
    flags = F.when(own, F.col("flags").bitwiseAND(F.lit(~RECLAIMED))).otherwise(F.col("flags")).cast("int")
    return joined.withColumn("flags", flags).withColumn("first_valid", F.coalesce("__first", "first_valid")).select(*directory.columns)


def orphaned(directory: DataFrame, seen: DataFrame) -> DataFrame:
    """Lanes that seen(lane) doesn't have are marked as orphans."""
    s = F.broadcast(seen.select("lane").distinct().withColumn("__seen", F.lit(True)))
    flags = F.when(F.col("__seen").isNull(), F.col("flags").bitwiseOR(F.lit(ORPHAN))).otherwise(F.col("flags")).cast("int")
    return directory.join(s, "lane", "left").withColumn("flags", flags).select(*directory.columns)


def searched(directory: DataFrame, needle: str, title: str = "module") -> DataFrame:
    """Lanes whose label has the text in it, whatever its case, and all lanes of a module whose title has; all lanes for no text."""
    word = needle.strip().lower()
    return directory.where(F.lower("label").contains(word) | F.lower(title).contains(word)) if word else directory


def default_lanes(directory: DataFrame, module: str, primary_unit: str, k: int = 8) -> DataFrame:
    """The first k lanes of a module that aren't orphans: those in its main unit if it has any."""
    lanes = directory.where((F.col("module") == module) & (F.col("flags").bitwiseAND(F.lit(ORPHAN)) == 0)).withColumn("__main", F.col("unit") == primary_unit)
    some = lanes.agg(F.coalesce(F.max("__main"), F.lit(False))).scalar()
    return lanes.where(F.col("__main") | ~some).orderBy("lane").limit(k).select(*directory.columns)


def colour_offset(directory: DataFrame) -> DataFrame:
    """offset: a lane's place among those of its module."""
    return directory.withColumn("offset", F.row_number().over(Window.partitionBy("module").orderBy("lane")) - 1)


# slots: lane, bucket, count, min, max, sum, reason
def commit(slots: DataFrame, rows: DataFrame, capacity: int) -> DataFrame:
    """slots after new ones took the place of those of the same lane and bucket; what the ring can't hold beside the newest bucket is gone."""
    both = slots.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    kept = [c for c in slots.columns if c not in ("lane", "bucket")]
    last = both.groupBy("lane", "bucket").agg(F.max_by(F.struct(*kept), "__new").alias("__r")).select("lane", "bucket", "__r.*")
    newest = last.agg(F.max("bucket")).scalar()
    return last.where(F.col("bucket") > newest - capacity).select(*slots.columns)


def coverage(slots: DataFrame) -> DataFrame:
    """lane, first_bucket, last_bucket, slots."""
    return slots.groupBy("lane").agg(F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"), F.count(F.lit(1)).alias("slots"))


def point(slots: DataFrame, lane: str, bucket: int) -> DataFrame:
    return slots.where((F.col("lane") == lane) & (F.col("bucket") == bucket))


def row_of(slots: DataFrame, bucket: int) -> DataFrame:
    return slots.where(F.col("bucket") == bucket)


def series_of(slots: DataFrame, lane: str, first: int, last: int) -> DataFrame:
    return slots.where((F.col("lane") == lane) & F.col("bucket").between(first, last))


def stamps(slots: DataFrame, capacity: int) -> DataFrame:
    """lane, place, stamp: what the ring's places hold, whether or not it can still be read; the newest bucket of each place."""
    return slots.groupBy("lane", (F.col("bucket") % capacity).alias("place")).agg(F.max("bucket").alias("stamp"))


def without_stranded(slots: DataFrame, now_bucket: int, capacity: int) -> DataFrame:
    """slots, or none if the clock is a whole ring or more away from the newest one: they all belong to another era."""
    newest = slots.agg(F.max("bucket")).scalar()
    return slots.where(F.abs(newest - now_bucket) < capacity)


def clear_of_era(rows: DataFrame, slots: DataFrame, high_water: int) -> DataFrame:
    """New rows after the clock went back: where a lane has a slot from before the step (up to high_water) that slot stays and the row is dropped."""
    old = slots.where(F.col("bucket") <= high_water).select("lane", "bucket")
    return rows.join(old, ["lane", "bucket"], "left_anti")


def projected_bytes(lanes: int, tiers: tuple[str, ...] = ("t0", "t1", "t2")) -> int:
    """Size of the tiers' files for so many lanes: header, directory, ring."""
    return sum(4096 + lanes * 128 + TIERS[t][1] * lanes * SLOT_BYTES for t in tiers)


def preset_change(before: list[str], after: list[str]) -> tuple[list[str], list[str]]:
    """Tiers that go and tiers that are made when the preset changes."""
    return [t for t in before if t not in after], [t for t in after if t not in before]


def staged(slots: DataFrame, drained: int, keep: int = 16) -> tuple[DataFrame, DataFrame]:
    """Slots that wait to be written: those after the last drained bucket within the newest `keep` buckets of all lanes, and lane, dropped for those too old."""
    open_ = slots.where(F.col("bucket") > drained)
    newest = open_.agg(F.max("bucket")).scalar()
    aged = open_.withColumn("__in", F.col("bucket") > newest - keep)
    return aged.where("__in").select(*slots.columns), aged.groupBy("lane").agg(F.count_if(~F.col("__in")).alias("dropped"))


def drained(slots: DataFrame, last: int, before: int, look_back: int = 128) -> DataFrame:
    """Closed slots that weren't given yet: after bucket `last`, before bucket `before`, look_back of them at most; each is given once if `last` becomes before - 1."""
    return slots.where((F.col("bucket") > max(last, before - 1 - look_back)) & (F.col("bucket") < before) & (F.col("count") > 0))


# spans: from_s, to_s, reason
def loaded_spans(spans: DataFrame, now_s: int, retention: int = SPAN_RETENTION) -> DataFrame:
    """Spans of a sidecar that hold: closed ones, not older than the retention."""
    return spans.where((F.col("to_s") > F.col("from_s")) & (F.col("to_s") >= now_s - retention))


def span_at(spans: DataFrame, moments: DataFrame) -> DataFrame:
    """moments(at_s, reason, ...) with from_s and to_s of the first span of the same reason that covers them; NULL without one.

    Spans are few (a year of sleeping), so they are broadcast; moments stay where they are.
    """
    s = F.broadcast(spans.where("to_s > from_s").select(F.col("from_s").alias("__f"), F.col("to_s").alias("__t"), F.col("reason").alias("__r")))
    keyed = moments.withColumn("__id", F.monotonically_increasing_id())
    met = keyed.join(s, (F.col("__r") == F.col("reason")) & (F.col("at_s") >= F.col("__f")) & (F.col("at_s") < F.col("__t")), "left")
    out = met.groupBy("__id", *moments.columns).agg(F.min(F.struct("__f", "__t")).alias("__s"))
    return out.select(*moments.columns, F.col("__s.__f").alias("from_s"), F.col("__s.__t").alias("to_s"))


def down_time(starts: DataFrame, floor_s: float = 20, tolerance_s: float = 72) -> DataFrame:
    """from_s, to_s, reason of the time before each start. starts: last_bucket, step, now_s, anchor_s (steady clock at the last commit), mono_s (steady clock now).

    It begins where the last committed bucket ends. A clock that went back gives a clock step over what will be lived again; a gap of floor_s or less gives
    nothing; clocks that disagree about the gap by more than the tolerance make it a clock step.
    """
    last = (F.col("last_bucket") + 1) * F.col("step")
    gap = F.col("now_s") - last
    disagree = (F.col("anchor_s") > 0) & (F.col("mono_s") >= F.col("anchor_s")) & (F.abs(gap - (F.col("mono_s") - F.col("anchor_s"))) > tolerance_s)
    reason = F.when(gap <= 0, CLOCK_STEP).when(disagree, CLOCK_STEP).otherwise(NOT_RUNNING)
    kept = starts.where((F.col("last_bucket") > 0) & ((gap <= 0) | (gap > floor_s)))
    out = kept.select(*[c for c in starts.columns if c not in ("last_bucket", "step", "anchor_s", "mono_s", "now_s")], F.least(last, "now_s").alias("from_s"), F.greatest(last, "now_s").alias("to_s"), reason.cast("long").alias("reason"))
    return out.where("from_s < to_s")


def step_spans(steps: DataFrame) -> DataFrame:
    """from_s, to_s of clock steps(at_s, step_s): the time jumped over, or the time to be lived again."""
    return steps.select(F.when(F.col("step_s") > 0, F.col("at_s") - F.col("step_s")).otherwise(F.col("at_s")).alias("from_s"), F.when(F.col("step_s") > 0, F.col("at_s")).otherwise(F.col("at_s") - F.col("step_s")).alias("to_s"), F.lit(CLOCK_STEP).cast("long").alias("reason"))


def sleep_spans(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason", F.lit(ASLEEP).cast("long"))


# daily counters: day, seq, upload, download
def compacted(records: DataFrame) -> DataFrame:
    """The last record of each day that passes its checksum (column valid) and has a day."""
    good = records.where("valid and day > 0")
    return good.groupBy("day").agg(F.max_by(F.struct("upload", "download"), "seq").alias("r")).select("day", "r.upload", "r.download")


# keyed records: key, value
def prefix_scan(records: DataFrame, prefix: str) -> DataFrame:
    """Keys that begin so, as a range of the sorted keys: the filter reaches the scan."""
    return records.where((F.col("key") >= prefix) & (F.col("key") < prefix + "\U0010ffff"))


def range_scan(records: DataFrame, first: str, end: str) -> DataFrame:
    return records.where((F.col("key") >= first) & (F.col("key") < end))


def last_of(records: DataFrame, prefix: str) -> DataFrame:
    """The record of largest key with the prefix."""
    return prefix_scan(records, prefix).orderBy(F.desc("key")).limit(1)


def deleted_before(records: DataFrame, before: Column | int) -> DataFrame:
    """Records without those of the minute store that are older; other keys stay."""
    name, ts = bucket_key_parts(F.col("key"))
    return records.where(name.isNull() | (ts >= before))


def minute_records(buckets: DataFrame) -> DataFrame:
    """key, value of minute buckets(name, minute_s, value)."""
    return buckets.select(bucket_key(F.col("name"), F.col("minute_s")).alias("key"), "value")


def restored(records: DataFrame, now_s: int, ttl_s: int = 3600) -> DataFrame:
    """The latest snapshot of each name, from keys 'name@seconds', that isn't older than the time to live."""
    name, ts = F.regexp_extract("key", "^(.*)@([0-9]+)$", 1), F.regexp_extract("key", "^(.*)@([0-9]+)$", 2).try_cast("long")
    live = records.select(name.alias("name"), ts.alias("at_s"), "value").where(F.col("at_s") >= now_s - ttl_s)
    return live.groupBy("name").agg(F.max("at_s").alias("at_s"), F.max_by("value", "at_s").alias("value"))


#: Settings that never leave the machine. Fixed values.
PRIVATE_SETTINGS = ("remote_id", "access_token", "refresh_token")


def exported_settings(settings: Column) -> Column:
    """A map of settings without the private ones."""
    return F.map_filter(settings, lambda k, v: ~k.isin(*PRIVATE_SETTINGS))


def imported_settings(settings: Column, own: Column) -> Column:
    """A map of settings to take over, with the machine's own private ones where it has them."""
    private = F.map_filter(own, lambda k, v: k.isin(*PRIVATE_SETTINGS))
    rest = F.map_filter(settings, lambda k, v: ~F.array_contains(F.map_keys(private), k))
    return F.map_concat(rest, private)


def allowed_after_failures(attempts: DataFrame, strikes: int = 3, pause_s: int = 3600) -> DataFrame:
    """lane, at_s, failed of the attempts that a writer makes which pauses pause_s after `strikes` failures in a row: those within a pause are left out.

    Like throttled(), a walk over sorted rows with two numbers a key.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row, until = object(), 0, float("-inf")
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (k, at, failed) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)):
                if k != now:
                    now, row, until = k, 0, float("-inf")
                if at >= until:
                    keep[i] = True
                    row = row + 1 if failed else 0
                    if row >= strikes:
                        row, until = 0, at + pause_s
            yield batch.filter(pa.array(keep))

    narrow = attempts.select("lane", F.col("at_s").cast("long").alias("at_s"), "failed")
    return narrow.repartition("lane").sortWithinPartitions("lane", "at_s", "failed").mapInArrow(walk, narrow.schema)


def cached(reads: DataFrame, ttl_s: int) -> DataFrame:
    """lane, at_s, fetched: what a cache with a time to live does with reads: the first fetches, and the first after each fetch's end."""
    from .windows import throttled

    timed = reads.select("lane", (F.col("at_s") * 1_000_000).cast("long").alias("us"), F.lit(0).cast("long").alias("seq")).distinct()
    fetched = throttled(timed, "lane", ttl_s).select("lane", (F.col("us") / 1_000_000).cast("long").alias("at_s"), F.lit(True).alias("fetched"))
    return reads.join(fetched, ["lane", "at_s"], "left").withColumn("fetched", F.coalesce("fetched", F.lit(False)))


# guards of a writer
#: Bytes that must be free, records of a daily file, seconds between its writes. Fixed values.
FREE_FLOOR, DAILY_RECORDS, DAILY_SECONDS = 50_000_000, 2_000, 300


def may_write(free_bytes: Column) -> Column:
    """Is there room? Unknown isn't full."""
    return free_bytes.isNull() | (free_bytes >= FREE_FLOOR)


def daily_action(records: Column, torn: Column, changed: Column, since_s: Column, force: Column) -> Column:
    """What the writer of a daily file does: nothing, append, or write it anew."""
    due = changed & (force | (since_s >= DAILY_SECONDS))
    return F.when(torn & changed, "compact").when(due & (records > DAILY_RECORDS), "compact").when(due, "append").otherwise("nothing")


def writer_lock(holders: DataFrame, now_s: int, lease_s: int = 120) -> DataFrame:
    """path, outcome of a writer that wants each path: acquired, held by another (a lease that still runs), or taken over (one that ran out). holders: path, owner, until_s; owner NULL is none."""
    outcome = F.when(F.col("owner").isNull(), "acquired").when(F.col("until_s") > now_s, "held").otherwise("taken over")
    return holders.select("path", outcome.alias("outcome"), F.when(outcome != "held", now_s + lease_s).otherwise(F.col("until_s")).cast("long").alias("until_s"))


def gpu_rows(rows: DataFrame, gpus: str) -> DataFrame:
    """The GPUs of each reading as rows: id and shares of 1 at most (NULL stays NULL); those that are off have no utilization."""
    keep = [c for c in rows.columns if c != gpus]
    each = rows.select(*keep, F.posexplode(gpus).alias("ord", "__g"))
    share = lambda c: F.when(F.col(f"__g.{c}").isNotNull(), F.least(F.col(f"__g.{c}") / 100, F.lit(1.0)))
    return each.select(*keep, "ord", F.coalesce(F.nullif(F.col("__g.id"), F.lit("")), F.lit("GPU")).alias("id"), F.when(F.col("__g.state"), share("utilization")).alias("utilization"), share("render").alias("render"))


def readable_keys(rows: DataFrame, keys: str) -> DataFrame:
    """Keys of each reading by index, without those that couldn't be read (NULL); what comes behind them keeps its index."""
    keep = [c for c in rows.columns if c != keys]
    return rows.select(*keep, F.posexplode(keys).alias("ord", "key")).where("key is not null")


def connectivity(rows: DataFrame) -> DataFrame:
    """key, us, seq, status, latency, step of probes (key, us, seq, status, latency): the difference to the last probe that was answered, which a lost one doesn't change."""
    w = Window.partitionBy("key").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("status"), F.col("latency")), ignorenulls=True).over(w)
    return rows.withColumn("step", F.when(F.col("status"), F.abs(F.col("latency") - before)))
