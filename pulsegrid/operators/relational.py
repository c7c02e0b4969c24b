"""Joins, set operations, top-k, grouping and identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import I64_MAX, day_key
from ..sources.shared import written
from .series import significant, total
from .windows import throttled


def lane_identity(module: Column, source: Column, metric: Column) -> Column:
    """The first 16 bytes of the SHA-256 of 'module|source|metric', in hex."""
    return F.substring(F.sha2(F.concat(module, F.lit("|"), F.coalesce(source, F.lit("")), F.lit("|"), metric), 256), 1, 32)


def reconcile(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Directories by position: the fine one holds; a coarse first bucket stays only where the identity at that position is the same."""
    c = coarse.select("pos", F.col("lane").alias("__lane"), F.col("first_bucket").alias("__first"))
    return fine.join(c, "pos", "left").select("pos", "lane", F.when(F.col("lane") == F.col("__lane"), F.col("__first")).otherwise(F.col("first_bucket")).alias("first_bucket"))


def newest(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The n rows of largest `by` (a unique column)."""
    return rows.orderBy(F.desc(by)).limit(n)


def last_wins(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of largest seq for each key."""
    kept = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*kept), seq).alias("__r")).select(key, "__r.*")


def conflate(rows: DataFrame, key: str, value: str, window_us: int) -> DataFrame:
    """The last value of each key in each window of the epoch's grid."""
    w = F.floor(F.col("us") / window_us).cast("long")
    return rows.groupBy(key, w.alias("window")).agg(F.max_by(value, F.struct("us", "seq")).alias(value), F.count(F.lit(1)).alias("merged"))


def grouped_top(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k keys of largest sum; ties by key."""
    return rows.groupBy(key).agg(total(value).alias("usage")).orderBy(F.desc("usage"), key).limit(k)


def responsible_top(rows: DataFrame, key: str, name: str, value: str, order: str, k: int) -> DataFrame:
    """The k groups of largest sum, each with the name of its first row by `order`; ties by key."""
    grouped = rows.groupBy(key).agg(F.min_by(name, order).alias(name), total(value).alias("usage"), F.count(F.lit(1)).alias("members"))
    return grouped.orderBy(F.desc("usage"), key).limit(k)


def pair_top(rows: DataFrame, key: str, a: str, b: str, k: int) -> DataFrame:
    """The k rows of largest (greater, lesser) of two values; ties by key."""
    return rows.orderBy(F.greatest(a, b).desc(), F.least(a, b).desc(), F.col(key)).limit(k)


def lru_victim(lanes: DataFrame, now_us: int, idle_us: int) -> DataFrame:
    """The lane used longest ago, if that is idle_us or more; ties by lane."""
    return lanes.where(F.col("last_us") <= now_us - idle_us).orderBy("last_us", "lane").limit(1)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).unionByName(b.subtract(a))


def only(rows: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Distinct rows whose key is live."""
    return rows.join(live, key, "left_semi").distinct()


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't gone."""
    return rows.join(gone, key, "left_anti")


def grouped(members: DataFrame, groups: DataFrame, key: str, group_key: str, name: str, none: str = "ungrouped") -> DataFrame:
    """members with grp: the name of their group, or `none` if there is no such group."""
    g = groups.select(F.col(group_key).alias(key), F.col(name).alias("__grp"))
    return members.join(g, key, "left").withColumn("grp", F.coalesce("__grp", F.lit(none))).drop("__grp")


def upsert(sources: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """Full outer merge; each field from the first source that has it."""
    named = [s.select(key, *[F.col(f).alias(f"__{i}_{f}") for f in fields]) for i, s in enumerate(sources)]
    merged = reduce(lambda x, y: x.join(y, key, "full_outer"), named)
    return merged.select(key, *[F.coalesce(*[F.col(f"__{i}_{f}") for i in range(len(sources))]).alias(f) for f in fields])


def resolve(items: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """items with target_id: by the first of the keys that is known and has exactly one target; ambiguity gives NULL for that key. A target goes to
    one item only: the one that matched by the earliest key, then the least item_id."""
    out = items
    for k in keys:
        unique = targets.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("target_id").alias(f"__t_{k}"), F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
        out = out.join(unique, k, "left")
    rank = F.coalesce(*[F.when(F.col(f"__t_{k}").isNotNull(), F.lit(i)) for i, k in enumerate(keys)])
    out = out.select("item_id", F.coalesce(*[F.col(f"__t_{k}") for k in keys]).alias("target_id"), rank.alias("__rank"))
    # the winner of each target by a partial aggregate; items without one don't meet on NULL
    won = out.where("target_id is not null").groupBy("target_id").agg(F.min(F.struct("__rank", "item_id")).alias("__w")).select(F.col("__w.item_id").alias("item_id"), F.col("target_id").alias("__won"))
    return out.join(won, "item_id", "left").select("item_id", F.when(F.col("target_id") == F.col("__won"), F.col("target_id")).alias("target_id"))


def normalized(text: Column) -> Column:
    """An address or name as it is compared: trimmed, lower case, dashes for colons; NULL if empty."""
    return F.nullif(F.lower(F.replace(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(":"), F.lit("-"))), F.lit(""))


def resolve_accessories(items: DataFrame, devices: DataFrame, hid: DataFrame) -> DataFrame:
    """items(item_id, address, name, vendor, product) with target_id of devices(target_id, address, name, vendor, product); hid(name, address).

    In turn: the device of the same address; of the address that the one HID device of the same name has (two such addresses end the search); the only device
    of the same name; the only device of the same vendor and product. A target goes to one item, as in resolve().
    """
    own = items.select("item_id", normalized(F.col("address")).alias("a"), normalized(F.col("name")).alias("n"), F.when(F.col("vendor").isNotNull() & F.col("product").isNotNull(), F.struct("vendor", "product")).alias("vp"))
    known = devices.select("target_id", normalized(F.col("address")).alias("a"), normalized(F.col("name")).alias("n"), F.struct("vendor", "product").alias("vp"))
    via = hid.select(normalized(F.col("name")).alias("n"), normalized(F.col("address")).alias("a")).where("n is not null").groupBy("n").agg(F.count_distinct("a").alias("__addresses"), F.min("a").alias("__hid"))
    first = lambda k, out: known.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("target_id").alias(out), F.count(F.lit(1)).alias(f"{out}_n"))
    found = own.join(first("a", "__1"), "a", "left").join(via, "n", "left").join(first("a", "__2").withColumnRenamed("a", "__hid"), "__hid", "left").join(first("n", "__3"), "n", "left").join(first("vp", "__4"), "vp", "left")
    only = lambda k: F.when(F.col(f"{k}_n") == 1, F.col(k))
    by_name = F.coalesce(only("__2"), only("__3"))
    stopped = F.coalesce(F.col("__addresses") > 1, F.lit(False))
    target = F.coalesce(F.col("__1"), F.when(~stopped, F.coalesce(by_name, only("__4"))))
    rank = F.when(F.col("__1").isNotNull(), 0).when(only("__2").isNotNull(), 1).when(only("__3").isNotNull(), 2).otherwise(3)
    out = found.select("item_id", target.alias("target_id"), rank.alias("__rank"))
    won = out.where("target_id is not null").groupBy("target_id").agg(F.min(F.struct("__rank", "item_id")).alias("__w")).select(F.col("__w.item_id").alias("item_id"), F.col("target_id").alias("__won"))
    return out.join(won, "item_id", "left").select("item_id", F.when(F.col("target_id") == F.col("__won"), F.col("target_id")).alias("target_id"))


def hierarchy(nodes: DataFrame, max_depth: int = 16) -> DataFrame:
    """id, depth, path of nodes(id, parent, ord): the ords from the root down, whose order is preorder. A cycle has no root and no rows.

    Each level is written before the next is made (one join a level), and the walk ends at the first empty one.
    """
    spark = nodes.sparkSession
    children = nodes.where("parent is not null").select("id", "parent", "ord")
    level = nodes.where("parent is null").select("id", F.lit(0).cast("long").alias("depth"), F.array(F.col("ord").cast("long")).alias("path"))
    out = []
    for _ in range(max_depth + 1):
        level = written(spark, level, "level")
        if level.isEmpty():
            break
        out.append(level)
        up = level.select(F.col("id").alias("parent"), F.col("depth").alias("__d"), F.col("path").alias("__p"))
        level = children.join(up, "parent").select("id", (F.col("__d") + 1).alias("depth"), F.concat("__p", F.array(F.col("ord").cast("long"))).alias("path"))
    return reduce(DataFrame.unionByName, out) if out else level


def status_rollup(hosts: DataFrame, group: str, up: Column, down: Column) -> DataFrame:
    """Colour of each group: green all up, red all down, orange any other mix (hosts that are neither count), gray for none."""
    n = hosts.groupBy(group).agg(F.count_if(up).alias("up"), F.count_if(down).alias("down"), F.count(F.lit(1)).alias("total"))
    return n.withColumn("colour", F.when(F.col("total") == 0, "gray").when(F.col("up") == F.col("total"), "green").when(F.col("down") == F.col("total"), "red").otherwise("orange"))


def mode(rows: DataFrame, key: str, code: str) -> DataFrame:
    """The most frequent code of each key; the least of equally frequent ones."""
    n = rows.groupBy(key, code).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.max_by(F.struct(code, "n"), F.struct(F.col("n"), -F.col(code))).alias("__m")).select(key, F.col(f"__m.{code}").alias(code), F.col("__m.n").alias("n"))


def custom_order(rows: DataFrame, order: DataFrame, key: str, name: str) -> DataFrame:
    """position of each row: by its index in order(key, idx), rows without one behind, by name without case."""
    joined = rows.join(order, key, "left")
    ranked = joined.withColumn("__o", F.coalesce("idx", F.lit(2**31 - 1)))
    # one ordered sequence over all rows: meant for lists that a person arranges
    return ranked.withColumn("position", F.row_number().over(Window.orderBy("__o", F.lower(name), key))).drop("__o", "idx")


def duration_weighted(rows: DataFrame, *keys: str) -> DataFrame:
    """Merge of statistics (average, minimum, maximum, count, duration): the average weighted by duration."""
    weighted = F.try_divide(F.sum((F.col("average") * F.col("duration")).cast("decimal(28,8)")).cast("double"), F.sum(F.col("duration").cast("decimal(28,8)")).cast("double"))
    return rows.groupBy(*keys).agg(weighted.alias("average"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"), F.sum("count").alias("count"), F.sum(F.col("duration").cast("decimal(28,8)")).cast("double").alias("duration"))


def split_minutes(rows: DataFrame, duration_s: Column) -> DataFrame:
    """Each sample over the minutes that [us - duration, us) covers: minute, seconds."""
    minute = 60 * 1_000_000
    start = F.col("us") - (F.least(duration_s, F.lit(86400)) * 1_000_000).cast("long")
    spread = rows.withColumn("__s", start).where("__s < us").withColumn("minute", F.explode(F.expr(f"sequence(__s div {minute}, (us - 1) div {minute})")))
    return spread.withColumn("seconds", (F.least(F.col("us"), (F.col("minute") + 1) * minute) - F.greatest(F.col("__s"), F.col("minute") * minute)) / 1_000_000).drop("__s")


def daily_totals(rows: DataFrame, utc: Column, zone: str, up: Column, down: Column) -> DataFrame:
    """day (YYYYMMDD of the zone's calendar), upload, download; negatives count as none, and sums stop at the largest 64-bit integer."""
    return rows.groupBy(day_key(utc, zone).alias("day")).agg(saturating_sum(up).alias("upload"), saturating_sum(down).alias("download"))


def saturating_sum(value: Column) -> Column:
    """Sum of whole numbers, negatives as none, held at the largest 64-bit integer (adding is monotonous, so holding each number and the exact sum is the same)."""
    held = F.least(F.greatest(value, F.lit(0)), F.lit(I64_MAX))
    exact = F.sum(held.cast("decimal(28,0)"))  # a decimal(38,0): 10^19 of the largest
    return F.least(exact, F.lit(I64_MAX).cast("decimal(38,0)")).cast("long")


def two_days(totals: DataFrame, today: int, yesterday: int) -> DataFrame:
    """One row: upload and download of today and of yesterday (days as YYYYMMDD), 0 without a record."""
    part = lambda c, d: F.coalesce(F.sum(F.when(F.col("day") == d, F.col(c))), F.lit(0)).cast("long")
    return totals.where(F.col("day").isin(today, yesterday)).agg(part("upload", today).alias("upload"), part("download", today).alias("download"), part("upload", yesterday).alias("upload_before"), part("download", yesterday).alias("download_before"))


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of least `order` for each key: the first to come holds."""
    kept = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*kept), order).alias("__r")).select(key, "__r.*")


def append_new(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """rows, and those of `more` whose key they don't have."""
    return rows.unionByName(more.join(rows.select(key), key, "left_anti").select(*rows.columns))


def patch(state: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """state with each field of an update that is not null in place of its own; updates of unknown keys change nothing."""
    fields = [c for c in state.columns if c != key]
    new = update.select(key, *[F.col(c).alias(f"__{c}") for c in fields if c in update.columns])
    return state.join(new, key, "left").select(key, *[F.coalesce(f"__{c}", c).alias(c) if c in update.columns else F.col(c) for c in fields])


def first_unused(left: DataFrame, right: DataFrame, matches: Column, left_order: str, right_order: str) -> DataFrame:
    """Each left row, in order, with the first right row that matches and no earlier left row took; NULL without one. For two short lists: the pairs that match
    are walked in one task."""
    import pandas as pd

    pairs = F.broadcast(right.select(F.col(right_order).alias("__r"), *[c for c in right.columns if c != right_order])).join(left, matches).select(F.col(left_order).alias("l"), F.col("__r").alias("r"))
    kinds = pairs.schema

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for l, rs in pdf.sort_values(["l", "r"]).groupby("l")["r"]:  # noqa: E741
            free = next((r for r in rs if r not in used), None)
            if free is not None:
                used.add(free)
                out.append((l, free))
        return pd.DataFrame(out, columns=["l", "r"]).astype(pdf[["l", "r"]].dtypes.to_dict())

    taken = pairs.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(walk, kinds)
    return left.join(taken.withColumnRenamed("l", left_order), left_order, "left").withColumnRenamed("r", right_order)


def usage_by_pid(rows: DataFrame, interval_s: float) -> DataFrame:
    """pid, name, usage (percent) of each tick after a client's one before: the clients' steps of GPU time over the elapsed time, summed by process.

    rows: client, pid, name, queues, gpu_ns, tick_ns. A client counts if it had the same process and number of queues and no more time at the tick before;
    a tick that comes under 0.25 s after the last that counted is left out, and one after three intervals (of a second or more) is only a new base.
    """
    # a row a tick; throttled() counts its seconds in units of `us`, here nanoseconds
    ticks = throttled(rows.select(F.lit(0).alias("one"), F.col("tick_ns").alias("us"), F.lit(0).alias("seq")).distinct(), "one", 250.0)
    ticks = ticks.select(F.col("us").alias("tick_ns"), F.lag("us").over(Window.partitionBy("one").orderBy("us")).alias("__before"))
    ticks = ticks.withColumn("__elapsed", F.col("tick_ns") - F.col("__before")).where(F.col("__elapsed") <= max(interval_s, 1) * 3e9)
    before = rows.select("client", F.col("tick_ns").alias("__before"), F.col("pid").alias("__pid"), F.col("queues").alias("__queues"), F.col("gpu_ns").alias("__gpu"))
    both = rows.join(F.broadcast(ticks), "tick_ns").join(before, ["client", "__before"])
    same = both.where((F.col("pid") == F.col("__pid")) & (F.col("queues") == F.col("__queues")) & (F.col("gpu_ns") >= F.col("__gpu")))
    share = (F.col("gpu_ns") - F.col("__gpu")) / F.col("__elapsed") * 100
    return same.groupBy("tick_ns", "pid").agg(F.min_by("name", "client").alias("name"), significant(F.sum(share)).alias("usage"))


def network_top(rows: DataFrame, a: str, b: str, time: str, key: str, k: int) -> DataFrame:
    """The k rows of largest (greater, lesser) of two values, then latest; ties by key, the largest first."""
    return rows.orderBy(F.greatest(a, b).desc(), F.least(a, b).desc(), F.col(time).desc(), F.col(key).desc()).limit(k)


def top(rows: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The k rows of largest value; ties by key."""
    return rows.orderBy(F.desc(value), key).limit(k)


def flag_ranked(rows: DataFrame, flag: Column, key: str, name: str) -> DataFrame:
    """rows with their place: those without the flag first, each part by key. For lists that a person looks at: one ordered sequence."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(flag, key)))


def group_order(rows: DataFrame, group: str, order: str, known: list[str]) -> DataFrame:
    """group, position: groups in the order that is known, the others behind by their first appearance. One row a group is ordered."""
    place = F.array_position(F.array(*[F.lit(x) for x in known]), F.col(group))
    firsts = rows.groupBy(group).agg(F.min(order).alias("__f"))
    ranked = Window.partitionBy(F.lit(0)).orderBy(F.when(place > 0, place).otherwise(len(known) + 1), "__f")
    return firsts.withColumn("position", F.row_number().over(ranked)).select(group, "position")


def active_by(rows: DataFrame, active: Column, value: str, key: str) -> DataFrame:
    """Active rows by value, the largest first; ties by key."""
    return rows.where(active).orderBy(F.desc(value), key)
