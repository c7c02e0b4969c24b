"""Projections and filters of sampled hardware: sensors, memory, disks, batteries, cores. Rows in, rows out, but for the few means over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import significant

#: The sensors that are recorded without being asked for. Fixed values.
CURATED = ("Average CPU", "Average GPU", "TB1T", "TB2T")
CURATED_PATTERN = "^TA[0-9]P$"
#: Letters that begin the keys of sensors of unknown kind. Fixed values.
KEY_TYPES = {"T": "temperature", "V": "voltage", "P": "power", "I": "current"}
#: Sensors below these values show 0. Fixed values.
DEAD_BANDS = {"VD0R": 0.4, "ID0R": 0.05}


def curated(key: Column) -> Column:
    return key.isin(*CURATED) | key.rlike(CURATED_PATTERN)


def recorded(sensors: DataFrame, enabled: DataFrame) -> DataFrame:
    """Sensors (key, type, value, computed) that become lanes: fans that aren't computed, curated temperatures above 0, and enabled(key) ones that aren't 0."""
    chosen = sensors.join(F.broadcast(enabled.select("key").distinct().withColumn("__on", F.lit(True))), "key", "left")
    fan = (F.col("type") == "fan") & ~F.col("computed")
    temperature = (F.col("type") == "temperature") & curated(F.col("key")) & (F.col("value") > 0)
    asked = F.col("__on").isNotNull() & F.col("type").isin("temperature", "voltage", "power") & (F.col("value") != 0)
    return chosen.where(fan | temperature | asked).drop("__on")


def plausible(kind: Column, value: Column) -> Column:
    """Temperatures of 0 or over 110 and currents over 100 aren't; other kinds always are."""
    return ~F.coalesce(((kind == "temperature") & ((value == 0) | (value > 110))) | ((kind == "current") & (value > 100)), F.lit(False))


def plausible_hid(value: Column) -> Column:
    return (value >= 0) & (value < 300)


def dead_band(key: Column, value: Column) -> Column:
    out = value
    for k, low in DEAD_BANDS.items():
        out = F.when((key == k) & (value < low), 0.0).otherwise(out)
    return out


def clamped(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def halved_in_tunnel(value: Column, connected: Column, mode: Column) -> Column:
    """Traffic that the counters see twice because it goes through a tunnel."""
    return F.when(connected & mode, F.call_function("div", value, F.lit(2))).otherwise(value)


def memory_columns(rows: DataFrame, total: str = "total", page: int = 4096) -> DataFrame:
    """used, free, app and cache in bytes from counts of pages (active, inactive, speculative, wired, compressed, purgeable, external) and the total in bytes."""
    b = {c: F.col(c).cast("double") * page for c in ("active", "inactive", "speculative", "wired", "compressed", "purgeable", "external")}
    used = b["active"] + b["inactive"] + b["speculative"] + b["wired"] + b["compressed"] - b["purgeable"] - b["external"]
    made = rows.withColumn("used", used)
    return made.withColumn("free", F.col(total) - F.col("used")).withColumn("app", F.col("used") - b["wired"] - b["compressed"]).withColumn("cache", b["purgeable"] + b["external"])


def pressure_level(level: Column) -> Column:
    return F.when(level == 2, "warning").when(level == 4, "critical").otherwise("normal")


def disk_used(size: Column, free: Column) -> Column:
    """Used share of a volume: 0 without a size, and none below 0; NULL if one isn't known."""
    return F.when(size == 0, 0.0).when(size.isNotNull() & free.isNotNull(), F.greatest(size - free, F.lit(0)) / size)


def battery_power(volts: Column, milliamps: Column) -> Column:
    return volts * (milliamps / 1000)


def battery_health(capacity: Column, design: Column) -> Column:
    """Whole percent of the design capacity, half to even, 100 at most."""
    share = F.bround(100.0 * capacity / design, 0).cast("int")
    return F.when(share.isNotNull(), F.least(share, F.lit(100)))


def expand_templates(templates: DataFrame, available: DataFrame) -> DataFrame:
    """key, name, type of the sensors that are there. templates: pos, key, name, type; available: key.

    A key with % stands for its ten digits; the name's % becomes the running number of those that are there. Keys that no template names take their type
    from their first letter, and their own name. A key goes to the first template that has it.
    """
    there = available.select("key").where(F.substring("key", 1, 1).isin(*KEY_TYPES)).distinct()
    plain = templates.where(~F.col("key").contains("%")).select("pos", F.lit(0).alias("digit"), "key", "name", "type")
    many = templates.where(F.col("key").contains("%")).withColumn("digit", F.explode(F.sequence(F.lit(0), F.lit(9))))
    many = many.select((F.col("pos") + 1_000_000).alias("pos"), "digit", F.replace("key", F.lit("%"), F.col("digit").cast("string")).alias("key"), "name", "type")
    found = plain.unionByName(many).join(there, "key", "left_semi")
    first = found.groupBy("key").agg(F.min_by(F.struct("pos", "digit", "name", "type"), F.struct("pos", "digit")).alias("t")).select("key", "t.*")
    # digits of a template are ten at most: its running number is a small self-join by template
    below = first.where("pos >= 1000000").select("pos", F.col("digit").alias("__d"))
    rank = first.join(below, (first["pos"] == below["pos"]) & (below["__d"] <= first["digit"]), "left").groupBy("key").agg(F.count("__d").alias("__n"))
    named = first.join(rank, "key").select("key", F.replace("name", F.lit("%"), F.col("__n").cast("string")).alias("name"), "type")
    kind = F.create_map(*[F.lit(x) for pair in KEY_TYPES.items() for x in pair])
    rest = there.join(first.select("key"), "key", "left_anti").select("key", F.col("key").alias("name"), kind[F.substring("key", 1, 1)].alias("type"))
    return named.unionByName(rest)


def group_mean(rows: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    return rows.groupBy(*keys).agg(significant(F.avg(value)).alias("mean"))


def pair_mean(rows: DataFrame, *keys: str, index: str = "core", value: str = "usage") -> DataFrame:
    """Mean of each two siblings (cores 0 and 1, 2 and 3, ...) of a key; a core without its sibling is left out."""
    pair = F.call_function("div", F.col(index), F.lit(2)).alias("pair")
    return rows.groupBy(*keys, pair).agg((F.sum(value) / 2).alias("usage"), F.count(F.lit(1)).alias("__n")).where("__n = 2").drop("__n")


#: States of a core that does nothing. Fixed values.
IDLE_STATES = ("IDLE", "DOWN", "OFF")


def residency_frequency(rows: DataFrame, *keys: str, floor_mhz: Column | None = None) -> DataFrame:
    """mhz of each key: frequencies weighted by residency over the states that aren't idle; 0 without any. rows: keys, state, residency, mhz."""
    active = rows.where(~F.col("state").isin(*IDLE_STATES)).groupBy(*keys)
    weight = F.sum("residency")
    out = active.agg(F.when(weight == 0, 0.0).otherwise(significant(F.sum(F.col("residency") * F.col("mhz")) / weight)).alias("mhz"))
    return out if floor_mhz is None else out.withColumn("mhz", F.greatest("mhz", floor_mhz))


def weighted_frequency(rows: DataFrame, *keys: str, clusters: dict[str, int]) -> DataFrame:
    """Mean over a key's clusters that have a frequency, weighted by their cores. rows: keys, cluster, mhz."""
    cores = F.create_map(*[F.lit(x) for pair in clusters.items() for x in pair])[F.col("cluster")]
    known = rows.where(F.col("mhz").isNotNull()).withColumn("__cores", cores)
    return known.groupBy(*keys).agg(significant(F.sum(F.col("mhz") * F.col("__cores")) / F.sum("__cores")).alias("mhz"))


def computed_rows(sensors: DataFrame, *keys: str) -> DataFrame:
    """Average and hottest sensor of each group (CPU, GPU, SOC), and the fastest of two fans or more, as rows beside the others. sensors: keys, key, group, type, value, averaged."""
    hot = sensors.where((F.col("type") == "temperature") & F.col("averaged") & F.col("group").isin("CPU", "GPU", "SOC"))
    each = hot.groupBy(*keys, "group").agg(significant(F.avg("value")).alias("mean"), F.max("value").alias("top"))
    pairs = F.array(F.struct(F.concat(F.lit("Average "), "group").alias("key"), F.col("mean").alias("value")), F.struct(F.concat(F.lit("Hottest "), "group").alias("key"), F.col("top").alias("value")))
    temperatures = each.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.key", F.lit("temperature").alias("type"), "x.value")
    fans = sensors.where("type = 'fan'").groupBy(*keys).agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    fans = fans.select(*keys, F.lit("Fastest fan").alias("key"), F.lit("fan").alias("type"), "value")
    return sensors.select(*keys, "key", "type", "value").unionByName(temperatures).unionByName(fans)


def map_mean(values: Column) -> Column:
    """Mean of a map's values; NULL for an empty one."""
    v = F.map_values(values)
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))


def active_device(paired: Column, connected: Column, levels: Column) -> Column:
    return paired | (connected & (F.size(F.coalesce(levels, F.array().cast("array<string>"))) > 0))


def accessory_levels(entries: DataFrame) -> DataFrame:
    """One row a group of accessories, or an accessory without one: name, address, levels (array of key, value, state).

    entries: ord, name, capacity, address, part, grp, category, charging, parts (array of part, capacity, charging). A group is named by its combined entry,
    else its first one that is no case; its levels are the case, then the combined entry's parts, or without either the battery.
    """
    state = lambda c: F.when(c, "charging").otherwise("discharging")
    level = lambda k, v, c: F.struct(k.alias("key"), v.cast("string").alias("value"), state(F.coalesce(c, F.lit(False))).alias("state"))
    alone = entries.where("grp is null").select("name", "address", F.array(level(F.lit("battery"), F.col("capacity"), F.col("charging"))).alias("levels"))
    entry = F.struct("ord", "name", "capacity", "address", "charging", "parts", "category")
    first = lambda when: F.min_by(F.when(when, entry), F.when(when, F.col("ord")))
    combined, case = F.col("part") == "Combined", (F.col("part") == "Case") | (F.col("category") == "Audio Battery Case")
    not_case = ~F.coalesce(F.col("category"), F.lit("")).contains("Case")
    g = entries.where("grp is not null").groupBy("grp").agg(
        first(F.coalesce(combined, F.lit(False))).alias("combined"), first(F.coalesce(case, F.lit(False))).alias("case"), first(not_case).alias("plain"), first(F.lit(True)).alias("any")
    )
    none = F.array().cast("array<struct<key:string,value:string,state:string>>")
    cases = F.when(F.col("case").isNotNull(), F.array(level(F.lit("case"), F.col("case.capacity"), F.col("case.charging")))).otherwise(none)
    kept = F.filter(F.coalesce("combined.parts", F.array().cast("array<struct<part:string,capacity:int,charging:boolean>>")), lambda p: p["part"].isNotNull() & p["capacity"].isNotNull())
    parts = F.transform(kept, lambda p: level(F.lower(p["part"]), p["capacity"], p["charging"]))
    whole = F.coalesce("combined", "any")
    battery = F.array(level(F.lit("battery"), whole["capacity"], whole["charging"]))
    both = F.concat(cases, parts)
    grouped = g.select(F.coalesce("combined.name", "plain.name", "any.name", F.lit("")).alias("name"), whole["address"].alias("address"), F.when(F.size(both) > 0, both).otherwise(battery).alias("levels"))
    return alone.unionByName(grouped)


def upsert_volumes(known: DataFrame, mounted: DataFrame, now_s: int, ttl_s: int = 60) -> DataFrame:
    """Volumes by BSD name: those that are mounted, with a purgeable size measured ttl_s ago at most carried over, and the fresh one otherwise.

    known: bsd, purgeable, measured_s; mounted: bsd, size, free, purgeable.
    """
    before = known.select("bsd", F.col("purgeable").alias("__p"), F.col("measured_s").alias("__m"))
    fresh = mounted.join(before, "bsd", "left")
    good = F.coalesce(now_s - F.col("__m") < ttl_s, F.lit(False))
    return fresh.select("bsd", "size", "free", F.when(good, F.col("__p")).otherwise(F.col("purgeable")).alias("purgeable"), F.when(good, F.col("__m")).otherwise(F.lit(now_s)).alias("measured_s"))


def driver_counters(volumes: DataFrame, drivers: DataFrame, tick: str = "tick") -> DataFrame:
    """Each volume of a tick with its driver's counters; a driver that has several readings in a tick counts with its first. volumes: tick, bsd, driver; drivers: tick, driver, ord, ..."""
    kept = [c for c in drivers.columns if c not in (tick, "driver")]
    once = drivers.groupBy(tick, "driver").agg(F.min_by(F.struct(*kept), "ord").alias("__r")).select(tick, "driver", "__r.*")
    return volumes.join(once, [tick, "driver"])


def emitted_by(rows: DataFrame, reader: str, metric: str, rules: dict[str, str]) -> DataFrame:
    """Rows whose metric comes from the reader that the rules name for it; other readers' values of it, and metrics without a rule, are left out."""
    right = F.lit(False)
    for name, source in rules.items():
        right = right | ((F.col(metric) == name) & (F.col(reader) == source))
    return rows.where(right)
