"""Line records of the remote protocol: comma-separated fields, a dollar sign at the end. NULL where a payload has nothing to say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import escape_field, half_away, whole

#: Codes of sensor types in records. Fixed values.
END = "$"


def number(value: Column) -> Column:
    """A double as text: the shortest digits that read back as the same value; whole values with '.0'."""
    return value.cast("double").cast("string")


def rounded4(value: Column) -> Column:
    return number(half_away(value, 4))


def cpu_record(total: Column, per_core: Column) -> Column:
    """1,1,total,cores,core...$ with four places."""
    cores = F.transform(per_core, rounded4)
    return F.concat(F.concat_ws(",", F.lit("1"), F.lit("1"), rounded4(total), F.size(per_core).cast("string"), cores), F.lit(END))


def load_record(load1: Column, load5: Column, load15: Column) -> Column:
    return F.concat(F.concat_ws(",", F.lit("1"), F.lit("1"), number(load1), number(load5), number(load15)), F.lit(END))


def memory_record(total: Column, used: Column, swap: Column) -> Column:
    """total,used,,swap$ in whole bytes; NULL if one isn't whole."""
    exact = lambda v: v == F.floor(v)
    text = F.concat(whole(total).cast("string"), F.lit(","), whole(used).cast("string"), F.lit(",,"), whole(swap).cast("string"), F.lit(END))
    return F.when(exact(total) & exact(used) & exact(swap), text)


def network_record(interface: Column, download: Column, upload: Column, local4: Column, local6: Column, remote4: Column, remote6: Column) -> Column:
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.concat_ws(",", F.lit("1"), empty(interface), F.lit("1"), download.cast("string"), upload.cast("string"), *[empty(c) for c in (local4, local6, remote4, remote6)]), F.lit(END))


def gpu_records(gpus: Column) -> Column:
    """count,id,1,utilization,render,tiler,,...$ of array<struct<id, utilization, render, tiler>>."""
    zero = lambda c: number(F.coalesce(c, F.lit(0.0)))
    one = lambda g: F.concat(F.concat_ws(",", F.coalesce(F.nullif(g["id"], F.lit("")), F.lit("0")), F.lit("1"), zero(g["utilization"]), zero(g["render"]), zero(g["tiler"])), F.lit(",,"))
    return F.concat(F.concat_ws(",", F.size(gpus).cast("string"), F.transform(gpus, one)), F.lit(END))


def disk_records(disks: Column) -> Column:
    """count,id,size,used,,read,write...$ of array<struct<id, size, free, read, write, removable>> without the removable ones."""
    fixed = F.filter(disks, lambda d: ~d["removable"])
    one = lambda d: F.concat_ws(",", d["id"], d["size"].cast("string"), (d["size"] - d["free"]).cast("string"), F.lit(""), d["read"].cast("string"), d["write"].cast("string"))
    return F.concat(F.concat_ws(",", F.size(fixed).cast("string"), F.transform(fixed, one)), F.lit(END))


def battery_record(available: Column, level: Column, source: Column, charging: Column, health: Column, capacity: Column, design: Column, cycles: Column) -> Column:
    power = F.when(source == "AC Power", "ac").when(source == "Battery Power", "battery").otherwise(source)
    shown = F.when((design > 1) & (capacity > 1), health.cast("string")).otherwise("")
    text = F.concat(F.concat_ws(",", number(level), power, charging.cast("int").cast("string"), shown, cycles.cast("string")), F.lit(END))
    return F.when(F.coalesce(available, F.lit(False)), text)


def sensor_records(sensors: Column) -> Column:
    """count,key,name,code,value...$ of array<struct<key, name, code, value, known>> with finite values of known groups; keys and names are escaped."""
    kept = F.filter(sensors, lambda s: s["known"] & ~F.isnan(s["value"]) & (F.abs(s["value"]) < float("inf")))
    one = lambda s: F.concat_ws(",", escape_field(s["key"]), escape_field(s["name"]), s["code"].cast("string"), number(s["value"]))
    return F.concat(F.concat_ws(",", F.size(kept).cast("string"), F.transform(kept, one)), F.lit(END))
