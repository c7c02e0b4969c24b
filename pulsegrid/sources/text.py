"""Text and markup that tools print, as columns: process tables, load averages, thermal limits, device lists, event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import digits, find_and_crop

EDGES = r"^[\t\p{Zs}]+|[\t\p{Zs}]+$"


def lines(text: Column) -> Column:
    """array of a text's lines, without empty ones."""
    return F.filter(F.split(text, r"\r?\n"), lambda x: x != "")


def process_lines(text: Column) -> Column:
    """array<struct<ord, line>> of a table's lines below its heading."""
    return F.transform(F.slice(lines(text), 2, 1 << 30), lambda x, i: F.struct(i.alias("ord"), x.alias("line")))


def ps_line(line: Column) -> dict[str, Column]:
    """pid, name, usage of 'pid percent command'; commas count as points."""
    pid, left = find_and_crop(F.regexp_replace(line, EDGES, ""), r"^\d+")
    usage, name = find_and_crop(left, r"^[0-9,.]+ ")
    return {"pid": F.coalesce(pid.try_cast("long"), F.lit(0)), "name": F.regexp_replace(name, EDGES, ""), "usage": F.coalesce(F.replace(usage, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))}


def nettop_line(line: Column) -> dict[str, Column]:
    """pid, name, download, upload of 'name.pid,in,out,...'; all NULL for less than three fields. A process without a name is called by its pid."""
    fields = F.filter(F.split(line, ","), lambda x: x != "")
    whole = F.size(fields) >= 3
    head = F.filter(F.split(F.get(fields, F.lit(0)), r"\."), lambda x: x != "")
    pid = F.coalesce(F.element_at(head, -1).try_cast("long"), F.lit(0))
    name = F.array_join(F.slice(head, F.lit(1), F.greatest(F.size(head) - 1, F.lit(0))), ".")
    count = lambda k: F.coalesce(F.when(F.get(fields, F.lit(k)).rlike("^[+-]?[0-9]+$"), F.get(fields, F.lit(k)).try_cast("long")), F.lit(0))
    parts = {"pid": pid, "name": F.when(name == "", pid.cast("string")).otherwise(name), "download": count(1), "upload": count(2)}
    return {k: F.when(whole, v) for k, v in parts.items()}


def process_bandwidth(rows: DataFrame, key: str, line: str) -> DataFrame:
    """download and upload summed over a key's process lines."""
    parsed = nettop_line(F.col(line))
    each = rows.select(key, parsed["download"].alias("download"), parsed["upload"].alias("upload"))
    return each.groupBy(key).agg(F.coalesce(F.sum("download"), F.lit(0)).alias("download"), F.coalesce(F.sum("upload"), F.lit(0)).alias("upload"))


def load_averages(text: Column) -> Column:
    """array of the three averages at the end of the first line of a text; NULL without three. Commas count as points."""
    first = F.regexp_replace(F.get(lines(text), F.lit(0)), EDGES, "")
    cropped, _ = find_and_crop(first, r"(\d+(.|,)\d+ *){3}$")
    parts = F.filter(F.split(cropped, " "), lambda x: x != "")
    values = F.transform(parts, lambda x: F.coalesce(F.replace(x, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0)))
    return F.when(F.size(parts) == 3, values)


def thermal_limits(text: Column) -> Column:
    """struct(scheduler, cpus, speed) from the lines after the third: the last line that names each, by all its digits. NULL for three lines or less."""
    all_lines = lines(text)
    rest = F.slice(all_lines, 4, 1 << 30)
    kinds = {"scheduler": lambda x: x.contains("Scheduler"), "cpus": lambda x: x.contains("CPUs") & ~x.contains("Scheduler"), "speed": lambda x: x.contains("Speed") & ~x.contains("Scheduler") & ~x.contains("CPUs")}

    def last(test) -> Column:
        values = F.filter(F.transform(F.filter(rest, test), lambda x: digits(x).try_cast("long")), lambda v: v.isNotNull())
        return F.when(F.size(values) > 0, F.element_at(values, -1))

    return F.when(F.size(all_lines) > 3, F.struct(*[last(t).alias(k) for k, t in kinds.items()]))


#: Names of battery levels in a device list, in order. Fixed values.
LEVEL_KEYS = ("device_batteryLevelCase", "device_batteryLevelLeft", "device_batteryLevelRight", "Left Battery Level", "Right Battery Level", "device_batteryLevelMain")


def device_address(address: Column) -> Column:
    return F.lower(F.replace(F.coalesce(address, F.lit("")), F.lit(":"), F.lit("-")))


def profiler_devices(rows: DataFrame, json: str) -> DataFrame:
    """Devices of a profiler's JSON list: the rows' other columns, name, address, connected, levels (array of key, value without '%'). Connected ones are those of the first list element."""
    device = "map<string,map<string,string>>"
    parsed = F.from_json(F.col(json), f"SPBluetoothDataType array<struct<device_connected:array<{device}>,device_not_connected:array<{device}>>>")
    data = rows.withColumn("__d", F.get(parsed["SPBluetoothDataType"], F.lit(0)))
    keep = [c for c in rows.columns if c != json]
    on = data.select(*keep, F.explode(F.get(F.col("__d.device_connected"), F.lit(0))).alias("name", "__p"), F.lit(True).alias("connected"))
    off = data.select(*keep, F.explode("__d.device_not_connected").alias("__m")).select(*keep, F.explode("__m").alias("name", "__p"), F.lit(False).alias("connected"))
    level = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.replace(F.col("__p")[k], F.lit("%"), F.lit("")).alias("value")) for k in LEVEL_KEYS]), lambda x: x["value"].isNotNull())
    both = on.unionByName(off)
    return both.select(*keep, "name", device_address(F.col("__p")["device_address"]).alias("address"), "connected", level.alias("levels"))


def plist_entries(rows: DataFrame, text: str) -> DataFrame:
    """Accessories of concatenated property lists: the rows' other columns, ord, name, capacity, address, part, grp, category, charging, vendor, product, parts.

    Each list begins with '<?xml'; one without a name, a whole capacity and an identifier is left out. Unknown charging follows the power source's state.
    """
    keep = [c for c in rows.columns if c != text]
    chunks = F.filter(F.split(F.col(text), r"<\?xml"), lambda x: F.trim(x) != "")
    each = rows.select(*keep, F.posexplode(chunks).alias("ord", "__x"))
    # only the list itself: no declaration, no document type
    body = each.withColumn("__x", F.regexp_extract("__x", r"(?s)(<plist.*</plist>)", 1)).where("__x <> ''")
    after = lambda k: f"/plist/dict/key[.='{k}']/following-sibling::*[1]"
    text_of = lambda k: F.nullif(F.xpath_string("__x", F.lit(after(k) + "[self::string]")), F.lit(""))
    int_of = lambda k: F.xpath_string("__x", F.lit(after(k) + "[self::integer]")).try_cast("int")
    flag = lambda k: F.xpath_string("__x", F.lit(f"name({after(k)})"))
    charging = F.when(flag("Is Charging").isin("true", "false"), flag("Is Charging") == "true").otherwise(F.coalesce(text_of("Power Source State") == "AC Power", F.lit(False)))
    inner = "/plist/dict/key[.='Combined Parts']/following-sibling::*[1][self::array]/dict"
    part = lambda k: F.xpath("__x", F.lit(f"{inner}/key[.='{k}']/following-sibling::*[1]/text()"))
    states = F.xpath("__x", F.lit(f"{inner}/key[.='Is Charging']/following-sibling::*[1][self::true]/preceding-sibling::key[.='Part Identifier']/following-sibling::*[1]/text()"))
    parts = F.zip_with(part("Part Identifier"), part("Current Capacity"), lambda a, b: F.struct(a.alias("part"), b.try_cast("int").alias("capacity"), F.array_contains(states, a).alias("charging")))
    return body.select(
        *keep, "ord", text_of("Name").alias("name"), int_of("Current Capacity").alias("capacity"), text_of("Accessory Identifier").alias("address"), text_of("Part Identifier").alias("part"),
        text_of("Group Identifier").alias("grp"), text_of("Accessory Category").alias("category"), charging.alias("charging"), int_of("Vendor ID").alias("vendor"), int_of("Product ID").alias("product"), parts.alias("parts"),
    ).where("name is not null and capacity is not null and address is not null")


def list_items(rows: DataFrame, json: str, schema: str) -> DataFrame:
    """Elements of JSON arrays, one a row with ord and the element's fields; text that is no such array gives none."""
    keep = [c for c in rows.columns if c != json]
    return rows.select(*keep, F.posexplode(F.from_json(F.col(json), f"array<struct<{schema}>>")).alias("ord", "__x")).select(*keep, "ord", "__x.*")


def sse_frames(buffer: Column) -> tuple[Column, Column]:
    """Frames of an event stream's bytes so far (each ended by an empty line), and what is left for the next read."""
    parts = F.split(buffer, "\n\n", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)


def sse_data(frame: Column) -> Column:
    """array of the data lines' payloads in a frame; empty ones are left out."""
    trimmed = F.transform(F.split(frame, "\n"), lambda x: F.regexp_replace(x, EDGES, ""))
    return F.filter(F.transform(F.filter(trimmed, lambda x: x.startswith("data:")), lambda x: F.regexp_replace(F.substring(x, 6, 1 << 30), EDGES, "")), lambda x: x != "")


def retry_delay(attempt: Column, most: float = 60.0) -> Column:
    """Seconds before the next attempt: doubled each time, up to a minute."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(most))
