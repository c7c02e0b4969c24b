"""CSV of columns: a line a column, minimum, average and maximum of each lane, and why there is nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, fixed, in_zone
from ..model import HELD, MEASURED, NODATA, REASON_TOKENS, UNIT_SYMBOLS

NEWLINE = "\r\n"


def quoted(text: Column) -> Column:
    """RFC 4180: quoted if it holds a comma, a quote or a line end; quotes doubled."""
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def two_places(value: Column, unit: Column | None = None) -> Column:
    """The exact binary value with two places, percents times 100; empty for none and for what isn't finite."""
    scaled = F.when(unit == "percent", value * 100).otherwise(value) if unit is not None else value
    return F.when(finite(value), fixed(scaled, 2)).otherwise("")


def stamp(seconds: Column, zone: str = "UTC") -> Column:
    """Local time of a zone with its offset in figures, +00:00 for UTC; not bound to the session's zone."""
    utc = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("timestamp_ntz")
    utc = utc + F.make_dt_interval(secs=(seconds % 86400).cast("decimal(18,6)"))
    wall = in_zone(utc, zone)
    offset = _minutes(wall) - _minutes(utc)
    sign = F.when(offset < 0, "-").otherwise("+")
    part = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), sign, part(F.floor(F.abs(offset) / 60)), F.lit(":"), part(F.abs(offset) % 60))


def _minutes(wall: Column) -> Column:
    return F.datediff(wall, F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour(wall) * 60 + F.minute(wall)


def token(reason: Column) -> Column:
    out = F.lit(REASON_TOKENS[NODATA])
    for code, name in REASON_TOKENS.items():
        out = F.when(reason == code, name).otherwise(out)
    return out


def row_reason(ordered: Column) -> Column:
    """Why a row of lanes (array of struct(reason, count), in order) is as it is: measured if a lane is, else held, else the first reason that isn't no data."""
    measured = F.exists(ordered, lambda x: F.coalesce((x["count"] > 0) & (x["reason"] == MEASURED), F.lit(False)))
    held = F.exists(ordered, lambda x: F.coalesce(x["reason"] == HELD, F.lit(False)))
    gaps = F.filter(F.transform(ordered, lambda x: x["reason"]), lambda r: F.coalesce(r != NODATA, F.lit(False)))
    return F.when(measured, MEASURED).when(held, HELD).otherwise(F.coalesce(F.get(gaps, F.lit(0)), F.lit(NODATA)))


def csv_lines(columns: DataFrame, lanes: DataFrame, zone: str = "UTC") -> DataFrame:
    """column, line: column -1 is the heading. columns: lane, column, start_s, min, avg, max, count, reason; lanes: lane, pos, label, unit (those shown, in order)."""
    shown = columns.join(F.broadcast(lanes), "lane")
    cells = F.concat_ws(",", *[F.when(F.col("count") > 0, two_places(F.col(c), F.col("unit"))).otherwise("") for c in ("min", "avg", "max")])
    rows = shown.groupBy("column", "start_s").agg(F.sort_array(F.collect_list(F.struct("pos", cells.alias("cells"), F.struct("reason", "count").alias("why")))).alias("l"))  # a list as long as the lanes shown
    body = rows.select("column", F.concat_ws(",", stamp(F.col("start_s"), zone), F.array_join(F.transform("l", lambda x: x["cells"]), ","), token(row_reason(F.transform("l", lambda x: x["why"])))).alias("line"))
    symbol = F.create_map(*[F.lit(x) for pair in UNIT_SYMBOLS.items() for x in pair])[F.col("unit")]
    fields = F.transform(F.array(F.lit("min"), F.lit("avg"), F.lit("max")), lambda f: quoted(F.concat(F.col("label"), F.lit(" "), f, F.lit(" ("), symbol, F.lit(")"))))
    names = lanes.agg(F.sort_array(F.collect_list(F.struct("pos", F.array_join(fields, ",").alias("cells")))).alias("l"))
    heading = names.select(F.lit(-1).cast("long").alias("column"), F.concat_ws(",", F.lit("timestamp"), F.when(F.size("l") > 0, F.array_join(F.transform("l", lambda x: x["cells"]), ",")), F.lit("gap")).alias("line"))
    return heading.unionByName(body)


def write_csv(lines: DataFrame, path: str) -> None:
    """The document as one file of UTF-8 without a byte order mark, CRLF after every line. A document has some thousand lines at most (MAX_COLUMNS)."""
    lines.orderBy("column").select("line").coalesce(1).write.option("lineSep", NEWLINE).text(path)
