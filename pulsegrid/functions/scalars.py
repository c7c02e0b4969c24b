"""Scalar functions on columns: units, texts, codecs, bands. All are built-in expressions; null in, null out, unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

I64_MAX = 9223372036854775807
#: What a person sees where a value can't be shown. Fixed value.
DASH = "—"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it many times in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fixed(value: Column, places: int) -> Column:
    """The exact binary value in so many places (four at most), half to even, as C's %.nf prints it. From 2^63 on, and for what isn't finite, as format_number prints it.

    The part below one is cut at 26 bits: both pieces times 10^places are exact wherever a tie is near, so that the rest is compared with one half exactly.
    """
    if not 0 <= places <= 4:
        raise ValueError("0 to 4 places")
    scale, cut = 10**places, float(1 << 26)
    pattern = F.lit("0" + ("." + "0" * places if places else ""))

    def text(v: Column) -> Column:
        size = F.abs(v)
        minus = F.when((v < 0) | ((v == 0) & v.cast("string").startswith("-")), "-").otherwise("")
        return F.when(size < 2.0**63, F.concat(minus, let(size, digits_of))).otherwise(F.call_function("format_number", v, pattern))

    def digits_of(size: Column) -> Column:
        return let(F.struct(F.floor(size).alias("n"), (size - F.floor(size)).alias("f")), lambda x: let(F.struct(x["n"].alias("n"), x["f"].alias("f"), (F.floor(x["f"] * cut) / cut).alias("high")), rounded))

    def rounded(x: Column) -> Column:
        scaled = x["high"] * scale
        half = 0.5 - (scaled - F.floor(scaled))
        low = (x["f"] - x["high"]) * scale
        odd = (F.floor(scaled) if places else x["n"]) % 2 == 1
        up = F.when((low > half) | ((low == half) & odd), 1).otherwise(0)
        return let(F.struct(x["n"].alias("n"), (F.floor(scaled) + up).alias("q")), joined)

    def joined(x: Column) -> Column:
        whole = (x["n"] + F.when(x["q"] >= scale, 1).otherwise(0)).cast("string")
        return F.concat(whole, F.lit("."), F.lpad((x["q"] % scale).cast("string"), places, "0")) if places else whole

    return let(value.cast("double"), text)


def half_away(value: Column, places: int = 0) -> Column:
    """Rounded half away from zero on the scaled value."""
    scaled = value * 10.0**places
    return F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / 10.0**places


def whole(value: Column) -> Column:
    """Toward zero, held within 64 bits; 0 for what isn't finite."""
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(~finite, F.lit(0)).when(value >= 2.0**63, F.lit(I64_MAX)).when(value <= -(2.0**63), F.lit(-I64_MAX) - 1).otherwise(value.cast("long")).cast("long")


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def add_saturating(a: Column, b: Column) -> Column:
    """a + b of two counts (none negative), held at the largest 64-bit integer."""
    return F.coalesce(F.try_add(a, b), F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.lit(I64_MAX))).cast("long")


# units
def speed(value: Column, base: str = "byte", unit: str = "auto") -> Column:
    """Bytes a second as text, in bytes or (eight times as many) bits; decimal steps by size, or a fixed unit (KB, MB, GB, TB) with two places."""
    letter, times = ("B", 1) if base == "byte" else ("b", 8)
    steps = {"KB": 1e3, "MB": 1e6, "GB": 1e9, "TB": 1e12}
    if unit.upper() in steps:
        return F.concat(fixed(value / steps[unit.upper()] * times, 2), F.lit(f" {unit.upper()[0]}{letter}/s"))
    v = value.cast("double") * times
    shown = lambda step, places, prefix: F.concat(fixed(v / step, places), F.lit(f" {prefix}{letter}/s"))
    return (
        F.when(v.isNull(), F.lit(None))
        .when(v < 1e3, f"0 K{letter}/s")
        .when(v < 1e6, shown(1e3, 0, "K"))
        .when(v < 1e8, shown(1e6, 1, "M"))
        .when(v < 1e9, shown(1e6, 0, "M"))
        .when(v < 1e12, shown(1e9, 1, "G"))
        .otherwise(shown(1e12, 1, "T"))
    )


def disk_size(value: Column) -> Column:
    """Bytes in whole KB and MB, GB and TB with one place; nothing under 1 KB; negatives in KB."""
    v = value.cast("double")
    return (
        F.when(v < 0, F.concat(fixed(v / 1e3, 0), F.lit(" KB")))
        .when(v < 1e3, "0 KB")
        .when(v < 1e6, F.concat(fixed(v / 1e3, 0), F.lit(" KB")))
        .when(v < 1e9, F.concat(fixed(v / 1e6, 0), F.lit(" MB")))
        .when(v < 1e12, F.concat(fixed(v / 1e9, 1), F.lit(" GB")))
        .otherwise(F.concat(fixed(v / 1e12, 1), F.lit(" TB")))
    )


def unit_text(value: Column, unit: str, fahrenheit_shown: bool = False) -> Column:
    """A lane's value as its axis shows it: percent (of a fraction of 1), rate, bytes, celsius, watts, volts, rpm."""
    count = F.when(value > 0, whole(value)).otherwise(F.lit(0)).cast("long")
    shown = {
        "percent": lambda: F.concat(whole(half_away(value * 100)).cast("string"), F.lit("%")),
        "bytesPerSec": lambda: speed(count),
        "bytes": lambda: disk_size(count),
        "celsius": lambda: F.concat(fixed(fahrenheit(value) if fahrenheit_shown else value, 0), F.lit("°F" if fahrenheit_shown else "°C")),
        "watts": lambda: F.when(value >= 100, F.concat(whole(value).cast("string"), F.lit(" W"))).otherwise(F.concat(fixed(value, 2), F.lit(" W"))),
        "volts": lambda: F.when(value >= 100, F.concat(whole(value).cast("string"), F.lit(" V"))).otherwise(F.concat(fixed(value, 3), F.lit(" V"))),
        "rpm": lambda: F.concat(whole(value).cast("string"), F.lit(" RPM")),
    }[unit]()
    return F.when(finite(value), shown).otherwise(F.lit(DASH))


def duration_text(seconds: Column, short: bool = False) -> Column:
    """'2h 05min', '2h', '05min', short '2:05'; 'n/a' for none and for a minute or more below it."""
    s = seconds.cast("double")
    h, m = (s / 3600).cast("long"), ((s % 3600) / 60).cast("long")
    minutes = F.when(m > 9, m.cast("string")).otherwise(F.concat(F.lit("0"), m.cast("string")))
    if short:
        text = F.concat(h.cast("string"), F.lit(":"), minutes)
    else:
        text = F.when(h == 0, F.concat(minutes, F.lit("min"))).when(m == 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(F.concat(h.cast("string"), F.lit("h "), minutes, F.lit("min")))
    return F.when(s.isNull() | (s == 0) | (h < 0) | (m < 0), "n/a").otherwise(text)


def fahrenheit(celsius: Column) -> Column:
    return celsius * 9 / 5 + 32


def band(share: Column, low: float = 0.6, high: float = 0.8) -> Column:
    return F.when(share < low, "normal").when(share < high, "warning").otherwise("critical")


def battery_band(share: Column, low: float = 0.2, high: float = 0.4) -> Column:
    return F.when(share < low, "critical").when(share < high, "warning").otherwise("normal")


def flag_names(mask: Column, names: list[str]) -> Column:
    """Names of the bits that are set, lowest first, comma-joined."""
    return F.array_join(F.filter(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull()), ",")


def media_mbit(text: Column) -> Column:
    """Mbit from a medium's name: '2500Base-T' 2500, '10GbaseT' 10000; 0 for others."""
    n, giga = F.regexp_extract(text, r"(?i)^([0-9]+)(g?)base", 1), F.regexp_extract(text, r"(?i)^([0-9]+)(g?)base", 2)
    return F.when(n == "", 0).otherwise(n.try_cast("long") * F.when(F.lower(giga) == "g", 1000).otherwise(1)).cast("long")


def pressure_share(level: Column) -> Column:
    """Memory pressure level (1, 2, 4) as a lane value."""
    return level / 2


def fan_percent(value: Column, most: Column) -> Column:
    """Whole percent of a fan's largest speed, from whole numbers; 0 where that is unknown."""
    return F.when(most.cast("long") == 0, F.lit(0)).otherwise(F.call_function("div", 100 * value.cast("long"), most.cast("long"))).cast("long")


# texts
def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\P{Nd}", "")


def condensed(text: Column) -> Column:
    """White space between words becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\u0085 \p{Z}]+", " "))


def trimmed(text: Column) -> Column:
    """Without the control characters and spaces (below 33) at both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def without_blanks(text: Column) -> Column:
    """Without spaces and tabs; line ends stay."""
    return F.regexp_replace(text, r"[\t\p{Zs}]", "")


def find(text: Column, pattern: str) -> Column:
    """The first match, without blanks at its ends; '' if there is none."""
    return F.regexp_replace(F.coalesce(F.regexp_substr(text, F.lit(pattern)), F.lit("")), r"^[\t\p{Zs}]+|[\t\p{Zs}]+$", "")


def find_and_crop(text: Column, pattern: str) -> tuple[Column, Column]:
    """The first match and what is left of the text without it, both without blanks at their ends; the whole text is left if there is no match."""
    ends = r"^[\t\p{Zs}]+|[\t\p{Zs}]+$"
    met = text.rlike(pattern)
    left = F.regexp_replace(F.array_join(F.split(text, pattern, 2), ""), ends, "")
    return find(text, pattern), F.when(met, left).otherwise(text)


def replaced(text: Column, pattern: str, by: str = "") -> Column:
    """All matches, whatever their case, replaced."""
    return F.regexp_replace(text, f"(?i){pattern}", by)


def truncated(text: Column, size: int = 88) -> Column:
    """The longest front part of at most `size` bytes of UTF-8 that cuts no character. The front part of `size` characters is always long enough to look at."""
    front = F.substring(text, 1, size)
    ends = F.aggregate(
        F.transform(F.split(front, ""), lambda c: F.octet_length(c)),
        F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars"), F.lit(False).alias("full")),
        lambda a, n: F.when(a["full"] | (a["bytes"] + n > size), F.struct(a["bytes"].alias("bytes"), a["chars"].alias("chars"), F.lit(True).alias("full"))).otherwise(
            F.struct((a["bytes"] + n).alias("bytes"), (a["chars"] + F.when(n > 0, 1).otherwise(0)).alias("chars"), F.lit(False).alias("full"))
        ),
    )["chars"]
    return F.when(F.octet_length(text) <= size, text).otherwise(F.substring(text, F.lit(1), ends))


def label(name: Column, *fallbacks: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (name, *fallbacks)])


def country_flag(code: Column) -> Column:
    """The flag of a two-letter country code: each letter moved to the regional indicators. NULL for codes of other lengths."""
    upper = F.upper(code)
    place = lambda k: F.ascii(F.substring(upper, k, 1)) + 127397 - 0x10000
    half = lambda k: F.concat(F.lpad(F.hex((place(k) / 1024).cast("int") + 0xD800), 4, "0"), F.lpad(F.hex(place(k) % 1024 + 0xDC00), 4, "0"))
    return F.when(F.length(upper) == 2, F.decode(F.unhex(F.concat(half(1), half(2))), "UTF-16BE"))


def escape_field(text: Column) -> Column:
    """Percent, comma and dollar signs as %25, %2C, %24."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit(","), F.lit("%2C")), F.lit("$"), F.lit("%24"))


def ipv4(text: Column) -> Column:
    """Four whole numbers from 0 to 255 between dots (empty parts don't count)."""
    parts = F.filter(F.split(text, r"\."), lambda x: x != "")
    numbers = F.transform(parts, lambda x: F.when(x.rlike("^[+-]?[0-9]+$"), x.try_cast("int")))
    return (F.size(parts) == 4) & F.forall(numbers, lambda n: F.coalesce(n.between(0, 255), F.lit(False)))


def local_address(v4: Column, v6: Column) -> Column:
    """The address to show: v4, else v6 unless it is link-local."""
    return F.coalesce(F.nullif(v4, F.lit("")), F.when(~v6.startswith("fe80::"), F.nullif(v6, F.lit(""))))


def top_line(line: Column) -> dict[str, Column]:
    """pid, name and bytes of a process line 'pid[*] name size[K|M|G][+]'."""
    pattern = r"^([0-9]+)\*?\s+(.*?)\s+([0-9]+)([KMG])[+-]?\s*$"
    part = lambda k: F.regexp_extract(line, pattern, k)
    size, unit = part(3).try_cast("double"), part(4)
    # a five-character M value counts in binary
    mega = F.when(unit == "G", size * 1024).when(unit == "K", size / 1024).when(F.length(F.concat(part(3), unit)) == 5, size / 1024 * 1000).otherwise(size)
    return {"pid": part(1).try_cast("long"), "name": part(2), "bytes": mega * 1e6}


# versions
def version_parts(version: Column) -> Column:
    """struct(major, minor, patch, fork, beta): numbers between dots, 0 where there is none; beta is null for a release."""
    parts = F.filter(F.split(condensed(F.replace(version, F.lit("v"), F.lit(""))), r"\."), lambda x: x != "")
    number = lambda x: F.coalesce(F.when(x.rlike("^[+-]?[0-9]+$"), x.try_cast("long")), F.lit(0))

    def of(p: Column) -> Column:
        last = F.element_at(p, -1)
        tail = F.filter(F.split(last, "-"), lambda x: x != "")
        cut = last.contains("-")
        patch = F.when(cut, number(F.get(tail, F.lit(0)))).otherwise(number(F.get(p, F.lit(2))))
        beta = F.when(cut, number(F.replace(F.element_at(tail, -1), F.lit("beta"), F.lit(""))))
        return F.struct(number(F.get(p, F.lit(0))).alias("major"), number(F.get(p, F.lit(1))).alias("minor"), patch.alias("patch"), number(F.get(p, F.lit(3))).alias("fork"), beta.alias("beta"))

    return let(parts, of)


def is_newer(current: Column, latest: Column) -> Column:
    """Is `latest` to be offered to one who has `current`? A beta gives way to the release or beta of the same numbers; no release gives way to a beta."""

    def judged(x: Column) -> Column:
        c, n = x["c"], x["n"]
        major, minor = n["major"] >= c["major"], n["minor"] >= c["minor"]
        front = (n["major"] > c["major"]) | ((n["minor"] > c["minor"]) & major)
        patch, same = (n["patch"] > c["patch"]) & minor & major, (n["patch"] >= c["patch"]) & minor & major
        release = front | patch | ((n["fork"] > c["fork"]) & same)
        return F.when(c["beta"].isNull() & n["beta"].isNull(), release).when(c["beta"].isNull(), F.lit(False)).otherwise(front | same)

    return let(F.struct(version_parts(current).alias("c"), version_parts(latest).alias("n")), judged)


def version_key(version: Column) -> Column:
    """A text key whose order is that of versions: three numbers and the fork's, betas before their release."""
    pad = lambda x: F.lpad(x.cast("string"), 9, "0")
    return let(version_parts(version), lambda v: F.concat(pad(v["major"]), pad(v["minor"]), pad(v["patch"]), F.coalesce(pad(v["beta"]), F.lit("999999999")), pad(v["fork"])))


# binary
#: Divisors of the 16-bit fixed-point formats. Fixed values of the wire format.
SMC_DIVISORS = {"sp1e": 16384, "sp3c": 4096, "sp4b": 2048, "sp5a": 1024, "sp69": 512, "sp78": 256, "sp87": 128, "sp96": 64, "spa5": 32, "spb4": 16, "spf0": 1}
#: Keys that may be all zero. Fixed values.
SMC_ZERO_KEYS = ("FS! ", "F0Md", "F1Md", "F0md", "F1md")


def smc_decode(kind: Column, hexed: Column, key: Column | None = None) -> Column:
    """Big-endian integers and fixed-point numbers, and little-endian floats, from hex. NULL for unknown kinds, no bytes, and zero bytes but for SMC_ZERO_KEYS."""
    byte = lambda k: F.conv(F.substring(hexed, 2 * k + 1, 2), 16, 10).cast("long")
    kind = F.rpad(kind, 4, " ")
    pair = byte(0) * 256 + byte(1)
    bits = F.conv(F.concat(*[F.substring(hexed, 2 * k + 1, 2) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
    value = F.when(kind == "ui8 ", byte(0).cast("double")).when(kind == "ui16", pair.cast("double")).when(kind == "ui32", (pair * 65536 + byte(2) * 256 + byte(3)).cast("double"))
    value = value.when(kind == "fpe2", (byte(0) * 64 + (byte(1) / 4).cast("long")).cast("double")).when(kind == "flt ", float_of_bits(bits))
    for k, d in SMC_DIVISORS.items():
        value = value.when(kind == k, pair / F.lit(float(d)))
    zero_allowed = key.isin(*SMC_ZERO_KEYS) if key is not None else F.lit(False)
    return F.when((F.length(hexed) > 0) & (~hexed.rlike("^0*$") | zero_allowed), value)


def float_of_bits(bits: Column) -> Column:
    """The 32-bit float of these bits, as a double; NULL for NaN and infinities."""
    sign = F.when(bits.bitwiseAND(F.lit(1 << 31)) != 0, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit((1 << 23) - 1))
    normal = (1 + fraction / float(1 << 23)) * F.pow(F.lit(2.0), exponent - 127)
    return F.when(exponent == 255, F.lit(None)).when(exponent == 0, sign * fraction * 2.0**-149).otherwise(sign * normal).cast("double")


def voltage_states(hexed: Column, divisor: int | Column = 1_000_000) -> Column:
    """MHz of each 8-byte state: its first four bytes, little-endian, through the divisor (1,000,000, or 1,000 on newer chips; a column where rows are of several chips). A last piece of under 4 bytes is none."""
    starts = F.sequence(F.lit(0), F.floor((F.length(hexed) / 2 - 4) / 8).cast("int"))
    word = lambda i: F.conv(F.concat(*[F.substring(hexed, i * 16 + 2 * k + 1, F.lit(2)) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
    return F.when(F.length(hexed) < 8, F.array().cast("array<int>")).otherwise(F.transform(starts, lambda i: F.floor(word(i) / divisor).cast("int")))


def checksum(data: Column) -> Column:
    """CRC-32 of bytes, unsigned."""
    return F.crc32(data)


# axes
def nice_bound(value: Column, up: bool = True) -> Column:
    """An axis bound of 1, 2, 2.5, 5 or 10 times a power of ten, outward of the value: up for the upper bound, down for the lower. 0 for 0 and for what isn't finite."""
    size = F.abs(value)
    power = F.pow(F.lit(10.0), F.floor(F.log10(size)))
    share = F.round(size / power, 12)
    above = F.when(share <= 1, 1.0).when(share <= 2, 2.0).when(share <= 2.5, 2.5).when(share <= 5, 5.0).otherwise(10.0)
    below = F.when(share >= 10, 10.0).when(share >= 5, 5.0).when(share >= 2.5, 2.5).when(share >= 2, 2.0).otherwise(1.0)
    outward = (value > 0) if up else (value < 0)
    return F.when(finite(value) & (value != 0), F.signum(value) * F.when(outward, above).otherwise(below) * power).otherwise(F.lit(0.0))


def axis_bounds(low: Column, high: Column, unit: Column) -> tuple[Column, Column]:
    """Lower and upper bound of an axis over lanes of one unit: 0 to 1 for percent and for nothing; from 0 unless the data are below it or are temperatures."""
    plain = (unit == "percent") | low.isNull()
    lower = F.when(F.coalesce(plain, F.lit(False)), 0.0).when(F.coalesce(unit == "celsius", F.lit(False)) | (low < 0), nice_bound(low, up=False)).otherwise(0.0)
    upper = nice_bound(high)
    return lower, F.when(F.coalesce(plain, F.lit(False)), 1.0).when(upper > lower, upper).otherwise(lower + 1)


def chart_scale(value: Column, most: Column, scale: str, height: float = 1.0, zero: float = 0.01, limit: float = 1.0) -> Column:
    """Height of a value in a chart: as it is (none), a share of the largest (linear), of their square or cube roots, of their logarithms over `zero`, or of a fixed limit."""
    root = {"square": F.sqrt, "cube": F.cbrt, "logarithmic": lambda x: F.log(x / zero)}.get(scale)
    if scale == "none":
        return F.when((value > 1) & (most != 0), value / most).otherwise(value) * height
    if root:
        value, most = F.when(value > 0, root(F.when(value > 0, value))).otherwise(value), F.when(most > 0, root(F.when(most > 0, most))).otherwise(most)
    if scale == "fixed":
        value, most = F.least(value, F.lit(limit)), F.lit(limit)
    return height * F.greatest(value, F.lit(0.0)) / F.when(most <= 0, F.lit(1.0)).otherwise(most)


# zones and keys
def zone_id(text: Column, local: str = "UTC") -> Column:
    """A zone's name from 'local', a name, or hours[:minutes] from UTC ('-3:30'); what is none of these is local."""
    hours, minutes = F.split(text, ":"), F.regexp_extract(text, r"^[+-]?[0-9]+:([0-9]+)", 1)
    h = F.when(F.get(hours, F.lit(0)).rlike("^[+-]?[0-9]+$"), F.get(hours, F.lit(0)).try_cast("int"))
    seconds = h * 3600 + F.when(h < 0, -1).otherwise(1) * F.coalesce(minutes.try_cast("int"), F.lit(0)) * 60
    at = F.abs(seconds)
    offset = F.concat(F.when(seconds < 0, "-").otherwise("+"), F.lpad(F.floor(at / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(at % 3600 / 60).cast("string"), 2, "0"))
    return F.when(text.rlike("^[A-Z][A-Za-z_]+(/[A-Za-z_+-]+[0-9]*)*$"), text).when(h.isNotNull() & (at <= 18 * 3600), offset).otherwise(F.lit(local))


def in_zone(utc: Column, zone: Column | str) -> Column:
    """Wall-clock time (TIMESTAMP_NTZ) of a UTC wall-clock time in a zone. Doesn't depend on the session's zone."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.call_function("convert_timezone", F.lit("UTC"), zone, utc.cast("timestamp_ntz"))


def from_zone(wall: Column, zone: Column | str) -> Column:
    """UTC wall-clock time of a zone's wall-clock time."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.call_function("convert_timezone", zone, F.lit("UTC"), wall.cast("timestamp_ntz"))


def day_key(utc: Column, zone: Column | str) -> Column:
    """YYYYMMDD of the zone's calendar."""
    wall = in_zone(utc, zone)
    return (F.year(wall) * 10000 + F.month(wall) * 100 + F.day(wall)).cast("int")


def day_bounds(utc: Column, zone: str) -> tuple[Column, Column]:
    """UTC times at which the zone's day begins and ends: 23 or 25 hours apart when its clocks change."""
    start = F.call_function("date_trunc", F.lit("DAY"), in_zone(utc, zone)).cast("timestamp_ntz")
    return from_zone(start, zone), from_zone(start + F.expr("INTERVAL 1 DAY"), zone)


#: Front of the keys of the minute store, and what is added to their times so that none is negative. Fixed values.
KEY_FRONT = "history@v2@"
KEY_BIAS = 1 << 63


def _biased() -> Column:
    return F.lit(str(KEY_BIAS)).cast("decimal(20,0)")


def bucket_key(name: Column, ts: Column) -> Column:
    """Keys whose order as text is that of time: a base64 name, and the time plus the bias in 20 digits."""
    number = (ts.cast("decimal(20,0)") + _biased()).cast("decimal(20,0)").cast("string")
    return F.concat(F.lit(KEY_FRONT), F.base64(F.encode(name, "UTF-8")), F.lit("@"), F.lpad(number, 20, "0"))


def bucket_key_parts(key: Column) -> tuple[Column, Column]:
    """name and ts of a key; NULL for what is none."""
    pattern = "^" + KEY_FRONT + "([A-Za-z0-9+/=]*)@([0-9]{20})$"
    name, number = (F.regexp_extract(key, pattern, k) for k in (1, 2))
    met = key.rlike(pattern)
    ts = (number.try_cast("decimal(20,0)") - _biased()).try_cast("long")
    return F.when(met, F.decode(F.unbase64(F.when(met, name)), "UTF-8")), F.when(met, ts)
