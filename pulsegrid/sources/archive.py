"""Binary history files: a tier's archive (header, lane directory, ring of slots), gap spans, daily counters. Decoders take any bytes and never fail.

A damaged archive gives no lanes and no slots, but its damage: short header, bad magic, bad version, bad checksum, geometry mismatch, truncated. A slot counts
only if its stamp is the bucket that its place in the ring stands for within the newest ring, so bits that flipped in the ring can't be read as data.
Files are read whole, one a row (an archive has some hundred MB at most), and decoded by Arrow batches on the executors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..model import KINDS, MODULES, NO_BUCKET, REASONS, TIERS, UNITS

#: Layout. Fixed values of the file formats; numbers are little-endian, identities are bytes in order.
ARCHIVE_MAGIC, SPANS_MAGIC, DAILY_MAGIC = b"STHS", b"STSP", b"STDY"
VERSION = 1
HEADER_BYTES, ENTRY_BYTES, LABEL_BYTES = 4096, 128, 88
HEADER = struct.Struct("<4sIIIIIQQI")
ENTRY = struct.Struct("<16sBBBBIQB88s7x")
SLOT = np.dtype([("bucket", "<u4"), ("count", "<u2"), ("reason", "u1"), ("spare", "u1"), ("min", "<f4"), ("max", "<f4"), ("sum", "<f4")])
SPAN = np.dtype([("from", "<u8"), ("to", "<u8"), ("reason", "u1"), ("spare", "V7")])
DAY = np.dtype([("day", "<u4"), ("upload", "<i8"), ("download", "<i8"), ("crc", "<u4")])
SIDE_HEADER = 16

LANE_SCHEMA = "path string, damage string, lane int, identity string, module string, unit string, kind string, flags int, first_valid long, last_used long, label string"
SLOT_SCHEMA = "path string, lane int, bucket long, count long, min double, max double, sum double, reason int"


def label_bytes(label: str) -> bytes:
    """UTF-8 cut before the first character that ends beyond LABEL_BYTES."""
    data = label.encode()[:LABEL_BYTES]
    return data.decode("utf-8", "ignore").encode()


def encode_archive(tier: str, lanes: list[dict], slots: np.ndarray, last_bucket: int, anchor: int = 0, created: int = 0) -> bytes:
    """The file of a tier: lanes in order (identity hex, module, unit, kind, flags, first_valid, last_used, label), and slots of SLOT with a lane column beside."""
    step, buckets = TIERS[tier]
    directory = b"".join(
        ENTRY.pack(bytes.fromhex(x["identity"]), MODULES.index(x["module"]), UNITS.index(x["unit"]), KINDS.index(x["kind"]), x["flags"], x["first_valid"], x["last_used"], len(label_bytes(x["label"])), label_bytes(x["label"])) for x in lanes
    )
    header = HEADER.pack(ARCHIVE_MAGIC, VERSION, step, buckets, len(lanes), last_bucket, anchor, created, 0).ljust(HEADER_BYTES, b"\0")
    crc = zlib.crc32(header, zlib.crc32(directory))
    ring = np.zeros(buckets * len(lanes), SLOT)
    if len(slots):
        ring[(slots["bucket"] % buckets) * len(lanes) + slots["lane"]] = slots[list(SLOT.names)]
    return header[:40] + struct.pack("<I", crc) + header[44:] + directory + ring.tobytes()


def damage_of(data: bytes) -> str | None:
    """What makes a file unreadable, in the order in which it is noticed; None for a good one."""
    if len(data) < HEADER_BYTES:
        return "shortHeader"
    magic, version, step, buckets, lanes, _, _, _, crc = HEADER.unpack_from(data)
    if magic != ARCHIVE_MAGIC:
        return "badMagic"
    if version != VERSION:
        return "badVersion"
    if (step, buckets) not in TIERS.values():
        return "geometryMismatch"
    end = HEADER_BYTES + lanes * ENTRY_BYTES
    if len(data) < end:
        return "truncated"
    image = data[:40] + b"\0\0\0\0" + data[44:HEADER_BYTES]
    if zlib.crc32(image, zlib.crc32(data[HEADER_BYTES:end])) != crc:
        return "badChecksum"
    return "truncated" if len(data) < end + buckets * lanes * SLOT.itemsize else None


def decode_lanes(data: bytes) -> list[tuple]:
    if damage_of(data):
        return []
    (lanes,) = struct.unpack_from("<I", data, 16)
    name = lambda names, k: names[k] if k < len(names) else names[0]
    out = []
    for k in range(lanes):
        identity, module, unit, kind, flags, first, used, size, label = ENTRY.unpack_from(data, HEADER_BYTES + k * ENTRY_BYTES)
        try:
            text = label[: min(size, LABEL_BYTES)].decode()
        except UnicodeDecodeError:
            text = ""
        out.append((k, identity.hex(), name(MODULES, module), name(UNITS, unit), KINDS[kind] if kind < len(KINDS) else "gauge", flags, first, used, text))
    return out


def decode_slots(data: bytes) -> np.ndarray:
    """Slots with lane and bucket whose stamp is right, that hold something, at or after their lane's first valid bucket."""
    kind = np.dtype([("lane", "<i4"), *[(n, SLOT[n]) for n in SLOT.names]])
    if damage_of(data):
        return np.zeros(0, kind)
    _, _, _, buckets, lanes, last, _, _, _ = HEADER.unpack_from(data)
    if not lanes:
        return np.zeros(0, kind)
    ring = np.frombuffer(data, SLOT, buckets * lanes, HEADER_BYTES + lanes * ENTRY_BYTES)
    place, lane = np.divmod(np.arange(len(ring)), lanes)
    first = np.array([x[6] for x in decode_lanes(data)], np.int64)
    stamp = ring["bucket"].astype(np.int64)
    good = (stamp % buckets == place) & (stamp <= last) & (stamp > last - buckets) & (stamp >= first[lane]) & (first[lane] != NO_BUCKET)
    good &= (ring["count"] > 0) | ((ring["reason"] != 0) & (ring["reason"] < len(REASONS)))
    out = np.zeros(int(good.sum()), kind)
    out["lane"] = lane[good]
    for n in SLOT.names:
        out[n] = ring[n][good]
    out["reason"][out["reason"] >= len(REASONS)] = 0
    return out


def encode_spans(spans: list[tuple[int, int, int]]) -> bytes:
    rows = np.zeros(len(spans), SPAN)
    for i, (a, b, r) in enumerate(spans):
        rows[i]["from"], rows[i]["to"], rows[i]["reason"] = a, b, r
    return struct.pack("<4sII4x", SPANS_MAGIC, VERSION, len(spans)) + rows.tobytes()


def decode_spans(data: bytes) -> np.ndarray:
    """Spans by start; as many as the header claims and the file holds."""
    if len(data) < SIDE_HEADER or data[:4] != SPANS_MAGIC or struct.unpack_from("<I", data, 4)[0] != VERSION:
        return np.zeros(0, SPAN)
    n = min(struct.unpack_from("<I", data, 8)[0], (len(data) - SIDE_HEADER) // SPAN.itemsize)
    out = np.frombuffer(data, SPAN, n, SIDE_HEADER).copy()
    out["reason"][out["reason"] >= len(REASONS)] = 0
    return out[np.argsort(out["from"], kind="stable")]


def encode_daily(records: list[tuple[int, int, int]]) -> bytes:
    out = struct.pack("<4sI8x", DAILY_MAGIC, VERSION)
    for day, up, down in records:
        part = struct.pack("<Iqq", day, up, down)
        out += part + struct.pack("<I", zlib.crc32(part))
    return out


def decode_daily(data: bytes) -> list[tuple[int, int, int, int, bool]]:
    """(seq, day, upload, download, valid) of every whole record."""
    if len(data) < SIDE_HEADER or data[:4] != DAILY_MAGIC or struct.unpack_from("<I", data, 4)[0] != VERSION:
        return []
    body = data[SIDE_HEADER:]
    return [(i, *struct.unpack_from("<Iqq", body, at), zlib.crc32(body[at : at + 20]) == struct.unpack_from("<I", body, at + 20)[0]) for i, at in enumerate(range(0, len(body) - DAY.itemsize + 1, DAY.itemsize))]


def is_torn(data: bytes) -> bool:
    """Must a daily file be written anew: a wrong front, a part of a record at the end, or a record that fails its checksum or has no day."""
    if len(data) < SIDE_HEADER:
        return False
    return data[:4] != DAILY_MAGIC or struct.unpack_from("<I", data, 4)[0] != VERSION or (len(data) - SIDE_HEADER) % DAY.itemsize != 0 or any(not ok or not day for _, day, _, _, ok in decode_daily(data))


def _decoded(files: DataFrame, decode, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = decode(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b"")
                if columns and len(next(iter(columns.values()))):
                    yield pa.RecordBatch.from_pydict(columns)

    return files.select("path", "content").mapInArrow(run, schema)


def lanes_of(files: DataFrame) -> DataFrame:
    """Lanes of files(path, content); a damaged one gives one row with its damage and no lane."""

    def decode(path: str, data: bytes) -> dict:
        rows = [(path, None, *x) for x in decode_lanes(data)] or [(path, damage_of(data), *[None] * 9)]
        names = ("path", "damage", "lane", "identity", "module", "unit", "kind", "flags", "first_valid", "last_used", "label")
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        return {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))}

    return _decoded(files, decode, LANE_SCHEMA)


def slots_of(files: DataFrame) -> DataFrame:
    """Slots of files(path, content)."""

    def decode(path: str, data: bytes) -> dict:
        s = decode_slots(data)
        kinds = {"lane": np.int32, "bucket": np.int64, "count": np.int64, "min": np.float64, "max": np.float64, "sum": np.float64, "reason": np.int32}
        return {"path": pa.array([path] * len(s), pa.string()), **{n: pa.array(s[n].astype(t)) for n, t in kinds.items()}}

    return _decoded(files, decode, SLOT_SCHEMA)


def spans_of(files: DataFrame) -> DataFrame:
    def decode(path: str, data: bytes) -> dict:
        s = decode_spans(data)
        return {"path": pa.array([path] * len(s), pa.string()), "from_s": pa.array(s["from"].astype(np.int64)), "to_s": pa.array(s["to"].astype(np.int64)), "reason": pa.array(s["reason"].astype(np.int64))}

    return _decoded(files, decode, "path string, from_s long, to_s long, reason long")


def daily_of(files: DataFrame) -> DataFrame:
    """Records in order, with whether they pass their checksum; store.compacted() makes days of them."""

    def decode(path: str, data: bytes) -> dict:
        rows = decode_daily(data)
        names, kinds = ("seq", "day", "upload", "download", "valid"), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return {"path": pa.array([path] * len(rows), pa.string()), **{n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))}}

    return _decoded(files, decode, "path string, seq long, day long, upload long, download long, valid boolean")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def archive_files(slots: DataFrame, lanes: DataFrame, tier: str, shard: str) -> DataFrame:
    """path, content of one archive a shard, from slots(shard, lane, bucket, count, min, max, sum, reason) and lanes(shard, lane, identity, module, unit, kind, flags, first_valid, last_used, label).

    A shard is one machine's history: at most 256 lanes and a ring of slots, some hundred MB.
    """
    import pandas as pd

    def build(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = np.zeros(len(left), np.dtype([("lane", "<i4"), *[(n, SLOT[n]) for n in SLOT.names]]))
        for n in ("lane", "bucket", "count", "min", "max", "sum", "reason"):
            rows[n] = left[n].to_numpy()
        rows["spare"] = 0
        last = int(left["bucket"].max()) if len(left) else 0
        rows = rows[rows["bucket"] > last - TIERS[tier][1]]
        data = encode_archive(tier, right.sort_values("lane").to_dict("records"), rows, last)
        return pd.DataFrame({"path": [f"{key[0]}/{tier}"], "content": [data]})

    return slots.groupBy(shard).cogroup(lanes.withColumnRenamed(shard, "__shard").groupBy("__shard")).applyInPandas(build, "path string, content binary")
