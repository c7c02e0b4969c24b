"""Tiers, ranges and gap reasons. Fixed values of the data model."""

from __future__ import annotations

#: tier: (seconds a bucket, buckets kept)
TIERS = {"t0": (10, 8640), "t1": (120, 21600), "t2": (1800, 17520)}
NODATA, MEASURED, ASLEEP, NOT_RUNNING, CLOCK_STEP, HELD = range(6)
REASON_TOKENS = {NODATA: "no_data", MEASURED: "", ASLEEP: "asleep", NOT_RUNNING: "not_running", CLOCK_STEP: "clock_step", HELD: "held"}
#: When spans overlap, the most specific reason holds.
REASON_RANK = {CLOCK_STEP: 3, ASLEEP: 2, NOT_RUNNING: 1}
#: range in seconds: (tier, seconds a column)
RANGES = {3600: ("t0", 10), 21600: ("t0", 30), 86400: ("t1", 120), 604800: ("t1", 1200), 2592000: ("t2", 1800), 31536000: ("t2", 21600)}
MAX_COLUMNS = 1460
MAX_COUNT = 65535
SPAN_BUCKETS = 16
HOLD_SECONDS = 900
SAMPLE_LIFETIME = 10
MAX_LANES = 256
RECLAIM_IDLE = 86_400
SLOT_BYTES = 20
#: first_valid of a lane that nothing was written for.
NO_BUCKET = 4_294_967_295
#: Flags of a lane.
ORPHAN, RECLAIMED = 1, 2
SPAN_RETENTION = 365 * 86_400
DAYS_KEPT = 400
MODULES = ("cpu", "ram", "gpu", "net", "disk", "battery", "sensors")
UNITS = ("percent", "bytesPerSec", "bytes", "celsius", "watts", "volts", "rpm")
KINDS = ("rate", "gauge", "step")
UNIT_SYMBOLS = {"percent": "%", "bytesPerSec": "B/s", "bytes": "B", "celsius": "°C", "watts": "W", "volts": "V", "rpm": "RPM"}
REASONS = ("nodata", "measured", "asleep", "notRunning", "clockStep", "held")
#: range in seconds: seconds between refreshes
REFRESH = {3600: 10, 21600: 10, 86400: 60, 604800: 60, 2592000: 300, 31536000: 300}
