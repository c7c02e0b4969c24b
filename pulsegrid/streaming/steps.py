"""Step lanes as a stream: closed buckets, and the last value held for a while after it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import HELD, HOLD_SECONDS, MAX_COUNT, MEASURED

OUT = "lane string, bucket long, count long, min double, max double, sum double, reason long"
STATE = "bucket long, count long, min double, max double, sum double, last_us long, last double"


def stream_step_lanes(samples: DataFrame, step: int, delay: str, hold_s: int = HOLD_SECONDS) -> DataFrame:
    """Slots of step lanes, once they are closed: measured ones, and held ones in the empty buckets that begin within hold_s of the last sample.

    samples: lane, ts (TIMESTAMP), value. A bucket is closed by a sample of a later one, or by the watermark when the hold has run out (the timer); what comes
    for a closed bucket is dropped. All of a lane's rows of a trigger are put in order before they are folded. State: the open bucket and the last sample.
    """
    micro = 1_000_000

    def held(key: str, last: float, last_us: int, end: int) -> list[tuple]:
        first, limit = last_us // (step * micro) + 1, (last_us + hold_s * micro - 1) // (step * micro)
        return [(key, b, 1, last, last, last, HELD) for b in range(first, min(limit + 1, end))]

    def fold(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        out: list[tuple] = []
        open_ = state.get if state.exists else None
        frames = [] if state.hasTimedOut else [pdf[["ts", "value"]] for pdf in batches]
        if state.hasTimedOut:
            bucket, count, low, high, total, last_us, last = open_
            out = [(key[0], bucket, count, low, high, total, MEASURED), *held(key[0], last, last_us, 1 << 62)]
            state.remove()
        rows = pd.concat(frames).sort_values(["ts", "value"], kind="stable") if frames else []
        for ts, value in rows.itertuples(index=False) if frames else ():
            us = ts.value // 1000
            b = us // (step * micro)
            if open_ and b < open_[0]:
                continue
            if open_ and b == open_[0]:
                bucket, count, low, high, total, _, _ = open_
                full = count >= MAX_COUNT
                open_ = (bucket, count + (not full), min(low, value), max(high, value), total + (0 if full else value), us, value)
                continue
            if open_:
                out += [(key[0], *open_[:5], MEASURED), *held(key[0], open_[6], open_[5], b)]
            open_ = (b, 1, value, value, value, us, value)
        if frames and open_:
            state.update(open_)
            state.setTimeoutTimestamp(max(open_[5] // 1000 + hold_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["lane", "bucket", "count", "min", "max", "sum", "reason"]).astype({"bucket": "int64", "count": "int64", "min": "float64", "max": "float64", "sum": "float64", "reason": "int64"})

    return samples.withWatermark("ts", delay).groupBy("lane").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
