"""Structured Streaming: the fold with a watermark, and state by lane. State lives in the checkpoint folder that the caller names."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_fold(samples: DataFrame, seconds: int, delay: str) -> DataFrame:
    """lane, start, count, min, max, sum of each tumbling window, once it is closed. samples: lane, ts (TIMESTAMP), value."""
    windows = samples.withWatermark("ts", delay).groupBy("lane", F.window("ts", f"{seconds} seconds").alias("w"))
    return windows.agg(F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum")).select("lane", F.col("w.start").alias("start"), "count", "min", "max", "sum")


def _in_order(batches: Iterator) -> Iterator:
    """(ts, value) of all a key's rows of a trigger, in order of time: a key with more rows than an Arrow batch comes in several frames that overlap."""
    import pandas as pd

    return pd.concat([pdf[["ts", "value"]] for pdf in batches]).sort_values(["ts", "value"], kind="stable").itertuples(index=False)


def stream_streaks(samples: DataFrame, threshold: float, streak: int) -> DataFrame:
    """Alerts by lane: fires when `streak` samples in a row reach the threshold, once until a lower one clears it. State: length of the run, whether it has fired."""

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        run, fired = state.get if state.exists else (0, False)
        out = []
        for ts, value in _in_order(batches):
            if value < threshold:
                run, fired = 0, False
            else:
                run += 1
                if run >= streak and not fired:
                    fired = True
                    out.append((key[0], ts, value))
        state.update((run, fired))
        yield pd.DataFrame(out, columns=["lane", "ts", "value"])

    return samples.groupBy("lane").applyInPandasWithState(step, "lane string, ts timestamp, value double", "run long, fired boolean", "append", GroupStateTimeout.NoTimeout)


def stream_hold(samples: DataFrame) -> DataFrame:
    """Each sample with its lane's value before: the state a held step value needs. lane, ts, value, previous."""

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        last = state.get[0] if state.exists else None
        out = []
        for ts, value in _in_order(batches):
            out.append((key[0], ts, value, last))
            last = value
        state.update((last,))
        yield pd.DataFrame(out, columns=["lane", "ts", "value", "previous"]).astype({"previous": "float64"})

    return samples.groupBy("lane").applyInPandasWithState(step, "lane string, ts timestamp, value double, previous double", "last double", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, folder: str) -> DataFrame:
    """Run a stream over what is there now, into a Parquet table, and read it."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")
