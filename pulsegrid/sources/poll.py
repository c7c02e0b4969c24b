"""A source that reads at fixed times: a Python data source for batches and streams, and the table function that makes samples of payloads."""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.functions import udtf

SCHEMA = "tick long, ts timestamp, lane string, value double"


def _reader(name: str):
    """The function that option reader='module:function' names: (seconds since 1970, options) to an iterable of (lane, value)."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _rows(options: dict, tick: int) -> Iterator[tuple]:
    import datetime

    start, interval = int(options.get("start_s", 0)), float(options.get("interval_s", 1))
    at = start + tick * interval
    ts = datetime.datetime.fromtimestamp(at, datetime.timezone.utc)
    for lane, value in _reader(options["reader"])(at, options):
        yield (tick, ts, lane, None if value is None else float(value))


class PollSource(DataSource):
    """format("poll"): options reader, interval_s, start_s (the grid that reads are aligned to), ticks (batch: how many; stream: where it ends, else the clock decides).

    A stream reads the ticks that are due, a second after another none is skipped; reads of the same ticks again call the reader again, so a reader that
    replays needs one that answers by time.
    """

    @classmethod
    def name(cls) -> str:
        return "poll"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        ticks, parts = int(self.options.get("ticks", 1)), int(self.options.get("partitions", 4))
        size = -(-ticks // parts)
        return [InputPartition((a, min(a + size, ticks))) for a in range(0, ticks, size)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for tick in range(*partition.value):
            yield from _rows(self.options, tick)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def _due(self) -> int:
        interval = float(self.options.get("interval_s", 1))
        due = int((time.time() - int(self.options.get("start_s", 0))) // interval) + 1
        return min(due, int(self.options["ticks"])) if "ticks" in self.options else due

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = max(start["tick"], min(self._due(), start["tick"] + int(self.options.get("most", 1000))))
        return iter([row for t in range(start["tick"], end) for row in _rows(self.options, t)]), {"tick": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([row for t in range(start["tick"], end["tick"]) for row in _rows(self.options, t)])


def replay(at: float, options: dict) -> list[tuple[str, float]]:
    """A reader for trials: lanes that depend on the time alone."""
    return [(f"lane{k}", (at * (k + 1)) % 97) for k in range(int(options.get("lanes", 2)))]


@udtf(returnType="module string, source string, metric string, value double")
class EmitHistory:
    """samples(module, payload): the lanes that a payload's JSON object emits, one a finite number; nested objects name their source."""

    def eval(self, module: str, payload: str):
        import json
        import math

        try:
            fields = json.loads(payload)
        except (TypeError, ValueError):
            return
        if not isinstance(fields, dict):
            return
        for key, value in fields.items():
            inner = value.items() if isinstance(value, dict) else [(None, value)]
            for metric, number in inner:
                if isinstance(number, (int, float)) and not isinstance(number, bool) and math.isfinite(number):
                    yield (module, "" if metric is None else key, key if metric is None else metric, float(number))
