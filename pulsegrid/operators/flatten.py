"""JSON documents to paths and numbers."""

from __future__ import annotations

import json as js
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fields that tell an array's objects apart, in order. Fixed values.
IDENTITIES = ("id", "uuid", "BSDName")


def _segment(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def _identity(item: dict) -> str | None:
    for key in IDENTITIES:
        if isinstance(item.get(key), str) and item[key]:
            return f"{key}:{item[key]}"
    kind, model = item.get("IOClass"), item.get("model")
    if isinstance(kind, str) and isinstance(model, str) and kind and model:
        return f"IOClass:{len(kind.encode())}:{kind}{model}"
    return None


def numbers(value: object, path: str = "") -> Iterator[tuple[str, float]]:
    """(path, number): fields as /field:k, array elements as /index:i, and objects in arrays as /item:identity; objects without an identity of their own are left out."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from numbers(inner, f"{path}/field:{_segment(key)}")
    elif isinstance(value, list):
        names = [_identity(x) if isinstance(x, dict) else None for x in value]
        count = Counter(names)
        for i, (name, inner) in enumerate(zip(names, value, strict=True)):
            if not isinstance(inner, dict):
                yield from numbers(inner, f"{path}/index:{i}")
            elif name is not None and count[name] == 1:
                yield from numbers(inner, f"{path}/item:{_segment(name)}")
    elif isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) < 2**1023 and math.isfinite(value):
        yield path, float(value)


def flatten_json(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, path, number of each finite number in a JSON text; text that is no JSON gives none."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, found = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    pairs = list(numbers(js.loads(text))) if text is not None else []
                except (ValueError, RecursionError):
                    pairs = []
                at += [i] * len(pairs)
                paths += [p for p, _ in pairs]
                found += [n for _, n in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(paths, pa.string()), pa.array(found, pa.float64())], names=["key", "path", "number"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, json).mapInArrow(flat, f"key {kind}, path string, number double").withColumnRenamed("key", key)
