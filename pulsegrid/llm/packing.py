"""Best-fit packing by exact complements.

Only the histogram of piece lengths (at most `capacity` rows) reaches the driver. There, from the longest length down, the gap it leaves is looked
up among single lengths, sums of pairs and sums of triples of lengths still available, and combinations that fill the gap exactly are consumed as
often as the counts allow; what has no exact partner is placed best-fit, all pieces of one length and all sequences with one gap at a time. The plan
is a list of runs (length, ranks from-to, first sequence, offset); it has a few rows for each length, however many pieces there are.

Each piece gets its rank among the pieces of its length from its place in its task plus the counts of earlier tasks: one array a task, by length. Up to
BROADCAST_CELLS of these arrays' cells they are broadcast and the ids stay where they are; beyond that (some thousand tasks) pieces and ids move once, to the
counts of their task and length. A broadcast join with the runs gives sequence and offset.

Defined results: a null text is a document of the end id alone. Rows that share a doc_id are packed like any others. Extra columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .word_tokens import encoder as word_encoder

CAPACITY = 4096
#: Cells (task, length) of earlier tasks' counts that are broadcast at most, 8 bytes each.
BROADCAST_CELLS = 16_000_000

Run = tuple[int, int, int, int, int]


class _Stock:
    """Counts of lengths, with an index of the sums of two of them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.pairs = np.ones(capacity + 1, dtype=bool)  # a sum that once has no pair never has one again

    def times(self, pattern: list[int]) -> int:
        return min(int(self.left[x]) // k for x, k in Counter(pattern).items())

    def pair(self, total: int, beside: list[int]) -> list[int] | None:
        """Two lengths that sum to total, available beside others; those that can be used most often."""
        if total < 2 or not self.pairs[total]:
            return None
        a = np.flatnonzero(self.left[1 : total // 2 + 1]) + 1
        a = a[self.left[total - a] > 0]
        if not len(a):
            self.pairs[total] = False
            return None
        for i in np.argsort(-np.minimum(self.left[a], self.left[total - a]), kind="stable")[:8]:
            found = [int(total - a[i]), int(a[i])]
            if self.times(beside + found):
                return found
        return None

    def fill(self, length: int, gap: int) -> list[int] | None:
        """One, two or three lengths that fill the gap beside one piece of this length."""
        if self.left[gap] and self.times([length, gap]):
            return [gap]
        if found := self.pair(gap, [length]):
            return found
        c = np.flatnonzero(self.left[1 : gap - 1]) + 1
        for x in c[self.pairs[gap - c]][::-1]:
            if (found := self.pair(gap - int(x), [length, int(x)])) and self.times([length, int(x), *found]):
                return [int(x), *found]
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """(length, first rank, end rank, first sequence, offset): rank r of a length goes to first sequence + r - first rank."""
    stock, used, runs, sequence = _Stock(counts, capacity), defaultdict(int), [], 0

    def put(length: int, times: int, first: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + times, first, offset))
        used[length] += times
        stock.left[length] -= times

    for length in range(capacity, 0, -1):
        while stock.left[length]:
            filled = [] if length == capacity else stock.fill(length, capacity - length)
            if filled is None:
                break
            times, offset = stock.times([length, *filled]), 0
            for x in [length, *filled]:
                put(x, times, sequence, offset)
                offset += x
            sequence += times

    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, sequences)
    there = np.zeros(capacity + 1, dtype=bool)

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            gaps[gap].append((first, n))
            there[gap] = True

    for length in range(capacity, 0, -1):
        while n := int(stock.left[length]):
            fits = np.flatnonzero(there[length:])
            if len(fits):
                gap = length + int(fits[0])
                first, free = gaps[gap].pop()
                there[gap] = bool(gaps[gap])
                times = min(n, free)
                put(length, times, first, capacity - gap)
                leave(gap - length, first, times)
                leave(gap, first + times, free - times)
            else:
                each = capacity // length
                opened, per = (n // each, each) if n >= each else (1, n)
                for k in range(per):
                    put(length, opened, sequence, k * length)
                leave(capacity - per * length, sequence, opened)
                sequence += opened
    return runs


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), task, place (number among the task's pieces of this length)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task, seen = word_encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids", "task", "place")}
                for d, x in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                    x = np.append(x, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(x), capacity)):
                        part = x[start : start + capacity]
                        for name, value in zip(out, (d, k, start, len(part), part.tobytes(), task, seen[len(part)]), strict=True):
                            out[name].append(value)
                        seen[len(part)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=list(out))
        encoder.forget()

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary, task long, place long")


def _dense(offsets: DataFrame, capacity: int) -> DataFrame:
    """task, before: an array by length, from rows (task, length, before), `capacity` a task at most."""
    import pandas as pd

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(capacity + 1, dtype=np.int64)
        out[pdf["length"].to_numpy()] = pdf["before"].to_numpy()
        return pd.DataFrame({"task": [pdf["task"].iloc[0]], "before": [out]})

    return offsets.groupBy("task").applyInPandas(fill, "task long, before array<long>")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, broadcast_cells: int = BROADCAST_CELLS) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of every piece of every document."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = materialise(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("task", "length", before.alias("before"))
    if counts.select("task").distinct().count() * (capacity + 1) <= broadcast_cells:
        ranked = cut.join(F.broadcast(_dense(offsets, capacity)), "task").withColumn("rank", F.get("before", F.col("length").cast("int")) + F.col("place"))
    else:
        ranked = cut.join(offsets, ["task", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    runs = spark.createDataFrame(plan(totals, capacity), "run_length long, low long, high long, first long, offset long")
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("doc_id", "piece", "start", "length", "ids", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
