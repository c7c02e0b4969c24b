"""Token ids in files of directly addressable codes.

A file holds the ids of a run of documents. Each id is cut into chunks of 8 bits, lowest first. Level k holds the k-th chunks of all ids that
have one, one byte each, with a bitmap that tells which of them continue on level k + 1, and a rank directory: the ones in the bitmap before every
block of 512 bits. Token i is read as byte i of level 0; if bit i is set, the next chunk is byte rank(i) of level 1, and so on; no block is decoded.

    magic PGDAC001 | n_docs, n_tokens, n_levels: u64 | doc ids: i64, doc starts: u64 (n_docs + 1) | null flags: u8
    then for each level: n: u64 | n bytes | bitmap: ceil(n / 8) bytes | directory: u64 for each started 512 bits
All numbers are little-endian.

Texts are encoded where they are read; only their ids move, two bytes each where the vocabulary allows it, to the range of their doc_id. Ranges are cut by a
sample of ids (SAMPLE_ROWS at most; it decides how even they are, and nothing else), and an id that fills several ranges is dealt over them by the
hash of its texts. The manifest is a table with a row a file, and the first token of each file a sum over the files before it in its range and over the ranges
before; it never reaches the driver.

Defined results: a null text has only the end id. Documents lie in ascending doc_id order (null ids first; rows that share an id by the hash of
their text). Files go to the shared folder through pyarrow's file systems; each task attempt writes files of its own, and only those of the
attempts that Spark accepted are in the manifest. Extra columns are ignored, whatever their names. An empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, new_path
from .word_tokens import encoder as word_encoder

MAGIC = b"PGDAC001"
BLOCK = 512
#: A file is closed at so many tokens, so that writer and reader hold a few MB.
FILE_TOKENS = 4_000_000
SAMPLE_ROWS = 20_000


def encode_levels(ids: np.ndarray) -> list[bytes]:
    parts, rest = [], ids.astype(np.uint32)
    while len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(rest) // BLOCK) * BLOCK, dtype=np.uint8)
        padded[: len(rest)] = more
        ones = padded.reshape(-1, BLOCK).sum(axis=1, dtype=np.uint64)
        directory = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8")
        parts.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + directory.tobytes())
        rest = rest[more] >> 8
    return parts


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    levels = encode_levels(np.concatenate(ids) if ids else np.zeros(0, np.uint32))
    head = MAGIC + struct.pack("<QQQ", len(doc_ids), int(starts[-1]), len(levels))
    return b"".join([head, np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), starts.tobytes(), np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes(), *levels])


class TokenFile:
    """Random access to the tokens of one file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_tokens, n_levels = struct.unpack_from("<QQQ", data, 8)
        at = 32
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        at += 8 * n_docs
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at)
        at += 8 * (n_docs + 1)
        self.null = np.frombuffer(data, np.uint8, n_docs, at)
        at += n_docs
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at + n)
            blocks = -(-n // BLOCK)
            directory = np.frombuffer(data, "<u8", blocks, at + n + len(bits))
            at += n + len(bits) + 8 * blocks
            self.levels.append((chunks, bits, directory))

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit i."""
        _, bits, directory = self.levels[level]
        block = i // BLOCK
        if block >= len(directory):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        return int(directory[block]) + int(np.unpackbits(bits[block * BLOCK // 8 : -(-i // 8)], bitorder="little")[: i - block * BLOCK].sum())

    def token(self, i: int) -> int:
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """uint32 ids start..end-1."""
        out = np.zeros(max(0, end - start), dtype="<u4")
        where = np.arange(len(out))
        for level, (chunks, bits, _) in enumerate(self.levels):
            if end <= start:
                break
            out[where] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[start // 8 : -(-end // 8)], bitorder="little")[start % 8 : start % 8 + end - start].astype(bool)
            where = where[more]
            start = self._rank(level, start) if len(where) else 0
            end = start + len(where)
        return out


_LEAST = np.iinfo(np.int64).min


def range_of(doc_ids: np.ndarray, ties: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each (doc_id, tie), in their order; an id that is several bounds is dealt over their ranges by its tie, a uniform 64-bit hash."""
    low, high = np.searchsorted(bounds, doc_ids, "left"), np.searchsorted(bounds, doc_ids, "right")
    share = ties.astype(np.float64) / 2.0**64 + 0.5
    return np.minimum(low + (share * (high - low + 1)).astype(np.int64), high).astype(np.int32)


def _bounds(docs: DataFrame, ranges: int) -> np.ndarray:
    """ranges - 1 doc_ids that cut the table into about equal parts (null ids as the least number)."""
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    drawn = np.sort(np.array([_LEAST if r[0] is None else r[0] for r in docs.select("doc_id").sample(fraction=share, seed=7).collect()], np.int64))
    return drawn[np.arange(1, ranges) * len(drawn) // ranges] if len(drawn) else np.zeros(0, np.int64)


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, bounds: np.ndarray) -> DataFrame:
    """doc_id, tie, ids (little-endian, of the width that width_of() gives), part (the range) of every row."""
    width = width_of(tokenizer, end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [np.append(x, np.uint32(end_id)).astype(width).tobytes() for x in encoder.encode(some.column(2).to_pylist())]
                part = range_of(some.column(0).fill_null(_LEAST).to_numpy(), some.column(1).to_numpy(), bounds)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(ids, pa.binary()), pa.array(part)], names=["doc_id", "tie", "ids", "part"])
        encoder.forget()

    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(encode, "doc_id long, tie long, ids binary, part int")


def width_of(tokenizer: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode docs and write the files; returns the manifest: path, first (token), docs, tokens of each file."""
    spark, width = docs.sparkSession, width_of(tokenizer, end_id)
    folder = folder or new_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = n = 0

        def close() -> pa.RecordBatch:
            name = f"{task.partitionId():06d}-{n:06d}-{task.taskAttemptId()}.dac"
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(file_bytes(doc_ids, ids))
            return pa.RecordBatch.from_pydict({"part": [task.partitionId()], "n": [n], "path": [f"{folder}/{name}"], "docs": [len(doc_ids)], "tokens": [held]})

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(d)
                ids.append(np.frombuffer(x.as_buffer(), width).astype("<u4"))
                held += len(ids[-1])
                if held >= file_tokens:
                    yield close()
                    doc_ids, ids, held, n = [], [], 0, n + 1
        if doc_ids:
            yield close()

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    encoded = _encoded(docs, tokenizer, end_id, _bounds(docs, ranges))
    ordered = encoded.repartitionById(ranges, F.col("part")).sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    made = materialise(ordered.mapInArrow(write, "part long, n long, path string, docs long, tokens long"), "manifest")
    running = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    parts = made.groupBy("part").agg(F.sum("tokens").alias("all"))  # a row a range of documents
    parts = parts.select("part", F.coalesce(F.sum("all").over(running(F.lit(0)).orderBy("part")), F.lit(0)).alias("before"))
    first = F.col("before") + F.coalesce(F.sum("tokens").over(running("part").orderBy("n")), F.lit(0))
    return made.join(F.broadcast(parts), "part").select("path", first.alias("first"), "docs", "tokens")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document in the files."""
    files = manifest.select("path", "first", "docs", "tokens")
    files = files.repartition(max(1, min(files.count(), 10_000)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, root = fs.FileSystem.from_uri(path)
                with store.open_input_stream(root) as f:
                    file = TokenFile(f.read())
                for at in range(0, len(file.doc_ids), 1024):
                    some = range(at, min(at + 1024, len(file.doc_ids)))
                    starts = [int(file.starts[i]) for i in some]
                    ends = [int(file.starts[i + 1]) for i in some]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([None if file.null[i] else int(file.doc_ids[i]) for i in some], pa.int64()),
                            "start": pa.array([first + a for a in starts], pa.int64()),
                            "n_tokens": pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()),
                            "ids": pa.array([file.tokens(a, b).tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                        }
                    )

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
