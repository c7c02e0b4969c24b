"""Byte-level BPE with Spark higher-order functions.

Python cuts the texts of a partition into words by the pattern and numbers the distinct ones; Spark folds each distinct word of a task once; Python puts the
words' ids in the texts' order. The fold takes a word as an array of bytes and merges the neighbours of least rank, leftmost first, until no pair has a
rank. Ranks come from literal arrays: a sparse matrix of pairs of ids, its rows shifted so that their entries don't meet. Decoding concatenates the pieces
of the ids.

Words of up to SHORT_WORD bytes take one merge a step. Longer ones take all places of the least pair that can't touch each other in one step, so that their
cost grows with the number of different merges and not with the square of their length; a step whose new pairs would come before the places that are
left makes the first merge only, so the result is the same.

The words that a bounded sample (HEAD_DOCS documents, by hash of doc_id) has most often, HEAD_WORDS of them, are folded once beforehand and known to every
task; they save folds and change no result. All else is one narrow stage: no row moves between tasks, and nothing is collected or broadcast but the ranks
and the head. A task keeps MEMO_WORDS more distinct words at most; then it starts anew, which costs folds and changes no result. Rows between the
steps hold the documents of about CHUNK_CHARS bytes of text.

Defined results: null counts as empty and has no tokens. Each row gives one row, repeated rows included. Extra columns are ignored, whatever their
names. An empty table gives an empty result. A vocabulary that lacks a byte, or with ids of over 20 bits, is refused.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

HEAD_DOCS = 16_000
HEAD_WORDS = 130_000
MEMO_WORDS = 150_000
CHUNK_CHARS = 500_000
SHORT_WORD = 64
ID_BITS = 20
#: Stands for no id and for no rank.
NONE = (1 << ID_BITS) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks a byte")
    if max(ranks.values()) >= NONE:
        raise ValueError(f"an id has more than {ID_BITS} bits")
    return ranks


def _pairs(ranks: dict[bytes, int]) -> dict[int, dict[int, int]]:
    """left id -> right id -> id of their concatenation."""
    pairs: dict[int, dict[int, int]] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs.setdefault(left, {})[right] = rank
    return pairs


def _displaced(rows: dict[int, dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sparse matrix as (shifts, owners, values): an entry (l, r) stands at shifts[l] + r, where owners has l. Long rows are placed first, each at the first place where it fits."""
    size = 2 * sum(map(len, rows.values())) + (1 << ID_BITS) + 1
    shifts, owners, values = np.zeros(max(rows, default=0) + 1, np.int64), np.full(size, -1), np.zeros(size, np.int64)
    low, end = 0, 0
    for left in sorted(rows, key=lambda x: (-len(rows[x]), x)):
        columns = np.array(sorted(rows[left]))
        at, window = low, 256
        while True:
            free = at + np.flatnonzero(owners[at : at + window] < 0)
            for c in columns[1:]:
                free = free[owners[free + (c - columns[0])] < 0]
            if len(free):
                break
            at, window = at + window, 8192
        shifts[left] = free[0] - columns[0]
        owners[columns + shifts[left]], values[columns + shifts[left]] = left, [rows[left][c] for c in columns.tolist()]
        end = max(end, int(columns[-1] + shifts[left]) + 1)
        while owners[low] >= 0:
            low += 1
    return shifts, owners[:end], values[:end]


def _ints(values: np.ndarray) -> Column:
    """A literal array<int>, folded by the optimiser."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<int>")


class PairRanks:
    """The ranks of pairs as literal arrays, and the fold over them.

    A word is an array of parts, after one element that ends it on the left. A part is rank << 2 * ID_BITS | place << ID_BITS | id: the rank of the pair
    that it makes with the part after it (NONE if none), the place of its first byte, and its id. So the least part is the leftmost pair of least rank.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.tables = [_ints(x) for x in _displaced(_pairs(ranks))]

    def fold_all(self, words: Column) -> Column:
        """The ids of each word with its merges made, after one element NONE. The tables are bound to lambda variables, so that they stand once in a query."""
        shifts, owners, values = self.tables
        return let(shifts, lambda s: let(owners, lambda o: let(values, lambda v: F.transform(words, lambda w: F.transform(self.fold(s, o, v, w), lambda x: x.bitwiseAND(F.lit(NONE).cast("bigint")).cast("int"))))))

    @staticmethod
    def fold(shifts: Column, owners: Column, values: Column, word: Column) -> Column:
        long = lambda x: F.lit(x).cast("bigint")
        id_of = lambda part: part.bitwiseAND(long(NONE)).cast("int")
        placed = lambda part: part.bitwiseAND(long((1 << 2 * ID_BITS) - 1))
        rank_of = lambda part: F.shiftright(part, 2 * ID_BITS)
        never = long(NONE << 2 * ID_BITS)

        def rank(left: Column, right: Column) -> Column:
            at = F.get(shifts, left) + right
            return F.shiftleft(F.when(F.get(owners, at) == left, F.get(values, at)).otherwise(F.lit(NONE)).cast("bigint"), 2 * ID_BITS)

        def merged(p: Column, least: Column, at: Column) -> Column:
            whole, before = rank_of(least).cast("int"), F.get(p, at - 2)
            neighbour = rank(id_of(before), whole) + placed(before)
            part = rank(whole, id_of(F.get(p, at + 1))) + least.bitwiseAND(long(NONE << ID_BITS)) + whole
            return F.concat(F.slice(p, F.lit(1), at - 2), F.array(neighbour, part), F.slice(p, at + 2, F.size(p)))

        def step(p: Column, _: Column) -> Column:
            """One merge. Places make the parts of a short word unique, so that one goes by its value and its neighbours change by theirs; no array is cut up."""

            def first(m: Column, at: Column, before: Column) -> Column:
                whole = rank_of(m).cast("int")
                part = rank(whole, id_of(F.get(p, at + 1))) + m.bitwiseAND(long(NONE << ID_BITS)) + whole
                neighbour = rank(id_of(before), whole) + placed(before)
                return F.transform(F.array_remove(p, F.get(p, at)), lambda x: F.when(x == m, part).when(x == before, neighbour).otherwise(x))

            found = lambda m: let(F.array_position(p, m).cast("int"), lambda at: let(F.get(p, at - 2), lambda before: first(m, at, before)))
            return let(F.array_min(p), lambda m: F.when(m >= never, p).otherwise(found(m)))

        def all_merged(p: Column, least: Column) -> Column:
            """Every second hit of each run of hits (parts of the least rank), from the run's first; only the first hit of all, if a new pair comes before."""
            whole = rank_of(least).cast("int")
            others = F.filter(F.transform(p, lambda x, i: F.when(rank_of(x) != whole, i)), lambda i: i.isNotNull())  # the last part is always one of these
            hits = let(others, lambda o: F.flatten(F.zip_with(F.slice(o, F.lit(1), F.size(o) - 1), F.slice(o, F.lit(2), F.size(o)), lambda a, b: F.when(b - a > 1, F.sequence(a + 1, b - 1, F.lit(2))).otherwise(F.array().cast("array<int>")))))

            def pieces(hit: Column) -> Column:
                """For each hit, the merged part and the parts from there to the next hit, the last of which has the next merged part behind it."""
                twin = rank(whole, whole)

                def piece(at: Column, k: Column) -> Column:
                    following = F.get(hit, k + 1)
                    end = F.coalesce(following, F.size(p))  # the place of the next hit
                    place = F.get(p, at).bitwiseAND(long(NONE << ID_BITS)) + whole
                    own = F.when(following == at + 2, twin).otherwise(rank(whole, id_of(F.get(p, at + 2)))) + place
                    last = F.get(p, end - 1)
                    inner = F.when(following.isNull(), F.slice(p, at + 3, F.size(p))).when(end - at > 2, F.concat(F.slice(p, at + 3, end - at - 3), F.array(rank(id_of(last), whole) + placed(last))))
                    return F.concat(F.array(own), F.coalesce(inner, F.array().cast("array<bigint>")))

                before = F.get(p, F.get(hit, 0) - 1)
                front = F.concat(F.slice(p, F.lit(1), F.get(hit, 0) - 1), F.array(rank(id_of(before), whole) + placed(before)))
                return F.concat(front, F.flatten(F.transform(hit, piece)))

            def early(hit: Column) -> Column:
                """Is there a hit whose merged part makes a pair of lesser rank with a neighbour, as that is before or after its own merge?"""
                low = lambda r: r < F.shiftleft(whole.cast("bigint"), 2 * ID_BITS)
                beside = F.exists(hit, lambda at: low(rank(whole, id_of(F.get(p, at + 2)))) | low(rank(id_of(F.get(p, at - 1)), whole)))
                return F.coalesce(beside | low(rank(whole, whole)), F.lit(False))

            return let(hits, lambda h: F.when((F.size(h) == 1) | early(h), merged(p, F.get(p, F.get(h, 0)), F.get(h, 0) + 1)).otherwise(pieces(h)))

        def all_step(a: Column, _: Column) -> Column:
            after = let(all_merged(a["parts"], a["least"]), lambda p: F.struct(p.alias("parts"), F.array_min(p).alias("least")))
            return F.when(a["least"] >= never, a).otherwise(after)

        every = F.sequence(F.lit(1), F.size(word) - 2)
        start = F.struct(word.alias("parts"), F.array_min(word).alias("least"))
        folded = F.when(F.size(word) <= SHORT_WORD + 1, F.aggregate(every, word, step)).otherwise(F.aggregate(every, start, all_step, lambda a: a["parts"]))
        return F.when(F.array_min(word) >= never, word).otherwise(folded)


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    r"""Of each code point: 0 white space, 1 letter (\p{L}), 2 number (\p{N}), 3 other."""
    import regex

    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    out = np.full(0x110000, 3, np.uint8)
    for kind, name in enumerate((r"\p{White_Space}", r"\p{L}", r"\p{N}")):
        for m in regex.finditer(name + "+", every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


def _units(text: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points of UTF-8 bytes, and where each begins (None: one byte each)."""
    data = np.frombuffer(text, np.uint8)
    if not len(data) or data.max() < 128:
        return data, None
    return np.frombuffer(text.decode().encode("utf-32-le"), "<u4"), np.flatnonzero((data & 0xC0) != 0x80)


def token_starts(text: bytes, starts: np.ndarray) -> np.ndarray:
    """Where the matches of public_tokenizers.PATTERN begin in the texts that begin at `starts` (ascending, from 0) of one run of UTF-8 bytes; they cover all.

    A match is a run of one kind, with these exceptions: of white space before something else, the last character is left, and goes with what comes next if it
    is U+0020; an apostrophe that begins a match alone takes s, t, m, d, re, ve or ll with it.
    """
    c, places = _units(text)
    n = len(c)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds()[c]
    begins = np.zeros(n + 2, bool)  # of a text; two more, so that what comes next can be asked
    begins[n] = True
    begins[starts if places is None else np.searchsorted(places, starts)] = True
    cut = np.ones(n + 2, bool)
    cut[1:n] = (kind[1:] != kind[:-1]) | begins[1:n]
    edge = np.flatnonzero(cut[1:n] & (kind[:-1] == 0) & ~begins[1:n]) + 1  # first characters after white space
    cut[edge - 1] = True
    cut[edge[c[edge - 1] == 0x20]] = False
    quotes = np.flatnonzero(c == 0x27)
    if len(quotes):
        after = np.append(c, [0, 0])
        one, two = after[quotes + 1], after[quotes + 2]
        same = ~begins[quotes + 1]
        short = same & np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        pair = one.astype(np.int64) << 8 | two
        long = same & ~begins[quotes + 2] & np.isin(pair, [0x7265, 0x7665, 0x6C6C]) & (two < 256)
        taken = (short | long) & cut[quotes]
        q, end = quotes[taken], quotes[taken] + np.where(short[taken], 2, 3)
        cut[q + 1] = False
        letter = end[(end < n) & (np.append(kind, [0, 0, 0])[end] == 1)]
        cut[letter] = True
    at = np.flatnonzero(cut[:n])
    return at if places is None else places[at]


def _words(batch_texts: pa.Array, pattern: str) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of some texts in order, and how many each text has."""
    texts = batch_texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    low, high = int(offsets[0]), int(offsets[-1])
    flat = data.slice(low, high - low).to_pybytes() if data is not None else b""
    bounds = offsets - low
    if pattern == public_tokenizers.PATTERN:
        at = token_starts(flat, bounds[:-1][bounds[:-1] < len(flat)])
    else:
        find = _finder(pattern)
        lists = [find(flat[a:b].decode()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        flat = b"".join(w.encode() for x in lists for w in x)
        sizes = np.array([len(w.encode()) for x in lists for w in x], np.int64)
        at, counts = np.cumsum(sizes) - sizes, np.array([len(x) for x in lists], np.int64)
    ends = np.append(at, len(flat)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat)])
    if pattern == public_tokenizers.PATTERN:
        counts = np.diff(np.searchsorted(at, bounds))
    return words.dictionary_encode(), counts


@functools.lru_cache(maxsize=4)
def _finder(pattern: str):
    """The matches of any other pattern in a text, as the library finds them."""
    import regex

    compiled = regex.compile(pattern)
    return lambda text: [m.group() for m in compiled.finditer(text) if m.group()]


class _Numbers(dict):
    """word (bytes) -> its number. New words wait to be folded: their bytes, or the id of a word that is a token."""

    def __init__(self, ranks: dict[bytes, int], head: pa.Array):
        super().__init__()
        self.ranks, self.fresh, self.final, self.head = ranks, [], [], dict(zip(head.to_pylist(), range(len(head)), strict=True))
        self.n = self.known = len(head)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.of_pair = np.array([ranks.get(bytes([a, b]), NONE) for a in range(256) for b in range(256)], np.int64)

    def __missing__(self, word: bytes) -> int:
        number = self.head.get(word)
        if number is not None:
            return number
        number = self[word] = self.n
        if word in self.ranks:
            self.final.append((len(self.fresh), self.ranks[word]))
            self.fresh.append(b"\0")
        else:
            self.fresh.append(word)
        self.n += 1
        return number

    def parts(self) -> pa.Array:
        """One list of the waiting words, each an array of parts."""
        n = np.array([len(x) for x in self.fresh], np.int64)
        starts, raw = np.cumsum(n) - n, np.frombuffer(b"".join(self.fresh), np.uint8).astype(np.int64)
        place, ranks = np.arange(len(raw)) - np.repeat(starts, n), np.full(len(raw), NONE)
        ranks[:-1] = self.of_pair[raw[:-1] << 8 | raw[1:]]
        ranks[starts + n - 1] = NONE
        flat = np.full(len(raw) + len(n), NONE << 2 * ID_BITS | NONE)
        flat[np.arange(len(raw)) + np.repeat(np.arange(len(n)) + 1, n)] = ranks << 2 * ID_BITS | np.minimum(place, NONE) << ID_BITS | self.of_byte[raw]
        for k, one in self.final:
            flat[starts[k] + k + 1] = NONE << 2 * ID_BITS | one
        offsets = np.append(starts + np.arange(len(n)), len(flat)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))

    def taken(self, restart: bool) -> None:
        self.fresh, self.final = [], []
        if restart:
            self.clear()
            self.n = self.known


def _ids(folded: pa.Array) -> pa.Array:
    """The ids (little-endian unsigned 32-bit) of each folded word, as binary."""
    parts = folded.flatten().to_numpy()
    ends = (folded.offsets.to_numpy().astype(np.int64) - folded.offsets[0].as_py()) - np.arange(len(folded) + 1)
    ids = parts[parts != NONE].astype("<u4")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(folded), [None, pa.py_buffer((4 * ends).tobytes()), pa.py_buffer(ids.tobytes())])


def _joined(values: pa.Array, codes: pa.Array, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """values[codes] joined within each of the stretches that end at `ends` (the first begins at 0), and the sizes of the results."""
    taken = values.take(codes)
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    bounds = offsets[np.append(0, ends)]
    data = taken.buffers()[2] if len(taken) else pa.py_buffer(b"")
    joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds.tobytes()), data])
    return joined.cast(pa.binary()), np.diff(bounds)


class _Pieces:
    """The bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        table = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            table[rank] = piece
        self.table = pa.array(table, pa.large_binary())

    def decoded(self, ids: pa.Array) -> pa.Array:
        """The bytes of each word from its ids: its pieces, joined."""
        offsets = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        flat = np.frombuffer(ids.buffers()[2], "<u4")[offsets[0] // 4 : offsets[-1] // 4] if len(ids) else np.zeros(0, "<u4")
        out, _ = _joined(self.table, pa.array(flat.astype(np.int64)), (offsets[1:] - offsets[0]) // 4)
        return out.cast(pa.large_binary())


def head(docs: DataFrame, pairs: PairRanks, ranks_path: str, pattern: str, n_docs: int, n_words: int) -> tuple[pa.Array, pa.Array]:
    """Words and their ids: at most n_words of the words met most often in a sample of about n_docs documents (by hash of doc_id, all if there are fewer)."""
    total = docs.count()  # from Parquet footers
    drawn = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text"))
    share = F.pmod(drawn, F.lit(1 << 40)) < int((1 << 40) * min(1.0, n_docs / max(1, total)))
    sample = docs.where(share & F.col("text").isNotNull()).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, int] = {}
        for batch in batches:
            for texts in _slices(batch.column(0)):
                words, _ = _words(texts, pattern)
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                for w, k in zip(words.dictionary.to_pylist(), n.tolist(), strict=True):
                    if len(w) <= SHORT_WORD:
                        met[w] = met.get(w, 0) + k
            if len(met) > MEMO_WORDS // 2:
                yield pa.RecordBatch.from_pydict({"word": pa.array(list(met), pa.binary()), "n": pa.array(list(met.values()), pa.int64())})
                met = {}
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(met), pa.binary()), "n": pa.array(list(met.values()), pa.int64())})

    counted = sample.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    top = counted.orderBy(F.desc("n"), "word").limit(n_words).select("word")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(load_ranks(ranks_path), pa.array([], pa.binary()))
        for batch in batches:
            for w in batch.column(0).to_pylist():
                numbers[w]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.concat_arrays([batch.column(0)])), numbers.parts()], names=["word", "words"])
            numbers.taken(True)

    folded = top.repartition(16).mapInArrow(parts, "word array<binary>, words array<array<bigint>>").withColumn("words", pairs.fold_all(F.col("words")))

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0)[row].values, _ids(batch.column(1)[row].values).cast(pa.binary())], names=["word", "ids"])

    got = folded.mapInArrow(spelt, "word binary, ids binary").toArrow()  # n_words rows at most
    one = lambda name: pa.concat_arrays(got.column(name).cast(pa.large_binary()).chunks) if got.num_rows else pa.array([], pa.large_binary())
    return one("word"), one("ids")


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about CHUNK_CHARS bytes together; a longer text is one of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + CHUNK_CHARS, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, head_docs: int = HEAD_DOCS, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded (bytes) of every row."""
    pairs = PairRanks(load_ranks(ranks_path))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    head_list, head_ids = head(docs.select("doc_id", "text"), pairs, ranks_path, pattern, head_docs, head_words) if head_words else (pa.array([], pa.large_binary()), pa.array([], pa.large_binary()))

    def number_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each chunk: are numbers given anew, the ids of documents, how many words each has, the words' numbers, the new words."""
        numbers = _Numbers(load_ranks(ranks_path), head_list)
        restarted = True
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1)):
                words, counts = _words(texts, pattern)
                known = np.array([numbers[w] for w in words.dictionary.to_pylist()], "<i4")
                codes = known[words.indices.to_numpy()] if len(words) else np.zeros(0, "<i4")
                ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                columns = [
                    pa.array([restarted]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays([ids])),
                    pa.array([counts.astype("<i8").tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary()), numbers.parts(),
                ]
                restarted = numbers.n > numbers.known + MEMO_WORDS
                numbers.taken(restarted)
                yield pa.RecordBatch.from_arrays(columns, names=["restarted", "doc_ids", "counts", "codes", "words"])
            batch = texts = words = codes = ids = columns = None
            pa.default_memory_pool().release_unused()

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents of each chunk. The chunks of a task come in the order in which their words were numbered."""
        pieces = _Pieces(load_ranks(ranks_path))
        first = (head_ids, pieces.decoded(head_ids))
        ids, spelt = first
        for batch in batches:
            for row in range(batch.num_rows):
                restarted, doc_ids, counts, codes, folded = (batch.column(k)[row] for k in range(5))
                if restarted.as_py():
                    ids, spelt = first
                fresh = _ids(folded.values)
                if len(fresh):
                    ids, spelt = pa.concat_arrays([ids, fresh]), pa.concat_arrays([spelt, pieces.decoded(fresh)])
                codes, ends = pa.array(np.frombuffer(codes.as_buffer(), "<i4")), np.cumsum(np.frombuffer(counts.as_buffer(), "<i8"))
                joined, sizes = _joined(ids, codes, ends)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([doc_ids.values]), pa.array(sizes // 4), joined, _joined(spelt, codes, ends)[0]], names=["doc_id", "n_tokens", "ids", "decoded"])
            batch = doc_ids = counts = codes = folded = joined = None
            pa.default_memory_pool().release_unused()

    chunks = docs.select("doc_id", "text").mapInArrow(number_words, f"restarted boolean, doc_ids array<{id_type}>, counts binary, codes binary, words array<array<bigint>>")
    folded = chunks.withColumn("words", pairs.fold_all(F.col("words")))
    return folded.mapInArrow(put_together, f"doc_id {id_type}, n_tokens bigint, ids binary, decoded binary")
