"""Near duplicates: MinHash signatures, a multi-index Hamming join over them, confirmation on full shingle sets, connected components.

1. Sketch. Each text becomes its set of distinct word shingles (64-bit hashes) and a signature of SYMBOLS MinHash values of 16 bits. Texts with
   equal sets are one class from here on, named by a hash of the set.
2. Index. The signature is split into chunks of CHUNK symbols. By pigeonhole, two signatures that differ in at most 2 * chunks - 1 symbols have a
   chunk with at most one error, so each chunk gives CHUNK keys, each leaving one symbol out. Classes that share a key are neighbours. (At a
   similarity of 0.8 the chance that no chunk has at most one error is 3e-5, and falls steeply above.)
3. Clusters. Keys are range-sorted, and neighbours in that order linked: a key held by a third of all rows spans many tasks. The connected
   components of these links hold every pair that the join guarantees, and far fewer pairs than the buckets. They are cut into blocks of bounded size whose
   pairs are compared by signature alone; the components of what is near (NEAR symbols at most) are the clusters that go on, so that texts
   which only share a passage don't hang together.
4. Confirmation on the full sets, which are made once. First each cluster's least class against its others: that links most near copies. Then only classes outside
   the largest linked group of a cluster are compared with the rest of it, block by block: pairs whose signatures are near, nearest first, but for pairs
   already connected. So a group of n copies of one text costs n comparisons, and one more text among them n more.
5. Components of the confirmed links; each class takes the smallest doc_id of its component.

Defined results: null text, or text without words, has an empty set, is linked with nothing and stays. A text with fewer words than a shingle has one
shingle. Repeated rows and equal texts are linked. component_id ignores null ids (null only if a component has no other); a row is kept if its
doc_id equals component_id, null equal to null. Extra columns are ignored, whatever their names. An empty table gives an empty result.
survivors() decides by row, not by doc_id: one row of each component stays, that of the smallest doc_id (null last), also where ids are repeated or null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import materialise, scratch

SHINGLE = 5
SYMBOLS = 60
CHUNK = 6
#: Signatures that differ in more symbols than this are not confirmed: at similarity 0.8 more have a chance below 1e-6. None: whatever is in a cluster is.
NEAR: int | None = 28
SIMILARITY_PERCENT = 80
#: Members of a block, and shingles that the sets of a block's members hold together (a longer text is a block of its own).
BLOCK_MEMBERS = 256
BLOCK_SHINGLES = 400_000
MAX_ROUNDS = 60
#: Rows of numbers (8 or 16 bytes each) that are broadcast at most: representatives whose texts are fetched, and rows that survivors() drops.
BROADCAST_ROWS = 500_000

_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS = np.ones(4096, dtype=_U)
with np.errstate(over="ignore"):
    np.cumprod(np.full(4095, 0x9E3779B97F4A7C15, dtype=_U), out=_POWERS[1:])
_FACTORS = _mix(np.arange(1, SYMBOLS + 1, dtype=_U)) | _U(1)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a lower-cased UTF-8 text, in order."""
    data = np.frombuffer(text.translate(_LOWER), dtype=np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=_U)
    kept = data[inside]
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.arange(len(kept)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        # beyond 4096 bytes of a word the powers repeat, shifted by the number of the round
        sums = np.add.reduceat((kept.astype(_U) + _U(1) + (at >> 12).astype(_U) * _U(0x1_0001)) * _POWERS[at & 4095], first)
        return _mix(sums + lengths.astype(_U) * _U(0xD6E8FEB86659FD93))


def shingle_set(text: str | bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    h = word_hashes(text.encode() if isinstance(text, str) else text or b"")
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, dtype=_U)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(h))):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS MinHash values of 16 bits."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=_U)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            part = shingles[at : at + 2048]
            np.minimum(least, (part[:, None] * _FACTORS[None, :]).min(axis=0), out=least)
    return (_mix(least) >> _U(48)).astype(np.uint16)


def set_name(shingles: np.ndarray) -> int:
    """A 64-bit name of a set; equal for equal sets."""
    with np.errstate(over="ignore"):
        return int(_mix(_mix(shingles + _U(0x51ED)).sum(dtype=_U) ^ _mix(np.array([len(shingles)], dtype=_U))[0]).astype(np.int64))


def _sketches(docs: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """__row (the columns to keep but for the text), text, row (a number), doc_id, n_shingles, class, signature of every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                sets = [shingle_set(x, size) for x in some.column(0).cast(pa.binary()).to_pylist()]
                made = [
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([set_name(x) if len(x) else None for x in sets], pa.int64()),
                    pa.array([signature(x).tobytes() if len(x) else None for x in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*some.columns, *made], names=[*some.schema.names, "n_shingles", "class", "signature"])

    kept = [F.col(c) for c in keep if c != "text"] or [F.lit(None).cast("string").alias("none")]
    rows = docs.select("text", "doc_id", F.monotonically_increasing_id().alias("row"), F.struct(*kept).alias("__row"))
    more = [StructField("n_shingles", LongType()), StructField("class", LongType()), StructField("signature", BinaryType())]
    return rows.mapInArrow(sketch, StructType([*rows.schema, *more]))


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, SYMBOLS) keys: for each chunk and each of its symbols, a hash of the chunk without that symbol."""
    salted = _mix(signatures.astype(_U) + (np.arange(1, SYMBOLS + 1, dtype=_U) << _U(20))[None, :])
    keys = np.empty(signatures.shape, dtype=_U)
    for at in range(0, SYMBOLS, CHUNK):
        part = salted[:, at : at + CHUNK]
        with np.errstate(over="ignore"):
            total = part.sum(axis=1, dtype=_U)
            for k in range(part.shape[1]):
                keys[:, at + k] = _mix(total - part[:, k] + _U(at * SYMBOLS + k + 1))
    return keys


def _keys(classes: DataFrame) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(some.column(1).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
                yield pa.RecordBatch.from_pydict({"key": pa.array(index_keys(sig).view(np.int64).ravel()), "class": pa.array(np.repeat(some.column(0).to_numpy(), SYMBOLS))})

    return classes.select("class", "signature").mapInArrow(emit, "key long, class long")


class Forest:
    """Union-find over int64 names; the least name is the root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, path = self.parent, []
        while (p := parent.setdefault(x, x)) != x:
            path.append(x)
            x = p
        for y in path:
            parent[y] = x
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _neighbours(keys: DataFrame) -> DataFrame:
    """Links (a, b) that connect all classes with a common key: a star from the first of each key in a partition, and one link from each partition's
    last key to the next partition's first if they are the same."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, last = TaskContext.get().partitionId(), None, None
        done = np.zeros((0, 2), dtype=np.int64)
        for batch in batches:
            key, name = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            if first is None:
                first = (int(key[0]), int(name[0]))
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            centre = np.repeat(name[start], np.diff(np.append(start, len(key))))
            if last is not None and last[0] == key[0]:  # a run goes on from the batch before
                centre[key == key[0]] = last[1]
            last = (int(key[-1]), int(centre[-1]))
            pairs = np.stack([centre, name], axis=1)[centre != name]
            done = np.unique(np.concatenate([done, pairs]), axis=0)
            if len(done) > 500_000:
                yield pa.RecordBatch.from_pydict({"a": done[:, 0], "b": done[:, 1], "part": np.full(len(done), -1), "key": np.zeros(len(done), dtype=np.int64)})
                done = done[:0]
        yield pa.RecordBatch.from_pydict({"a": done[:, 0], "b": done[:, 1], "part": np.full(len(done), -1), "key": np.zeros(len(done), dtype=np.int64)})
        if first is not None:
            yield pa.RecordBatch.from_pydict({"a": [first[1], last[1]], "b": [first[1], last[1]], "part": [2 * part, 2 * part + 1], "key": [first[0], last[0]]})

    out = materialise(keys.repartitionByRange("key", "class").sortWithinPartitions("key", "class").mapInArrow(link, "a long, b long, part long, key long"), "neighbours")
    ends = sorted((r["part"], r["key"], r["a"]) for r in out.where("part >= 0").collect())  # two rows for each partition
    across = [(ends[i][2], ends[i + 1][2]) for i in range(len(ends) - 1) if ends[i][1] == ends[i + 1][1] and ends[i][2] != ends[i + 1][2]]
    links = out.where("part < 0").select("a", "b")
    return links.unionByName(keys.sparkSession.createDataFrame(across, "a long, b long")) if across else links


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links(a, b), root being the least name that its component's contraction met.

    Each round gives every node its least neighbour, follows that one's choice, and puts the roots in place of the nodes; links inside a component
    vanish. All steps are aggregates and joins over narrow tables, written to the shared folder.
    """
    spark = links.sparkSession
    local = "a long, b long"

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A star for each component of the links of one task's batches."""
        for batch in batches:
            forest = Forest()
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.union(a, b)
            nodes = [(x, forest.find(x)) for x in list(forest.parent)]
            nodes = [(x, r) for x, r in nodes if x != r]
            yield pa.RecordBatch.from_pydict({"a": pa.array([r for _, r in nodes], pa.int64()), "b": pa.array([x for x, _ in nodes], pa.int64())})

    steps: list[DataFrame] = []
    edges = materialise(links.where("a != b").mapInArrow(shrink, local).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        choice = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        # a node that is less than all its neighbours stays; the others go where their least neighbour goes
        choice = choice.select("node", F.least("node", "to").alias("to"))
        hop = choice.select(F.col("node").alias("to"), F.col("to").alias("root"))
        step = materialise(choice.join(hop, "to").select("node", "root"), "step")
        a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(a, "a").join(b, "b").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = materialise(moved.mapInArrow(shrink, local).distinct(), "links")
        steps.append(step)
    else:
        raise RuntimeError("components did not settle")
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    labels = steps[0]
    for step in steps[1:]:  # each names roots of the one before
        nxt = step.select(F.col("node").alias("root"), F.col("root").alias("later"))
        labels = labels.join(nxt, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return materialise(labels, "labels") if len(steps) > 1 else labels


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal values in the first columns (integers), as one batch."""
    held: list[pa.RecordBatch] = []
    now = None

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(keys)], axis=1)
        starts = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))), batch.num_rows)
        for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if held and tuple(key[at]) != now:
                yield whole()
                held = []
            now = tuple(key[at])
            held.append(batch.slice(at, end - at))
    if held:
        yield whole()


def _links(members: DataFrame, percent: int, near: int | None) -> DataFrame:
    """Links (a, b) between classes of a group that connect what belongs together and isn't connected yet, each group by itself.

    members: cluster, i, j (the group), class, comp (what a class is connected with), n, signature, left, right (which pairs are to be looked at), and shingles, if
    they decide; without that column, near signatures and sizes do.
    """
    exact = "shingles" in members.columns

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 3):
            names, comps, sizes = (group.column(k).to_pylist() for k in (3, 4, 5))
            left, right = np.array(group.column(7).to_pylist()), np.array(group.column(8).to_pylist())
            sig, n = np.frombuffer(b"".join(group.column(6).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS), np.array(sizes)
            sets = [np.frombuffer(x, dtype=_U) for x in group.column(9).to_pylist()] if exact else []
            label, found, forest, pairs = np.array(comps), [], Forest(), []
            columns = np.flatnonzero(right)
            for i in np.flatnonzero(left).tolist():
                others = columns[(label[columns] != label[i]) & ((columns > i) | ~left[columns] | ~right[i])]
                others = others[others != i]
                far = (sig[others] != sig[i]).sum(axis=1)
                ok = 100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])
                if near is not None:
                    ok &= far <= near
                pairs.append(np.stack([far[ok], np.full(ok.sum(), i), others[ok]], axis=1))
            close = np.concatenate(pairs) if pairs else np.zeros((0, 3), dtype=np.int64)
            for _, i, j in close[np.argsort(close[:, 0], kind="stable")].tolist():
                if forest.find(comps[i]) != forest.find(comps[j]):
                    if exact:
                        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * common < percent * (len(sets[i]) + len(sets[j]) - common):
                            continue
                    forest.union(comps[i], comps[j])
                    found.append((names[i], names[j]))
            if found:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    order = ["cluster", "i", "j"]
    columns = ["class", "comp", "n", "signature", "left", "right", *(["shingles"] if exact else [])]
    return members.select(*order, *columns).repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long")


def _blocks(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """rows with name (a block of its keys) and name_n (how many there are): bounded by members and by the shingles that they can have together."""
    weights = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"), F.max("n").alias("__longest"))
    per = F.greatest(F.lit(1), F.least(F.lit(BLOCK_MEMBERS), F.floor(F.lit(BLOCK_SHINGLES) / F.col("__longest"))))
    weights = weights.select(*keys, F.ceil(F.col("__m") / per).cast("int").alias(f"{name}_n"))
    return rows.join(weights, [*keys]).withColumn(name, F.pmod(F.xxhash64("class", F.lit(1)), F.col(f"{name}_n")).cast("int"))


def _all_pairs(rows: DataFrame) -> DataFrame:
    """Every pair of a cluster's blocks as a group: i, j, left, right. rows: cluster, block, block_n, ..."""
    pair = F.transform(F.sequence(F.lit(0), F.col("block_n") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    spread = rows.withColumn("__p", F.explode(pair))
    return spread.select("*", "__p.i", "__p.j", (F.col("block") == F.col("__p.i")).alias("left"), (F.col("block") == F.col("__p.j")).alias("right"))


def _clustered(rooted: DataFrame, rows: DataFrame) -> DataFrame:
    """rows of classes that have company, with their cluster. rooted: node, root."""
    return rooted.select(F.col("node").alias("class"), F.col("root").alias("cluster")).join(rows, "class").withColumn("comp", F.col("class"))


def _sets(sketches: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """class, shingles of members(class, row): their texts' sets, made again."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([shingle_set(x, size).tobytes() for x in some.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["class", "shingles"])

    wanted = members.select("class", "row")
    if members.count() <= BROADCAST_ROWS:  # else texts move once, to their numbers
        wanted = F.broadcast(wanted)
    return sketches.select("row", "text").join(wanted, "row").select("class", "text").mapInArrow(shingles, "class long, shingles binary")


def _grouped(sketches: DataFrame, size: int, percent: int, near: int | None) -> DataFrame:
    """class, component_id, keep_row of each class that has more than one row, or links: the component's smallest doc_id, and the number of the row that has it."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = sketches.where(F.col("class").isNotNull()).groupBy("class")
    classes = materialise(classes.agg(F.min(first).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n")), "classes")
    narrow = classes.select("class", "n", "signature", F.col("least.row").alias("row"))
    members = materialise(_clustered(components(_neighbours(_keys(classes))), narrow), "clusters")
    if near is not None:
        close = _links(_all_pairs(_blocks(members, "block", "cluster")), percent, near)
        members = materialise(_clustered(components(close), narrow), "near-clusters")
    sets = materialise(_sets(sketches, members, size), "sets")
    # the least class of each cluster against the others, which it meets block by block
    blocked = _blocks(members, "block", "cluster")
    heads = members.groupBy("cluster").agg(F.min("class").alias("head"))
    star = materialise(blocked.join(heads, "cluster"), "star")
    head = star.where("class = head").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("block_n") - 1)))
    group = lambda rows, is_head: rows.select("cluster", "i", F.lit(0).alias("j"), "class", "comp", "n", "signature", F.lit(is_head).alias("left"), F.lit(not is_head).alias("right"))
    rays = group(head, True).unionByName(group(star.where("class <> head").withColumn("i", F.col("block")), False))
    linked = materialise(_links(rays.join(sets, "class"), percent, near), "rays")
    # what is outside the largest group of each cluster against all of the cluster
    roots = components(linked).select(F.col("node").alias("class"), F.col("root").alias("__root"))
    told = materialise(members.drop("comp").join(roots, "class", "left").withColumn("comp", F.coalesce("__root", "class")).drop("__root"), "told")
    sizes = told.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("cluster").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("groups")).where("groups > 1").drop("groups")
    open_ = materialise(told.join(largest, "cluster").withColumn("inside", F.col("comp") == F.col("main")), "open")
    outside = materialise(_blocks(open_.where("not inside"), "block", "cluster"), "outside")
    inside = _blocks(open_.where("inside"), "block", "cluster")
    counts = outside.select("cluster", F.col("block_n").alias("outside_n")).distinct()
    inside = materialise(inside.join(counts, "cluster"), "inside")
    met = inside.select("cluster", F.col("block_n").alias("inside_n")).distinct()
    line = lambda rows, i, j, left, right: rows.select("cluster", i.alias("i"), j.alias("j"), "class", "comp", "n", "signature", F.lit(left).alias("left"), F.lit(right).alias("right"))
    among = _all_pairs(outside).select("cluster", "i", "j", "class", "comp", "n", "signature", "left", "right")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # groups of outside block i and inside block j have -1 - j, so that none is taken for a pair of outside blocks
    across = line(outside.join(met, "cluster").withColumn("o", each("inside_n")), F.col("block"), -1 - F.col("o"), True, False).unionByName(line(inside.withColumn("o", each("outside_n")), F.col("o"), -1 - F.col("block"), False, True))
    rest = _links(among.unionByName(across).join(sets, "class"), percent, near)
    roots = components(linked.unionByName(rest))
    # the least row of each component, for classes that have company
    named = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").select("class", "least", "copies", F.coalesce("root", "class").alias("root"), F.col("root").isNotNull().alias("linked"))
    named = materialise(named.where("linked or copies > 1"), "named")
    least = named.groupBy("root").agg(F.min("least").alias("first"))
    return named.join(least, "root").select("class", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("keep_row"))


def near_dedup(docs: DataFrame, size: int = SHINGLE, percent: int = SIMILARITY_PERCENT, near: int | None = NEAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    sketches = materialise(_sketches(docs, size, []), "sketches")
    with scratch(docs.sparkSession):
        final = materialise(_grouped(sketches, size, percent, near), "final", outer=True)
    out = sketches.select("doc_id", "n_shingles", "class").join(final.withColumn("known", F.lit(True)), "class", "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def survivors(docs: DataFrame, size: int = SHINGLE, percent: int = SIMILARITY_PERCENT, broadcast_rows: int = BROADCAST_ROWS, near: int | None = NEAR) -> DataFrame:
    """The rows of docs that stay, one of each component; rows are told apart by a number of their own."""
    sketches = materialise(_sketches(docs, size, docs.columns), "sketches")
    with scratch(docs.sparkSession):
        final = _grouped(sketches, size, percent, near).select("class", "keep_row")
        gone = sketches.select("row", "class").join(final, "class").where("row != keep_row").select("row")
        gone = materialise(gone, "gone", outer=True)
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return sketches.join(gone, "row", "left_anti").select(*[F.col(c) if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns])
