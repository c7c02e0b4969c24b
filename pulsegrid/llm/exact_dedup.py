"""Exact duplicates by two-pass Bloom filtering. Native: DataFrame functions only.

Pass 1 maps each text's SHA-256 to PROBES bits of one block of a bit filter and counts rows per bit, on each task first; the filter has a bit set where a bit
was hit more than once. Pass 2 probes every row: a row with an unset bit is the only one with its text and passes straight through; the others (all true
repeats and a few false ones) are shuffled and grouped by the full SHA-256, which decides.

The filter has about BITS_PER_ROW bits a row. Up to BROADCAST_BITS it is broadcast (so at most BROADCAST_BITS / 8 bytes); beyond that it is joined as a table on
its block number, one join for all probes, and the rows move once, to their blocks.

Defined results: null counts as the empty text, and empty texts are equal to each other; of equal texts the largest doc_id stays (null ids
only if all are null), and rows that repeat that doc_id too are each marked kept. survivors() keeps one row of equal texts, whatever their ids. Extra columns
are passed on; columns named like the result's are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

PROBES = 2
BITS_PER_ROW = 16
MIN_BITS = 1 << 18
BROADCAST_BITS = 1 << 28
#: Bits in one block of Spark's bitmap functions: 4096 bytes.
BLOCK = 32768
RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def _block(sha: Column, blocks: int) -> Column:
    return F.pmod(F.conv(F.substring(sha, 1, 13), 16, 10).cast("long"), F.lit(blocks))


def _bits(sha: Column) -> list[Column]:
    """PROBES bits of a block: pieces of the digest."""
    return [F.pmod(F.conv(F.substring(sha, 14 + 4 * k, 4), 16, 10).cast("long"), F.lit(BLOCK)) for k in range(PROBES)]


def repeat_filter(shas: DataFrame, blocks: int) -> DataFrame:
    """(block, bitmap): the bits that two or more rows hit. Column of shas: sha."""
    hits = shas.select(_block(F.col("sha"), blocks).alias("block"), F.explode(F.array_distinct(F.array(*_bits(F.col("sha"))))).alias("bit"))
    more = hits.groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return more.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))).cast("int"), F.lit(2)) == 1, F.lit(False))


def _probed(rows: DataFrame, bits: int | None, broadcast_bits: int) -> DataFrame:
    """rows (with text_sha256) with __seen: may another row have this text?"""
    if bits is None:
        bits = MIN_BITS
        wanted = BITS_PER_ROW * rows.count()  # from Parquet footers: no column is read
        while bits < wanted:
            bits *= 2
    blocks = max(1, bits // BLOCK)
    found = repeat_filter(rows.select(F.col("text_sha256").alias("sha")), blocks).select(F.col("block").alias("__block"), F.col("bitmap").alias("__bitmap"))
    if bits <= broadcast_bits:
        found = F.broadcast(found)
    joined = rows.join(found, _block(F.col("text_sha256"), blocks) == F.col("__block"), "left")
    seen = F.lit(True)
    for bit in _bits(F.col("text_sha256")):
        seen = seen & _is_set(F.col("__bitmap"), bit)
    return joined.select(*rows.columns, seen.alias("__seen"))


def _hashed(docs: DataFrame, columns: list) -> DataFrame:
    return docs.select(*columns, F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def exact_dedup(docs: DataFrame, bits: int | None = None, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256."""
    keep = [c for c in docs.columns if c not in RESULT]
    probed = _probed(_hashed(docs, keep), bits, broadcast_bits)
    alone = probed.where(~F.col("__seen")).select(*keep, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = probed.where("__seen")
    groups = materialise(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    # both sides of this join come straight from an exchange, so that AQE can split a hot text over many tasks
    settled = maybe.join(groups, "text_sha256").select(*keep, "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(settled)


def survivors(docs: DataFrame, bits: int | None = None, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """The rows of docs that stay: of equal texts one row, one of those with the largest doc_id (null if all are), also where ids are repeated.

    Each task keeps one row of a text before any moves, so a text that a third of all rows have moves once a task.
    """
    probed = _probed(_hashed(docs, [F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), F.col("doc_id").alias("__id")]), bits, broadcast_bits)
    order = F.struct(F.col("__id").isNotNull(), "__id")
    one = probed.where("__seen").groupBy("text_sha256").agg(F.max_by("__row", order).alias("__row"))
    return probed.where(~F.col("__seen")).select("__row.*").unionByName(one.select("__row.*"))
