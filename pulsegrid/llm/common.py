"""Helpers shared by the training-data operators: scratch tables in the cluster's shared folder, and native span search."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words (fixed by the contract): space and the controls 09-0D.
WS_CHARS = " \t\n\x0b\f\r"
WS_CLASS = r"[\x20\x09-\x0D]"

_local_folders: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one for this application on a local master, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
        atexit.register(shutil.rmtree, _local_folders[app][7:], True)
    return _local_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/pulsegrid-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, runs upstream work once.

    The table goes at the end of the scratch() that it is made in (outer: of the one around that), or stays where there is none.
    """
    path = new_path(df.sparkSession, name)
    if len(_scopes) > outer:
        _scopes[-1 - outer].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialise() makes inside are deleted at the end."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it many times in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs of characters other than WS_CHARS, in order; an empty array for a text without one."""

    def inner(parts: Column) -> Column:  # only the first and the last part can be empty
        first = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
        last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
        return F.slice(parts, first + 1, F.size(parts) - first - last)

    return let(F.split(text, WS_CLASS + "+", -1), inner)


def spans(text: Column, pattern: str, context: int = 0, chunk: int = 128) -> Column:
    """Leftmost non-overlapping matches of a Java pattern as array<struct<s,e,m,c>>: code point offsets, end exclusive, the
    match, and up to `context` characters before it (from the end of the match before, at most).

    Offsets are running sums of the lengths of matches and of the pieces between them. The sums are taken chunk by chunk, so
    a text with n matches costs n * chunk steps, not n squared.
    """
    kind = "array<struct<s:int,e:int,m:string,c:string>>"
    none = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        one = F.struct(start.alias("s"), (start + x["l"]).alias("e"), x["m"].alias("m"), x["c"].alias("c"))
        return F.struct((start + x["l"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def located(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x["g"] + x["l"]))
        starts = F.aggregate(
            totals,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, t: F.struct((a["at"] + t).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        )["out"]
        return F.flatten(F.zip_with(parts, starts, lambda p, at: F.aggregate(p, F.struct(at.alias("at"), none.alias("out")), step)["out"]))

    def measured(hits: Column) -> Column:
        before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        each = F.zip_with(
            before,
            hits,
            lambda p, m: F.struct(
                F.length(p).alias("g"), F.length(m).alias("l"), m.alias("m"), (F.right(p, F.lit(context)) if context else F.lit("")).alias("c")
            ),
        )
        cut = let(each, lambda z: F.transform(F.sequence(F.lit(0), ((F.size(z) - 1) / chunk).cast("int")), lambda i: F.slice(z, i * chunk + 1, F.lit(chunk))))
        return F.when(F.size(hits) == 0, none).otherwise(let(cut, located))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), measured)


def joined_spans(found: Column) -> Column:
    """'kind:start:end' of array<struct<s,k,e,name>> in order of start, then kind, comma-joined."""
    return F.array_join(F.transform(F.sort_array(found), lambda x: F.concat_ws(":", x["name"], x["s"], x["e"])), ",")
