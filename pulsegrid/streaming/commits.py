"""What happens to a reader's values: one stream, several sinks, and slots that are committed to a table every minute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import written

Sink = Callable[[DataFrame, int], None]
#: Seconds between commits. Fixed value.
CADENCE = 60


def fan_out(*sinks: Sink) -> Sink:
    """Each micro-batch goes to every sink, in order. It is written once first, so that the sinks see the same rows and the source is read once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = written(batch.sparkSession, batch, f"batch-{batch_id}")
        if not rows.isEmpty():  # nothing to do: the commit is parked
            for sink in sinks:
                sink(rows, batch_id)

    return run


def start(stream: DataFrame, checkpoint: str, *sinks: Sink, seconds: int | None = CADENCE) -> StreamingQuery:
    """Run a stream into sinks every so many seconds; None: over what is there now."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(fan_out(*sinks))
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def table_sink(path: str, buckets_a_part: int) -> Sink:
    """Slots (lane, bucket, ...) into a table kept by part (bucket div buckets_a_part): only the parts that a batch touches are written anew, and of a lane and
    bucket the newest row holds, so a batch that comes twice changes nothing."""

    def commit(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        new = rows.withColumn("part", F.call_function("div", F.col("bucket"), F.lit(buckets_a_part)))
        parts = [r["part"] for r in new.select("part").distinct().collect()]  # parts of one commit: a handful
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        both = new.withColumn("__new", F.lit(1))
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            old = spark.read.schema(new.schema).parquet(path).where(F.col("part").isin(parts))
            both = both.unionByName(old.withColumn("__new", F.lit(0)))
        kept = [c for c in rows.columns if c not in ("lane", "bucket")]
        last = both.groupBy("part", "lane", "bucket").agg(F.max_by(F.struct(*kept), "__new").alias("__r")).select("lane", "bucket", "__r.*", "part")
        settled = written(spark, last, "commit")  # not read from the parts that are about to be written
        settled.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    return commit


def snapshot_sink(path: str, key: str, order: str) -> Sink:
    """The newest row of each key, in a table of its own that is replaced."""

    def keep(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        both = rows
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            both = rows.unionByName(spark.read.schema(rows.schema).parquet(path))
        others = [c for c in rows.columns if c != key]
        newest = both.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("__r")).select(key, "__r.*").select(*rows.columns)
        written(spark, newest, "snapshot").write.mode("overwrite").parquet(path)

    return keep
