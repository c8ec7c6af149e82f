"""Streaming views of growing logs: progress, idempotent commits, step telemetry."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_progress(stream: DataFrame, status: str = "status") -> DataFrame:
    """Rows by status so far, for update or complete mode. State is one row a status."""
    return stream.groupBy(status).agg(F.count("*").alias("n"))


def committed(spark: SparkSession, path: str) -> DataFrame:
    """All records committed under a path, by batches or by streams."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def _folder(spark: SparkSession, path: str, make: bool = False) -> bool:
    """True if the folder exists; with `make` it is made if it doesn't."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(jpath) or (make and files.mkdirs(jpath))


_REFUSED = "a record's binding differs from the committed one"


def commit_batch(batch: DataFrame, path: str, key: str, binding: str) -> None:
    """Appends records whose key isn't committed yet. A batch with two bindings for a key, or another binding than the
    committed one, is refused; records committed already are left out. Reads the whole table: streams use stream_commit."""
    spark = batch.sparkSession
    one = batch.groupBy(key).agg(F.min(binding).alias("_lo"), F.max(binding).alias("_hi"))
    bad = one.where("_lo <> _hi").select(key)
    fresh = batch.dropDuplicates([key])
    if _folder(spark, path):
        known = committed(spark, path).select(key, F.col(binding).alias("_b"))
        bad = bad.unionByName(one.join(known, key).where("_lo <> _b").select(key))
        fresh = fresh.join(known.select(key), key, "left_anti")
    if bad.limit(1).count():
        raise ValueError(_REFUSED)
    fresh.write.mode("append").parquet(path)


def stream_commit(stream: DataFrame, path: str, checkpoint: str, key: str, binding: str, **trigger) -> StreamingQuery:
    """Commits a stream's records once each; another binding for a key, whenever it comes, stops the query before its batch is written.

    What is known of a key (its bindings, first record, and when it first came) is keyed state, so a batch costs what its own keys cost,
    not what the table holds. The table is a second source of the same state: what others committed before this stream began is met
    in its first batch, and what this stream wrote once more in the next. Each batch has a folder of its own that a retry
    overwrites. State is one row a key for good; a session with many keys should keep it in RocksDB
    (spark.sql.streaming.stateStore.providerClass). Of several records of a key in its first batch the smallest is taken, so records
    can be ordered, thus hold no maps. Records without a key count as one key.
    """
    spark = stream.sparkSession
    _folder(spark, path, make=True)
    run = f"{path}/run-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"
    old = spark.readStream.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)
    seen = lambda df, at: df.select(F.col(key).alias("_k"), F.col(binding).alias("_b"), F.struct(*[F.col(f"`{c}`") for c in stream.columns]).alias("_record"), at.alias("_at"))
    both = seen(stream, F.current_timestamp()).unionByName(seen(old, F.timestamp_seconds(F.lit(0))))
    keys = both.groupBy("_k").agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"), F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.min("_record").alias("_record"))

    def commit(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # else a second use would go through the state again
        try:
            if batch.where("_lo <> _hi").limit(1).count():
                raise ValueError(_REFUSED)
            fresh = batch.where((F.col("_first") == F.col("_last")) & (F.col("_first") > F.timestamp_seconds(F.lit(0))))
            fresh.select("_record.*").write.mode("overwrite").parquet(f"{run}/batch-{number}")
        finally:
            batch.unpersist()

    return keys.writeStream.outputMode("update").foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_steps(stream: DataFrame, event_time: str, run: str = "run", step: str = "step", window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Per run and tumbling window: steps, mean loss, mean and longest seconds; repeated (run, step) count once within the watermark."""
    once = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([run, step])
    return once.groupBy(F.window(event_time, window).alias("w"), run).agg(F.count("*").alias("steps"), F.avg("loss").alias("loss"), F.avg("seconds").alias("seconds"), F.max("seconds").alias("longest"))
