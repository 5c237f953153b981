"""Structured Streaming forms of ingest, hourly counts and sessions; each accounts for every event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType, *, ts: str = "ts", files_per_batch: int | None = None) -> DataFrame:
    """File stream of events with the time stamp as TIMESTAMP (windows need it)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def _run(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest(stream: DataFrame, path: str, checkpoint: str, *, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Events once each, however late, as Parquet by day at ``path``; returns what is there.

    A batch is compared with the days it touches alone, so nothing is kept in state and no file is too
    late. A batch that runs again after a failure finds its own rows and adds none. Repeats of an event
    carry its time stamp; events without one or without a key form a day or key of their own.
    """
    day = F.coalesce(F.to_date(ts).cast("string"), F.lit("none"))
    schema = stream.withColumn("event_date", day).schema
    stream.sparkSession.createDataFrame([], schema).write.mode("append").partitionBy("event_date").parquet(path)

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("event_date", day).dropDuplicates([key, "event_date"])
        days = [r[0] for r in new.select("event_date").distinct().collect()]  # bounded by the calendar
        there = spark.read.schema(schema).parquet(path).where(F.col("event_date").isin(days)).select(F.col(key).alias("_k"), F.col("event_date").alias("_d"))
        fresh = new.join(there, new[key].eqNullSafe(there["_k"]) & (new["event_date"] == there["_d"]), "left_anti")
        fresh.write.mode("append").partitionBy("event_date").parquet(path)

    _run(stream.writeStream.foreachBatch(add), checkpoint)
    return stream.sparkSession.read.schema(schema).parquet(path).drop("event_date")


def hourly_counts(stream: DataFrame, *, ts: str = "ts", by: str = "event_type", delay: str | None = None) -> DataFrame:
    """Counts per tumbling hour and event type. With ``delay``, a running append query may forget older hours."""
    rows = stream.withWatermark(ts, delay) if delay else stream
    counts = rows.groupBy(F.window(ts, "1 hour").alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("hour_start"), by, "n")


def sessions(stream: DataFrame, *, ts: str = "ts", user: str = "user_id", gap: str = "12 hours", delay: str | None = None) -> DataFrame:
    """Gap sessions per user. With ``delay``, a running append query emits them once the watermark has passed their end."""
    rows = stream.withWatermark(ts, delay) if delay else stream
    counts = rows.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("start_time"), F.max(ts).alias("end_time"))
    return counts.select(user, "start_time", "end_time", "events")


def _batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)


def _dropped(spark: SparkSession, path: str, number: int) -> None:
    """Delete the folder of one batch, if it is there, in whatever store ``path`` lies."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run_available(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "complete", keys: Sequence[str] = ()) -> DataFrame:
    """Process all files present now and return the result at ``path``.

    ``update`` writes only the rows a batch has changed, and of rows with equal ``keys`` the latest counts;
    open windows and late events are held. ``complete`` holds them too, for results that cannot be updated:
    each batch writes the whole result as its own partition, the last one counts, and older ones but one are
    deleted. A batch that runs again after a failure overwrites its own rows. ``append`` is for endless streams
    with a watermark and leaves out windows that are still open.
    """
    spark = stream.sparkSession
    if mode == "append":
        _run(stream.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint)
        return spark.read.schema(stream.schema).parquet(path)
    if mode == "update" and not keys:
        raise ValueError("update needs the keys that tell rows apart")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if mode == "complete":
            _dropped(batch.sparkSession, path, number - 2)

    _run(stream.writeStream.outputMode(mode).foreachBatch(put), checkpoint)
    rows = _batches(spark, path, stream.schema)
    if mode == "update":
        names = [c for c in stream.columns if c not in keys]
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("_latest"))
        return latest.select(*[F.col(c) if c in keys else F.col(f"_latest.{c}") for c in stream.columns])
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(last, "batch").drop("batch")
