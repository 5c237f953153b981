"""Sinks: CSV chunks, JSON documents, stored results and transition edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spark writes milliseconds to text files unless told otherwise.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_csv_chunks(df: DataFrame, path: str, *, rows_per_file: int = 100_000) -> None:
    """CSV with header, at most ``rows_per_file`` rows a file, no index column; quotes in fields are doubled."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"').option("maxRecordsPerFile", rows_per_file)
    writer.option("timestampFormat", MICROS).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).option("timestampFormat", MICROS).json(path)


def as_documents(df: DataFrame, out: str = "document") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "timestampFormat": MICROS}).alias(out))


def store(df: DataFrame, path: str) -> DataFrame:
    """Write a result as Parquet and return it read back, so later steps start from stored rows."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_events(df: DataFrame, path: str) -> None:
    """Cleaned events as Parquet partitioned by day, one shuffle by day and (session, hour).

    A day is spread over several files, and a session of many events over the hours of the day,
    so neither a busy day nor a busy session is one task.
    """
    day = df.withColumn("event_date", F.to_date("event_time"))
    spread = F.pmod(F.xxhash64("session_id", F.hour("event_time")), F.lit(32))
    day.repartition("event_date", spread).write.mode("overwrite").partitionBy("event_date").parquet(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Transition probabilities as JSON lines."""
    write_json(edges.select("src", "dst", "prob", "avg_secs"), path)
