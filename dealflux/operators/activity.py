"""Time, place, device and latency analyses of an event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealflux.functions import columns as C
from dealflux.operators.projections import latencies
from dealflux.operators.sessions import session_spans, with_duration
from dealflux.plans import kernels as K

TS = "event_time"


def overview(df: DataFrame, *, approx: bool = False) -> DataFrame:
    """Rows, distinct users, sessions, types, countries and cities, time range, events per user.

    Exact distinct counts expand rows once per counted column, so equal rows are summed up first;
    ``approx`` uses one small sketch per column in a single pass.
    """
    distinct = F.approx_count_distinct if approx else F.count_distinct
    counted = ["user_id", "session_id", "event_type", "country", "city"]
    rows = df.groupBy(*counted).agg(F.count(F.lit(1)).alias("_n"), F.min(TS).alias("_first"), F.max(TS).alias("_last"))
    whole = rows.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("events"),
        *[distinct(c).alias(n) for n, c in [
            ("users", "user_id"), ("sessions", "session_id"), ("event_types", "event_type"),
            ("countries", "country"), ("cities", "city")]],
        F.min("_first").alias("first_time"), F.max("_last").alias("last_time"),
    )
    return whole.withColumn("events_per_user", C.ratio("events", "users"))


def by_hour(df: DataFrame) -> DataFrame:
    """Events and distinct sessions per hour of day."""
    return df.groupBy(F.hour(TS).alias("hour")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("session_id").alias("sessions"))


def by_day(df: DataFrame) -> DataFrame:
    """Events and distinct sessions per day of week, Sunday = 1."""
    return df.groupBy(F.dayofweek(TS).alias("day")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("session_id").alias("sessions"))


def distributions(df: DataFrame) -> DataFrame:
    """Counts by hour, weekday, month and date, in one long table."""
    parts = df.select(
        F.hour(TS).cast("string").alias("hour"), F.date_format(TS, "EEEE").alias("weekday"),
        C.month_label(TS).alias("month"), F.date_format(TS, "yyyy-MM-dd").alias("date"),
    )
    long = K.unpivot(parts, [], parts.columns, "part", "value")
    return K.aggregate_by(long, ["part", "value"], n=F.count(F.lit(1)))


def weekday_hour(df: DataFrame) -> DataFrame:
    """Counts for all 7 x 24 cells, zero-filled (Monday = 0)."""
    cells = df.groupBy(F.weekday(TS).alias("weekday"), F.hour(TS).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    days = df.limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
    return K.grid_fill(cells, days, "hour", F.sequence(F.lit(0), F.lit(23)), {"n": 0})


def daily_stats(df: DataFrame) -> DataFrame:
    """Mean, median and spread of daily counts, with the busiest day."""
    days = K.aggregate_by(df.withColumn("day", F.to_date(TS)), ["day"], n=F.count(F.lit(1)))
    return days.agg(
        F.avg("n").alias("mean_events"), F.percentile("n", 0.5).alias("median_events"),
        F.stddev_samp("n").alias("std_events"), F.max("n").alias("peak_events"),
        F.min(F.struct(-F.col("n"), "day")).getField("day").alias("peak_day"),
    )


def peaks(df: DataFrame, top: int = 3) -> DataFrame:
    """Busiest and quietest hours, busiest weekdays and months."""
    counts = distributions(df).where("part <> 'date'")
    busy = K.top_per_group(counts, ["part"], top, F.desc("n"), F.asc("value")).withColumn("kind", F.lit("peak"))
    quiet = K.top_per_group(counts.where("part = 'hour'"), ["part"], top, F.asc("n"), F.asc("value"))
    return busy.unionByName(quiet.withColumn("kind", F.lit("quiet")))


def peak_hours_by_weekday(df: DataFrame, top: int = 3) -> DataFrame:
    cells = df.groupBy(F.weekday(TS).alias("weekday"), F.hour(TS).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return K.top_per_group(cells, ["weekday"], top, F.desc("n"), F.asc("hour"))


def country_metrics(df: DataFrame) -> DataFrame:
    """Events, sessions and users per country (null country kept)."""
    rows = df.groupBy("country", "session_id", "user_id").agg(F.count(F.lit(1)).alias("_n"))
    return rows.groupBy("country").agg(
        F.sum("_n").alias("events"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("user_id").alias("users")
    )


def region_by_country(df: DataFrame, top: int = 10) -> DataFrame:
    counts = df.groupBy("country", "region").agg(F.count(F.lit(1)).alias("events"))
    return K.top_k(counts, top, F.desc("events"), F.asc("country"), F.asc("region"))


def usage(df: DataFrame, column: str) -> DataFrame:
    """Events and sessions per value of a column (null kept)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("session_id").alias("sessions"))


def city_metrics(df: DataFrame, top: int = 20) -> DataFrame:
    """Users, sessions, events and their ratios for the busiest cities."""
    rows = K.present(df, "city").groupBy("city", "user_id", "session_id").agg(F.count(F.lit(1)).alias("_n"))
    m = rows.groupBy("city").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("session_id").alias("sessions"), F.sum("_n").alias("events"))
    m = m.withColumns({"events_per_user": C.ratio("events", "users"), "sessions_per_user": C.ratio("sessions", "users")})
    return K.top_k(m, top, F.desc("events"), F.asc("city"))


def country_device(df: DataFrame, top: int = 10) -> DataFrame:
    """Country x device counts and row percent for the top countries, zero-filled."""
    rows = K.keep_keys(df, K.top_keys(df, "country", F.count(F.lit(1)), top))
    cells = K.crosstab(rows, "country", "device_family", K.values_array(rows, "device_family"))
    return K.share_of(cells, "n", ["country"], "row_percent")


def region_event_preferences(df: DataFrame, top: int = 10) -> DataFrame:
    """Region x top event types, zero-filled."""
    rows = K.keep_keys(df, K.top_keys(df, "event_type", F.count(F.lit(1)), top))
    return K.crosstab(rows, "region", "event_type", K.values_array(rows, "event_type"))


def prefix_counts(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Counts by matched prefix and event."""
    pattern = "^(" + "|".join(prefixes) + ")"
    rows = df.withColumn("prefix", F.regexp_extract("event_type", pattern, 1)).where("prefix <> ''")
    return K.aggregate_by(rows, ["prefix", "event_type"], n=F.count(F.lit(1)))


def latency_by_geo(df: DataFrame, columns: Sequence[str] = ("region", "city"), more_than: int = 1000) -> DataFrame:
    """Mean latencies of places with enough rows, and rows under 100 ms."""
    timed = latencies(df)
    long = K.unpivot(timed, ["server_latency", "processing_latency"], columns, "level", "place")
    means = K.aggregate_by(
        long, ["level", "place"],
        mean_server=F.avg("server_latency"), mean_processing=F.avg("processing_latency"),
        n=F.count("server_latency"), fast_rows=F.count_if(F.col("server_latency") < 0.1),
    )
    return means.where(F.col("n") > more_than)


def latency_duration_corr(df: DataFrame, session: str = "session_id") -> DataFrame:
    """Correlation of per-session mean latency and duration."""
    means = K.aggregate_by(latencies(df), [session], latency=F.avg("server_latency"))
    joined = means.join(session_spans(df, session), session)
    return joined.agg(F.corr("latency", "seconds").alias("correlation"), F.count(F.lit(1)).alias("sessions"))


def hourly_metrics(df: DataFrame) -> DataFrame:
    """Per hour: events, mean duration, mean latency and sessions; gaps carry the last means forward.

    ``mean_sessions`` is the mean over time stamps of distinct sessions at that stamp;
    ``sessions`` is the true distinct count of the hour.
    """
    rows = latencies(with_duration(df)).withColumn("hour_start", F.date_trunc("hour", TS))
    base = rows.groupBy("hour_start").agg(
        F.count(F.lit(1)).alias("events"), C.exact_mean("session_duration").alias("mean_duration"),
        C.exact_mean("server_latency").alias("mean_latency"), F.count_distinct("session_id").alias("sessions"),
    )
    stamps = rows.groupBy("hour_start", TS).agg(F.count_distinct("session_id").alias("_s"))
    per_stamp = stamps.groupBy("hour_start").agg(F.avg("_s").alias("mean_sessions"))
    hours = K.calendar(base, "hour_start", "hour")
    filled = hours.join(base, "hour_start", "left").join(per_stamp, "hour_start", "left").fillna({"events": 0, "sessions": 0})
    # One row per hour of the whole log: bounded by its time span.
    upto = Window.partitionBy(F.lit(1)).orderBy("hour_start").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumns(
        {c: F.last(c, ignorenulls=True).over(upto) for c in ("mean_duration", "mean_latency", "mean_sessions")}
    )
