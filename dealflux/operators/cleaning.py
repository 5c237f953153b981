"""Deduplication, imputation, z-score filtering and the ordered cleaning pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflux.functions import columns as C
from dealflux.functions import vocab as V
from dealflux.operators import filters, projections
from dealflux.operators.sessions import with_duration
from dealflux.plans import kernels as K


def dedup(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def fill_unknown(df: DataFrame, columns: Sequence[str] = ("region", "city"), value: str = V.UNKNOWN) -> DataFrame:
    return df.fillna(value, subset=list(columns))


def fill_region_by_city(df: DataFrame) -> DataFrame:
    """Null regions from the city's most frequent region, then from the overall one."""
    by_city = K.mode_by(df, ["city"], "region", "_city_region")
    counts = K.present(df, "region").groupBy("region").agg(F.count(F.lit(1)).alias("_n"))
    overall = K.scalar(counts, F.min(F.struct(-F.col("_n"), "region")).getField("region"))
    return df.join(by_city, "city", "left").withColumn("region", F.coalesce("region", "_city_region", overall)).drop("_city_region")


def impute_city(df: DataFrame) -> DataFrame:
    """Null cities from the most frequent city of the same country and region, else Unknown."""
    keys = ["country", "region"]
    usual = K.mode_by(df, keys, "city", "_usual_city")
    return df.join(usual, keys, "left").withColumn("city", F.coalesce("city", "_usual_city", F.lit(V.UNKNOWN))).drop("_usual_city")


def with_zscore(df: DataFrame, column: str, out: str = "zscore") -> DataFrame:
    """Standard score against the whole column (sample standard deviation)."""
    stats = df.select(F.struct(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))).scalar()
    wide = df.withColumn("_s", stats)
    return wide.withColumn(out, F.try_divide(F.col(column) - F.col("_s.m"), F.col("_s.s"))).drop("_s")


def zscore_filter(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """Rows whose absolute standard score lies below the limit."""
    return with_zscore(df, column, "_z").where(F.abs("_z") < limit).drop("_z")


def clean_steps(
    df: DataFrame,
    *,
    cutoff: str = "2025-01-01",
    drop: Sequence[str] = (),
    essential: Sequence[str] = ("event_id", "session_id", "event_type", "event_time"),
    devices: Sequence[str] = V.MOBILE_DEVICES,
    constants: Sequence[str] | None = None,
):
    """Yield (step name, table) in cleaning order.

    ``constants`` names constant columns already known; otherwise one profiling job finds them.
    """
    dropped = projections.drop_constant_columns(df, essential) if constants is None else df.drop(*constants)
    yield "constant_columns", dropped
    recent = filters.since(dropped, "event_time", cutoff)
    yield "cutoff", recent
    slim = projections.drop_columns(recent, drop)
    yield "drop_columns", slim
    located = fill_unknown(slim)
    yield "fill_location", located
    desk = filters.exclude(located, "device_family", devices, keep_null=True)
    yield "exclude_devices", desk
    known = filters.not_null(desk, "user_id")
    yield "known_users", known
    timed = with_duration(known)
    yield "duration", timed
    usual = zscore_filter(timed, "session_duration")
    yield "zscore", usual
    done = projections.latencies(projections.time_features(usual)).drop("user_id")
    yield "features", done


def clean(df: DataFrame, **options) -> DataFrame:
    """The fully cleaned event table."""
    for _, table in clean_steps(df, **options):
        pass
    return table


def clean_report(df: DataFrame, **options) -> DataFrame:
    """Rows and columns left after every cleaning step.

    The steps before the z-score keep rows by their own values and are counted in one scan; the
    z-score needs every duration, so the last two steps share a second count.
    """
    tables = dict(clean_steps(df, **options))
    cutoff = options.get("cutoff", "2025-01-01")
    devices = options.get("devices", V.MOBILE_DEVICES)
    recent = F.col("event_time") >= F.lit(cutoff).cast("timestamp")
    desk = recent & C.not_in("device_family", devices, keep_null=True)
    known = desk & F.col("user_id").isNotNull()
    kept = {
        "constant_columns": F.lit(True), "cutoff": recent, "drop_columns": recent, "fill_location": recent,
        "exclude_devices": desk, "known_users": known, "duration": known & F.col("session_id").isNotNull(),
    }
    early = df.agg(*[F.count_if(test).alias(name) for name, test in kept.items()])
    late = tables["zscore"].agg(F.count(F.lit(1)).alias("zscore")).withColumn("features", F.col("zscore"))
    shape = {name: (i + 1, len(t.columns)) for i, (name, t) in enumerate(tables.items())}

    def long(counts: DataFrame) -> DataFrame:
        cells = [
            F.struct(F.lit(shape[c][0]).alias("step"), F.lit(c).alias("name"), F.col(c).alias("rows"), F.lit(shape[c][1]).alias("columns"))
            for c in counts.columns
        ]
        return counts.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")

    return long(early).unionByName(long(late))
