"""Derived columns and column dropping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflux.functions import columns as C
from dealflux.functions import vocab as V
from dealflux.plans.kernels import scalar, unpivot


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the listed columns that exist."""
    return df.drop(*[c for c in columns if c in df.columns])


def drop_report(df: DataFrame, steps: Mapping[str, Sequence[str]]) -> DataFrame:
    """Row and column counts after each named drop step."""
    width, shapes = len(df.columns), []
    left = set(df.columns)
    for i, (name, cols) in enumerate(steps.items()):
        left -= set(cols)
        shapes.append(F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("name"),
                               F.lit(len(left)).alias("columns_left"), F.lit(width - len(left)).alias("columns_dropped")))
    counted = df.agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("rows", F.explode(F.array(*shapes)).alias("_s")).select("_s.*", "rows")


def constant_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Columns with exactly one distinct non-null value, found in one pass by min = max."""
    cols = [c for c in df.columns if c not in keep]
    flags = [(F.min(f"`{c}`") == F.max(f"`{c}`")).alias(c) for c in cols]
    return unpivot(df.agg(*flags), [], cols, "column_name", "constant").where("constant").select("column_name")


def drop_constant_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop constant columns; one profiling job decides which (a list of column names)."""
    found = [r.column_name for r in constant_columns(df, keep).collect()]
    return df.drop(*found)


def time_features(df: DataFrame, ts: str = "event_time") -> DataFrame:
    """hour, day, weekday (Monday = 0), month, year, day name, date and year-month."""
    t = F.col(ts)
    return df.withColumns(
        {
            "hour": F.hour(t),
            "day": F.dayofmonth(t),
            "weekday": F.weekday(t),
            "month": F.month(t),
            "year": F.year(t),
            "day_of_week": F.date_format(t, "EEEE"),
            "event_date": F.to_date(t),
            "year_month": C.month_label(t),
        }
    )


def date_parts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """<c>_year, <c>_month and <c>_quarter for every date column."""
    made = {}
    for c in cols:
        made |= {f"{c}_year": F.year(c), f"{c}_month": F.month(c), f"{c}_quarter": F.quarter(c)}
    return df.withColumns(made)


def latencies(df: DataFrame) -> DataFrame:
    """Server and processing latency in seconds."""
    return df.withColumns(
        {
            "server_latency": C.seconds_between("client_upload_time", "processed_time"),
            "processing_latency": C.seconds_between("server_upload_time", "processed_time"),
        }
    )


def company_age(df: DataFrame, *, as_of: str | Column, founded: str = "date_founded", out: str = "age") -> DataFrame:
    """Years since founding at a date (text) or at a date column."""
    at = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return df.withColumn(out, C.years_between(founded, at))


def stage(df: DataFrame, mapping: Mapping[str, str] = V.STAGES, *, col: str = "round_type", out: str = "stage") -> DataFrame:
    """Funding stage of a round type; unmapped types give null."""
    return df.withColumn(out, C.lookup(col, mapping))


def home_region(df: DataFrame, *, col: str = "investor_country", out: str = "region") -> DataFrame:
    """Canada, USA or Other International (also for unknown countries)."""
    return df.withColumn(out, C.lookup(col, V.HOME_REGIONS, V.REGION_OTHER))


def deal_size(df: DataFrame, *, col: str = "amount", out: str = "deal_size") -> DataFrame:
    return df.withColumn(out, C.bins(col, V.DEAL_SIZE_EDGES, V.DEAL_SIZE_LABELS))


def deal_size_millions(df: DataFrame, *, col: str = "amount", out: str = "size_class") -> DataFrame:
    return df.withColumn(out, C.bins(F.col(col) / 1e6, V.DEAL_MILLION_EDGES, V.DEAL_MILLION_LABELS))


def age_band(df: DataFrame, *, col: str = "age", out: str = "age_band") -> DataFrame:
    return df.withColumn(out, C.bins(col, V.AGE_EDGES, V.AGE_LABELS))


def daytime(hour: Column, *, include_lowest: bool = False) -> Column:
    """night, morning, afternoon or evening; hour 0 reads "nan" unless ``include_lowest``."""
    part = C.bins(hour, V.DAYTIME_EDGES, V.DAYTIME_LABELS, include_lowest=include_lowest)
    return F.coalesce(part, F.lit("nan"))


def success_flag(df: DataFrame, *, col: str = "total_funding", threshold: str = "max", out: str = "is_successful") -> DataFrame:
    """1 when funding lies above the overall maximum (always 0) or above the median."""
    from dealflux.operators.features import funding_threshold

    if threshold == "max":
        limit = scalar(df, F.max(col))
    else:
        limit = funding_threshold(df, col=col, threshold=threshold).scalar()
    return df.withColumn(out, F.when(F.col(col) > limit, 1).otherwise(0))
