"""Row filters and the counts that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflux.functions import columns as C
from dealflux.functions import vocab as V
from dealflux.plans.kernels import aggregate_by, present


def exclude(df: DataFrame, col: str = "device_family", values: Sequence[str] = V.MOBILE_DEVICES, *, keep_null: bool = False) -> DataFrame:
    """Drop rows with the listed values; null rows go too unless ``keep_null``."""
    return df.where(C.not_in(col, values, keep_null=keep_null))


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols) or ["user_id"])


def since(df: DataFrame, ts: str, cutoff: str) -> DataFrame:
    """Rows at or after a cutoff."""
    return df.where(F.col(ts) >= F.lit(cutoff).cast("timestamp"))


def since_report(df: DataFrame, ts: str, cutoff: str) -> DataFrame:
    kept = F.count_if(F.col(ts) >= F.lit(cutoff).cast("timestamp"))
    counts = df.agg(F.count(F.lit(1)).alias("before"), kept.alias("after"))
    return counts.withColumn("removed", F.col("before") - F.col("after")).withColumn(
        "removed_percent", C.percent("removed", "before")
    )


def years(df: DataFrame, first: int, last: int, *, date: str = "date") -> DataFrame:
    """Rows dated in first..last, as a date range that reaches the scan."""
    low, high = F.lit(f"{first}-01-01").cast("date"), F.lit(f"{last + 1}-01-01").cast("date")
    return df.where((F.col(date) >= low) & (F.col(date) < high))


def before_year(df: DataFrame, year: int, *, date: str = "date") -> DataFrame:
    return df.where(F.col(date) < F.lit(f"{year}-01-01").cast("date"))


def starts_with_any(df: DataFrame, prefixes: Sequence[str], col: str = "event_type") -> DataFrame:
    test = F.lit(False)
    for p in prefixes:
        test = test | F.col(col).startswith(p)
    return df.where(test)


def all_null(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.where(F.col(c).isNull())
    return df


def column_equality(df: DataFrame, left: str, right: str) -> DataFrame:
    """Counts of rows where two columns are the same (null equal to null) or differ."""
    same = F.col(left).eqNullSafe(F.col(right))
    return df.agg(F.count_if(same).alias("equal_rows"), F.count_if(~same).alias("different_rows"))


def min_group_size(df: DataFrame, key: str, more_than: int) -> DataFrame:
    """Rows of groups holding more than a number of rows."""
    large = aggregate_by(df, [key], _n=F.count(F.lit(1))).where(F.col("_n") > more_than)
    return df.join(large.select(key), key, "left_semi")


def sessions_where(df: DataFrame, test: Column, session: str = "session_id") -> DataFrame:
    """Ids of sessions whose aggregate satisfies ``test``."""
    return present(df, session).groupBy(session).agg(test.alias("_t")).where("_t").select(session)


def drop_sessions(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids, ids.columns, "left_anti")


def drop_single_event_sessions(df: DataFrame, session: str = "session_id") -> DataFrame:
    return drop_sessions(df, sessions_where(df, F.count(F.lit(1)) == 1, session))


def drop_sessions_of_only(df: DataFrame, event: str, session: str = "session_id", col: str = "event_type") -> DataFrame:
    """Remove sessions in which every event is ``event``."""
    only = F.bool_and(F.coalesce(F.col(col) == event, F.lit(False)))
    return drop_sessions(df, sessions_where(df, only, session))
