"""Regular time series per key: buckets, gaps, lags, rolling means, changes and windows.

Every function works on aggregated series (one row per key and bucket), whose length is bounded by
the calendar; windows over them are partitioned by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealflux.functions import columns as C
from dealflux.plans import kernels as K

STEPS = {"month": "month", "hour": "hour", "day": "day", "quarter": "month"}


def bucketed(df: DataFrame, ts: str, value: str, *, step: str = "month", keys: Sequence[str] = (), fill: bool = True) -> DataFrame:
    """Sum and count per bucket; absent buckets between first and last are zero when ``fill``."""
    keys = list(keys)
    rows = K.present(df, *keys, ts).withColumn("bucket", F.date_trunc(step, ts))
    sums = rows.groupBy(*keys, "bucket").agg(C.total(value).alias("value"), F.count(F.lit(1)).alias("n"))
    if not fill:
        return sums
    return K.calendar(sums, "bucket", step, keys).join(sums, [*keys, "bucket"], "left").fillna({"value": 0.0, "n": 0})


def by_key(keys: Sequence[str], order: str = "bucket") -> Window:
    return Window.partitionBy(*(keys or [F.lit(1)])).orderBy(order)


def lags(df: DataFrame, keys: Sequence[str], value: str = "value", steps: Sequence[int] = (1, 3, 6, 12), order: str = "bucket") -> DataFrame:
    w = by_key(keys, order)
    return df.withColumns({f"lag_{n}": F.lag(value, n).over(w) for n in steps})


def rolling_means(df: DataFrame, keys: Sequence[str], value: str = "value", windows: Sequence[int] = (3, 6, 12), order: str = "bucket") -> DataFrame:
    """Trailing means, null until the window is full."""
    w = by_key(keys, order)
    made = {}
    for n in windows:
        frame = w.rowsBetween(1 - n, 0)
        made[f"mean_{n}"] = F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))
    return df.withColumns(made)


def change_against(df: DataFrame, keys: Sequence[str], value: str = "value", n: int = 12, out: str = "change", order: str = "bucket") -> DataFrame:
    """Relative change against n rows back (a ratio, not a percent)."""
    before = F.lag(value, n).over(by_key(keys, order))
    return df.withColumn(out, C.ratio(F.col(value) - before, before))


def feature_table(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Lags, rolling means and the yearly change; rows with any of them missing are dropped."""
    wide = change_against(rolling_means(lags(df, keys, value), keys, value), keys, value, 12, "change_12")
    return wide.dropna()


def trailing_windows(df: DataFrame, keys: Sequence[str], value: str = "value", length: int = 12, *, full: bool = False, order: str = "bucket") -> DataFrame:
    """Array of the last ``length`` values with the next one as target; ``full`` keeps complete rows."""
    w = by_key(keys, order)
    wide = df.withColumns({
        "window": F.collect_list(value).over(w.rowsBetween(1 - length, 0)), "target": F.lead(value, 1).over(w)
    })
    return wide.where((F.size("window") == length) & F.col("target").isNotNull()) if full else wide


def hourly_ffill(df: DataFrame, ts: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Hourly mean of a value, gaps carrying the last mean forward."""
    keys = list(keys)
    rows = K.present(df, *keys, ts).withColumn("bucket", F.date_trunc("hour", ts))
    means = rows.groupBy(*keys, "bucket").agg(F.avg(value).alias("value"))
    full = K.calendar(means, "bucket", "hour", keys).join(means, [*keys, "bucket"], "left")
    upto = by_key(keys).rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("value", F.last("value", ignorenulls=True).over(upto))


def last_days(df: DataFrame, ts: str, days: int = 30) -> DataFrame:
    """Rows within the last days before the latest time stamp."""
    newest = K.scalar(df, F.max(ts))
    return df.where(F.col(ts) >= newest - F.expr(f"interval {days} days"))


def monthly_returns(deals: DataFrame) -> DataFrame:
    """Month x company change of summed amounts (0/0 = 0, x/0 = null, first month 0).

    A company's months are gathered in one row, completed over the months of the whole table and compared there, so
    that the filled rows, which are most, are neither joined nor sorted.
    """
    month = F.date_trunc("month", "date")
    cells = K.present(deals, "company_id").groupBy("company_id", month.alias("month")).agg(
        C.total("amount").alias("amount"), F.max(F.col("amount").isNotNull()).alias("_known")
    )
    sums = cells.groupBy("company_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("month").isNotNull(), F.struct("month", "amount")))).alias("_m"),
        F.max("_known").alias("_known"), F.min("month").alias("_a"), F.max("month").alias("_b"),
    ).where(F.col("_known") & F.col("_a").isNotNull())
    span = sums.select(F.struct(F.min("_a").alias("a"), F.max("_b").alias("b"))).scalar()
    months = sums.withColumn("_s", span).withColumn("month", F.sequence("_s.a", "_s.b", F.expr("interval 1 month")))
    number = lambda v: F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(0.0))
    filled = months.withColumn("amount", F.transform("month", lambda m: number(F.try_element_at("_m", m))))
    shifted = F.concat(F.array(F.lit(None).cast("double")), F.slice("amount", 1, F.size("amount") - 1))
    full = filled.withColumn("_before", shifted).select("company_id", F.explode(F.arrays_zip("month", "amount", "_before")).alias("_r"))
    full = full.select("company_id", "_r.month", "_r.amount", "_r._before")
    before = F.col("_before")
    change = F.when(before.isNull() | ((before == 0) & (F.col("amount") == 0)), F.lit(0.0)).otherwise(
        C.ratio(F.col("amount") - before, before)
    )
    return full.select("company_id", "month", "amount", change.alias("change"))


def mean_step(df: DataFrame, order: str, value: str) -> DataFrame:
    """Mean difference of consecutive values of a small ordered table."""
    before = F.lag(value).over(by_key([], order))
    return df.withColumn("_d", F.col(value) - before).agg(F.avg("_d").alias("mean_step"))
