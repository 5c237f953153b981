"""Tables over forecast rows: growth summaries, rankings and forecast against actual."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflux.functions import columns as C
from dealflux.functions import vocab as V
from dealflux.operators.projections import stage
from dealflux.plans import kernels as K


def sector_stage_growth(deals: DataFrame, companies: DataFrame) -> DataFrame:
    """Per sector and stage: last quarter's deals and amount, their growth over the quarter before,
    and the share of past quarters in which the amount grew.

    Built from the deals themselves in the shape of a sector growth result document.
    """
    rows = deals.withColumn("quarter", F.to_date(F.date_trunc("quarter", "date")))
    per = stage(rows, V.STAGES).groupBy("company_id", "stage", "quarter").agg(F.count(F.lit(1)).alias("deals"), C.total("amount").alias("amount"))
    who = companies.select(F.col("id").alias("company_id"), F.col("primary_tag").alias("sector"))
    cells = K.aggregate_by(per.join(who, "company_id"), ["sector", "stage", "quarter"], deals=F.sum("deals"), amount=F.sum("amount"))
    keys = ["sector", "stage"]
    wide = K.growth(K.growth(cells, keys, "quarter", "amount", "growth_rate_amount"), keys, "quarter", "deals", "growth_rate_deals")
    up = F.avg(F.when(F.col("growth_rate_amount") > 0, 1.0).when(F.col("growth_rate_amount").isNotNull(), 0.0))
    last = F.max_by(F.struct("growth_rate_amount", "growth_rate_deals", "amount", "deals"), "quarter")
    return wide.groupBy(*keys).agg(up.alias("growth_probability"), last.alias("_l")).select(
        *keys, F.col("_l.growth_rate_amount").alias("growth_rate_amount"), F.col("_l.growth_rate_deals").alias("growth_rate_deals"),
        "growth_probability", F.col("_l.amount").alias("total_amount_last_quarter"), F.col("_l.deals").alias("deal_count_last_quarter"),
    )


def stage_summary(rows: DataFrame) -> DataFrame:
    """Mean growth and probability and summed volume by stage."""
    return K.aggregate_by(
        rows, ["stage"], growth_rate_amount=F.avg("growth_rate_amount"), growth_rate_deals=F.avg("growth_rate_deals"),
        growth_probability=F.avg("growth_probability"), total_amount=F.sum("total_amount_last_quarter"),
        deal_count=F.sum("deal_count_last_quarter"),
    )


def growth_heatmap(rows: DataFrame) -> DataFrame:
    """Sector x stage mean growth, zero-filled, with the sector's overall mean."""
    cells = K.aggregate_by(rows, ["sector", "stage"], growth=F.avg("growth_rate_amount"))
    full = K.grid_fill(cells, cells.select("sector"), "stage", K.values_array(cells, "stage"), {"growth": 0.0}).fillna({"growth": 0.0})
    return full.join(K.aggregate_by(rows, ["sector"], sector_growth=F.avg("growth_rate_amount")), "sector")


def ranked_growth(rows: DataFrame, *, min_growth: float | None = None, min_probability: float | None = None,
                  min_amount: float | None = None, top: int = 10) -> DataFrame:
    """Forecast rows above thresholds, ordered by probability and growth."""
    if min_growth is not None:
        rows = rows.where(F.col("growth_rate_amount") > min_growth)
    if min_probability is not None:
        rows = rows.where(F.col("growth_probability") >= min_probability)
    if min_amount is not None:
        rows = rows.where(F.col("total_amount_last_quarter") > min_amount)
    return K.top_k(rows, top, F.desc("growth_probability"), F.desc("growth_rate_amount"), F.asc("sector"), F.asc("stage"))


def forecast_vs_actual(forecast: DataFrame) -> DataFrame:
    """Ecosystem forecasts in millions beside the last actual year, largest first."""
    return forecast.select(
        "ecosystem", (F.col("predicted_amount") / 1e6).alias("predicted_amount"), (F.col("actual_amount") / 1e6).alias("actual_amount"),
        C.change("predicted_amount", "actual_amount").alias("amount_growth_rate"), "predicted_deals", "actual_deals",
        C.change("predicted_deals", "actual_deals").alias("deals_growth_rate"),
        (F.col("growth_probability") * 100).alias("growth_probability"),
    ).orderBy(F.desc("predicted_amount"), "ecosystem")
