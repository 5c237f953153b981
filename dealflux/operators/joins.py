"""Joins of the star schema.

No side is hinted: Spark broadcasts a side it measures to be small and shuffles both otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflux.functions import columns as C
from dealflux.plans import kernels as K


def deals_with_companies(deals: DataFrame, companies: DataFrame, how: str = "inner") -> DataFrame:
    """Deals with their company's columns."""
    return deals.join(companies.withColumnRenamed("id", "company_id"), "company_id", how)


def companies_with_geography(companies: DataFrame, ecosystems: DataFrame) -> DataFrame:
    return companies.join(ecosystems, "ecosystem_name", "left")


def investments_with_investors(deal_investor: DataFrame, investors: DataFrame) -> DataFrame:
    return deal_investor.join(investors.select(F.col("id").alias("investor_id"), "country", "investor_type"), "investor_id")


def investments_with_deals(deal_investor: DataFrame, deals: DataFrame) -> DataFrame:
    """Every investment with its deal's amount and date, unmatched deals kept as null."""
    d = deals.select(F.col("id").alias("deal_id"), "company_id", "amount", "date", "year")
    return deal_investor.join(d, "deal_id", "left")


def investments_with_companies(deal_investor: DataFrame, deals: DataFrame, companies: DataFrame) -> DataFrame:
    d = deals.select(F.col("id").alias("deal_id"), "company_id", "amount", "date", "year")
    return deal_investor.join(deals_with_companies(d, companies), "deal_id")


def sector_counts(companies: DataFrame) -> DataFrame:
    """Primary and secondary sector counts side by side."""
    first = K.aggregate_by(companies, ["primary_tag"], n=F.count(F.lit(1))).toDF("sector", "primary_count")
    second = K.aggregate_by(companies, ["secondary_tag"], n=F.count(F.lit(1))).toDF("sector", "secondary_count")
    return first.join(second, "sector", "full_outer").fillna(0)


def with_later_month(monthly: DataFrame, month: str = "month") -> DataFrame:
    """Months that have a later month in the same series: those before the last one.

    The correlated test "exists a month >= this + 1 month" only asks for the maximum.
    """
    last = K.scalar(monthly, F.max(month))
    return monthly.where(F.col(month) + F.expr("interval 1 month") <= last)


def with_group_total(df: DataFrame, keys: list[str], out: str = "group_rows") -> DataFrame:
    """Rows with the size of their group, aggregated first and joined back."""
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)), keys)
