"""Investors: activity, countries, regions, stages and estimated amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealflux.functions import columns as C
from dealflux.functions import vocab as V
from dealflux.operators.joins import investments_with_deals, investments_with_investors
from dealflux.operators.projections import home_region, stage
from dealflux.plans import kernels as K


def by_country(deal_investor: DataFrame, investors: DataFrame) -> DataFrame:
    """Deals and lead deals per investor country."""
    rows = investments_with_investors(deal_investor, investors)
    return K.aggregate_by(rows, ["country"], deals=F.count("deal_id"), lead_deals=F.sum("lead_investor_flag"))


def rounds_by_country(deal_investor: DataFrame, investors: DataFrame) -> DataFrame:
    """Country x round counts, zero-filled."""
    rows = investments_with_investors(deal_investor, investors)
    return K.crosstab(rows, "country", "round_type", K.values_array(rows, "round_type"))


def active(deal_investor: DataFrame, investors: DataFrame) -> DataFrame:
    """Deals and lead deals per (investor, country)."""
    rows = investments_with_investors(deal_investor, investors)
    return K.aggregate_by(rows, ["investor_name", "country"], deals=F.count("deal_id"), lead_deals=F.sum("lead_investor_flag"))


def estimated_amounts(deal_investor: DataFrame, deals: DataFrame, top: int = 20) -> DataFrame:
    """Each deal split equally among its investments, summed per investor, largest first.

    The join brings a deal's investments together in order, so they are counted there and not in a second join.
    """
    rows = K.present(investments_with_deals(deal_investor, deals), "deal_id")
    rows = rows.withColumn("num_investors", F.count(F.lit(1)).over(Window.partitionBy("deal_id")))
    rows = rows.withColumn("estimated", C.ratio("amount", "num_investors"))
    sums = K.aggregate_by(rows, ["investor_name", "investor_id"], deals=F.count("deal_id"), amount=C.total("estimated"))
    return K.top_k(sums, top, F.desc("amount"), F.asc("investor_id"))


def region_round_share(deal_investor: DataFrame, digits: int = 1) -> DataFrame:
    """Rounded percent of rounds per region, the rounding residue added to the largest cell."""
    rows = home_region(deal_investor)
    cells = K.crosstab(rows, "region", "round_type", K.values_array(rows, "round_type"))
    shares = K.share_of(cells, "n", ["region"], "share").withColumn("share", F.round("share", digits))
    region = Window.partitionBy("region")
    first = F.row_number().over(region.orderBy(F.desc("share"), F.asc("round_type")))
    residue = 100.0 - F.sum("share").over(region)
    return shares.withColumn("share", F.when(first == 1, F.col("share") + residue).otherwise(F.col("share")))


def region_round_mean(deal_investor: DataFrame, deals: DataFrame) -> DataFrame:
    """Mean deal size in millions by (region, round)."""
    rows = home_region(investments_with_deals(deal_investor, deals))
    return K.aggregate_by(rows, ["region", "round_type"], mean_amount=F.avg("amount") / 1e6)


def stage_influence(deal_investor: DataFrame, top: int = 5) -> DataFrame:
    """Most active investors: percent of their deals in each stage, zero-filled."""
    rows = stage(deal_investor, V.STAGES_LONG)
    totals = K.aggregate_by(rows, ["investor_name"], _t=F.count("deal_id"))
    first = K.top_k(totals, top, F.desc("_t"), F.asc("investor_name"))
    kept = rows.join(first.select("investor_name"), "investor_name", "left_semi")
    cells = K.crosstab(kept, "investor_name", "stage", K.literal_array(sorted(set(V.STAGES_LONG.values()))))
    return cells.join(totals, "investor_name").select("investor_name", "stage", C.percent("n", "_t").alias("share"))


def investor_pairs(deal_investor: DataFrame) -> DataFrame:
    """Distinct (deal, investor) pairs; what exploding a deal's list of investors gives."""
    return deal_investor.select("deal_id", F.col("investor_name").alias("investor"), "round_type").distinct()


def explode_investors(deals: DataFrame, column: str = "investors") -> DataFrame:
    """(deal, investor, round) rows from an array column."""
    return deals.select(F.col("id").alias("deal_id"), F.explode(column).alias("investor"), "round_type")


def investor_rounds(pairs: DataFrame, top: int = 10) -> DataFrame:
    """Investors with most deals x round: counts, zero-filled."""
    kept = K.keep_keys(pairs, K.top_keys(pairs, "investor", F.count(F.lit(1)), top))
    return K.crosstab(kept, "investor", "round_type", K.values_array(kept, "round_type"))


def investor_round_amounts(pairs: DataFrame, deals: DataFrame, top: int = 10) -> DataFrame:
    """Investors with the largest summed deals x round: amounts, zero-filled."""
    d = deals.select(F.col("id").alias("deal_id"), F.coalesce("amount", F.lit(0.0)).alias("amount"))
    rows = pairs.join(d, "deal_id")
    kept = K.keep_keys(rows, K.top_keys(rows, "investor", F.sum("amount"), top))
    return K.crosstab(kept, "investor", "round_type", K.values_array(kept, "round_type"), F.sum("amount"), "amount")


def region_sector_sums(deal_investor: DataFrame, deals: DataFrame, companies: DataFrame) -> DataFrame:
    """Investments and their deals' amount by (region, sector).

    Investments are counted per (deal, region) first, so a deal joins its company once per region.
    """
    per_deal = home_region(deal_investor).groupBy("deal_id", "region").agg(F.count(F.lit(1)).alias("k"))
    d = deals.select(F.col("id").alias("deal_id"), "company_id", "amount")
    who = companies.select(F.col("id").alias("company_id"), "primary_tag")
    rows = per_deal.join(d, "deal_id").join(who, "company_id")
    return K.aggregate_by(rows, ["region", "primary_tag"], deals=F.sum("k"), amount=C.total(F.col("amount") * F.col("k")))


def region_sector(sums: DataFrame, top: int = 10) -> DataFrame:
    """Region x top sectors: deals, amount (millions), shares within region and within sector."""
    kept = K.keep_keys(sums, K.top_keys(sums, "primary_tag", F.sum("amount"), top))
    full = K.grid_fill(kept, kept.select("region"), "primary_tag", K.values_array(kept, "primary_tag"), {"deals": 0, "amount": 0.0})
    full = full.withColumn("amount", F.col("amount") / 1e6)
    return K.share_of(K.share_of(full, "deals", ["region"], "region_share"), "deals", ["primary_tag"], "sector_share")


def region_totals(cells: DataFrame) -> DataFrame:
    """Deals and amount per region with their shares."""
    sums = cells.groupBy("region").agg(F.sum("deals").alias("deals"), F.sum("amount").alias("amount"))
    return K.share_of(K.share_of(sums, "deals", (), "deal_share"), "amount", (), "amount_share")


def dominance(cells: DataFrame, group: str, member: str) -> DataFrame:
    """The member with most deals in each group, and its percent of the group's deals."""
    best = F.min(F.struct((-F.col("deals")).alias("d"), F.col(member).alias("m")))
    sums = cells.groupBy(group).agg(best.alias("_b"), F.sum("deals").alias("_t"))
    return sums.select(group, F.col("_b.m").alias("leader"), C.percent(-F.col("_b.d"), "_t").alias("share"))


def region_years(deal_investor: DataFrame, deals: DataFrame, before: int | None = None) -> DataFrame:
    """Investments and their deals' amount by (year, region)."""
    rows = home_region(investments_with_deals(deal_investor, deals))
    if before is not None:
        rows = rows.where(F.col("year") < before)
    return K.aggregate_by(rows, ["year", "region"], deals=F.count("deal_id"), amount=C.total("amount"))
