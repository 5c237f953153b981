"""Company age at the time of deals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflux.functions import columns as C
from dealflux.functions import vocab as V
from dealflux.operators.joins import deals_with_companies
from dealflux.operators.projections import age_band, company_age, stage
from dealflux.operators.series import mean_step
from dealflux.plans import kernels as K


def deals_with_age(deals: DataFrame, companies: DataFrame) -> DataFrame:
    """Deals with sector, ecosystem, the company's age at the deal, its band and the stage."""
    who = companies.select("id", "primary_tag", "ecosystem_name", "date_founded")
    rows = deals_with_companies(deals, who)
    rows = company_age(rows, as_of=F.col("date"), out="company_age")
    return stage(age_band(rows, col="company_age"), V.STAGES_AGE)


def age_rounds(aged: DataFrame, rounds: Sequence[str] = V.ROUND_ORDER) -> DataFrame:
    """Age band x round counts, both in fixed order and zero-filled."""
    kept = aged.where(F.col("round_type").isin(*rounds))
    return K.crosstab(kept, "age_band", "round_type", K.literal_array(rounds))


def age_stages(aged: DataFrame, mapping: Mapping[str, str] = V.STAGES_AGE) -> DataFrame:
    return K.crosstab(aged, "age_band", "stage", K.literal_array(sorted(set(mapping.values()))))


def age_by_round(aged: DataFrame, rounds: Sequence[str] = V.ROUND_ORDER) -> DataFrame:
    """Median and mean age and deals per round, in round order; rounds without deals stay."""
    listed = aged.where(F.col("round_type").isin(*rounds))
    base = K.aggregate_by(listed, ["round_type"], mean_age=F.avg("company_age"), n=F.count("company_age"))
    medians = K.exact_percentiles(listed, ["round_type"], "company_age", {"median_age": 0.5})
    order = [F.struct(F.lit(i + 1).alias("place"), F.lit(r).alias("round_type")) for i, r in enumerate(rounds)]
    dim = aged.agg(F.count(F.lit(1))).select(F.explode(F.array(*order)).alias("_o")).select("_o.*")
    return dim.join(base, "round_type", "left").join(medians, "round_type", "left").fillna({"n": 0}).orderBy("place")


def age_distribution(aged: DataFrame) -> DataFrame:
    """Deals per age band, empty bands kept."""
    counts = K.aggregate_by(aged, ["age_band"], n=F.count(F.lit(1)))
    bands = aged.agg(F.count(F.lit(1))).select(F.explode(K.literal_array(V.AGE_LABELS)).alias("age_band"))
    return bands.join(counts, "age_band", "left").fillna({"n": 0})


def sector_ages(aged: DataFrame) -> DataFrame:
    """Deals with an amount, sum and mean by (sector, age band), empty bands kept."""
    cells = K.aggregate_by(aged, ["primary_tag", "age_band"], deals=F.count("amount"), amount=C.total("amount"), mean_amount=F.avg("amount"))
    return K.grid_fill(cells, cells.select("primary_tag"), "age_band", K.literal_array(V.AGE_LABELS), {"deals": 0, "amount": 0.0})


def sector_age_matrix(cells: DataFrame, top: int = 10) -> DataFrame:
    """Deals by age band of the sectors with most deals."""
    return K.keep_keys(cells, K.top_keys(cells, "primary_tag", F.sum("deals"), top)).select("primary_tag", "age_band", "deals")


def sector_age_totals(cells: DataFrame, top: int = 10) -> DataFrame:
    """Sectors with most deals: deals, sum, and the mean over bands of the band means."""
    sums = K.aggregate_by(cells, ["primary_tag"], deals=F.sum("deals"), amount=F.sum("amount"), mean_of_means=F.avg("mean_amount"))
    return K.top_k(sums, top, F.desc("deals"), F.asc("primary_tag"))


def stage_ages(aged: DataFrame) -> DataFrame:
    """Median and mean age and deals per stage."""
    base = K.aggregate_by(aged, ["stage"], mean_age=F.avg("company_age"), n=F.count("company_age"))
    return base.join(K.exact_percentiles(aged, ["stage"], "company_age", {"median_age": 0.5}), "stage", "left")


def round_ages(deals: DataFrame, companies: DataFrame, rounds: Sequence[str] = V.FIRST_ROUNDS) -> DataFrame:
    """Mean, median, least, greatest and spread of the company's present age by round."""
    rows = deals_with_companies(deals, companies.select("id", "ecosystem_name", "age")).where(F.col("round_type").isin(*rounds))
    base = K.aggregate_by(
        rows, ["round_type"], mean_age=F.avg("age"), min_age=F.min("age"), max_age=F.max("age"), std_age=F.stddev_samp("age")
    )
    return base.join(K.exact_percentiles(rows, ["round_type"], "age", {"median_age": 0.5}), "round_type", "left")


def ecosystem_round_ages(deals: DataFrame, companies: DataFrame, rounds: Sequence[str] = V.FIRST_ROUNDS) -> DataFrame:
    """Mean present age by (ecosystem, round)."""
    rows = deals_with_companies(deals, companies.select("id", "ecosystem_name", "age")).where(F.col("round_type").isin(*rounds))
    return K.aggregate_by(rows, ["ecosystem_name", "round_type"], mean_age=F.avg("age"))


def age_progression(stats: DataFrame) -> DataFrame:
    """Mean step between rounds ordered by mean age."""
    return mean_step(stats, "mean_age", "mean_age")
