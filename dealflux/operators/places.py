"""Ecosystems, sectors and geography of companies and their funding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealflux.functions import columns as C
from dealflux.functions import vocab as V
from dealflux.operators.deals import mean_amount, resum, top_of
from dealflux.operators.joins import companies_with_geography, deals_with_companies
from dealflux.plans import kernels as K

N = "n"


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return K.aggregate_by(df, list(keys), n=F.count(F.lit(1)))


def ecosystem_stats(companies: DataFrame) -> DataFrame:
    """Companies, mean age, most common sector and latest round of each ecosystem."""
    key = ["ecosystem_name"]
    base = K.aggregate_by(companies, key, company_count=F.count("id"), avg_company_age=F.avg("age"))
    sector = K.mode_by(companies, key, "primary_tag", "dominant_sector")
    latest = K.mode_by(companies, key, "latest_round_type", "common_round_type")
    return base.join(sector, key, "left").join(latest, key, "left")


def sector_founding_matrix(companies: DataFrame) -> DataFrame:
    """Companies by (founding year, sector), zero-filled, with the yearly change."""
    rows = companies.withColumn("founded", F.year("date_founded"))
    cells = count_by(rows, "founded", "primary_tag")
    full = K.grid_fill(cells, cells.select("founded"), "primary_tag", K.values_array(cells, "primary_tag"), {"n": 0})
    return K.growth(full, ["primary_tag"], "founded", "n", "yoy_growth")


def sector_region_amounts(rolled: DataFrame) -> DataFrame:
    """Sum, mean and count by sector, by ecosystem, and by both, in one table.

    ``rolled`` by primary_tag and ecosystem_name; the dimension summed over reads "all".
    """
    cells = resum(rolled, "primary_tag", "ecosystem_name")
    sets = cells.groupingSets(
        [["primary_tag", "ecosystem_name"], ["primary_tag"], ["ecosystem_name"]], "primary_tag", "ecosystem_name"
    ).agg(F.sum("amount").alias("amount"), F.sum("priced").alias("priced"))
    return sets.select(
        F.coalesce("primary_tag", F.lit("all")).alias("primary_tag"),
        F.coalesce("ecosystem_name", F.lit("all")).alias("ecosystem_name"),
        "amount", mean_amount().alias("mean_amount"), "priced",
    )


def geo_distribution(companies: DataFrame, ecosystems: DataFrame, top: int = 3) -> DataFrame:
    """Companies and their most frequent sectors (array) by province and city."""
    keys = ["province", "city"]
    counts = count_by(companies_with_geography(companies, ecosystems), *keys, "primary_tag")
    # Only the first few sectors of a place come together.
    leading = K.top_per_group(counts, keys, top, F.desc("n"), F.asc("primary_tag"))
    leading = leading.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "primary_tag"))), lambda s: s["primary_tag"]).alias("top_sectors"))
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("companies"))
    same = [sums[k].eqNullSafe(leading[k]) for k in keys]
    return sums.join(leading, same[0] & same[1]).select(*[sums[k] for k in keys], "companies", "top_sectors")


def province_counts(companies: DataFrame, ecosystems: DataFrame) -> DataFrame:
    return K.aggregate_by(companies_with_geography(companies, ecosystems), ["province"], companies=F.count(F.lit(1)))


def ecosystem_sectors(companies: DataFrame, top: int = 10) -> DataFrame:
    """Largest ecosystems with their number of companies and distinct sectors (sorted array)."""
    sizes = K.aggregate_by(companies, ["ecosystem_name"], companies=F.count(F.lit(1)))
    largest = K.top_k(sizes, top, F.desc("companies"), F.asc("ecosystem_name"))
    # Sectors are listed for the chosen few only.
    pairs = count_by(companies, "ecosystem_name", "primary_tag").join(largest, "ecosystem_name")
    return pairs.groupBy("ecosystem_name", "companies").agg(F.sort_array(F.collect_list("primary_tag")).alias("sectors"))


def ecosystem_shares(rolled: DataFrame) -> DataFrame:
    """Deals, total and mean of each ecosystem with shares of deals and investment."""
    base = resum(rolled, "ecosystem_name")
    shares = K.share_of(K.share_of(base, "deals", (), "deal_share"), "amount", (), "investment_share")
    return shares.select("ecosystem_name", "deals", "amount", mean_amount().alias("mean_amount"), "deal_share", "investment_share")


def concentration(shares: DataFrame, share: str, ks: Sequence[int] = (3, 5)) -> DataFrame:
    """Summed share of the k largest rows."""
    largest = K.top_k(shares, max(ks), F.desc(share), F.asc("ecosystem_name")).select(share)
    ordered = largest.agg(F.sort_array(F.collect_list(share), asc=False).alias("_s"))
    total = lambda k: F.aggregate(F.slice("_s", 1, k), F.lit(0.0), lambda a, x: a + x)
    return ordered.select(*[total(k).alias(f"top_{k}") for k in ks])


def ecosystem_funding_share(rolled: DataFrame) -> DataFrame:
    """Funding in millions, share, rank and running share of each ecosystem."""
    base = resum(rolled, "ecosystem_name").select("ecosystem_name", (F.col("amount") / 1e6).alias("amount"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("amount"), F.asc("ecosystem_name"))
    shares = K.share_of(base, "amount", (), "share")
    return shares.withColumns({"rank": F.row_number().over(w), "running_share": F.sum("share").over(w)})


def sector_ecosystem(companies: DataFrame, axis: str = "ecosystem_name", top: int = 10) -> DataFrame:
    """Top sectors x top ecosystems: companies, and percent within ``axis``, zero-filled."""
    kept = K.keep_keys(companies, K.top_keys(companies, "primary_tag", F.count(F.lit(1)), top))
    kept = K.keep_keys(kept, K.top_keys(companies, "ecosystem_name", F.count(F.lit(1)), top))
    cells = K.crosstab(kept, "ecosystem_name", "primary_tag", K.values_array(kept, "primary_tag"))
    return K.share_of(cells, "n", [axis], "share")


def leaders(cells: DataFrame, group: str, member: str, out: str) -> DataFrame:
    """The member with the largest share in each group."""
    best = F.min(F.struct((-F.col("share")).alias("s"), F.col(member).alias("m")))
    return cells.groupBy(group).agg(best.alias("_b")).select(group, F.col("_b.m").alias(out), (-F.col("_b.s")).alias("share"))


def diversity(cells: DataFrame) -> DataFrame:
    """100 minus the spread of sector shares of each ecosystem."""
    return cells.groupBy("ecosystem_name").agg((F.lit(100.0) - F.stddev_samp("share")).alias("diversity"))


def sector_concentration(cells: DataFrame, k: int = 3) -> DataFrame:
    """Share of each sector held by its k leading ecosystems, most concentrated first."""
    ranked = K.top_per_group(cells, ["primary_tag"], k, F.desc("share"), F.asc("ecosystem_name"))
    return ranked.groupBy("primary_tag").agg(F.sum("share").alias("top_share")).orderBy(F.desc("top_share"), "primary_tag")


def ecosystem_metrics(deals: DataFrame, companies: DataFrame) -> DataFrame:
    """Deal sizes, age, funding per year of age, early and late round ratios of each ecosystem."""
    key = ["ecosystem_name"]
    rows = K.present(deals_with_companies(deals, companies.select("id", "ecosystem_name", "age")), *key)
    share = lambda rounds: C.percent(F.count_if(F.col("round_type").isin(*rounds)), F.count("round_type"))
    base = rows.groupBy(*key).agg(
        F.avg("amount").alias("avg_deal_size"), F.stddev_samp("amount").alias("deal_size_std"), F.count("amount").alias("deal_count"),
        F.avg("age").alias("avg_company_age"), (C.total("amount") / 1e6).alias("total_funding"),
        share(V.EARLY_ROUNDS).alias("early_stage_ratio"), share(V.LATE_ROUNDS).alias("late_stage_ratio"),
    )
    medians = K.exact_percentiles(rows, key, "amount", {"median_deal_size": 0.5})
    return base.join(medians, key, "left").withColumn("funding_per_year", C.ratio("total_funding", "avg_company_age"))


METRICS = [
    "avg_deal_size", "median_deal_size", "deal_size_std", "deal_count", "avg_company_age", "total_funding", "funding_per_year",
]


def ecosystem_metric_summary(metrics: DataFrame) -> DataFrame:
    """Mean, median and spread of every metric across ecosystems."""
    cols = [*METRICS, "early_stage_ratio", "late_stage_ratio"]
    long = K.unpivot(metrics.select(*[F.col(c).cast("double").alias(c) for c in cols]), [], cols, "metric", "value")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.stddev_samp("value").alias("std")
    )


def ecosystem_round_share(rolled: DataFrame) -> DataFrame:
    """Row percent of rounds in each ecosystem, zero-filled. ``rolled`` by ecosystem and round."""
    cells = resum(rolled, "ecosystem_name", "round_type").select("ecosystem_name", "round_type", "deals")
    full = K.grid_fill(cells, cells.select("ecosystem_name"), "round_type", K.values_array(cells, "round_type"), {"deals": 0})
    return K.share_of(full, "deals", ["ecosystem_name"], "share")
