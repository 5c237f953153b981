"""Funding by time, size, round, stage and sector.

Deals are summed per company before they meet the company table (``rollup``), so the join carries
at most one row per company and deal key, however many deals one company holds; everything after
works on the small result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealflux.functions import columns as C
from dealflux.functions import vocab as V
from dealflux.operators.projections import deal_size, deal_size_millions, stage
from dealflux.plans import kernels as K

SUMS = ("deals", "priced", "amount")


def sums() -> list[Column]:
    """Rows, rows with an amount, and the summed amount."""
    return [F.count(F.lit(1)).alias("deals"), F.count("amount").alias("priced"), C.total("amount").alias("amount")]


def resum(df: DataFrame, *keys: str) -> DataFrame:
    """Re-aggregate a rolled-up table to coarser keys, dropping null keys."""
    return K.present(df, *keys).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def rollup(deals: DataFrame, companies: DataFrame, company_keys: Sequence[str], deal_keys: Sequence[str] = ()) -> DataFrame:
    """Deal sums by company attributes and deal attributes (null keys kept)."""
    per_company = deals.groupBy("company_id", *deal_keys).agg(*sums())
    who = companies.select(F.col("id").alias("company_id"), *company_keys)
    joined = per_company.join(who, "company_id")
    return joined.groupBy(*company_keys, *deal_keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def top_of(rolled: DataFrame, key: str, measure: str, k: int, *, ascending: bool = False) -> DataFrame:
    return K.top_keys(rolled, key, F.sum(measure), k, ascending=ascending)


def mean_amount() -> Column:
    return C.ratio("amount", "priced")


def yearly_trends(deals: DataFrame) -> DataFrame:
    """Deals, sum, mean, median, std and yearly change of the sum."""
    base = K.aggregate_by(
        deals, ["year"], deals=F.count("id"), amount_sum=C.total("amount"), amount_mean=F.avg("amount"), amount_std=F.stddev_samp("amount")
    )
    medians = K.exact_percentiles(deals, ["year"], "amount", {"amount_median": 0.5}, bounded=True)
    return K.growth(base.join(medians, "year", "left"), [], "year", "amount_sum", "yoy_growth")


def quarterly_trends(deals: DataFrame) -> DataFrame:
    rows = deals.withColumn("quarter", F.quarter("date"))
    return K.aggregate_by(rows, ["year", "quarter"], deals=F.count("id"), amount_sum=C.total("amount"), amount_mean=F.avg("amount"))


def size_trends(deals: DataFrame) -> DataFrame:
    """Count, sum and mean by (year, size bin); empty bins are kept with zero sums and no mean."""
    cells = K.aggregate_by(deal_size(deals), ["year", "deal_size"], deals=F.count("id"), amount_sum=C.total("amount"), amount_mean=F.avg("amount"))
    return K.grid_fill(cells, cells.select("year"), "deal_size", K.literal_array(V.DEAL_SIZE_LABELS), {"deals": 0, "amount_sum": 0.0})


def size_distribution(deals: DataFrame) -> DataFrame:
    """Percent of each year's binned deals by size."""
    cells = K.crosstab(deal_size(deals), "year", "deal_size", K.literal_array(V.DEAL_SIZE_LABELS))
    return K.share_of(cells, "n", ["year"], "percent")


def round_analysis(deals: DataFrame) -> DataFrame:
    """Count, mean, median and sum by round."""
    base = K.aggregate_by(deals, ["round_type"], deals=F.count("id"), amount_mean=F.avg("amount"), amount_sum=C.total("amount"))
    return base.join(K.exact_percentiles(deals, ["round_type"], "amount", {"amount_median": 0.5}), "round_type", "left")


def round_evolution(deals: DataFrame) -> DataFrame:
    return K.aggregate_by(deals, ["year", "round_type"], deals=F.count("id"), amount_mean=F.avg("amount"), amount_sum=C.total("amount"))


def quarterly_activity(deals: DataFrame) -> DataFrame:
    """Deals and amount per quarter start, with the total of the quarter's year."""
    q = K.aggregate_by(deals.withColumn("quarter_start", F.to_date(F.date_trunc("quarter", "date"))), ["quarter_start"],
                       deals=F.count(F.lit(1)), amount=C.total("amount"))
    year = Window.partitionBy(F.year("quarter_start"))
    return q.withColumns({"year_deals": F.sum("deals").over(year), "year_amount": F.sum("amount").over(year)})


def stage_quarters(deals: DataFrame, mapping: Mapping[str, str] = V.STAGES_LONG) -> DataFrame:
    """Deals and amount by (stage, quarter)."""
    rows = stage(deals, mapping).withColumn("quarter", C.quarter_label("date"))
    return K.aggregate_by(rows, ["stage", "quarter"], deals=F.count(F.lit(1)), amount=C.total("amount"))


def quarter_rounds(deals: DataFrame, rounds: Sequence[str] = V.ROUND_ORDER) -> DataFrame:
    """Quarter rows, one column of summed millions per round, and their total."""
    return _quarter_pivot(deals, "round_type", rounds)


def quarter_sizes(deals: DataFrame) -> DataFrame:
    """Quarter rows, one column of summed millions per size class, and their total."""
    return _quarter_pivot(deal_size_millions(deals), "size_class", V.DEAL_MILLION_LABELS)


def _quarter_pivot(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    cells = K.present(rows.withColumn("quarter", C.quarter_label("date")), column).groupBy("quarter")
    wide = cells.agg(*[(C.total(F.when(F.col(column) == v, F.col("amount"))) / 1e6).alias(v) for v in values])
    return wide.withColumn("total", sum((F.col(f"`{v}`") for v in values), F.lit(0.0)))


def stage_medians(deals: DataFrame) -> DataFrame:
    """Median over rounds of the yearly round medians (millions), and deals, by (year, stage)."""
    counts = K.aggregate_by(deals, ["year", "round_type"], deals=F.count("amount"))
    medians = K.exact_percentiles(deals, ["year", "round_type"], "amount", {"median_amount": 0.5})
    rounds = stage(counts.join(medians, ["year", "round_type"], "left"), V.STAGES_PLURAL)
    return K.present(rounds, "year", "stage").groupBy("year", "stage").agg(
        (F.percentile("median_amount", 0.5) / 1e6).alias("median_amount"), F.sum("deals").alias("deals")
    )


def sector_year_stats(rolled: DataFrame, top: int = 5) -> DataFrame:
    """(sector, year) sums of the sectors with most deals. ``rolled`` by primary_tag and year."""
    kept = K.keep_keys(rolled, top_of(rolled, "primary_tag", "deals", top))
    return resum(kept, "primary_tag", "year").select("primary_tag", "year", "amount", F.col("priced").alias("deals"))


def sector_latest_growth(stats: DataFrame) -> DataFrame:
    """Deals of each sector and the change of its latest year against the year before (else 0)."""
    last = stats.groupBy("primary_tag").agg(F.max("year").alias("_y"), F.sum("deals").alias("total_deals"))
    at = stats.join(last, "primary_tag").groupBy("primary_tag", "total_deals").agg(
        F.max(F.when(F.col("year") == F.col("_y"), F.col("deals"))).alias("_now"),
        F.max(F.when(F.col("year") == F.col("_y") - 1, F.col("deals"))).alias("_before"),
    )
    return at.select("primary_tag", "total_deals", F.coalesce(C.change("_now", "_before"), F.lit(0.0)).alias("growth"))


def sector_stage_share(rolled: DataFrame, measure: str = "amount", top: int = 5, top_by: str | None = None,
                       years: tuple[int, int] | None = None, mapping: Mapping[str, str] = V.STAGES) -> DataFrame:
    """Per year: percent of the top sectors' total by sector and stage, zero-filled.

    ``rolled`` by primary_tag, year and round_type; the top sectors come from all its years.
    """
    kept = K.keep_keys(rolled, top_of(rolled, "primary_tag", top_by or measure, top))
    if years:
        kept = kept.where(F.col("year").between(*years))
    totals = kept.groupBy("year").agg(F.sum(measure).alias("_t"))
    cells = K.aggregate_by(stage(kept, mapping), ["year", "primary_tag", "stage"], value=F.sum(measure))
    stages = K.literal_array(sorted(set(mapping.values())))
    full = K.grid_fill(cells, cells.select("year", "primary_tag"), "stage", stages, {"value": 0})
    return full.join(totals, "year").select("year", "primary_tag", "stage", C.percent("value", "_t").alias("share"))


def sector_stage_table(rolled: DataFrame, top: int = 10, mapping: Mapping[str, str] = V.STAGES_LONG) -> DataFrame:
    """Sector x stage deal counts with row percent and the totals of rows, columns and all.

    Totals carry "all" in place of the summed-over dimension.
    """
    kept = stage(K.keep_keys(rolled, top_of(rolled, "primary_tag", "deals", top)), mapping)
    cells = K.aggregate_by(kept, ["primary_tag", "stage"], n=F.sum("deals"))
    sets = cells.groupingSets([["primary_tag", "stage"], ["primary_tag"], ["stage"], []], "primary_tag", "stage").agg(F.sum("n").alias("n"))
    row = Window.partitionBy("primary_tag")
    named = sets.select(
        F.coalesce("primary_tag", F.lit("all")).alias("primary_tag"), F.coalesce("stage", F.lit("all")).alias("stage"), "n"
    )
    whole = F.max(F.when(F.col("stage") == "all", F.col("n"))).over(row)
    return named.withColumn("row_percent", C.percent("n", whole))


def ecosystem_sector_trend(rolled: DataFrame, top: int = 6, sectors: int = 5) -> DataFrame:
    """Top ecosystems: per year the sectors with the largest share of the amount."""
    kept = K.keep_keys(rolled, top_of(rolled, "ecosystem_name", "amount", top))
    cells = resum(kept, "ecosystem_name", "year", "primary_tag")
    shares = K.share_of(cells, "amount", ["ecosystem_name", "year"], "share")
    ranked = K.top_per_group(shares, ["ecosystem_name", "year"], sectors, F.desc("share"), F.asc("primary_tag"))
    return ranked.select("ecosystem_name", "year", "primary_tag", "share", "rank")


def year_sector_table(rolled: DataFrame, top: int = 10, by: str = "deals") -> DataFrame:
    """Year x top sectors: deals and amount in millions, zero-filled."""
    kept = K.keep_keys(rolled, top_of(rolled, "primary_tag", by, top))
    cells = resum(kept, "year", "primary_tag")
    full = K.grid_fill(cells, cells.select("year"), "primary_tag", K.values_array(cells, "primary_tag"), {"deals": 0, "amount": 0.0})
    return full.select("year", "primary_tag", "deals", (F.col("amount") / 1e6).alias("amount"))


def bottom_sectors(rolled: DataFrame, k: int = 5) -> DataFrame:
    """Least active sectors: deals, sum and mean in millions, and share of all deals."""
    shares = K.share_of(resum(rolled, "primary_tag"), "deals", (), "deal_share")
    least = K.top_k(shares, k, F.asc("deals"), F.asc("primary_tag"))
    return least.select("primary_tag", "deals", (F.col("amount") / 1e6).alias("amount"), (mean_amount() / 1e6).alias("mean_amount"), "deal_share")


def bottom_sector_years(rolled: DataFrame, k: int = 5) -> DataFrame:
    """Yearly deals of the least active sectors, zero-filled."""
    kept = K.keep_keys(rolled, top_of(rolled, "primary_tag", "deals", k, ascending=True))
    cells = resum(kept, "year", "primary_tag").select("year", "primary_tag", "deals")
    return K.grid_fill(cells, cells.select("year"), "primary_tag", K.values_array(cells, "primary_tag"), {"deals": 0})


def sector_growth_table(rolled: DataFrame, first: int, last: int) -> DataFrame:
    """Per sector: each yearly change, total and deal growth, volatility, best and worst year.

    Sectors without funding in the first year are left out; a change from nothing counts as 0.
    """
    span = list(range(first, last + 1))
    in_span = rolled.where(F.col("year").between(first, last))
    per = K.aggregate_by(
        in_span, ["primary_tag"], total_amount=F.sum("amount") / 1e6,
        **{f"a{y}": C.total(F.when(F.col("year") == y, F.col("amount"))) / 1e6 for y in span},
        first_deals=F.coalesce(F.sum(F.when(F.col("year") == first, F.col("deals"))), F.lit(0)),
        last_deals=F.coalesce(F.sum(F.when(F.col("year") == last, F.col("deals"))), F.lit(0)),
    ).where(F.col(f"a{first}") > 0)
    changes = {f"growth_{b}": F.coalesce(C.change(f"a{b}", f"a{a}"), F.lit(0.0)) for a, b in zip(span, span[1:])}
    per = per.withColumns(changes)
    steps = F.array(*[F.struct(F.col(g).alias("g"), F.lit(int(g[-4:])).alias("y")) for g in changes])
    values = F.array(*changes)
    n = len(changes)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1)
    return per.withColumns({
        "total_growth": C.change(f"a{last}", f"a{first}"),
        "deal_growth": F.coalesce(C.change("last_deals", "first_deals"), F.lit(0.0)),
        "volatility": F.sqrt(var),
        "best_year": F.array_max(steps).getField("y"),
        "worst_year": F.array_min(steps).getField("y"),
        "first_amount": F.col(f"a{first}"),
        "last_amount": F.col(f"a{last}"),
    }).drop(*[f"a{y}" for y in span])


def kpi_changes(yearly: DataFrame) -> DataFrame:
    """Latest year against the one before: total, mean, count and spread."""
    w = Window.partitionBy(F.lit(1)).orderBy("year")
    measures = ["amount_sum", "amount_mean", "deals", "amount_std"]
    wide = yearly.withColumns({f"{m}_change": C.change(m, F.lag(m).over(w)) for m in measures})
    return K.top_k(wide, 1, F.desc("year")).select("year", *measures, *[f"{m}_change" for m in measures])


def latest_findings(deals: DataFrame, companies: DataFrame, top: int = 10) -> DataFrame:
    """Peak quarter, last quarterly change, share of deals above 10M now and before, lead ecosystem."""
    quarters = K.aggregate_by(deals.withColumn("quarter", C.quarter_label("date")), ["quarter"], amount=C.total("amount"))
    changes = K.growth(quarters, [], "quarter", "amount", "change")
    large = K.aggregate_by(
        deals, ["year"], share=C.percent(F.count_if(F.col("amount") > 1e7), F.count_if(F.col("amount") > 0))
    )
    newest = F.max(F.struct("year", "share")).getField("share")
    before = F.max(F.struct("year", "share"))
    hubs = K.top_k(K.aggregate_by(companies, ["ecosystem_name"], n=F.count(F.lit(1))), top, F.desc("n"), F.desc("ecosystem_name"))
    first = F.max(F.struct("n", "ecosystem_name"))
    last_year = K.scalar(large, F.max("year"))
    return quarters.agg(F.min(F.struct(-F.col("amount"), "quarter")).getField("quarter").alias("peak_quarter")).select(
        "peak_quarter",
        K.scalar(changes, F.max_by("change", "quarter")).alias("last_quarter_change"),
        K.scalar(large, newest).alias("large_share"),
        K.scalar(large.where(F.col("year") < last_year), before.getField("share")).alias("large_share_before"),
        K.scalar(hubs, first.getField("ecosystem_name")).alias("lead_ecosystem"),
        K.scalar(hubs, C.percent(F.max("n"), F.sum("n"))).alias("lead_share"),
    )
