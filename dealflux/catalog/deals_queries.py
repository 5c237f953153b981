"""Deal analytics: trends, sizes, stages, sectors, ecosystems, ages and investors."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealflux.catalog.profiles_queries import AGE_BIN, BINS, SIZE_CLASS, STAGE_SQL
from dealflux.catalog.registry import query
from dealflux.catalog.relational_queries import SECTORS
from dealflux.functions import vocab as V
from dealflux.operators import ages as G
from dealflux.operators import deals as D
from dealflux.operators import filters as flt
from dealflux.operators import investing as I
from dealflux.operators import joins as J
from dealflux.operators import outlook as O
from dealflux.operators import places as P
from dealflux.plans import kernels as K
from dealflux.sources.adapters import FIRST_YEAR, LAST_YEAR

SPAN = (FIRST_YEAR, LAST_YEAR)
STAGE3 = STAGE_SQL.format("Seed", "Early", "Late")
STAGE_LONG = STAGE_SQL.format("Seed", "Early Stage", "Later Stage")
STAGE_AGE = STAGE_SQL.format("Seed", "Early Stage", "Late Stage")
STAGE_PLURAL = STAGE_SQL.format("Seeds", "Early", "Late")
DC = "dc AS (SELECT * FROM deal_company WHERE year < 2001)"
QUARTER = "CAST(year(date) AS VARCHAR) || 'Q' || quarter(date)"


def closed(t):
    """Deals of the complete years."""
    return flt.before_year(t.deals, LAST_YEAR + 1)


def rolled(t, company_keys, deal_keys=()):
    """Deal sums, kept: the queries below read the small table several times."""
    return D.rollup(closed(t), t.companies, company_keys, deal_keys).persist()


# Companies.


@query("agg_ecosystem_stats", """
  WITH s AS (SELECT ecosystem_name, primary_tag, row_number() OVER (PARTITION BY ecosystem_name ORDER BY count(*) DESC, primary_tag) AS rn
    FROM companies GROUP BY 1, 2),
  r AS (SELECT ecosystem_name, latest_round_type, row_number() OVER (PARTITION BY ecosystem_name ORDER BY count(*) DESC, latest_round_type) AS rn
    FROM companies_rounds WHERE latest_round_type IS NOT NULL GROUP BY 1, 2),
  b AS (SELECT ecosystem_name, count(id) AS company_count, avg(age) AS avg_company_age FROM companies GROUP BY 1)
  SELECT b.*, s.primary_tag AS dominant_sector, r.latest_round_type AS common_round_type FROM b
  LEFT JOIN s ON s.ecosystem_name = b.ecosystem_name AND s.rn = 1 LEFT JOIN r ON r.ecosystem_name = b.ecosystem_name AND r.rn = 1""",
       r6="avg_company_age")
def _(t):
    return P.ecosystem_stats(t.companies_rounds)


@query("agg_sector_counts", SECTORS)
def _(t):
    return J.sector_counts(t.companies)


@query("agg_sector_growth_matrix", """
  WITH c AS (SELECT CAST(year(date_founded) AS INTEGER) AS founded, primary_tag, count(*) AS n FROM companies
      WHERE date_founded IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT founded, primary_tag, coalesce(n, 0) AS n FROM (SELECT DISTINCT founded FROM c) CROSS JOIN (SELECT DISTINCT primary_tag FROM c)
    LEFT JOIN c USING (founded, primary_tag))
  SELECT *, 100.0::DOUBLE * (n - lag(n) OVER w) / nullif(lag(n) OVER w, 0) AS yoy_growth FROM g
  WINDOW w AS (PARTITION BY primary_tag ORDER BY founded)""", r6="yoy_growth")
def _(t):
    return P.sector_founding_matrix(t.companies)


@query("agg_round_distribution", """SELECT latest_round_type, count(*) AS n FROM companies_rounds WHERE latest_round_type IS NOT NULL GROUP BY 1""")
def _(t):
    return P.count_by(t.companies_rounds, "latest_round_type")


@query("agg_funding_timeline", """SELECT CAST(latest_round_date AS VARCHAR) AS latest_round_date, count(*) AS n FROM companies_rounds
  WHERE latest_round_date IS NOT NULL GROUP BY 1""")
def _(t):
    return P.count_by(t.companies_rounds, "latest_round_date")


@query("agg_geo_distribution", """
  WITH c AS (SELECT province, city, primary_tag, count(*) AS n FROM companies c JOIN ecosystems e ON c.ecosystem_name = e.ecosystem_name GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY province, city ORDER BY n DESC, primary_tag) AS rn FROM c)
  SELECT province, city, CAST(sum(n) AS BIGINT) AS companies, string_agg(primary_tag, ',' ORDER BY rn) FILTER (rn <= 3) AS top_sectors FROM r GROUP BY 1, 2""")
def _(t):
    return P.geo_distribution(t.companies, t.ecosystems).withColumn("top_sectors", F.array_join("top_sectors", ","))


@query("agg_province_counts", """SELECT province, count(*) AS companies FROM companies c JOIN ecosystems e ON c.ecosystem_name = e.ecosystem_name GROUP BY 1""")
def _(t):
    return P.province_counts(t.companies, t.ecosystems)


@query("agg_ecosystem_sector_list", """
  SELECT ecosystem_name, count(*) AS companies, string_agg(DISTINCT primary_tag, ',' ORDER BY primary_tag) AS sectors
  FROM companies GROUP BY 1 ORDER BY companies DESC, ecosystem_name LIMIT 10""")
def _(t):
    return P.ecosystem_sectors(t.companies).withColumn("sectors", F.array_join("sectors", ","))


CELLS = """top_s AS (SELECT primary_tag FROM companies GROUP BY 1 ORDER BY count(*) DESC, primary_tag LIMIT 10),
  f AS (SELECT * FROM companies WHERE primary_tag IN (SELECT primary_tag FROM top_s) AND ecosystem_name IN (
    SELECT ecosystem_name FROM companies WHERE primary_tag IN (SELECT primary_tag FROM top_s) GROUP BY 1 ORDER BY count(*) DESC, ecosystem_name LIMIT 10)),
  g AS (SELECT ecosystem_name, primary_tag FROM (SELECT DISTINCT ecosystem_name FROM f) CROSS JOIN (SELECT DISTINCT primary_tag FROM f)),
  n AS (SELECT g.ecosystem_name, g.primary_tag, count(f.id) AS n FROM g LEFT JOIN f ON f.ecosystem_name = g.ecosystem_name
    AND f.primary_tag = g.primary_tag GROUP BY 1, 2),
  cells AS (SELECT *, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY {0}) AS share FROM n)"""
CELLS = CELLS.replace("companies WHERE primary_tag IN (SELECT primary_tag FROM top_s) GROUP BY 1", "companies GROUP BY 1")


def sectors(t):
    """Sector and ecosystem of each company."""
    return t.companies.select("id", "primary_tag", "ecosystem_name")


BY_ECO = CELLS.replace("{0}", "ecosystem_name")
BY_SEC = CELLS.replace("{0}", "primary_tag")


@query("agg_sector_ecosystem_row_share", f"WITH {BY_ECO} SELECT * FROM cells", r6="share")
def _(t):
    return P.sector_ecosystem(sectors(t))


@query("agg_sector_ecosystem_row_leaders", f"""WITH {BY_ECO} SELECT ecosystem_name, primary_tag AS top_sector, share FROM cells
  QUALIFY row_number() OVER (PARTITION BY ecosystem_name ORDER BY share DESC, primary_tag) = 1""", r6="share")
def _(t):
    return P.leaders(P.sector_ecosystem(sectors(t)), "ecosystem_name", "primary_tag", "top_sector")


@query("agg_ecosystem_diversity", f"WITH {BY_ECO} SELECT ecosystem_name, 100 - stddev_samp(share) AS diversity FROM cells GROUP BY 1", r6="diversity")
def _(t):
    return P.diversity(P.sector_ecosystem(sectors(t)))


@query("agg_sector_ecosystem_col_share", f"WITH {BY_SEC} SELECT * FROM cells", r6="share")
def _(t):
    return P.sector_ecosystem(sectors(t), "primary_tag")


@query("agg_sector_ecosystem_col_leaders", f"""WITH {BY_SEC} SELECT primary_tag, ecosystem_name AS top_ecosystem, share FROM cells
  QUALIFY row_number() OVER (PARTITION BY primary_tag ORDER BY share DESC, ecosystem_name) = 1""", r6="share")
def _(t):
    return P.leaders(P.sector_ecosystem(sectors(t), "primary_tag"), "primary_tag", "ecosystem_name", "top_ecosystem")


@query("agg_sector_concentration", f"""WITH {BY_SEC}, r AS (SELECT *, row_number() OVER (PARTITION BY primary_tag ORDER BY share DESC, ecosystem_name) AS rn FROM cells)
  SELECT primary_tag, sum(share) AS top_share FROM r WHERE rn <= 3 GROUP BY 1""", r6="top_share")
def _(t):
    return P.sector_concentration(P.sector_ecosystem(sectors(t), "primary_tag"))


# Trends.

YEARLY = """y AS (SELECT year, count(id) AS deals, sum(coalesce(amount, 0)) AS amount_sum, avg(amount) AS amount_mean, stddev_samp(amount) AS amount_std,
  quantile_cont(amount, 0.5) AS amount_median FROM deals WHERE year < 2001 GROUP BY 1)"""


@query("agg_yearly_trends", f"""WITH {YEARLY} SELECT *, 100 * (amount_sum - lag(amount_sum) OVER (ORDER BY year)) / lag(amount_sum) OVER (ORDER BY year) AS yoy_growth FROM y""",
       r0="amount_sum amount_mean amount_std amount_median", r6="yoy_growth")
def _(t):
    return D.yearly_trends(closed(t))


@query("agg_kpi_yoy", f"""WITH {YEARLY}, l AS (SELECT *, lag(amount_sum) OVER w AS s, lag(amount_mean) OVER w AS m, lag(deals) OVER w AS d, lag(amount_std) OVER w AS v
    FROM y WINDOW w AS (ORDER BY year))
  SELECT year, amount_sum, amount_mean, deals, amount_std, 100 * (amount_sum - s) / s AS amount_sum_change, 100 * (amount_mean - m) / m AS amount_mean_change,
    100.0::DOUBLE * (deals - d) / d AS deals_change, 100 * (amount_std - v) / v AS amount_std_change FROM l ORDER BY year DESC LIMIT 1""",
       r0="amount_sum amount_mean amount_std", r6="amount_sum_change amount_mean_change deals_change amount_std_change")
def _(t):
    return D.kpi_changes(D.yearly_trends(closed(t)))


@query("agg_quarterly_trends", """SELECT year, CAST(quarter(date) AS INTEGER) AS quarter, count(id) AS deals, sum(coalesce(amount, 0)) AS amount_sum,
  avg(amount) AS amount_mean FROM deals WHERE year < 2001 GROUP BY 1, 2""", r0="amount_sum amount_mean")
def _(t):
    return D.quarterly_trends(closed(t))


LABELS = ", ".join(f"('{b}')" for b in V.DEAL_SIZE_LABELS)
SIZES = f"""d AS (SELECT *, {BINS} AS deal_size FROM deals WHERE year < 2001),
  g AS (SELECT year, b AS deal_size FROM (SELECT DISTINCT year FROM d) CROSS JOIN (VALUES {LABELS}) v(b))"""


@query("agg_deal_size_trends", f"""WITH {SIZES} SELECT g.year, g.deal_size, count(d.id) AS deals, coalesce(sum(d.amount), 0) AS amount_sum, avg(d.amount) AS amount_mean
  FROM g LEFT JOIN d ON d.year = g.year AND d.deal_size = g.deal_size GROUP BY 1, 2""", r3="amount_sum", r0="amount_mean")
def _(t):
    return D.size_trends(closed(t))


@query("agg_deal_size_distribution", f"""WITH {SIZES}, c AS (SELECT g.year, g.deal_size, count(d.id) AS n FROM g LEFT JOIN d ON d.year = g.year
    AND d.deal_size = g.deal_size GROUP BY 1, 2) SELECT *, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY year) AS percent FROM c""", r6="percent")
def _(t):
    return D.size_distribution(closed(t))


@query("agg_stage_analysis", """SELECT round_type, count(id) AS deals, avg(amount) AS amount_mean, quantile_cont(amount, 0.5) AS amount_median,
  sum(coalesce(amount, 0)) AS amount_sum FROM deals WHERE round_type IS NOT NULL GROUP BY 1""", r0="amount_mean amount_median amount_sum")
def _(t):
    return D.round_analysis(t.deals)


@query("agg_stage_evolution", """SELECT year, round_type, count(id) AS deals, avg(amount) AS amount_mean, sum(coalesce(amount, 0)) AS amount_sum
  FROM deals WHERE round_type IS NOT NULL GROUP BY 1, 2""", r3="amount_sum", r0="amount_mean")
def _(t):
    return D.round_evolution(t.deals)


@query("agg_quarterly_activity", """
  WITH q AS (SELECT CAST(date_trunc('quarter', date) AS DATE) AS q, count(*) AS deals, sum(coalesce(amount, 0)) AS amount FROM deals WHERE year < 2001 GROUP BY 1)
  SELECT CAST(q AS VARCHAR) AS quarter_start, deals, amount, CAST(sum(deals) OVER (PARTITION BY year(q)) AS BIGINT) AS year_deals,
    sum(amount) OVER (PARTITION BY year(q)) AS year_amount FROM q""", r3="amount", r0="year_amount")
def _(t):
    return D.quarterly_activity(closed(t))


@query("agg_stage_quarter_series", f"""SELECT {STAGE_LONG} AS stage, {QUARTER} AS quarter, count(*) AS deals, sum(coalesce(amount, 0)) AS amount
  FROM deals WHERE {STAGE_LONG} IS NOT NULL GROUP BY 1, 2""", r3="amount")
def _(t):
    return D.stage_quarters(t.deals)


def pivot_sql(column, values, source):
    cells = ", ".join(f"coalesce(sum(amount) FILTER ({column} = '{v}'), 0) / 1e6 AS \"{v}\"" for v in values)
    total = f"coalesce(sum(amount) FILTER ({column} IS NOT NULL), 0) / 1e6 AS total"
    rounded = ", ".join(f"round(\"{v}\"::DOUBLE, 9) AS \"{v}\"" for v in [*values, "total"])
    return f"SELECT * REPLACE ({rounded}) FROM (SELECT {QUARTER} AS quarter, {cells}, {total} FROM {source} GROUP BY 1)"


def rounded(df, names):
    return df.select("quarter", *[F.round(f"`{n}`", 9).alias(n) for n in names])


@query("agg_quarter_round_pivot", pivot_sql("round_type", V.ROUND_ORDER, f"(SELECT * FROM deals WHERE round_type IN {tuple(V.ROUND_ORDER)})"))
def _(t):
    d = t.deals.where(F.col("round_type").isin(*V.ROUND_ORDER))
    return rounded(D.quarter_rounds(d), [*V.ROUND_ORDER, "total"])


@query("agg_quarter_size_pivot", pivot_sql("size_class", V.DEAL_MILLION_LABELS, f"(SELECT *, {SIZE_CLASS} AS size_class FROM deals WHERE year < 2001 AND amount IS NOT NULL)"))
def _(t):
    return rounded(D.quarter_sizes(closed(t)), [*V.DEAL_MILLION_LABELS, "total"])


@query("agg_stage_medians", f"""
  WITH r AS (SELECT year, round_type, quantile_cont(amount, 0.5) AS m, count(amount) AS n FROM deals WHERE year < 2001 AND round_type IS NOT NULL GROUP BY 1, 2)
  SELECT year, {STAGE_PLURAL} AS stage, quantile_cont(m, 0.5) / 1e6 AS median_amount, CAST(sum(n) AS BIGINT) AS deals FROM r
  WHERE {STAGE_PLURAL} IS NOT NULL GROUP BY 1, 2""", r6="median_amount")
def _(t):
    return D.stage_medians(closed(t))


SY = f"""WITH {DC}, top AS (SELECT primary_tag FROM dc GROUP BY 1 ORDER BY count(*) DESC, primary_tag LIMIT 5),
  sy AS (SELECT primary_tag, year, sum(coalesce(amount, 0)) AS amount, count(amount) AS deals FROM dc WHERE primary_tag IN (SELECT primary_tag FROM top) GROUP BY 1, 2)"""


@query("agg_sector_year_stats", SY + " SELECT * FROM sy", r3="amount")
def _(t):
    return D.sector_year_stats(rolled(t, ["primary_tag"], ["year"]))


@query("agg_sector_latest_growth", SY + """, l AS (SELECT *, max(year) OVER (PARTITION BY primary_tag) AS last FROM sy)
  SELECT primary_tag, CAST(sum(deals) AS BIGINT) AS total_deals, coalesce(100.0::DOUBLE * (max(deals) FILTER (year = last) - max(deals) FILTER (year = last - 1))
    / nullif(max(deals) FILTER (year = last - 1), 0), 0) AS growth FROM l GROUP BY 1""", r6="growth")
def _(t):
    return D.sector_latest_growth(D.sector_year_stats(rolled(t, ["primary_tag"], ["year"])))


@query("agg_ecosystem_shares", """
  WITH e AS (SELECT ecosystem_name, count(*) AS deals, sum(coalesce(amount, 0)) AS amount, avg(amount) AS mean_amount FROM deal_company GROUP BY 1)
  SELECT *, 100.0::DOUBLE * deals / sum(deals) OVER () AS deal_share, 100 * amount / sum(amount) OVER () AS investment_share FROM e""",
       r0="amount mean_amount", r6="deal_share investment_share")
def _(t):
    return P.ecosystem_shares(D.rollup(t.deals, t.companies, ["ecosystem_name"]).persist())


@query("agg_ecosystem_concentration", """
  WITH e AS (SELECT ecosystem_name, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS s FROM deal_company GROUP BY 1),
  r AS (SELECT s, row_number() OVER (ORDER BY s DESC, ecosystem_name) AS rn FROM e)
  SELECT sum(s) FILTER (rn <= 3) AS top_3, sum(s) FILTER (rn <= 5) AS top_5 FROM r""", r6="top_3 top_5")
def _(t):
    return P.concentration(P.ecosystem_shares(D.rollup(t.deals, t.companies, ["ecosystem_name"]).persist()), "deal_share")


@query("agg_ecosystem_funding_share", """
  WITH e AS (SELECT ecosystem_name, sum(coalesce(amount, 0)) / 1e6 AS amount FROM deal_company GROUP BY 1),
  s AS (SELECT *, 100 * amount / sum(amount) OVER () AS share FROM e)
  SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank, sum(share) OVER w AS running_share FROM s
  WINDOW w AS (ORDER BY amount DESC, ecosystem_name ROWS UNBOUNDED PRECEDING)""", r4="amount", r6="share running_share")
def _(t):
    return P.ecosystem_funding_share(D.rollup(t.deals, t.companies, ["ecosystem_name"]).persist())


SHARE = """WITH {dc}, top AS (SELECT primary_tag FROM dc GROUP BY 1 ORDER BY {rank} DESC, primary_tag LIMIT 5),
  k AS (SELECT *, {stage} AS stage FROM dc WHERE primary_tag IN (SELECT primary_tag FROM top)),
  tot AS (SELECT year, {measure} AS t FROM k GROUP BY 1),
  g AS (SELECT * FROM (SELECT DISTINCT year, primary_tag FROM k WHERE stage IS NOT NULL) CROSS JOIN (VALUES {stages}) v(stage))
  SELECT g.year, g.primary_tag, g.stage, 100.0::DOUBLE * coalesce({measure}, 0) / max(t) AS share FROM g JOIN tot ON tot.year = g.year
  LEFT JOIN k ON k.year = g.year AND k.primary_tag = g.primary_tag AND k.stage = g.stage GROUP BY 1, 2, 3"""


@query("agg_stage_sector_amount_share", SHARE.format(dc=DC, rank="sum(amount)", stage=STAGE3, measure="sum(k.amount)", stages="('Seed'), ('Early'), ('Late')")
       .replace("sum(k.amount) AS t", "sum(amount) AS t"), r6="share")
def _(t):
    return D.sector_stage_share(rolled(t, ["primary_tag"], ["year", "round_type"]), "amount", years=SPAN)


@query("agg_stage_sector_deal_share", SHARE.format(dc=DC, rank="count(*)", stage=STAGE_LONG, measure="count(k.id)",
                                                  stages="('Seed'), ('Early Stage'), ('Later Stage')"), r6="share")
def _(t):
    return D.sector_stage_share(rolled(t, ["primary_tag"], ["year", "round_type"]), "deals", years=SPAN, mapping=V.STAGES_LONG)


@query("agg_ecosystem_sector_trend", f"""
  WITH {DC}, top AS (SELECT ecosystem_name FROM dc GROUP BY 1 ORDER BY sum(amount) DESC, ecosystem_name LIMIT 6),
  s AS (SELECT ecosystem_name, year, primary_tag, 100 * sum(coalesce(amount, 0)) / sum(sum(coalesce(amount, 0))) OVER (PARTITION BY ecosystem_name, year) AS share
    FROM dc WHERE ecosystem_name IN (SELECT ecosystem_name FROM top) GROUP BY 1, 2, 3),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ecosystem_name, year ORDER BY share DESC, primary_tag) AS INTEGER) AS rank FROM s)
  SELECT * FROM r WHERE rank <= 5""", r6="share")
def _(t):
    return D.ecosystem_sector_trend(rolled(t, ["ecosystem_name", "primary_tag"], ["year"]))


YS = """WITH {0}, top AS (SELECT primary_tag FROM dc GROUP BY 1 ORDER BY {1}, primary_tag LIMIT {2}),
  k AS (SELECT * FROM dc WHERE primary_tag IN (SELECT primary_tag FROM top)),
  g AS (SELECT * FROM (SELECT DISTINCT year FROM k) CROSS JOIN top)
  SELECT g.year, g.primary_tag, count(k.id) AS deals{3} FROM g LEFT JOIN k ON k.year = g.year AND k.primary_tag = g.primary_tag GROUP BY 1, 2"""


@query("agg_year_sector_pivot", YS.format(DC, "sum(amount) DESC", 10, ", coalesce(sum(amount), 0) / 1e6 AS amount"), r4="amount")
def _(t):
    return D.year_sector_table(rolled(t, ["primary_tag"], ["year"]), by="amount")


@query("agg_year_sector_deals", YS.format(DC, "count(*) DESC", 10, ", coalesce(sum(amount), 0) / 1e6 AS amount"), r4="amount")
def _(t):
    return D.year_sector_table(rolled(t, ["primary_tag"], ["year"]), by="deals")


@query("agg_stage_sector_crosstab", f"""
  WITH {DC}, top AS (SELECT primary_tag FROM dc GROUP BY 1 ORDER BY count(*) DESC, primary_tag LIMIT 10),
  k AS (SELECT primary_tag, {STAGE_LONG} AS stage FROM dc WHERE primary_tag IN (SELECT primary_tag FROM top) AND {STAGE_LONG} IS NOT NULL),
  u AS (SELECT primary_tag, stage, count(*) AS n FROM k GROUP BY 1, 2 UNION ALL SELECT primary_tag, 'all', count(*) FROM k GROUP BY 1
    UNION ALL SELECT 'all', stage, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*) FROM k)
  SELECT *, 100.0::DOUBLE * n / max(CASE WHEN stage = 'all' THEN n END) OVER (PARTITION BY primary_tag) AS row_percent FROM u""", r6="row_percent")
def _(t):
    return D.sector_stage_table(rolled(t, ["primary_tag"], ["round_type"]))


@query("agg_bottom_sectors", f"""
  WITH {DC}, s AS (SELECT primary_tag, count(*) AS deals, sum(coalesce(amount, 0)) / 1e6 AS amount, avg(amount) / 1e6 AS mean_amount,
    100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS deal_share FROM dc GROUP BY 1) SELECT * FROM s ORDER BY deals, primary_tag LIMIT 5""",
       r4="amount mean_amount", r6="deal_share")
def _(t):
    return D.bottom_sectors(rolled(t, ["primary_tag"]))


@query("agg_bottom_sector_years", YS.format(DC, "count(*)", 5, ""))
def _(t):
    return D.bottom_sector_years(rolled(t, ["primary_tag"], ["year"]))


GROWTH_YEARS = list(range(FIRST_YEAR, LAST_YEAR + 1))
GROWTH_SQL = ", ".join(f"coalesce(100 * (a{b} / nullif(a{a}, 0) - 1), 0) AS growth_{b}" for a, b in zip(GROWTH_YEARS, GROWTH_YEARS[1:]))
GROWTHS = ", ".join(f"growth_{y}" for y in GROWTH_YEARS[1:])


@query("agg_sector_growth_table", f"""
  WITH {DC}, s AS (SELECT primary_tag, sum(amount) / 1e6 AS total_amount,
    {", ".join(f"coalesce(sum(amount) FILTER (year = {y}), 0) / 1e6 AS a{y}" for y in GROWTH_YEARS)},
    count(*) FILTER (year = 1995) AS first_deals, count(*) FILTER (year = 2000) AS last_deals FROM dc GROUP BY 1),
  p AS (SELECT *, {GROWTH_SQL} FROM s WHERE a1995 > 0),
  l AS (SELECT primary_tag AS tag, unnest([{GROWTHS}]) AS g, unnest([1996, 1997, 1998, 1999, 2000]) AS y FROM p),
  v AS (SELECT tag, stddev_samp(g) AS volatility, arg_max(y, g) AS best_year, arg_min(y, g) AS worst_year FROM l GROUP BY 1)
  SELECT primary_tag, total_amount, first_deals, last_deals, {GROWTHS}, 100 * (a2000 / a1995 - 1) AS total_growth,
    100.0::DOUBLE * (last_deals - first_deals) / first_deals AS deal_growth, volatility, best_year, worst_year, a1995 AS first_amount, a2000 AS last_amount
  FROM p JOIN v ON primary_tag = tag""", r4="total_amount first_amount last_amount total_growth deal_growth volatility " + GROWTHS.replace(",", ""))
def _(t):
    return D.sector_growth_table(rolled(t, ["primary_tag"], ["year"]), *SPAN)


@query("agg_latest_findings", f"""
  WITH d AS (SELECT *, {QUARTER} AS q FROM deals WHERE year < 2001),
  qs AS (SELECT q, sum(coalesce(amount, 0)) AS a FROM d GROUP BY 1),
  ch AS (SELECT q, 100 * (a - lag(a) OVER (ORDER BY q)) / lag(a) OVER (ORDER BY q) AS c FROM qs),
  lg AS (SELECT year, 100.0::DOUBLE * count(*) FILTER (amount > 1e7) / count(amount) AS s FROM d GROUP BY 1),
  hub AS (SELECT ecosystem_name, count(*) AS n FROM companies GROUP BY 1 ORDER BY n DESC, ecosystem_name DESC LIMIT 10)
  SELECT (SELECT q FROM qs ORDER BY a DESC, q LIMIT 1) AS peak_quarter, (SELECT c FROM ch ORDER BY q DESC LIMIT 1) AS last_quarter_change,
    (SELECT s FROM lg WHERE year = 2000) AS large_share, (SELECT s FROM lg WHERE year = 1999) AS large_share_before,
    (SELECT ecosystem_name FROM hub ORDER BY n DESC, ecosystem_name DESC LIMIT 1) AS lead_ecosystem,
    (SELECT 100.0::DOUBLE * max(n) / sum(n) FROM hub) AS lead_share""", r6="last_quarter_change large_share large_share_before lead_share")
def _(t):
    return D.latest_findings(closed(t), t.companies)


@query("agg_sector_region_amounts", """
  WITH c AS (SELECT primary_tag, ecosystem_name, sum(coalesce(amount, 0)) AS amount, avg(amount) AS mean_amount, count(amount) AS priced FROM deal_company
    GROUP BY GROUPING SETS ((primary_tag, ecosystem_name), (primary_tag), (ecosystem_name)))
  SELECT coalesce(primary_tag, 'all') AS primary_tag, coalesce(ecosystem_name, 'all') AS ecosystem_name, amount, mean_amount, priced FROM c""",
       r0="amount mean_amount")
def _(t):
    return P.sector_region_amounts(D.rollup(t.deals, t.companies, ["primary_tag", "ecosystem_name"]))


# Ages.

AGED = f"""ag AS (SELECT *, {AGE_BIN} AS age_band, {STAGE_AGE} AS stage FROM
  (SELECT id, round_type, amount, primary_tag, ecosystem_name, (date - date_founded) / 365.25::DOUBLE AS age FROM deal_company))"""
BANDS = ", ".join(f"('{b}')" for b in V.AGE_LABELS)
RVALUES = ", ".join(f"('{r}')" for r in V.ROUND_ORDER)


@query("agg_age_round_crosstab", f"""WITH {AGED}, g AS (SELECT * FROM (SELECT DISTINCT age_band FROM ag WHERE age_band IS NOT NULL AND round_type IN {tuple(V.ROUND_ORDER)})
    CROSS JOIN (VALUES {RVALUES}) v(round_type))
  SELECT g.age_band, g.round_type, count(ag.id) AS n FROM g LEFT JOIN ag ON ag.age_band = g.age_band AND ag.round_type = g.round_type GROUP BY 1, 2""")
def _(t):
    return G.age_rounds(G.deals_with_age(t.deals, t.companies))


@query("agg_age_stage_crosstab", f"""WITH {AGED}, g AS (SELECT * FROM (SELECT DISTINCT age_band FROM ag WHERE age_band IS NOT NULL AND stage IS NOT NULL)
    CROSS JOIN (VALUES ('Seed'), ('Early Stage'), ('Late Stage')) v(stage))
  SELECT g.age_band, g.stage, count(ag.id) AS n FROM g LEFT JOIN ag ON ag.age_band = g.age_band AND ag.stage = g.stage GROUP BY 1, 2""")
def _(t):
    return G.age_stages(G.deals_with_age(t.deals, t.companies))


@query("agg_age_by_round", f"""WITH {AGED} SELECT CAST(o AS INTEGER) AS place, r AS round_type, avg(age) AS mean_age, count(age) AS n, quantile_cont(age, 0.5) AS median_age
  FROM (VALUES {", ".join(f"({i + 1}, '{r}')" for i, r in enumerate(V.ROUND_ORDER))}) v(o, r) LEFT JOIN ag ON ag.round_type = r GROUP BY 1, 2""",
       r6="mean_age median_age")
def _(t):
    return G.age_by_round(G.deals_with_age(t.deals, t.companies))


@query("agg_age_distribution", f"WITH {AGED} SELECT b AS age_band, count(ag.id) AS n FROM (VALUES {BANDS}) v(b) LEFT JOIN ag ON ag.age_band = b GROUP BY 1")
def _(t):
    return G.age_distribution(G.deals_with_age(t.deals, t.companies))


SECTOR_AGE = f"""WITH {AGED}, g AS (SELECT primary_tag, b AS age_band FROM (SELECT DISTINCT primary_tag FROM ag) CROSS JOIN (VALUES {BANDS}) v(b)),
  sa AS (SELECT g.primary_tag, g.age_band, count(amount) AS deals, coalesce(sum(amount), 0) AS amount, avg(amount) AS mean_amount
    FROM g LEFT JOIN ag ON ag.primary_tag = g.primary_tag AND ag.age_band = g.age_band GROUP BY 1, 2)"""


@query("agg_sector_age_stats", SECTOR_AGE + " SELECT * FROM sa", r3="amount", r0="mean_amount")
def _(t):
    return G.sector_ages(G.deals_with_age(t.deals, t.companies))


@query("agg_sector_age_matrix", SECTOR_AGE + """ SELECT primary_tag, age_band, deals FROM sa WHERE primary_tag IN
  (SELECT primary_tag FROM sa GROUP BY 1 ORDER BY sum(deals) DESC, primary_tag LIMIT 10)""")
def _(t):
    return G.sector_age_matrix(G.sector_ages(G.deals_with_age(t.deals, t.companies)).persist())


@query("agg_sector_age_totals", SECTOR_AGE + """ SELECT primary_tag, CAST(sum(deals) AS BIGINT) AS deals, sum(amount) AS amount, avg(mean_amount) AS mean_of_means
  FROM sa GROUP BY 1 ORDER BY deals DESC, primary_tag LIMIT 10""", r0="amount mean_of_means")
def _(t):
    return G.sector_age_totals(G.sector_ages(G.deals_with_age(t.deals, t.companies)))


@query("agg_stage_age_stats", f"""WITH {AGED} SELECT stage, avg(age) AS mean_age, count(age) AS n, quantile_cont(age, 0.5) AS median_age FROM ag
  WHERE stage IS NOT NULL GROUP BY 1""", r6="mean_age median_age")
def _(t):
    return G.stage_ages(G.deals_with_age(t.deals, t.companies))


ROUND_AGE = f"""WITH ra AS (SELECT round_type, avg(age) AS mean_age, min(age) AS min_age, max(age) AS max_age, stddev_samp(age) AS std_age,
  quantile_cont(age, 0.5) AS median_age FROM deal_company WHERE round_type IN {tuple(V.FIRST_ROUNDS)} GROUP BY 1)"""


@query("agg_series_age_stats", ROUND_AGE + " SELECT * FROM ra", r6="mean_age min_age max_age std_age median_age")
def _(t):
    return G.round_ages(t.deals, t.companies_aged)


@query("agg_ecosystem_series_ages", f"""SELECT ecosystem_name, round_type, avg(age) AS mean_age FROM deal_company
  WHERE round_type IN {tuple(V.FIRST_ROUNDS)} GROUP BY 1, 2""", r6="mean_age")
def _(t):
    return G.ecosystem_round_ages(t.deals, t.companies_aged)


@query("agg_series_age_step", ROUND_AGE + """ SELECT avg(d) AS mean_step FROM (SELECT mean_age - lag(mean_age) OVER (ORDER BY mean_age) AS d FROM ra)""", r6="mean_step")
def _(t):
    return G.age_progression(G.round_ages(t.deals, t.companies_aged))


# Ecosystem metrics.

EM = f"""WITH em AS (SELECT ecosystem_name, avg(amount) AS avg_deal_size, stddev_samp(amount) AS deal_size_std, count(amount) AS deal_count, avg(age) AS avg_company_age,
  sum(amount) / 1e6 AS total_funding, 100.0::DOUBLE * count(*) FILTER (round_type IN {tuple(V.EARLY_ROUNDS)}) / count(round_type) AS early_stage_ratio,
  100.0::DOUBLE * count(*) FILTER (round_type IN {tuple(V.LATE_ROUNDS)}) / count(round_type) AS late_stage_ratio,
  quantile_cont(amount, 0.5) AS median_deal_size, sum(amount) / 1e6 / avg(age) AS funding_per_year FROM deal_company GROUP BY 1)"""


@query("agg_ecosystem_metrics", EM + " SELECT * FROM em", r0="avg_deal_size deal_size_std median_deal_size",
       r4="total_funding funding_per_year", r6="avg_company_age early_stage_ratio late_stage_ratio")
def _(t):
    return P.ecosystem_metrics(t.deals, t.companies_aged)


METRICS = P.METRICS


@query("agg_ecosystem_metric_correlations", EM + " UNION ALL ".join(
    f" SELECT '{a}' AS left_column, '{b}' AS right_column, corr({a}, {b}) AS correlation FROM em" for i, a in enumerate(METRICS) for b in METRICS[i + 1:]), r6="correlation")
def _(t):
    from dealflux.operators.profile import correlation_matrix

    return correlation_matrix(P.ecosystem_metrics(t.deals, t.companies_aged), METRICS)


@query("agg_ecosystem_metric_summary", EM + " UNION ALL ".join(
    f" SELECT '{m}' AS metric, avg({m}) AS mean, quantile_cont({m}, 0.5)::DOUBLE AS median, stddev_samp({m}) AS std FROM em"
    for m in [*METRICS, "early_stage_ratio", "late_stage_ratio"]), r2="mean median std")
def _(t):
    return P.ecosystem_metric_summary(P.ecosystem_metrics(t.deals, t.companies_aged).persist())


@query("agg_ecosystem_series_share", """
  WITH c AS (SELECT ecosystem_name, round_type, count(*) AS n FROM deal_company WHERE round_type IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT * FROM (SELECT DISTINCT ecosystem_name FROM c) CROSS JOIN (SELECT DISTINCT round_type FROM c)),
  f AS (SELECT g.*, coalesce(n, 0) AS deals FROM g LEFT JOIN c USING (ecosystem_name, round_type))
  SELECT *, 100.0::DOUBLE * deals / sum(deals) OVER (PARTITION BY ecosystem_name) AS share FROM f""", r6="share")
def _(t):
    return P.ecosystem_round_share(D.rollup(t.deals, t.companies, ["ecosystem_name"], ["round_type"]).persist())


# Investors.


@query("agg_investor_country", """SELECT country, count(deal_id) AS deals, CAST(sum(lead_investor_flag) AS BIGINT) AS lead_deals
  FROM deal_investor x JOIN investors i ON i.id = x.investor_id GROUP BY 1""")
def _(t):
    return I.by_country(t.deal_investor, t.investors)


@query("agg_stage_by_country", """
  WITH c AS (SELECT investor_country AS country, round_type, count(*) AS n FROM deal_investor WHERE round_type IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT * FROM (SELECT DISTINCT country FROM c) CROSS JOIN (SELECT DISTINCT round_type FROM c))
  SELECT g.country, g.round_type, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (country, round_type)""")
def _(t):
    return I.rounds_by_country(t.deal_investor, t.investors)


@query("agg_active_investors", """SELECT investor_name, investor_country AS country, count(deal_id) AS deals, CAST(sum(lead_investor_flag) AS BIGINT) AS lead_deals
  FROM deal_investor GROUP BY 1, 2""")
def _(t):
    return I.active(t.deal_investor, t.investors)


@query("agg_investor_estimated_amounts", """
  WITH r AS (SELECT x.*, amount / count(*) OVER (PARTITION BY deal_id) AS e FROM deal_investor x LEFT JOIN deals d ON d.id = x.deal_id)
  SELECT investor_name, investor_id, count(deal_id) AS deals, sum(e) AS amount FROM r GROUP BY 1, 2 ORDER BY amount DESC, investor_id LIMIT 20""", r0="amount")
def _(t):
    return I.estimated_amounts(t.deal_investor, t.deals)


REGION = "CASE WHEN investor_country IN ('Canada', 'USA') THEN investor_country ELSE 'Other International' END"


@query("agg_region_stage_share", f"""
  WITH c AS (SELECT {REGION} AS region, round_type, count(*) AS n FROM deal_investor WHERE round_type IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT region, round_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT region FROM c) CROSS JOIN (SELECT DISTINCT round_type FROM c) LEFT JOIN c USING (region, round_type)),
  s AS (SELECT *, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY region), 1) AS share FROM g),
  r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY share DESC, round_type) AS rn, 100 - sum(share) OVER (PARTITION BY region) AS rest FROM s)
  SELECT region, round_type, n, CASE WHEN rn = 1 THEN share + rest ELSE share END AS share FROM r""", r4="share")
def _(t):
    return I.region_round_share(t.deal_investor)


@query("agg_region_stage_avg_deal", f"""SELECT {REGION} AS region, x.round_type, avg(amount) / 1e6 AS mean_amount FROM deal_investor x LEFT JOIN deals d ON d.id = x.deal_id
  WHERE x.round_type IS NOT NULL GROUP BY 1, 2""", r4="mean_amount")
def _(t):
    return I.region_round_mean(t.deal_investor, t.deals)


@query("agg_investor_stage_influence", f"""
  WITH t AS (SELECT investor_name, count(*) AS t FROM deal_investor GROUP BY 1 ORDER BY t DESC, investor_name LIMIT 5),
  k AS (SELECT investor_name, t, {STAGE_LONG} AS stage FROM deal_investor JOIN t USING (investor_name)),
  g AS (SELECT * FROM t CROSS JOIN (VALUES ('Seed'), ('Early Stage'), ('Later Stage')) v(stage))
  SELECT g.investor_name, g.stage, 100.0::DOUBLE * count(k.stage) / max(g.t) AS share FROM g LEFT JOIN k ON k.investor_name = g.investor_name AND k.stage = g.stage GROUP BY 1, 2""",
       r6="share")
def _(t):
    return I.stage_influence(t.deal_investor)


TOP_INV = """WITH p AS (SELECT DISTINCT deal_id, investor_name AS investor, x.round_type, coalesce(amount, 0) AS amount FROM deal_investor x JOIN deals d ON d.id = x.deal_id),
  top AS (SELECT investor FROM p GROUP BY 1 ORDER BY {0} DESC, investor LIMIT 10),
  k AS (SELECT * FROM p WHERE investor IN (SELECT investor FROM top) AND round_type IS NOT NULL),
  g AS (SELECT * FROM (SELECT DISTINCT investor FROM k) CROSS JOIN (SELECT DISTINCT round_type FROM k))
  SELECT g.investor, g.round_type, {1} FROM g LEFT JOIN k USING (investor, round_type) GROUP BY 1, 2"""


@query("agg_top_investor_series", TOP_INV.format("count(*)", "count(k.deal_id) AS n"))
def _(t):
    return I.investor_rounds(I.investor_pairs(t.deal_investor))


@query("agg_top_investor_series_amounts", TOP_INV.format("sum(amount)", "coalesce(sum(k.amount), 0) AS amount"), r3="amount")
def _(t):
    return I.investor_round_amounts(I.investor_pairs(t.deal_investor), t.deals)


RS = f"""WITH r AS (SELECT {REGION} AS region, primary_tag, deal_id, amount FROM deal_investor x JOIN deal_company d ON d.id = x.deal_id),
  top AS (SELECT primary_tag FROM r GROUP BY 1 ORDER BY sum(amount) DESC, primary_tag LIMIT 10),
  g AS (SELECT * FROM (SELECT DISTINCT region FROM r) CROSS JOIN top),
  c AS (SELECT g.region, g.primary_tag, count(deal_id) AS deals, coalesce(sum(amount), 0) / 1e6 AS amount FROM g LEFT JOIN r USING (region, primary_tag) GROUP BY 1, 2),
  rs AS (SELECT *, 100.0::DOUBLE * deals / sum(deals) OVER (PARTITION BY region) AS region_share, 100.0::DOUBLE * deals / sum(deals) OVER (PARTITION BY primary_tag) AS sector_share FROM c)"""


def region_cells(t):
    return I.region_sector(I.region_sector_sums(t.deal_investor, t.deals, t.companies).persist()).persist()


@query("agg_region_sector", RS + " SELECT * FROM rs", r4="amount", r6="region_share sector_share")
def _(t):
    return region_cells(t)


@query("agg_region_totals", RS + """, t AS (SELECT region, CAST(sum(deals) AS BIGINT) AS deals, sum(amount) AS amount FROM rs GROUP BY 1)
  SELECT *, 100.0::DOUBLE * deals / sum(deals) OVER () AS deal_share, 100 * amount / sum(amount) OVER () AS amount_share FROM t""", r0="amount", r6="deal_share amount_share")
def _(t):
    return I.region_totals(region_cells(t))


@query("agg_region_dominance", RS + """ SELECT 'region' AS axis, region AS name, primary_tag AS leader, region_share AS share FROM rs
    QUALIFY row_number() OVER (PARTITION BY region ORDER BY deals DESC, primary_tag) = 1
  UNION ALL SELECT * FROM (SELECT 'sector' AS axis, primary_tag AS name, region AS leader, sector_share AS share FROM rs
    QUALIFY row_number() OVER (PARTITION BY primary_tag ORDER BY deals DESC, region) = 1)""", r6="share")
def _(t):
    cells = region_cells(t)
    one = lambda axis, g, m: I.dominance(cells, g, m).select(F.lit(axis).alias("axis"), F.col(g).alias("name"), "leader", "share")
    return one("region", "region", "primary_tag").unionByName(one("sector", "primary_tag", "region"))


@query("agg_region_year", f"""SELECT year, {REGION} AS region, count(deal_id) AS deals, sum(coalesce(amount, 0)) AS amount
  FROM deal_investor x LEFT JOIN deals d ON d.id = x.deal_id WHERE year < 2001 GROUP BY 1, 2""", r0="amount")
def _(t):
    return I.region_years(t.deal_investor, t.deals, before=LAST_YEAR + 1)


# Tables over growth rows.

GROW = f"""WITH q AS (SELECT primary_tag AS sector, {STAGE3} AS stage, date_trunc('quarter', date) AS q, count(*) AS deals, sum(coalesce(amount, 0)) AS amount
    FROM deal_company WHERE {STAGE3} IS NOT NULL GROUP BY 1, 2, 3),
  w AS (SELECT *, 100 * (amount - lag(amount) OVER w) / nullif(lag(amount) OVER w, 0) AS ga, 100.0::DOUBLE * (deals - lag(deals) OVER w) / nullif(lag(deals) OVER w, 0) AS gd,
    row_number() OVER (PARTITION BY sector, stage ORDER BY q DESC) AS rn FROM q WINDOW w AS (PARTITION BY sector, stage ORDER BY q)),
  gr AS (SELECT sector, stage, max(ga) FILTER (rn = 1) AS growth_rate_amount, max(gd) FILTER (rn = 1) AS growth_rate_deals,
    avg(CASE WHEN ga > 0 THEN 1.0::DOUBLE WHEN ga IS NOT NULL THEN 0 END) AS growth_probability,
    max(amount) FILTER (rn = 1) AS total_amount_last_quarter, max(deals) FILTER (rn = 1) AS deal_count_last_quarter FROM w GROUP BY 1, 2)"""


@query("agg_sector_stage_growth", GROW + " SELECT * FROM gr", r3="total_amount_last_quarter", r4="growth_rate_amount growth_rate_deals", r6="growth_probability")
def _(t):
    return O.sector_stage_growth(t.deals, t.companies)


@query("agg_stage_growth_summary", GROW + """ SELECT stage, avg(growth_rate_amount) AS growth_rate_amount, avg(growth_rate_deals) AS growth_rate_deals,
  avg(growth_probability) AS growth_probability, sum(total_amount_last_quarter) AS total_amount, CAST(sum(deal_count_last_quarter) AS BIGINT) AS deal_count FROM gr GROUP BY 1""",
       r3="total_amount", r4="growth_rate_amount growth_rate_deals growth_probability")
def _(t):
    return O.stage_summary(O.sector_stage_growth(t.deals, t.companies))


@query("agg_stage_growth_heatmap", GROW + """, a AS (SELECT sector, avg(growth_rate_amount) AS sector_growth FROM gr GROUP BY 1),
  g AS (SELECT * FROM a CROSS JOIN (SELECT DISTINCT stage FROM gr))
  SELECT sector, stage, coalesce(growth_rate_amount, 0) AS growth, sector_growth FROM g LEFT JOIN gr USING (sector, stage)""", r4="growth sector_growth")
def _(t):
    return O.growth_heatmap(O.sector_stage_growth(t.deals, t.companies))


@query("agg_ranked_growth", GROW + """ SELECT * FROM gr WHERE growth_rate_amount > 0 AND growth_probability >= 0.4 AND total_amount_last_quarter > 10000000
  ORDER BY growth_probability DESC, growth_rate_amount DESC, sector, stage LIMIT 10""", r3="total_amount_last_quarter", r4="growth_rate_amount growth_rate_deals", r6="growth_probability")
def _(t):
    rows = O.sector_stage_growth(t.deals, t.companies)
    return O.ranked_growth(rows, min_growth=0, min_probability=0.4, min_amount=1e7)


@query("agg_forecast_vs_actual", """
  WITH y AS (SELECT ecosystem_name AS ecosystem, year, sum(coalesce(amount, 0)) AS a, count(*) AS n FROM deal_company GROUP BY 1, 2),
  w AS (SELECT p.ecosystem, avg(p.a) FILTER (p.year BETWEEN 1998 AND 2000) AS predicted_amount, avg(p.n) FILTER (p.year BETWEEN 1998 AND 2000) AS predicted_deals,
    max(p.a) FILTER (p.year = 2000) AS actual_amount, max(p.n) FILTER (p.year = 2000) AS actual_deals,
    count(*) FILTER (p.year BETWEEN 1998 AND 2000 AND p.a > 0) / 3.0::DOUBLE AS pr FROM y p GROUP BY 1)
  SELECT ecosystem, predicted_amount / 1e6 AS predicted_amount, actual_amount / 1e6 AS actual_amount, 100 * (predicted_amount - actual_amount) / actual_amount AS amount_growth_rate,
    predicted_deals, actual_deals, 100 * (predicted_deals - actual_deals) / actual_deals AS deals_growth_rate, 100 * pr AS growth_probability FROM w""",
       r4="predicted_amount actual_amount amount_growth_rate predicted_deals deals_growth_rate growth_probability")
def _(t):
    # A three-year mean stands in for the forecast document here.
    y = D.rollup(t.deals, t.companies, ["ecosystem_name"], ["year"]).withColumnRenamed("ecosystem_name", "ecosystem")
    recent, last = F.col("year").between(1998, 2000), F.col("year") == 2000
    rows = y.groupBy("ecosystem").agg(
        F.avg(F.when(recent, F.col("amount"))).alias("predicted_amount"), F.avg(F.when(recent, F.col("deals"))).alias("predicted_deals"),
        F.max(F.when(last, F.col("amount"))).alias("actual_amount"), F.max(F.when(last, F.col("deals"))).alias("actual_deals"),
        (F.count_if(recent & (F.col("amount") > 0)) / 3.0).alias("growth_probability"),
    )
    return O.forecast_vs_actual(rows)
