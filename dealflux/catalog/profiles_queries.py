"""Profiling, cleaning, filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealflux.catalog.registry import query
from dealflux.functions import columns as C
from dealflux.functions import vocab as V
from dealflux.operators import cleaning as L
from dealflux.operators import filters as flt
from dealflux.operators import profile as P
from dealflux.operators import projections as prj
from dealflux.operators import sessions as S
from dealflux.plans import kernels as K
from dealflux.catalog.events_queries import DESCRIBE, DESCRIBED
from dealflux.sources.adapters import AS_OF

EVENT_COLS = ["user_id", "country", "region", "city", "os_name", "device_family", "language", "platform"]
CATS = ["event_type", "country", "region", "device_family", "language"]


@query("agg_value_counts", """SELECT event_type, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percent
  FROM web_events GROUP BY 1""", r6="percent")
def _(t):
    return P.value_counts(t.web_events, "event_type")


@query("agg_value_counts_top", """WITH c AS (SELECT city, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percent
  FROM web_events WHERE city IS NOT NULL GROUP BY 1) SELECT * FROM c ORDER BY n DESC, city LIMIT 10""", r6="percent")
def _(t):
    return P.value_counts(t.web_events, "city", top=10)


CITY_SHARES = """WITH c AS (SELECT city, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percent
  FROM web_events WHERE city IS NOT NULL GROUP BY 1)"""


@query("agg_value_counts_other", CITY_SHARES + """ SELECT CASE WHEN percent < 1 THEN 'Other' ELSE city END AS city,
  CAST(sum(n) AS BIGINT) AS n, sum(percent) AS percent FROM c GROUP BY 1""", r6="percent")
def _(t):
    return P.value_counts_other(t.web_events, "city")


@query("set_union_other_row", CITY_SHARES + """, k AS (SELECT * FROM c ORDER BY n DESC, city LIMIT 5)
  SELECT city, n, percent FROM k UNION ALL SELECT 'Other', CAST(sum(n) AS BIGINT), sum(percent) FROM c WHERE city NOT IN (SELECT city FROM k)""",
       r6="percent")
def _(t):
    return P.append_other_row(P.value_counts(t.web_events, "city"), "city", top=5)


@query("agg_sampled_counts", """SELECT event_type, count(*) AS sample_n, CAST(round(count(*) / 0.3::DOUBLE) AS BIGINT) AS estimated_n FROM web_events
  WHERE ('0x' || substr(md5('42#' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.3::DOUBLE GROUP BY 1""")
def _(t):
    return P.sampled_counts(t.web_events, "event_type", "event_id", fraction=0.3)


@query("agg_frequent_users", """WITH t AS (SELECT count(user_id) AS rows FROM web_events)
  SELECT user_id AS value, count(*) AS n, count(*) / rows::DOUBLE AS share FROM web_events, t WHERE user_id IS NOT NULL
  GROUP BY user_id, rows HAVING count(*) / rows::DOUBLE > 0.007::DOUBLE""", r6="share")
def _(t):
    return P.frequent_values(t.web_events, "user_id", share=0.007)


@query("agg_null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS nulls, "
    f"100.0::DOUBLE * (count(*) - count({c})) / count(*) AS null_percent FROM web_events" for c in EVENT_COLS), r6="null_percent")
def _(t):
    return P.null_profile(t.web_events, EVENT_COLS)


UNIQUE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, 100.0::DOUBLE * count(DISTINCT {c}) / count(*) AS unique_percent "
    "FROM web_events" for c in ["event_id", *EVENT_COLS])


@query("agg_unique_profile", f"""SELECT *, CASE WHEN distinct_values = 1 THEN 'constant' WHEN unique_percent > 90 THEN 'high'
  WHEN distinct_values BETWEEN 2 AND 5 THEN 'low' ELSE 'medium' END AS uniqueness FROM ({UNIQUE})""", r6="unique_percent")
def _(t):
    return P.unique_profile(t.web_events, ["event_id", *EVENT_COLS])


LONG_CATS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM web_events WHERE {c} IS NOT NULL" for c in CATS)


@query("agg_categorical_profile", f"""
  WITH c AS (SELECT column_name, value, count(*) AS n FROM ({LONG_CATS}) GROUP BY 1, 2),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INTEGER) AS rank,
    count(*) OVER (PARTITION BY column_name) AS distinct_values FROM c)
  SELECT * FROM r WHERE rank <= 10""")
def _(t):
    return P.categorical_profile(t.web_events, CATS)


@query("agg_imbalance", f"""
  WITH c AS (SELECT column_name, value, count(*) AS n FROM ({LONG_CATS}) GROUP BY 1, 2)
  SELECT column_name, max(n)::DOUBLE / min(n) AS imbalance_ratio, 100.0::DOUBLE * max(n) / sum(n) AS dominant_percent FROM c GROUP BY 1""",
       r6="imbalance_ratio dominant_percent")
def _(t):
    return P.imbalance(t.web_events, CATS)


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("agg_numeric_describe", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {DESCRIBE.format(c)} FROM lineitem" for c in LINE), r4=DESCRIBED)
def _(t):
    return P.numeric_describe(t.base("lineitem"), LINE)


@query("agg_iqr_outliers", """
  WITH l AS (SELECT 'amount' AS column_name, amount AS v FROM deals WHERE amount IS NOT NULL
    UNION ALL SELECT 'year', year FROM deals),
  q AS (SELECT column_name, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY 1)
  SELECT column_name, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers,
    100.0::DOUBLE * count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / count(*) AS outlier_percent
  FROM l JOIN q USING (column_name) GROUP BY 1""", r6="outlier_percent")
def _(t):
    return P.iqr_outliers(t.deals, ["amount", "year"])


CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS left_column, '{b}' AS right_column, corr({a}, {b}) AS correlation FROM lineitem"
    for i, a in enumerate(LINE) for b in LINE[i + 1:])


@query("agg_correlation_matrix", CORR, r6="correlation")
def _(t):
    return P.correlation_matrix(t.base("lineitem"), LINE)


@query("agg_correlation_strong", f"SELECT * FROM ({CORR}) WHERE abs(correlation) > 0.5", r6="correlation")
def _(t):
    return P.correlation_matrix(t.base("lineitem"), LINE, above=0.5)


@query("agg_quality_checks", """
  WITH e AS (SELECT user_id, event_type, city, CAST(event_time AS DATE) AS d FROM web_events)
  SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM e)) AS duplicate_rows,
    count(*) FILTER (user_id IS NULL OR event_type IS NULL OR city IS NULL) AS null_rows,
    count(*) FILTER (user_id = 0) AS zero_rows FROM e""")
def _(t):
    e = t.web_events.select("user_id", "event_type", "city", F.to_date("event_time").alias("d"))
    return P.quality_checks(e, ["user_id"])


@query("agg_json_structure_profile", """
  SELECT array_to_string(list_sort(json_keys(event_properties)), ',') AS structure, count(*) AS n,
    (SELECT count(*) FROM web_events) AS rows, (SELECT count(event_properties) FROM web_events) AS non_null,
    (SELECT count(DISTINCT event_properties) FROM web_events) AS distinct_payloads
  FROM web_events WHERE event_properties IS NOT NULL GROUP BY 1 ORDER BY n DESC LIMIT 5""")
def _(t):
    return P.json_structure_profile(t.web_events, "event_properties")


# Filters.

KEPT = "SELECT event_id, device_family FROM web_events WHERE device_family NOT IN ('iOS', 'Android')"


@query("flt_exclude_devices", KEPT)
def _(t):
    return flt.exclude(t.web_events).select("event_id", "device_family")


@query("flt_exclude_devices_keep_null", "SELECT event_id, os_name FROM web_events WHERE os_name NOT IN ('iOS', 'Android') OR os_name IS NULL")
def _(t):
    return flt.exclude(t.web_events, "os_name", keep_null=True).select("event_id", "os_name")


@query("flt_not_null_user", "SELECT event_id, user_id FROM web_events WHERE user_id IS NOT NULL")
def _(t):
    return flt.not_null(t.web_events, "user_id").select("event_id", "user_id")


@query("flt_time_cutoff", "SELECT event_id FROM web_events WHERE event_time >= TIMESTAMP '2024-01-15 00:00:00'")
def _(t):
    return flt.since(t.web_events, "event_time", "2024-01-15").select("event_id")


@query("flt_time_cutoff_report", """
  SELECT count(*) AS before, count(*) FILTER (event_time >= TIMESTAMP '2024-01-15') AS after,
    count(*) FILTER (event_time < TIMESTAMP '2024-01-15') AS removed,
    100.0::DOUBLE * count(*) FILTER (event_time < TIMESTAMP '2024-01-15') / count(*) AS removed_percent FROM web_events""", r6="removed_percent")
def _(t):
    return flt.since_report(t.web_events, "event_time", "2024-01-15")


@query("flt_year_window", "SELECT id, year FROM deals WHERE year BETWEEN 1996 AND 1999")
def _(t):
    return flt.years(t.deals, 1996, 1999).select("id", "year")


@query("flt_event_blacklist", "SELECT event_id, event_type FROM web_events WHERE event_type <> 'error'")
def _(t):
    return flt.exclude(t.web_events, "event_type", ["error"]).select("event_id", "event_type")


@query("flt_prefix_events", "SELECT event_id, event_type FROM web_events WHERE event_type LIKE 'p%' OR event_type LIKE 'si%'")
def _(t):
    return flt.starts_with_any(t.web_events, ["p", "si"]).select("event_id", "event_type")


@query("flt_both_null", "SELECT count(*) AS n FROM web_events WHERE city IS NULL AND region IS NULL")
def _(t):
    return flt.all_null(t.web_events, "city", "region").agg(F.count(F.lit(1)).alias("n"))


@query("flt_threshold", "SELECT id, amount FROM deals WHERE amount > 10000000", r3="amount")
def _(t):
    return t.deals.where(F.col("amount") > 1e7).select("id", "amount")


@query("flt_column_equality", """
  SELECT count(*) FILTER (server_upload_time = client_upload_time) AS equal_rows,
    count(*) FILTER (server_upload_time <> client_upload_time) AS different_rows FROM web_events""")
def _(t):
    return flt.column_equality(t.web_events, "server_upload_time", "client_upload_time")


@query("flt_min_group_size", """SELECT event_id, city FROM web_events WHERE city IN
  (SELECT city FROM web_events GROUP BY 1 HAVING count(*) > 130)""")
def _(t):
    return flt.min_group_size(t.web_events, "city", 130).select("event_id", "city")


# Projections.


@query("prj_drop_columns", "SELECT event_id, event_type, user_id, session_id FROM web_events")
def _(t):
    rest = [c for c in t.web_events.columns if c not in ("event_id", "event_type", "user_id", "session_id")]
    return prj.drop_columns(t.web_events, [*rest, "missing"])


@query("prj_drop_report", """
  SELECT s.step, s.name, s.l AS columns_left, s.d AS columns_dropped, count(*) AS rows
  FROM web_events, (VALUES (1, 'constants', 17, 3), (2, 'payload', 16, 4)) s(step, name, l, d) GROUP BY 1, 2, 3, 4""")
def _(t):
    return prj.drop_report(t.web_events, {"constants": ["platform", "library", "app"], "payload": ["event_properties"]})


@query("prj_drop_constant_columns", "SELECT event_id, device_family, language FROM web_events")
def _(t):
    e = t.web_events.select("event_id", "device_family", "language", "platform", "library", "app")
    return prj.drop_constant_columns(e)


@query("prj_constant_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name FROM web_events HAVING count(DISTINCT {c}) = 1" for c in EVENT_COLS))
def _(t):
    return prj.constant_columns(t.web_events.select(*EVENT_COLS))


@query("prj_time_features", """
  SELECT event_id, CAST(hour(event_time) AS INTEGER) AS hour, CAST(day(event_time) AS INTEGER) AS day,
    CAST(isodow(event_time) - 1 AS INTEGER) AS weekday, CAST(month(event_time) AS INTEGER) AS month,
    CAST(year(event_time) AS INTEGER) AS year, dayname(event_time) AS day_of_week, CAST(CAST(event_time AS DATE) AS VARCHAR) AS event_date,
    strftime(event_time, '%Y-%m') AS year_month FROM web_events""")
def _(t):
    cols = ["event_id", "hour", "day", "weekday", "month", "year", "day_of_week", "event_date", "year_month"]
    return prj.time_features(t.web_events).select(*cols)


@query("prj_date_parts", """
  SELECT id, CAST(year(date) AS INTEGER) AS date_year, CAST(month(date) AS INTEGER) AS date_month,
    CAST(quarter(date) AS INTEGER) AS date_quarter FROM deals""")
def _(t):
    return prj.date_parts(t.deals, ["date"]).select("id", "date_year", "date_month", "date_quarter")


@query("prj_latency", """
  SELECT event_id, (epoch_us(processed_time) - epoch_us(client_upload_time)) / 1e6 AS server_latency,
    (epoch_us(processed_time) - epoch_us(server_upload_time)) / 1e6 AS processing_latency FROM web_events""", r6="server_latency processing_latency")
def _(t):
    return prj.latencies(t.web_events).select("event_id", "server_latency", "processing_latency")


@query("prj_company_age", "SELECT id, age FROM companies", r6="age")
def _(t):
    return prj.company_age(t.companies, as_of=AS_OF).select("id", "age")


@query("prj_company_age_at_deal", "SELECT id, (date - date_founded) / 365.25::DOUBLE AS age FROM deal_company", r6="age")
def _(t):
    from dealflux.operators.joins import deals_with_companies

    return prj.company_age(deals_with_companies(t.deals, t.companies), as_of=F.col("date")).select("id", "age")


STAGE_SQL = """CASE WHEN round_type IN ('Pre-Seed', 'Seed') THEN '{0}' WHEN round_type IN ('Series A', 'Series B') THEN '{1}'
  WHEN round_type IN ('Series C', 'Series D', 'Series E', 'Series F', 'Series G') THEN '{2}' END"""


@query("prj_stage_map", f"""SELECT id, {STAGE_SQL.format('Seed', 'Early', 'Late')} AS stage,
  {STAGE_SQL.format('Seeds', 'Early', 'Late')} AS stage_plural, {STAGE_SQL.format('Seed', 'Early Stage', 'Later Stage')} AS stage_long,
  {STAGE_SQL.format('Seed', 'Early Stage', 'Later Stage')} AS stage_growth FROM deals""")
def _(t):
    d = prj.stage(t.deals)
    d = prj.stage(d, V.STAGES_PLURAL, out="stage_plural")
    d = prj.stage(d, V.STAGES_LONG, out="stage_long")
    return prj.stage(d, V.STAGES_GROWTH, out="stage_growth").select("id", "stage", "stage_plural", "stage_long", "stage_growth")


@query("prj_region_map", """SELECT id, CASE WHEN country IN ('Canada', 'USA') THEN country ELSE 'Other International' END AS region
  FROM investors""")
def _(t):
    return prj.home_region(t.investors, col="country").select("id", "region")


BINS = """CASE WHEN amount <= 0 THEN NULL WHEN amount <= 1e5 THEN '<100K' WHEN amount <= 5e5 THEN '100K-500K' WHEN amount <= 1e6 THEN '500K-1M'
  WHEN amount <= 5e6 THEN '1M-5M' WHEN amount <= 1e7 THEN '5M-10M' WHEN amount <= 5e7 THEN '10M-50M' WHEN amount <= 1e8 THEN '50M-100M'
  WHEN amount > 1e8 THEN '100M+' END"""
SIZE_CLASS = """CASE WHEN amount IS NULL THEN NULL WHEN amount <= 5e6 THEN '$0-5M' WHEN amount <= 15e6 THEN '$5-15M' WHEN amount <= 40e6 THEN '$15-40M'
  WHEN amount <= 100e6 THEN '$40-100M' WHEN amount <= 250e6 THEN '$100-250M' ELSE '$250M+' END"""
AGE_BIN = """CASE WHEN age <= 0 THEN NULL WHEN age > 10 THEN '10+' WHEN age > 0 THEN (CAST(ceil(age) AS INTEGER) - 1) || '-' || CAST(ceil(age) AS INTEGER) END"""


@query("prj_binning", f"SELECT id, {BINS} AS deal_size, {SIZE_CLASS} AS size_class FROM deals")
def _(t):
    return prj.deal_size_millions(prj.deal_size(t.deals)).select("id", "deal_size", "size_class")


@query("prj_binning_age", f"SELECT id, {AGE_BIN} AS age_band FROM companies")
def _(t):
    return prj.age_band(t.companies_aged).select("id", "age_band")


@query("prj_binning_daytime", """SELECT event_id, CASE WHEN hour(event_time) = 0 THEN 'nan' WHEN hour(event_time) <= 6 THEN 'night'
  WHEN hour(event_time) <= 12 THEN 'morning' WHEN hour(event_time) <= 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day FROM web_events""")
def _(t):
    return t.web_events.select("event_id", prj.daytime(F.hour("event_time")).alias("time_of_day"))


FUNDING = """WITH f AS (SELECT c.id AS company_id, coalesce(sum(amount), 0) AS total_funding FROM companies c
  LEFT JOIN deals d ON c.id = d.company_id GROUP BY 1)"""


@query("prj_success_flag", FUNDING + """ SELECT company_id,
  CASE WHEN total_funding > (SELECT max(total_funding) FROM f) THEN 1 ELSE 0 END AS over_max,
  CASE WHEN total_funding > (SELECT median(total_funding) FROM f) THEN 1 ELSE 0 END AS over_median FROM f""")
def _(t):
    from dealflux.operators.features import company_funding

    f = company_funding(t.companies, t.deals)
    f = prj.success_flag(f, threshold="max", out="over_max")
    return prj.success_flag(f, threshold="median", out="over_median").select("company_id", "over_max", "over_median")


@query("prj_funding_label_unit", """
  SELECT id, amount / 1e6 AS millions,
    CASE WHEN amount >= 1e9 THEN '$' || printf('%.1f', amount / 1e9) || 'B' ELSE '$' || printf('%.1f', amount / 1e6) || 'M' END AS money,
    CASE WHEN amount >= 1e9 THEN printf('%.1f', amount / 1e9) || 'B' WHEN amount >= 1e6 THEN printf('%.1f', amount / 1e6) || 'M'
      WHEN amount >= 1e3 THEN printf('%.0f', amount / 1e3) || 'k' ELSE printf('%.0f', amount) END AS compact
  FROM (SELECT id, floor(amount / 1000) * 1000 + 1 AS amount FROM deals WHERE amount IS NOT NULL)""", r6="millions")
def _(t):
    d = t.deals.where("amount is not null").select("id", (F.floor(F.col("amount") / 1000) * 1000 + 1).cast("double").alias("amount"))
    return d.select("id", (F.col("amount") / 1e6).alias("millions"), C.money_text("amount").alias("money"), C.compact_number("amount").alias("compact"))


# Cleaning.


@query("set_dedup_rows", """SELECT user_id, event_type, CAST(CAST(event_time AS DATE) AS VARCHAR) AS d FROM web_events GROUP BY ALL""")
def _(t):
    return L.dedup(t.web_events.select("user_id", "event_type", F.to_date("event_time").alias("d")))


@query("set_distinct_values", "SELECT DISTINCT event_type FROM web_events")
def _(t):
    return t.web_events.select("event_type").distinct()


@query("jn_map_lookup_fill", """
  WITH m AS (SELECT city, region FROM web_events WHERE city IS NOT NULL AND region IS NOT NULL GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY city ORDER BY count(*) DESC, region) = 1),
  g AS (SELECT region FROM web_events WHERE region IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, region LIMIT 1)
  SELECT event_id, coalesce(e.region, m.region, (SELECT region FROM g)) AS region FROM web_events e LEFT JOIN m ON e.city = m.city""")
def _(t):
    return L.fill_region_by_city(t.web_events).select("event_id", "region")


@query("evt_location_impute", """
  WITH m AS (SELECT country, region, city FROM web_events WHERE city IS NOT NULL AND region IS NOT NULL GROUP BY 1, 2, 3
    QUALIFY row_number() OVER (PARTITION BY country, region ORDER BY count(*) DESC, city) = 1)
  SELECT event_id, coalesce(e.city, m.city, 'Unknown') AS city, coalesce(e.city, 'Unknown') AS parity_city
  FROM web_events e LEFT JOIN m ON e.country = m.country AND e.region = m.region""")
def _(t):
    e = t.web_events.withColumn("parity_city", F.coalesce("city", F.lit(V.UNKNOWN)))
    return L.impute_city(e).select("event_id", "city", "parity_city")


ZS = """WITH r AS (SELECT event_id, seconds FROM web_events e JOIN sessions s ON e.session_id = s.session_id),
  z AS (SELECT event_id, (seconds - avg(seconds) OVER ()) / stddev_samp(seconds) OVER () AS zscore FROM r)"""


@query("win_zscore", ZS + " SELECT event_id, zscore FROM z WHERE abs(zscore) < 3", r6="zscore")
def _(t):
    z = L.with_zscore(S.with_duration(t.web_events), "session_duration")
    return z.where(F.abs("zscore") < 3).select("event_id", "zscore")


CLEAN_OPTIONS = dict(
    cutoff="2024-01-10",
    drop=("event_properties", "client_event_time", "server_received_time"),
    constants=("platform", "library", "app"),
)
CLEAN_SQL = """
  WITH c AS (SELECT *, coalesce(region, 'Unknown') AS region2, coalesce(city, 'Unknown') AS city2 FROM web_events
    WHERE event_time >= TIMESTAMP '2024-01-10'),
  d AS (SELECT * FROM c WHERE device_family NOT IN ('iOS', 'Android')),
  k AS (SELECT * FROM d WHERE user_id IS NOT NULL),
  s AS (SELECT *, (epoch_us(max(event_time) OVER (PARTITION BY session_id)) - epoch_us(min(event_time) OVER (PARTITION BY session_id))) / 1e6
    AS session_duration FROM k),
  z AS (SELECT * FROM (SELECT *, (session_duration - avg(session_duration) OVER ()) / stddev_samp(session_duration) OVER () AS zz FROM s) WHERE abs(zz) < 3)"""


@query("evt_clean_pipeline", CLEAN_SQL + """
  SELECT event_id, session_id, event_type, region2 AS region, city2 AS city, session_duration, dayname(event_time) AS day_of_week,
    (epoch_us(processed_time) - epoch_us(client_upload_time)) / 1e6 AS server_latency FROM z""", r4="session_duration", r6="server_latency")
def _(t):
    return L.clean(t.web_events, **CLEAN_OPTIONS).select(
        "event_id", "session_id", "event_type", "region", "city", "session_duration", "day_of_week", "server_latency")


@query("evt_clean_pipeline_report", CLEAN_SQL + """
  SELECT 1 AS step, 'constant_columns' AS name, count(*) AS rows, 17 AS columns FROM web_events
  UNION ALL SELECT 2, 'cutoff', count(*), 17 FROM c UNION ALL SELECT 3, 'drop_columns', count(*), 14 FROM c
  UNION ALL SELECT 4, 'fill_location', count(*), 14 FROM c UNION ALL SELECT 5, 'exclude_devices', count(*), 14 FROM d
  UNION ALL SELECT 6, 'known_users', count(*), 14 FROM k UNION ALL SELECT 7, 'duration', count(*), 15 FROM s
  UNION ALL SELECT 8, 'zscore', count(*), 15 FROM z UNION ALL SELECT 9, 'features', count(*), 24 FROM z""")
def _(t):
    return L.clean_report(t.web_events, **CLEAN_OPTIONS)
