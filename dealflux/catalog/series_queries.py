"""Windows over aggregated series and company feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealflux.catalog.registry import query
from dealflux.operators import activity as A
from dealflux.operators import features as X
from dealflux.operators import joins as J
from dealflux.operators import series as R
from dealflux.plans import kernels as K

MONTHLY = """mo AS (SELECT primary_tag, date_trunc('month', date) AS m, sum(coalesce(amount, 0)) AS v FROM deal_company GROUP BY 1, 2),
  cal AS (SELECT primary_tag, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM mo GROUP BY 1),
  ser AS (SELECT primary_tag, CAST(CAST(m AS DATE) AS VARCHAR) AS bucket, coalesce(v, 0) / 1e6 AS value FROM cal LEFT JOIN mo USING (primary_tag, m))"""


def sector_series(t):
    """Monthly funding in millions per sector."""
    d = J.deals_with_companies(t.deals, t.companies)
    s = R.bucketed(d, "date", "amount", keys=["primary_tag"])
    return s.select("primary_tag", F.to_date("bucket").alias("bucket"), (F.col("value") / 1e6).alias("value"))


W = "(PARTITION BY primary_tag ORDER BY bucket)"


@query("win_lags", f"""WITH {MONTHLY} SELECT primary_tag, bucket, value, lag(value, 1) OVER w AS lag_1, lag(value, 3) OVER w AS lag_3,
  lag(value, 6) OVER w AS lag_6, lag(value, 12) OVER w AS lag_12 FROM ser WINDOW w AS {W}""", r4="value lag_1 lag_3 lag_6 lag_12")
def _(t):
    return R.lags(sector_series(t), ["primary_tag"])


def mean_sql(n):
    return (f"CASE WHEN row_number() OVER w >= {n} THEN avg(value) OVER (PARTITION BY primary_tag ORDER BY bucket "
            f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS mean_{n}")


@query("win_rolling_mean", f"""WITH {MONTHLY} SELECT primary_tag, bucket, value, {mean_sql(3)}, {mean_sql(6)}, {mean_sql(12)}
  FROM ser WINDOW w AS {W}""", r4="value mean_3 mean_6 mean_12")
def _(t):
    return R.rolling_means(sector_series(t), ["primary_tag"])


@query("win_yoy_12", f"""WITH {MONTHLY} SELECT * FROM (SELECT primary_tag, bucket, value, lag(value, 1) OVER w AS lag_1, lag(value, 3) OVER w AS lag_3,
  lag(value, 6) OVER w AS lag_6, lag(value, 12) OVER w AS lag_12, {mean_sql(3)}, {mean_sql(6)}, {mean_sql(12)},
  (value - lag(value, 12) OVER w) / nullif(lag(value, 12) OVER w, 0) AS change_12 FROM ser WINDOW w AS {W}) WHERE change_12 IS NOT NULL""",
       r4="value lag_1 lag_3 lag_6 lag_12 mean_3 mean_6 mean_12 change_12")
def _(t):
    return R.feature_table(sector_series(t), ["primary_tag"])


@query("win_pct_change", """
  WITH y AS (SELECT year, sum(coalesce(amount, 0)) AS amount FROM deals GROUP BY 1)
  SELECT year, (amount - lag(amount) OVER (ORDER BY year)) / lag(amount) OVER (ORDER BY year) * 100 AS change FROM y""", r4="change")
def _(t):
    from dealflux.functions.columns import total

    y = K.aggregate_by(t.deals, ["year"], amount=total("amount"))
    return K.growth(y, [], "year", "amount", "change").select("year", "change")


@query("win_share_of_total", """
  SELECT ecosystem_name, primary_tag, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY ecosystem_name) AS group_share,
    100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS total_share FROM companies GROUP BY 1, 2""", r6="group_share total_share")
def _(t):
    c = K.aggregate_by(t.companies, ["ecosystem_name", "primary_tag"], n=F.count(F.lit(1)))
    return K.share_of(K.share_of(c, "n", ["ecosystem_name"], "group_share"), "n", (), "total_share")


@query("win_diff_mean", """
  WITH y AS (SELECT year, avg(amount) AS v FROM deals GROUP BY 1), d AS (SELECT v - lag(v) OVER (ORDER BY year) AS x FROM y)
  SELECT avg(x) / 1e6 AS mean_step FROM d""", r4="mean_step")
def _(t):
    y = K.aggregate_by(t.deals, ["year"], v=F.avg("amount") / 1e6)
    return R.mean_step(y, "year", "v")


LIST = "list(round(value, 3)) OVER (PARTITION BY primary_tag ORDER BY bucket ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


@query("win_rolling_array", f"""
  WITH {MONTHLY}, r AS (SELECT primary_tag, bucket, {LIST} AS w, lead(value) OVER {W} AS target FROM ser)
  SELECT primary_tag, bucket, CAST(len(w) AS INTEGER) AS size, w[1] AS oldest, w[-1] AS newest, list_sum(w) AS total, target FROM r""",
       r3="oldest newest target total")
def _(t):
    s = sector_series(t).withColumn("value", F.round("value", 3))
    return R.trailing_windows(s, ["primary_tag"]).select(
        "primary_tag", "bucket", F.size("window").alias("size"), F.element_at("window", 1).alias("oldest"),
        F.element_at("window", -1).alias("newest"), F.aggregate("window", F.lit(0.0), lambda a, x: a + x).alias("total"), "target")


@query("win_sequence_windows", f"""
  WITH {MONTHLY}, r AS (SELECT primary_tag, bucket, {LIST} AS w, lead(value) OVER {W} AS target FROM ser)
  SELECT primary_tag, bucket, w[1] AS oldest, w[-1] AS newest, target FROM r WHERE len(w) = 12 AND target IS NOT NULL""", r3="oldest newest target")
def _(t):
    w = R.trailing_windows(sector_series(t), ["primary_tag"], full=True)
    return w.select("primary_tag", "bucket", F.element_at("window", 1).alias("oldest"), F.element_at("window", -1).alias("newest"), "target")


@query("win_hourly_resample_ffill", """
  WITH h AS (SELECT event_type, date_trunc('hour', ts) AS b, avg(value) AS v FROM events GROUP BY 1, 2),
  cal AS (SELECT event_type, unnest(generate_series(min(b), max(b), INTERVAL 1 HOUR)) AS b FROM h GROUP BY 1)
  SELECT event_type, CAST(b AS VARCHAR) AS bucket, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY b ROWS UNBOUNDED PRECEDING) AS value
  FROM cal LEFT JOIN h USING (event_type, b)""", r6="value")
def _(t):
    e = t.base("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.hourly_ffill(e, "ts", "value", ["event_type"])


@query("win_last_30_days", "SELECT id FROM deals WHERE date >= (SELECT max(date) FROM deals) - 30")
def _(t):
    return R.last_days(t.deals, "date").select("id")


RANKED = "dense_rank() OVER (ORDER BY ecosystem_name) - 1 AS ecosystem_id, dense_rank() OVER (ORDER BY primary_tag) - 1 AS primary_tag_id"


@query("win_dense_rank_ids", f"SELECT id AS company_id, age, {RANKED} FROM companies", r6="age")
def _(t):
    c = X.name_ids(X.name_ids(t.companies_aged, "ecosystem_name", "ecosystem_id"), "primary_tag", "primary_tag_id")
    return c.select(F.col("id").alias("company_id"), "age", "ecosystem_id", "primary_tag_id")


@query("win_factorize_ids", """
  WITH f AS (SELECT secondary_tag, min(id) AS first FROM companies WHERE secondary_tag IS NOT NULL GROUP BY 1),
  r AS (SELECT secondary_tag, row_number() OVER (ORDER BY first) - 1 AS tag_id FROM f)
  SELECT c.id, coalesce(tag_id, -1) AS tag_id FROM companies c LEFT JOIN r ON c.secondary_tag = r.secondary_tag""")
def _(t):
    return X.appearance_ids(t.companies, "secondary_tag", "id", "tag_id").select("id", "tag_id")


FUND = """fu AS (SELECT c.id AS company_id, age, ecosystem_name, primary_tag, coalesce(sum(amount), 0) AS total_funding, count(amount) AS deal_count,
  coalesce(sum(amount::DECIMAL(28,6))::DOUBLE / nullif(count(amount), 0), 0) AS avg_deal_size FROM companies c LEFT JOIN deals d ON c.id = d.company_id GROUP BY 1, 2, 3, 4)"""


@query("ml_company_features", f"WITH {FUND} SELECT company_id, age, {RANKED}, total_funding, deal_count, avg_deal_size FROM fu",
       r6="age", r3="total_funding avg_deal_size")
def _(t):
    return X.company_features(t.companies_aged, t.deals)


@query("agg_company_funding", f"WITH {FUND} SELECT company_id, total_funding, deal_count, avg_deal_size FROM fu WHERE deal_count > 0",
       r3="total_funding avg_deal_size")
def _(t):
    return X.company_funding(t.companies, t.deals).where("deal_count > 0").select("company_id", "total_funding", "deal_count", "avg_deal_size")


@query("agg_funding_threshold", f"""WITH {FUND} SELECT 'max' AS kind, max(total_funding) AS threshold FROM fu
  UNION ALL SELECT 'median', quantile_cont(total_funding, 0.5) FROM fu""", r3="threshold")
def _(t):
    f = X.company_funding(t.companies, t.deals)
    rows = [X.funding_threshold(f, threshold=k).withColumn("kind", F.lit(k)) for k in ("max", "median")]
    return rows[0].unionByName(rows[1])


@query("agg_monthly_amount", """SELECT CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS month, sum(coalesce(amount, 0)) AS monthly_amount
  FROM deals GROUP BY 1""", r3="monthly_amount")
def _(t):
    s = R.bucketed(t.deals, "date", "amount", fill=False)
    return s.select(F.to_date("bucket").alias("month"), F.col("value").alias("monthly_amount"))


@query("agg_monthly_amount_filled", """
  WITH m AS (SELECT date_trunc('month', date) AS m, sum(amount) AS v, count(*) AS n FROM deals WHERE amount > 5e8 GROUP BY 1),
  cal AS (SELECT unnest(generate_series((SELECT min(m) FROM m), (SELECT max(m) FROM m), INTERVAL 1 MONTH)) AS m)
  SELECT CAST(CAST(cal.m AS DATE) AS VARCHAR) AS month, coalesce(v, 0) AS monthly_amount, coalesce(n, 0) AS n FROM cal LEFT JOIN m ON m.m = cal.m""",
       r3="monthly_amount")
def _(t):
    s = R.bucketed(t.deals.where(F.col("amount") > 5e8), "date", "amount")
    return s.select(F.to_date("bucket").alias("month"), F.col("value").alias("monthly_amount"), "n")


@query("agg_monthly_returns", """
  WITH s AS (SELECT company_id, date_trunc('month', date) AS m, sum(coalesce(amount, 0)) AS v FROM deals
      WHERE company_id IN (SELECT company_id FROM deals WHERE amount IS NOT NULL) GROUP BY 1, 2),
  cal AS (SELECT unnest(generate_series((SELECT min(m) FROM s), (SELECT max(m) FROM s), INTERVAL 1 MONTH)) AS m),
  g AS (SELECT c.company_id, cal.m, coalesce(v, 0) AS v FROM (SELECT DISTINCT company_id FROM s) c CROSS JOIN cal
      LEFT JOIN s ON s.company_id = c.company_id AND s.m = cal.m),
  l AS (SELECT *, lag(v) OVER (PARTITION BY company_id ORDER BY m) AS p FROM g)
  SELECT company_id, CAST(CAST(m AS DATE) AS VARCHAR) AS month, v AS amount,
    CASE WHEN p IS NULL OR (p = 0 AND v = 0) THEN 0.0::DOUBLE ELSE (v - p) / nullif(p, 0) END AS change FROM l""", r3="amount", r4="change")
def _(t):
    return R.monthly_returns(t.deals).withColumn("month", F.to_date("month"))
