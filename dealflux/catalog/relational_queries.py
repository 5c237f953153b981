"""Joins, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealflux.catalog.registry import query
from dealflux.functions import columns as C
from dealflux.functions import vocab as V
from dealflux.operators import filters as flt
from dealflux.operators import joins as J
from dealflux.operators import series as R
from dealflux.operators.features import company_funding
from dealflux.plans import kernels as K

# Joins.


@query("jn_deals_companies_inner", "SELECT id, company_id, company_name, primary_tag, ecosystem_name FROM deal_company")
def _(t):
    return J.deals_with_companies(t.deals, t.companies).select("id", "company_id", "company_name", "primary_tag", "ecosystem_name")


@query("jn_deals_companies_left", """
  SELECT d.id, d.company_id, c.company_name FROM deals d LEFT JOIN (SELECT * FROM companies WHERE id % 3 <> 0) c ON d.company_id = c.id""")
def _(t):
    known = t.companies.where(F.col("id") % 3 != 0)
    return J.deals_with_companies(t.deals, known, "left").select("id", "company_id", "company_name")


FUNDING = """SELECT c.id AS company_id, coalesce(sum(amount), 0) AS total_funding, count(amount) AS deal_count,
  coalesce(sum(amount::DECIMAL(28,6))::DOUBLE / nullif(count(amount), 0), 0) AS avg_deal_size FROM companies c LEFT JOIN deals d ON c.id = d.company_id GROUP BY 1"""


@query("jn_companies_funding_left", FUNDING, r3="total_funding avg_deal_size")
def _(t):
    return company_funding(t.companies, t.deals).select("company_id", "total_funding", "deal_count", "avg_deal_size")


@query("jn_investor_deals_inner", """SELECT deal_id, investor_id, country, investor_type, lead_investor_flag
  FROM deal_investor x JOIN investors i ON x.investor_id = i.id""")
def _(t):
    return J.investments_with_investors(t.deal_investor, t.investors).select(
        "deal_id", "investor_id", "country", "investor_type", "lead_investor_flag")


@query("jn_investor_deals_left", """SELECT deal_id, investor_id, amount, CAST(date AS VARCHAR) AS date
  FROM deal_investor x LEFT JOIN (SELECT * FROM deals WHERE year < 2001) d ON x.deal_id = d.id""", r3="amount")
def _(t):
    return J.investments_with_deals(t.deal_investor, flt.before_year(t.deals, 2001)).select("deal_id", "investor_id", "amount", "date")


@query("jn_three_way", """SELECT deal_id, investor_id, primary_tag, ecosystem_name, amount
  FROM deal_investor x JOIN deal_company d ON x.deal_id = d.id""", r3="amount")
def _(t):
    return J.investments_with_companies(t.deal_investor, t.deals, t.companies).select(
        "deal_id", "investor_id", "primary_tag", "ecosystem_name", "amount")


@query("jn_company_geo_left", """SELECT c.id, c.ecosystem_name, city, province FROM companies c
  LEFT JOIN ecosystems e ON c.ecosystem_name = e.ecosystem_name""")
def _(t):
    return J.companies_with_geography(t.companies, t.ecosystems).select("id", "ecosystem_name", "city", "province")


SECTORS = """
  WITH p AS (SELECT primary_tag AS sector, count(*) AS n FROM companies GROUP BY 1),
  s AS (SELECT secondary_tag AS sector, count(*) AS n FROM companies WHERE secondary_tag IS NOT NULL GROUP BY 1)
  SELECT coalesce(p.sector, s.sector) AS sector, coalesce(p.n, 0) AS primary_count, coalesce(s.n, 0) AS secondary_count
  FROM p FULL JOIN s ON p.sector = s.sector"""


@query("jn_full_outer_counts", SECTORS)
def _(t):
    return J.sector_counts(t.companies)


@query("jn_cross_scalar", f"""WITH f AS ({FUNDING}) SELECT company_id, total_funding, (SELECT max(total_funding) FROM f) AS median_funding,
  CASE WHEN total_funding > (SELECT max(total_funding) FROM f) THEN 1 ELSE 0 END AS is_successful FROM f""", r3="total_funding median_funding")
def _(t):
    f = company_funding(t.companies, t.deals)
    top = K.scalar(f, F.max("total_funding"))
    return f.select("company_id", "total_funding", top.alias("median_funding"), F.when(F.col("total_funding") > top, 1).otherwise(0).alias("is_successful"))


MONTHS = "SELECT date_trunc('month', date) AS m, sum(coalesce(amount, 0)) AS amount FROM deals GROUP BY 1"


@query("jn_exists_theta", f"""WITH mo AS ({MONTHS}) SELECT CAST(CAST(m AS DATE) AS VARCHAR) AS month, amount FROM mo
  WHERE EXISTS (SELECT 1 FROM mo b WHERE b.m >= mo.m + INTERVAL 1 MONTH)""", r3="amount")
def _(t):
    monthly = R.bucketed(t.deals, "date", "amount", fill=False).select(F.col("bucket").alias("month"), F.col("value").alias("amount"))
    return J.with_later_month(monthly).withColumn("month", F.to_date("month"))


@query("jn_semi_topk", """SELECT id, primary_tag FROM deal_company WHERE primary_tag IN
  (SELECT primary_tag FROM deal_company GROUP BY 1 ORDER BY sum(amount) DESC, primary_tag LIMIT 5)""")
def _(t):
    d = J.deals_with_companies(t.deals, t.companies)
    return K.keep_keys(d, K.top_keys(d, "primary_tag", C.total("amount"), 5)).select("id", "primary_tag")


@query("jn_anti_sessions", """SELECT event_id, session_id FROM web_events WHERE session_id NOT IN
  (SELECT session_id FROM sessions WHERE events <= 2)""")
def _(t):
    ids = flt.sessions_where(t.web_events, F.count(F.lit(1)) <= 2)
    return flt.drop_sessions(t.web_events, ids).select("event_id", "session_id")


@query("jn_group_total_back", "SELECT deal_id, investor_id, count(*) OVER (PARTITION BY deal_id) AS num_investors FROM deal_investor")
def _(t):
    return J.with_group_total(t.deal_investor, ["deal_id"], "num_investors").select("deal_id", "investor_id", "num_investors")


@query("jn_calendar_left", """
  WITH mo AS (SELECT primary_tag, date_trunc('month', date) AS m, sum(coalesce(amount, 0)) AS v, count(*) AS n FROM deal_company
      WHERE amount > 1e6 GROUP BY 1, 2),
  cal AS (SELECT primary_tag, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM mo GROUP BY 1)
  SELECT primary_tag, CAST(CAST(m AS DATE) AS VARCHAR) AS bucket, coalesce(v, 0) AS value, coalesce(n, 0) AS n
  FROM cal LEFT JOIN mo USING (primary_tag, m)""", r3="value")
def _(t):
    d = J.deals_with_companies(t.deals, t.companies).where(F.col("amount") > 1e6)
    return R.bucketed(d, "date", "amount", keys=["primary_tag"]).withColumn("bucket", F.to_date("bucket"))


# Sorts, limits, top-k, sampling.


@query("srt_topk", "SELECT id, amount FROM deals WHERE amount IS NOT NULL ORDER BY amount DESC, id LIMIT 20", r3="amount")
def _(t):
    return K.top_k(t.deals.where("amount is not null"), 20, F.desc("amount"), F.asc("id")).select("id", "amount")


@query("srt_bottomk", "SELECT id, amount FROM deals WHERE amount IS NOT NULL ORDER BY amount, id LIMIT 20", r3="amount")
def _(t):
    return K.top_k(t.deals.where("amount is not null"), 20, F.asc("amount"), F.asc("id")).select("id", "amount")


@query("srt_multi_key", "SELECT company_id, id, round_type FROM deals ORDER BY company_id, date, id")
def _(t):
    return t.deals.orderBy("company_id", "date", "id").select("company_id", "id", "round_type")


ROUNDS = ", ".join(f"({i + 1}, '{r}')" for i, r in enumerate(V.ROUND_ORDER))


@query("srt_custom_order", f"""SELECT CAST(o AS INTEGER) AS place, r AS round_type, count(d.id) AS n FROM (VALUES {ROUNDS}) v(o, r)
  LEFT JOIN (SELECT * FROM deals WHERE amount > 6e8) d ON d.round_type = r GROUP BY 1, 2 ORDER BY 1""")
def _(t):
    counts = K.aggregate_by(t.deals.where(F.col("amount") > 6e8), ["round_type"], n=F.count(F.lit(1)))
    order = [F.struct(F.lit(i + 1).alias("place"), F.lit(r).alias("round_type")) for i, r in enumerate(V.ROUND_ORDER)]
    dim = t.deals.limit(1).select(F.explode(F.array(*order)).alias("_o")).select("_o.*")
    return dim.join(counts, "round_type", "left").fillna({"n": 0}).orderBy("place")


@query("srt_argmax", """
  SELECT ecosystem_name, arg_max(primary_tag, n) AS top_sector FROM (
    SELECT ecosystem_name, primary_tag, count(*) * 1000 - row_number() OVER (PARTITION BY ecosystem_name ORDER BY primary_tag) AS n
    FROM companies GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    counts = K.aggregate_by(t.companies, ["ecosystem_name", "primary_tag"], n=F.count(F.lit(1)))
    best = F.min(F.struct(-F.col("n"), "primary_tag")).getField("primary_tag")
    return counts.groupBy("ecosystem_name").agg(best.alias("top_sector"))


@query("srt_distinct_sample_sessions", """
  SELECT event_id, session_id FROM web_events WHERE session_id IN (
    SELECT session_id FROM sessions ORDER BY md5('42#' || session_id), session_id LIMIT 500)""")
def _(t):
    ids = t.web_events.select("session_id").distinct()
    picked = K.top_k(ids, 500, F.md5(F.concat(F.lit("42#"), F.col("session_id"))), F.col("session_id"))
    return K.keep_keys(t.web_events, picked).select("event_id", "session_id")


@query("srt_row_sample", """SELECT id, amount FROM deals ORDER BY md5('42#' || id), id LIMIT 1000""", r3="amount")
def _(t):
    return K.top_k(t.deals, 1000, F.md5(F.concat(F.lit("42#"), F.col("id").cast("string"))), F.col("id")).select("id", "amount")


@query("srt_row_sample_fraction", """SELECT id, amount FROM deals
  WHERE ('0x' || substr(md5('42#' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1::DOUBLE""", r3="amount")
def _(t):
    return t.deals.where(K.hash_share(F.col("id")) < 0.1).select("id", "amount")


# Sets.


@query("set_union_chunks", """
  SELECT id, amount, NULL::VARCHAR AS round_type FROM deals WHERE year < 1998
  UNION ALL SELECT id, NULL, round_type FROM deals WHERE year >= 1998""", r3="amount")
def _(t):
    early = t.deals.where("year < 1998").select("id", "amount")
    late = t.deals.where("year >= 1998").select("round_type", "id")
    return early.unionByName(late, allowMissingColumns=True)


# Scalar functions.


@query("scl_string", """
  SELECT c_custkey, starts_with(c_mktsegment, 'B') AS is_b, regexp_extract(c_name, '([0-9]+)$', 1) AS digits,
    concat_ws('|', c_name, c_mktsegment) AS joined, split_part(c_name, '#', 2) AS part, replace(replace(c_name, 'Customer', 'C'), '#', '') AS short,
    CAST(rtrim('12.5%', '%') AS DOUBLE) AS pct, lower(c_mktsegment) AS low, substr(c_name, 1, 3) AS head,
    upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS title, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded
  FROM customer""".replace("starts_with(c_mktsegment, 'B') AS is_b", "CAST(starts_with(c_mktsegment, 'B') AS INTEGER) AS is_b"))
def _(t):
    return t.base("customer").select(
        "c_custkey", F.col("c_mktsegment").startswith("B").alias("is_b"), F.regexp_extract("c_name", "([0-9]+)$", 1).alias("digits"),
        F.concat_ws("|", "c_name", "c_mktsegment").alias("joined"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("part"),
        F.replace(F.replace("c_name", F.lit("Customer"), F.lit("C")), F.lit("#"), F.lit("")).alias("short"),
        F.rtrim(F.lit("12.5%"), F.lit("%")).cast("double").alias("pct"), F.lower("c_mktsegment").alias("low"),
        F.substring("c_name", 1, 3).alias("head"), F.initcap(F.lower("c_mktsegment")).alias("title"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"),
    )


@query("scl_format", """
  SELECT c_custkey, format('{:,}', c_custkey * 1000) AS thousands, printf('%.1f%%', c_custkey % 7 * 1.0) AS pct,
    printf('$%.2f', c_custkey % 100 * 1.0) AS cash FROM customer""")
def _(t):
    k = F.col("c_custkey")
    return t.base("customer").select(
        k, F.format_number(k * 1000, 0).alias("thousands"), F.format_string("%.1f%%", (k % 7).cast("double")).alias("pct"),
        F.format_string("$%.2f", (k % 100).cast("double")).alias("cash"))


@query("scl_date", """
  SELECT id, CAST(month(date) AS INTEGER) AS m, CAST(quarter(date) AS INTEGER) AS q, CAST(isodow(date) - 1 AS INTEGER) AS wd,
    dayname(date) AS day_name, strftime(date, '%Y-%m') AS ym, CAST(CAST(date_trunc('quarter', date) AS DATE) AS VARCHAR) AS quarter_start,
    CAST(date - DATE '1995-01-01' AS INTEGER) AS days, CAST(last_day(date) AS VARCHAR) AS month_end,
    CAST(CAST(date + INTERVAL 2 MONTH AS DATE) AS VARCHAR) AS later, CAST(TRY_CAST(CASE WHEN id % 2 = 0 THEN '2001-02-03' ELSE 'bad' END AS DATE) AS VARCHAR) AS parsed,
    CAST(len(generate_series(date_trunc('month', date), TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS INTEGER) AS months_left,
    CAST(year(date) AS VARCHAR) || 'Q' || quarter(date) AS quarter_text FROM deals""")
def _(t):
    d = F.col("date")
    return t.deals.select(
        "id", F.month(d).alias("m"), F.quarter(d).alias("q"), F.weekday(d).alias("wd"), F.date_format(d, "EEEE").alias("day_name"),
        C.month_label(d).alias("ym"), F.to_date(F.date_trunc("quarter", d)).alias("quarter_start"),
        F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"), F.last_day(d).alias("month_end"), F.add_months(d, 2).alias("later"),
        F.to_date(F.try_to_timestamp(F.when(F.col("id") % 2 == 0, "2001-02-03").otherwise("bad"), F.lit("yyyy-MM-dd"))).alias("parsed"),
        F.size(F.sequence(F.trunc(d, "month"), F.lit("2001-12-01").cast("date"), F.expr("interval 1 month"))).alias("months_left"),
        C.quarter_label(d).alias("quarter_text"),
    )


@query("scl_math", """
  SELECT s_suppkey, abs(s_acctbal) AS a, sqrt(abs(s_acctbal)) AS s, round_even(s_acctbal, 1) AS r, least(greatest(s_acctbal, 0), 5000) AS clip,
    log10(abs(s_acctbal) + 1) AS l, s_acctbal / nullif(s_suppkey % 3, 0) AS ratio FROM supplier""", r6="a s clip l ratio", r1="r")
def _(t):
    b = F.col("s_acctbal")
    return t.base("supplier").select(
        "s_suppkey", F.abs(b).alias("a"), F.sqrt(F.abs(b)).alias("s"), F.bround(b, 1).alias("r"),
        F.least(F.greatest(b, F.lit(0.0)), F.lit(5000.0)).alias("clip"), F.log10(F.abs(b) + 1).alias("l"),
        C.ratio(b, F.col("s_suppkey") % 3).alias("ratio"))


@query("scl_conditional", """
  SELECT id, CASE WHEN amount > 1e7 THEN 'large' WHEN amount > 1e6 THEN 'medium' ELSE 'small' END AS size, coalesce(round_type, 'none') AS round,
    CASE WHEN id % 5 = 0 THEN NULL ELSE id::DOUBLE END AS finite FROM deals""")
def _(t):
    k = F.col("id").cast("double")
    raw = F.when(F.col("id") % 5 == 0, F.lit(float("inf"))).otherwise(k)
    return t.deals.select(
        "id", F.when(F.col("amount") > 1e7, "large").when(F.col("amount") > 1e6, "medium").otherwise("small").alias("size"),
        F.coalesce("round_type", F.lit("none")).alias("round"), F.when(raw != float("inf"), raw).alias("finite"))


@query("scl_cast", """
  SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'x' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS DOUBLE) AS num,
    CAST(o_orderkey AS VARCHAR) AS txt FROM orders""")
def _(t):
    k = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), k)).otherwise(k)
    return t.base("orders").select("o_orderkey", text.try_cast("double").alias("num"), k.alias("txt"))


@query("scl_array", """
  WITH r AS (SELECT r_name, list(n_name ORDER BY n_name) AS a FROM places GROUP BY 1)
  SELECT r_name, CAST(len(a) AS INTEGER) AS size, a[1] AS head, a[-1] AS tail, array_to_string(a, ',') AS joined, array_to_string(a[2:3], '>') AS piece,
    CAST(list_contains(a, 'NATION_3') AS INTEGER) AS has_3, CAST(len(list_distinct(list_concat(a, a))) AS INTEGER) AS n_distinct,
    array_to_string(list_concat(list_transform(range(7 - len(a)), lambda x: '-'), a), ' ') AS padded FROM r""")
def _(t):
    a = F.sort_array("a")
    lists = t.places.groupBy("r_name").agg(F.collect_list("n_name").alias("a")).withColumn("a", a)
    return lists.select(
        "r_name", F.size("a").alias("size"), F.element_at("a", 1).alias("head"), F.element_at("a", -1).alias("tail"),
        F.array_join("a", ",").alias("joined"), F.array_join(F.slice("a", 2, 2), ">").alias("piece"),
        F.array_contains("a", "NATION_3").alias("has_3"), F.size(F.array_distinct(F.concat("a", "a"))).alias("n_distinct"),
        F.array_join(F.concat(F.array_repeat(F.lit("-"), F.lit(7) - F.size("a")), F.col("a")), " ").alias("padded"))


@query("scl_json", """
  SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.k') AS k_text,
    array_to_string(json_keys(props), ',') AS structure FROM events""")
def _(t):
    e = t.base("events")
    return e.select(
        "event_id", F.from_json("props", "k int").getField("k").alias("k"), F.get_json_object("props", "$.k").alias("k_text"),
        F.array_join(F.json_object_keys("props"), ",").alias("structure"))


@query("scl_map", """
  SELECT id, CASE country WHEN 'Canada' THEN 'CA' WHEN 'USA' THEN 'US' END AS code, nullif((SELECT count(*) FROM investors j WHERE j.country = i.country), 0) AS same
  FROM investors i""")
def _(t):
    # Listed values by a literal map, an open dictionary by its key.
    counts = K.present(t.investors, "country").groupBy("country").agg(F.count(F.lit(1)).alias("same"))
    return t.investors.join(counts, "country", "left").select(
        "id", C.lookup("country", {"Canada": "CA", "USA": "US"}).alias("code"), "same")


# Lambdas of the source system, as native expressions and grouped functions.


@query("udf_group_agg", """
  WITH c AS (SELECT ecosystem_name, primary_tag, count(*) AS n FROM companies GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY ecosystem_name ORDER BY n DESC, primary_tag) AS rn FROM c),
  a AS (SELECT ecosystem_name, max(age) - min(age) AS age_range FROM companies GROUP BY 1)
  SELECT ecosystem_name, age_range, max(CASE WHEN rn = 1 THEN primary_tag END) AS mode_sector,
    string_agg(primary_tag, ',' ORDER BY rn) FILTER (rn <= 3) AS top_sectors, string_agg(primary_tag, ',' ORDER BY primary_tag) AS sectors
  FROM r JOIN a USING (ecosystem_name) GROUP BY 1, 2""", r6="age_range")
def _(t):
    ranges = t.companies_aged.groupBy("ecosystem_name").agg((F.max("age") - F.min("age")).alias("age_range"))
    counts = K.aggregate_by(t.companies, ["ecosystem_name", "primary_tag"], n=F.count(F.lit(1)))
    ranked = F.sort_array(F.collect_list(F.struct(-F.col("n"), "primary_tag")))
    lists = counts.groupBy("ecosystem_name").agg(ranked.getField("primary_tag").alias("_r"))
    return lists.join(ranges, "ecosystem_name").select(
        "ecosystem_name", "age_range", F.get("_r", 0).alias("mode_sector"), F.array_join(F.slice("_r", 1, 3), ",").alias("top_sectors"),
        F.array_join(F.array_sort("_r"), ",").alias("sectors"))


@query("udf_group_apply", """
  SELECT event_id, user_id, event_type || ' -> ' || coalesce(lead(event_type) OVER (PARTITION BY user_id ORDER BY event_time, event_id), 'nan') AS pair
  FROM web_events WHERE user_id IS NOT NULL""")
def _(t):
    from dealflux.plans.ordered import following

    wide = following(t.web_events, ["user_id"], ["event_time", "event_id"], ["event_type"])
    pair = F.concat_ws(" -> ", "event_type", F.coalesce("next_event_type", F.lit("nan")))
    return wide.select("event_id", "user_id", pair.alias("pair"))


@query("udf_row_map", """
  SELECT id, CASE WHEN country IN ('Canada', 'USA') THEN country ELSE 'Other International' END || ' / ' || investor_type AS label FROM investors""")
def _(t):
    region = C.lookup("country", V.HOME_REGIONS, V.REGION_OTHER)
    return t.investors.select("id", F.concat_ws(" / ", region, "investor_type").alias("label"))
