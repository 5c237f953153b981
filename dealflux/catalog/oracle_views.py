"""The adapter views written in DuckDB SQL, for the side-by-side checks."""

from __future__ import annotations

import re

VIEWS = {
    "places": """SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "companies": """
        SELECT c_custkey AS id, c_custkey AS company_id, c_name AS company_name,
          c_mktsegment || '-' || (c_custkey % 4) AS primary_tag,
          CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment || '-' || ((c_custkey + 1) % 4) END AS secondary_tag,
          n_name AS ecosystem_name,
          CASE WHEN c_custkey % 83 <> 0 THEN DATE '1985-01-01' + CAST((c_custkey * 37) % 3650 AS INTEGER) END AS date_founded,
          CASE WHEN c_custkey % 83 <> 0 THEN
            (DATE '2002-01-01' - (DATE '1985-01-01' + CAST((c_custkey * 37) % 3650 AS INTEGER))) / 365.25::DOUBLE END AS age
        FROM customer JOIN places ON c_nationkey = n_nationkey""",
    "ecosystems": """
        SELECT n_name AS ecosystem_name, n_name || '_CITY' AS city, r_name AS province
        FROM places WHERE n_nationkey % 11 <> 0""",
    "deals": """
        SELECT o_orderkey AS id, o_custkey AS company_id, CAST(o_orderdate AS DATE) AS date,
          CAST(year(o_orderdate) AS INTEGER) AS year,
          CASE WHEN o_orderkey % 97 <> 0 THEN
            o_totalprice * ([0.1, 1, 10, 100, 1000]::DOUBLE[])[o_orderkey % 5 + 1] END AS amount,
          CASE WHEN o_orderkey % 89 <> 0 THEN
            (['Pre-Seed','Seed','Series A','Series B','Series C','Series D','Series E','Series F','Series G',
              'Series ?','Grant'])[(o_orderkey // 5) % 11 + 1] END AS round_type
        FROM orders""",
    "last_rounds": """
        SELECT company_id, round_type AS latest_round_type, date AS latest_round_date FROM (
          SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY date DESC, id DESC) AS rn FROM deals)
        WHERE rn = 1""",
    "companies_rounds": """
        SELECT c.*, latest_round_type, latest_round_date FROM companies c LEFT JOIN last_rounds l ON c.id = l.company_id""",
    "investors": """
        SELECT s_suppkey AS id, s_name AS investor_name,
          CASE n_nationkey % 5 WHEN 0 THEN 'Canada' WHEN 1 THEN 'USA' ELSE n_name END AS country,
          (['VC','Angel','Corporate'])[s_suppkey % 3 + 1] AS investor_type
        FROM supplier JOIN places ON s_nationkey = n_nationkey""",
    "deal_investor": """
        SELECT l_orderkey AS deal_id, l_suppkey AS investor_id,
          CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS lead_investor_flag,
          d.round_type, i.investor_name, i.country AS investor_country
        FROM lineitem JOIN deals d ON l_orderkey = d.id JOIN investors i ON l_suppkey = i.id""",
    "sessioned": """
        SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no
        FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOUR
                THEN 1 ELSE 0 END AS brk FROM events)""",
    "web_events": """
        SELECT event_id, event_type, ts AS event_time, ts AS client_event_time,
          ts + to_milliseconds((event_id % 7) * 100) AS client_upload_time,
          ts + to_milliseconds((event_id % 7) * 100) AS server_received_time,
          ts + to_milliseconds((event_id % 7) * 100 + (event_id % 3) * 50) AS server_upload_time,
          ts + to_milliseconds((event_id % 7) * 100 + (event_id % 3) * 50 + (event_id % 11) * 250) AS processed_time,
          CASE WHEN event_id % 101 <> 0 THEN user_id END AS user_id,
          user_id || '-' || CAST(session_no AS BIGINT) AS session_id,
          r_name AS country,
          CASE WHEN event_id % 53 <> 0 THEN n_name END AS region,
          CASE WHEN event_id % 31 <> 0 THEN n_name || '_C' || (user_id % 3) END AS city,
          (['Windows','Mac OS X','Linux','Windows','iOS','Android'])[user_id % 6 + 1] AS device_family,
          CASE WHEN event_id % 71 <> 0 THEN (['Windows','Mac OS X','Linux','Windows','iOS','Android'])[user_id % 6 + 1] END AS os_name,
          (['English','Polish','Spanish','English'])[user_id % 4 + 1] AS language,
          'Web' AS platform, 'http/2' AS library, 'app' AS app, props AS event_properties
        FROM sessioned JOIN customer ON user_id = c_custkey JOIN places ON c_nationkey = n_nationkey""",
    "sessions": """
        SELECT session_id, count(*) AS events, min(event_time) AS start_time, max(event_time) AS end_time,
          epoch_us(max(event_time)) / 1e6 - epoch_us(min(event_time)) / 1e6 AS seconds
        FROM web_events GROUP BY session_id""",
    "deal_company": """
        SELECT d.*, c.company_name, c.primary_tag, c.secondary_tag, c.ecosystem_name, c.date_founded, c.age
        FROM deals d JOIN companies c ON d.company_id = c.id""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it mentions, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
