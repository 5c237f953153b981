"""Round trips through sources and sinks, and streams compared with batch results.

Files go to a new folder inside the checkpoint folder, which on a cluster is the shared one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dealflux.catalog.events_queries import STATES
from dealflux.catalog.registry import query
from dealflux.operators import deals as D
from dealflux.operators import sequences as Q
from dealflux.operators.sessions import session_stats
from dealflux.session import checkpoint_dir
from dealflux.sources import readers as R
from dealflux.sources import writers as W
from dealflux.streaming import events as E

EVENT_COLS = ["event_id", "event_type", "event_time", "user_id", "session_id", "country", "region", "city", "event_properties"]
# JSON text with quotes, commas and a backslash, as exports have it.
PROPERTIES = """concat('{"said": "a, \\\\"b\\\\"", "type": "', coalesce(event_type, ''), '", "n": ', cast(event_id AS string), '}')"""
EVENT_SQL = """SELECT event_id, event_type, CAST(event_time AS VARCHAR) AS event_time, CAST(user_id AS VARCHAR) AS user_id, session_id, country, region, city,
  concat('{"said": "a, \\"b\\"", "type": "', coalesce(event_type, ''), '", "n": ', CAST(event_id AS VARCHAR), '}') AS event_properties
  FROM web_events"""


def web_events(t):
    return t.web_events.withColumn("event_properties", F.expr(PROPERTIES))


def folder(t, name):
    return f"{checkpoint_dir(t.spark)}/files/{name}-{uuid.uuid4().hex}"


def event_csv(t):
    path = folder(t, "events")
    W.write_csv_chunks(web_events(t).select(*EVENT_COLS), path, rows_per_file=2000)
    return path


@query("src_csv_chunks", EVENT_SQL.replace("country, region, city", "CASE WHEN coalesce(user_id % 2, 0) = 0 THEN country END AS country, CASE WHEN user_id % 2 = 1 THEN city END AS city")
)
def _(t):
    e = web_events(t)
    names = [c for c in EVENT_COLS if c not in ("region", "city")], [c for c in EVENT_COLS if c not in ("region", "country")]
    paths = []
    for i, cols in enumerate(names):
        paths.append(folder(t, f"chunk{i}"))
        W.write_csv_chunks(e.where(F.coalesce(F.col("user_id") % 2, F.lit(0)) == i).select(*cols), paths[-1])
    return R.read_chunks(t.spark, paths, [R.event_schema(c) for c in names])


@query("src_csv_schema", EVENT_SQL)
def _(t):
    return R.read_csv(t.spark, event_csv(t), R.event_schema(EVENT_COLS))


@query("src_csv_by_name", "SELECT city, event_id, event_type, CAST(event_time AS VARCHAR) AS event_time, NULL::VARCHAR AS dma FROM web_events")
def _(t):
    return R.read_csv_by_name(t.spark, event_csv(t), R.event_schema(["city", "event_id", "event_type", "event_time", "dma"]))


@query("src_csv_projected", "SELECT event_id, event_type, session_id FROM web_events WHERE event_type <> 'error'")
def _(t):
    scan = R.read_csv(t.spark, event_csv(t), R.event_schema(EVENT_COLS), ["event_id", "event_type", "session_id"])
    return scan.where(F.col("event_type") != "error")


@query("src_json_array_to_csv", EVENT_SQL.replace("CAST(event_time AS VARCHAR) AS event_time, CAST(user_id AS VARCHAR) AS user_id, session_id, country, region, city,", "city,"))
def _(t):
    # One array of about a hundred objects a line, so that objects share lines as in an export without line breaks.
    source, target = folder(t, "json"), folder(t, "csv")
    kept = ["event_id", "event_type", "city", "event_properties"]
    objects = web_events(t).select((F.col("event_id") % 101).alias("_line"), F.to_json(F.struct(*kept, "language")).alias("_o"))
    lines = objects.groupBy("_line").agg(F.concat(F.array_join(F.collect_list("_o"), ", "), F.lit(",")).alias("value")).select("value")
    lines.unionByName(t.spark.createDataFrame([("[",), ("]",)], "value string")).write.text(source)
    R.convert_export(t.spark, source, target, R.event_schema([*kept, "language"]), kept, form="array", rows_per_file=3000)
    return R.read_csv(t.spark, target, R.event_schema(kept))


@query("src_star_tables", """
  SELECT 'deals' AS source, count(*) AS rows, count(amount) AS present, CAST(max(date) AS VARCHAR) AS newest FROM deals
  UNION ALL SELECT 'companies', count(*), count(date_founded), CAST(max(date_founded) AS VARCHAR) FROM companies
  UNION ALL SELECT 'investors', count(*), count(country), NULL FROM investors
  UNION ALL SELECT 'deal_investor', count(*), count(lead_investor_flag), NULL FROM deal_investor
  UNION ALL SELECT 'ecosystems', count(*), count(city), NULL FROM ecosystems""")
def _(t):
    path = folder(t, "star")
    for name in R.Star._fields:
        W.write_csv_chunks(getattr(t, name), f"{path}/{name}")
    star = R.load_star(t.spark, path)
    null = F.lit(None).cast("date")
    shown = [("deals", F.count("amount"), F.max("date")), ("companies", F.count("date_founded"), F.max("date_founded")), ("investors", F.count("country"), null),
             ("deal_investor", F.count("lead_investor_flag"), null), ("ecosystems", F.count("city"), null)]
    out = None
    for name, present, newest in shown:
        row = getattr(star, name).agg(F.count(F.lit(1)).alias("rows"), present.alias("present"), newest.alias("newest")).withColumn("source", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("src_required_columns", """SELECT 'deals' AS source, 'amount' AS missing, count(*) AS rows FROM deals""")
def _(t):
    tables = {"deals": t.deals.drop("amount"), "investors": t.investors}
    found = [(s, c) for s, cols in R.missing_columns(tables).items() for c in cols]
    missing = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(c).alias("missing")) for s, c in found]))
    return tables["deals"].agg(F.count(F.lit(1)).alias("rows")).select("rows", missing.alias("_m")).select("_m.*", "rows")


SUMS = "SELECT year, count(id) AS deals, avg(amount) AS amount_mean FROM deals GROUP BY 1"


@query("src_json_results", SUMS, r0="amount_mean")
def _(t):
    path = folder(t, "document")
    yearly = D.quarterly_trends(t.deals).groupBy("year").agg(
        F.sum("deals").alias("deals"), (F.sum("amount_sum")).alias("amount_sum"))
    counts = t.deals.groupBy("year").agg(F.count("amount").alias("priced"))
    rows = yearly.join(counts, "year").select("year", "deals", (F.col("amount_sum") / F.col("priced")).alias("amount_mean"))
    W.write_json(rows.agg(F.collect_list(F.struct("year", "deals", "amount_mean")).alias("yearly_trends")), path)
    return R.read_results(t.spark, path, "yearly_trends", "year int, deals bigint, amount_mean double")


@query("src_latest_file")
def _(t):
    path = folder(t, "models")
    for i in range(2):
        W.write_json(t.deals.groupBy("year").agg(F.count(F.lit(1)).alias("n")), f"{path}/results_{i}")
    return R.latest_file(t.spark, f"{path}/results_*/*.json")


@query("snk_csv_chunks", "SELECT id, company_id, round_type FROM deals")
def _(t):
    path = folder(t, "deals")
    W.write_csv_chunks(t.deals.select("id", "company_id", "round_type"), path, rows_per_file=1000)
    return R.read_csv(t.spark, path, "id bigint, company_id bigint, round_type string")


@query("snk_json_results", "SELECT id, amount, round_type FROM deals", r3="amount")
def _(t):
    path = folder(t, "json")
    W.write_json(t.deals.select("id", "amount", "round_type"), path)
    return t.spark.read.schema("id bigint, amount double, round_type string").json(path)


@query("snk_json_documents", """SELECT '{"id":' || id || ',"round_type":' || coalesce('"' || round_type || '"', 'null') || '}' AS document FROM deals""")
def _(t):
    return W.as_documents(t.deals.select("id", "round_type"))


@query("snk_results_cache", """SELECT session_id, count(*) AS events, count(DISTINCT event_type) AS event_types FROM web_events GROUP BY 1""")
def _(t):
    return W.store(session_stats(t.web_events).select("session_id", "events", "event_types"), folder(t, "stats"))


@query("snk_edges_json", STATES + " SELECT src, dst, prob, avg_secs FROM edges", r9="prob", r4="avg_secs")
def _(t):
    path = folder(t, "edges")
    W.write_edges(Q.markov(t.web_events), path)
    return t.spark.read.schema("src string, dst string, prob double, avg_secs double").json(path)


@query("snk_events_partitioned", "SELECT event_id, session_id FROM web_events WHERE CAST(event_time AS DATE) = DATE '2024-01-10'")
def _(t):
    path = folder(t, "curated")
    W.write_events(t.web_events, path)
    return t.spark.read.parquet(path).where("event_date = date'2024-01-10'").select("event_id", "session_id")


# Streams.


def stream(t):
    return E.read_events(t.spark, f"{t.folder}/event[s].parquet", t.base("events").schema)


@query("stm_ingest", "SELECT event_id, event_type, user_id FROM events")
def _(t):
    twice = stream(t).unionByName(stream(t))
    return E.ingest(twice, folder(t, "ingest"), folder(t, "state")).select("event_id", "event_type", "user_id")


@query("stm_hourly_counts", """
  SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def _(t):
    return E.run_available(E.hourly_counts(stream(t)), folder(t, "hourly"), folder(t, "state"), mode="update", keys=["hour_start", "event_type"])


@query("stm_sessions", """
  WITH s AS (SELECT user_id, session_no, min(ts) AS a, max(ts) AS b, count(*) AS events FROM sessioned GROUP BY 1, 2)
  SELECT user_id, CAST(a AS VARCHAR) AS start_time, CAST(b AS VARCHAR) AS end_time, events FROM s""")
def _(t):
    return E.run_available(E.sessions(stream(t)), folder(t, "sessions"), folder(t, "state"))
