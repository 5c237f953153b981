"""Event analytics: sessions, sequences, funnels, time, place and latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealflux.catalog.registry import query
from dealflux.functions.vocab import ARROW
from dealflux.operators import activity as A
from dealflux.operators import distinct_sets as D
from dealflux.operators import filters as flt
from dealflux.operators import sequences as Q
from dealflux.operators import sessions as S
from dealflux.plans import kernels as K
from dealflux.plans.ordered import sessionize
from dealflux.session import cut

BLACKLIST = ["error"]
FUNNELS = {
    "buy": ["view", "click", "purchase"],
    "join": ["signup", "view", "purchase"],
    "absent": ["view", "refund", "purchase"],
}
STANDARD = [("view", "click"), ("click", "view")]

NEXTS = """SELECT *, lead(event_type) OVER w AS next_event_type, lead(event_time) OVER w AS next_time
  FROM web_events WINDOW w AS (PARTITION BY session_id ORDER BY event_time, event_id)"""
DESCRIBE = """count({0}) AS n, avg({0}) AS mean, stddev_samp({0}) AS std, min({0})::DOUBLE AS min, max({0})::DOUBLE AS max,
  quantile_cont({0}, 0.25)::DOUBLE AS q1, quantile_cont({0}, 0.5)::DOUBLE AS median, quantile_cont({0}, 0.75)::DOUBLE AS q3"""
DESCRIBED = "mean std min max q1 median q3"


@query("evt_sessionize", """
  SELECT event_id, user_id, CAST(session_no AS BIGINT) AS session_no FROM sessioned""")
def _(t):
    return sessionize(t.base("events")).select("event_id", "user_id", "session_no")


STATES = """
  WITH st AS (SELECT session_id, event_time, event_id,
      event_type || '|' || CASE WHEN hour(event_time) = 0 THEN 'nan' WHEN hour(event_time) <= 6 THEN 'night'
        WHEN hour(event_time) <= 12 THEN 'morning' WHEN hour(event_time) <= 18 THEN 'afternoon' ELSE 'evening' END AS state
    FROM web_events),
  nx AS (SELECT state AS src, lead(state) OVER w AS dst, epoch_us(lead(event_time) OVER w) - epoch_us(event_time) AS us
    FROM st WINDOW w AS (PARTITION BY session_id ORDER BY event_time, event_id)),
  ed AS (SELECT src, dst, count(*) AS n, avg(us / 1e6) AS avg_secs FROM nx WHERE dst IS NOT NULL GROUP BY src, dst),
  edges AS (SELECT src, dst, n, avg_secs, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY src) AS prob FROM ed)"""


@query("evt_markov", STATES + " SELECT src, dst, n, prob, avg_secs FROM edges", r9="prob", r4="avg_secs")
def _(t):
    return Q.markov(t.web_events).select("src", "dst", "n", "prob", "avg_secs")


@query("evt_markov_edges", STATES + " SELECT src, dst, prob, avg_secs FROM edges WHERE prob > 0.05",
       r9="prob", r4="avg_secs")
def _(t):
    return Q.markov(t.web_events, min_prob=0.05).select("src", "dst", "prob", "avg_secs")


@query("evt_markov_predict", STATES + """,
  by_event AS (SELECT split_part(src, '|', 1) AS event_type, split_part(dst, '|', 1) AS next_event, sum(n) AS n, max(prob) AS max_prob
    FROM edges GROUP BY 1, 2),
  pr AS (SELECT *, n / sum(n) OVER (PARTITION BY event_type)::DOUBLE AS prob FROM by_event),
  rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY prob DESC, next_event) AS INTEGER) AS rank FROM pr),
  last AS (SELECT session_id AS case_id, last(event_type ORDER BY event_time, event_id) AS event_type FROM web_events GROUP BY 1)
  SELECT case_id, event_type, rank, next_event, prob, max_prob FROM last JOIN rk USING (event_type) WHERE rank <= 5""",
       r9="prob max_prob")
def _(t):
    last = S.first_last(t.web_events).select(F.col("session_id").alias("case_id"), F.col("last_event").alias("event_type"))
    return Q.markov_predict(Q.markov(t.web_events), last)


@query("evt_transitions", f"""SELECT event_type, next_event_type, count(*) AS n FROM ({NEXTS})
  WHERE next_event_type IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return Q.transitions(t.web_events)


@query("win_next_event", f"SELECT session_id, event_id, event_type, next_event_type FROM ({NEXTS})")
def _(t):
    return Q.next_event(t.web_events).select("session_id", "event_id", "event_type", "next_event_type")


@query("win_prev_event", """SELECT session_id, event_id, event_type,
  lag(event_type, 1, 'START') OVER (PARTITION BY session_id ORDER BY event_time, event_id) AS prev_event_type FROM web_events""")
def _(t):
    return Q.prev_event(t.web_events).select("session_id", "event_id", "event_type", "prev_event_type")


@query("win_first_event", """SELECT event_type, count(*) AS sessions FROM (
  SELECT event_type, row_number() OVER (PARTITION BY session_id ORDER BY event_time, event_id) AS rn FROM web_events)
  WHERE rn = 1 GROUP BY 1""")
def _(t):
    return Q.first_events(t.web_events)


DELTAS = """SELECT event_id, event_type, (epoch_us(client_event_time) - epoch_us(lag(client_event_time) OVER
  (PARTITION BY user_id ORDER BY client_event_time, event_id))) / 1e6 AS secs_since_prev FROM web_events WHERE user_id IS NOT NULL"""


@query("win_time_delta", DELTAS.replace("event_id, event_type,", "event_id,", 1), r6="secs_since_prev")
def _(t):
    return Q.seconds_since_previous(t.web_events).select("event_id", "secs_since_prev")


@query("win_time_delta_summary", f"SELECT {DESCRIBE.format('secs_since_prev')} FROM ({DELTAS})", r3=DESCRIBED)
def _(t):
    return K.describe(Q.seconds_since_previous(t.web_events), [], "secs_since_prev")


@query("win_time_delta_by_type", f"""SELECT event_type, avg(secs_since_prev) AS mean_seconds FROM ({DELTAS})
  GROUP BY 1 ORDER BY 2 DESC LIMIT 10""", r3="mean_seconds")
def _(t):
    means = Q.seconds_since_previous(t.web_events).groupBy("event_type").agg(F.avg("secs_since_prev").alias("mean_seconds"))
    return K.top_k(means, 10, F.desc("mean_seconds"), F.asc("event_type"))


@query("win_session_duration", """SELECT event_id, session_id, (epoch_us(max(event_time) OVER (PARTITION BY session_id))
  - epoch_us(min(event_time) OVER (PARTITION BY session_id))) / 1e6 AS session_duration FROM web_events""", r6="session_duration")
def _(t):
    return S.with_duration(t.web_events).select("event_id", "session_id", "session_duration")


@query("win_sliding_events", """
  WITH w AS (SELECT session_id, event_id, event_type AS label,
      lag(event_type, 3) OVER o AS a, lag(event_type, 2) OVER o AS b, lag(event_type, 1) OVER o AS c
    FROM web_events WINDOW o AS (PARTITION BY session_id ORDER BY event_time, event_id)),
  k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY md5('42#' || event_id), event_id) AS rn FROM w WHERE a IS NOT NULL)
  SELECT session_id, event_id, a || ' ' || b || ' ' || c AS events, label FROM k WHERE rn <= 25""")
def _(t):
    return Q.sliding_windows(t.web_events, 3).withColumn("events", F.array_join("events", " "))


@query("evt_session_stats", """SELECT session_id, count(*) AS events, count(DISTINCT event_type) AS event_types,
  CAST(min(event_time) AS VARCHAR) AS start_time, CAST(max(event_time) AS VARCHAR) AS end_time,
  (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 6e7 AS minutes FROM web_events GROUP BY 1""", r4="minutes")
def _(t):
    return S.session_stats(t.web_events)


@query("evt_session_stats_summary", f"""
  SELECT measure, {DESCRIBE.format('v')} FROM (SELECT 'events' AS measure, events::DOUBLE AS v FROM sessions
    UNION ALL SELECT 'minutes', seconds / 60 FROM sessions) GROUP BY 1""", r4=DESCRIBED)
def _(t):
    return S.stats_summary(t.web_events)


ENDS = """SELECT session_id, first(event_type ORDER BY event_time, event_id) AS first_event,
  last(event_type ORDER BY event_time, event_id) AS last_event FROM {} GROUP BY session_id"""


@query("evt_session_first_last", ENDS.format("web_events"))
def _(t):
    return S.first_last(t.web_events)


@query("evt_first_last_counts", f"""
  WITH e AS ({ENDS.format('web_events')}),
  l AS (SELECT 'first_event' AS position, first_event AS event_type FROM e UNION ALL SELECT 'last_event', last_event FROM e)
  SELECT position, event_type, count(*) AS sessions, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY position) AS share
  FROM l GROUP BY 1, 2""", r6="share")
def _(t):
    return S.first_last_counts(t.web_events)


@query("evt_entry_exit", f"""
  WITH e AS ({ENDS.format("web_events WHERE event_type <> 'error'")}),
  l AS (SELECT 'first_event' AS position, first_event AS event_type FROM e UNION ALL SELECT 'last_event', last_event FROM e),
  c AS (SELECT position, event_type, count(*) AS sessions FROM l GROUP BY 1, 2),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY position ORDER BY sessions DESC, event_type) AS INTEGER) AS rank FROM c)
  SELECT * FROM r WHERE rank <= 10""")
def _(t):
    return S.entry_exit(t.web_events, BLACKLIST)


@query("evt_session_describe", f"""
  WITH u AS (SELECT user_id, count(*) AS e, count(DISTINCT session_id) AS s FROM web_events WHERE user_id IS NOT NULL GROUP BY 1),
  l AS (SELECT 'events_per_session' AS measure, events::DOUBLE AS v FROM sessions
    UNION ALL SELECT 'session_seconds', seconds FROM sessions
    UNION ALL SELECT 'events_per_user', e FROM u UNION ALL SELECT 'sessions_per_user', s FROM u)
  SELECT measure, {DESCRIBE.format('v')} FROM l GROUP BY 1""", r3=DESCRIBED)
def _(t):
    return S.activity_describe(t.web_events)


@query("evt_duration_by_start", """
  SELECT part, value, avg(seconds) AS mean_seconds, count(*) AS sessions FROM (
    SELECT 'hour' AS part, CAST(hour(start_time) AS INTEGER) AS value, seconds FROM sessions
    UNION ALL SELECT 'weekday', CAST(isodow(start_time) - 1 AS INTEGER), seconds FROM sessions
    UNION ALL SELECT 'month', CAST(month(start_time) AS INTEGER), seconds FROM sessions) GROUP BY 1, 2""", r3="mean_seconds")
def _(t):
    return S.duration_by_start(t.web_events)


@query("evt_user_pairs", """
  SELECT event_type || ' -> ' || coalesce(nx, 'nan') AS pair, count(*) AS n FROM (
    SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS nx
    FROM web_events WHERE user_id IS NOT NULL) GROUP BY 1 ORDER BY n DESC, pair LIMIT 10""")
def _(t):
    return Q.user_pairs(t.web_events)


@query("evt_time_of_day_matrix", """
  SELECT k.event_type, d.time_of_day, count(e.event_id) AS n
  FROM (SELECT DISTINCT event_type FROM web_events) k,
    (VALUES ('night', 1, 6), ('morning', 7, 12), ('afternoon', 13, 18), ('evening', 19, 24)) d(time_of_day, lo, hi)
  LEFT JOIN web_events e ON e.event_type = k.event_type AND hour(e.event_time) BETWEEN lo AND hi GROUP BY 1, 2""")
def _(t):
    return Q.time_of_day_matrix(t.web_events)


GRAMS = """
  WITH s AS (SELECT session_id, list(event_type ORDER BY event_time, event_id) AS ev FROM web_events
      WHERE event_type <> 'error' GROUP BY 1),
  p AS (SELECT ev, unnest(range(1, len(ev) + 1)) AS i FROM s),
  g AS (SELECT k AS length, array_to_string(ev[i : i + k - 1], ' → ') AS sequence FROM p, (VALUES (2), (3), (4), (5)) v(k)
      WHERE i + k - 1 <= len(ev)),
  c AS (SELECT length, sequence, count(*) AS n FROM g GROUP BY 1, 2),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY length ORDER BY n DESC, sequence) AS INTEGER) AS rank FROM c),
  top AS (SELECT * FROM r WHERE rank <= CASE WHEN length = 2 THEN 20 ELSE 10 END)"""


@query("evt_ngrams", GRAMS + " SELECT length, sequence, n, rank FROM top")
def _(t):
    return Q.top_ngrams(Q.ngrams(t.web_events, blacklist=BLACKLIST))


@query("evt_ngram_counts", GRAMS + " SELECT length, sequence, n FROM c")
def _(t):
    return Q.ngrams(t.web_events, blacklist=BLACKLIST)


@query("evt_flow_edges", GRAMS + """,
  st AS (SELECT n, string_split(sequence, ' → ') AS s FROM top),
  mv AS (SELECT n, s, unnest(range(1, len(s))) AS i FROM st)
  SELECT CAST(i AS INTEGER) AS position, upper(s[i][1]) || s[i][2:] AS source, upper(s[i + 1][1]) || s[i + 1][2:] AS target,
    CAST(sum(n) AS BIGINT) AS weight FROM mv GROUP BY 1, 2, 3""")
def _(t):
    return Q.flow_edges(Q.top_ngrams(Q.ngrams(t.web_events, blacklist=BLACKLIST)))


STEPS = ", ".join(f"('{f}', {i + 1}, '{e}')" for f, es in FUNNELS.items() for i, e in enumerate(es))


@query("evt_funnel", f"""
  WITH st(funnel, step, event_type) AS (VALUES {STEPS}),
  c AS (SELECT funnel, step, st.event_type, count(DISTINCT user_id) AS users
    FROM st LEFT JOIN web_events e ON e.event_type = st.event_type GROUP BY 1, 2, 3)
  SELECT funnel, step, event_type, users, CASE WHEN step = 1 THEN 100.0::DOUBLE ELSE
    100.0::DOUBLE * users / nullif(lag(users) OVER (PARTITION BY funnel ORDER BY step), 0) END AS conversion FROM c""", r6="conversion")
def _(t):
    return Q.funnels(t.web_events, FUNNELS)


@query("evt_funnel_ordered", f"""
  WITH st(funnel, step, event_type) AS (VALUES {STEPS}),
  f AS (SELECT user_id, event_type, min(event_time) AS ft FROM web_events WHERE user_id IS NOT NULL GROUP BY 1, 2),
  j AS (SELECT funnel, user_id, max(CASE WHEN step = 1 THEN ft END) AS t1, max(CASE WHEN step = 2 THEN ft END) AS t2,
      max(CASE WHEN step = 3 THEN ft END) AS t3 FROM st JOIN f USING (event_type) GROUP BY 1, 2),
  n AS (SELECT funnel, count(t1) AS n1, count(CASE WHEN t1 <= t2 THEN 1 END) AS n2,
      count(CASE WHEN t1 <= t2 AND t2 <= t3 THEN 1 END) AS n3 FROM j GROUP BY 1),
  c AS (SELECT funnel, step, event_type, CASE step WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE n3 END AS users FROM st JOIN n USING (funnel))
  SELECT funnel, step, event_type, users, CASE WHEN step = 1 THEN 100.0::DOUBLE ELSE
    100.0::DOUBLE * users / nullif(lag(users) OVER (PARTITION BY funnel ORDER BY step), 0) END AS conversion FROM c""", r6="conversion")
def _(t):
    return Q.funnels(t.web_events, FUNNELS, mode="ordered")


@query("evt_sequence_lengths", """SELECT count(*) AS sessions, avg(events) AS mean_events, max(events) AS max_events,
  min(events) AS min_events FROM sessions""", r6="mean_events")
def _(t):
    return S.sequence_lengths(t.web_events)


@query("evt_short_sessions", f"""
  SELECT s.session_id, events, CAST(start_time AS VARCHAR) AS start_time, CAST(end_time AS VARCHAR) AS end_time,
    first_event, last_event, seconds FROM sessions s JOIN ({ENDS.format('web_events')}) e ON s.session_id = e.session_id
  WHERE seconds < 5""", r6="seconds")
def _(t):
    return S.short_sessions(t.web_events)


@query("evt_short_session_report", """
  SELECT count(*) FILTER (seconds < 5) AS short_sessions, count(*) AS sessions,
    CAST(coalesce(sum(events) FILTER (seconds < 5), 0) AS BIGINT) AS short_rows, CAST(sum(events) AS BIGINT) AS rows,
    100.0::DOUBLE * count(*) FILTER (seconds < 5) / count(*) AS session_percent,
    100.0::DOUBLE * coalesce(sum(events) FILTER (seconds < 5), 0) / sum(events) AS row_percent,
    sum(events) FILTER (seconds < 5) / nullif(count(*) FILTER (seconds < 5), 0)::DOUBLE AS mean_events FROM sessions""",
       r6="session_percent row_percent mean_events")
def _(t):
    return S.short_session_report(t.web_events)


@query("evt_short_session_paths", """
  SELECT session_id, CAST(event_time AS VARCHAR) AS event_time, event_id, event_type,
    lead(event_type) OVER (PARTITION BY session_id ORDER BY event_time, event_id) AS next_event_type
  FROM web_events WHERE session_id IN (SELECT session_id FROM sessions WHERE seconds < 5)""")
def _(t):
    ids = S.short_sessions(t.web_events).select("session_id")
    return S.session_paths(t.web_events, ids)


@query("evt_peak_activity", """
  WITH c AS (SELECT 'hour' AS part, CAST(hour(event_time) AS VARCHAR) AS value, count(*) AS n FROM web_events GROUP BY 2
    UNION ALL SELECT 'weekday', dayname(event_time), count(*) FROM web_events GROUP BY 2
    UNION ALL SELECT 'month', strftime(event_time, '%Y-%m'), count(*) FROM web_events GROUP BY 2),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY part ORDER BY n DESC, value) AS INTEGER) AS rank, 'peak' AS kind FROM c
    UNION ALL SELECT *, CAST(row_number() OVER (ORDER BY n, value) AS INTEGER), 'quiet' FROM c WHERE part = 'hour')
  SELECT part, value, n, rank, kind FROM r WHERE rank <= 3""")
def _(t):
    return A.peaks(t.web_events)


@query("win_topn_per_group", """
  WITH c AS (SELECT CAST(isodow(event_time) - 1 AS INTEGER) AS weekday, CAST(hour(event_time) AS INTEGER) AS hour, count(*) AS n
    FROM web_events GROUP BY 1, 2),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY weekday ORDER BY n DESC, hour) AS INTEGER) AS rank FROM c)
  SELECT * FROM r WHERE rank <= 3""")
def _(t):
    return A.peak_hours_by_weekday(t.web_events)


@query("evt_user_event_matrix", """
  SELECT user_id, event_type, count(*) AS n FROM web_events WHERE user_id IS NOT NULL AND event_type IN (
    SELECT event_type FROM web_events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 3) GROUP BY 1, 2""")
def _(t):
    return S.user_event_matrix(t.web_events, top=3)


@query("evt_user_event_columns", """
  SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
    count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup,
    count(*) FILTER (event_type = 'view') AS view FROM web_events WHERE user_id IS NOT NULL GROUP BY 1""")
def _(t):
    return S.user_event_columns(t.web_events)


@query("evt_session_features", """
  WITH d AS (SELECT session_id, device_family, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, device_family) AS rn
    FROM web_events GROUP BY 1, 2),
  c AS (SELECT session_id, country, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, country) AS rn
    FROM web_events GROUP BY 1, 2),
  h AS (SELECT session_id, avg(hour(event_time)) AS mean_hour FROM web_events GROUP BY 1)
  SELECT s.session_id, events, mean_hour, seconds, device_family, country FROM sessions s JOIN h ON s.session_id = h.session_id
  JOIN d ON s.session_id = d.session_id AND d.rn = 1 JOIN c ON s.session_id = c.session_id AND c.rn = 1""", r6="mean_hour seconds")
def _(t):
    return S.session_features(t.web_events)


@query("evt_hourly_metrics", """
  WITH r AS (SELECT date_trunc('hour', e.event_time) AS h, e.event_time, e.session_id, s.seconds,
      (epoch_us(processed_time) - epoch_us(client_upload_time)) / 1e6 AS lat FROM web_events e JOIN sessions s ON e.session_id = s.session_id),
  b AS (SELECT h, count(*) AS events, sum(seconds::DECIMAL(28,6))::DOUBLE / nullif(count(seconds), 0) AS mean_duration,
    sum(lat::DECIMAL(28,6))::DOUBLE / nullif(count(lat), 0) AS mean_latency, count(DISTINCT session_id) AS sessions FROM r GROUP BY 1),
  p AS (SELECT h, avg(s) AS mean_sessions FROM (SELECT h, event_time, count(DISTINCT session_id) AS s FROM r GROUP BY 1, 2) GROUP BY 1),
  cal AS (SELECT unnest(generate_series((SELECT min(h) FROM b), (SELECT max(h) FROM b), INTERVAL 1 HOUR)) AS h)
  SELECT CAST(cal.h AS VARCHAR) AS hour_start, coalesce(events, 0) AS events, coalesce(sessions, 0) AS sessions,
    last_value(mean_duration IGNORE NULLS) OVER w AS mean_duration, last_value(mean_latency IGNORE NULLS) OVER w AS mean_latency,
    last_value(mean_sessions IGNORE NULLS) OVER w AS mean_sessions
  FROM cal LEFT JOIN b ON cal.h = b.h LEFT JOIN p ON cal.h = p.h WINDOW w AS (ORDER BY cal.h ROWS UNBOUNDED PRECEDING)""",
       r4="mean_duration", r7="mean_latency mean_sessions")
def _(t):
    return A.hourly_metrics(t.web_events)


@query("flt_non_standard_sessions", f"""
  SELECT session_id, first_event, last_event AS second_event FROM ({ENDS.format('web_events')})
  WHERE session_id IN (SELECT session_id FROM sessions WHERE events = 2)
    AND NOT (first_event = 'view' AND last_event = 'click') AND NOT (first_event = 'click' AND last_event = 'view')""")
def _(t):
    return S.non_standard_sessions(t.web_events, STANDARD)


@query("flt_non_standard_profile", f"""
  WITH ns AS (SELECT session_id FROM ({ENDS.format('web_events')}) WHERE session_id IN (SELECT session_id FROM sessions WHERE events = 2)
      AND NOT (first_event = 'view' AND last_event = 'click') AND NOT (first_event = 'click' AND last_event = 'view')),
  r AS (SELECT e.*, s.seconds FROM web_events e JOIN ns ON e.session_id = ns.session_id JOIN sessions s ON e.session_id = s.session_id),
  c AS (SELECT 'device_family' AS feature, device_family AS value, count(*) AS n FROM r GROUP BY 2
    UNION ALL SELECT 'day_of_week', dayname(event_time), count(*) FROM r GROUP BY 2
    UNION ALL SELECT 'city', city, count(*) FROM r WHERE city IS NOT NULL GROUP BY 2),
  s AS (SELECT *, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY feature) AS share,
      row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rn FROM c)
  SELECT feature, value, n, share FROM s WHERE feature <> 'city' OR rn <= 5
  UNION ALL SELECT 'all', 'users', count(DISTINCT user_id), avg(seconds) FROM r""", r4="share")
def _(t):
    return S.non_standard_profile(t.web_events, STANDARD)


@query("flt_drop_single_event_sessions", """SELECT event_id, session_id FROM web_events
  WHERE session_id IN (SELECT session_id FROM sessions WHERE events > 1)""")
def _(t):
    return flt.drop_single_event_sessions(t.web_events).select("event_id", "session_id")


@query("flt_drop_all_same_event_sessions", """SELECT event_id, session_id FROM web_events
  WHERE session_id IN (SELECT session_id FROM web_events GROUP BY 1 HAVING count(*) FILTER (event_type <> 'view') > 0)""")
def _(t):
    return flt.drop_sessions_of_only(t.web_events, "view").select("event_id", "session_id")


@query("agg_overview", """
  SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT session_id) AS sessions,
    count(DISTINCT event_type) AS event_types, count(DISTINCT country) AS countries, count(DISTINCT city) AS cities,
    CAST(min(event_time) AS VARCHAR) AS first_time, CAST(max(event_time) AS VARCHAR) AS last_time,
    count(*) / count(DISTINCT user_id)::DOUBLE AS events_per_user FROM web_events""", r6="events_per_user")
def _(t):
    return A.overview(t.web_events)


@query("agg_events_by_hour", """SELECT CAST(hour(event_time) AS INTEGER) AS hour, count(*) AS events,
  count(DISTINCT session_id) AS sessions FROM web_events GROUP BY 1""")
def _(t):
    return A.by_hour(t.web_events)


@query("agg_events_by_day", """SELECT CAST(dayofweek(event_time) + 1 AS INTEGER) AS day, count(*) AS events,
  count(DISTINCT session_id) AS sessions FROM web_events GROUP BY 1""")
def _(t):
    return A.by_day(t.web_events)


@query("agg_temporal_distributions", """
  SELECT 'hour' AS part, CAST(hour(event_time) AS VARCHAR) AS value, count(*) AS n FROM web_events GROUP BY 2
  UNION ALL SELECT 'weekday', dayname(event_time), count(*) FROM web_events GROUP BY 2
  UNION ALL SELECT 'month', strftime(event_time, '%Y-%m'), count(*) FROM web_events GROUP BY 2
  UNION ALL SELECT 'date', strftime(event_time, '%Y-%m-%d'), count(*) FROM web_events GROUP BY 2""")
def _(t):
    return A.distributions(t.web_events)


@query("agg_weekday_hour_matrix", """
  SELECT CAST(d.d AS INTEGER) AS weekday, CAST(h.h AS INTEGER) AS hour, count(e.event_id) AS n
  FROM range(7) d(d) CROSS JOIN range(24) h(h) LEFT JOIN web_events e ON isodow(event_time) - 1 = d.d AND hour(event_time) = h.h
  GROUP BY 1, 2""")
def _(t):
    return A.weekday_hour(t.web_events)


@query("agg_daily_stats", """
  WITH d AS (SELECT CAST(event_time AS DATE) AS day, count(*) AS n FROM web_events GROUP BY 1)
  SELECT avg(n) AS mean_events, median(n)::DOUBLE AS median_events, stddev_samp(n) AS std_events, max(n) AS peak_events,
    (SELECT CAST(day AS VARCHAR) FROM d ORDER BY n DESC, day LIMIT 1) AS peak_day FROM d""", r6="mean_events median_events std_events")
def _(t):
    return A.daily_stats(t.web_events)


@query("agg_country_metrics", """SELECT country, count(*) AS events, count(DISTINCT session_id) AS sessions,
  count(DISTINCT user_id) AS users FROM web_events GROUP BY 1""")
def _(t):
    return A.country_metrics(t.web_events)


@query("agg_distinct_rollup", """
  SELECT 'country' AS scope, country, count(DISTINCT user_id) AS users, count(DISTINCT session_id) AS sessions
  FROM web_events GROUP BY country
  UNION ALL SELECT 'all', NULL, count(DISTINCT user_id), count(DISTINCT session_id) FROM web_events""")
def _(t):
    names = {"user_id": "users", "session_id": "sessions"}
    sets = cut(D.rollup(t.web_events, ["country"], list(names)))
    by = D.counts(sets, ["country"], names).withColumn("scope", F.lit("country"))
    whole = D.counts(sets, [], names).withColumns({"scope": F.lit("all"), "country": F.lit(None).cast("string")})
    return by.unionByName(whole).select("scope", "country", "users", "sessions")


@query("agg_region_by_country", """SELECT country, region, count(*) AS events FROM web_events GROUP BY 1, 2
  ORDER BY events DESC, country, region LIMIT 10""")
def _(t):
    return A.region_by_country(t.web_events)


@query("agg_device_usage", """SELECT device_family, count(*) AS events, count(DISTINCT session_id) AS sessions
  FROM web_events GROUP BY 1""")
def _(t):
    return A.usage(t.web_events, "device_family")


@query("agg_os_usage", "SELECT os_name, count(*) AS events, count(DISTINCT session_id) AS sessions FROM web_events GROUP BY 1")
def _(t):
    return A.usage(t.web_events, "os_name")


@query("agg_city_metrics", """
  SELECT city, count(DISTINCT user_id) AS users, count(DISTINCT session_id) AS sessions, count(*) AS events,
    count(*) / nullif(count(DISTINCT user_id), 0)::DOUBLE AS events_per_user,
    count(DISTINCT session_id) / nullif(count(DISTINCT user_id), 0)::DOUBLE AS sessions_per_user
  FROM web_events WHERE city IS NOT NULL GROUP BY 1 ORDER BY events DESC, city LIMIT 20""", r6="events_per_user sessions_per_user")
def _(t):
    return A.city_metrics(t.web_events)


@query("agg_country_device_crosstab", """
  WITH top AS (SELECT country FROM web_events GROUP BY 1 ORDER BY count(*) DESC, country LIMIT 3),
  g AS (SELECT country, device_family FROM top, (SELECT DISTINCT device_family FROM web_events)),
  c AS (SELECT g.country, g.device_family, count(e.event_id) AS n FROM g LEFT JOIN web_events e
    ON e.country = g.country AND e.device_family = g.device_family GROUP BY 1, 2)
  SELECT *, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY country) AS row_percent FROM c""", r6="row_percent")
def _(t):
    return A.country_device(t.web_events, top=3)


@query("agg_region_event_pref", """
  WITH top AS (SELECT event_type FROM web_events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 3),
  g AS (SELECT region, event_type FROM top, (SELECT DISTINCT region FROM web_events WHERE region IS NOT NULL))
  SELECT g.region, g.event_type, count(e.event_id) AS n FROM g LEFT JOIN web_events e
    ON e.region = g.region AND e.event_type = g.event_type GROUP BY 1, 2""")
def _(t):
    return A.region_event_preferences(t.web_events, top=3)


@query("agg_prefix_counts", """
  SELECT CASE WHEN event_type LIKE 'p%' THEN 'p' WHEN event_type LIKE 'si%' THEN 'si' ELSE 'v' END AS prefix, event_type, count(*) AS n
  FROM web_events WHERE event_type LIKE 'p%' OR event_type LIKE 'si%' OR event_type LIKE 'v%' GROUP BY 1, 2""")
def _(t):
    return A.prefix_counts(t.web_events, ["p", "si", "v"])


@query("agg_language_metrics", """
  WITH b AS (SELECT language, count(*) AS events, avg(seconds) / 60 AS mean_minutes FROM web_events e
      JOIN sessions s ON e.session_id = s.session_id GROUP BY 1),
  u AS (SELECT language, user_id, count(DISTINCT session_id) AS s FROM web_events WHERE user_id IS NOT NULL GROUP BY 1, 2),
  a AS (SELECT language, avg(s) AS sessions_per_user, avg(CASE WHEN s > 1 THEN 100.0::DOUBLE ELSE 0 END) AS return_rate FROM u GROUP BY 1)
  SELECT b.*, sessions_per_user, return_rate, 100.0::DOUBLE * events / sum(events) OVER () AS share FROM b JOIN a ON a.language = b.language""",
       r6="mean_minutes sessions_per_user return_rate share")
def _(t):
    return S.language_metrics(t.web_events)


@query("agg_ttest_by_group", """
  WITH r AS (SELECT language, seconds FROM web_events e JOIN sessions s ON e.session_id = s.session_id),
  m AS (SELECT language, count(*) AS n, avg(seconds) AS mu, var_samp(seconds) AS v FROM r GROUP BY 1),
  tt AS (SELECT 'English' AS reference, o.language, CAST(o.n + f.n - 2 AS BIGINT) AS df,
    (f.mu - o.mu) / sqrt(((o.n - 1) * o.v + (f.n - 1) * f.v) / (o.n + f.n - 2) * (1.0::DOUBLE / o.n + 1.0::DOUBLE / f.n)) AS t
  FROM m o JOIN m f ON f.language = 'English' WHERE o.language <> 'English'),
  z AS (SELECT *, abs(t) / sqrt(2.0::DOUBLE) AS z, 1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * abs(t) / sqrt(2.0::DOUBLE)) AS k FROM tt)
  SELECT reference, language, df, t, (0.254829592::DOUBLE * k - 0.284496736::DOUBLE * k ** 2 + 1.421413741::DOUBLE * k ** 3
    - 1.453152027::DOUBLE * k ** 4 + 1.061405429::DOUBLE * k ** 5) * exp(-z * z) AS p_value FROM z""", r6="t p_value")
def _(t):
    return S.ttest_p_values(S.duration_ttest(t.web_events))


@query("agg_latency_by_geo", """
  WITH l AS (SELECT region, city, (epoch_us(processed_time) - epoch_us(client_upload_time)) / 1e6 AS sl,
      (epoch_us(processed_time) - epoch_us(server_upload_time)) / 1e6 AS pl FROM web_events),
  u AS (SELECT 'region' AS level, region AS place, sl, pl FROM l UNION ALL SELECT 'city', city, sl, pl FROM l)
  SELECT level, place, avg(sl) AS mean_server, avg(pl) AS mean_processing, count(sl) AS n, count(*) FILTER (sl < 0.1) AS fast_rows
  FROM u WHERE place IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 100""", r6="mean_server mean_processing")
def _(t):
    return A.latency_by_geo(t.web_events, more_than=100)


@query("agg_latency_duration_corr", """
  WITH m AS (SELECT session_id, avg((epoch_us(processed_time) - epoch_us(client_upload_time)) / 1e6) AS lat FROM web_events GROUP BY 1)
  SELECT corr(lat, seconds) AS correlation, count(*) AS sessions FROM m JOIN sessions s ON m.session_id = s.session_id""", r6="correlation")
def _(t):
    return A.latency_duration_corr(t.web_events)


@query("agg_feature_duration", """
  WITH r AS (SELECT e.*, s.seconds FROM web_events e JOIN sessions s ON e.session_id = s.session_id),
  l AS (SELECT 'device_family' AS feature, device_family AS value, seconds FROM r
    UNION ALL SELECT 'os_name', os_name, seconds FROM r UNION ALL SELECT 'day_of_week', dayname(event_time), seconds FROM r
    UNION ALL SELECT 'hour', CAST(hour(event_time) AS VARCHAR), seconds FROM r
    UNION ALL SELECT 'city', city, seconds FROM r UNION ALL SELECT 'region', region, seconds FROM r)
  SELECT feature, value, avg(seconds) AS mean_seconds, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 300""",
       r3="mean_seconds")
def _(t):
    e = t.web_events.withColumns({"day_of_week": F.date_format("event_time", "EEEE"), "hour": F.hour("event_time")})
    return S.feature_duration(e, ["device_family", "os_name", "day_of_week", "hour", "city", "region"], more_than=300)


@query("agg_session_corr", "SELECT count(*) AS sessions, corr(events, seconds) AS correlation FROM sessions", r6="correlation")
def _(t):
    return S.session_correlation(t.web_events)


@query("agg_session_corr_trimmed", """
  WITH q AS (SELECT quantile_cont(events, 0.25) AS a, quantile_cont(events, 0.75) AS b FROM sessions),
  k AS (SELECT events, seconds FROM sessions, q WHERE events >= a - 1.5 * (b - a) AND events <= b + 1.5 * (b - a)),
  p AS (SELECT quantile_cont(seconds, 0.25) AS a, quantile_cont(seconds, 0.75) AS b FROM k)
  SELECT count(*) AS sessions, corr(events, seconds) AS correlation FROM k, p
  WHERE seconds >= a - 1.5 * (b - a) AND seconds <= b + 1.5 * (b - a)""", r6="correlation")
def _(t):
    return S.session_correlation(t.web_events, trim=True)


CONTEXTS = """
  WITH s AS (SELECT session_id, list(event_type ORDER BY event_time, event_id) AS ev FROM web_events GROUP BY 1),
  p AS (SELECT session_id, ev, unnest(range(2, len(ev) + 1)) AS i FROM s),
  c AS (SELECT k AS length, array_to_string(ev[i - k : i - 1], ' → ') AS context, ev[i] AS next_event, count(*) AS n
    FROM p, (VALUES (1), (2), (3)) v(k) WHERE i - k >= 1 GROUP BY 1, 2, 3),
  r AS (SELECT *, n / sum(n) OVER (PARTITION BY length, context)::DOUBLE AS prob,
    CAST(row_number() OVER (PARTITION BY length, context ORDER BY n DESC, next_event) AS INTEGER) AS rank FROM c)"""


@query("fc_next_event_ngram_table", CONTEXTS + " SELECT * FROM r WHERE rank <= 5", r9="prob")
def _(t):
    return Q.next_event_backoff(t.web_events, 3)


@query("fc_next_event_ngram", CONTEXTS + """,
  k AS (SELECT session_id AS case_id, ev[-3:] AS tail FROM s WHERE len(ev) >= 1),
  a AS (SELECT case_id, l AS length, array_to_string(tail[-l:], ' → ') AS context FROM k, (VALUES (1), (2), (3)) v(l) WHERE l <= len(tail)),
  b AS (SELECT a.* FROM a WHERE EXISTS (SELECT 1 FROM r WHERE r.length = a.length AND r.context = a.context)
    QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY a.length DESC) = 1)
  SELECT case_id, b.length, b.context, rank, next_event, prob FROM b JOIN r ON r.length = b.length AND r.context = b.context WHERE rank <= 5""",
       r9="prob")
def _(t):
    e = t.web_events
    ends = e.groupBy("session_id").agg(F.max(F.struct("event_time", "event_id")).alias("_at"))
    tails = Q.neighbours(e, ["session_id"], Q.ORDER, ["event_type"], n=2, backwards=True, out="_prev")
    last = tails.join(ends, "session_id").where(F.struct("event_time", "event_id") == F.col("_at"))
    cases = last.select(
        F.col("session_id").alias("case_id"), F.concat(F.reverse(F.col("_prev.event_type")), F.array("event_type")).alias("events")
    )
    return Q.predict_backoff(Q.next_event_backoff(e, 3), cases, 3)
