"""Feature preparation, models, metrics and forecasts over the supplied tables.

Model queries use the operators' default trees, rounds and seeds and read whole tables; where SQL can't fit
the model, it checks what must hold of any fit (rows, labels, shares).
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dealflux.catalog.registry import query
from dealflux.catalog.series_queries import MONTHLY, sector_series
from dealflux.operators import bin_forest as G
from dealflux.operators import boosting as B
from dealflux.operators import cell_forest as T
from dealflux.operators import features as X
from dealflux.operators import forecasting as Y
from dealflux.operators import hidden_states as H
from dealflux.operators import models as M
from dealflux.operators import sequences as Q
from dealflux.operators import series as R
from dealflux.operators import sessions as S
from dealflux.operators.projections import success_flag
from dealflux.plans import kernels as K
from dealflux.session import checkpoint_dir, cut

FUND = """fu AS (SELECT c.id AS company_id, age, ecosystem_name, primary_tag, coalesce(sum(amount), 0) AS total_funding, count(amount) AS deal_count,
  coalesce(sum(amount::DECIMAL(28,6))::DOUBLE / nullif(count(amount), 0), 0) AS avg_deal_size FROM companies c LEFT JOIN deals d ON c.id = d.company_id GROUP BY 1, 2, 3, 4)"""
INPUTS = ["age", "ecosystem_id", "primary_tag_id"]
ROUND_INPUTS = ["round_ordinal", "amount", "previous_amount", "age_at_deal", "weekday", "month"]
ROUND_CATEGORIES = ["ecosystem_name", "sector_group"]
MARKET = ["age", "total_funding", "deal_count", "avg_deal_size"]


def company_table(t):
    """Company features with age imputed by its mean and the success flag."""
    c = X.company_features(t.companies_aged, t.deals)
    return cut(success_flag(X.impute(c, ["age"], "mean"), threshold="median"))


@query("ml_label_index", """SELECT id, dense_rank() OVER (ORDER BY secondary) - 1 AS secondary_tag_index FROM
  (SELECT id, coalesce(secondary_tag, 'Unknown') AS secondary FROM companies)""")
def _(t):
    return X.label_index(t.companies, ["secondary_tag"]).select("id", "secondary_tag_index")


@query("ml_impute", """
  SELECT id, coalesce(age, (SELECT avg(age) FROM companies)) AS mean_age, coalesce(age, (SELECT quantile_cont(age, 0.5) FROM companies)) AS median_age,
    coalesce(secondary_tag, (SELECT secondary_tag FROM companies WHERE secondary_tag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS tag
  FROM companies""", r6="mean_age median_age")
def _(t):
    c = t.companies_aged.select("id", F.col("age").alias("mean_age"), F.col("age").alias("median_age"), F.col("secondary_tag").alias("tag"))
    return X.impute(X.impute(X.impute(c, ["mean_age"], "mean"), ["median_age"], "median"), ["tag"], "most_frequent")


@query("ml_standardize", f"""WITH {FUND} SELECT company_id, (age - avg(age) OVER ()) / stddev_pop(age) OVER () AS age_z,
  (total_funding - avg(total_funding) OVER ()) / stddev_pop(total_funding) OVER () AS total_funding_z FROM fu""", r6="age_z total_funding_z")
def _(t):
    c = X.company_funding(t.companies_aged, t.deals)
    return X.standardize(c, ["age", "total_funding"]).select("company_id", "age_z", "total_funding_z")


@query("ml_winsorize_iqr", f"""WITH {FUND}, q AS (SELECT quantile_cont(total_funding, 0.25) AS a, quantile_cont(total_funding, 0.75) AS b FROM fu)
  SELECT company_id, least(greatest(total_funding, a - 1.5 * (b - a)), b + 1.5 * (b - a)) AS total_funding FROM fu, q""", r0="total_funding")
def _(t):
    c = X.company_funding(t.companies_aged, t.deals)
    return X.winsorize(c, X.winsor_bounds(c, ["total_funding"]), ["total_funding"]).select("company_id", "total_funding")


@query("ml_one_hot", """
  WITH s AS (SELECT list(DISTINCT split_part(primary_tag, '-', 1) ORDER BY split_part(primary_tag, '-', 1)) AS all_s FROM companies)
  SELECT id, array_to_string(list_transform(all_s, lambda x: CASE WHEN x = split_part(primary_tag, '-', 1) THEN 1 ELSE 0 END), ',') AS sector FROM companies, s""")
def _(t):
    c = t.companies.select("id", F.split("primary_tag", "-")[0].alias("sector_group"))
    hot = M.one_hot(c, ["sector_group"])
    flags = F.transform(vector_to_array("sector_group_onehot"), lambda v: v.cast("int").cast("string"))
    return hot.select("id", F.array_join(flags, ",").alias("sector"))


@query("ml_train_test_split", """SELECT id, primary_tag, CAST(row_number() OVER (PARTITION BY primary_tag ORDER BY md5('42#' || id), id)
    <= round(count(*) OVER (PARTITION BY primary_tag) * 0.2::DOUBLE) AS INTEGER) AS is_test FROM companies""")
def _(t):
    return X.stratified_split(t.companies, "primary_tag", "id").select("id", "primary_tag", "is_test")


@query("ml_smote")
def _(t):
    c = company_table(t).withColumn("large", F.when(F.col("total_funding") > 2e8, 1).otherwise(0))
    return X.smote(c, "large", "company_id", ["age", "deal_count", "total_funding"])


# Models learn from four fifths of the rows and score all; ``is_test`` marks the rows they have not seen.


def learnt(df):
    return df.where("not is_test")


@query("ml_random_forest_classifier")
def _(t):
    c = cut(X.stratified_split(company_table(t), "is_successful", "company_id"))
    scored, _ = T.fit_and_score(learnt(c), c, INPUTS, "is_successful")
    return scored.select("company_id", "is_successful", "is_test", "prediction", "score")


@query("ml_gbt_regressor")
def _(t):
    c = cut(X.stratified_split(company_table(t), "is_successful", "company_id"))
    model = M.boosted_regressor(learnt(c), INPUTS, "total_funding")
    return M.score(model, c).select("company_id", "total_funding", "is_test", "prediction")


def next_rounds(t, **kw):
    # Deals that have a next one are split; the last deal's next round is unknown and is scored as a test row.
    rows = X.next_round_examples(t.deals, t.companies, **kw).withColumn("_known", F.col("next_amount").isNotNull())
    return cut(X.stratified_split(rows, "_known", "id").withColumn("is_test", F.col("is_test") | ~F.col("_known")))


@query("ml_regressor_elastic_net")
def _(t):
    rows = next_rounds(t)
    model = M.elastic_net(learnt(rows), ROUND_INPUTS, "next_amount")
    return M.score(model, rows).select("id", "next_amount", "is_test", "prediction")


@query("ml_regressor_random_forest")
def _(t):
    rows = next_rounds(t, counted=True)
    model = G.fit(learnt(rows), [*ROUND_INPUTS, "previous_rounds"], "next_amount", "id", categories=ROUND_CATEGORIES)
    return G.predict(model, rows).select("id", "next_amount", "is_test", "prediction")


@query("ml_next_round_forecast", """
  WITH d AS (SELECT id, company_id, date FROM deals WHERE amount IS NOT NULL AND round_type IS NOT NULL)
  SELECT d.company_id, d.id AS last_deal, 1 AS scored FROM d JOIN companies c ON c.id = d.company_id
  QUALIFY row_number() OVER (PARTITION BY d.company_id ORDER BY date DESC, d.id DESC) = 1""")
def _(t):
    # The amount of each company's next round, from its latest deal; SQL checks which deal that is and that it has a number.
    rows = cut(X.next_round_examples(t.deals, t.companies).select("id", "company_id", *ROUND_INPUTS, "next_amount"))
    made = M.score(M.elastic_net(rows, ROUND_INPUTS, "next_amount"), rows.where("next_amount is null"))
    return made.select("company_id", F.col("id").alias("last_deal"), (F.isnotnull("prediction") & ~F.isnan("prediction")).cast("int").alias("scored"))


@query("ml_regressor_cross_validation", """
  WITH d AS (SELECT id, company_id, lead(amount) OVER (PARTITION BY company_id ORDER BY date, id) AS y FROM deals WHERE amount IS NOT NULL AND round_type IS NOT NULL)
  SELECT CAST(floor(('0x' || substr(md5('42#' || d.id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 5) AS INTEGER) AS fold, count(*) AS held_out, 1 AS finite
  FROM d JOIN companies c ON c.id = d.company_id WHERE y IS NOT NULL GROUP BY 1""")
def _(t):
    # Five folds by key hash: fitted on four, measured on the fifth; SQL checks the folds.
    rows = X.next_round_examples(t.deals, t.companies).where("next_amount is not null").select("id", *ROUND_INPUTS, "next_amount")
    folds = M.cross_validated(rows, "next_amount", "id", lambda part: M.elastic_net(part, ROUND_INPUTS, "next_amount"))
    return folds.select("fold", "held_out", (F.isnotnull("r2") & ~F.isnan("r2")).cast("int").alias("finite"))


@query("ml_next_round_rows", """
  WITH l AS (SELECT company_id, round_type AS current_round, count(*) OVER (PARTITION BY company_id) AS rounds FROM deals WHERE round_type IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY date DESC, id DESC) = 1)
  SELECT l.company_id, current_round, rounds, CASE current_round WHEN 'Pre-Seed' THEN 'Seed' WHEN 'Seed' THEN 'Series A' WHEN 'Series A' THEN 'Series B'
    WHEN 'Series B' THEN 'Series C' WHEN 'Series C' THEN 'Series D' WHEN 'Series D' THEN 'Series E' WHEN 'Series E' THEN 'Series F' WHEN 'Series F' THEN 'Series G'
    ELSE 'Unknown' END AS next_round, company_name, ecosystem_name, primary_tag FROM l JOIN companies c ON c.id = l.company_id""")
def _(t):
    return X.round_table(t.deals, t.companies)


@query("ml_next_round_examples", """
  WITH d AS (SELECT id, company_id, date, amount, round_type FROM deals WHERE amount IS NOT NULL AND round_type IS NOT NULL)
  SELECT id, d.company_id, amount, coalesce(lag(amount) OVER w, 0) AS previous_amount, lead(amount) OVER w AS next_amount FROM d
  WINDOW w AS (PARTITION BY d.company_id ORDER BY date, id)""", r3="amount previous_amount next_amount")
def _(t):
    return X.next_round_examples(t.deals, t.companies).select("id", "company_id", "amount", "previous_amount", "next_amount")


EVENT_INPUTS = ["hour", "weekday", "prev_event_type", "device_family"]


def next_events(t):
    return cut(X.stratified_split(M.next_event_rows(t.web_events), "event_type", "event_id"))


@query("ml_next_event_split", """
  WITH r AS (SELECT event_id, event_type FROM web_events QUALIFY count(*) OVER (PARTITION BY event_type) >= 5)
  SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY md5('42#' || event_id), event_id)
    <= round(count(*) OVER (PARTITION BY event_type) * 0.2::DOUBLE) AS INTEGER) AS is_test FROM r""")
def _(t):
    return next_events(t).select("event_id", "event_type", "is_test")


@query("ml_next_event_classifier")
def _(t):
    rows = next_events(t)
    model = B.fit(learnt(rows), EVENT_INPUTS, "event_type")
    return B.predict(model, rows).select("event_id", "event_type", "is_test", "prediction")


@query("ml_next_event_predict")
def _(t):
    rows = next_events(t)
    return B.top_classes(B.fit(learnt(rows), EVENT_INPUTS, "event_type"), rows, "event_id")


@query("ml_next_event_held_out")
def _(t):
    """Accuracy and log-loss of booster and forest, on rows they learnt from and on rows they have not seen."""
    rows = next_events(t)
    model = B.fit(learnt(rows), EVENT_INPUTS, "event_type")
    # Scores follow from the inputs: equal rows are scored, and learnt by the forest, as one.
    cells = cut(rows.groupBy(*EVENT_INPUTS, "event_type", "is_test").agg(F.count(F.lit(1)).alias("n")))
    boosted = B.log_loss(B.predict(model, cells), model.classes, "event_type", "is_test", weight="n").withColumn("model", F.lit("boosted trees"))
    scored, names = T.class_chances(cells, EVENT_INPUTS, "event_type", ~F.col("is_test"), "n")
    return boosted.unionByName(B.log_loss(B.likeliest(scored, names), names, "event_type", "is_test", weight="n").withColumn("model", F.lit("forest")))


@query("ml_kmeans_sessions")
def _(t):
    f = ["events", "mean_hour", "seconds"]
    rows = cut(X.standardize(S.session_features(t.web_events), f))
    model, _cost = M.kmeans(rows, [f"{c}_z" for c in f])
    labelled = M.assign(model, rows, [f"{c}_z" for c in f])
    stats = M.cluster_centres(labelled, f)
    return stats.join(K.mode_by(labelled, ["cluster"], "device_family"), "cluster").join(K.mode_by(labelled, ["cluster"], "country"), "cluster")


@query("ml_kmeans_users")
def _(t):
    wide = S.user_event_columns(t.web_events)
    kinds = [c for c in wide.columns if c != "user_id"]
    rows = cut(X.standardize(wide, kinds))
    model, _cost = M.kmeans(rows, [f"{c}_z" for c in kinds])
    sizes = M.cluster_centres(M.assign(model, rows, [f"{c}_z" for c in kinds]), kinds)
    long = K.unpivot(sizes, ["cluster", "size", "percent"], kinds, "event_type", "mean_events")
    return K.top_per_group(long, ["cluster"], 5, F.desc("mean_events"), F.asc("event_type"))


@query("ml_kmeans_market")
def _(t):
    c = X.company_features(t.companies_aged, t.deals)
    labelled, cost = M.market_clusters(c, "company_id", MARKET)
    quality = M.silhouette(labelled, [f"{f}_z" for f in MARKET])
    return M.cluster_centres(labelled, MARKET).withColumns({"inertia": F.lit(cost), "silhouette": F.lit(quality)})


# Cluster statistics for a given labelling (company id modulo 5), so that SQL can check the formulas.

GIVEN = f"""WITH {FUND}, z AS (SELECT CAST(company_id % 5 AS INTEGER) AS cluster, (total_funding - avg(total_funding) OVER ()) / stddev_pop(total_funding) OVER () AS f1,
    (deal_count - avg(deal_count) OVER ()) / stddev_pop(deal_count) OVER () AS f2 FROM fu),
  c AS (SELECT cluster, count(*) AS n, avg(f1) AS m1, avg(f2) AS m2 FROM z GROUP BY 1)"""


def given_clusters(t):
    f = ["total_funding", "deal_count"]
    c = X.standardize(X.company_funding(t.companies_aged, t.deals), f)
    return c.select((F.col("company_id") % 5).cast("int").alias("cluster"), F.col("total_funding_z").alias("f1"), F.col("deal_count_z").alias("f2"))


@query("ml_cluster_importance", GIVEN + """, b AS (SELECT sum(n * m1 * m1) AS b1, sum(n * m2 * m2) AS b2 FROM c)
  SELECT 'f1' AS feature, b1 / (b1 + b2) AS importance FROM b UNION ALL SELECT 'f2', b2 / (b1 + b2) FROM b""", r6="importance")
def _(t):
    return M.cluster_importance(given_clusters(t), ["f1", "f2"])


@query("ml_cluster_profiles", GIVEN + """, l AS (SELECT cluster, 'f1' AS feature, f1 AS v FROM z UNION ALL SELECT cluster, 'f2', f2 FROM z)
  SELECT cluster, feature, count(*) AS size, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max,
    100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY feature) AS percent FROM l GROUP BY 1, 2""", r6="mean std min max percent")
def _(t):
    return M.cluster_profiles(given_clusters(t), ["f1", "f2"])


@query("ml_cluster_metrics", GIVEN + """, d AS (SELECT cluster, sum((f1 - m1) ** 2 + (f2 - m2) ** 2) AS w, avg(sqrt((f1 - m1) ** 2 + (f2 - m2) ** 2)) AS s
    FROM z JOIN c USING (cluster) GROUP BY 1),
  p AS (SELECT a.cluster, max((da.s + db.s) / sqrt((a.m1 - b.m1) ** 2 + (a.m2 - b.m2) ** 2)) AS r FROM c a JOIN c b ON a.cluster <> b.cluster
    JOIN d da ON da.cluster = a.cluster JOIN d db ON db.cluster = b.cluster GROUP BY 1)
  SELECT (SELECT sum(w) FROM d) AS inertia, (SELECT sum(n * (m1 * m1 + m2 * m2)) / 4 FROM c) / ((SELECT sum(w) FROM d) / ((SELECT count(*) FROM z) - 5)) AS calinski_harabasz,
    (SELECT avg(r) FROM p) AS davies_bouldin,
    (SELECT avg((b - a) / greatest(a, b)) FROM (SELECT i, max(CASE WHEN own THEN q END) AS a, min(CASE WHEN NOT own THEN q END) AS b FROM (
      SELECT z.i, z.cluster = c.cluster AS own, (f1 * f1 + f2 * f2 - 2 * (f1 * m1 + f2 * m2) + sq) * CASE WHEN z.cluster = c.cluster THEN n / (n - 1.0::DOUBLE) ELSE 1 END AS q
      FROM (SELECT *, row_number() OVER () AS i FROM z) z CROSS JOIN (SELECT cluster, count(*) AS n, avg(f1) AS m1, avg(f2) AS m2, avg(f1 * f1 + f2 * f2) AS sq FROM z GROUP BY 1) c)
      GROUP BY 1)) AS silhouette""", r4="inertia calinski_harabasz davies_bouldin silhouette")
def _(t):
    labelled, f = given_clusters(t), ["f1", "f2"]
    return M.cluster_quality(labelled, f).withColumn("silhouette", F.lit(M.silhouette(labelled, f)))


SCORED = """sc AS (SELECT id, CASE WHEN amount > 1e6 THEN 1 ELSE 0 END AS label, (id * 37 % 101) / 101.0::DOUBLE + (CASE WHEN amount > 1e6 THEN 0.2::DOUBLE ELSE 0 END) AS score FROM deals)"""


@query("ml_classification_metrics", f"""WITH {SCORED}, p AS (SELECT label, CASE WHEN score > 0.6 THEN 1 ELSE 0 END AS pred, score FROM sc),
  k AS (SELECT count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn,
    count(*) FILTER (label = pred) AS hits, count(*) AS n FROM p),
  r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM p)
  SELECT hits / n::DOUBLE AS accuracy, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1,
    (SELECT (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE)
      / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) FROM r) AS auc FROM k""", r6="accuracy precision recall f1 auc")
def _(t):
    label = F.when(F.col("amount") > 1e6, 1).otherwise(0)
    d = t.deals.select("id", label.alias("label"), ((F.col("id") * 37 % 101) / 101.0 + F.when(label == 1, 0.2).otherwise(0.0)).alias("score"))
    return M.classification_metrics(d.withColumn("prediction", F.when(F.col("score") > 0.6, 1).otherwise(0)))


@query("ml_regression_metrics", """
  WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500.0::DOUBLE AS yhat FROM lineitem)
  SELECT avg((y - yhat) ** 2) AS mse, sqrt(avg((y - yhat) ** 2)) AS rmse, avg(abs(y - yhat)) AS mae, 1 - avg((y - yhat) ** 2) / var_pop(y) AS r2,
    avg(abs((y - yhat) / nullif(y, 0))) * 100 AS mape FROM p""", r1="mse", r4="rmse mae r2 mape")
def _(t):
    d = t.base("lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500.0).alias("prediction"))
    return M.regression_metrics(d)


@query("ml_confusion_matrix", """SELECT event_type AS actual, prev AS predicted, count(*) AS n FROM (
  SELECT event_type, lag(event_type) OVER (PARTITION BY session_id ORDER BY event_time, event_id) AS prev FROM web_events) WHERE prev IS NOT NULL GROUP BY 1, 2""")
def _(t):
    # The previous event as the prediction of the next.
    e = Q.preceding(t.web_events, ["session_id"], Q.ORDER, ["event_type"])
    return M.confusion_matrix(e.select(F.col("event_type").alias("actual"), F.col("prev_event_type").alias("predicted")), "actual", "predicted")


@query("ml_feature_importance")
def _(t):
    return T.importances(company_table(t), INPUTS, "is_successful", "company_id")


@query("ml_model_persistence")
def _(t):
    c = company_table(t)
    model = M.elastic_net(c, INPUTS, "total_funding")
    path = f"{checkpoint_dir(t.spark)}/models/{uuid.uuid4().hex}"
    M.save(model, path)
    before = M.score(model, c).select("company_id", F.col("prediction").alias("saved"))
    return M.score(M.load(path), c).select("company_id", "prediction").join(before, "company_id")


def coded_segments(t):
    coded = X.label_index(t.web_events, ["event_type"])
    return cut(H.segments(coded, "event_type_index", seconds=86400))


@query("ml_hmm_em")
def _(t):
    model = H.fit(coded_segments(t))
    return H.parameters(model, t.spark)


@query("ml_hmm_decode")
def _(t):
    segs = coded_segments(t)
    return H.decode(segs, H.fit(segs))


@query("ml_hmm_next_events")
def _(t):
    """Next event types of every session, ranked from its last state."""
    segs = coded_segments(t)
    names = X.label_index(t.web_events, ["event_type"]).select("event_type", F.col("event_type_index").cast("int").alias("code")).distinct()
    ranked = H.next_of_sessions(segs, H.fit(segs), names.count())
    return ranked.join(F.broadcast(names), "code").select("session_id", "state", "rank", "event_type", "prob")


# Forecasts.

NAMED = MONTHLY.replace("ser AS (SELECT primary_tag,", "ser AS (SELECT primary_tag AS series,")


def monthly(t):
    return cut(Y.series_key(sector_series(t), ["primary_tag"]))


@query("fc_acf", f"""
  WITH {NAMED}, i AS (SELECT series, value - avg(value) OVER (PARTITION BY series) AS d, row_number() OVER (PARTITION BY series ORDER BY bucket) AS i,
    count(*) OVER (PARTITION BY series) AS n FROM ser)
  SELECT a.series, CAST(k AS INTEGER) AS lag, sum(a.d * b.d) / max(v.v) AS acf FROM range(0, 41) r(k) CROSS JOIN i a JOIN i b ON a.series = b.series AND a.i = b.i + k
  JOIN (SELECT series, sum(d * d) AS v FROM i GROUP BY 1) v ON v.series = a.series WHERE k <= floor(a.n * 0.4) GROUP BY 1, 2""", r6="acf")
def _(t):
    return Y.acf(monthly(t))


@query("fc_pacf_order")
def _(t):
    return Y.orders(Y.acf(monthly(t)))


@query("fc_stationarity", f"""
  WITH {NAMED}, s AS (SELECT series, lag(value) OVER w AS x, value - lag(value) OVER w AS y FROM ser WINDOW w AS (PARTITION BY series ORDER BY bucket)),
  f AS (SELECT series, count(*) AS n, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, var_pop(y) * count(*) AS syy, var_pop(x) * count(*) AS sxx FROM s WHERE x IS NOT NULL GROUP BY 1)
  SELECT series, n, slope, slope / sqrt((1 - r2) * syy / (n - 2) / sxx) AS t, CASE WHEN slope / sqrt((1 - r2) * syy / (n - 2) / sxx) < -2.86 THEN 0 ELSE 1 END AS d FROM f""",
       r6="slope t")
def _(t):
    return Y.stationarity(monthly(t))


@query("fc_unit_root")
def _(t):
    return Y.unit_root(monthly(t))


@query("fc_ar_fit")
def _(t):
    f = Y.ar_fit(monthly(t))
    return f.withColumns({"ar": F.array_join(F.transform("ar", lambda x: F.format_number(x, 4)), ","), "ma": F.array_join(F.transform("ma", lambda x: F.format_number(x, 4)), ",")})


@query("fc_ar_forecast")
def _(t):
    return Y.ar_forecast(monthly(t), horizon=12)


def hourly(t):
    e = t.base("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return Y.series_key(R.bucketed(e, "ts", "value", step="hour", keys=["event_type"]), ["event_type"])


@query("fc_seasonal_trend")
def _(t):
    return Y.seasonal_trend(hourly(t)).where("kind <> 'changepoint'")


@query("fc_changepoints")
def _(t):
    return Y.changepoints(Y.seasonal_trend(hourly(t)))


@query("fc_growth_peaks", f"""
  WITH {NAMED}, g AS (SELECT series, 100 * (arg_max(value, bucket) - arg_min(value, bucket)) / nullif(arg_min(value, bucket), 0) AS growth FROM ser GROUP BY 1),
  r AS (SELECT series, bucket, value, CAST(row_number() OVER (PARTITION BY series ORDER BY value DESC, bucket) AS INTEGER) AS rank FROM ser)
  SELECT r.*, growth FROM r JOIN g USING (series) WHERE rank <= 3""", r4="value growth")
def _(t):
    return Y.growth_and_peaks(monthly(t), "value")


@query("fc_lagged_regression")
def _(t):
    windows = cut(R.trailing_windows(sector_series(t), ["primary_tag"], full=True))
    _model, rows = Y.lagged_regression(windows)
    return rows.select("primary_tag", "bucket", "target", "prediction")


@query("fc_month_forecast_table")
def _(t):
    from dealflux.operators.joins import deals_with_companies

    s = R.bucketed(deals_with_companies(t.deals, t.companies), "date", "amount", keys=["ecosystem_name"]).withColumn("bucket", F.to_date("bucket"))
    deals = s.select("ecosystem_name", "bucket", F.col("n").cast("double").alias("value"))
    return Y.forecast_table(Y.series_key(s, ["ecosystem_name"]), Y.series_key(deals, ["ecosystem_name"]))
