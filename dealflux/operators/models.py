"""Model fitting and scoring with MLlib on DataFrames of features."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealflux.functions import columns as C
from dealflux.operators.features import standardize
from dealflux.plans import kernels as K
from dealflux.plans.ordered import neighbours
from dealflux.session import checkpoint_dir, cut

SEED = 42
#: Independent fits that run at the same time.
PARALLEL_FITS = 10


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def complete(df: DataFrame, features: Sequence[str]) -> Column:
    """Whether a row has all features (those of them that are columns of ``df``), none null or NaN.

    Fits learn from complete rows; scores keep the others with a null prediction. Impute before, where a value is wanted.
    """
    kinds = dict(df.dtypes)
    ok = F.lit(True)
    for c in features:
        if c in kinds:
            ok = ok & F.col(f"`{c}`").isNotNull()
            if kinds[c] in ("double", "float"):
                ok = ok & ~F.isnan(f"`{c}`")
    return ok


def transformed(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The model's columns beside every row of ``df``; null on incomplete rows."""
    ok = complete(df, features)
    return model.transform(df.where(ok)).unionByName(df.where(~ok), allowMissingColumns=True)


def inputs(model: PipelineModel) -> list[str]:
    return next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()


def one_hot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds <c>_onehot vectors, categories in alphabetical order."""
    index = StringIndexer(
        inputCols=list(columns), outputCols=[f"{c}_i" for c in columns], stringOrderType="alphabetAsc", handleInvalid="keep"
    )
    encode = OneHotEncoder(inputCols=[f"{c}_i" for c in columns], outputCols=[f"{c}_onehot" for c in columns], dropLast=True)
    return Pipeline(stages=[index, encode]).fit(df).transform(df).drop(*[f"{c}_i" for c in columns])


def random_forest_classifier(df: DataFrame, features: Sequence[str], label: str, *, trees: int = 100, depth: int = 30) -> PipelineModel:
    checkpoint_dir(df.sparkSession)
    forest = RandomForestClassifier(
        labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=SEED, checkpointInterval=10, minInstancesPerNode=1
    )
    return Pipeline(stages=[assembler(features), forest]).fit(df.where(complete(df, [*features, label])))


def random_forest_regressor(df: DataFrame, features: Sequence[str], label: str, *, trees: int = 100, depth: int = 10) -> PipelineModel:
    forest = RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED)
    return Pipeline(stages=[assembler(features), forest]).fit(df.where(complete(df, [*features, label])))


def boosted_regressor(
    df: DataFrame, features: Sequence[str], label: str, *, rounds: int = 100, depth: int = 6, step: float = 0.1,
    rows: float = 0.8, columns: float = 0.8,
) -> PipelineModel:
    """Gradient boosted trees with row and column subsampling."""
    checkpoint_dir(df.sparkSession)
    trees = GBTRegressor(
        labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=rows,
        featureSubsetStrategy=str(columns), seed=SEED, checkpointInterval=10,
    )
    return Pipeline(stages=[assembler(features), trees]).fit(df.where(complete(df, [*features, label])))


def elastic_net(df: DataFrame, features: Sequence[str], label: str, *, penalty: float = 0.1, mix: float = 0.5) -> PipelineModel:
    line = LinearRegression(labelCol=label, regParam=penalty, elasticNetParam=mix)
    return Pipeline(stages=[assembler(features), line]).fit(df.where(complete(df, [*features, label])))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predictions beside every row, without vector columns; ``score`` is the probability of class 1.

    A row that lacks a feature has a null prediction.
    """
    out = transformed(model, df, inputs(model))
    if "probability" in out.columns:
        out = out.withColumn("score", F.get(vector_to_array("probability"), 1))
    return out.drop("features", "rawPrediction", "probability")


def feature_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Impurity importance per feature, ranked."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    rows = sorted(zip(features, values), key=lambda r: -r[1])
    return spark.createDataFrame([(n, v, i + 1) for i, (n, v) in enumerate(rows)], "feature string, importance double, rank int")


def successors(df: DataFrame, features: Sequence[str], label: str, key: str, seed: int = SEED) -> DataFrame:
    """key, label and features of every row, and as ``_other`` the features of its successor in seeded hash order."""
    order = df.select(key, label, *features).withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_all", F.lit(1))
    wide = neighbours(order, ["_all"], ["_h", key], list(features), n=1, chunk=F.shiftright("_h", 48), out="_next")
    return wide.withColumn("_other", F.coalesce(F.get("_next", 0), F.struct(*features)))


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str, key: str, seed: int = SEED) -> DataFrame:
    """Loss of accuracy when one feature's values move to the next row in hash order.

    One pass finds every row's successor in the seeded order; each feature then swaps in the
    successor's value and the rows are scored again.
    """
    wide = successors(df, features, label, key, seed)
    base = model.transform(wide.select(key, label, *features)).agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("base_accuracy"))
    result = None
    for f in features:
        moved = wide.withColumn(f, F.col(f"_other.{f}")).select(key, label, *features)
        hit = F.avg((F.col("prediction") == F.col(label)).cast("double"))
        row = model.transform(moved).agg(hit.alias("accuracy")).withColumn("feature", F.lit(f))
        result = row if result is None else result.unionByName(row)
    return result.withColumn("base_accuracy", base.scalar()).withColumn("importance", F.col("base_accuracy") - F.col("accuracy"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# Next event.


def next_event_rows(df: DataFrame, min_rows: int = 5) -> DataFrame:
    """Hour, weekday, previous event and device of each event, for classes with enough rows."""
    from dealflux.operators.filters import min_group_size
    from dealflux.operators.sequences import prev_event

    rows = min_group_size(prev_event(df), "event_type", min_rows - 1)
    return rows.select(
        "event_id", "event_type", "prev_event_type", F.coalesce("device_family", F.lit("Unknown")).alias("device_family"),
        F.hour("event_time").alias("hour"), F.weekday("event_time").alias("weekday"),
    )


def next_event_classifier(rows: DataFrame, *, trees: int = 50, depth: int = 6) -> PipelineModel:
    """Forest over next-event rows; the first stage keeps the class names.

    Trees take as many bins as the largest dictionary has entries, so any number of event types fits.
    """
    label = StringIndexer(inputCol="event_type", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)
    indexed = StringIndexer(
        inputCols=["prev_event_type", "device_family"], outputCols=["prev_i", "device_i"], stringOrderType="alphabetAsc", handleInvalid="keep"
    ).fit(rows)
    bins = max(32, *[len(names) + 1 for names in indexed.labelsArray])
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, maxBins=bins)
    stages = [label, indexed, assembler(["hour", "weekday", "prev_i", "device_i"]), forest]
    return Pipeline(stages=stages).fit(rows)


def top_classes(model: PipelineModel, rows: DataFrame, key: str, top: int = 5) -> DataFrame:
    """The most probable classes of each row, ranked inside the row (no shuffle)."""
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    ranked = F.sort_array(F.transform(vector_to_array("probability"), lambda p, i: F.struct((-p).alias("m"), i.alias("i"))))
    wide = model.transform(rows).select(key, F.posexplode(F.slice(ranked, 1, top)).alias("_r", "_c"))
    return wide.select(key, (F.col("_r") + 1).alias("rank"), F.get(labels, F.col("_c.i")).alias("event"), (-F.col("_c.m")).alias("prob"))


# Clusters.


def kmeans(df: DataFrame, features: Sequence[str], *, k: int = 5, seeds: int = 10, max_iter: int = 300, tol: float = 1e-4):
    """Best of several seeded fits on ``features``; returns (model, its cost).

    A round is a short job, and rows as narrow as these make few tasks: the fits run side by side. Each fit keeps the
    vectors and norms that its rounds read; ``df`` should be persisted or checkpointed.
    """
    data = assembler(features).transform(df.where(complete(df, features))).select("features")

    def seeded(i: int):
        return KMeans(k=k, seed=SEED + i, maxIter=max_iter, tol=tol, initMode="k-means||").fit(data)

    data.count()  # a persisted ``df`` is stored before the fits share it
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        fits = list(pool.map(inheritable_thread_target(df.sparkSession)(seeded), range(seeds)))
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best, best.summary.trainingCost


def assign(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``cluster`` of every row; null on rows that lack a feature."""
    both = PipelineModel(stages=[assembler(features), model])
    return transformed(both, df, features).withColumnRenamed("prediction", "cluster").drop("features")


def silhouette(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> float:
    data = assembler(features).transform(df.where(complete(df, [*features, cluster]))).select("features", F.col(cluster).cast("double").alias("prediction"))
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(data)


def market_clusters(rows: DataFrame, key: str, features: Sequence[str], *, k: int = 5, seeds: int = 10):
    """Winsorise, impute, scale and cluster; returns the labelled rows (raw and scaled) and the cost."""
    from dealflux.operators.features import impute, winsor_bounds, winsorize

    kept = winsorize(rows, winsor_bounds(rows, features), features)
    scaled = standardize(impute(kept, features, "mean"), features).persist()
    zs = [f"{f}_z" for f in features]
    model, cost = kmeans(scaled, zs, k=k, seeds=seeds)
    return assign(model, scaled, zs).select(key, "cluster", *features, *zs), cost


def cluster_centres(labelled: DataFrame, features: Sequence[str]) -> DataFrame:
    """Size, percent and centre (original units) of each cluster."""
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *[F.avg(f).alias(f) for f in features])
    return K.share_of(sizes, "size", (), "percent")


def cluster_importance(labelled: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share of the between-cluster variance carried by each feature."""
    long = K.unpivot(labelled.select("cluster", *[F.col(f).cast("double").alias(f) for f in features]), ["cluster"], features, "feature", "value")
    cells = long.groupBy("feature", "cluster").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.sum("value").alias("s"))
    means = cells.groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("g"))
    between = cells.join(means, "feature").groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("between"))
    return K.share_of(between, "between", (), "importance").select("feature", (F.col("importance") / 100.0).alias("importance"))


def cluster_profiles(labelled: DataFrame, features: Sequence[str]) -> DataFrame:
    """Size, percent and mean, population spread, least and greatest value per cluster and feature."""
    long = K.unpivot(labelled.select("cluster", *[F.col(f).cast("double").alias(f) for f in features]), ["cluster"], features, "feature", "value")
    stats = long.groupBy("cluster", "feature").agg(
        F.count("value").alias("size"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    return K.share_of(stats, "size", ["feature"], "percent")


def cluster_quality(labelled: DataFrame, features: Sequence[str]) -> DataFrame:
    """Inertia, Calinski-Harabasz and Davies-Bouldin over scaled features.

    Distances are taken to cluster means held in one array (clusters x features numbers).
    """
    fs = list(features)
    centres = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(f) for f in fs]).alias("c"))
    sq = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    point = labelled.select("cluster", F.array(*[F.col(f).cast("double") for f in fs]).alias("x"))
    spread = (
        point.join(centres, "cluster")
        .groupBy("cluster", "n", "c")
        .agg(F.sum(sq("x", "c")).alias("w"), F.avg(F.sqrt(sq("x", "c"))).alias("s"))
    )
    whole = labelled.select(F.array(*[F.avg(f) for f in fs])).scalar()
    table = spread.agg(
        F.collect_list(F.struct("cluster", "c", "s")).alias("cs"), F.sum("w").alias("inertia"),
        F.collect_list(F.struct("n", "c")).alias("nc"),
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
    ).withColumn("_g", whole)
    between = F.aggregate("nc", F.lit(0.0), lambda s, r: s + r["n"] * sq(r["c"], F.col("_g")))
    worst = F.transform(
        "cs",
        lambda a: F.array_max(
            F.transform(
                F.filter("cs", lambda b: b["cluster"] != a["cluster"]),
                lambda b: F.try_divide(a["s"] + b["s"], F.sqrt(sq(a["c"], b["c"]))),
            )
        ),
    )
    davies = F.aggregate(worst, F.lit(0.0), lambda s, v: s + v) / F.col("k")
    return table.select(
        "inertia",
        C.ratio(between / (F.col("k") - 1), F.col("inertia") / (F.col("n") - F.col("k"))).alias("calinski_harabasz"),
        davies.alias("davies_bouldin"),
    )


# Metrics over scored rows.


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", score: str = "score") -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC of a binary prediction.

    AUC counts, for each distinct score, the negatives below it. Scores are ranked inside score
    buckets and the buckets' totals give the offsets, so no single task orders all scores.
    """
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count(F.lit(1)).alias("n"),
        F.count_if(y == p).alias("hits"),
    )
    per = df.groupBy(F.col(score).alias("_s")).agg(F.count_if(y).alias("_p"), F.count_if(~y).alias("_n")).withColumn("_b", F.floor(F.col("_s") * 4096))
    buckets = per.groupBy("_b").agg(F.sum("_n").alias("_t"))
    below = Window.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("_b", F.coalesce(F.sum("_t").over(below), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.withColumn("_l", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, "_b")
    wins = F.sum(F.col("_p") * (F.col("_o") + F.col("_l") + F.col("_n") / 2.0))
    auc = K.scalar(ranked, C.ratio(wins, F.sum("_p") * F.sum("_n")))
    precision, recall = C.ratio("tp", F.col("tp") + F.col("fp")), C.ratio("tp", F.col("tp") + F.col("fn"))
    return counts.select(
        C.ratio("hits", "n").alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        C.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), auc.alias("auc"),
    )


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MSE, RMSE, MAE, R2 and MAPE (rows with a zero label leave MAPE out)."""
    e = F.col(label) - F.col(prediction)
    sums = df.agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(label).alias("_v"),
        (F.avg(F.abs(F.try_divide(e, F.col(label)))) * 100).alias("mape"),
    )
    return sums.select("mse", F.sqrt("mse").alias("rmse"), "mae", (1 - C.ratio("mse", "_v")).alias("r2"), "mape")


def cross_validated(df: DataFrame, label: str, key: str, fit, folds: int = 5, seed: int = SEED) -> DataFrame:
    """Errors of each fold under a model fitted on the others: fold, held_out, mse, rmse, mae, r2, mape.

    Folds follow a hash of the key; the rows are stored once, as every fold reads them again. Their mean and spread are the usual cross-validated figures (``spread_of``).
    """
    placed = cut(df.withColumn("fold", F.floor(K.hash_share(F.col(key), seed) * folds).cast("int")))
    out = None
    for i in range(folds):
        held = score(fit(placed.where(F.col("fold") != i)), placed.where(F.col("fold") == i))
        row = regression_metrics(held, label).withColumn("fold", F.lit(i))
        row = row.join(held.agg(F.count(F.lit(1)).alias("held_out")).withColumn("fold", F.lit(i)), "fold")
        out = row if out is None else out.unionByName(row)
    return out.where("held_out > 0")


def spread_of(folds: DataFrame, measure: str = "r2") -> DataFrame:
    """Mean and standard deviation of a measure over folds."""
    return folds.agg(F.avg(measure).alias("mean"), F.stddev_pop(measure).alias("std"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return K.aggregate_by(df, [actual, predicted], n=F.count(F.lit(1)))
