"""Company features, dense ids, scaling, imputation and other inputs of models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealflux.functions import columns as C
from dealflux.functions import vocab as V
from dealflux.operators.near import nearest
from dealflux.plans import kernels as K
from dealflux.plans.ordered import chunk_of, earlier_rows, neighbours
from dealflux.session import cut


def company_funding(companies: DataFrame, deals: DataFrame) -> DataFrame:
    """Total, count and mean funding of every company, zero without deals.

    Deals are aggregated before the join, so the join carries one row per company.
    """
    sums = K.aggregate_by(
        deals, ["company_id"], total_funding=C.total("amount"), deal_count=F.count("amount"), avg_deal_size=C.exact_mean("amount")
    )
    return (
        companies.withColumnRenamed("id", "company_id")
        .join(sums, "company_id", "left")
        .fillna({"total_funding": 0.0, "deal_count": 0, "avg_deal_size": 0.0})
    )


def funding_threshold(funding: DataFrame, *, col: str = "total_funding", threshold: str = "max") -> DataFrame:
    """One-row table with the overall maximum or the exact median."""
    if threshold == "max":
        return funding.agg(F.max(col).alias("threshold"))
    return K.exact_percentiles(funding, [], col, {"threshold": 0.5})


def name_ids(df: DataFrame, column: str, out: str) -> DataFrame:
    """0-based id of each row's value in name order (a dense rank without a global window)."""
    ids = K.range_rank(df, column, out)
    return df.join(ids, column, "left")


def appearance_ids(df: DataFrame, column: str, order: str, out: str) -> DataFrame:
    """0-based id by first appearance in ``order``; null values get -1."""
    firsts = K.aggregate_by(df, [column], _first=F.min(order))
    ids = K.range_rank(firsts, "_first", out)
    numbered = firsts.join(ids, "_first").select(column, out)
    return df.join(numbered, column, "left").fillna({out: -1})


def company_features(companies: DataFrame, deals: DataFrame) -> DataFrame:
    """Age, ecosystem and sector ids, and funding of each company."""
    rows = company_funding(companies, deals)
    rows = name_ids(rows, "ecosystem_name", "ecosystem_id")
    rows = name_ids(rows, "primary_tag", "primary_tag_id")
    return rows.select("company_id", "age", "ecosystem_id", "primary_tag_id", "total_funding", "deal_count", "avg_deal_size")


def label_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Alphabetical codes <c>_index; null becomes the text "Unknown" first."""
    for c in columns:
        df = name_ids(df.withColumn(c, F.coalesce(F.col(c), F.lit(V.UNKNOWN))), c, f"{c}_index")
    return df


def impute(df: DataFrame, columns: Sequence[str], strategy: str = "median") -> DataFrame:
    """Fill nulls with the column's median, mean or most frequent value, all taken from ``df``."""
    columns = list(columns)
    if strategy == "mean":
        fills = df.agg(*[F.avg(c).alias(c) for c in columns])
    elif strategy == "median":
        long = K.unpivot(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), [], columns, "column_name", "fill")
        found = K.exact_percentiles(long, ["column_name"], "fill", {"middle": 0.5}, bounded=True)
        fills = found.agg(*[F.max(F.when(F.col("column_name") == c, F.col("middle"))).alias(c) for c in columns])
    elif strategy == "most_frequent":
        long = K.unpivot(df.select(*[F.col(c).cast("string").alias(c) for c in columns]), [], columns, "column_name", "fill")
        found = K.mode_by(long, ["column_name"], "fill")
        fills = found.agg(*[F.max(F.when(F.col("column_name") == c, F.col("fill"))).cast(df.schema[c].dataType).alias(c) for c in columns])
    else:
        raise ValueError(f"unknown strategy {strategy}")
    wide = df.withColumn("_f", fills.select(F.struct(*columns)).scalar())
    return wide.withColumns({c: F.coalesce(F.col(c), F.col(f"_f.{c}")) for c in columns}).drop("_f")


def standardize(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / population standard deviation; a constant column gives 0."""
    stats = [s for c in columns for s in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    wide = df.withColumn("_s", df.select(F.struct(*stats)).scalar())
    scaled = {
        f"{c}{suffix}": F.when(F.col(f"_s.s_{c}") > 0, (F.col(c) - F.col(f"_s.m_{c}")) / F.col(f"_s.s_{c}")).when(
            F.col(c).isNotNull(), F.lit(0.0)
        )
        for c in columns
    }
    return wide.withColumns(scaled).drop("_s")


def winsor_bounds(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Fitted clamp bounds, one row per column, from finite values."""
    finite = df.select(*[F.when(~F.col(c).cast("double").isin(float("inf"), float("-inf")), F.col(c).cast("double")).alias(c) for c in columns])
    long = K.unpivot(finite, [], list(columns), "column_name", "value")
    q = K.exact_percentiles(long, ["column_name"], "value", {"q1": 0.25, "q3": 0.75}, bounded=True)
    spread = factor * (F.col("q3") - F.col("q1"))
    return q.select("column_name", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))


def winsorize(df: DataFrame, bounds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Clamp columns to fitted bounds; infinite values become null."""
    ends = K.scalar(bounds, F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("low", "high")))))
    clamped = {}
    for c in columns:
        v, b = F.col(c).cast("double"), F.try_element_at("_b", F.lit(c))
        finite = F.when(~v.isin(float("inf"), float("-inf")), v)
        clamped[c] = F.when(finite.isNotNull(), F.least(F.greatest(finite, b["low"]), b["high"]))
    return df.withColumn("_b", ends).withColumns(clamped).drop("_b")


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Mark each row ``is_test`` so that every class gives the fraction, rounded to a row.

    Rows of a class stand in order of a seeded MD5 of their key (ties by the key), so the split does not
    depend on partitioning. Counts of 4,096 hash buckets per class show in which bucket the fraction is
    reached; ranks are taken inside buckets only. A null label is a class of its own.
    """
    order = F.md5(F.concat(F.lit(f"{seed}#"), F.col(key).cast("string")))
    rows = df.withColumns({"_h": order, "_b": F.coalesce(F.substring(order, 1, 3), F.lit(""))})
    sizes = rows.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_bb")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("_l")
    sizes = sizes.withColumns({
        "_before": F.coalesce(F.sum("_n").over(group.orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_wanted": F.round(F.sum("_n").over(group) * test_fraction),
    })
    placed = rows.join(sizes, rows[label].eqNullSafe(sizes["_l"]) & (rows["_b"] == sizes["_bb"]))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_l", "_bb").orderBy("_h", key))
    return placed.withColumn("is_test", rank <= F.col("_wanted")).select(*df.columns, "is_test")


def round_table(deals: DataFrame, companies: DataFrame) -> DataFrame:
    """Per company: latest round, the round that follows it in order (else Unknown), place and sector."""
    known = deals.where("round_type is not null")
    last = known.groupBy("company_id").agg(
        F.max(F.struct("date", "id", "round_type")).getField("round_type").alias("current_round"), F.count(F.lit(1)).alias("rounds")
    )
    following = dict(zip(V.ROUND_ORDER, V.ROUND_ORDER[1:]))
    rows = last.withColumn("next_round", C.lookup("current_round", following, V.UNKNOWN))
    who = companies.select(F.col("id").alias("company_id"), "company_name", "ecosystem_name", "primary_tag")
    return rows.join(who, "company_id")


def next_round_examples(deals: DataFrame, companies: DataFrame, *, counted: bool = False) -> DataFrame:
    """One row per deal with the company's next deal amount as label and its history as features.

    ``counted`` adds previous_rounds, the number of the company's earlier rounds, of unknown amount too.
    """
    week = chunk_of("date", 7 * 86400)
    d = deals.where("round_type is not null")
    if counted:
        d = earlier_rows(d, ["company_id"], ["date", "id"], chunk=week, out="previous_rounds")
    d = d.where("amount is not null")
    d = d.withColumn("round_ordinal", F.coalesce(C.ordinal("round_type", V.ROUND_ORDER), F.lit(0)))
    wide = neighbours(d, ["company_id"], ["date", "id"], ["amount"], n=1, chunk=week, out="_next")
    wide = neighbours(wide, ["company_id"], ["date", "id"], ["amount"], n=1, backwards=True, chunk=week, out="_prev")
    who = companies.select(F.col("id").alias("company_id"), "ecosystem_name", "primary_tag", "date_founded")
    return wide.join(who, "company_id").select(
        "id", "company_id", "round_ordinal", "amount",
        F.coalesce(F.get("_prev", 0).getField("amount"), F.lit(0.0)).alias("previous_amount"),
        F.coalesce(C.years_between("date_founded", "date"), F.lit(0.0)).alias("age_at_deal"),
        F.weekday("date").alias("weekday"), F.month("date").alias("month"),
        "ecosystem_name", F.split("primary_tag", "-")[0].alias("sector_group"),
        F.get("_next", 0).getField("amount").alias("next_amount"),
        *(["previous_rounds"] if counted else []),
    )


def smote(df: DataFrame, label: str, key: str, features: Sequence[str], *, k: int = 5, seed: int = 42) -> DataFrame:
    """Rows plus synthetic minority rows that balance two classes exactly.

    A synthetic row lies between a minority row and one of its ``k`` nearest minority rows over the scaled
    features (see ``near``), so that no pairs inside a class are enumerated. Synthetic rows have
    ``is_synthetic`` = 1 and keep the key of the row they start from.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    small = K.scalar(counts, F.min(F.struct("_n", label)))
    large = K.scalar(counts, F.max("_n"))
    rows = df.select(key, label, *features).withColumns({"_small": small, "_large": large})
    minority = rows.where(F.col(label) == F.col(f"_small.{label}"))
    scaled = standardize(minority, features, "_z")
    close = nearest(scaled, key, [f"{f}_z" for f in features], k, payload=features, seed=seed)
    # Stored once: the ranks below and the copies both read it.
    near = cut(minority.join(close.select(key, F.col("near.payload").alias("_after")), key, "left"))

    # Every minority row makes the same number of copies; the remainder goes to the first rows in hash order.
    hashed = near.withColumn("_h", F.struct(F.xxhash64(F.lit(seed), key).alias("h"), F.col(key).alias("k")))
    order = K.range_rank(hashed, "_h", "_rank")
    missing = F.col("_large") - F.col("_small._n")
    each = F.expr("(_large - _small._n) div _small._n")
    extra = F.when(F.col("_rank") < missing - each * F.col("_small._n"), 1).otherwise(0)
    grown = hashed.join(order, "_h").withColumn("_copies", each + extra).where(F.col("_copies") > 0)
    grown = grown.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    pick = F.pmod(F.xxhash64(F.lit(seed + 1), key, "_c"), F.greatest(F.coalesce(F.size("_after"), F.lit(0)), F.lit(1)))
    grown = grown.withColumn("_near", F.get("_after", pick.cast("int"))).withColumn(
        "_u", F.pmod(F.xxhash64(F.lit(seed + 2), key, "_c"), F.lit(1 << 20)) / float(1 << 20)
    )
    mixed = [
        (F.col(f) + F.col("_u") * (F.coalesce(F.col(f"_near.{f}"), F.col(f)) - F.col(f))).cast("double").alias(f) for f in features
    ]
    made = grown.select(key, label, *mixed, F.lit(1).alias("is_synthetic"))
    kept = df.select(key, label, *[F.col(f).cast("double").alias(f) for f in features], F.lit(0).alias("is_synthetic"))
    return kept.unionByName(made)
