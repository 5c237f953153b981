"""The two data models as views over the supplied tables.

``Tables`` hands out base tables and, built from them, the deal star schema and the web event log.
Every column is a deterministic expression, so that the same rows can be written in plain SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflux.functions.vocab import ROUND_ORDER
from dealflux.plans.ordered import sessionize

AS_OF = "2002-01-01"
FIRST_YEAR, LAST_YEAR = 1995, 2000
ROUNDS = [*ROUND_ORDER, "Series ?", "Grant"]
DEVICES = ["Windows", "Mac OS X", "Linux", "Windows", "iOS", "Android"]
LANGUAGES = ["English", "Polish", "Spanish", "English"]
INVESTOR_TYPES = ["VC", "Angel", "Corporate"]


# Column types of the supplied tables, so that no scan starts by reading a footer.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz,
        o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def null_every(c, key, n):
    return F.when(F.col(key) % n != 0, c)


class Tables:
    """Base tables and adapter views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def base(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
        return reader.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def places(self) -> DataFrame:
        nation, region = self.base("nation"), self.base("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            "n_nationkey", "n_name", "r_name"
        )

    @cached_property
    def companies(self) -> DataFrame:
        c = self.base("customer").join(self.places, F.col("c_nationkey") == F.col("n_nationkey"))
        key = F.col("c_custkey")
        tag = lambda k: F.concat_ws("-", "c_mktsegment", (k % 4).cast("string"))
        founded = F.date_add(F.lit("1985-01-01").cast("date"), ((key * 37) % 3650).cast("int"))
        return c.select(
            key.alias("id"),
            F.col("c_name").alias("company_name"),
            tag(key).alias("primary_tag"),
            null_every(tag(key + 1), "c_custkey", 7).alias("secondary_tag"),
            F.col("n_name").alias("ecosystem_name"),
            null_every(founded, "c_custkey", 83).alias("date_founded"),
        )

    @cached_property
    def companies_aged(self) -> DataFrame:
        """Companies with their age in years at the reference date."""
        from dealflux.operators.projections import company_age

        return company_age(self.companies, as_of=AS_OF)

    @cached_property
    def companies_rounds(self) -> DataFrame:
        """Companies with the type and date of their latest round."""
        last = (
            self.deals.where("date is not null")
            .groupBy("company_id")
            .agg(F.max(F.struct("date", "id", "round_type")).alias("_last"))
            .select(
                F.col("company_id").alias("id"),
                F.col("_last.round_type").alias("latest_round_type"),
                F.col("_last.date").alias("latest_round_date"),
            )
        )
        return self.companies_aged.join(last, "id", "left")

    @cached_property
    def ecosystems(self) -> DataFrame:
        return self.places.where(F.col("n_nationkey") % 11 != 0).select(
            F.col("n_name").alias("ecosystem_name"),
            F.concat("n_name", F.lit("_CITY")).alias("city"),
            F.col("r_name").alias("province"),
        )

    @cached_property
    def deals(self) -> DataFrame:
        key = F.col("o_orderkey")
        factor = pick([0.1, 1.0, 10.0, 100.0, 1000.0], key % 5)
        date = F.col("o_orderdate").cast("date")
        return self.base("orders").select(
            key.alias("id"),
            F.col("o_custkey").alias("company_id"),
            date.alias("date"),
            F.year(date).alias("year"),
            null_every(F.col("o_totalprice") * factor, "o_orderkey", 97).alias("amount"),
            null_every(pick(ROUNDS, F.expr("(o_orderkey div 5) % 11")), "o_orderkey", 89).alias("round_type"),
        )

    @cached_property
    def investors(self) -> DataFrame:
        s = self.base("supplier").join(self.places, F.col("s_nationkey") == F.col("n_nationkey"))
        home = F.col("n_nationkey") % 5
        return s.select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("investor_name"),
            F.when(home == 0, "Canada").when(home == 1, "USA").otherwise(F.col("n_name")).alias("country"),
            pick(INVESTOR_TYPES, F.col("s_suppkey") % 3).alias("investor_type"),
        )

    @cached_property
    def deal_investor(self) -> DataFrame:
        line = self.base("lineitem").select(
            F.col("l_orderkey").alias("deal_id"),
            F.col("l_suppkey").alias("investor_id"),
            F.when(F.col("l_linenumber") == 1, 1).otherwise(0).alias("lead_investor_flag"),
        )
        rounds = self.deals.select(F.col("id").alias("deal_id"), "round_type")
        who = self.investors.select(
            F.col("id").alias("investor_id"), "investor_name", F.col("country").alias("investor_country")
        )
        return line.join(rounds, "deal_id").join(who, "investor_id")

    @cached_property
    def web_events(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        ms = lambda modulus, step: F.expr(f"make_dt_interval(0,0,0,cast((event_id % {modulus}) * {step} as decimal(18,6)))")
        events = sessionize(self.base("events").withColumn("ts", ts), "user_id", "ts")
        homes = (
            self.base("customer")
            .join(self.places, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("c_custkey").alias("user_id"), "n_name", "r_name")
        )
        user = F.col("user_id")
        device = pick(DEVICES, user % 6)
        e = events.join(homes, "user_id")
        e = e.withColumn("client_upload_time", F.col("ts") + ms(7, "0.1"))
        e = e.withColumn("server_upload_time", F.col("client_upload_time") + ms(3, "0.05"))
        e = e.withColumn("processed_time", F.col("server_upload_time") + ms(11, "0.25"))
        return e.select(
            "event_id",
            "event_type",
            F.col("ts").alias("event_time"),
            F.col("ts").alias("client_event_time"),
            "client_upload_time",
            F.col("client_upload_time").alias("server_received_time"),
            "server_upload_time",
            "processed_time",
            null_every(user, "event_id", 101).alias("user_id"),
            F.concat_ws("-", user.cast("string"), F.col("session_no").cast("string")).alias("session_id"),
            F.col("r_name").alias("country"),
            null_every(F.col("n_name"), "event_id", 53).alias("region"),
            null_every(F.concat("n_name", F.lit("_C"), (user % 3).cast("string")), "event_id", 31).alias("city"),
            device.alias("device_family"),
            null_every(device, "event_id", 71).alias("os_name"),
            pick(LANGUAGES, user % 4).alias("language"),
            F.lit("Web").alias("platform"),
            F.lit("http/2").alias("library"),
            F.lit("app").alias("app"),
            F.col("props").alias("event_properties"),
        )
