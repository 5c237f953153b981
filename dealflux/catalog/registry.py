"""Named queries over the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflux.catalog.oracle_views import with_views
from dealflux.sources.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ["events", "profiles", "relational", "series", "deals", "learning", "io"]


def plain(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Rounded doubles, text dates and integer flags, so that two engines compare equal."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if name in digits:
            # Scaled in binary, as the SQL side rounds; rounding the decimal form instead breaks other ties.
            c = F.round(c.cast("double") * F.lit(10.0 ** digits[name])) / F.lit(10.0 ** digits[name])
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            c = c.cast("string")
        elif kind == "boolean":
            c = c.cast("int")
        cols.append(c.alias(name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, **rounds: str):
    """Register a query; ``r3="a b"`` rounds columns a and b to 3 digits on both sides."""
    digits = {c: int(k[1:]) for k, cs in rounds.items() for c in cs.split()}

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(fn(Tables(spark, folder)), digits)

        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            if digits:
                shown = ", ".join(f"round({c}::DOUBLE, {d}) + 0.0 AS {c}" for c, d in digits.items())
                text = f"SELECT * REPLACE ({shown}) FROM ({text})"
            ORACLES[name] = with_views(text)
        return fn

    return register


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"dealflux.catalog.{module}_queries")
