"""Scans: CSV chunks, JSON exports, star tables, result documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflux.functions.vocab import EVENT_COLUMNS

TIME_COLUMNS = [c for c in EVENT_COLUMNS if c.endswith("_time")]


def event_schema(columns: Sequence[str] = EVENT_COLUMNS) -> T.StructType:
    """Types of an event export by name: times, one integer id, text for the rest."""
    kind = {c: T.TimestampType() for c in TIME_COLUMNS} | {"event_id": T.LongType()}
    return T.StructType([T.StructField(c, kind.get(c, T.StringType())) for c in columns])


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """Typed CSV scan that checks the header against the schema and keeps the named columns.

    A schema in another order than the file fails on the header instead of binding columns by
    position. A quote inside a field is doubled. Quoted line breaks are not expected, so files stay splittable.
    """
    df = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False).option("mode", "FAILFAST").schema(schema).csv(path)
    return df.select(*columns) if columns else df


def read_csv_by_name(spark: SparkSession, path: str | list[str], schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV scan that takes columns by header name, in any order; names the file lacks are null.

    One line is read for the header; every file of the glob must share it.
    """
    header = spark.read.option("header", True).option("escape", '"').csv(path).columns
    raw = T.StructType([T.StructField(c, T.StringType()) for c in header])
    df = read_csv(spark, path, raw)
    wanted = [f for f in schema.fields if columns is None or f.name in columns]
    return df.select(*[
        (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in header else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted
    ])


def read_chunks(spark: SparkSession, paths: Sequence[str], schemas: Sequence[T.StructType]) -> DataFrame:
    """Bag union by name of CSV chunks whose columns differ."""
    frames = [read_csv(spark, p, s) for p, s in zip(paths, schemas)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_json_export(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None, *, lines: bool = True) -> DataFrame:
    """Event export as JSON lines (splittable) or as one array per file (one task per file)."""
    df = spark.read.option("multiLine", not lines).schema(schema).json(path)
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def read_json_array_lines(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """Event export as one JSON array with an object a line; such a file is split like any text file.

    Brackets and commas between objects are cut off each line; a line that holds no object gives no row.
    """
    line = F.trim(F.regexp_replace(F.trim("value"), r"^\[|(?<=\})\s*\]?\s*,?\s*$|^\]$", ""))
    df = spark.read.text(path).select(line.alias("_l")).where("_l <> ''").select(F.from_json("_l", schema, {"mode": "FAILFAST"}).alias("_o")).select("_o.*")
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def convert_export(spark: SparkSession, source: str, target: str, schema: T.StructType, keep: Sequence[str] = EVENT_COLUMNS,
                   *, form: str = "lines", rows_per_file: int = 100_000) -> None:
    """JSON export (``lines``, ``array`` or ``array_lines``; an array is split however it is laid out) to CSV files of bounded length holding the kept columns."""
    from dealflux.sources.json_arrays import read_json_array
    from dealflux.sources.writers import write_csv_chunks

    if form == "array":
        rows = read_json_array(spark, source, schema, keep)
    elif form == "array_lines":
        rows = read_json_array_lines(spark, source, schema, keep)
    else:
        rows = read_json_export(spark, source, schema, keep)
    write_csv_chunks(rows, target, rows_per_file=rows_per_file)


class Star(NamedTuple):
    companies: DataFrame
    deals: DataFrame
    investors: DataFrame
    deal_investor: DataFrame
    ecosystems: DataFrame


# Columns each star table must have.
REQUIRED = {
    "companies": ["id", "company_name", "primary_tag", "ecosystem_name", "date_founded"],
    "deals": ["id", "company_id", "amount", "round_type", "date", "year"],
    "investors": ["id", "country", "investor_type"],
    "deal_investor": ["deal_id", "investor_id", "investor_name", "lead_investor_flag", "round_type"],
    "ecosystems": ["ecosystem_name", "city", "province"],
}
DATES = {"companies": ["date_founded"], "deals": ["date"]}
NUMBERS = {
    "companies": {"id": "bigint"},
    "deals": {"id": "bigint", "company_id": "bigint", "amount": "double", "year": "int"},
    "investors": {"id": "bigint"},
    "deal_investor": {"deal_id": "bigint", "investor_id": "bigint", "lead_investor_flag": "int"},
}


def coerce(df: DataFrame, dates: Sequence[str] = (), numbers: Mapping[str, str] | None = None) -> DataFrame:
    """Dates and numbers from text; what does not parse becomes null."""
    made = {c: F.to_date(F.try_to_timestamp(F.col(c))) for c in dates if c in df.columns}
    made |= {c: F.col(c).try_cast(kind) for c, kind in (numbers or {}).items() if c in df.columns}
    return df.withColumns(made) if made else df


def missing_columns(tables: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]] = REQUIRED) -> dict[str, list[str]]:
    """Required columns each table lacks."""
    lacks = {name: [c for c in cols if c not in tables[name].columns] for name, cols in required.items() if name in tables}
    return {name: cols for name, cols in lacks.items() if cols}


def check_columns(tables: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]] = REQUIRED) -> None:
    """Raise one error that lists the missing columns of every table."""
    lacks = missing_columns(tables, required)
    if lacks:
        raise ValueError("missing columns: " + "; ".join(f"{t}: {', '.join(c)}" for t, c in lacks.items()))


def load_star(spark: SparkSession, folder: str) -> Star:
    """The five star tables from CSV, with dates and numbers coerced and columns checked."""
    tables = {}
    for name in Star._fields:
        df = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/{name}")
        tables[name] = coerce(df, DATES.get(name, ()), NUMBERS.get(name))
    check_columns(tables)
    return Star(**tables)


def read_results(spark: SparkSession, path: str, array: str, schema: str) -> DataFrame:
    """Rows of one array inside result documents."""
    df = spark.read.option("multiLine", True).schema(f"`{array}` array<struct<{schema}>>").json(path)
    return df.select(F.inline(array))


def latest_file(spark: SparkSession, pattern: str) -> DataFrame:
    """Path and time of the newest file that matches a glob."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    return files.agg(F.max(F.struct("modificationTime", "path")).alias("_f")).select("_f.path", F.col("_f.modificationTime").alias("modified"))
