"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from dealflux.operators import filters
from dealflux.sources import readers as R
from dealflux.sources import writers as W
from dealflux.sources.json_arrays import read_json_array
from dealflux.streaming import events as E


def test_schema_in_another_order_is_refused(spark, tmp_path):
    W.write_csv_chunks(spark.createDataFrame([(1, "x")], "event_id long, event_type string"), str(tmp_path / "c"))
    good = R.event_schema(["event_id", "event_type"])
    assert R.read_csv(spark, str(tmp_path / "c"), good).first().event_type == "x"
    with pytest.raises(Exception, match="(?i)header"):
        R.read_csv(spark, str(tmp_path / "c"), R.event_schema(["event_type", "event_id"])).collect()
    swapped = R.read_csv_by_name(spark, str(tmp_path / "c"), R.event_schema(["event_type", "event_id", "city"])).first()
    assert (swapped.event_type, swapped.event_id, swapped.city) == ("x", 1, None)


def test_chunk_length_and_time_precision(spark, tmp_path):
    df = spark.range(250).select(F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") + 1_700_000_000_000_001).alias("event_time"))
    W.write_csv_chunks(df.coalesce(1), str(tmp_path / "c"), rows_per_file=100)
    assert len(list((tmp_path / "c").glob("*.csv"))) == 3
    back = R.read_csv(spark, str(tmp_path / "c"), R.event_schema(["event_id", "event_time"]))
    assert back.exceptAll(df).count() == 0


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"event_id": 1, "city": "x", "more": 2}, {"event_id": 2}]))
    got = R.read_json_export(spark, str(tmp_path / "a.json"), R.event_schema(["event_id", "city"]), ["event_id", "city"], lines=False)
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (2, None)]


ODD = [{"event_id": i, "city": c, "more": {"a": [{}, {"b": "}{"}]}} for i, c in enumerate(
    ["x", None, "", 'a "quoted" }', "{", "}", "\\\\", 'end\\\\"', "line\nbreak", "é" * 40, "[", "]", ",", "{" * 30, "\\u007d"])] * 7


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":")}])
@pytest.mark.parametrize("size", ["37b", "200b", "128m"])
def test_arrays_are_split_anywhere(spark, tmp_path, layout, size):
    for n, rows in enumerate([ODD, ODD[:1], [], [{"event_id": 1, "city": "y" * 900}]]):
        (tmp_path / f"{n}.json").write_text(json.dumps(rows, **layout, ensure_ascii=n == 1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = read_json_array(spark, str(tmp_path), R.event_schema(["event_id", "city"]), ["event_id", "city"])
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((r["event_id"], r["city"])) for r in [*ODD, ODD[0], {"event_id": 1, "city": "y" * 900}])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_array_of_other_elements_and_cut_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[1, "{", null, {"event_id": 3}, [2], "}", {"event_id": 4}]')
    assert sorted(r.event_id for r in read_json_array(spark, str(tmp_path / "a.json"), "event_id long").collect()) == [3, 4]
    (tmp_path / "b.json").write_text('[{"event_id": 3}, {"event_id": 4')
    with pytest.raises(Exception, match="(?i)malformed|corrupt"):
        read_json_array(spark, str(tmp_path / "b.json"), "event_id long").collect()


def test_one_line_of_many_megabytes_is_read_by_several_tasks(spark, tmp_path):
    rows = spark.range(200_000).select(F.to_json(F.struct(F.col("id").alias("event_id"), F.lit("a } b { c" * 8).alias("city"))).alias("j"))
    path = tmp_path / "big.json"
    path.write_text("[" + ", ".join(r.j for r in rows.collect()) + "]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        got = read_json_array(spark, str(path), R.event_schema(["event_id", "city"]))
        whole = R.read_json_export(spark, str(path), R.event_schema(["event_id", "city"]), lines=False)
        assert got.where("event_id is not null").groupBy(F.spark_partition_id()).count().count() > 4
        assert got.count() == 200_000 and got.exceptAll(whole).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_star_coercion_and_missing_columns(spark):
    raw = spark.createDataFrame([("1", "bad", "2020-02-30"), ("x", "2.5", "2020-02-03")], "id string, amount string, date string")
    rows = R.coerce(raw, ["date"], {"id": "bigint", "amount": "double"}).collect()
    assert [(r.id, r.amount, str(r.date)) for r in rows] == [(1, None, "None"), (None, 2.5, "2020-02-03")]
    with pytest.raises(ValueError, match="deals: company_id.*investors: country"):
        R.check_columns({"deals": raw, "investors": raw}, {"deals": ["id", "company_id"], "investors": ["id", "country"]})


def test_filters_and_columns_reach_the_scan(spark, tables, tmp_path):
    W.store(tables.deals, str(tmp_path / "deals"))
    plan = filters.years(spark.read.parquet(str(tmp_path / "deals")), 1996, 1997).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,1996-01-01)" in plan and "LessThan(date,1998-01-01)" in plan
    assert "amount" not in plan.split("ReadSchema")[1]


def test_stream_equals_batch_over_several_batches(spark, tables, tmp_path):
    base = tables.base("events").orderBy("ts")
    base.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    late = base.withColumn("ts", F.col("ts") - F.expr("interval 30 days")).withColumn("event_id", F.col("event_id") + 10_000_000)
    stream = E.read_events(spark, str(tmp_path / "in"), base.schema, files_per_batch=1)
    out = E.ingest(stream.unionByName(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert out.count() == base.count() and out.select("event_id").distinct().count() == base.count()
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = E.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp2"))
    assert out.count() == 2 * base.count()
    hours = E.run_available(E.hourly_counts(stream), str(tmp_path / "hours"), str(tmp_path / "cp3"))
    assert hours.agg(F.sum("n")).first()[0] == 2 * base.count()
    found = E.run_available(E.sessions(stream), str(tmp_path / "sessions"), str(tmp_path / "cp4"))
    assert found.agg(F.sum("events")).first()[0] == 2 * base.count()


def test_csv_fields_with_quotes_commas_and_json(spark, tmp_path):
    rows = [(i, text) for i, text in enumerate(['{"a": "1, \\"2\\""}', 'Acme "The, Best" Co', '"', None, "\\", 'x\\"y'])]
    W.write_csv_chunks(spark.createDataFrame(rows, "event_id long, event_properties string"), str(tmp_path / "c"))
    schema = R.event_schema(["event_id", "event_properties"])
    for read in (R.read_csv, R.read_csv_by_name):
        assert sorted(map(tuple, read(spark, str(tmp_path / "c"), schema).collect())) == rows


def test_json_array_with_an_object_a_line(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"event_id": 1, "city": "x],"},\n{"event_id": 2},\n {"event_id": 3, "city": "}"}]\n')
    got = R.read_json_array_lines(spark, str(tmp_path / "a.json"), R.event_schema(["event_id", "city"]))
    assert sorted(map(tuple, got.collect())) == [(1, "x],"), (2, None), (3, "}")]


def test_updates_hold_late_events_and_files_stay_few(spark, tables, tmp_path):
    base = tables.base("events").orderBy("ts")
    base.repartitionByRange(5, F.pmod(F.xxhash64("event_id"), F.lit(97))).write.parquet(str(tmp_path / "in"))  # every file holds late events
    stream = E.read_events(spark, str(tmp_path / "in"), base.schema, files_per_batch=1)
    want = base.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour_start"), "event_type").agg(F.count("*").alias("n"))
    out, cp = str(tmp_path / "hours"), str(tmp_path / "cp")
    got = E.run_available(E.hourly_counts(stream), out, cp, mode="update", keys=["hour_start", "event_type"])
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    written = spark.read.parquet(out)
    assert written.select("batch").distinct().count() == 5 and written.count() < 5 * want.count()
    base.limit(1).withColumn("event_id", F.lit(10**9)).write.mode("append").parquet(str(tmp_path / "in"))
    again = E.run_available(E.hourly_counts(stream), out, cp, mode="update", keys=["hour_start", "event_type"])
    assert spark.read.parquet(f"{out}/batch=5").count() == 1 and again.agg(F.sum("n")).first()[0] == base.count() + 1
    E.run_available(E.sessions(stream), str(tmp_path / "s"), str(tmp_path / "cp2"))
    assert len(list((tmp_path / "s").glob("batch=*"))) == 2
    with pytest.raises(ValueError, match="keys"):
        E.run_available(E.hourly_counts(stream), out, cp, mode="update")
