import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from panelspark.sources import files, payloads, runs, sinks


def put(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(content if isinstance(content, str) else json.dumps(content, indent=2))


def test_weather_documents_one_per_file(spark, folder):
    hourly = {
        "time": ["2024-06-01T00:00", "2024-06-01T01:00", "bad"],
        "temperature_2m": [1.5, None, 2.5],
        "relative_humidity_2m": [50, 51, 52],
        "precipitation": [0, 0, 1],
        "wind_speed_10m": [1, 2, 3],
        "shortwave_radiation": [0, 0, 0],
        "weather_code": [1, 2, 3],
    }
    for place in ("paris", "vienna"):
        put(f"{folder}/location={place}/weather.json", {"hourly": hourly, "hourly_units": {"x": "y"}})
        put(f"{folder}/location={place}/request.json", {"location": place, "latitude": 1.0, "longitude": 2.0})
    rows = payloads.read_weather(spark, f"{folder}/location=*/weather.json", folder).collect()
    assert len(rows) == 6 and {r.location for r in rows} == {"paris", "vienna"}
    bad = [r for r in rows if r.event_time_utc is None]
    assert len(bad) == 2 and bad[0].temperature_2m_c == 2.5
    requests = payloads.read_requests(spark, f"{folder}/location=*/request.json", folder)
    joined = payloads.join_sidecar(
        payloads.read_weather(spark, f"{folder}/location=*/weather.json", folder), requests, ["location"]
    )
    assert {(r.latitude, r.longitude) for r in joined.collect()} == {(1.0, 2.0)}


def test_many_forecast_runs(spark, folder):
    for run in ("2024-06-01T00-00Z", "2024-06-01T12-00Z"):
        base = f"{folder}/run={run}/location=paris"
        start = run.replace("-00Z", ":00Z")
        hourly = {
            "time": ["2024-06-01T13:00"], "temperature_2m": [20.0], "wind_speed_10m": [5],
            "shortwave_radiation": [None], "precipitation": [0.1],
        }
        put(f"{base}/forecast.json", {"hourly": hourly})
        put(f"{base}/request.json", {
            "location": "paris", "latitude": 1.0, "longitude": 2.0, "model": "m", "forecast_run_utc": start,
        })
    rows = payloads.read_forecast_runs(spark, f"{folder}/run=*/location=*/forecast.json", folder)
    requests = payloads.read_requests(spark, f"{folder}/run=*/location=*/request.json", folder)
    silver = payloads.forecast_silver(rows, requests, "b1").collect()
    assert sorted(r.forecast_horizon_hours for r in silver) == [1.0, 13.0]
    assert silver[0].shortwave_radiation_forecast_w_m2 is None and silver[0].model == "m"


def market(folder):
    base = f"{folder}/batch_id=b1/country=de/bzn=DE-LU"
    put(f"{base}/endpoint=price/price.json", {"unix_seconds": [0, 3600], "price": [1.0, None]})
    put(f"{base}/endpoint=public_power/public_power.json", {
        "unix_seconds": [0, 900],
        "production_types": [
            {"name": "Solar", "data": [1, 2]}, {"name": "Renewable share of load", "data": [3, None]},
        ],
    })
    put(f"{base}/endpoint=public_power_forecast/production_type=load/forecast_load.json", {
        "unix_seconds": [0], "forecast_values": [5.0], "production_type": "load", "forecast_type": "day-ahead",
    })
    return base


def test_market_payloads(spark, folder):
    base = market(folder)
    prices = payloads.read_prices(spark, f"{base}/endpoint=price/price.json", folder)
    power = payloads.read_public_power(spark, f"{base}/endpoint=public_power/public_power.json", folder)
    forecast = payloads.read_power_forecasts(
        spark, f"{base}/endpoint=public_power_forecast/production_type=*/forecast_*.json", folder
    )
    rows = payloads.market_rows(prices, power, forecast).collect()
    by_metric = {}
    for r in rows:
        by_metric.setdefault(r.metric, []).append(r)
    assert {m: len(v) for m, v in by_metric.items()} == {
        "price_day_ahead": 2, "actual_solar": 2, "actual_renewable_share_of_load": 2, "forecast_load": 1
    }
    assert by_metric["price_day_ahead"][0].unit == "EUR / MWh"
    assert by_metric["actual_renewable_share_of_load"][0].unit == "pct"
    assert {(r.bzn, r.country, r.batch_id) for r in rows} == {("DE-LU", "de", "b1")}


def test_length_mismatch_is_an_error(spark, folder):
    put(f"{folder}/p.json", {"unix_seconds": [0, 1, 2], "price": [1.0]})
    with pytest.raises(Exception, match="length mismatch"):
        payloads.read_prices(spark, f"{folder}/p.json").collect()


def test_payload_rules(spark):
    rows = [
        ("/price", '{"price": []}'), ("/price", '{"x": 1}'), ("/price", '{"error": "no", "price": []}'),
        ("/price", '{"error": "", "price": []}'), ("/public_power", "[1]"), ("/public_power", "{broken"),
    ]
    raw = spark.createDataFrame(rows, "endpoint string, body string")
    usable, quarantine = payloads.split_payloads(raw)
    assert usable.count() == 2
    assert sorted(r.problem for r in quarantine.collect()) == [
        "/price response has no price", "API error: no", "not JSON", "not a JSON object"
    ]


def test_wide_csv_and_mapping(spark, folder):
    put(f"{folder}/wide.csv", "utc_timestamp,cet_cest_timestamp,a,b\n2024-01-01T00:00:00Z,x,1.5,\n")
    frame = files.read_wide_csv(spark, f"{folder}/wide.csv")
    assert frame.columns == ["utc_timestamp", "cet_cest_timestamp", "a", "b"]
    assert frame.first().a == "1.5" and frame.first().b is None
    fields = [
        {"name": "utc_timestamp"}, {"name": "a", "opsdProperties": {"Region": "AT", "Variable": "load"}},
        {"name": "b", "opsdProperties": {"Region": "", "Variable": "x"}},
    ]
    put(f"{folder}/package.json", {"resources": [{"schema": {"fields": fields}}]})
    mapping = files.read_column_mapping(spark, f"{folder}/package.json").collect()
    assert [tuple(r) for r in mapping] == [("a", "AT", "load")]


def test_batches_and_path_keys(spark, folder):
    frame = spark.createDataFrame(
        [("20240101", "b1", 1), ("20240102", "b2", 2), ("20240102", "b3", 3)],
        "ingestion_date string, batch_id string, v int",
    )
    sinks.write_batch(frame, f"{folder}/t", ["ingestion_date", "batch_id"])
    put(f"{folder}/t/quality_report.json", {"rows": 3})
    table = files.read_lake_table(spark, f"{folder}/t")
    assert dict(table.dtypes)["ingestion_date"] == "string"
    assert [r.v for r in files.latest_batch(table, ["ingestion_date", "batch_id"]).collect()] == [3]
    listed = files.path_keys(files.list_files(spark, f"{folder}/t", "*.parquet"), ["batch_id", "run"])
    assert {(r.batch_id, r.run) for r in listed.collect()} == {("b1", None), ("b2", None), ("b3", None)}


def test_manifest_and_tolerant_json(spark, folder):
    put(f"{folder}/good.json", {"a": {"b": 1}})
    put(f"{folder}/bad.json", "{oops")
    manifest = {r.file_name: r for r in files.bronze_manifest(spark, folder, "src", "b1").collect()}
    with open(f"{folder}/bad.json", "rb") as handle:
        assert manifest["bad.json"].sha256 == hashlib.sha256(handle.read()).hexdigest()
    documents = files.read_tolerant_json(spark, folder).select(
        F.regexp_extract("path", "[a-z]+.json$", 0).alias("n"), F.to_json("document").alias("d")
    )
    assert {r.n: r.d for r in documents.collect()} == {"good.json": '{"a":{"b":1}}', "bad.json": "{}"}


def test_manifest_of_files_too_large_for_one_value(spark, folder):
    """Files above the bound are hashed from their lines, over several splits."""
    noise = bytes(i * i % 251 for i in range(60_000))
    contents = {
        "plain": noise, "ended": noise + b"\n", "crlf": b"a\r\nb\rc\n\n" * 9000, "ends": b"\n" * 50_000,
        "marked": b"\xef\xbb\xbf" + noise, "marked_ended": b"\xef\xbb\xbf" + noise + b"\n\n",
        "one_line": b"\xff" * 50_000, "small": b"\n\xff",
    }
    for name, content in contents.items():
        with open(f"{folder}/{name} é%.bin", "wb") as file:
            file.write(content)
    kept = {"spark.sql.files.maxPartitionBytes": "7k", "spark.sql.files.openCostInBytes": "1k",
            "spark.sql.execution.arrow.maxRecordsPerBatch": "70"}
    kept = {k: (spark.conf.get(k), spark.conf.set(k, v))[0] for k, v in kept.items()}
    try:
        manifest = files.bronze_manifest(spark, folder, "src", "b1", "*.bin", whole_bytes=20_000)
        rows = manifest.collect()
        whole = files.bronze_manifest(spark, folder, "src", "b1", "*.bin").collect()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    want = {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}
    assert len(rows) == len(want) and sorted(rows) == sorted(whole)
    assert {r.file_name.split(" ")[0]: (r.bytes, r.sha256) for r in rows} == want


def test_manifest_refuses_lines_that_do_not_make_up_the_file(spark, folder):
    with gzip.open(f"{folder}/big.txt.gz", "wb") as file:
        file.write(os.urandom(30_000))
    assert files.bronze_manifest(spark, folder, "src", "b1").count() == 1
    with pytest.raises(Exception, match="bytes in lines"):
        files.bronze_manifest(spark, folder, "src", "b1", whole_bytes=20_000).collect()


def test_series_availability(spark):
    expected = spark.createDataFrame(
        [("AT", "price", False), ("AT", "offshore", True)], "bzn string, metric string, optional boolean"
    )
    landed = spark.createDataFrame([("AT", "price")], "bzn string, metric string")
    got = {r.metric: r.status for r in files.series_availability(expected, landed, ["bzn", "metric"]).collect()}
    assert got == {"price": "available", "offshore": "unavailable"}
    with pytest.raises(Exception, match="required series did not land"):
        files.series_availability(expected, landed.where("false"), ["bzn", "metric"]).collect()


def test_run_catalog(spark):
    rows = runs.run_catalog(spark, "2024-06-01T00:00", 30, 12, ["frankfurt", "paris", "vienna"])
    assert rows.count() == 90 and rows.select("forecast_run_utc").distinct().count() == 30
    assert str(rows.agg(F.max("forecast_run_utc")).first()[0]) == "2024-06-15 12:00:00"
    for bad in (
        ("2023-06-01T00:00", 1, 12, ["paris"]), ("2024-06-01T03:00", 1, 12, ["paris"]),
        ("2024-06-01T00:00", 0, 12, ["paris"]), ("2024-06-01T00:00", 1, 7, ["paris"]),
        ("2024-06-01T00:00", 1, 12, ["atlantis"]),
    ):
        with pytest.raises(ValueError):
            runs.run_catalog(spark, *bad)


def test_write_once_and_checked(spark, folder):
    frame = spark.range(10).selectExpr("id", "id % 2 AS k")
    sinks.write_batch(frame, f"{folder}/once", ["k"])
    with pytest.raises(Exception, match="exist"):
        sinks.write_batch(frame, f"{folder}/once", ["k"])

    def refuse(_):
        raise ValueError("bad batch")

    with pytest.raises(ValueError):
        sinks.write_checked(frame, f"{folder}/never", ["k"], refuse)
    assert not os.path.exists(f"{folder}/never")
    assert os.path.exists(f"{folder}/once/_SUCCESS")
    sinks.write_metrics(frame, f"{folder}/metrics")
    assert spark.read.parquet(f"{folder}/metrics/parquet").count() == 10


def test_broken_payloads_stop_the_read_and_are_listed(spark, folder):
    good = '{"hourly": {"time": ["2024-01-01T00:00"], "temperature_2m": [1]}}'
    texts = {"good": good, "cut": good[:40], "error": '{"error": true, "reason": "down"}'}
    for name, text in texts.items():
        with open(f"{folder}/{name}.json", "w") as file:
            file.write(text)
    for bad in ("cut", "error"):
        with pytest.raises(Exception, match="unusable payload"):
            payloads.read_weather(spark, f"{folder}/{bad}.json").collect()
    listed = {r.path.rsplit("/", 1)[1]: r.problem for r in payloads.quarantined(spark, folder, F.lit("/weather")).collect()}
    assert listed == {"cut.json": "not JSON", "error.json": "API error: true"}


def test_latest_batch_reads_no_row(spark, folder):
    rows = [("2024-01-02", "b1", 1), ("2024-01-10", "b0", 2), ("2024-01-10", "b2", 3), ("2024-01-10", "b2", 4)]
    spark.createDataFrame(rows, "ingestion_date string, batch_id string, v int").write.partitionBy(
        "ingestion_date", "batch_id").parquet(f"{folder}/t")
    table = spark.read.parquet(f"{folder}/t")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("latest", "latest")
    latest = files.latest_batch(table, ["ingestion_date", "batch_id"])
    assert tracker.getJobIdsForGroup("latest") == []
    assert sorted(r.v for r in latest.collect()) == [3, 4]
