import json


from panelspark.control import contracts as Q
from panelspark.control import registry as R
from panelspark.sources import files


def documents(spark, rows, key="artifact_path"):
    frame = spark.createDataFrame(rows, f"{key} string, text string")
    return frame.select(key, files.tolerant_document("text").alias("document"))


def rule_results(spark, report, rules):
    reports = documents(spark, [("r", json.dumps(report))])
    asked = spark.createDataFrame(
        [("r", i, p, o, float(v), str(v)) for i, (p, o, v) in enumerate(rules)],
        "artifact_path string, rule_id int, path string, op string, expected double, shown string",
    )
    checked = Q.check_rules(Q.report_paths(reports, "artifact_path", 4), asked, "artifact_path")
    return {r.rule_id: (r.passed, r.message) for r in checked.collect()}


def test_rule_semantics(spark):
    report = {"a": 1, "rate": 0.98, "text": "1", "flag": True, "none": None,
              "list": [{"n": 0}, {"n": 2}, {"other": 1}], "empty": [], "deep": {"x": {"y": 3}}}
    rules = [("a", "eq", 1), ("rate", "ge", 0.99), ("text", "eq", 1), ("flag", "eq", 1), ("none", "ge", 0),
             ("list.*.n", "eq", 0), ("empty.*.n", "eq", 0), ("gone", "eq", 0), ("deep.x.y", "gt", 2),
             ("a.*.n", "eq", 1), ("a", "lt", 2), ("a", "le", 0), ("a", "other", 1)]
    got = rule_results(spark, report, rules)
    passed = {i for i, (ok, _) in got.items() if ok}
    assert passed == {0, 3, 8, 10}
    assert got[1][1] == "rate ge 0.99; observed ['0.98']"
    assert got[5][1] == "list.*.n eq 0; observed ['2']"
    assert got[6][1] == "missing report field: empty.*.n"
    assert got[0][1] == "a eq 1"


def test_contract_ladder(spark):
    good = "event_time_utc region load_actual_mw load_forecast_mw load_forecast_error_mw " \
           "renewable_generation_mw renewable_share price_day_ahead_eur_mwh negative_price_flag " \
           "price_spike_flag hour_utc day_of_week source silver_batch_id".split()
    cases = [
        ("bronze", "x", "b0", "COMPLETE"), ("bronze", "x", "b1", "WARN"), ("gold", "energy_research", "ok", "COMPLETE"),
        ("gold", "energy_research", "missing", "COMPLETE"), ("gold", "energy_research", "bad", "COMPLETE"),
        ("gold", "unknown", "u", "COMPLETE"), ("silver", "energy_charts", "w", "WARN"),
    ]
    registry = spark.createDataFrame(
        [(a, b, c, c, d) for a, b, c, d in cases],
        "layer string, dataset string, batch_id string, artifact_path string, status string",
    )
    reports = documents(spark, [("ok", '{"renewable_share_over_100pct_rows": 0}'),
                                ("missing", '{"renewable_share_over_100pct_rows": 0}'),
                                ("bad", '{"renewable_share_over_100pct_rows": 4}')])
    columns = spark.createDataFrame(
        [("ok", good), ("missing", good[2:]), ("bad", good)], "artifact_path string, observed array<string>"
    )
    results = Q.validate_contracts(registry, reports, columns)
    got = {r.artifact_path: r for r in results.collect()}
    assert {k: r.status for k, r in got.items()} == {
        "b0": "SKIP_BRONZE", "b1": "WARN", "ok": "PASS", "missing": "FAIL", "bad": "FAIL", "u": "WARN", "w": "WARN"
    }
    assert got["missing"].failures == ["missing required columns: ['event_time_utc', 'region']"]
    assert got["u"].failures == ["no contract defined for gold/unknown"]
    assert got["ok"].required_column_count == 14 and got["u"].required_column_count is None
    summary = Q.contract_summary(results)
    assert tuple(summary.first()) == (7, 1, 2, 3, 1)
    assert (Q.exit_code(summary), Q.exit_code(summary, True)) == (0, 1)


def test_seven_contracts_with_twenty_two_rules(spark):
    rules = Q.contract_rules(spark)
    assert rules.count() == 22 and rules.select("contract").distinct().count() == 7


def test_registry(spark, folder):
    listed = [
        ("bronze/a/ingestion_date=1/batch_id=b1/manifest.jsonl", 10),
        ("bronze/a/ingestion_date=1/batch_id=b1/raw.csv", 99),
        ("bronze/a/ingestion_date=1/batch_id=b2/country=de/bzn=X/manifest.jsonl", 11),
        ("bronze/a/ingestion_date=1/batch_id=b3/raw.csv", 1),
        ("silver/s/ingestion_date=1/batch_id=b1/quality_report.json", 5),
        ("silver/s/ingestion_date=1/batch_id=b1/year=2024/part-0.parquet", 100),
        ("silver/s/ingestion_date=1/batch_id=b2/run=r1/quality_report.json", 5),
        ("silver/s/ingestion_date=1/batch_id=b2/run=r1/part-0.parquet", 50),
        ("gold/g/batch=1/error_report.json", 5), ("gold/g/batch=1/part-0.parquet", 70),
        ("gold/g/batch=1/x/part-1.parquet", 30), ("gold/h/p/panel_report.json", 5),
    ]
    files_frame = spark.createDataFrame(listed, "path string, bytes long")
    reports = documents(spark, [
        ("silver/s/ingestion_date=1/batch_id=b1/quality_report.json", '{"rows_written": 7, "invalid_timestamp_count": 2}'),
        ("silver/s/ingestion_date=1/batch_id=b2/run=r1/quality_report.json", '{"rows": 3, "bronze_batch": "up"}'),
        ("gold/g/batch=1/error_report.json", '{"rows_gold": 9, "match_rate": 0.5, "layer": "gold"}'),
        ("gold/h/p/panel_report.json", "not json"),
    ], "path")
    registry = R.build_registry(files_frame, reports, gold_reports=[*R.GOLD_REPORTS, "panel_report.json"])
    assert R.build_registry(files_frame, reports).count() == 6
    got = {r.artifact_path: r for r in registry.collect()}
    assert len(got) == 7
    b = "bronze/a/ingestion_date=1/batch_id="
    assert got[b + "b1"].status == "COMPLETE" and got[b + "b1"].manifest_bytes == 10
    assert got[b + "b2"].report_path.endswith("bzn=X/manifest.jsonl")
    assert got[b + "b3"].failed_checks == ["report_present", "manifest_present"]
    first = got["silver/s/ingestion_date=1/batch_id=b1"]
    assert (first.rows, first.failed_checks, first.check_count) == (7, ["invalid_timestamp_gate"], 4)
    second = got["silver/s/ingestion_date=1/batch_id=b2/run=r1"]
    assert (second.batch_id, second.lineage_bronze_batch, second.parquet_bytes) == ("b2", "up", 50)
    gold = got["gold/g/batch=1"]
    assert (gold.parquet_file_count, gold.parquet_bytes, gold.status) == (2, 100, "WARN")
    assert got["gold/h/p"].failed_checks == ["parquet_present"]
    assert tuple(R.registry_summary(registry).first()) == (7, 3, 4)
    R.write_registry(registry, f"{folder}/registry")
    stored = spark.read.option("header", True).csv(f"{folder}/registry/csv")
    assert stored.count() == 7
    assert [r.layer for r in R.ordered_registry(registry).select("layer").collect()] == (
        ["bronze"] * 3 + ["gold"] * 2 + ["silver"] * 2
    )


def test_observed_columns(spark, folder):
    spark.range(2).selectExpr("id AS a", "1 AS k").write.partitionBy("k").parquet(f"{folder}/art")
    artifacts = spark.createDataFrame([("art",), ("none",)], "artifact_path string")
    got = {r.artifact_path: sorted(r.observed) for r in R.observed_columns(spark, artifacts, f"{folder}/").collect()}
    assert got == {"art": ["a", "k"], "none": []}


def test_lineage_is_text(spark):
    frame = documents(spark, [("a", '{"silver_batch": "s1", "energy_batch": 5}')])
    row = frame.select(*[c.alias(n) for n, c in R.lineage_columns().items()]).first()
    assert (row.lineage_silver_batch, row.lineage_energy_batch, row.lineage_bronze_run) == ("s1", "5", None)


def test_rules_reach_any_depth(spark):
    registry = spark.createDataFrame(
        [("gold", "deep", "b", "x", "COMPLETE")], "layer string, dataset string, batch_id string, artifact_path string, status string"
    )
    reports = documents(spark, [("x", '{"a": {"b": {"c": {"d": {"e": 0}}}}}')])
    columns = spark.createDataFrame([("x", ["k"])], "artifact_path string, observed array<string>")
    contracts = {"gold/deep": {"columns": ["k"], "rules": [("a.b.c.d.e", "eq", 0)]}}
    found = Q.validate_contracts(
        registry, reports, columns, Q.contract_rules(spark, contracts), Q.contract_columns(spark, contracts)
    )
    assert [r.status for r in found.collect()] == ["PASS"]


def test_contracts_from_a_file(spark, folder):
    import json

    with open(f"{folder}/contracts.json", "w") as file:
        json.dump({"contracts": {"gold/x": {"required_columns": ["a"], "report_rules": [{"path": "n", "op": "ge", "value": 1}]}}}, file)
    assert Q.read_contracts(spark, f"{folder}/contracts.json") == {"gold/x": {"columns": ["a"], "rules": [("n", "ge", 1)]}}
