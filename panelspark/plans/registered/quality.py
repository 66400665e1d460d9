"""Guards, registry, contracts and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.constants import LINEAGE_KEYS
from panelspark.control import contracts as Q
from panelspark.control import registry as R
from panelspark.operators import aggregates as A
from panelspark.operators import guards
from panelspark.plans import fixtures as X
from panelspark.plans import marts
from panelspark.plans.registered.reshape import mapping_frame
from panelspark.plans.registered.scans import WIDE_VALUES
from panelspark.plans.registered.spec import query
from panelspark.session import scratch_path
from panelspark.sources import files, sinks


@query(
    "quality_counters",
    "non_null_values i, rows_written i, invalid_timestamp_count i, negative_physical_value_count i, "
    "profile_out_of_range_count i",
    """SELECT 4 * count(*) AS non_null_values, 4 * count(*) FILTER (l_linenumber <> 1) AS rows_written,
         4 * count(*) FILTER (l_linenumber = 1) AS invalid_timestamp_count,
         count(*) FILTER (l_linenumber <> 1 AND l_discount < 0) + count(*) FILTER (l_linenumber <> 1 AND l_tax < 0)
           AS negative_physical_value_count,
         count(*) FILTER (l_linenumber <> 1 AND l_quantity NOT BETWEEN 0 AND 1) AS profile_out_of_range_count
       FROM lineitem""",
)
def quality_counters(spark, sf_dir):
    """The first line of every order carries an unreadable time."""
    stamp = F.when(F.col("l_linenumber") == 1, F.lit("soon")).otherwise(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    )
    wide = X.table(spark, sf_dir, "lineitem").select(
        stamp.alias("utc_timestamp"), F.lit("").alias("cet_cest_timestamp"), *WIDE_VALUES
    )
    long = marts.silver_long(
        wide, mapping_frame(spark), "utc_timestamp", "cet_cest_timestamp", WIDE_VALUES, "b1", "now"
    )
    return A.silver_counters(long)


@query(
    "require_columns",
    "outcome s, rows i",
    "SELECT 'lineitem lacks required columns: [''l_missing'', ''l_other'']' AS outcome, count(*) AS rows FROM lineitem",
)
def require_columns(spark, sf_dir):
    items = X.table(spark, sf_dir, "lineitem")
    guards.require_columns(items, ["l_orderkey", "l_tax"], "lineitem")
    try:
        guards.require_columns(items, ["l_tax", "l_other", "l_missing"], "lineitem")
        outcome = "accepted"
    except guards.DataQualityError as refusal:
        outcome = str(refusal)
    return items.agg(F.count(F.lit(1)).alias("rows")).withColumn("outcome", F.lit(outcome))


@query(
    "duplicate_guard",
    "side s, accepted b, rows i",
    """SELECT 'lineitem' AS side, count(DISTINCT (l_orderkey, l_linenumber)) = count(*) AS accepted,
         count(*) AS rows FROM lineitem
       UNION ALL SELECT 'orders', count(DISTINCT o_orderkey) = count(*), count(*) FROM orders""",
)
def duplicate_guard(spark, sf_dir):
    def judge(name, keys):
        frame = X.table(spark, sf_dir, name)
        try:
            guards.refuse_duplicates(frame, keys, name)
            accepted = True
        except guards.DataQualityError:
            accepted = False
        return frame.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("side"), F.lit(accepted).alias("accepted"), "rows"
        )

    return judge("lineitem", ["l_orderkey", "l_linenumber"]).unionByName(
        judge("orders", ["o_orderkey"])
    )


def small_lake(spark, sf_dir):
    """A lake written from the tables: bronze, silver and gold batches."""
    root = scratch_path(spark, "lake")
    market = X.market_observations(spark, sf_dir)
    bronze = f"{root}/bronze/energy_charts/ingestion_date=20240201/batch_id=20240201T000000Z"
    market.write.json(f"{bronze}/payload")
    silver = f"{root}/silver/energy_charts/ingestion_date=20240201/batch_id=20240201T010000Z"
    sinks.write_batch(market, f"{silver}/data", ["bzn"])
    gold = f"{root}/gold/energy_forecast_impact/market_batch=b1__weather_batch=w1/bzn=DE-LU"
    panel = X.impact_panel(spark, sf_dir)
    sinks.write_batch(panel, f"{gold}/data", ["bzn"])
    reports = {
        f"{silver}/quality_report.json": market.agg(
            F.lit("silver").alias("layer"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("event_time_utc").isNull()).alias("invalid_timestamp_count"),
            F.lit("b0").alias("bronze_batch"),
        ),
        f"{gold}/gold_report.json": marts.impact_report(panel).withColumns(
            {"layer": F.lit("gold"), "weather_batch": F.lit("w1")}
        ),
    }
    return root, reports


def lake_inputs(spark, sf_dir):
    """(root, files, reports): listing and documents of the small lake."""
    root, reports = small_lake(spark, sf_dir)
    prefix = len(root) + 2
    relative = F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {prefix})")
    listed = files.list_files(spark, root).select(relative.alias("path"), "bytes")
    documents, names = None, []
    for path, report in reports.items():
        name = path[len(root) + 1 :]
        names.append(name)
        text = report.select(F.lit(name).alias("path"), F.to_json(F.struct("*")).alias("text"))
        documents = text if documents is None else documents.unionByName(text)
    with_reports = listed.unionByName(
        spark.createDataFrame([(n, 0) for n in names], "path string, bytes long")
    )
    parsed = documents.select("path", files.tolerant_document("text").alias("document"))
    return root, with_reports, parsed


@query(
    "lake_registry",
    "layer s, dataset s, artifact_path s, report_layer s, rows d0, match_rate d, status s, failed_checks l, "
    "check_count i, passed_check_count i, lineage_bronze_batch s, lineage_weather_batch s",
    """SELECT 'bronze' AS layer, 'energy_charts' AS dataset,
         'bronze/energy_charts/ingestion_date=20240201/batch_id=20240201T000000Z' AS artifact_path,
         NULL AS report_layer, NULL AS rows, NULL AS match_rate, 'WARN' AS status,
         ['report_present', 'manifest_present'] AS failed_checks, 3 AS check_count, 1 AS passed_check_count,
         NULL AS lineage_bronze_batch, NULL AS lineage_weather_batch
       UNION ALL SELECT 'silver', 'energy_charts',
         'silver/energy_charts/ingestion_date=20240201/batch_id=20240201T010000Z', 'silver',
         (SELECT count(*) FROM market), NULL, 'COMPLETE', [], 4, 4, 'b0', NULL
       UNION ALL SELECT 'gold', 'energy_forecast_impact',
         'gold/energy_forecast_impact/market_batch=b1__weather_batch=w1/bzn=DE-LU', 'gold', n, r,
         CASE WHEN r >= 0.99 THEN 'COMPLETE' ELSE 'WARN' END,
         CASE WHEN r >= 0.99 THEN [] ELSE ['match_rate_gate'] END, 4,
         CASE WHEN r >= 0.99 THEN 4 ELSE 3 END, NULL, 'w1'
       FROM (SELECT count(*) AS n, avg(market_match_flag::INT) AS r FROM impact)""",
    "impact",
)
def lake_registry(spark, sf_dir):
    _, listed, reports = lake_inputs(spark, sf_dir)
    return R.build_registry(listed, reports, rate_fields=("match_rate", "market_match_rate"))


def event_reports(spark, sf_dir):
    """One report per event: its props, a list of parts and a nested value."""
    value = F.col("value").cast("string")
    text = F.concat(
        F.lit('{"props": '), "props", F.lit(', "parts": [{"count": '), value,
        F.lit('}, {"count": 1}], "empty": [], "a": {"b": [{"c": {"d": '), value, F.lit('}}]}}'),
    )
    return X.table(spark, sf_dir, "events").select(
        "event_id", "value", "event_type", F.parse_json(text).alias("document")
    )


@query(
    "report_paths",
    "event_id i, path s, value d",
    """SELECT event_id, 'props.k' AS path, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events
       UNION ALL SELECT event_id, 'parts.*.count', value FROM events
       UNION ALL SELECT event_id, 'parts.*.count', 1.0 FROM events
       UNION ALL SELECT event_id, 'a.b.*.c.d', value FROM events""",
)
def report_paths(spark, sf_dir):
    """Leaf numbers of every report; objects and lists are left out."""
    nodes = Q.report_paths(event_reports(spark, sf_dir), "event_id", 5)
    number = F.try_variant_get("value", "$", "double")
    return nodes.select("event_id", "path", number.alias("value")).where("value IS NOT NULL")


_RULES = [
    (0, "props.k", "lt", 50.0, "50"),
    (1, "parts.*.count", "ge", 1.0, "1"),
    (2, "empty.*.count", "eq", 0.0, "0"),
]


@query(
    "contract_rules",
    "event_id i, rule_id i, passed b, message s",
    """SELECT event_id, 0 AS rule_id, k < 50 AS passed,
         CASE WHEN k < 50 THEN 'props.k lt 50' ELSE concat('props.k lt 50; observed [''', k, ''']') END AS message
       FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
       UNION ALL SELECT event_id, 1, value >= 1, CASE WHEN value >= 1 THEN 'parts.*.count ge 1' ELSE 'shown below' END
       FROM events
       UNION ALL SELECT event_id, 2, false, 'missing report field: empty.*.count' FROM events""",
)
def contract_rules(spark, sf_dir):
    reports = event_reports(spark, sf_dir)
    rule_rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("rule_id"), F.lit(p).alias("path"), F.lit(o).alias("op"),
                F.lit(v).alias("expected"), F.lit(s).alias("shown"),
            )
            for i, p, o, v, s in _RULES
        ]
    )
    rules = reports.select("event_id", F.explode(rule_rows).alias("r")).select("event_id", "r.*")
    checked = Q.check_rules(Q.report_paths(reports, "event_id", Q.rule_depth(rules)), rules, "event_id")
    # the decimal text of a double differs between engines, so it is not compared
    shown = F.when((F.col("rule_id") == 1) & ~F.col("passed"), F.lit("shown below"))
    return checked.withColumn("message", F.coalesce(shown, "message"))


def event_registry(spark, sf_dir):
    """One artifact per event, spread over layers, states and datasets."""
    kind = F.col("event_type")
    registry = X.table(spark, sf_dir, "events").select(
        F.when(kind == "error", "bronze").when(kind == "view", "silver").otherwise("gold").alias("layer"),
        F.when(kind == "view", "unknown").otherwise("energy_research").alias("dataset"),
        F.lit("b1").alias("batch_id"),
        F.col("event_id").cast("string").alias("artifact_path"),
        F.when(F.col("value") < 5, "WARN").otherwise("COMPLETE").alias("status"),
    )
    reports = X.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("artifact_path"),
        F.parse_json(
            F.when(kind == "purchase", F.lit('{"renewable_share_over_100pct_rows": 0}')).otherwise(
                F.lit('{"renewable_share_over_100pct_rows": 3}')
            )
        ).alias("document"),
    )
    names = Q.CONTRACTS["gold/energy_research"]["columns"]
    observed = F.when(
        F.col("user_id") % 2 == 0, F.array(*[F.lit(n) for n in names])
    ).otherwise(F.array(*[F.lit(n) for n in names[1:]]))
    columns = X.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("artifact_path"), observed.alias("observed")
    )
    return registry, reports, columns


_VALIDATION_SQL = """
SELECT *, CASE WHEN layer = 'bronze' AND ok THEN 'SKIP_BRONZE' WHEN NOT ok OR layer = 'silver' OR layer = 'bronze' THEN 'WARN'
    WHEN len(failures) = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
  len(failures) = 0 AS passed, len(failures) AS failure_count
FROM (SELECT *, CASE
    WHEN layer = 'bronze' AND NOT ok THEN ['Bronze registry status is not COMPLETE']
    WHEN layer = 'bronze' THEN []
    WHEN NOT ok THEN ['registry status is not COMPLETE']
    WHEN layer = 'silver' THEN ['no contract defined for silver/unknown']
    ELSE list_concat(
      CASE WHEN user_id % 2 = 0 THEN [] ELSE ['missing required columns: [''event_time_utc'']'] END,
      CASE WHEN event_type = 'purchase' THEN []
        ELSE ['renewable_share_over_100pct_rows eq 0; observed [''3'']'] END) END AS failures
  FROM (SELECT *, CAST(event_id AS VARCHAR) AS artifact_path, value >= 5 AS ok,
      CASE event_type WHEN 'error' THEN 'bronze' WHEN 'view' THEN 'silver' ELSE 'gold' END AS layer FROM events))"""


@query(
    "contract_validation",
    "layer s, artifact_path s, status s, passed b, failure_count i, failures l",
    _VALIDATION_SQL,
)
def contract_validation(spark, sf_dir):
    return Q.validate_contracts(*event_registry(spark, sf_dir))


@query(
    "contract_summary",
    "total_artifacts i, pass_count i, fail_count i, warn_count i, skip_bronze_count i",
    f"""SELECT count(*) AS total_artifacts, count(*) FILTER (status = 'PASS') AS pass_count,
          count(*) FILTER (status = 'FAIL') AS fail_count, count(*) FILTER (status = 'WARN') AS warn_count,
          count(*) FILTER (status = 'SKIP_BRONZE') AS skip_bronze_count FROM ({_VALIDATION_SQL})""",
)
def contract_summary(spark, sf_dir):
    return Q.contract_summary(Q.validate_contracts(*event_registry(spark, sf_dir)))


@query(
    "lineage_extract",
    "event_id i, " + ", ".join(f"lineage_{k} s" for k in LINEAGE_KEYS),
    """SELECT event_id, concat('b', user_id) AS lineage_bronze_batch,
         CASE WHEN event_type = 'view' THEN 's1' END AS lineage_silver_batch, """
    + ", ".join(f"NULL AS lineage_{k}" for k in LINEAGE_KEYS if k not in ("bronze_batch", "silver_batch"))
    + " FROM events",
)
def lineage_extract(spark, sf_dir):
    text = F.concat(
        F.lit('{"bronze_batch": "b'), F.col("user_id"),
        F.when(F.col("event_type") == "view", '", "silver_batch": "s1"}').otherwise('"}'),
    )
    reports = X.table(spark, sf_dir, "events").withColumn("text", text).select(
        "event_id", files.tolerant_document("text").alias("document")
    )
    return reports.withColumns(R.lineage_columns())

