"""The driver contract, and a sample of oracles on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check_oracles
from panelspark.plans.registered import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_contract():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    queries, oracles = QUERIES, ORACLES
    assert len(queries) >= 113 and set(oracles) <= set(queries)
    assert set(queries) - set(oracles) == {
        "bronze_manifest", "artifact_files", "wild_cluster_bootstrap_drawn", "model_suite",
        "model_suite_coefficients", "model_suite_multi_vintage", "model_suite_single_zone",
        "model_suite_energy_weather", "model_suite_zone_panel",
    }


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in check_oracles.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize(
    "name",
    ["mart_multi_zone_impact", "mart_forecast_error", "error_metrics_horizon", "condition_summary",
     "zone_regime_summary", "ols_two_way_cluster", "wild_cluster_bootstrap", "scan_power_json",
     "contract_validation", "spearman_matrix"],
)
def test_oracle(spark, database, name):
    mine = entry.queries()[name](spark, SF).toPandas()
    theirs = database.execute(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert check_oracles.normalized(mine) == check_oracles.normalized(theirs)
