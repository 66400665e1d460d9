import pytest

from panelspark.operators import guards, joins, reshape
from panelspark.operators.aggregates import observe_silver, silver_counters, silver_report
from panelspark.plans import marts


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_required_columns_and_duplicates(spark):
    f = frame(spark, "k int, v int", [(1, 1), (1, 2), (2, 3), (None, 4), (None, 5)])
    with pytest.raises(guards.DataQualityError, match=r"\['a', 'b'\]"):
        guards.require_columns(f, ["b", "a", "k"])
    with pytest.raises(guards.DataQualityError, match="duplicate"):
        guards.refuse_duplicates(f, ["k"])
    assert guards.duplicate_key_count(f, ["k"]).first().duplicate_key_count == 2
    assert guards.refuse_duplicates(f, ["k", "v"]) is f


def test_cardinality(spark):
    many = frame(spark, "k int, a int", [(1, 1), (1, 2), (3, 3), (None, 4)])
    one = frame(spark, "k int, b int", [(1, 10), (2, 20), (None, 30)])
    joined = joins.left_join_marked(many, one, ["k"], "hit")
    assert sorted((r.a, r.b, r.hit) for r in joined.collect()) == [
        (1, 10, True), (2, 10, True), (3, None, False), (4, None, False)
    ]
    with pytest.raises(guards.DataQualityError):
        joins.left_join_marked(one, many, ["k"])
    with pytest.raises(guards.DataQualityError):
        joins.left_join_indicator(many, one, ["k"], "status")
    status = joins.left_join_indicator(one, one.withColumnRenamed("b", "c"), ["k"], "status")
    assert sorted(r.status for r in status.collect()) == ["both", "both", "left_only"]
    with pytest.raises(ValueError):
        guards.check_cardinality(many, one, ["k"], "many_to_many")


def test_strict_pivot_refuses_repeats(spark):
    rows = [(1, "a", 1.0), (1, "b", 2.0), (2, "a", None)]
    wide = reshape.pivot_metrics(frame(spark, "t int, metric string, value double", rows), ["t"], ["a", "b", "c"], how="strict")
    assert sorted((r.t, r.a, r.b, r.c) for r in wide.collect()) == [(1, 1.0, 2.0, None), (2, None, None, None)]
    repeated = frame(spark, "t int, metric string, value double", rows + [(1, "a", 1.0)])
    with pytest.raises(Exception, match="duplicate key in pivot"):
        reshape.pivot_metrics(repeated, ["t"], ["a", "b"], how="strict").collect()


def test_zone_map_overrides(spark):
    mapping = joins.zone_location_map(spark, {"FR": "paris", "AT": "vienna"}, ["FR=lyon", "CH=bern", "FR=nice"])
    assert {r.bzn: r.location for r in mapping.collect()} == {"FR": "nice", "AT": "vienna", "CH": "bern"}
    with pytest.raises(guards.DataQualityError):
        joins.zone_location_map(spark, {}, ["FR"])
    with pytest.raises(guards.DataQualityError, match="no mapping"):
        joins.require_mapped(frame(spark, "bzn string", [("XX",)]), mapping, "bzn")


def test_missing_required(spark):
    f = frame(spark, "z string, m string", [("A", "x"), ("A", "y"), ("B", "y")])
    assert [tuple(r) for r in guards.missing_required(f, "z", "m", ["x", "y"]).collect()] == [("B", "x")]


def test_silver_long_drops_and_counts(spark, folder):
    wide = frame(spark, "utc string, cet string, a string, b string",
                 [("2024-01-01T00:00:00Z", "l1", "1", "-2"), ("never", "l2", "3", None)])
    mapping = frame(spark, "column string, region string, metric string", [("a", "AT", "wind_profile")])
    long = marts.silver_long(wide, mapping, "utc", "cet", ["a", "b"], "b1", "now")
    got = {(r.source_column, r.event_time_local): (r.region, r.metric, r.unit) for r in long.collect()}
    assert got[("a", "l1")] == ("AT", "wind_profile", "fraction")
    assert got[("b", "l1")] == ("UNKNOWN", "b", "MW") and len(got) == 3
    counters = silver_counters(long).first().asDict()
    assert counters == {
        "non_null_values": 3, "rows_written": 2, "invalid_timestamp_count": 1,
        "negative_physical_value_count": 1, "profile_out_of_range_count": 0,
    }
    rows, observation = observe_silver(long)
    marts.with_valid_time(rows).write.parquet(f"{folder}/silver")
    assert observation.get == counters
    report = silver_report(long.unionByName(long))
    assert report["duplicate_key_count"] == 2 and report["unknown_columns"] == ["b"]


def test_strict_pivot_keeps_every_key_on_request(spark):
    rows = [(1, "a", 1.0), (2, "other", 5.0)]
    df = frame(spark, "t int, metric string, value double", rows)
    assert [tuple(r) for r in reshape.pivot_metrics(df, ["t"], ["a"], how="strict").collect()] == [(1, 1.0)]
    kept = reshape.pivot_metrics(df, ["t"], ["a"], how="strict", every_key=True).orderBy("t").collect()
    assert [tuple(r) for r in kept] == [(1, 1.0), (2, None)]
