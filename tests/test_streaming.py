import datetime as dt

from panelspark.streaming.incremental import read_silver, stream_bronze_to_silver

SCHEMA = "bzn string, metric string, event_time_utc timestamp, value double"
T0 = dt.datetime(2024, 6, 1)


def deliver(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_new_files_are_appended_once(spark, folder):
    bronze, silver, checkpoint = f"{folder}/bronze", f"{folder}/silver", f"{folder}/checkpoint"

    def run():
        stream_bronze_to_silver(spark, bronze, silver, checkpoint, SCHEMA).awaitTermination()
        return sorted((r.bzn, r.event_time_utc.hour, r.value) for r in read_silver(spark, silver).collect())

    deliver(spark, bronze, [("FR", "p", T0, 1.0), ("FR", "p", T0, 1.0), ("AT", "p", T0, 2.0)])
    assert run() == [("AT", 0, 2.0), ("FR", 0, 1.0)]
    assert run() == [("AT", 0, 2.0), ("FR", 0, 1.0)]
    later = T0 + dt.timedelta(hours=1)
    deliver(spark, bronze, [("FR", "p", T0, 1.0), ("FR", "p", later, 3.0)])
    assert run() == [("AT", 0, 2.0), ("FR", 0, 1.0), ("FR", 1, 3.0)]


def test_late_keys_are_kept(spark, folder):
    bronze, silver, checkpoint = f"{folder}/bronze", f"{folder}/silver", f"{folder}/checkpoint"
    for day in (20, 21, 10, 20):
        deliver(spark, bronze, [("FR", "p", dt.datetime(2024, 1, day), float(day))])
        stream_bronze_to_silver(spark, bronze, silver, checkpoint, SCHEMA).awaitTermination()
    assert sorted(r.value for r in read_silver(spark, silver).collect()) == [10.0, 20.0, 21.0]


def test_new_checkpoint_over_same_bronze_stores_no_copy(spark, folder):
    bronze, silver = f"{folder}/bronze", f"{folder}/silver"
    deliver(spark, bronze, [("FR", "p", T0, 1.0)])
    stream_bronze_to_silver(spark, bronze, silver, f"{folder}/c1", SCHEMA).awaitTermination()
    deliver(spark, bronze, [("FR", "p", T0 + dt.timedelta(hours=1), 2.0)])
    stream_bronze_to_silver(spark, bronze, silver, f"{folder}/c1", SCHEMA).awaitTermination()
    stream_bronze_to_silver(spark, bronze, silver, f"{folder}/c2", SCHEMA).awaitTermination()
    assert sorted(r.value for r in read_silver(spark, silver).collect()) == [1.0, 2.0]


def test_new_landing_folder_loses_nothing(spark, folder):
    silver = f"{folder}/silver"
    deliver(spark, f"{folder}/landing1", [("FR", "p", T0, 1.0)])
    stream_bronze_to_silver(spark, f"{folder}/landing1", silver, f"{folder}/c1", SCHEMA).awaitTermination()
    deliver(spark, f"{folder}/landing2", [("FR", "p", T0 + dt.timedelta(hours=2), 3.0), ("FR", "p", T0, 9.0)])
    stream_bronze_to_silver(spark, f"{folder}/landing2", silver, f"{folder}/c2", SCHEMA).awaitTermination()
    assert sorted(r.value for r in read_silver(spark, silver).collect()) == [1.0, 3.0]
