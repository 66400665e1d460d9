"""Publishing: checks on metrics observed during the write, nothing readable after a failure."""

import os

import pytest
from pyspark.sql import functions as F

from panelspark.sources import sinks


def test_publish_and_reject(spark, folder):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "a", 5.0)], "id long, part string, v double")
    metrics = {"nulls": F.count_if(F.col("v").isNull()), "top": F.max("v")}
    found = sinks.publish(df, f"{folder}/ok", ["part"], metrics, {"rows": lambda m: m["rows"] == 3})
    assert found == {"rows": 3, "nulls": 1, "top": 5.0}
    assert sinks.read_published(spark, f"{folder}/ok").count() == 3
    with pytest.raises(sinks.RejectedBatch) as rejected:
        sinks.publish(df, f"{folder}/bad", ["part"], metrics, {"no nulls": lambda m: m["nulls"] == 0})
    assert rejected.value.failed == ["no nulls"]
    assert sorted(os.listdir(folder)) == ["ok"]
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, f"{folder}/bad")
    with pytest.raises(FileExistsError):
        sinks.publish(df, f"{folder}/ok", ["part"], metrics, {})


def test_empty_batch(spark, folder):
    df = spark.createDataFrame([], "id long, part string")
    with pytest.raises(sinks.RejectedBatch):
        sinks.publish(df, f"{folder}/e", ["part"], {}, {"has rows": lambda m: m["rows"] > 0})
    assert os.listdir(folder) == []
