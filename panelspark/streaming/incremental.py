"""New Bronze market deliveries to Silver with Structured Streaming.

The batch lake only knows "a new immutable batch appears". This job keeps that
contract but reads only the files that are new since the last run.

Each micro-batch writes one Silver folder named by the stream's query id (kept
in its checkpoint) and the batch number. A retried batch rewrites only its own
folder; a new checkpoint, or a stream over another landing folder, writes new
folders and never touches those of other streams. A key is new when no other
folder holds it, so every Silver key is stored exactly once.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from panelspark.session import materialize

SILVER_KEY = ["bzn", "metric", "event_time_utc"]


def bronze_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def one_per_key(batch: DataFrame) -> DataFrame:
    """One row for each Silver key: of several the smallest, so a retry gives the same."""
    rest = [c for c in batch.columns if c not in SILVER_KEY]
    picked = batch.groupBy(*SILVER_KEY).agg(F.min(F.struct(*rest)).alias("_rest"))
    return picked.select(*SILVER_KEY, "_rest.*").select(*batch.columns)


def new_keys(batch: DataFrame, silver: str, delivery: str) -> DataFrame:
    """Rows whose key no other delivery folder holds, however old the key is.

    Only the Silver partitions (zone and month) that the batch touches are read.
    """
    spark = batch.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(silver)
    storage = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not storage.exists(path):
        return batch
    earlier = spark.read.schema(_stored(batch)).option("basePath", silver).parquet(silver)
    touched = batch.select("bzn", _month()).distinct()
    earlier = earlier.where(F.col("delivery") != delivery).join(touched, ["bzn", "event_month"], "left_semi")
    return batch.join(earlier.select(*SILVER_KEY), SILVER_KEY, "left_anti")


def _month():
    return F.date_format("event_time_utc", "yyyy-MM").alias("event_month")


def _stored(batch: DataFrame) -> T.StructType:
    keys = [T.StructField("delivery", T.StringType()), T.StructField("event_month", T.StringType())]
    return T.StructType([*batch.schema.fields, *keys])


def stream_bronze_to_silver(
    spark: SparkSession, bronze: str, silver: str, checkpoint: str, schema: str
) -> StreamingQuery:
    """Process every file that is new, append its new Silver keys and stop.

    A key is kept once, whenever it arrives again; late keys are kept like
    any other, so nothing is held in state. A micro-batch is written under its
    query id and number and overwrites only that folder when it is retried, so
    a restart does not append twice and another stream loses nothing.
    """
    identity: list[str] = []

    def append(batch: DataFrame, number: int) -> None:
        if not identity:
            identity.append(_query_id(spark, checkpoint))
        delivery = f"{identity[0]}-{number:012d}"
        keys = materialize(one_per_key(batch), "stream-batch")
        fresh = new_keys(keys, silver, delivery).withColumn("event_month", _month())
        fresh.write.mode("overwrite").partitionBy("bzn", "event_month").parquet(f"{silver}/delivery={delivery}")

    return (
        bronze_stream(spark, bronze, schema)
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a streaming query keeps in its checkpoint across restarts."""
    text = "\n".join(r.value for r in spark.read.text(f"{checkpoint}/metadata").collect())
    return json.loads(text)["id"]


def read_silver(spark: SparkSession, silver: str) -> DataFrame:
    stored = spark.read.option("basePath", silver).parquet(f"{silver}/delivery=*")
    return stored.drop("delivery", "event_month")
