"""Session defaults and the shared scratch area.

Intermediate results that must be read twice (cell moments, group statistics,
row positions) are written as Parquet under the folder the cluster names in
``spark.checkpoint.dir``. A written table survives executor loss, cuts the
lineage, and gives Catalyst the true size of a side, so the choice between a
broadcast and a shuffled join is made on measured bytes and never on a hint.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ENGINE_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Fixed when the session starts. Without call-site capture for every column
# expression, wide plans are built several times faster.
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

# Used when the master is not local: enough initial partitions that a shuffle
# of tens of terabytes stays spillable; adaptive execution merges them again.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16384",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def build_session(
    app_name: str = "panelspark",
    master: str | None = None,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """Create or fetch a session with the settings the operators rely on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    scale = {} if master and master.startswith("local") else CLUSTER_SETTINGS
    merged = {**ENGINE_SETTINGS, **STATIC_SETTINGS, **scale, **(settings or {})}
    for key, value in merged.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that was built elsewhere."""
    for key, value in ENGINE_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Only a local master may fall back to a temporary folder of the machine.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    configured = configured or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="panelspark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _scratch_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/panelspark/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder of this application."""
    return f"{_scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, and only those."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
