"""Registry of lake artifacts built from a file listing and batch reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.constants import LINEAGE_KEYS
from panelspark.sources.files import artifact_files

# Report names per layer, in order of preference for Bronze.
BRONZE_REPORTS = ["quality_report.json", "manifest.jsonl"]
SILVER_REPORTS = ["quality_report.json"]
GOLD_REPORTS = ["gold_report.json", "error_report.json"]
RATE_FIELDS = ("match_rate",)

_BATCH = r"^((?:.*/)?(?:bronze|silver)/[^/]+/ingestion_date=[^/]+/batch_id=[^/]+)(?:/.*)?$"
_LAYER = r"(?:^|/)(bronze|silver|gold)/([^/]+)/"


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _ancestors(path: Column) -> Column:
    """Every directory above a file, so a prefix match becomes an equality."""
    parts = F.split(path, "/")
    depths = F.sequence(F.lit(1), F.size(parts) - 1)
    return F.when(
        F.size(parts) > 1,
        F.transform(depths, lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/")),
    ).otherwise(F.array().cast("array<string>"))


def discover_artifacts(files: DataFrame, gold_reports: Sequence[str] = GOLD_REPORTS) -> DataFrame:
    """(layer, dataset, artifact_path, report_path) from (path, bytes).

    A Bronze artifact is a batch folder, with the best report found in or
    below it. A Silver or Gold artifact is the folder of a report file.
    """
    named = files.select(
        "path",
        F.regexp_extract("path", _LAYER, 1).alias("layer"),
        F.regexp_extract("path", _LAYER, 2).alias("dataset"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
    )
    batch = F.regexp_extract("path", _BATCH, 1)
    in_batch = F.concat(batch, F.lit("/"), F.col("name")) == F.col("path")
    # larger is better: a report in the folder, then the last nested manifest
    rank = (
        F.when(in_batch & (F.col("name") == BRONZE_REPORTS[0]), 3)
        .when(in_batch & (F.col("name") == BRONZE_REPORTS[1]), 2)
        .when(F.col("name") == BRONZE_REPORTS[1], 1)
    )
    bronze = (
        named.where((F.col("layer") == "bronze") & (batch != ""))
        .groupBy("layer", "dataset", batch.alias("artifact_path"))
        .agg(
            F.max_by(
                F.when(rank.isNotNull(), F.col("path")),
                F.struct(F.coalesce(rank, F.lit(0)), "path"),
            ).alias("report_path")
        )
    )
    folders = named.where(
        ((F.col("layer") == "silver") & F.col("name").isin(SILVER_REPORTS) & (batch != ""))
        | ((F.col("layer") == "gold") & F.col("name").isin(*gold_reports))
    ).select("layer", "dataset", _directory(F.col("path")).alias("artifact_path"),
             F.col("path").alias("report_path"))
    return bronze.unionByName(folders)


def count_below(artifacts: DataFrame, files: DataFrame, pattern: str, prefix: str) -> DataFrame:
    """File count and bytes below each artifact for names matching ``pattern``."""
    wanted = files.where(F.col("path").rlike(pattern)).select(
        "path", "bytes", F.explode(_ancestors(F.col("path"))).alias("artifact_path")
    )
    inside = wanted.join(artifacts.select("artifact_path").distinct(), "artifact_path")
    return artifact_files(inside, "artifact_path").withColumnsRenamed(
        {"file_count": f"{prefix}_file_count", "bytes": f"{prefix}_bytes"}
    )


def _field(name: str, kind: str) -> Column:
    return F.try_variant_get("document", f"$.{name}", kind)


def lineage_columns(document: str = "document") -> dict[str, Column]:
    """``lineage_<key>`` texts of the upstream keys a report may carry."""
    return {
        f"lineage_{key}": F.try_variant_get(document, f"$.{key}", "string")
        for key in LINEAGE_KEYS
    }


def build_registry(
    files: DataFrame,
    reports: DataFrame,
    minimum_match_rate: float = 0.99,
    rate_fields: Sequence[str] = RATE_FIELDS,
    gold_reports: Sequence[str] = GOLD_REPORTS,
) -> DataFrame:
    """One row per artifact with its checks and status.

    ``files``: (path, bytes). ``reports``: (path, document as variant); a
    report that could not be read is an empty document.
    """
    if not 0 <= minimum_match_rate <= 1:
        raise ValueError("the minimum match rate lies between 0 and 1")
    artifacts = discover_artifacts(files, gold_reports)
    joined = (
        artifacts.join(
            reports.select(F.col("path").alias("report_path"), "document"), "report_path", "left"
        )
        .join(count_below(artifacts, files, r"\.parquet$", "parquet"), "artifact_path", "left")
        .join(
            count_below(artifacts, files, r"(^|/)manifest\.jsonl$", "manifest"),
            "artifact_path",
            "left",
        )
        .fillna(0, [f"{p}_{c}" for p in ("parquet", "manifest") for c in ("file_count", "bytes")])
    )
    bronze, silver, gold = (F.col("layer") == n for n in ("bronze", "silver", "gold"))
    rate = F.coalesce(*[_field(name, "double") for name in rate_fields])
    invalid = F.coalesce(
        _field("quality_checks.invalid_timestamp_count", "bigint"),
        _field("invalid_timestamps", "bigint"),
        _field("invalid_timestamp_count", "bigint"),
    )

    def check(name: str, applies: Column, passed: Column) -> Column:
        return F.when(applies, F.struct(F.lit(name).alias("name"), passed.alias("passed")))

    checks = F.array_compact(
        F.array(
            check("report_present", F.lit(True), F.col("report_path").isNotNull()),
            check("parquet_present", F.lit(True), bronze | (F.col("parquet_file_count") > 0)),
            check("manifest_present", F.lit(True), ~bronze | (F.col("manifest_file_count") > 0)),
            check("match_rate_gate", gold & rate.isNotNull(), rate >= minimum_match_rate),
            check("invalid_timestamp_gate", silver & invalid.isNotNull(), invalid == 0),
        )
    )
    checked = joined.withColumn("_checks", checks)
    failed = F.transform(F.filter("_checks", lambda c: ~c["passed"]), lambda c: c["name"])
    return checked.select(
        "layer",
        "dataset",
        F.nullif(F.regexp_extract("artifact_path", r"(?:^|/)batch_id=([^/]+)", 1), F.lit(""))
        .alias("batch_id"),
        "artifact_path",
        "report_path",
        _field("layer", "string").alias("report_layer"),
        F.coalesce(
            _field("rows", "bigint"), _field("rows_gold", "bigint"), _field("rows_written", "bigint")
        ).alias("rows"),
        "parquet_file_count",
        "parquet_bytes",
        "manifest_file_count",
        "manifest_bytes",
        rate.alias("match_rate"),
        F.when(F.size(failed) == 0, "COMPLETE").otherwise("WARN").alias("status"),
        failed.alias("failed_checks"),
        F.size("_checks").alias("check_count"),
        (F.size("_checks") - F.size(failed)).alias("passed_check_count"),
        *[column.alias(name) for name, column in lineage_columns().items()],
    )


def ordered_registry(registry: DataFrame) -> DataFrame:
    names = ["layer", "dataset", "batch_id", "artifact_path"]
    return registry.orderBy(*[F.col(n).asc_nulls_last() for n in names])


def registry_summary(registry: DataFrame) -> DataFrame:
    return registry.agg(
        F.count(F.lit(1)).alias("artifact_count"),
        F.count_if(F.col("status") == "COMPLETE").alias("complete_count"),
        F.count_if(F.col("status") == "WARN").alias("warning_count"),
    )


def write_registry(registry: DataFrame, path: str) -> None:
    """The registry as Parquet and, with lists as text, as CSV."""
    ordered = ordered_registry(registry)
    ordered.write.mode("errorifexists").parquet(f"{path}/parquet")
    flat = ordered.withColumn("failed_checks", F.to_json("failed_checks"))
    flat.write.mode("errorifexists").option("header", True).csv(f"{path}/csv")


def observed_columns(spark: SparkSession, artifacts: DataFrame, root: str = "") -> DataFrame:
    """(artifact_path, observed): column names of each Parquet artifact.

    Reads file footers only, one artifact after the other: the control plane
    has a row for each artifact, not for each file.
    """
    paths = [r[0] for r in artifacts.select("artifact_path").distinct().toLocalIterator()]
    rows = []
    for path in paths:
        reader = spark.read.option("pathGlobFilter", "part-*.parquet")
        try:
            names = reader.parquet(f"{root}{path}").columns
        except AnalysisException:
            names = []
        rows.append((path, names))
    schema = T.StructType(
        [
            T.StructField("artifact_path", T.StringType()),
            T.StructField("observed", T.ArrayType(T.StringType())),
        ]
    )
    return spark.createDataFrame(rows, schema)
