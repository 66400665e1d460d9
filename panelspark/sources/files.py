"""CSV, Parquet and file-level sources of the lake."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The ``binaryFile`` source holds a file in one value and refuses more bytes.
WHOLE_FILE_BYTES = 2**31 - 1
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
TIME_COLUMNS = ("utc_timestamp", "cet_cest_timestamp")
MAPPING_SCHEMA = (
    "resources array<struct<schema: struct<fields: array<struct<name: string, "
    "opsdProperties: struct<Region: string, Variable: string>>>>>>"
)


def read_wide_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Wide CSV with every column as text; the melt coerces the values.

    Without ``columns`` the names come from the header line alone.
    """
    if columns is None:
        columns = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).csv(path)


def read_column_mapping(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """(column, region, metric) from the field metadata of a data package."""
    package = (
        spark.read.schema(MAPPING_SCHEMA).option("multiLine", str(one_per_file).lower()).json(path)
    )
    fields = package.select(F.explode("resources").alias("r")).select(
        F.explode("r.schema.fields").alias("f")
    )
    properties = F.col("f.opsdProperties")
    named = fields.select(
        F.col("f.name").alias("column"),
        properties.getField("Region").alias("region"),
        properties.getField("Variable").alias("metric"),
    ).where("region <> '' and metric <> ''")
    # the same column listed twice keeps one entry
    return named.groupBy("column").agg(
        F.max_by("region", F.concat("region", "metric")).alias("region"),
        F.max_by("metric", F.concat("region", "metric")).alias("metric"),
    )


def read_lake_table(
    spark: SparkSession, root: str, path: str | None = None, schema: str | None = None,
    pattern: str = "part-*.parquet",
) -> DataFrame:
    """Hive-partitioned Parquet below ``root``; reports beside it are skipped."""
    reader = spark.read.option("basePath", root).option("pathGlobFilter", pattern)
    reader = reader.option("recursiveFileLookup", "false")
    if schema:
        reader = reader.schema(schema)
    return reader.parquet(path or root)


def latest_batch(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the last batch: the lexicographically last ``key=value`` path.

    The maximum is taken over the paths of the table's file index, which the
    planner holds already: no job runs and no row is read. The winning values
    become literals, so only the files of that batch are read afterwards. Keys
    that are not in the paths fall back to an aggregate over the rows.
    """
    found = []
    for path in table.inputFiles():
        values = tuple(_path_value(path, key) for key in keys)
        if None not in values:
            found.append(values)
    if found:
        last = dict(zip(keys, max(found)))
    else:
        row = table.agg(F.max(F.struct(*keys)).alias("m")).select("m.*").first()
        if row is None or row[0] is None:
            raise ValueError("the table has no batch")
        last = {key: row[key] for key in keys}
    for key in keys:
        table = table.where(F.col(key) == F.lit(last[key]))
    return table


def _path_value(path: str, key: str) -> str | None:
    match = re.search(rf"(?:^|/){re.escape(key)}=([^/]+)/", path)
    return unquote(match.group(1)) if match else None


def path_keys(files: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """Adds a column per ``key=value`` part of the path; absent keys are null."""
    return files.withColumns(
        {
            key: F.nullif(F.regexp_extract(path, rf"(?:^|/){key}=([^/]+)", 1), F.lit(""))
            for key in keys
        }
    )


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, bytes, modified) of the files below ``path``; contents stay unread."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")
    )


def bronze_manifest(
    spark: SparkSession, path: str, source: str, batch_id: str, pattern: str | None = None,
    whole_bytes: int = WHOLE_FILE_BYTES,
) -> DataFrame:
    """One row per landed file: size, SHA-256, source, batch and status.

    Each task hashes the files of its own splits. A file over ``whole_bytes`` is
    cut into lines, which go back in order to one task: a digest is a chain over
    all bytes of its file, so that task still reads the file whole.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    landed = reader.format("binaryFile").load(path)
    whole = landed.where(F.col("length") <= whole_bytes).select(
        "path", "length", F.sha2("content", 256).alias("sha256")
    )
    large = landed.where(F.col("length") > whole_bytes).select(
        "path", "length", F.col("_metadata.file_path").alias("_uri")
    )
    # "\n" alone ends a line, so that no byte of the file is lost
    lines = reader.format("text").option("lineSep", "\n").load(path)
    lines = lines.where(F.col("_metadata.file_size") > whole_bytes).select(
        F.col("_metadata.file_path").alias("_uri"),
        F.col("_metadata.file_size").alias("_length"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_n"),
        F.col("value").cast("binary").alias("_line"),
    )
    ordered = lines.repartition("_uri").sortWithinPartitions("_uri", "_start", "_n")
    digests = ordered.select("_uri", "_length", "_line").mapInArrow(
        _line_digests, "_uri string, sha256 string"
    )
    hashed = whole.unionByName(large.join(digests, "_uri", "left").drop("_uri"))
    return hashed.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("path"),
        F.col("length").alias("bytes"),
        F.col("sha256"),
        F.lit(source).alias("source"),
        F.lit(batch_id).alias("batch_id"),
        F.when(F.col("length") > 0, "landed").otherwise("empty").alias("status"),
    )


def _line_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uri, SHA-256) of files whose lines come in order, one file after another."""
    uri, length, read, digests = None, 0, 0, {}

    def finished() -> pa.RecordBatch:
        # bytes that the line reader leaves out: a mark at the start, the last line end
        for left_out, digest in digests.items():
            if length - read - left_out in (0, 1):
                digest.update(b"\n" * (length - read - left_out))
                return pa.RecordBatch.from_pydict({"_uri": [uri], "sha256": [digest.hexdigest()]})
        raise ValueError(f"{uri}: {read} bytes in lines, {length} in the file")

    for batch in batches:
        runs = pc.run_end_encode(batch.column(0))
        begin = 0
        for end, name in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
            piece = b"\n".join(batch.column(2).slice(begin, end - begin).to_pylist())
            if name == uri:
                piece = b"\n" + piece
            else:
                if uri is not None:
                    yield finished()
                uri, length, read = name, batch.column(1)[begin].as_py(), 0
                digests = {len(m): hashlib.sha256(m) for m in (b"", BYTE_ORDER_MARK)}
            for digest in digests.values():
                digest.update(piece)
            read += len(piece)
            begin = end
    if uri is not None:
        yield finished()


def artifact_files(files: DataFrame, artifact: str = "artifact") -> DataFrame:
    """File count and bytes per artifact from a file listing."""
    return files.groupBy(artifact).agg(
        F.countDistinct("path").alias("file_count"), F.sum("bytes").alias("bytes")
    )


def read_tolerant_json(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, document): unreadable text becomes an empty document."""
    text = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
    )
    return text.select(
        F.col("_metadata.file_path").alias("path"), tolerant_document("value").alias("document")
    )


def tolerant_document(text: str):
    return F.coalesce(F.try_parse_json(F.col(text)), F.parse_json(F.lit("{}")))


def series_availability(expected: DataFrame, landed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Expected series with a status: available or unavailable.

    A missing optional series is metadata; a missing required one is an error
    raised while the rows are computed.
    """
    seen = landed.select(*key).distinct().withColumn("_seen", F.lit(True))
    joined = expected.join(seen, list(key), "left")
    name = F.concat_ws("/", *key)
    status = (
        F.when(F.col("_seen"), F.lit("available"))
        .when(F.col("optional"), F.lit("unavailable"))
        .otherwise(F.raise_error(F.concat(F.lit("required series did not land: "), name)))
    )
    return joined.withColumn("status", status).drop("_seen")
