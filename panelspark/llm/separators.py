"""Token counts of documents in flat token streams without an index.

A stream is cut into blocks of ids. Each block is searched for the end-of-document
id on its own, vectorised; a document may span any number of blocks, so what
each block needs from those before it (ids and separators so far, place of the
last separator) comes from a prefix scan over the block sums, in two levels so
that one very long stream is no single group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.common import named, written
from panelspark.llm.tokens import byte_bpe_ids

BLOCK_IDS = 1 << 16
_SUPER = 1024


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks (stream, block, ids) of flat binary files of ``width``-byte ids.

    Any file system Spark reads; the reader holds one file in a task, so files
    of up to 2 GB, as token shards usually are. A trailing partial id is left out.
    """
    size = block_ids * width
    files = spark.read.format("binaryFile").load(path)
    last = F.ceil(F.length("content") / size).cast("int") - 1
    return (
        files.where(F.length("content") >= width)
        .select(F.col("path").alias("stream"), "content", F.explode(F.sequence(F.lit(0), last)).alias("block"))
        .select("stream", F.col("block").cast("long"), F.expr(f"substring(content, block * {size} + 1, {size})").alias("ids"))
    )


def _streamed(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    """One flat stream per partition: ids of all rows, each followed by the end id."""
    end = np.array([end_id], "<u2").tobytes()
    stream, block, pending, held, ending = str(TaskContext.get().partitionId()), 0, [], 0, []
    size = 2 * block_ids

    def row(body: bytes, documents: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([stream]), pa.array([block], pa.int64()), pa.array([body], pa.binary()),
             pa.array([documents], pa.list_(pa.int64()))],
            names=["stream", "block", "ids", "doc_ids"],
        )

    for batch in batches:
        documents, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for begin in range(0, len(documents), 64):
            part = byte_bpe_ids(texts.slice(begin, 64).to_pylist(), vocabulary, ordinary=True)
            for document, body in zip(documents[begin : begin + 64], part):
                body = body + end
                while held + len(body) >= size:
                    cut = size - held
                    pending.append(body[:cut])
                    body = body[cut:]
                    yield row(b"".join(pending), ending + ([document] if not body else []))
                    block, pending, held, ending = block + 1, [], 0, []
                    if not body:
                        break
                if body:
                    pending.append(body)
                    held += len(body)
                    ending.append(document)
    if held:
        yield row(b"".join(pending), ending)


def token_streams(
    df: DataFrame, vocabulary: str, end_id: int, text_column: str = "text", id_column: str = "doc_id",
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Flat streams of 16-bit ids of a table: (stream, block, ids) and, beside them,
    the ids of the documents that end in each block. A null text is empty; end
    marks inside a text are ordinary text."""
    picked = df.select(named(df, id_column).cast("long").alias("doc_id"), named(df, text_column).alias("text"))
    return picked.mapInArrow(
        partial(_streamed, vocabulary=vocabulary, end_id=end_id, block_ids=block_ids),
        "stream string, block long, ids binary, doc_ids array<long>",
    )


def _searched(batches: Iterator[pa.RecordBatch], end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, counts = [], []
        for ids in batch.column("ids"):
            body = ids.as_buffer()
            values = np.frombuffer(body, f"<u{width}", len(body) // width) if body is not None else np.zeros(0, "<u2")
            found.append(np.flatnonzero(values == end_id))
            counts.append(len(values))
        rest = [n for n in batch.schema.names if n != "ids"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in rest], pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
            names=[*rest, "n_ids", "places"],
        )


def token_counts(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """One row per document: stream, ordinal, start, n_tokens, terminated.

    ``blocks`` has stream, block (ascending in the stream) and ids (little-endian,
    ``width`` bytes each); if it has doc_ids, the ids of the documents that end
    in the block, the result has doc_id. A document is what lies between two end ids,
    possibly nothing; ids after the last end id are a document that is not
    terminated. Null or empty blocks hold nothing. A block given twice counts twice.
    """
    has_ids = "doc_ids" in blocks.columns
    picked = blocks.select("stream", "block", "ids", *(["doc_ids"] if has_ids else []))
    schema = f"stream string, block long{', doc_ids array<long>' if has_ids else ''}, n_ids long, places array<long>"
    found = written(picked.mapInArrow(partial(_searched, end_id=end_id, width=width), schema), "block-separators")
    sums = found.select(
        "stream", F.floor(F.col("block") / _SUPER).alias("group"), "block", "n_ids",
        F.size("places").cast("long").alias("n_ends"), F.try_element_at("places", F.lit(-1)).alias("last"),
    )
    earlier = Window.partitionBy("stream", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    sums = (
        sums.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(earlier), zero))
        .withColumn("ends_before", F.coalesce(F.sum("n_ends").over(earlier), zero))
        .withColumn("last", F.col("ids_before") + F.col("last"))
        .withColumn("last_before", F.max("last").over(earlier))
    )
    sums = written(sums, "block-sums")
    groups = sums.groupBy("stream", "group").agg(
        F.sum("n_ids").alias("ids"), F.sum("n_ends").alias("ends"), F.max("last").alias("group_last")
    )
    before = Window.partitionBy("stream").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        groups.withColumn("ids_base", F.coalesce(F.sum("ids").over(before), zero))
        .withColumn("ends_base", F.coalesce(F.sum("ends").over(before), zero))
        .withColumn("last_base", F.max(F.col("ids_base") + F.col("group_last")).over(before))
    )
    carried = sums.join(groups, ["stream", "group"]).select(
        "stream", "block",
        (F.col("ids_base") + F.col("ids_before")).alias("start_id"),
        (F.col("ends_base") + F.col("ends_before")).alias("first_ordinal"),
        F.coalesce(F.col("ids_base") + F.col("last_before"), "last_base", F.lit(-1)).alias("previous"),
    )
    carried = written(carried, "carried")
    ends = found.join(carried, ["stream", "block"]).select(
        "stream", "start_id", "first_ordinal", "previous", "places", *(["doc_ids"] if has_ids else []),
        F.posexplode("places").alias("k", "place"),
    )
    before_k = F.when(F.col("k") == 0, F.col("previous")).otherwise(
        F.col("start_id") + F.try_element_at("places", F.when(F.col("k") == 0, 1).otherwise(F.col("k")))
    )
    ends = ends.select(
        *([F.try_element_at("doc_ids", F.col("k") + 1).alias("doc_id")] if has_ids else []),
        "stream", (F.col("first_ordinal") + F.col("k")).alias("ordinal"), (before_k + 1).alias("start"),
        (F.col("start_id") + F.col("place") - before_k - 1).alias("n_tokens"), F.lit(True).alias("terminated"),
    )
    whole = groups.groupBy("stream").agg(
        F.sum("ids").alias("total"), F.sum("ends").alias("ordinal"), F.max(F.col("ids_base") + F.col("group_last")).alias("final")
    )
    rest = F.col("total") - F.coalesce("final", F.lit(-1)) - 1
    tails = whole.where(rest > 0).select(
        *([F.lit(None).cast("long").alias("doc_id")] if has_ids else []),
        "stream", "ordinal", (F.coalesce("final", F.lit(-1)) + 1).alias("start"), rest.alias("n_tokens"),
        F.lit(False).alias("terminated"),
    )
    return ends.unionByName(tails)
