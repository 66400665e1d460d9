"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so, every chunk becomes a 64-bit identifier,
and a document is the ordered list of its identifiers, its recipe. Identifiers
are verified: each distinct chunk is moved once, and chunks that share an
identifier but differ are told apart by their rank. Equal recipes are then equal
texts, and no long document is moved or compared again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelspark.llm.common import named, written

# every run of white space that is not one single space already
_UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
# a cut after the first vowel or s before a space beyond 512 characters, at the
# latest after 2048; the matches of the pattern lie end to end
CHUNK_PATTERN = r"(?s).{512,2047}?[aeios] |.{1,2048}"


def normalised(text: Column) -> Column:
    """Null is empty; every run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN_SPACE, " ")


def chunks_of(text: Column) -> Column:
    """The content-defined chunks in order; none for an empty text."""
    return F.regexp_extract_all(text, F.lit(CHUNK_PATTERN), F.lit(0))


def _identifier(chunk: Column, key_bits: int) -> Column:
    code = F.xxhash64(chunk)
    return code if key_bits >= 64 else code.bitwiseAND(F.lit((1 << key_bits) - 1))


def chunk_collisions(df: DataFrame, text_column: str = "text", key_bits: int = 64) -> DataFrame:
    """Identifiers that stand for more than one chunk: each distinct chunk moves once.

    Copies of a chunk meet in the map tasks first, so a group of copies sends
    one row per task.
    """
    chunk = F.explode(chunks_of(normalised(named(df, text_column)))).alias("chunk")
    store = df.select(chunk).select(_identifier(F.col("chunk"), key_bits).alias("key"), "chunk").distinct()
    return store.groupBy("key").count().where("count > 1").select("key")


def _variants(df: DataFrame, text_column: str, collisions: DataFrame, key_bits: int) -> DataFrame:
    """Per text that holds colliding chunks: the ranks of those chunks in order."""
    body = df.select(normalised(named(df, text_column)).alias("body"))
    rows = body.select(
        F.sha2(F.col("body"), 256).alias("text_sha256"),
        F.posexplode(chunks_of(F.col("body"))).alias("place", "chunk"),
    )
    rows = rows.withColumn("key", _identifier(F.col("chunk"), key_bits)).join(collisions, "key")
    ranks = (
        rows.select("key", "chunk").distinct()
        .withColumn("variant", F.row_number().over(Window.partitionBy("key").orderBy("chunk")))
    )
    return (
        rows.join(ranks, ["key", "chunk"])
        .select("text_sha256", "place", "variant").distinct()
        .groupBy("text_sha256")
        .agg(F.sort_array(F.collect_list(F.struct("place", "variant"))).alias("variants"))
    )


def exact_groups(
    df: DataFrame,
    text_column: str = "text",
    id_column: str = "doc_id",
    carry: bool = False,
    key_bits: int = 64,
) -> DataFrame:
    """One row per input row: its id, the id that stays, group size, kept, digest.

    Texts are equal when identical after every run of ASCII white space became
    one space; null counts as empty, and all empty texts are one group. The row
    with the smallest id stays; of rows that share that id exactly one stays; a
    null id stays only where its group has no other. An empty table gives an
    empty result. ``carry`` adds the whole input row as the struct ``row``, so
    clashing column names do no harm. ``key_bits`` shortens the identifiers (to
    test their verification).
    """
    body = df.select(
        named(df, id_column).alias("doc_id"),
        normalised(named(df, text_column)).alias("body"),
        *([F.struct(*[named(df, c) for c in df.columns]).alias("row")] if carry else []),
    )
    recipes = body.select(
        "doc_id",
        F.sha2(F.col("body"), 256).alias("text_sha256"),
        F.transform(chunks_of(F.col("body")), lambda c: _identifier(c, key_bits)).alias("recipe"),
        *(["row"] if carry else []),
        F.monotonically_increasing_id().alias("row_no"),
    )
    recipes = written(recipes, "recipes")
    collisions = written(chunk_collisions(df, text_column, key_bits), "chunk-collisions")
    if collisions.isEmpty():
        recipes = recipes.withColumn("variants", F.lit(None).cast("array<int>"))
    else:
        variants = _variants(df, text_column, collisions, key_bits)
        recipes = written(recipes.join(variants, "text_sha256", "left"), "recipes")
    key = ["recipe", "variants"]
    groups = (
        recipes.groupBy(*key)
        .agg(
            F.count("*").alias("group_size"),
            F.min("doc_id").alias("keep_id"),
            F.coalesce(F.min_by("row_no", "doc_id"), F.min("row_no")).alias("keep_row"),
        )
        .where("group_size > 1")
    )
    groups = groups.withColumnsRenamed({k: f"group_{k}" for k in key})
    groups = written(groups, "copy-groups")
    same = (recipes.recipe == groups.group_recipe) & recipes.variants.eqNullSafe(groups.group_variants)
    single = F.col("keep_row").isNull()
    if carry:  # whole rows move once, at every size alike
        groups = groups.hint("merge")
    return recipes.join(groups, same, "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast(T.LongType())).alias("group_size"),
        (single | (F.col("row_no") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
        *(["row"] if carry else []),
    )


def exact_dedup(df: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows that stay, whole and with the input's columns; rules as in ``exact_groups``."""
    return exact_groups(df, text_column, id_column, carry=True).where("kept").select("row.*")


ORACLE = r"""
WITH bodies AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM bodies WINDOW same AS (PARTITION BY body)
"""
