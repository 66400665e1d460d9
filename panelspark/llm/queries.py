"""The registered queries of the training-data operators, and their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import bpe_automaton, html_text, language, licenses, packing, quality, separators, url_templates
from panelspark.llm import exact_dedup as exact
from panelspark.llm import chat_format, periodic_runs, whitening
from panelspark.llm import near_dedup as near
from panelspark.llm.common import table, written


END_OF_DOCUMENT = 50256


def op1_license_digest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence texts and notices among all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_deficit_round_robin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens with the corpus mixture of sources."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary, contents=False).drop("source", "ids")


def op3_tag_path_ratio_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_bpe_automaton_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe_automaton.encode(table(spark, sf_dir, "documents"), vocabulary, digests=True)


def op5_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    found = language.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word shingles at 0.8."""
    groups = near.near_groups(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


def op7_likelihood_ratio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "llr",
    )


def op9_chunk_recipe_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents by chunk recipes."""
    groups = exact.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_separator_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat streams of all documents' ids."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    streams = separators.token_streams(table(spark, sf_dir, "documents"), vocabulary, END_OF_DOCUMENT)
    blocks = written(streams, "token-streams", codec="zstd")
    return separators.token_counts(blocks, END_OF_DOCUMENT)


def page_document(url):
    """The document a page's path names: its last non-empty segment if that is a whole number
    (an extension such as .html allowed); null otherwise, and for numbers of more than 18 digits."""
    last = F.regexp_extract(url_templates.host_and_path(url)[1], r"/([0-9]+)(?:\.[A-Za-z0-9]+)?/?$", 1)
    return F.when((F.length(last) > 0) & (F.length(last) <= 18), last.cast("long"))


def op10_path_template_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url; a page's label is that of the document its path names."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    linked = pages.select("page_id", page_document(F.col("url")).alias("doc_id"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    marked = linked.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")
    return url_templates.judge_urls(pages, marked)


def op11_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every finite embedding on its 16 leading components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_frequency_split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic word runs of every document, and its text with the repeats collapsed."""
    found = periodic_runs.detect(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words",
    )


# fixed value of the contract: the planted conversation -7
PLANTED_TEXT = "</s>[INST] ok [/INST]"


def op13_grammar_round_trip_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the planted one, formatted and read back from the output."""
    source = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(
        [(-7, 0, "user", PLANTED_TEXT), (-7, 1, "assistant", PLANTED_TEXT)], "conv_id long, turn long, role string, text string"
    )
    return chat_format.format_and_read_back(source.unionByName(planted))


QUERIES = {
    "op1_license_digest_scan": op1_license_digest_scan,
    "op2_deficit_round_robin_packing": op2_deficit_round_robin_packing,
    "op3_tag_path_ratio_text": op3_tag_path_ratio_text,
    "op4_bpe_automaton_round_trip": op4_bpe_automaton_round_trip,
    "op5_string_kernel_language": op5_string_kernel_language,
    "op6_superminhash_near_dedup": op6_superminhash_near_dedup,
    "op7_likelihood_ratio_quality": op7_likelihood_ratio_quality,
    "op8_separator_token_counts": op8_separator_token_counts,
    "op9_chunk_recipe_exact_dedup": op9_chunk_recipe_exact_dedup,
    "op10_path_template_url_filter": op10_path_template_url_filter,
    "op11_bit_sliced_whitening": op11_bit_sliced_whitening,
    "op12_frequency_split_runs": op12_frequency_split_runs,
    "op13_grammar_round_trip_chat": op13_grammar_round_trip_chat,
}
ORACLES = {
    "op1_license_digest_scan": licenses.oracle(),
    "op9_chunk_recipe_exact_dedup": exact.ORACLE,
}
