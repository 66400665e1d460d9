"""Quality rules: hashed n-gram likelihood ratio of trusted target against raw corpus.

Byte n-grams (n = 1 to 3) are hashed into 2^16 buckets. One multinomial is
counted over all documents, one over documents labelled good. A document's
score is the mean log ratio of its n-grams. The threshold is the cut that
separates labelled good from labelled bad documents best, so every document
gets a fixed verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import extended, mixed, named, row_slices, text_bytes, written
from panelspark.llm.words import sequence_hashes, span_hashes, word_spans

BUCKET_BITS = 16
ORDERS = 3
SAMPLE_ROWS = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SLICE_BYTES = 1 << 20
SYMBOLS = "#*$%&|<>"


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams that lie inside one row, and whether each is such, by order."""
    running = np.zeros(len(data), np.uint32)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for order in range(ORDERS):
        count = len(data) - order
        if count <= 0:
            return
        running = running[:count] | (data[order:].astype(np.uint32) << np.uint32(8 * order))
        code = (running + np.uint32((order + 1) * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        code = (code ^ (code >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        yield code >> np.uint32(32 - BUCKET_BITS), np.arange(order, len(data)) < ends[:count]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 1 << BUCKET_BITS
    raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        good = batch.column("good").fill_null(0).to_numpy(zero_copy_only=False) == 1
        for first, last in row_slices(offsets, _SLICE_BYTES):
            bounds = offsets[first : last + 1] - offsets[first]
            trusted = np.repeat(good[first:last], np.diff(bounds))
            for buckets, whole in ngram_buckets(data[offsets[first] : offsets[last]], bounds):
                raw += np.bincount(buckets[whole], minlength=size)
                if trusted.any():
                    target += np.bincount(buckets[whole & trusted[: len(buckets)]], minlength=size)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"]
    )


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(p_target / p_raw) of every bucket, both smoothed by one; 0 without a target."""
    if not target.sum():
        return np.zeros(len(raw))
    smooth = np.log((target + 1.0) / (target.sum() + len(target)))
    return smooth - np.log((raw + 1.0) / (raw.sum() + len(raw)))


def _repeat_words(hashes: np.ndarray, rows: np.ndarray, total: int) -> np.ndarray:
    """Words per row that lie in a three-word window found at least twice in the row."""
    covered = np.zeros(len(hashes), bool)
    windows, owners = sequence_hashes(hashes, rows, 3)
    if len(windows):
        places = np.flatnonzero(rows[: len(rows) - 2] == rows[2:])
        keys = mixed(windows + owners.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            spot = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            hits = places[twice[spot] == keys]
            for k in range(3):
                covered[hits + k] = True
    return np.bincount(rows[covered], minlength=total)


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines per row that hold a word and equal an earlier line of the row."""
    total = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begins = begins[begins < len(data)]
    if not len(begins):
        return np.zeros(total, np.int64)
    stops = np.append(begins[1:], len(data))
    stops = stops - (data[stops - 1] == 10)
    words_before = np.searchsorted(starts, np.stack([begins, np.maximum(begins, stops)]))
    holds = words_before[1] > words_before[0]
    begins, stops = begins[holds], stops[holds]
    rows = np.searchsorted(offsets, begins, side="right") - 1
    hashes = span_hashes(data, begins, stops)
    order = np.lexsort((hashes, rows))
    same = (hashes[order][1:] == hashes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    return np.bincount(rows[order][1:][same], minlength=total)


def measures(data: np.ndarray, offsets: np.ndarray, ratios: np.ndarray | None) -> dict[str, np.ndarray]:
    """The base counts of every row and the mean log ratio of its n-grams (0 if empty)."""
    total = len(offsets) - 1
    starts, ends = word_spans(data, offsets)
    rows = np.searchsorted(offsets, starts, side="right") - 1

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    white = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
    first_byte = (np.arange(256) & 0xC0) != 0x80
    symbol = np.isin(np.arange(256), list(SYMBOLS.encode()))
    score, grams = np.zeros(total), np.zeros(total, np.int64)
    if ratios is not None:
        for buckets, whole in ngram_buckets(data, offsets):
            gains = np.zeros(len(data) + 1)
            gains[1 : len(buckets) + 1] = np.where(whole, ratios[buckets], 0.0)
            sums = np.cumsum(gains)
            score += sums[offsets[1:]] - sums[offsets[:-1]]
            inside = np.zeros(len(data), bool)
            inside[: len(whole)] = whole
            grams += per_row(inside)
    return {
        "n_words": np.bincount(rows, minlength=total),
        "word_chars": per_row((~white & first_byte)[data]),
        "n_symbols": per_row(symbol[data]),
        "n_dup_lines": _duplicate_lines(data, offsets, starts),
        "n_repeat_words": _repeat_words(span_hashes(data, starts, ends), rows, total),
        "llr": score / np.maximum(grams, 1),
    }


def _measured(batches: Iterator[pa.RecordBatch], ratios: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for first, last in row_slices(offsets, _SLICE_BYTES):
            found = measures(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], ratios)
            part = batch.slice(first, last - first)
            rest = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in rest], *[pa.array(v.astype(np.int64) if n != "llr" else v) for n, v in found.items()]],
                names=[*rest, *found],
            )


def trusted_sample(labels: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` labelled documents of each kind: (doc_id, good) with good 1 or 0.

    Good is quality 1 and not toxic, bad is quality 0. The choice is by a hash of the id.
    """
    kind = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).when(F.col("quality") == 0, 0)
    known = labels.select("doc_id", kind.alias("good")).where("good IS NOT NULL AND doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("good").alias("good"))
    sizes = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    place = F.pmod(F.xxhash64(F.lit("trusted"), "doc_id"), F.lit(1 << 30))
    chosen = F.lit(False)
    for good, size in sizes.items():
        chosen = chosen | ((F.col("good") == good) & (place < int((1 << 30) * min(1.0, rows / size)) + 1))
    return known.where(chosen)


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The score from which a document is kept: most good above and most bad below it.

    The middle of the gap is taken, the lowest cut on ties; minus infinity if one
    kind is missing or no cut beats keeping everything.
    """
    if not len(good) or not len(bad):
        return float("-inf")
    values = np.unique(np.concatenate([good, bad]))
    below = lambda x: np.searchsorted(np.sort(x), values, side="left") / len(x)
    gain = below(bad) - below(good)
    best = int(gain.argmax())
    return float("-inf") if gain[best] <= 0 else float((values[best] + values[best - 1]) / 2)


def judge(
    df: DataFrame,
    labels: DataFrame,
    text_column: str = "text",
    id_column: str = "doc_id",
    sample_rows: int = SAMPLE_ROWS,
    carry: bool = False,
) -> DataFrame:
    """One row per input row: the base counts, base_failed, llr and kept.

    Words are runs without ASCII white space; null is an empty text. A document
    fails the base with fewer than 50 words or more than half of its words in
    repeated windows; else it is kept if its llr reaches the threshold. The raw
    counts cover all documents; at most about ``sample_rows`` labelled documents
    of each kind serve as the target and for the threshold. Without usable labels
    every document that passes the base is kept. Repeated rows are judged
    alike; an empty table gives an empty result. ``carry`` adds the input row.
    """
    picked = df.select(
        named(df, id_column).alias("doc_id"),
        named(df, text_column).alias("text"),
        *([F.struct(*[named(df, c) for c in df.columns]).alias("row")] if carry else []),
    )
    sample = written(trusted_sample(labels, sample_rows), "trusted-sample")
    # at most about 2 * sample_rows rows of two numbers
    marked = picked.join(F.broadcast(sample), "doc_id", "left")
    size = 1 << BUCKET_BITS
    counts = (
        marked.select("text", F.col("good").cast("int").alias("good"))
        .mapInArrow(_counted, "bucket long, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toArrow()
    )
    raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
    buckets = counts.column("bucket").to_numpy()
    raw[buckets], target[buckets] = counts.column("raw").to_numpy(), counts.column("target").to_numpy()
    numbers = ", ".join(f"{n} long" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    measure = partial(_measured, ratios=log_ratios(raw, target))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))

    def measured(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(measure, extended(rows, "text", f"{numbers}, llr double")).withColumn("base_failed", failed)

    labelled = picked.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    known = measured(labelled).where("NOT base_failed").select("good", "llr").toArrow()
    good, llr = known.column("good").to_numpy(), known.column("llr").to_numpy()
    cut = best_cut(llr[good == 1], llr[good == 0])
    return measured(picked).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(cut)))


def keep_good(df: DataFrame, labels: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows that are kept, whole and with the input's columns; rules as in ``judge``."""
    return judge(df, labels, text_column, id_column, carry=True).where("kept").select("row.*")
