"""Language identification by string kernels.

The kernel of two texts counts the letter n-grams (n = 1 to 4, over letters and
word gaps, hashed into buckets) that occur in both, whatever their number of
occurrences, and is normalised by the two set sizes. A bounded labelled sample
gives landmarks and, through their Nystroem features, one ridge regression per
language against the rest. Scores are linear in the presence vector, so whole
batches are scored as one sparse-by-dense matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import extended, id_crc, mixed, named, worker_state

BUCKET_BITS = 17
ORDERS = 4
SAMPLE_ROWS = 1200
LANDMARKS = 96
RIDGE = 1e-4
_FOLDS, _HELD_OUT = 3, 1
_STEP_CODES = 1 << 19


class Model(NamedTuple):
    """Learned languages and the weight of each n-gram bucket for each of them."""

    languages: list
    weights: np.ndarray


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _buckets(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of every n-gram of the code sequence, order by order."""
    running = np.zeros(len(codes), np.uint64)
    for order in range(ORDERS):
        if len(codes) <= order:
            return
        running = running[: len(codes) - order] * np.uint64(0x100000001B3) + codes[order:]
        yield (mixed(running + np.uint64(order << 56)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def presence(text: str, found: np.ndarray) -> np.ndarray:
    """Ascending buckets of the n-grams in the whole text; empty without letters.

    ``found`` is an all-False table of all buckets and is handed back so. Long
    texts go through in overlapping steps.
    """
    letters = worker_state(("letters",), _letters)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[codes]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    codes = np.where(is_letter, codes, 32).astype(np.uint64)
    for begin in range(0, len(codes), _STEP_CODES):
        for buckets in _buckets(codes[begin : begin + _STEP_CODES + ORDERS - 1]):
            found[buckets] = True
    present = np.flatnonzero(found)
    found[present] = False
    return present


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(1 << BUCKET_BITS, bool)
    for batch in batches:
        bits = []
        for text in batch.column("text"):
            table = np.zeros(1 << BUCKET_BITS, bool)
            table[presence(text.as_py() or "", found)] = True
            bits.append(np.packbits(table).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), pa.array(bits, pa.binary())],
            names=["doc_id", "lang", "bits"],
        )


def held_out(identifier: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(id_crc(identifier) % _FOLDS == _HELD_OUT, F.lit(False))


def labelled_sample(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` training rows, as many of each language, chosen by a hash of the id."""
    eligible = df.where((id_crc(F.col("doc_id")) % _FOLDS != _HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in eligible.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return eligible.where(F.lit(False))
    share = max(1, rows // len(sizes))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    chosen = F.lit(False)
    for language, size in sorted(sizes.items()):
        chosen = chosen | ((F.col("lang") == language) & (place < int((1 << 30) * min(1.0, share / size)) + 1))
    return eligible.where(chosen)


def _unpacked(rows: list, size: int) -> Iterator[np.ndarray]:
    for begin in range(0, len(rows), size):
        part = np.frombuffer(b"".join(rows[begin : begin + size]), np.uint8).reshape(-1, 1 << (BUCKET_BITS - 3))
        yield np.unpackbits(part, axis=1).astype(np.float32)


def fit(df: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> Model:
    """Train on about ``sample_rows`` labelled rows (columns doc_id, text, lang).

    The driver receives 16 KB for each sampled row, whatever its length.
    """
    sample = labelled_sample(df, sample_rows).select("doc_id", "lang", "text")
    rows = sample.mapInArrow(_packed, "doc_id long, lang string, bits binary").toArrow().to_pylist()
    rows = sorted((r for r in rows if any(r["bits"])), key=lambda r: (r["doc_id"], r["lang"], r["bits"]))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32))
    marks = []
    for language in languages:
        marks += [r["bits"] for r in rows if r["lang"] == language][: max(1, landmarks // len(languages))]
    bits = [r["bits"] for r in rows]
    base = np.concatenate(list(_unpacked(marks, 32)))
    base /= np.sqrt(base.sum(axis=1, keepdims=True))
    kernel = np.concatenate(
        [part @ base.T / np.sqrt(part.sum(axis=1, keepdims=True)) for part in _unpacked(bits, 32)]
    ).astype(np.float64)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    usable = values > values.max() * 1e-8
    root = vectors[:, usable] / np.sqrt(values[usable])
    features = kernel @ root
    wanted = np.where(np.array([[r["lang"] == l for l in languages] for r in rows]), 1.0, -1.0)
    # each class and its rest weigh the same, so no language is favoured
    normal = features.T @ features + RIDGE * len(rows) * np.eye(features.shape[1])
    solved = np.linalg.solve(normal, features.T @ wanted)
    return Model(languages, (base.T @ (root @ solved).astype(np.float32)).astype(np.float32))


def scores(texts: list, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Class scores of a batch, and which texts have letters."""
    found = np.zeros(1 << BUCKET_BITS, bool)
    present = [presence(t, found) if t else np.zeros(0, np.int64) for t in texts]
    sizes = np.array([len(p) for p in present])
    has = sizes > 0
    result = np.zeros((len(texts), len(model.languages)), np.float32)
    if has.any() and model.languages:
        first = np.concatenate([[0], np.cumsum(sizes[has])[:-1]])
        product = np.add.reduceat(model.weights[np.concatenate(present)], first, axis=0)
        result[has] = product / np.sqrt(sizes[has])[:, None]
    return result, has


def _predicted(batches: Iterator[pa.RecordBatch], model: Model, step: int = 64) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.languages, "und"], dtype=object)
    for batch in batches:
        for begin in range(0, batch.num_rows, step):
            part = batch.slice(begin, step)
            result, has = scores(part.column("text").to_pylist(), model)
            best = np.full(part.num_rows, len(model.languages))
            top = np.zeros(part.num_rows)
            if model.languages:
                best[has] = result[has].argmax(axis=1)
                top[has] = np.clip((result[has].max(axis=1) + 1) / 2, 0, 1)
            rest = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in rest], pa.array(names[best], pa.string()), pa.array(top)],
                names=[*rest, "lang_pred", "score"],
            )


def identify(
    df: DataFrame,
    text_column: str = "text",
    id_column: str = "doc_id",
    lang_column: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    landmarks: int = LANDMARKS,
    carry: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Learns from rows with a label and a text that are not held out; the label,
    the id and other columns are no input of a prediction. A null text, one
    without letters, or a table without labels gives ``und`` with score 0. A null
    id is not held out and not learned from. Repeated rows get equal results;
    an empty table gives an empty result. ``carry`` adds the input row as ``row``.
    """
    picked = df.select(
        named(df, id_column).alias("doc_id"),
        named(df, text_column).alias("text"),
        named(df, lang_column).alias("lang"),
        *([F.struct(*[named(df, c) for c in df.columns]).alias("row")] if carry else []),
    )
    model = fit(picked, sample_rows, landmarks)
    rest = picked.drop("lang").withColumn("held_out", held_out(F.col("doc_id")))
    schema = extended(rest, "text", "lang_pred string, score double")
    return rest.mapInArrow(partial(_predicted, model=model), schema)


def keep_identified(df: DataFrame, text_column: str = "text", id_column: str = "doc_id", lang_column: str = "lang") -> DataFrame:
    """The rows whose language could be told, whole and with the input's columns."""
    found = identify(df, text_column, id_column, lang_column, carry=True)
    return found.where("lang_pred <> 'und'").select("row.*")
