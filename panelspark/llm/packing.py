"""Mixture-controlled packing of tokenized documents into fixed windows.

Each source is a queue of tokens. Deficit round-robin gives every window each
queue's share; what a window's whole tokens leave over is carried to the next
as the queue's deficit, so after any number of windows a queue has had its
share to within one token. The carried state has a closed form (the rounded
running share), so it crosses windows and partitions without a sequential pass:
a token's window follows from its place in its queue. Queues that run dry leave
their share to the others. The last tokens go to windows of powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.common import named, text_bytes, written
from panelspark.llm.tokens import byte_bpe_ids

WINDOW = 2048
_PARTS = 1 << 20
_NO_SOURCE = "\x00null"


class Segment(NamedTuple):
    """A run of equal windows: after w of them, the queues up to s have given
    floor(w * length * shares[s] / parts) tokens together."""

    first: int
    count: int
    length: int
    parts: int
    shares: np.ndarray  # running shares, one more than queues, from 0 to parts
    before: np.ndarray  # tokens each queue gave before


def _served(windows, segment: Segment, shares: np.ndarray) -> np.ndarray:
    """Tokens the queues up to each running share gave after so many windows of a segment."""
    whole, part = np.divmod(np.asarray(windows, np.int64), segment.parts)
    shares = shares[:, None]
    return (whole * segment.length) * shares + part * segment.length * shares // segment.parts


def _running(values) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)]).astype(np.int64)


def _shares(weights: np.ndarray) -> np.ndarray:
    """Weights as whole parts of 2^20, at least one each."""
    parts = np.maximum(1, np.floor(weights / weights.sum() * _PARTS)).astype(np.int64)
    parts[parts.argmax()] += _PARTS - parts.sum()
    return parts


def schedule(totals: np.ndarray, weights: np.ndarray, window: int = WINDOW) -> list[Segment]:
    """The windows of all tokens: at most a few segments for each queue.

    While all remaining queues can fill their share, windows are equal. The
    window in which one would run dry is written out: it gives all it has,
    the others fill up in turn, so a queue costs a bounded number of segments.
    Less than a window is left over for powers of two.
    """
    left, given = totals.astype(np.int64).copy(), np.zeros(len(totals), np.int64)
    segments, first = [], 0

    def add(count: int, length: int, parts: int, counts: np.ndarray) -> None:
        nonlocal first
        segment = Segment(first, count, length, parts, _running(counts), given.copy())
        taken = np.diff(_served([count], segment, segment.shares)[:, 0])
        segments.append(segment)
        given[:] += taken
        left[:] -= taken
        first += count

    while left.sum() >= window:
        active = left > 0
        parts = np.zeros(len(left), np.int64)
        parts[active] = _shares(weights[active])
        # one token to spare for the rounding of the running share
        runs = min(max(0, int(n) - 1) * _PARTS // (window * int(p)) for n, p in zip(left[active], parts[active]))
        if runs:
            add(runs, window, _PARTS, parts)
            continue
        # queues without their share and a token to spare give all they have, the others theirs of the rest
        dry = active & ((left - 1) * _PARTS // (window * np.maximum(parts, 1)) < 1)
        takes, room = np.zeros(len(left), np.int64), window
        for queue in sorted(np.flatnonzero(dry), key=lambda q: left[q]):
            takes[queue] = min(int(left[queue]), room)
            room -= int(takes[queue])
        rest = np.where(dry, 0, parts)
        if rest.any():
            takes += np.minimum(np.diff(_running(rest) * room // int(rest.sum())), np.where(dry, 0, left))
        short = window - int(takes.sum())
        for queue in np.argsort(-(left - takes), kind="stable"):
            more = min(short, int(left[queue] - takes[queue]))
            takes[queue] += more
            short -= more
        add(1, window, window, takes)
    size = 1 << (window - 1).bit_length()
    while left.sum():
        size //= 2
        if left.sum() >= size:
            before = _running(left)
            takes = np.diff(np.minimum(before, size))
            add(1, size, size, takes)
    return segments


def cuts(queue: int, start: int, end: int, segments: list[Segment]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the tokens ``start`` to ``end`` of a queue are cut: (place in queue,
    window, offset in it) of every piece, in order."""
    places, windows, offsets = [], [], []
    for k, segment in enumerate(segments):
        low = int(segment.before[queue])
        high = int(segments[k + 1].before[queue]) if k + 1 < len(segments) else None
        if low >= end:
            break
        if high is not None and high <= max(start, low):
            continue
        share = int(segment.shares[queue + 1] - segment.shares[queue])
        if not share:
            continue
        per = segment.length * share / segment.parts
        a = max(0, int((max(start, low) - low - 1) / per) - 1)
        b = min(segment.count, int((end - low + 1) / per) + 2)
        served = _served(np.arange(a, b + 1), segment, segment.shares[queue : queue + 2])
        mine = low + served[1] - served[0]  # given by this queue after each window
        begins, stops = mine[:-1], mine[1:]
        inside = (stops > start) & (begins < end) & (stops > begins)
        window = np.arange(a, b)
        lower = np.diff(served[0])  # tokens of the queues before it in each window
        places.append(begins[inside])
        windows.append(segment.first + window[inside])
        offsets.append(lower[inside])
    return np.concatenate(places), np.concatenate(windows), np.concatenate(offsets)


def _tokenized(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Token ids of every row and its place within the (partition, source) stream."""
    places: dict[str, int] = {}
    part = TaskContext.get().partitionId()
    end = np.array([end_id], "<u2").tobytes()
    for batch in batches:
        ids = [x + end for x in byte_bpe_ids(batch.column("text").to_pylist(), vocabulary)]
        starts = []
        for source, x in zip(batch.column("source").to_pylist(), ids):
            starts.append(places.get(source, 0))
            places[source] = starts[-1] + len(x) // 2
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("source"),
                pa.array([part] * len(ids), pa.int64()),
                pa.array(starts, pa.int64()),
                pa.array([len(x) // 2 for x in ids], pa.int64()),
                pa.array(ids, pa.binary()),
            ],
            names=["doc_id", "source", "part", "place", "doc_tokens", "ids"],
        )


def _pieces(batches: Iterator[pa.RecordBatch], queues: dict[str, int], segments: list[Segment], contents: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"]
    for batch in batches:
        columns = [batch.column(n) for n in ("doc_id", "source", "place", "doc_tokens")]
        ids = batch.column("ids")
        rows, starts, lengths, sums, windows, offsets, bodies = [], [], [], [], [], [], []
        for k, (source, place, tokens) in enumerate(zip(*[c.to_pylist() for c in columns[1:]])):
            places, window, offset = cuts(queues[source], place, place + tokens, segments)
            begins = np.maximum(places, place)
            offset = offset + (begins - places)
            begin = begins - place
            size = np.diff(np.append(begin, tokens))
            narrow = ids[k].as_buffer()
            wide = memoryview(np.frombuffer(narrow, "<u2").astype("<u4")).cast("B")
            for a, n in zip(begin.tolist(), size.tolist()):
                body = wide[4 * a : 4 * (a + n)]
                sums.append(zlib.crc32(body))
                bodies.append(bytes(body) if contents else None)
            rows.append(np.full(len(size), k))
            starts.append(begin)
            lengths.append(size)
            windows.append(window)
            offsets.append(offset)
        if not rows:
            continue
        take = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays(
            [
                columns[0].take(take),
                pa.array(np.concatenate(starts)),
                pa.array(np.concatenate(lengths)),
                pa.array(sums, pa.int64()),
                columns[3].take(take),
                pa.array(np.concatenate(windows)),
                pa.array(np.concatenate(offsets)),
                columns[1].take(take),
                pa.array(bodies, pa.binary()),
            ],
            names=names,
        )


def pack(
    df: DataFrame,
    vocabulary: str,
    text_column: str = "text",
    id_column: str = "doc_id",
    source_column: str = "source",
    targets: Mapping[str, float] | None = None,
    window: int = WINDOW,
    end_id: int = 1,
    contents: bool = True,
) -> DataFrame:
    """Pieces of all documents, each with its window (sequence_id) and offset there.

    A document is its byte-level BPE ids and ``end_id``; a null text has the end
    only, so every row, repeated ones too, has at least one piece. ``targets``
    gives each source's weight (the key None for a null source; default: the
    tokens it holds, so all windows have the corpus mixture); sources without
    a weight get an equal share of the smallest. Windows are full but for the
    last, which are powers of two, so nothing is padded. The ids of a piece are
    little-endian unsigned 32-bit numbers in ``ids`` (null without ``contents``). An empty table gives an
    empty result; other columns are not read. The driver holds one number per
    source and phase of the mixture.
    """
    picked = df.select(
        named(df, id_column).alias("doc_id"),
        named(df, text_column).alias("text"),
        F.coalesce(named(df, source_column).cast("string"), F.lit(_NO_SOURCE)).alias("source"),
    )
    tokens = written(
        picked.mapInArrow(
            partial(_tokenized, vocabulary=vocabulary, end_id=end_id),
            "doc_id long, source string, part long, place long, doc_tokens long, ids binary",
        ),
        "token-streams",
        codec="zstd",
    )
    streams = tokens.groupBy("source", "part").agg(F.sum("doc_tokens").alias("tokens"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    streams = written(
        streams.select("source", "part", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")),
        "stream-bases",
    )
    totals = {r["source"]: r["n"] for r in streams.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    names = sorted(totals)
    counts = np.array([totals[n] for n in names], np.int64)
    weights = counts.astype(float)
    if targets:
        given = {_NO_SOURCE if k is None else k: v for k, v in targets.items() if v > 0}
        least = min(given.values())
        weights = np.array([given.get(n, least) for n in names], float)
    segments = schedule(counts, weights, window) if names else []
    placed = (
        tokens.join(streams.select("source", "part", "base"), ["source", "part"])
        .select("doc_id", "source", (F.col("place") + F.col("base")).alias("place"), "doc_tokens", "ids")
    )
    pieces = placed.mapInArrow(
        partial(_pieces, queues={n: k for k, n in enumerate(names)}, segments=segments, contents=contents),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long,"
        " offset long, source string, ids binary",
    )
    return pieces.withColumn("source", F.when(F.col("source") != _NO_SOURCE, F.col("source")))
