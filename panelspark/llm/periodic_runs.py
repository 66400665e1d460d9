"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a maximal stretch of words with smallest period q and length at least
max(12, 2q). Every word of such a run has an equal word q places away inside
the run, and q is at most half the run. So inside a segment of m words, a word
whose nearest equal word in the segment is more than m/2 places away (or that
occurs once) cannot belong to any run: it splits the segment. Splitting is
repeated on the pieces, whose shorter lengths make more words too rare, until
no piece changes; pieces under 12 words are left out. Runs never cross a split,
so each is found whole inside one surviving piece.

The lag scan then tests, in each piece of m words, every lag q up to m/2. A run
of period q holds at least q consecutive matches w[j] = w[j+q], so it covers a
multiple of q: comparing only the words at multiples of q (m/q tests) tells
which lags need the full comparison. Maximal match stretches long enough give
the stretches of period q; one whose extent also appears at a smaller lag has a
smaller period (its smallest period divides q) and is left to that lag.

Documents are spread over Spark tasks; each document is handled whole inside
one task with numpy (a document is a row; no document is cut).

Defined cases: null text has no words (n = 0); null doc_id is not rewritten by
the planting rule and is returned as null. Empty or space-only texts have no
runs. Repeated rows are judged alike, each on its own row. Extra input columns
are ignored. Without a run, start, length, period and exponent_milli are null,
runs_sha256 is the digest of the empty string and collapsed_sha256 that of all
words joined by one space.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# fixed values of the contract
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHORTEST = 12

RESULT = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """Words after the rewriting rule of the contract (a periodic tail for a tenth of the ids)."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def surviving_segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """Pieces of at least 12 words in which every word has an equal word within half the piece."""
    n = len(ids)
    segments = [(0, n)] if n >= SHORTEST else []
    position = np.arange(n)
    while segments:
        label = np.full(n, -1, dtype=np.int64)
        half = np.zeros(n, dtype=np.int64)
        for k, (lo, hi) in enumerate(segments):
            label[lo:hi] = k
            half[lo:hi] = (hi - lo) // 2
        inside = position[label >= 0]
        order = inside[np.lexsort((inside, ids[inside], label[inside]))]
        same = (label[order][1:] == label[order][:-1]) & (ids[order][1:] == ids[order][:-1])
        gap = np.where(same, order[1:] - order[:-1], n + 1)
        nearest = np.full(n, n + 1, dtype=np.int64)
        nearest[order[1:]] = np.minimum(nearest[order[1:]], gap)
        nearest[order[:-1]] = np.minimum(nearest[order[:-1]], gap)
        alive = (label >= 0) & (nearest <= half)
        if alive[inside].all():
            return segments
        pieces = []
        for lo, hi in segments:
            live = np.concatenate(([False], alive[lo:hi], [False])).astype(np.int8)
            edges = np.flatnonzero(np.diff(live))
            for a, b in zip(edges[::2], edges[1::2]):
                if b - a >= SHORTEST:
                    pieces.append((lo + int(a), lo + int(b)))
        segments = pieces
    return []


def lag_scan(ids: np.ndarray, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal periodic stretch of the piece, smallest period only."""
    piece = ids[lo:hi]
    m = len(piece)
    found: dict[tuple[int, int], int] = {}
    for q in range(1, m // 2 + 1):
        need = max(SHORTEST, 2 * q) - q
        samples = np.arange(0, m - q, q)
        if not (piece[samples] == piece[samples + q]).any():
            continue
        matches = np.concatenate(([0], (piece[: m - q] == piece[q:]).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(matches))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= need:
                key = (lo + int(a), int(b - a) + q)
                found.setdefault(key, q)
    return sorted((start, length, q) for (start, length), q in found.items())


def runs_of(words: list[str]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """All runs, ordered by start then period, and the mask of words kept after collapsing."""
    if not words:
        return [], np.ones(0, dtype=bool)
    _, ids = np.unique(np.array(words, dtype=object), return_inverse=True)
    ids = ids.astype(np.int64)
    runs = [run for lo, hi in surviving_segments(ids) for run in lag_scan(ids, lo, hi)]
    runs.sort(key=lambda r: (r[0], r[2]))
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return runs, kept


def describe(doc_id: int | None, text: str | None) -> dict:
    """One output row of the contract for one document."""
    words = planted(WORD.findall(text or ""), doc_id)
    runs, kept = runs_of(words)
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    collapsed = " ".join(w for w, k in zip(words, kept) if k)
    row = {
        "doc_id": doc_id, "n_words": len(words), "n_runs": len(runs),
        "start": None, "length": None, "period": None, "exponent_milli": None,
        "runs_sha256": hashlib.sha256(listing.encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(collapsed.encode()).hexdigest(),
    }
    if runs:
        start, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        row.update(start=start, length=length, period=q, exponent_milli=1000 * length // q)
    return row


def _task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
        rows = [describe(None if d is None else int(d), t) for d, t in zip(ids, batch["text"])]
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
        for name in ("doc_id", "start", "length", "period", "exponent_milli"):
            frame[name] = frame[name].astype("Int64")
        yield frame


def detect(documents: DataFrame) -> DataFrame:
    """Runs of every document: one row per input row."""
    return documents.select("doc_id", "text").mapInPandas(_task, RESULT)
