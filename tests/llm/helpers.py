"""Brute-force versions and awkward inputs for the training-data operators."""

from __future__ import annotations

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """(doc_id, text[, lang, source]) rows as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def clashing(df):
    """Extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    for name in ("row", "row_no", "rep", "recipe", "band", "n_shingles", "good", "kept", "place", "part", "component", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    return df


def shingles(text, size):
    words = [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(text or "")]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def near_groups(rows, size, percent=80):
    """doc_id -> (set size, smallest reachable id) by comparing all pairs."""
    sets = {d: shingles(t, size) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def base_counts(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, duplicates, len(covered)


AWKWARD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "one two"), (6, "One  Two"), (7, "a b a b a b a b"),
    (8, "éa ñ ß 日本 語\n\néa ñ"), (9, "x" * 5000), (10, "word " * 3000), (11, "x\ny\nx\n\nx \n"), (12, "12345 !!! ***"),
    (13, None), (14, "one two"),
]
