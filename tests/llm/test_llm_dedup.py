import random

import pytest
from helpers import AWKWARD, clashing, documents, near_groups
from panelspark.llm import exact_dedup, near_dedup
from panelspark.llm.graph import components


def long_text(seed, words=900):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeios") for _ in range(rng.randint(2, 8))) for _ in range(words))


EXACT_ROWS = [
    *AWKWARD, (20, long_text(1)), (21, long_text(1).replace(" ", "\n ", 5)), (22, long_text(1) + " "), (23, long_text(2)),
    (24, long_text(1)), (24, long_text(1)), (None, long_text(2)), (None, "only null"), (25, long_text(1)[:-1] + "q"),
]


@pytest.mark.parametrize("key_bits", [64, 3])
def test_exact_groups_equal_plain_comparison(spark, key_bits):
    import hashlib
    import re

    found = exact_dedup.exact_groups(clashing(documents(spark, EXACT_ROWS)), key_bits=key_bits).collect()
    groups = {}
    for doc, text in EXACT_ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(found) == len(EXACT_ROWS)
    for row in found:
        ids = by_digest[row.text_sha256]
        known = [i for i in ids if i is not None]
        assert row.group_size == len(ids)
        assert row.keep_id == (min(known) if known else None)
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups)  # one row of each text, of repeated rows too
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_keeps_columns_and_empty_table(spark):
    df = clashing(documents(spark, EXACT_ROWS))
    assert exact_dedup.exact_dedup(df).columns == df.columns
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_chunks_cover_the_text(spark):
    from pyspark.sql import functions as F

    rows = [(k, t or "") for k, t in EXACT_ROWS if k] + [(99, "ab" * 9000)]
    df = documents(spark, rows).select("text", exact_dedup.chunks_of(F.col("text")).alias("c"))
    assert all("".join(r.c) == r.text for r in df.collect())


def varied(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(["foo", "bar", "baz"]) + str(rng.randint(0, 99))
    return " ".join(words)


def near_rows():
    rng = random.Random(5)
    rows = list(AWKWARD)
    for group in range(6):
        base = long_text(100 + group, 80).split()
        rows += [(1000 * (group + 1) + k, varied(rng, base, k % 14)) for k in range(30)]
    chain = long_text(7, 60).split()
    for k in range(12):  # each close to the next, the ends far apart
        chain = chain[2:] + [f"n{k}", f"m{k}"]
        rows.append((9000 - k, " ".join(chain)))
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_near_groups_equal_all_pairs(spark, size):
    rows = near_rows()
    wanted = near_groups(rows, size)
    found = near_dedup.near_groups(clashing(documents(spark, rows)), shingle_words=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_dedup_repeated_rows_null_ids_and_empty(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "z"), (5, None), (6, "")]
    df = clashing(documents(spark, rows))
    kept = near_dedup.near_dedup(df, shingle_words=2)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5", "6", "None"]
    assert near_dedup.near_dedup(df.limit(0)).count() == 0


def test_signature_agreement_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = values[:2000], values[500:2500]  # similarity 0.6
    hashes = np.concatenate([a, b])
    table = near_dedup.super_minhash(hashes, np.repeat([0, 1], 2000), 2, 200)
    assert abs((table[0] == table[1]).mean() - 0.6) < 0.1
    small = near_dedup.super_minhash(values[:3], np.zeros(3, int), 1, 200)
    assert (small < near_dedup._NEVER).all()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.doc_id: r.component for r in components(links).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_BUCKET_BLOCK", 4)
    rows = near_rows()
    found = near_dedup.near_groups(documents(spark, rows), shingle_words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near_groups(rows, 2)
