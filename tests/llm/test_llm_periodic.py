"""Periodic runs against the definition checked place by place."""

import hashlib
import random

from helpers import AWKWARD, WORD, clashing, documents

from panelspark.llm import periodic_runs as pr
from panelspark.llm.queries import op12_frequency_split_runs


def brute_runs(words):
    n, runs = len(words), []
    for q in range(1, n // 2 + 1):
        j = 0
        while j < n - q:
            if words[j] != words[j + q]:
                j += 1
                continue
            s = j
            while j < n - q and words[j] == words[j + q]:
                j += 1
            e = j + q
            smaller = any(all(words[k] == words[k + p] for k in range(s, e - p)) for p in range(1, q))
            if e - s >= max(12, 2 * q) and not smaller:
                runs.append((s, e - s, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = pr.planted(WORD.findall(text or ""), doc_id)
    runs = brute_runs(words)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return {
        "n_runs": len(runs),
        "start": best and best[0], "length": best and best[1], "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": hashlib.sha256("".join(f"{s},{l},{q}\n" for s, l, q in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in dropped).encode()).hexdigest(),
    }


def texts():
    rng = random.Random(5)
    out = list(AWKWARD)
    vocab = ["a", "b", "c", "d", "e", "f"]
    for doc_id in range(100, 180):
        n = rng.randint(0, 120)
        words = [rng.choice(vocab[: rng.randint(1, 6)]) for _ in range(n)]
        if rng.random() < 0.4 and n > 20:
            period = rng.randint(1, 8)
            at = rng.randint(0, n - 1)
            words[at:] = [words[at + k % period] if at + k % period < n else "z" for k in range(n - at)]
        out.append((doc_id, " ".join(words)))
    out += [(10 * k, " ".join(f"w{j}" for j in range(60))) for k in range(100, 140)]
    out.append((200, "x y " * 40 + "q " + "x y " * 7))
    return out


def test_against_definition(spark):
    rows = texts()
    got = {r.doc_id: r.asDict() for r in pr.detect(clashing(documents(spark, rows))).collect()}
    for doc_id, text in rows:
        expected = brute_row(doc_id, text)
        assert {k: got[doc_id][k] for k in expected} == expected, doc_id


def test_planting_and_cases():
    assert pr.planted([], 10) == []
    assert pr.planted(["a", "b"], None) == ["a", "b"]
    assert pr.describe(None, None)["n_runs"] == 0
    row = pr.describe(3, "a " * 5000)
    assert row["n_runs"] == 1 and row["period"] == 1 and row["length"] == 5000
    assert row["collapsed_sha256"] == hashlib.sha256(b"a").hexdigest()


def test_empty_and_query(spark):
    assert pr.detect(documents(spark, [])).count() == 0
    got = op12_frequency_split_runs(spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert got.where("n_runs > 0").count() > 0
