import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import AWKWARD, base_counts, clashing, documents
from panelspark.llm import bpe_automaton, html_text, language, license_texts, licenses, packing, quality, separators, tokens
from panelspark.llm.license_texts import MIT
from tokenizers import Tokenizer

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    *[t for _, t in AWKWARD], "it's  I'LL\tgo 12x", "a \n b", "<|endoftext|> x", " lead", "tail ", "aaaa bbbbbbbb", "👍🏽 ok",
    "<|startoftext|>y", "ΣΑΣ ΟΔΟΣ İx", "a\x1cb", "½ ² ١٢٣",
]


@pytest.fixture(scope="module")
def numbered(spark):
    return clashing(documents(spark, [(k, t, None, None if k % 3 == 0 else f"s{k % 3}") for k, t in enumerate(TEXTS)]))


def test_byte_ids_equal_the_library():
    library = Tokenizer.from_file(BYTE_BPE)
    for text, ids in zip(TEXTS, tokens.byte_bpe_ids(TEXTS, BYTE_BPE)):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_bpe_automaton_equals_the_library(spark, numbered):
    library = Tokenizer.from_file(WORD_BPE)
    library.no_truncation()
    library.no_padding()
    found = {r.doc_id: r for r in bpe_automaton.encode(numbered, WORD_BPE).collect()}
    digests = {r.doc_id: r for r in bpe_automaton.encode(numbered, WORD_BPE, digests=True).collect()}
    for k, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        joined = " ".join(map(str, ids))
        assert (found[k].n_tokens, found[k].ids) == (len(ids), joined)
        assert found[k].decoded == library.decode(ids, skip_special_tokens=False)
        assert digests[k].ids_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    assert bpe_automaton.encode(numbered.limit(0), WORD_BPE).count() == 0


def test_bpe_automaton_on_random_words():
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abelnorst") for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    library = Tokenizer.from_file(WORD_BPE)
    encoder = bpe_automaton.Encoder(WORD_BPE)
    for word, (ids, _) in zip(words, encoder.encode(words)):
        assert ids == " ".join(map(str, library.encode(word, add_special_tokens=False).ids))


@pytest.mark.parametrize("targets", [None, {"s1": 3.0, "s2": 1.0}])
@pytest.mark.parametrize("window", [2048, 64])
def test_packing_places_every_id_once(spark, numbered, targets, window):
    library = Tokenizer.from_file(BYTE_BPE)
    pieces = packing.pack(numbered, BYTE_BPE, targets=targets, window=window).collect()
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_window[p.sequence_id].append(p)
    for k, text in enumerate(TEXTS):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(by_doc[k], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) == zlib.crc32(p.ids)
            at += p.length
        assert at == len(ids)
    sizes = []
    for k in range(len(by_window)):
        at = 0
        for p in sorted(by_window[k], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    assert all(s == window or s < window and s & (s - 1) == 0 for s in sizes)
    assert packing.pack(numbered.limit(0), BYTE_BPE).count() == 0


def test_packing_mixture_stays_within_a_token():
    totals = np.array([100_000, 40_000, 60_001])
    segments = packing.schedule(totals, np.array([1.0, 2.0, 1.0]), 2048)
    assert sum(int(s.shares[-1]) * s.count * s.length // s.parts for s in segments) == totals.sum()
    first = segments[0]
    for windows in range(1, first.count + 1):
        given = np.diff(packing._served([windows], first, first.shares)[:, 0])
        assert np.abs(given - windows * 2048 * np.array([0.25, 0.5, 0.25])).max() <= 1


@pytest.mark.parametrize("small", [[1], [2], [500], [9000], [1, 1, 2, 3, 700, 5000], [1] * 3000, [0, 7]])
def test_packing_schedule_is_short_beside_tiny_sources(small):
    totals = np.array([2_000_000_000, *small, 900_000_001])
    segments = packing.schedule(totals, totals.astype(float), 2048)
    assert len(segments) <= 3 * (totals > 0).sum() + 12
    given = sum(np.diff(packing._served([s.count], s, s.shares)[:, 0]) for s in segments)
    assert given.tolist() == totals.tolist() and all((np.diff(s.shares) >= 0).all() for s in segments)
    assert sum(s.count for s in segments if s.length == 2048) == totals.sum() // 2048


def test_separator_scan_counts_and_stitches(spark, numbered):
    streams = separators.token_streams(numbered, BYTE_BPE, 50256, block_ids=7)
    streams = spark.createDataFrame(streams.collect(), streams.schema)
    found = {r.doc_id: r for r in separators.token_counts(streams, 50256).collect()}
    wanted = {k: len(x) // 2 for k, x in enumerate(tokens.byte_bpe_ids(TEXTS, BYTE_BPE, ordinary=True))}
    assert {k: r.n_tokens for k, r in found.items()} == wanted
    assert all(r.terminated for r in found.values())
    assert separators.token_counts(streams.limit(0), 50256).count() == 0


def test_separator_scan_of_flat_files(spark, folder):
    ids = np.array([9, 0, 5, 5, 5, 0, 0, 7, 7], "<u2")
    with open(f"{folder}/shard.bin", "wb") as file:
        file.write(ids.tobytes())
    blocks = separators.read_token_files(spark, folder, block_ids=2)
    rows = separators.token_counts(blocks, 0).orderBy("ordinal").collect()
    assert [(r.start, r.n_tokens, r.terminated) for r in rows] == [(0, 1, True), (2, 3, True), (6, 0, True), (7, 2, False)]


def test_separator_scan_across_groups_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(separators, "_SUPER", 2)
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 12, 500).astype("<u2")
    ids[100:300] = 5  # a document over many blocks
    rows = [("f", k, ids[9 * k : 9 * k + 9].tobytes()) for k in range(56)]
    found = separators.token_counts(spark.createDataFrame(rows, "stream string, block long, ids binary"), 0)
    ends = np.flatnonzero(ids == 0)
    wanted = np.diff(np.concatenate([[-1], ends])) - 1
    got = [r.n_tokens for r in found.where("terminated").orderBy("ordinal").collect()]
    assert got == wanted.tolist()


def test_license_scan(spark):
    british = MIT.replace("LICENSE", "licence").replace("<year> <copyright holders>", "2019 Someone & Co.").upper()
    rows = [(1, MIT), (2, british.replace("\n", "  \n")), (3, MIT + "more"), (4, None), (5, ""), (6, "Released under the MIT Licence"),
            (7, "text\n** LICENSED under the Apache License, version 2.0 **\nend"), (7, "x")]
    found = licenses.scan(clashing(documents(spark, rows)))
    assert sorted((r.doc_id, r.license, r.notices) for r in found.where("license IS NOT NULL OR notices <> ''").collect()) == [
        (1, "MIT", ""), (2, "MIT", ""), (6, None, "MIT"), (7, None, "Apache-2.0"),
    ] and found.count() == len(rows)
    assert licenses.scan(documents(spark, rows).limit(0)).count() == 0


def test_license_copies_however_they_wrap(spark):
    import textwrap

    rows, wanted = [], {}
    for name, text in license_texts.TEXTS:
        for holder in ("2020 Jane Doe", "2019-2021, X. All rights reserved.", "<year> <copyright holders>", "Jane Doe and others"):
            filled = text.replace("<year>, <copyright holders>", holder).replace("<year> <copyright holders>", holder)
            parts = [" ".join(p.split()) for p in filled.strip().split("\n\n")]
            forms = ["\n\n".join(parts), " ".join(parts), "\r\n".join(filled.split("\n"))]
            for width in (*range(50, 90), 100):
                forms += ["\n\n".join(textwrap.fill(p, width) for p in parts), textwrap.fill(" ".join(parts), width)]
            for form in forms:
                wanted[len(rows)] = name
                rows.append((len(rows), form))
    found = licenses.scan(documents(spark, rows)).collect()
    assert [(rows[r.doc_id][1], r.license) for r in found if r.license != wanted[r.doc_id]] == []


def test_license_notice_beside_a_statement(spark):
    rows = [(1, "Copyright 2020 X. Licensed under the MIT License."), (2, "a\n# (c) 2019 Y, All rights reserved. SPDX-License-Identifier: MIT\nb"),
            (3, "copyright holders be kind"), (4, ""), (5, "(c) the user pays"), (6, "© 2020 Z\nAll rights reserved.")]
    found = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert [found[k].notices for k in (1, 2, 3)] == ["MIT", "MIT", ""]
    empty = found[4].text_digest
    assert found[6].text_digest == empty and empty not in (found[3].text_digest, found[5].text_digest)


GOOD = "the quick brown fox jumps over lazy dogs and then walks home through green fields near old rivers "


def quality_rows():
    import random

    rng = random.Random(9)
    rows = []
    for k in range(60):
        words = GOOD.split() * 5
        rng.shuffle(words)
        junk = k % 3 == 0
        rows.append((k, " ".join(w + "***" if junk else w for w in words)))
    return rows


def test_quality_counts_and_verdicts(spark):
    rows = quality_rows() + [(1000 + k, t) for k, t in AWKWARD]
    labels = spark.createDataFrame(
        [(k, int(k % 3 != 0), 0) for k in range(40)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int"
    )
    found = {r.doc_id: r for r in quality.judge(clashing(documents(spark, rows)), labels).collect()}
    for doc, text in rows:
        n, chars, symbols, lines, repeats = base_counts(text)
        r = found[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
    assert all(found[k].kept == (k % 3 != 0 and not found[k].base_failed) for k in range(60))
    kept = quality.keep_good(documents(spark, rows), labels.limit(0)).count()
    assert kept == sum(not r.base_failed for r in found.values())
    assert quality.judge(documents(spark, rows).limit(0), labels).count() == 0


def test_quality_ratio_matches_direct_counts():
    import pyarrow as pa
    from panelspark.llm.common import text_bytes

    texts = ["abc abd", None, "", "éx"]
    data, offsets = text_bytes(pa.array(texts))
    ratios = np.random.default_rng(1).normal(size=1 << quality.BUCKET_BITS)
    got = quality.measures(data, offsets, ratios)["llr"]
    for text, value in zip(texts, got):
        single, bounds = text_bytes(pa.array([text]))
        parts = [ratios[b[w]] for b, w in quality.ngram_buckets(single, bounds)]
        whole = np.concatenate(parts) if parts else np.zeros(0)
        assert abs(value - (whole.mean() if len(whole) else 0.0)) < 1e-12


def test_best_cut():
    assert quality.best_cut(np.array([3.0, 4.0]), np.array([1.0, 2.0])) == 2.5
    assert quality.best_cut(np.array([1.0]), np.array([])) == float("-inf")
    assert quality.best_cut(np.array([1.0]), np.array([5.0])) == float("-inf")


def test_language_held_out_and_awkward_rows(spark):
    import random

    rng = random.Random(4)
    parts = {"en": ["the", "ing", "and", "tion", "er"], "fr": ["eau", "que", "oi", "les", "é"], "de": ["sch", "ung", "ß", "ein", "ch"]}
    rows = []
    for k in range(300):
        lang = list(parts)[k % 3]
        rows.append((k, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(40)), lang))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "fr"), (1003, "x" * 100_000, None), (None, "sching", "de")]
    df = clashing(documents(spark, rows))
    found = {r.doc_id: r for r in language.identify(df).collect()}
    assert len(found) == len(rows)
    for doc, _, lang in rows[:300]:
        assert found[doc].held_out == (zlib.crc32(str(doc).encode()) % 3 == 1)
        assert found[doc].lang_pred == lang and 0 <= found[doc].score <= 1
    assert [found[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3
    assert found[1003].lang_pred in parts
    assert language.keep_identified(df).columns == df.columns
    assert language.identify(df.limit(0)).count() == 0
    unlabelled = documents(spark, [(1, "some text", None)])
    assert [r.lang_pred for r in language.identify(unlabelled).collect()] == ["und"]


def test_language_labels_are_no_input(spark):
    rows = [(k, "the and ing" if k % 2 else "eau que les", "en" if k % 2 else "fr") for k in range(60)]
    swapped = [(d, t, ("fr" if l == "en" else "en") if zlib.crc32(str(d).encode()) % 3 == 1 else l) for d, t, l in rows]
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language.identify(documents(spark, x)).collect()} for x in (rows, swapped))
    assert a == b


PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var a="</p>";</script></head><body>
<header>Site</header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies, accept them.</div>
<main><article><h1>Head &amp; T&eacute;te</h1><p>First  paragraph,
with <b>bold</b> text; and more.<p>Second<br>line &lt;x&gt;.</p><!-- no --><ul><li>one<li>two</ul></article></main>
<div id="sidebar">Side, bar.</div><section class="comments"><p>A reader writes, at length, again and again.</p></section>
<form><label>Name</label></form><footer>&copy; f</footer></body></html>"""


def test_html_main_text(spark):
    wanted = "Head & Téte\nFirst paragraph, with bold text; and more.\nSecond line <x>.\none\ntwo"
    bare = PAGE.replace("<main><article>", '<div class="post">').replace("</article></main>", "</div>")
    rows = [(1, "u", PAGE), (2, "u", bare), (3, None, None), (4, "u", ""), (5, "u", "<nav>x</nav>"), (1, "u", PAGE),
            (6, "u", "<p>a</p>" * 3), (7, "u", '<a href="' + "b c " * 9000), (8, "u", "<div>" * 500 + "deep, text")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = [(r.page_id, r.text) for r in html_text.extract(df).collect()]
    texts = dict(found)
    assert texts[1] == texts[2] == wanted and len(found) == len(rows)
    assert texts[3] == texts[4] == texts[5] == texts[7] == "" and texts[6] == "a\na\na" and texts[8] == "deep, text"
    assert all(r.n_chars == len(r.text) for r in html_text.extract(df).collect())
    assert html_text.extract(df.limit(0)).count() == 0


ARTICLE = "<h2 id='search-in-graphs'>Search</h2><p>A long sentence, with marks; it tells a story.</p><p>Another one, as long as that, ends it.</p>"
STORY = "Search\nA long sentence, with marks; it tells a story.\nAnother one, as long as that, ends it."


@pytest.mark.parametrize("page", [
    f"<body><div class='layout with-sidebar'><article>{ARTICLE}</article><div class='sidebar'>Side, bar.</div></div>",
    f"<body><div class='no-sidebar'><div>{ARTICLE}</div></div>", f"<div class='post has-comments'>{ARTICLE}</div>",
    f"<section id='related-work'>{ARTICLE}</section>", f"<div class='share-price'>{ARTICLE}</div>",
    f"<div class='sidebar'><article>{ARTICLE}</article></div>", f"<div id='search'>{ARTICLE}</div><p class='ad'>Buy, now.</p>",
    f"<html><head><title>t</title><meta x><body><article>{ARTICLE}</article>", f"<head><script>x</script><div>{ARTICLE}</div>",
    f"<article>{ARTICLE}</article><div class='comments-area'><article class='c'><p>{'A reader writes, much. ' * 40}</p></article></div>",
])
def test_html_layout_names_do_not_remove_the_article(page):
    assert html_text.main_text(page) == STORY


@pytest.mark.parametrize("around", ["<article>%s</article>", "<div>%s</div>", "<main><div>%s</div></main>"])
def test_html_low_scores_inside_a_container_go(around):
    links = "<ul><li><a href='x'>One more</a></li><li><a href='y'>And more</a></li></ul>"
    inner = ARTICLE + "<ul><li>point</li></ul><h3>Sub</h3><p>Yet another sentence, with marks; it goes on.</p><h3>More</h3>" + links + "<div>Read on</div>"
    page = "<body><div><span>Top</span></div>" + around % inner + "<div><a href='z'>Next</a></div><div>Tail</div></body>"
    assert html_text.main_text(page) == STORY + "\npoint\nSub\nYet another sentence, with marks; it goes on."
