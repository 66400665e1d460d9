import corpus_pipeline
from helpers import clashing, near_groups
from panelspark.llm import queries, url_templates

SF = "/root/testdata/sf0.001"


def plain_rule(url):
    """Host, path, rule and verdict by the contract's words."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for verdict, rule in url_templates.RULES:
        of_host, _, of_path = rule.partition("/")
        if (host == of_host or host.endswith("." + of_host)) and path.startswith("/" + of_path):
            if best is None or len(rule) > len(best[1]):
                best = (verdict, rule)
    return host, path, best


URLS = [
    None, "", "no mark", "http://A.Example.NET/en/1", "http://a.example.net/de/1?x=/en/", "https://net/", "https://net", "x://Xnet/a",
    "http://b.org/fr/", "http://org/fr", "http://example.com/de/5#t", "http://example.com?de/", "http://u@h:80/p//q/", "://h/ä",
    "http://a://b/c", "http://h/" + "x/" * 3000, "http://bad.com/spam/1", "http://bad.com/spam/2",
]


def test_url_rules_and_templates(spark):
    rows = list(enumerate(URLS)) + [(0, None)] + [(100 + k, f"http://big.com/{'bad' if k % 2 else 'good'}/{k}.html") for k in range(200)]
    labels = [(100 + k, k % 2) for k in range(200)] + [(100, None), (101, 1), (None, 1)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string"))
    marks = spark.createDataFrame(labels, "page_id long, bad int")
    found = url_templates.judge_urls(df, marks).collect()
    assert len(found) == len(rows)
    by_id = {r.page_id: r for r in found}
    for page, url in rows:
        host, path, best = plain_rule(url)
        r = by_id[page]
        assert (r.host, r.path, r.rule) == (host, path, best[1] if best else None)
        if best:
            assert r.verdict == best[0]
    assert by_id[101].verdict == "block" and by_id[100].verdict == "allow"
    assert by_id[101].template == "/bad/{n}.html"
    assert {r.verdict for r in url_templates.judge_urls(df, marks.limit(0)).collect() if r.page_id >= 100} == {"allow"}
    assert url_templates.judge_urls(df.limit(0), marks).count() == 0


def test_similar_branches_merge(spark):
    pages = [(k, f"http://h/{lang}/{k}") for k, lang in enumerate(["en", "de", "fr", "es"] * 30)]
    marks = spark.createDataFrame([(k, int(k % 8 < 4)) for k, _ in pages], "page_id long, bad int")
    found = url_templates.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), marks).collect()
    assert {r.template for r in found} == {"/*/{n}"}


def test_a_bad_section_among_many_is_blocked(spark):
    pages = [(k, f"http://h/{chr(97 + k % 26)}{chr(97 + k // 26 % 2)}/{k}") for k in range(52 * 40)]
    pages += [(10_000 + k, f"http://h/{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}x/{k}") for k in range(676)]  # a label each
    marks = [(k, int("/bb/" in url or k > 10_000 and k % 10 == 0)) for k, url in pages]
    found = url_templates.judge_urls(
        spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(marks, "page_id long, bad int")
    ).collect()
    assert {r.path.split("/")[1] for r in found if r.verdict == "block"} == {"bb"}
    assert {r.template for r in found if r.path.startswith("/bb/")} == {"/bb/{n}"}
    assert {r.template for r in found if r.page_id >= 10_000} == {"/*/{n}"}


def test_sections_deep_in_a_path_are_told_apart(spark):
    pages = [(k, f"http://h/a/2024/05/06/section/topic/{'spam' if k % 2 else 'news'}/x/{k}") for k in range(200)]
    marks = spark.createDataFrame([(k, k % 2) for k, _ in pages], "page_id long, bad int")
    found = url_templates.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), marks).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in found) and len(found) == 200
    assert {r.template for r in found} == {f"/a/{{n}}/{{n}}/{{n}}/section/topic/{x}/x/{{n}}" for x in ("spam", "news")}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "exact_dedup", "near_dedup", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        assert kept.columns == docs.columns
    groups = near_groups([(r.doc_id, r.text) for r in kept.collect()], 5)
    assert all(d == root for d, (_, root) in groups.items())  # no two of the rest are near
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}


def test_every_query_is_named_after_its_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_page_document_is_the_last_whole_number(spark):
    urls = ["https://a.example.com/en/853/", "http://x.net/2024/05/123", "https://b.org/de/216.html?x=1",
            "https://c.com/en/1234567890123456789", "https://d.com/en/12abc", "https://e.com/7#t", None, "nothing"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r.d for r in df.select(queries.page_document(df["url"]).alias("d")).collect()]
    assert got == [853, 123, 216, None, None, 7, None, None]
