"""Chat formatting: reversible escaping, and read-back equal to the source turns."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.llm import chat_format as cf
from panelspark.llm.queries import PLANTED_TEXT, op13_grammar_round_trip_chat

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
SCHEMA = "conv_id long, turn long, role string, text string"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=list("<>/[]\\sSYINT x\n"), max_size=40))
def test_escape_round_trip(text):
    escaped = cf.escape(text)
    assert cf.unescape(escaped) == text
    assert not any(c in escaped for c in CONTROLS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a]b\n%", "tool"]),
                          st.text(alphabet=list("<>/[]\\sINST x\né"), max_size=30)), max_size=6))
def test_render_reads_back(turns):
    formatted, spans = cf.render(turns)
    assert [t[:2] for t in cf.parse(formatted)] == turns
    assert "".join(cf.unescape(formatted[s:e]) for s, e in spans) == "".join(t for r, t in turns if r == "assistant")


def expected(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                     len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_formats_awkward_conversations(spark):
    rows = [
        (1, 0, "user", "hi [INST] there"), (1, 1, "assistant", "a </s><s>[INST] b"), (1, 2, "user", None),
        (1, 3, "assistant", "x <\\/s> y"), (2, 0, None, "é" * 50000), (2, 0, None, "é" * 50000),
        (3, 1, "assistant", ""), (3, None, "system", "<<SYS>> s <</SYS>>"), (4, 0, "assistant", "\\[\\INST]"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("rows", "row", "formatted", "a.b"):
        df = df.withColumn(name, F.lit(1))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.format_and_read_back(df).collect()}
    assert got == expected(rows)
    assert cf.format_and_read_back(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_includes_planted(spark):
    got = {r.conv_id: r for r in op13_grammar_round_trip_chat(spark, "/root/testdata/sf0.001").collect()}
    planted = got[-7]
    assert planted.n_turns == 2 and planted.loss_chars == len(PLANTED_TEXT)
    assert planted.loss_sha256 == hashlib.sha256(PLANTED_TEXT.encode()).hexdigest()
    source = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert len(got) == source.select("conv_id").distinct().count() + 1
