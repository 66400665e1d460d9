"""Chat formatting checked by a grammar round trip.

Template (one line per turn, conversation = its turns in order):

    <s>[ROLE]\\n TEXT </s>\\n        (no spaces: "<s>[" role "]\\n" text "</s>\\n")

ROLE is the role name with every character outside [A-Za-z0-9_-] percent-encoded
(UTF-8), so it never holds "]" or a line break. TEXT is the turn's text, escaped
only where the round trip demands it. The control strings are the template's
markers and the reserved strings of common chat formats; none may appear
inside a rendered text:

    fixed values: <s>  </s>  [INST]  [/INST]  <<SYS>>  <</SYS>>

Escaping is reversible: where a control string's first character is followed
by k backslashes and then the rest of the string, one more backslash is
inserted (k -> k + 1); the parser always removes one again (k + 1 -> k, k >= 1).
A text is rendered raw first; the deterministic parser reads the rendered turn
back; if the recovered role or text differ from the source, the text is escaped
and rendered again. The whole conversation is then parsed once more and must give
back every turn; anything else raises.

The loss mask holds the code-point spans of the assistant texts (as written,
escaped) in the formatted string. Reading back unescapes the text under the
mask, so it equals the assistant texts in order, nothing between.

Spark groups the rows of a conversation (one conversation is one output string,
so its rows meet in one task: a conversation is bounded by its own length, not
by the table), formats in Python tasks, writes the formatted table, and reads it
back in a second pass that knows only the written output.

Defined cases: null text is empty; a null role is the empty role name; rows are
ordered by turn (null turns first), then role, then text, so ties and repeated
rows are kept, each as its own turn, in a fixed order; a null conv_id forms its
own conversation. Empty tables give no rows (the planted conversation -7 is
added by the query). Extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import written

OPEN, CLOSE = "<s>", "</s>"
_ESCAPABLE = re.compile(r"(<)(\\*)(s>|/s>|<SYS>>|</SYS>>)|(\[)(\\*)(INST\]|/INST\])")
_UNESCAPABLE = re.compile(r"(<)\\(\\*)(s>|/s>|<SYS>>|</SYS>>)|(\[)\\(\\*)(INST\]|/INST\])")
_SAFE_ROLE = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"


def escape(text: str) -> str:
    return _ESCAPABLE.sub(lambda m: "".join(g or "" for g in (m[1], m[2], "\\" if m[1] else "", m[3],
                                                              m[4], m[5], "\\" if m[4] else "", m[6])), text)


def unescape(text: str) -> str:
    return _UNESCAPABLE.sub(lambda m: "".join(g or "" for g in m.groups()), text)


def _head(role: str) -> str:
    return f"{OPEN}[{quote(role, safe=_SAFE_ROLE)}]\n"


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of each turn, text unescaped, span of the written text; None if not the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN + "[", at):
            return None
        close = formatted.find("]\n", at + len(OPEN) + 1)
        if close < 0:
            return None
        role = unquote(formatted[at + len(OPEN) + 1 : close], errors="strict")
        start = close + 2
        end = formatted.find(CLOSE, start)
        if end < 0 or not formatted.startswith(CLOSE + "\n", end):
            return None
        turns.append((role, unescape(formatted[start:end]), start, end))
        at = end + len(CLOSE) + 1
    return turns


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted conversation and the loss spans of its assistant texts."""
    pieces, spans, at = [], [], 0
    for role, text in turns:
        head = _head(role)
        body = text
        piece = head + body + CLOSE + "\n"
        recovered = parse(piece)
        if recovered is None or recovered[0][:2] != (role, text):
            body = escape(text)
            piece = head + body + CLOSE + "\n"
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        pieces.append(piece)
        at += len(piece)
    formatted = "".join(pieces)
    back = parse(formatted)
    if back is None or [t[:2] for t in back] != list(turns):
        raise ValueError("the template does not read back its own conversation")
    return formatted, spans


def _format_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = {"conv_id": [], "formatted": [], "loss_starts": [], "loss_ends": []}
        for conv_id, rows in zip(batch["conv_id"], batch["rows"]):
            turns = [(r["role"] or "", r["text"] or "") for r in rows]
            formatted, spans = render(turns)
            out["conv_id"].append(None if pd.isna(conv_id) else int(conv_id))
            out["formatted"].append(formatted)
            out["loss_starts"].append([s for s, _ in spans])
            out["loss_ends"].append([e for _, e in spans])
        frame = pd.DataFrame(out)
        frame["conv_id"] = frame["conv_id"].astype("Int64")
        yield frame


def _read_back_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for conv_id, formatted, starts, ends in zip(
            batch["conv_id"], batch["formatted"], batch["loss_starts"], batch["loss_ends"]
        ):
            turns = parse(formatted)
            if turns is None:
                raise ValueError(f"conversation {conv_id} does not parse")
            listing = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns)
            loss = "".join(unescape(formatted[s:e]) for s, e in zip(starts, ends))
            rows.append((
                None if pd.isna(conv_id) else int(conv_id), len(turns),
                hashlib.sha256(listing.encode()).hexdigest(), len(loss),
                hashlib.sha256(loss.encode()).hexdigest(), len(formatted),
            ))
        frame = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                            "formatted_chars"])
        frame["conv_id"] = frame["conv_id"].astype("Int64")
        yield frame


FORMATTED = "conv_id long, formatted string, loss_starts array<long>, loss_ends array<long>"
RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The formatted text and loss spans of every conversation."""
    rows = conversations.select(
        "conv_id",
        F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
                 F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("row"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return grouped.mapInPandas(_format_task, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turn count, digests and loss-mask figures recovered from the formatted output alone."""
    return formatted.mapInPandas(_read_back_task, RESULT)


def format_and_read_back(conversations: DataFrame) -> DataFrame:
    return read_back(written(format_conversations(conversations), "chat-formatted"))
