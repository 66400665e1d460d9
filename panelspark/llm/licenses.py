"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form (case, copyright lines, punctuation, white
space and equivalent spellings do not count), digested, and hash-joined to the
digests of known licence texts. Known one-line notices are found the same
way, each line of a document being such a text. Copies of a text or line are
gathered before anything is shuffled: the known table is what is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import named
from panelspark.llm.license_texts import NOTICES, TEXTS

# spellings that count as the same (fixed values)
EQUIVALENT = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("fulfilment", "fulfillment"),
    ("merchantibility", "merchantability"),
)
# the oracle's rule: it takes any line that begins so, and differs from STATEMENT where body text does
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©|portions copyright|all rights reserved)[^\n]*$"
KNOWN_AT_MOST = 10_000
HEAD_WORDS, NOTICE_WORDS = 6, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP, _MARK = r"[^\p{L}\p{N}\n]*", r"(?:copyright|\(c\)|©|&copy;)"


def _spelled(texts: Iterable[Sequence[str]]) -> str:
    """A pattern of word sequences with any white space and punctuation between the words."""
    found = {r"[^\p{L}\p{N}]+".join(w.replace("license", "licen[cs]e") for w in words) for words in texts if words}
    return "|".join(sorted(found, key=lambda x: (-len(x), x))) or "(?!)"


def statement(texts: Sequence[tuple[str, str]] = tuple(TEXTS), notices: Sequence[tuple[str, str]] = tuple(NOTICES)) -> str:
    """The pattern of copyright statements; its first group is what stands before one.

    A statement begins a line or follows a known title. It is a mark with a year, a
    placeholder or another mark behind it, or directly precedes a known text; body
    text that wraps before the word is none. It ends with its line, or where a known
    text or notice begins, so it may share a line with them.
    """
    fold = str.maketrans(_UPPER, _LOWER)
    words = lambda text: re.findall(r"[^\W_]+", text.translate(fold))
    titles, heads = [], []
    for _, text in texts:
        lines = text.split("\n")
        at = next((k for k, line in enumerate(lines) if re.match(r"\W*copyright\W+(\(c\)|<|\[|\{|[0-9])", line, re.I)), None)
        if at is not None:
            titles.append(words("\n".join(lines[:at])))
            heads.append(words("\n".join(lines[at + 1 :]))[:HEAD_WORDS])
    head, title = rf"(?<![\p{{L}}\p{{N}}])(?:{_spelled(heads)})(?![\p{{L}}\p{{N}}])", _spelled(titles)
    notice = rf"(?<![\p{{L}}\p{{N}}])(?:{_spelled(words(t)[:NOTICE_WORDS] for _, t in notices)})(?![\p{{L}}\p{{N}}])"
    # to a known text or notice in the line, to a known text in the next if the holder's name wraps, or to the line's end
    end = rf"(?:[^\n]*?(?={head}|{notice})|[^\n]*\n[^\n.:;]{{1,80}}?{_GAP}(?={head})|[^\n]*)"
    marked = rf"(?:portions\s+)?{_MARK}(?={_GAP}\n?{_GAP}(?:(?:19|20)[0-9]{{2}}(?![0-9])|{_MARK}|[<\[{{])){end}"
    bare = rf"(?:portions\s+)?{_MARK}[^\n]{{1,200}}?(?=[^\p{{L}}\p{{N}}]*+{head})"
    reserved = rf"all\s+rights\s+reserved(?:{_GAP}$|[^\p{{L}}\p{{N}}]*+(?={head}))"
    return rf"(?md)(^{_GAP}(?:(?:{title})[^\p{{L}}\p{{N}}]+?)?)(?:{marked}|{bare}|{reserved})"


STATEMENT = statement()


def canonical_lines(text: Column, statements: str = STATEMENT) -> Column:
    """The text without case, copyright statements and punctuation; its line breaks stay."""
    text = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    text = F.regexp_replace(text, statements, "$1")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")
    for spelling, same in EQUIVALENT:
        text = F.replace(text, F.lit(spelling), F.lit(same))
    return text


def _flat(lines: Column) -> Column:
    """Canonical lines as one line; spellings that a line break had split are made equal."""
    flat = F.regexp_replace(F.replace(lines, F.lit("\n"), F.lit(" ")), " {2,}", " ")
    for spelling, same in EQUIVALENT:
        if " " in spelling:
            flat = F.replace(flat, F.lit(spelling), F.lit(same))
    return F.trim(flat)


def canonical(text: Column, statements: str = STATEMENT) -> Column:
    """The canonical form of a whole text."""
    return _flat(canonical_lines(text, statements))


def _known(df: DataFrame, rows: Sequence[tuple[str, str]], statements: str) -> DataFrame:
    """(license, digest, size) of known texts; refuses a table that is no small one."""
    if len(rows) > KNOWN_AT_MOST:
        raise ValueError(f"at most {KNOWN_AT_MOST} known texts are broadcast")
    texts = df.sparkSession.createDataFrame(list(rows), "license string, text string")
    form = canonical(F.col("text"), statements)
    texts = texts.select("license", F.sha2(form, 256).alias("digest"), F.length(form).alias("size"))
    return texts.groupBy("digest", "size").agg(F.min("license").alias("license"))


def scan(
    df: DataFrame,
    text_column: str = "text",
    id_column: str = "doc_id",
    texts: Sequence[tuple[str, str]] = tuple(TEXTS),
    notices: Sequence[tuple[str, str]] = tuple(NOTICES),
) -> DataFrame:
    """One row per input row: doc_id, text_digest, license, notices.

    ``license`` is the known licence whose text the whole document is, else null;
    ``notices`` the licences, sorted, distinct and joined by commas, whose notice is a line
    of the document (empty if none). A null text is empty and matches nothing;
    repeated rows get repeated results; an empty table gives an empty one; other
    columns are not read. Lines are only digested if a known notice has their length.
    """
    statements = statement(texts, notices)
    whole, lines = F.broadcast(_known(df, texts, statements)), _known(df, notices, statements)
    sizes = sorted({r["size"] for r in lines.select("size").collect()})
    by_digest = [(r["digest"], r["license"]) for r in lines.collect()]
    picked = df.select(named(df, id_column).alias("doc_id"), canonical_lines(named(df, text_column), statements).alias("body"))
    flat = _flat(F.col("body"))
    found = F.transform(F.split("body", "\n"), lambda x: F.trim(x))
    found = F.filter(found, lambda x: F.length(x).isin(sizes) if sizes else F.lit(False))
    # the digest table of notices as a literal map: a hash lookup per line, no explosion
    table = F.create_map(*[F.lit(v) for pair in by_digest for v in pair]) if by_digest else F.create_map().cast("map<string,string>")
    hits = F.transform(found, lambda x: F.try_element_at(table, F.sha2(x, 256)))
    hits = F.array_join(F.array_sort(F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))), ",")
    picked = picked.select("doc_id", F.sha2(flat, 256).alias("text_digest"), F.length(flat).alias("length"), hits.alias("notices"))
    matched = picked.join(whole, (picked.text_digest == whole.digest) & (picked.length == whole["size"]), "left")
    return matched.select("doc_id", "text_digest", "license", "notices")


def _sql_lines(text: str) -> str:
    form = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    form = f"regexp_replace({form}, '{COPYRIGHT_LINE}', '', 'g')"
    form = f"regexp_replace({form}, '[^\\p{{L}}\\p{{N}}\n]+', ' ', 'g')"
    for spelling, same in EQUIVALENT:
        form = f"replace({form}, '{spelling}', '{same}')"
    return form


def _sql_flat(lines: str) -> str:
    form = f"regexp_replace(replace({lines}, chr(10), ' '), ' {{2,}}', ' ', 'g')"
    for spelling, same in EQUIVALENT:
        if " " in spelling:
            form = f"replace({form}, '{spelling}', '{same}')"
    return f"trim({form}, ' ')"


def oracle() -> str:
    """The same scan as DuckDB SQL."""
    values = lambda rows: ", ".join("('%s', '%s')" % (a, b.replace("'", "''")) for a, b in rows)
    return f"""
WITH known AS (SELECT license, {_sql_flat(_sql_lines('t'))} AS form FROM (VALUES {values(TEXTS)}) AS k(license, t)),
notice AS (SELECT license, {_sql_flat(_sql_lines('t'))} AS form FROM (VALUES {values(NOTICES)}) AS k(license, t)),
bodies AS (SELECT doc_id, {_sql_lines('text')} AS body FROM documents),
lines AS (SELECT doc_id, trim(unnest(string_split(body, chr(10))), ' ') AS line FROM bodies),
hits AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
         FROM lines JOIN notice ON line = form GROUP BY doc_id)
SELECT b.doc_id, sha256({_sql_flat('body')}) AS text_digest,
       (SELECT min(license) FROM known WHERE form = {_sql_flat('body')}) AS license,
       coalesce(h.notices, '') AS notices
FROM bodies b LEFT JOIN hits h USING (doc_id)
"""
