"""Cleaning of document text, as functions of columns and, line by line, of tables.

A table holds one text per ``doc_id``.  All that an operator needs of a line
stands in the same text, so nothing is shuffled: the line operators take texts in
Arrow batches and give each back with the lines that it keeps, the rest are
expressions that stay inside one stage.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkstone.functions.text import strip

REPEATED_TITLE, REPEATED_LINE = 3, 2
TABLE_KEY, TEXT_KEY = 60, 120
#: Patterns of what is cleaned away.
STYLE, RULE = r"(?s)<style[^>]*>.*?</style>", r"(?s)\.[A-Za-z][\w\-]*[^{]*\{[^}]*\}"
PICTURE = r"\*\*==>?\s*picture\s*\[\d+\s*x\s*\d+\]\s*intentionally omitted\s*<==\*\*\n?"
PICTURE_TEXT = r"(?s)\*\*----- Start of picture text -----\*\*.*?\*\*----- End of picture text -----\*\*\n?"
PAGE_NUMBER, EMPTY_BULLET, SOURCE_NOTICE = r"(?mdU)^\s*\d{1,3}\s*$", r"(?mdU)^[\s▪•\-–—]+\s*$", r"(?md)^☞.*출처.*바랍니다.*$"
_FOOTNOTE = re.compile(r"주\s*\d+\)|[*☞]")
_MARKS, _TABLE_MARKS = re.compile(r"^#+\s*"), re.compile(r"[|*\s]")


def css_blocks(text: Column) -> Column:
    """Without style elements and rule blocks; a rule reaches from a dot and letter to the next brace, over lines."""
    return F.regexp_replace(F.regexp_replace(text, STYLE, ""), RULE, "")


def picture_tags(text: Column) -> Column:
    """Without the marks of omitted pictures."""
    return F.regexp_replace(text, PICTURE, "")


def picture_text(text: Column) -> Column:
    """Without the text read from pictures."""
    return F.regexp_replace(text, PICTURE_TEXT, "")


def page_numbers(text: Column) -> Column:
    """With lines of one to three digits blanked, neighbouring blank lines with them."""
    return F.regexp_replace(text, PAGE_NUMBER, "")


def empty_bullets(text: Column) -> Column:
    """With lines of only bullets, dashes and spaces blanked."""
    return F.regexp_replace(text, EMPTY_BULLET, "")


def source_notice(text: Column) -> Column:
    """Without notices that ask to name the source."""
    return F.regexp_replace(text, SOURCE_NOTICE, "")


def whitespace(text: Column) -> Column:
    """At most one blank line and one space in a row, nothing around."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), " {2,}", " "))


def by_text(docs: DataFrame, change: Callable[[str], str]) -> DataFrame:
    """(doc_id, text) with ``change`` applied to every text that is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else change(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, batch.schema.field(1).type)], schema=batch.schema)

    given = docs.select("doc_id", "text")
    return given.mapInArrow(run, StructType([given.schema["doc_id"], StructField("text", StringType())]))


def _keys(text: str) -> tuple[list[str], list[str]]:
    lines = text.splitlines()
    return lines, [x.strip() for x in lines]


def repeated_titles(docs: DataFrame) -> DataFrame:
    """Of lines that stand three times or more in a document, only the first is kept."""

    def change(text: str) -> str:
        lines, keys = _keys(text)
        often = {k for k, n in Counter(keys).items() if n >= REPEATED_TITLE and k}
        first = dict(zip(reversed(keys), range(len(keys) - 1, -1, -1), strict=True)) if often else {}
        return "\n".join(x for i, (x, k) in enumerate(zip(lines, keys, strict=True)) if k not in often or first[k] == i)

    return by_text(docs, change)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines that stand twice or more, heading marks aside, are dropped altogether.

    If two or more lines consist of heading marks alone, blank lines go with them.
    """

    def change(text: str) -> str:
        lines, keys = _keys(text)
        norms = [_MARKS.sub("", k) if k.startswith("#") else k for k in keys]
        count = Counter(n for n, k in zip(norms, keys, strict=True) if k)
        return "\n".join(x for x, n in zip(lines, norms, strict=True) if count[n] < REPEATED_LINE)

    return by_text(docs, change)


def consecutive_lines(docs: DataFrame) -> DataFrame:
    """A line equal to the last line that is not blank is dropped."""

    def change(text: str) -> str:
        lines, keys = _keys(text)
        solid = [i for i, k in enumerate(keys) if k]
        gone = {j for i, j in zip(solid, solid[1:]) if keys[i] == keys[j]}
        return "\n".join(x for i, x in enumerate(lines) if i not in gone)

    return by_text(docs, change)


def footnotes(docs: DataFrame) -> DataFrame:
    """Of footnotes alike but for spaces only the first is kept."""

    def change(text: str) -> str:
        lines, keys = _keys(text)
        notes = {i: "".join(k.split()) for i, k in enumerate(keys) if _FOOTNOTE.match(k)}
        first = {note: i for i, note in reversed(notes.items())}
        return "\n".join(x for i, x in enumerate(lines) if i not in notes or first[notes[i]] == i)

    return by_text(docs, change)


def table_rows(docs: DataFrame) -> DataFrame:
    """Line breaks for br elements, and of table rows and leading texts alike only the first."""

    def key(part: str) -> str:
        bare = part.strip()
        row = next((x for x in bare.splitlines() if "|" in x), None)
        return bare[:TEXT_KEY] if row is None else _TABLE_MARKS.sub("", row)[:TABLE_KEY]

    def change(text: str) -> str:
        for mark in ("<br>", "<br/>", "<br />"):
            text = text.replace(mark, "\n")
        first: dict[str, str] = {}
        for part in _parts(text):
            first.setdefault(key(part), part)
        return "".join(first.values())

    return by_text(docs, change)


def _parts(text: str) -> list[str]:
    """The text cut in front of every line that begins with a bar."""
    head, *rows = text.split("\n|")
    return [head, *("\n|" + r for r in rows)] if head else ["\n|" + r for r in rows]


def _each(*steps: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    def run(docs: DataFrame) -> DataFrame:
        text = F.col("text")
        for step in steps:
            text = step(text)
        return docs.select("doc_id", text.alias("text"))

    return run


_TAIL = _each(empty_bullets, whitespace)
_PAGES = (_each(picture_tags, picture_text), repeated_titles, _each(page_numbers), repeated_lines, _TAIL)
PROFILES: dict[str, tuple[Callable[[DataFrame], DataFrame], ...]] = {
    "hwp": (_each(css_blocks, empty_bullets, whitespace),),
    "ir_report": (table_rows, *_PAGES),
    "pdf": _PAGES,
    "docx": (consecutive_lines, footnotes, _each(source_notice, empty_bullets, whitespace)),
    "generic": (_TAIL,),
}


def clean(docs: DataFrame, source: str = "generic") -> DataFrame:
    """(doc_id, text) cleaned in the order of the source's profile; unknown sources get the generic one."""
    out = docs.select("doc_id", "text")
    for step in PROFILES.get(source, PROFILES["generic"]):
        out = step(out)
    return out


def tags_to_text(html: Column) -> Column:
    """Text of markup: tags as spaces, named entities resolved, blank lines and spaces reduced."""
    text = F.regexp_replace(html, r"<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return strip(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), " {2,}", " "))
