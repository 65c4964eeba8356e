"""Column helpers that treat text as Python's ``str`` methods do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that str.strip takes off, and where str.splitlines cuts.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85  ]"


def strip(text: Column) -> Column:
    """``str.strip``."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def splitlines(text: Column) -> Column:
    """``str.splitlines``: no item for an empty rest behind the last line end."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def is_blank(text: Column) -> Column:
    """Whether nothing is left of a text after ``strip``; true for null."""
    return F.coalesce(strip(text) == "", F.lit(True))


def tokens(text: Column) -> Column:
    """Runs of Hangul, Latin letters and digits, case kept."""
    return F.regexp_extract_all(text, F.lit("[가-힣a-zA-Z0-9]+"), F.lit(0))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words stands in the text."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def replace_all(text: Column, old: str, new: Column) -> Column:
    """Replace a literal by a column's value."""
    return F.replace(text, F.lit(old), new)
