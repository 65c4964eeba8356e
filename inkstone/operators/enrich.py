"""Metadata derived from the text of a chunk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.text import bound, contains_any

#: The words of each type of section, in the order in which the types are tried.
SECTION_TYPES = {
    "실적": ("실적", "매출", "영업이익", "순이익", "매출액", "revenue", "earnings", "profit", "손익"),
    "리스크": ("리스크", "위험", "risk", "충당금", "부실", "손실", "불확실"),
    "전망": ("전망", "outlook", "guidance", "목표", "계획", "전략", "성장", "로드맵", "방향"),
}
#: The metrics looked for.
METRICS = (
    "영업이익", "순이익", "매출", "매출액", "ROE", "ROA", "EPS", "PER", "PBR", "BIS", "부채비율", "자본", "자산", "배당", "배당수익률", "EBITDA",
    "영업현금흐름", "잉여현금흐름", "FCF", "영업이익률", "순이익률", "시가총액", "주가", "EV", "ROIC", "레버리지",
)
YEAR = r"(?U)\b(20[1-3][0-9])년?\b"


def doc_year(section: Column, text: Column) -> Column:
    """The year named most often in section and text, of equals the greatest; null if none is."""
    years = F.regexp_extract_all(F.concat_ws(" ", section, text), F.lit(YEAR), F.lit(1))
    count = lambda ys: F.transform(F.array_distinct(ys), lambda y: F.struct(F.size(F.filter(ys, lambda z: z == y)).alias("n"), y.alias("y")))
    return bound(years, lambda ys: F.array_max(count(ys))["y"])


def section_type(section: Column, text: Column) -> Column:
    """The first type with a word in the section's name or the first hundred characters; null if none."""
    head = F.lower(F.concat(F.coalesce(section, F.lit("")), F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, 100)))
    out = F.lit(None).cast("string")
    for name, words in reversed(SECTION_TYPES.items()):
        out = F.when(contains_any(head, words), F.lit(name)).otherwise(out)
    return out


def metrics(text: Column, words: tuple[str, ...] = METRICS) -> Column:
    """The metrics that stand in the text, case-sensitive and anywhere, sorted."""
    found = F.array(*(F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words))
    return F.coalesce(F.array_sort(F.array_compact(found)), F.array().cast("array<string>"))
