"""Scores of predicted against reference answers, as functions of columns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.text import bound

_TERM = re.compile("[가-힣a-zA-Z0-9]+")

#: Patterns of dates, of a number's units, and words that are no entities.
DATE = r"\d{4}\.\d{1,2}(?:\.\d{1,2})?|\d{4}년\s*\d{1,2}월|\d{2}/\d{2}"
UNITS = r"(?:\s*(?:조|억|만)?\s*(?:원|달러|엔|위안))?(?:\s*[%％](?:p|P)?)?(?:\s*bp)?(?:\s*개월)?"
ONE = r"[\+\-]?[\d,]+\.?\d*"
NUMBER, RANGE = ONE + UNITS, f"{ONE}~{ONE}{UNITS}"
NO_ENTITY = (
    "이곳", "저곥", "그곳", "이것", "저것", "그것", "한다", "하는", "되는", "있다", "없다", "서말", "대비", "대해", "대한", "따릅", "위한",
    "목표", "결과", "수준", "기준", "N/A", "문서", "내용", "없음", "없는",
)


def normal(token: Column) -> Column:
    """A number without surrounding space, commas and spaces."""
    return F.regexp_replace(F.regexp_replace(token, r"^\s+|\s+$", ""), "[, ]", "")


def numbers(text: Column) -> Column:
    """Numbers with their units, ranges first, each once; dates don't count, nor do lone signs."""
    dated = F.regexp_replace(text, DATE, "")
    found = F.concat(F.regexp_extract_all(dated, F.lit(RANGE), F.lit(0)), F.regexp_extract_all(F.regexp_replace(dated, RANGE, ""), F.lit(NUMBER), F.lit(0)))
    return F.array_distinct(F.filter(F.transform(found, normal), lambda x: ~x.isin("", ".", "-", "+")))


def number_match(prediction: Column, reference: Column) -> Column:
    """struct(accuracy, matched, missed) over the reference's numbers; 1.0 without any."""
    want, have = numbers(reference), numbers(prediction)
    hit = F.array_intersect(want, have)
    return F.struct(F.when(F.size(want) > 0, F.round(F.size(hit) / F.size(want), 4)).otherwise(1.0).alias("accuracy"), hit.alias("matched"), F.array_except(want, have).alias("missed"))


def entities(text: Column) -> Column:
    """Runs of two to ten Hangul syllables that are no stop words, each once, in order."""
    return F.array_distinct(F.array_except(F.regexp_extract_all(text, F.lit("[가-힣]{2,10}"), F.lit(0)), F.array(*(F.lit(w) for w in NO_ENTITY))))


def entity_coverage(prediction: Column, reference: Column, keys: Column | None = None) -> Column:
    """struct(coverage, matched, missed, total): targets found in the prediction, commas and spaces aside.

    Targets are the keys given, else the reference's numbers and entities; empty
    sides score 0, no targets 1.
    """
    own = F.array_sort(F.array_union(numbers(reference), entities(reference)))
    want = own if keys is None else F.when(F.size(F.coalesce(keys, F.array().cast("array<string>"))) > 0, keys).otherwise(own)
    flat = lambda x: F.regexp_replace(x, "[, ]", "")
    hit = lambda e: F.contains(flat(prediction), flat(e)) | F.contains(prediction, e)
    empty = (F.coalesce(prediction, F.lit("")) == "") | (F.coalesce(reference, F.lit("")) == "")
    none = F.array().cast("array<string>")
    matched, missed = F.filter(want, hit), F.filter(want, lambda e: ~hit(e))
    return F.when(empty, F.struct(F.lit(0.0).alias("coverage"), none.alias("matched"), none.alias("missed"), F.lit(0).alias("total"))).otherwise(
        F.struct(F.when(F.size(want) > 0, F.round(F.size(matched) / F.size(want), 4)).otherwise(1.0).alias("coverage"), matched.alias("matched"), missed.alias("missed"), F.size(want).alias("total"))
    )


def _f1(overlap: Column, a: Column, b: Column) -> Column:
    p, r = overlap / a, overlap / b
    return F.when((a > 0) & (b > 0) & (overlap > 0), F.round(2 * p * r / (p + r), 4)).otherwise(0.0)


def _overlaps(count: Callable[[list[str], list[str]], tuple[int, int, int]], prediction: Column, reference: Column) -> Column:
    """F-measure of a count of (in common, of the prediction, of the reference) over the terms of both."""

    @F.pandas_udf("both int, a int, b int")
    def counted(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [count(_TERM.findall(p or ""), _TERM.findall(r or "")) for p, r in zip(x, y, strict=True)]
        return pd.DataFrame(rows, columns=["both", "a", "b"]).astype("int32")

    return F.coalesce(bound(counted(prediction, reference), lambda c: _f1(c["both"], c["a"], c["b"])), F.lit(0.0))


def rouge_n(prediction: Column, reference: Column, n: int) -> Column:
    """F-measure of the n-grams in common, counted as often as both have them."""

    def count(p: list[str], r: list[str]) -> tuple[int, int, int]:
        a, b = (Counter(zip(*(x[k:] for k in range(n)))) for x in (p, r))
        return sum((a & b).values()), sum(a.values()), sum(b.values())

    return _overlaps(count, prediction, reference)


def common_length(p: list[str], r: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table being the bits of one number."""
    places: dict[str, int] = {}
    for i, t in enumerate(p):
        places[t] = places.get(t, 0) | 1 << i
    row, every = (1 << len(p)) - 1, (1 << len(p)) - 1
    for t in r:
        hit = row & places.get(t, 0)
        row = (row + hit | row - hit) & every
    return len(p) - row.bit_count()


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F-measure of the longest common subsequence of terms."""
    return _overlaps(lambda p, r: (common_length(p, r), len(p), len(r)), prediction, reference)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """Cosine between 0 and 1 to four digits; null where a vector is null or zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm)), 4))


def bert_score(pairs):
    """(pair, precision, recall, f1) of (pair, side, token_no, vector): mean of each token's best match on the other side.

    ``side`` is p or r.  Token vectors meet only within their pair.
    """
    p = pairs.where("side = 'p'").select("pair", F.col("token_no").alias("i"), F.col("vector").alias("v"))
    r = pairs.where("side = 'r'").select("pair", F.col("token_no").alias("j"), F.col("vector").alias("u"))
    sim = p.join(r, "pair").withColumn("s", dot(F.col("v"), F.col("u")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("u"), F.col("u"))))
    prec = sim.groupBy("pair", "i").agg(F.max("s").alias("s")).groupBy("pair").agg(F.avg("s").alias("p"))
    rec = sim.groupBy("pair", "j").agg(F.max("s").alias("s")).groupBy("pair").agg(F.avg("s").alias("r"))
    return prec.join(rec, "pair").select("pair", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")), 4).alias("f1"))
