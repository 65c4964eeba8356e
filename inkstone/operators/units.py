"""Quantities in many units and notations, brought to common units.

Every mention of a quantity becomes a row with a number and a notation, the
spelling of its unit.  A notation that the grammar of units can read is an
anchor: its conversion is known.  For any other, the same entities are linked
across sources, the documents, by what is said around their numbers; quantiles
over entities hold their sizes in a notation of a source against those in
resolved ones, with each known conversion and a possible offset, and the best is
taken.  Notations resolved so become anchors of the next round, until nothing is
won.  Each entity is reduced to one row per source and notation before entities
are compared, so no pairs of mentions are formed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.runtime import materialize

#: Scale words and base units, with the quantity and the size of one in its common unit.
SCALES = {"": 1, "십": 10, "백": 100, "천": 1_000, "만": 10**4, "십만": 10**5, "백만": 10**6, "천만": 10**7, "억": 10**8, "십억": 10**9, "백억": 10**10, "천억": 10**11, "조": 10**12}
BASES = {"원": ("krw", 1), "달러": ("usd", 1), "불": ("usd", 1), "명": ("people", 1), "인": ("people", 1), "주": ("shares", 1), "톤": ("mass", 1_000)}
CURRENCIES = {"krw": "krw", "₩": "krw", "won": "krw", "usd": "usd", "us$": "usd", "$": "usd", "dollars": "usd"}
CURRENCY_SCALES = {"": 1, "k": 1_000, "thousand": 1_000, "m": 10**6, "mn": 10**6, "mln": 10**6, "million": 10**6, "b": 10**9, "bn": 10**9, "bln": 10**9, "billion": 10**9, "t": 10**12, "tn": 10**12, "trn": 10**12, "trillion": 10**12}
OTHERS = {
    "%": ("rate", 100), "%p": ("rate", 100), "%pt": ("rate", 100), "퍼센트": ("rate", 100), "퍼센트포인트": ("rate", 100), "percent": ("rate", 100), "pp": ("rate", 100),
    "‰": ("rate", 10), "퍼밀": ("rate", 10), "bp": ("rate", 1), "bps": ("rate", 1), "베이시스포인트": ("rate", 1),
    "wh": ("energy", 0.001), "kwh": ("energy", 1), "mwh": ("energy", 10**3), "gwh": ("energy", 10**6), "twh": ("energy", 10**9),
    "kg": ("mass", 1), "g": ("mass", 0.001), "t": ("mass", 10**3), "kt": ("mass", 10**6), "mt": ("mass", 10**9), "ton": ("mass", 10**3), "tons": ("mass", 10**3), "킬로그램": ("mass", 1),
    "개월": ("duration", 1), "달": ("duration", 1), "mo": ("duration", 1), "month": ("duration", 1), "months": ("duration", 1), "년": ("duration", 12), "yr": ("duration", 12), "yrs": ("duration", 12), "year": ("duration", 12), "years": ("duration", 12),
}
#: Money is understood behind a bare large scale word.
BARE = {"만": ("krw", 10**4), "억": ("krw", 10**8), "조": ("krw", 10**12), "천억": ("krw", 10**11), "십억": ("krw", 10**9), "백억": ("krw", 10**10)}


def conversions() -> dict[str, tuple[str, float]]:
    """Every notation that the grammar reads: no spaces, lower case → quantity and size in the common unit."""
    out = {f"{s}{b}": (q, k * n) for b, (q, n) in BASES.items() for s, k in SCALES.items()}
    out |= {f"{c}{s}": (q, k) for c, q in CURRENCIES.items() for s, k in CURRENCY_SCALES.items()}
    out |= OTHERS | BARE
    return out


_FROM = "０１２３４５６７８９，．（）－＋％＄￦−–‐△▲▼ 　\x01"
_TO = "0123456789,.()-+%$₩-----" + "-" + "   "
_NUMBER = r"\d++(?:,\d{3})*+(?:\.\d++)?+"
_SCALE_RE = "(?:천만|백만|십만|천억|백억|십억|조|억|만|천|백|십)"
_BASE_RE = "(?:원|달러|불|명|인|주|톤)"
#: Notations behind a number, longest first.
_SUFFIX = (
    rf"(?:{_SCALE_RE}\s*{_BASE_RE}|{_BASE_RE}|%\s*pt|%\s*p|%|퍼센트포인트|퍼센트|percent|‰|퍼밀|bps|bp|"
    r"[kKMGT]?[Ww]h|kg|kt|[Mm]t|t|tons?|개월|년|years?|yrs?|months?|" + rf"{_SCALE_RE})"
)
#: What looks like a quantity and is none: dates, years, periods, ranks, ordinals, times.
_NOT = (
    r"\d{4}\s*[-./]\s*\d{1,2}\s*[-./]\s*\d{1,2}|\d{1,2}/\d{1,2}|(?:19|20)\d{2}\s*년(?:\s*\d{1,2}\s*월(?:\s*\d{1,2}\s*일)?)?(?:\s*[1-4]\s*분기)?"
    r"|FY\s*\d{2,4}E?|[1-4]Q\s*\d{2,4}E?|[1-4]H\s*\d{2,4}|\d+\s*분기|제\s*\d+\s*(?:차|회|기|호)|\d+\s*위|\d+\s*(?:번째|차례|등급)|\d{1,2}:\d{2}|\d{1,2}\s*월(?:\s*\d{1,2}\s*일)?"
)
_MISSING = r"^(?:|-+|n\.?\s*[am]\.?|n/?a|nm|null|none|nan|적자전환|흑자전환|미공시)$"


def plain(text: Column) -> Column:
    """Full-width signs as usual ones, all signs for negative numbers as a hyphen."""
    return F.trim(F.translate(text, _FROM, _TO))


def notation(text: Column) -> Column:
    """A spelling of a unit without spaces, brackets and the word for unit, in lower case; null if blank."""
    t = F.regexp_replace(F.lower(plain(text)), r"단위|units?\s*:|[\s()\[\]:：]", "")
    return F.when(t != "", t)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _decimal(digits: Column) -> Column:
    return F.regexp_replace(digits, ",", "").try_cast("decimal(20,6)")


_YEARS = rf"(-?)\s*({_NUMBER})\s*년\s*(\d+)\s*개월"
_TRILLIONS = rf"([-(]?)\s*({_NUMBER})\s*조\s*({_NUMBER})\s*(천)?억"
_CURRENCY = rf"([-(]?)\s*(KRW|₩|USD|US\$|\$)\s*([-(]?)\s*({_NUMBER})\s*\)?\s*(trillion|trn|tn|billion|bln|bn|million|mln|mn|thousand|[mkbt](?![A-Za-z]))?"
_PLAIN = rf"([-(]?)\s*({_NUMBER})\s*\)?\s*({_SUFFIX})(?![A-Za-z])"
_ODD = rf"([-(]?)\s*({_NUMBER})\s*\)?\s*([^\s\d,.()\-]+)"
#: What is before a quantity, its parts in all notations, and what is behind it, as fields between marks.
_MARK = "\x01"
_FIELDS = rf"(?s)^(.*?)(?:{_YEARS}|{_TRILLIONS}|{_CURRENCY}|{_PLAIN})(.*)$"
_ODD_FIELDS = rf"(?s)^(.*?){_ODD}(.*)$"
#: Notation of numbers whose unit is stated nowhere; what it means is a matter of each source.
UNSTATED = "?"
#: Words in which a report says that it gives a figure, and endings of nouns, none of them part of what is measured.
_SAYING = ("기록", "집계됨", "집계", "수준", "변동", "약", "업체", "대비", "우위", "중", "추이", "위", "reported", "recorded", "was", "were", "of", "the", "at", "about", "around", "in", "to")
_ENDING = "(?<=[가-힣]{2})(?:으로|에서|은|는|이|가|을|를|의|로|도)$"


def fields(text: Column) -> Column:
    """The parts of the first quantity in a text, by one pattern of all notations; a text without one stays in one piece."""
    marks = lambda n: _MARK.join(f"${i}" for i in range(1, n + 1))
    usual = F.regexp_replace(text, _FIELDS, marks(17))
    return F.split(F.when(F.contains(usual, F.lit(_MARK)), usual).otherwise(F.regexp_replace(text, _ODD_FIELDS, marks(5))), _MARK, -1)


def measured(p: Column) -> Column:
    """struct(number, notation, about) of the quantity among ``fields``, or null; about is the text around it.

    Years with months and trillions with hundreds of millions become one number.
    Of several quantities, which a text should not have, the first counts.
    """

    def value(signs: list[Column], number: Column, unit: Column, last: int) -> Column:
        minus = signs[0] != ""
        for s in signs[1:]:
            minus = minus | (s != "")
        return F.struct(F.when(minus, -number).otherwise(number).cast("decimal(26,6)").alias("number"), unit.alias("notation"), F.concat(p[0], F.lit(" "), p[last]).alias("about"))

    years = value([p[1]], _decimal(p[2]) * 12 + _decimal(p[3]), F.lit("개월"), 16)
    trillions = value([p[4]], _decimal(p[5]) * 10_000 + _decimal(p[6]) * F.when(p[7] == "", 1).otherwise(1000), F.lit("억원"), 16)
    money = value([p[8], p[10]], _decimal(p[11]), F.lower(F.concat(p[9], p[12])), 16)
    usual = value([p[13]], _decimal(p[14]), F.lower(F.regexp_replace(p[15], r"\s", "")), 16)
    odd = value([p[1]], _decimal(p[2]), F.lower(p[3]), 4)
    return F.when(p.isNull(), F.lit(None)).when(F.size(p) == 5, odd).when(F.size(p) != 17, F.lit(None)).when(p[2] != "", years).when(p[5] != "", trillions).when(p[11] != "", money).otherwise(usual)


def bare_number(text: Column) -> Column:
    """The number of a text that holds nothing else, brackets or a hyphen making it negative."""
    parts = F.split(F.regexp_replace(text, rf"^([-(]?)\s*[+]?({_NUMBER})\s*\)?$", f"{_MARK}$1{_MARK}$2"), _MARK, -1)
    return F.when(F.size(parts) == 3, F.when(parts[1] == "", _decimal(parts[2])).otherwise(-_decimal(parts[2])).cast("decimal(26,6)"))


def mentions(sections: DataFrame) -> DataFrame:
    """(doc_id, section_no, place, series_no, pos, about, period, number, notation) of all mentions of quantities.

    A bullet's unit stands behind or before its number.  A chart's stands with
    the value, in the field ``unit``, in the title or with the name of the
    series; the nearest to the value counts, and a value without any has the
    notation ``UNSTATED``.  ``about`` is the text around a quantity, of a chart
    its title and series; ``period`` the label of the value or the text that may
    name its period.  Repeated rows count once, of differing ones the least.
    Null lists, missing values and bullets without any unit give no rows.
    """
    rows = (
        sections.where("doc_id is not null and section_no is not null").groupBy("doc_id", "section_no")
        .agg(F.min(F.struct("bullets", "chart_spec")).alias("r")).select("doc_id", "section_no", "r.bullets", "r.chart_spec")
    )
    keys = ["doc_id", "section_no"]
    bullets = rows.select(*keys, F.lit("bullets").alias("place"), F.lit(0).alias("series_no"), F.posexplode("bullets").alias("pos", "raw"))
    bullets = bullets.withColumn("whole", plain(F.col("raw"))).withColumn("text", F.regexp_replace("whole", _NOT, " ")).where(F.col("text").rlike(r"\d"))
    bullets = bullets.select(*keys, "place", "series_no", "pos", F.lit(None).cast("string").alias("unit"), F.lit("").alias("about"), F.col("whole").alias("period"), "text")

    spec = F.col("chart_spec")
    title_unit = F.coalesce(
        notation(F.nullif(_part(plain(spec["title"]), r"단위\s*:?\s*([^)\]]+?)\s*[)\]]?\s*$", 1), F.lit(""))),
        notation(F.nullif(_part(plain(spec["title"]), r"[(\[]\s*([^)\]]+?)\s*[)\]]\s*$", 1), F.lit(""))),
    )
    charts = rows.where("chart_spec is not null").select(*keys, spec.alias("c"), F.coalesce(notation(spec["unit"]), title_unit).alias("unit"), F.coalesce(F.regexp_replace(plain(spec["title"]), r"\s*추이.*$|\s*[(\[,].*$", ""), F.lit("")).alias("about"))
    label = F.coalesce(F.try_element_at("c.labels", F.col("pos") + 1), F.lit(""))
    flat = charts.select(*keys, F.lit("values").alias("place"), F.lit(0).alias("series_no"), F.posexplode("c.values").alias("pos", "raw"), "unit", "about", "c").withColumn("period", label).drop("c")
    series = charts.select(*keys, "unit", "about", "c", F.posexplode("c.series").alias("series_no", "s"))
    name_unit = notation(F.nullif(_part(plain(F.col("s.name")), r"[(\[]\s*([^)\]]+?)\s*[)\]]\s*$", 1), F.lit("")))
    nested = series.select(*keys, F.lit("series").alias("place"), "series_no", F.posexplode("s.values").alias("pos", "raw"), F.coalesce(name_unit, F.col("unit")).alias("unit"), F.concat_ws(" ", "about", "s.name").alias("about"), "c").withColumn("period", label).drop("c")
    values = flat.unionByName(nested).withColumn("text", plain(F.col("raw"))).where(F.col("text").rlike(r"\d") & ~F.lower("text").rlike(_MISSING)).drop("raw")
    texts = bullets.unionByName(values).select("*", F.explode(F.array(F.when(F.col("place") != "bullets", bare_number(F.col("text"))))).alias("alone"))
    # exploded, for a filter on the parts would otherwise work out all patterns again
    parsed = texts.select("*", F.explode(F.array(F.when(F.col("alone").isNull(), fields(F.col("text"))))).alias("p")).select("*", F.explode(F.array(measured(F.col("p")))).alias("m"))
    found = parsed.select(
        *keys, "place", "series_no", "pos", F.concat_ws(" ", F.nullif("about", F.lit("")), F.when(F.col("place") == "bullets", F.col("m.about"))).alias("about"), "period",
        F.coalesce("alone", "m.number").alias("number"), F.when(F.col("alone").isNotNull(), F.coalesce("unit", F.lit(UNSTATED))).otherwise(F.col("m.notation")).alias("notation"),
    )
    return found.where("number is not null and notation is not null")


def entities(found: DataFrame) -> DataFrame:
    """(entity, source, notation, size): what each mention measures, and its number without sign.

    An entity is the set of words around the quantity, without its notation and
    the words that only report it, with the period; so the same thing in other
    words, order or units is the same entity.  The source is the document.
    """
    words = F.transform(F.regexp_extract_all(F.lower("about"), F.lit("[가-힣]+|[a-z]+"), F.lit(0)), lambda w: F.regexp_replace(w, _ENDING, ""))
    words = F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(*_SAYING))))
    quarter = F.regexp_replace(F.col("period"), r"(?s)^.*?(?:(\d{4})\s*년\s*([1-4])\s*분기|([1-4])Q\s*(?:20)?(\d{2})(?!\d)).*$", "$1$4Q$2$3")
    when = F.regexp_replace(F.when(quarter != F.col("period"), quarter).otherwise(F.regexp_extract("period", r"(?<!\d)(?:19|20)\d{2}(?!\d)", 0)), "^20(?=\\d\\d)", "")
    return found.where("number <> 0").select(F.concat(F.array_join(words, " "), F.lit("|"), when).alias("entity"), F.col("doc_id").alias("source"), "notation", F.abs(F.col("number").cast("double")).alias("size")).where(F.length("entity") > 1)


def _anchors(spark: SparkSession) -> DataFrame:
    rows = [(n, q, float(f), 0.0, ANYWHERE) for n, (q, f) in conversions().items()]
    return spark.createDataFrame(pa.table(dict(zip(("notation", "quantity", "factor", "offset", "scope"), zip(*rows, strict=True), strict=True))))  # part of the plan, no job


#: Scope of a notation that means the same in all sources.
ANYWHERE = "*"


def resolved(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (source, notation, ...) with what their notation means, in all sources or in their own."""
    own = known.where(F.col("scope") != ANYWHERE).withColumnRenamed("scope", "source")
    out = rows.join(known.where(F.col("scope") == ANYWHERE).drop("scope"), "notation")
    return out if own.isEmpty() else out.unionByName(rows.join(own, ["notation", "source"]).select(*out.columns))


def scale_graph(links: DataFrame, anchors: DataFrame, tolerance: float = 0.05, least: int = 3) -> DataFrame:
    """(notation, quantity, factor, offset, scope): the anchors, and every notation of a source linked to them.

    ``links`` has entity, source, notation, size.  In each round the entities'
    sizes in resolved notations, whatever their source, give a reference in the
    common unit.  Every notation that is open is held against it with each known
    conversion of the quantity: without an offset if three quarters of at least
    ``least`` entities agree within ``tolerance`` decades, else with the median
    of what is left as offset, if that varies by no more than ``tolerance`` of
    the references themselves.  The best conversion wins, for all sources
    together where they agree, else for each source.  What is resolved so is a
    reference of the next round; a round that resolves nothing is the last.
    """
    known = anchors
    rows = links if "source" in links.columns else links.withColumn("source", F.lit(""))
    rows = rows.where("size > 0 and entity is not null")
    if rows.join(known, "notation", "left_anti").isEmpty():
        return known
    sizes = materialize(rows.groupBy("entity", "source", "notation").agg(F.percentile_approx("size", 0.5).alias("size")), "unit-sizes")
    steps = anchors.select("quantity", F.col("factor").alias("step")).distinct()
    quartiles = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    while True:
        sized = resolved(sizes, known).withColumn("amount", F.col("size") * F.col("factor") + F.col("offset"))
        reference = sized.groupBy("entity", "quantity").agg(F.percentile_approx("amount", 0.5).alias("ref")).where("ref > 0")
        open_ = sizes.join(known.where(F.col("scope") == ANYWHERE), "notation", "left_anti").join(known.select("notation", F.col("scope").alias("source")), ["notation", "source"], "left_anti")
        link = open_.join(reference, "entity").join(steps, "quantity").withColumn("rest", F.col("ref") - F.col("size") * F.col("step"))
        link = link.withColumn("scope", F.explode(F.when(F.col("notation") == UNSTATED, F.array("source")).otherwise(F.array(F.lit(ANYWHERE), "source"))))
        fit = link.groupBy("scope", "notation", "quantity", "step").agg(
            F.count("*").alias("n"), F.percentile_approx(F.abs(F.log10(F.col("ref") / (F.col("size") * F.col("step")))), 0.75).alias("off"), quartiles(F.col("rest")).alias("rest"), quartiles(F.col("ref")).alias("ref"),
        ).where(F.col("n") >= least)
        spread = (F.col("rest")[2] - F.col("rest")[0]) / F.nullif(F.col("ref")[2] - F.col("ref")[0], F.lit(0.0))
        scored = fit.withColumn("score", F.when(F.col("off") <= tolerance, F.struct(F.lit(0).alias("kind"), F.col("off").alias("by"))).when(spread <= tolerance, F.struct(F.lit(1).alias("kind"), spread.alias("by"))))
        best = scored.where("score is not null").groupBy("scope", "notation").agg(F.min(F.struct("score", (-F.col("n")).alias("n"), "quantity", "step", F.when(F.col("score.kind") == 1, F.col("rest")[1]).otherwise(0.0).alias("offset"))).alias("b"))
        new = materialize(best.select("notation", "b.quantity", F.col("b.step").alias("factor"), "b.offset", "scope"), "unit-resolved")
        if new.isEmpty():
            return known
        pooled = new.where(F.col("scope") == ANYWHERE)
        known = known.unionByName(pooled).unionByName(new.where(F.col("scope") != ANYWHERE).join(pooled.select("notation"), "notation", "left_anti").select(*new.columns))


def harmonized(sections: DataFrame, common_units: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """(doc_id, section_no, place, series_no, pos, quantity, amount) of all quantities in the common units.

    Only quantities named in ``common_units`` come out.  Amounts are rounded to
    whole numbers; mentions in notations that neither the anchors, by default
    the grammar's, nor the graph of sources resolves are left out.
    """
    anchors = _anchors(sections.sparkSession) if anchors is None else anchors
    found = materialize(mentions(sections).withColumn("source", F.col("doc_id")), "unit-mentions")  # read for the graph and for the amounts
    graph = anchors if found.join(anchors, "notation", "left_anti").isEmpty() else scale_graph(entities(found), anchors)
    exact = F.col("number") * F.col("factor").cast("decimal(17,3)") + F.col("offset").cast("decimal(17,3)")
    out = resolved(found, graph).join(common_units.select("quantity").distinct(), "quantity", "left_semi")
    return out.select("doc_id", "section_no", "place", "series_no", "pos", "quantity", F.round(exact).cast("bigint").alias("amount"))
