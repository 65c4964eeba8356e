"""Specifications of charts, checked and turned into what a renderer needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.text import contains_any

#: Colours, sizes and words of the charts.
POSITIVE, NEGATIVE, TOTAL = "#4C78A8", "#E45756", "#72B7B2"
PALETTE = ("#4C78A8", "#F58518", "#54A24B", "#B279A2", "#E45756")
WIDTH = 480
HEIGHTS = {"line": 260, "bar": 260, "pie": 260, "waterfall": 300, "multiline": 320}
TOTAL_WORDS = ("합계", "순이익", "net profit", "net income", "total", "ebitda")
LEAST_POINTS, MAX_SERIES, BUDGET, HOLE = 3, 5, 5, 0.3


def _floats(values: Column) -> Column:
    """Numbers as Python's float reads them: blanks around and underscores aside, no separators."""
    return F.transform(values, lambda v: F.regexp_replace(v, r"^\s+|\s+$", "").try_cast("double"))


def kind(spec: Column) -> Column:
    """The chart's type in lower case, or null where there is nothing to draw."""
    t = F.lower(F.trim(spec["chart_type"]))
    return F.when(t.isin(*HEIGHTS), t)


def single(spec: Column) -> Column:
    """struct(labels, values) of a chart with one series, cut to the shorter; null if it can't be drawn."""
    n = F.least(F.size(spec["labels"]), F.size(spec["values"]))
    values = _floats(F.slice(spec["values"], F.lit(1), F.greatest(n, F.lit(0))))
    good = (F.size(spec["values"]) >= LEAST_POINTS) & spec["labels"].isNotNull() & ~F.exists(values, lambda v: v.isNull())
    return F.when(good, F.struct(F.slice(spec["labels"], F.lit(1), F.greatest(n, F.lit(0))).alias("labels"), values.alias("values")))


def multi(spec: Column) -> Column:
    """array<struct(name, colour, labels, values)> of the first five series that can be drawn; null if none can."""
    first = F.slice(spec["series"], 1, MAX_SERIES)

    def trace(s: Column, i: Column) -> Column:
        n = F.least(F.size(spec["labels"]), F.size(s["values"]))
        values = _floats(F.slice(s["values"], F.lit(1), F.greatest(n, F.lit(0))))
        made = F.struct(F.coalesce(s["name"], F.lit("None")).alias("name"), F.element_at(F.array(*(F.lit(c) for c in PALETTE)), i + 1).alias("colour"), F.slice(spec["labels"], F.lit(1), F.greatest(n, F.lit(0))).alias("labels"), values.alias("values"))
        return F.when((n >= LEAST_POINTS) & ~F.exists(values, lambda v: v.isNull()), made)

    traces = F.filter(F.transform(first, trace), lambda t: t.isNotNull())
    return F.when(spec["labels"].isNotNull() & (F.size(traces) > 0), traces)


def bar_colours(values: Column) -> Column:
    """A colour per value by its sign."""
    return F.transform(values, lambda v: F.when(v >= 0, POSITIVE).otherwise(NEGATIVE))


def measures(labels: Column) -> Column:
    """relative for every bar of a waterfall, total for the last if its label says so."""
    return F.transform(labels, lambda x, i: F.when((i == F.size(labels) - 1) & contains_any(F.lower(x), TOTAL_WORDS), "total").otherwise("relative"))


def bar_texts(values: Column, kinds: Column) -> Column:
    """Labels of a waterfall's bars, with a sign unless they are totals."""
    return F.zip_with(values, kinds, lambda v, m: F.when(m == "relative", F.format_string("%+.1f", v)).otherwise(F.format_string("%.1f", v)))


def route(spec: Column) -> Column:
    """The figure of a specification as a struct, or null if it can't be drawn."""
    t, one, many = kind(spec), single(spec), multi(spec)
    values = one["values"]
    common = (F.coalesce(spec["title"], F.lit("")).alias("title"), F.coalesce(spec["unit"], F.lit("")).alias("unit"), F.lit(WIDTH).alias("width"))
    height = F.coalesce(*(F.when(t == k, F.lit(h)) for k, h in HEIGHTS.items()))
    figure = F.struct(
        t.alias("kind"), *common, height.alias("height"), one["labels"].alias("labels"), values.alias("values"),
        F.when(t == "bar", bar_colours(values)).alias("colours"), F.when(t == "bar", F.exists(values, lambda v: v < 0)).otherwise(t == "waterfall").alias("zero_line"),
        F.when(t == "waterfall", measures(one["labels"])).alias("measures"), F.when(t == "waterfall", bar_texts(values, measures(one["labels"]))).alias("texts"),
        F.when(t == "pie", F.lit(HOLE)).alias("hole"), F.when(t == "multiline", many).alias("traces"),
    )
    return F.when(F.when(t == "multiline", many.isNotNull()).otherwise(one.isNotNull()) & t.isNotNull(), figure)


def within_budget(sections: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Of each document's sections with a chart that can be drawn, the first ones."""
    ranked = sections.where("figure is not null").withColumn("chart_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no")))
    return ranked.where(F.col("chart_no") <= budget)
