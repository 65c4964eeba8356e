"""Sections, tables and chunks of document text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.text import contains_any, is_blank, splitlines, strip
from inkstone.operators.enrich import doc_year, metrics, section_type
from inkstone.runtime import materialize

SIZE, OVERLAP, LEAST = 700, 200, 50
TABLE_SHARE = 0.5
_BLOCK = 4096
#: Words of sections that are left out.
SKIP = ("compliance", "면책", "투자등급", "산업 투자의견", "조사분석자료", "본 자료는", "보도출처")


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_no, title, body): text cut before headings of level one to three.

    The text before the first heading has the title ""; sections without body
    are left out.  A document that has no section with a heading left is cut at
    blank lines instead.  Null texts give no rows.
    """
    title = lambda x: F.regexp_extract(x, r"^#{1,3} (.+)", 0)
    part = lambda x: F.struct(F.regexp_replace(strip(title(x)), r"^#{1,3} ", "").alias("title"), strip(F.regexp_replace(x, r"^#{1,3} .+", "")).alias("body"), (title(x) != "").alias("headed"))
    cut = docs.where("text is not null").select("doc_id", "text", F.filter(F.transform(F.split("text", r"(?md)(?=^#{1,3} .+$)", -1), part), lambda p: p["body"] != "").alias("parts"))
    bare = F.transform(F.filter(F.transform(F.split("text", "\n\n", -1), strip), lambda x: x != ""), lambda x: F.struct(F.lit("").alias("title"), x.alias("body"), F.lit(False).alias("headed")))
    # all of a document's sections stand in its row, so they are numbered there
    return cut.select("doc_id", F.posexplode(F.when(F.exists("parts", lambda p: p["headed"]), F.col("parts")).otherwise(bare)).alias("section_no", "p")).select("doc_id", "section_no", "p.title", "p.body")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, para_no, text): the text between blank lines, blank parts left out."""
    cut = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n\n", -1)).alias("para_no", "text"))
    return cut.withColumn("text", strip(F.col("text"))).where("text <> ''")


def windows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, window_no, text): windows of fixed size and stride over the whole text."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - F.lit(overlap) - 1, F.lit(0)), F.lit(size - overlap))
    return docs.where("text is not null and text <> ''").select("doc_id", "text", F.posexplode(starts).alias("window_no", "at")).select("doc_id", "window_no", F.expr(f"substring(text, at + 1, {size})").alias("text"))


def is_skipped(title: Column, body: Column) -> Column:
    """Whether a section's title or first line has one of the words of sections to leave out."""
    first = F.coalesce(F.try_element_at(splitlines(body), F.lit(1)), F.lit(""))
    return contains_any(F.lower(F.concat_ws(" ", title, first)), SKIP)


def is_table(text: Column) -> Column:
    """Whether at least half of the lines that are not blank begin or end with a bar."""
    lines = F.filter(F.transform(splitlines(text), strip), lambda x: x != "")
    bars = F.filter(lines, lambda x: F.startswith(x, F.lit("|")) | F.endswith(x, F.lit("|")))
    return F.when(F.size(lines) > 0, F.size(bars) / F.size(lines) >= TABLE_SHARE).otherwise(False)


def table_key(text: Column) -> Column:
    """First line without bars and spaces, sixty characters of it."""
    return F.substring(F.regexp_replace(F.coalesce(F.try_element_at(splitlines(strip(text)), F.lit(1)), F.lit("")), r"[|\t-\r\x1c-\x20\x85\p{Z}]", ""), 1, 60)


_ATOM = re.compile(r"(?<=\n)|(?<=[.?!。][ \t\n\x0b\f\r])")
_BREAK = re.compile(r"[ \t\n\x0b\f\r.](.*)", re.DOTALL)


def pieces(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most ``size`` characters, each with the end of the last one in front where that fits, by one walk over lines and sentences."""
    out: list[str] = []
    held: list[str] = []  # of the open piece
    length = 0
    for atom in (a[i:i + size] for a in _ATOM.split(text) for i in range(0, len(a), size)):
        if held and length + len(atom) > size or len(atom) > size:
            done = "".join(held)
            out.append(done)
            rest = _BREAK.search(done[-overlap:]) if overlap and len(atom) + overlap <= size else None
            held, length = ([rest[1]], len(rest[1])) if rest else ([], 0)
        held.append(atom)
        length += len(atom)
    out.append("".join(held))
    return [x for x in map(str.strip, out) if x]


def split_recursive(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Pieces of at most ``size`` characters, cut at the last blank line, line end, sentence end or space that fits.

    Pieces begin at most ``overlap`` before the last one's end.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pieces(t, size, overlap), na_action="ignore")

    return cut(text)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with number: from 0 in each document in the given order, whose first column is a whole number.

    A number is a place in a block of ``_BLOCK`` values of that column plus the
    sizes of earlier blocks, so no task holds a whole document.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(order[0]) / _BLOCK))
    sizes = blocked.groupBy("doc_id", "_block").agg(F.count("*").alias("_n"))
    before = sizes.select("doc_id", "_block", (F.sum("_n").over(Window.partitionBy("doc_id").orderBy("_block")) - F.col("_n")).alias("_before"))
    placed = blocked.withColumn("_at", F.row_number().over(Window.partitionBy("doc_id", "_block").orderBy(*order)) - 1)
    return placed.join(before, ["doc_id", "_block"]).withColumn("number", (F.col("_at") + F.col("_before")).cast("int")).drop("_block", "_at", "_before")


def first_tables(tables: DataFrame, order: str) -> DataFrame:
    """Of the ``tables`` of a document with one ``key`` the first by ``order``; combined before any shuffle."""
    rest = [c for c in tables.columns if c not in ("doc_id", "key", order)]
    return tables.groupBy("doc_id", "key").agg(F.min(F.struct(order, *rest)).alias("_t")).select("doc_id", "key", "_t.*")


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Chunks of documents with derived metadata, numbered from 0 in each document.

    Sections to leave out go first.  Tables stay whole, and of tables with one
    key in a document only the first counts; other sections within the size are
    one chunk, larger ones are cut.  Chunks below the least size are dropped.
    """
    sec = sections(docs).where(~is_skipped(F.col("title"), F.col("body")))
    sec = sec.withColumn("full", strip(F.concat_ws("\n\n", F.nullif("title", F.lit("")), "body"))).withColumn("table", is_table(F.col("body")))
    sec = materialize(sec, "chunk-sections")  # read for tables and for text
    tables = first_tables(sec.where("table").select("doc_id", "section_no", table_key(F.col("full")).alias("key"), "title", "full"), "section_no")
    whole = tables.select("doc_id", "section_no", F.lit(0).alias("sub_no"), "title", F.col("full").alias("text"), F.lit("table").alias("chunk_type"))
    plain = sec.where("not table")
    rest = plain.where(F.length("full") <= size).withColumn("parts", F.array("full")).unionByName(plain.where(F.length("full") > size).withColumn("parts", split_recursive(F.col("full"), size, overlap)))
    cut = rest.select("doc_id", "section_no", F.posexplode("parts").alias("sub_no", "text"), "title").select("doc_id", "section_no", "sub_no", "title", "text", F.lit("text").alias("chunk_type"))
    kept = whole.unionByName(cut).where(F.length(strip(F.col("text"))) >= least)
    return numbered(kept, "section_no", "sub_no").select(
        "doc_id", F.col("title").alias("section"), F.lit(None).cast("int").alias("page"), F.col("number").alias("chunk_index"), "text", "chunk_type",
        doc_year(F.col("title"), F.col("text")).alias("doc_year"), section_type(F.col("title"), F.col("text")).alias("section_type"), metrics(F.col("text")).alias("metrics"),
    )


def semantic_groups(sentences: DataFrame, percentile: float = 0.85) -> DataFrame:
    """(doc_id, section_no, group_no, text) from sentences with vectors, cut where the next is farther than usual.

    ``sentences`` has doc_id, section_no, sent_no, text, vector.  The distance to
    the previous sentence is held against the section's percentile; sections of
    fewer than three sentences give no rows.
    """
    of = Window.partitionBy("doc_id", "section_no")
    seq = of.orderBy("sent_no")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    v, u = F.col("vector"), F.lag("vector").over(seq)
    dist = 1 - dot(v, u) / F.sqrt(dot(v, v) * dot(u, u))
    marked = sentences.withColumn("n", F.count("*").over(of)).where("n >= 3").withColumn("dist", dist)
    cut = marked.withColumn("edge", F.percentile("dist", F.lit(percentile)).over(of)).withColumn("group_no", F.sum(F.when(F.col("dist") > F.col("edge"), 1).otherwise(0)).over(seq).cast("int"))
    return cut.groupBy("doc_id", "section_no", "group_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_no", "text"))), lambda x: x["text"]), " ").alias("text"))


def non_blank(chunks_: DataFrame) -> DataFrame:
    """Rows whose text is not blank."""
    return chunks_.where(~is_blank(F.col("text")))
