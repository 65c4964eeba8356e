"""Lines that one source repeats across its documents.

Every line is reduced to a key: its letters in lower case and usual width.  For
each source the documents that hold a line are kept as a compressed bitmap for
each written variant of the line: words of 64 documents, of which only those
with a document in them are stored, one to a row.  The variants' bitmaps are
united by key, the exact cardinality of the union is held against the source's
number of documents, and a line is deleted if its key's bitmap has its document.

Lines and keys are held as 64-bit hashes.  Most keys are unique, and a bitmap for
each would be waste.  So a first pass counts occurrences.  A count of occurrences
is never below the count of documents, hence no line that could pass is lost; the
keys left (at most ``1 / share`` times the lines of a mean document, whatever the
size of the corpus) get bitmaps and the exact test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.runtime import materialize

MIN_LETTERS = 8
MIN_DOCS = 3
SHARE = 0.25

_WIDE = "".join(chr(c) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
_USUAL = "".join(chr(c - 0xFEE0) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
#: Documents are numbered within hash groups of about this size, so no single task numbers all of them.
_GROUP_DOCS = 16_384
#: Sources that are written into an expression, and the greatest length of the substrings by which more are looked up.
_MAX_INLINE_SOURCES, _ANCHOR = 500, 8
#: Documents to a word of a bitmap.
_WORD = 64


def letters(text: Column) -> Column:
    """Keys of the lines of a text, line by line: letters only, lower case, usual width."""
    usual = F.when(text.rlike("[\uFF21-\uFF3A\uFF41-\uFF5A]"), F.translate(text, _WIDE, _USUAL)).otherwise(text)
    return F.regexp_replace(F.lower(usual), r"[^\p{L}\n]+", "")


def line_hashes(text: Column) -> Column:
    """Hashes of the keys of a text's lines in order; null for lines that are too short to count."""
    return F.transform(F.split(letters(text), "\n"), lambda k: F.when(F.length(k) >= MIN_LETTERS, F.xxhash64(k)))


def _file_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[-_\s]+", "-")


def _tags(issuers: DataFrame) -> DataFrame:
    return issuers.where("filename_tag is not null and issuer_code is not null").select("issuer_code", _file_key(F.col("filename_tag")).alias("_tag")).where("_tag <> ''").distinct()


def with_source(rows: DataFrame, issuers: DataFrame) -> DataFrame:
    """``rows`` with the column issuer: the code of the source whose tag stands in doc_id; null if there is none.

    Case does not matter and hyphen, space and underscore are alike.  If several
    tags fit, the longest counts, then the first by code.  Up to
    ``_MAX_INLINE_SOURCES`` rows of the table of sources become branches of one
    expression.  Beyond, each document name is matched once by its substrings of
    the length of the shortest tags, and the names are joined back.
    """
    tags = _tags(issuers)
    few = tags.limit(_MAX_INLINE_SOURCES + 1).collect()
    name = _file_key(F.col("doc_id"))
    if len(few) <= _MAX_INLINE_SOURCES:
        out = F.lit(None).cast("string")
        for r in sorted(few, key=lambda r: (-len(r[1]), str(r[0])), reverse=True):
            out = F.when(F.contains(name, F.lit(r[1])), F.lit(r[0])).otherwise(out)
        return rows.withColumn("issuer", out)
    width = min(_ANCHOR, tags.agg(F.min(F.length("_tag"))).first()[0])
    anchored = tags.withColumn("_a", F.left("_tag", F.lit(width)))
    names = rows.where("doc_id is not null").select("doc_id").distinct().withColumn("_name", name)
    starts = F.sequence(F.lit(1), F.greatest(F.length("_name") - width + 1, F.lit(1)))
    spread = names.select("doc_id", "_name", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("_name", i, F.lit(width))))).alias("_a"))
    fit = spread.join(anchored, "_a").where(F.contains("_name", F.col("_tag")))
    best = fit.groupBy("doc_id").agg(F.min(F.struct((-F.length("_tag")).alias("n"), "issuer_code"))["issuer_code"].alias("issuer"))
    return rows.join(materialize(best, "document-sources"), "doc_id", "left")


def hashed_lines(chunks: DataFrame, issuers: DataFrame) -> DataFrame:
    """(issuer, doc_id, chunk_index, line_no, h, v) of all lines that count, written once.

    h and v are hashes of key and line; the issuer is null where there is none.
    """
    rows = with_source(chunks.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "chunk_index", "text"), issuers)
    pairs = F.arrays_zip(line_hashes(F.col("text")).alias("h"), F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x)).alias("v"))
    lines = rows.select("issuer", "doc_id", "chunk_index", F.posexplode(pairs).alias("line_no", "p")).where("p.h is not null")
    return materialize(lines.select("issuer", "doc_id", "chunk_index", "line_no", "p.h", "p.v"), "source-line-hashes")


def _docs(chunks: DataFrame, issuers: DataFrame) -> DataFrame:
    return with_source(chunks.where("doc_id is not null").select("doc_id").distinct(), issuers).select("issuer", "doc_id")


def repeated_lines(chunks: DataFrame, issuers: DataFrame, share: float = SHARE, min_docs: int = MIN_DOCS, lines: DataFrame | None = None, docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, keys) of the lines repeated excessively within their source.

    ``lines`` has issuer, doc_id, chunk_index, line_no once per line to remove;
    ``keys`` has issuer, h, n_docs, total_docs once per repeated key.
    A line is repeated if it stands in at least ``share`` of the source's documents
    and in at least ``min_docs``.  Null texts have no lines, documents without a
    source are left alone, repeated rows count once, a table without rows gives
    no rows.  Extra columns of the input are ignored.  Callers that have the
    hashed lines and the documents (issuer, doc_id) already pass them.
    """
    docs = _docs(chunks, issuers) if docs is None else docs
    total = materialize(docs.where("issuer is not null").groupBy("issuer").agg(F.count("*").alias("total_docs")), "source-sizes")  # one row per source
    lines = (hashed_lines(chunks, issuers) if lines is None else lines).where("issuer is not null").select("issuer", "doc_id", "chunk_index", "line_no", "h", "v")
    enough = lambda n: (F.col(n) >= min_docs) & (F.col(n) >= F.col("total_docs") * F.lit(share))
    maybe = lines.groupBy("issuer", "h").agg(F.count("*").alias("n")).join(total, "issuer").where(enough("n")).select("issuer", "h")
    maybe = materialize(maybe, "source-line-candidates")
    # At most 1/share times the mean number of lines of a document, for each source; the row count decides all the same.
    small = maybe.count() <= 200_000
    hits = lines.join(F.broadcast(maybe) if small else maybe, ["issuer", "h"])
    hits = materialize(hits, "source-line-hits")
    groups = 1 + int(total.agg(F.coalesce(F.sum("total_docs"), F.lit(0))).first()[0]) // _GROUP_DOCS
    numbered = _number(hits.select("doc_id").distinct().withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")))
    placed = hits.join(numbered, "doc_id").select("issuer", "doc_id", "chunk_index", "line_no", "h", "v", "g", F.floor(F.col("num") / _WORD).cast("int").alias("word"), (F.col("num") % _WORD).cast("int").alias("bit"))
    placed = materialize(placed, "source-line-places")
    per_variant = placed.groupBy("issuer", "h", "v", "g", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    per_key = materialize(per_variant.groupBy("issuer", "h", "g", "word").agg(F.bit_or("bits").alias("bits")), "source-line-bitmaps")
    keys = per_key.groupBy("issuer", "h").agg(F.sum(F.bit_count("bits")).alias("n_docs")).join(total, "issuer").where(enough("n_docs"))
    keys = materialize(keys, "source-lines")
    kept = keys.select("issuer", "h")
    gone = per_key.join(F.broadcast(kept) if small else kept, ["issuer", "h"], "left_semi")
    looked = placed.join(gone, ["issuer", "h", "g", "word"]).where(F.expr("shiftrightunsigned(bits, bit) & 1L = 1L"))
    return looked.select("issuer", "doc_id", "chunk_index", "line_no").distinct(), keys


def _number(docs: DataFrame) -> DataFrame:
    """Number the documents of each hash group from 1, for bit positions."""
    return docs.select("doc_id", "g", F.row_number().over(Window.partitionBy("g").orderBy("doc_id")).cast("bigint").alias("num"))


def without_source_lines(chunks: DataFrame, issuers: DataFrame) -> DataFrame:
    """``chunks`` with every text rid of its source's repeated lines.

    One row of doc_id, chunk_index and text per key, the first by text where
    repeated rows differ; only its lines count.  Texts that lose all lines become
    empty, null texts stay null.  Rows without a key are left out.
    """
    first = chunks.where("doc_id is not null and chunk_index is not null").groupBy("doc_id", "chunk_index").agg(F.min(F.struct("text"))["text"].alias("text"))
    lines, _ = repeated_lines(first, issuers)
    gone = lines.groupBy("doc_id", "chunk_index").agg(F.collect_set("line_no").alias("_gone"))  # bounded by the lines of one text
    kept = first.join(gone, ["doc_id", "chunk_index"], "left")
    split = F.split("text", "\n")
    rest = F.array_join(F.filter(split, lambda line, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    return kept.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(rest)).drop("_gone")
