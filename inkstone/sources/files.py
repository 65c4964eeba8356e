"""Document files as tables: routing, parsing, metadata, text recognition with a cache.

Files come from Spark's ``binaryFile`` source.  Parsers that need no library run
here; those that do (PDF, HWP, text recognition) are functions that a caller
plugs in, from bytes to pages.  Failures are data: a row has ``status`` and
``error_class`` beside its text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.text import is_blank, strip, tokens
from inkstone.operators.clean import PICTURE

FORMATS = ("pdf", "docx", "doc", "hwp", "hwpx")
IMAGE_BASED = 500
OMITTED = "intentionally omitted"
PagesOf = Callable[[bytes], list[str]]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

#: Frequent short words by which a language is told.
LANGUAGE_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "with", "each", "this", "one"),
    "fr": ("le", "la", "les", "des", "et", "une", "du", "est", "dans", "sous", "par"),
    "de": ("der", "die", "das", "und", "ein", "eine", "ist", "am", "im", "auf", "von"),
    "es": ("el", "los", "las", "y", "un", "del", "con", "que", "por", "bajo", "una"),
}


class ParseError(Exception):
    """A document that can't be read."""


class FileNotSupportedError(ParseError):
    """Of a format that has no parser."""


class FileCorruptedError(ParseError):
    """Of a known format, but damaged or without bytes."""


class EmptyDocumentError(ParseError):
    """Read, but without any text."""


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of all files below a folder.

    Spark's reader skips files without bytes; as rows, they count as corrupted.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def extension(path: Column) -> Column:
    """Lower-case suffix of a path without the dot."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def source_class(path: Column) -> Column:
    """Profile of cleaning for a path: ir_report, pdf, docx, hwp or generic."""
    stem = F.lower(F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1))
    report = stem.rlike("실적|분기|연간|ir")
    ext = extension(path)
    return F.when((ext == "pdf") & report, "ir_report").when(ext == "pdf", "pdf").when(ext.isin("docx", "doc"), "docx").when(ext == "hwp", "hwp").otherwise("generic")


def content_hash(content: Column) -> Column:
    """Key of a file's content in caches."""
    return F.substring(F.sha2(content, 256), 1, 16)


def page_key(content: Column, index: Column) -> Column:
    """Key of one page in caches."""
    return F.concat(content_hash(content), F.lit("_p"), index.cast("string"))


def is_image_based(pages: DataFrame) -> DataFrame:
    """(doc_id, is_image_based): whether the mean page has fewer than 500 characters; pages are doc_id, text."""
    return pages.groupBy("doc_id").agg((F.avg(F.length(strip(F.coalesce("text", F.lit(""))))) < IMAGE_BASED).alias("is_image_based"))


def has_omitted_images(text: Column) -> Column:
    """Whether a text marks pictures that were left out."""
    return F.coalesce(F.contains(text, F.lit(OMITTED)), F.lit(False))


def supplement(text: Column, tables: Column, recognised: Column) -> Column:
    """A page with its marks of omitted pictures replaced by tables, else by recognised text, else left."""
    by = F.coalesce(F.nullif(tables, F.lit("")), F.nullif(recognised, F.lit("")))
    marked = F.regexp_replace(text, PICTURE, "\x01")
    return F.when(by.isNotNull(), F.replace(marked, F.lit("\x01"), by)).otherwise(text)


def merge_pages(converted: DataFrame, plain: DataFrame, recognised: DataFrame) -> DataFrame:
    """(doc_id, text) from three readings of pages: the first that isn't blank counts, pages joined by blank lines.

    Each has doc_id, page_no, text.  Documents whose pages are all blank have no row.
    """
    every = converted.select("doc_id", "page_no", F.lit(0).alias("r"), "text").unionByName(plain.select("doc_id", "page_no", F.lit(1).alias("r"), "text")).unionByName(recognised.select("doc_id", "page_no", F.lit(2).alias("r"), "text"))
    best = every.where(~is_blank(F.col("text"))).groupBy("doc_id", "page_no").agg(F.min(F.struct("r", "text"))["text"].alias("text"))
    return best.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def table_markdown(rows: Column) -> Column:
    """A table of rows of cells as Markdown; empty for no rows."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(F.trim(F.replace(c, F.lit("\n"), F.lit(" "))), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(rows[0])))
    body = F.array_join(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line), "\n")
    return F.when(F.size(rows) > 0, F.concat_ws("\n", line(rows[0]), rule, F.nullif(body, F.lit("")))).otherwise("")


def docx_text(content: bytes) -> str:
    """Text of a DOCX file: paragraphs with heading marks, then all tables."""
    if not content:
        raise FileCorruptedError("no bytes")
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise FileCorruptedError(str(e)) from e
    runs = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out = []
    for p in body.findall(f"{_W}p"):
        text = runs(p).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.fullmatch(r"[Hh]eading\s*([123])", style.get(f"{_W}val", "")) if style is not None else None
        if text:
            out.append("#" * int(level[1]) + " " + text if level else text)
    for table in body.findall(f"{_W}tbl"):
        rows = [" | ".join(runs(c).strip() for c in r.findall(f"{_W}tc")) for r in table.findall(f"{_W}tr")]
        out.append("\n".join(r for r in rows if r.strip(" |")))
    text = "\n".join(x for x in out if x)
    if not text.strip():
        raise EmptyDocumentError("no text")
    return text


def parse(documents: DataFrame, parsers: dict[str, PagesOf] | None = None) -> DataFrame:
    """(path, page_no, text, status, error_class, error) of files, one row per page or failure.

    ``parsers`` maps formats to functions from bytes to pages; DOCX is built in.
    Formats without a parser, and unknown ones, give a row with an error.
    """
    known = {"docx": lambda b: [docx_text(b)], **(parsers or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
                try:
                    if ext not in known:
                        raise FileNotSupportedError(ext)
                    if not content:
                        raise FileCorruptedError("no bytes")
                    pages = known[ext](bytes(content))
                    if not any(p.strip() for p in pages):
                        raise EmptyDocumentError("no text")
                    rows += [(path, i, p, "ok", None, None) for i, p in enumerate(pages)]
                except ParseError as e:
                    rows.append((path, None, None, "error", type(e).__name__, str(e)))
                except Exception as e:  # noqa: BLE001 - a parser's failure is this document's
                    rows.append((path, None, None, "error", "ParseError", str(e)))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "status", "error_class", "error"]).astype({"page_no": "Int32"})

    return documents.select("path", "content").mapInPandas(run, "path string, page_no int, text string, status string, error_class string, error string")


def recognise(documents: DataFrame, cache: DataFrame, reader: PagesOf) -> tuple[DataFrame, DataFrame]:
    """(all pages, new pages) of text recognition: files whose content the cache has are not read again.

    ``cache`` has content_hash, page_index, text; the new pages are to be appended to it.
    """
    keyed = documents.withColumn("content_hash", content_hash(F.col("content")))
    missing = keyed.dropDuplicates(["content_hash"]).join(cache, "content_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(h, i, t) for h, c in zip(batch["content_hash"], batch["content"], strict=True) for i, t in enumerate(reader(bytes(c)))], columns=["content_hash", "page_index", "text"]).astype({"page_index": "int32"})

    new = missing.select("content_hash", "content").mapInPandas(run, "content_hash string, page_index int, text string")
    pages = keyed.select("path", "content_hash").join(cache.select("content_hash", "page_index", "text").unionByName(new), "content_hash")
    return pages, new


def pdf_date(text: Column) -> Column:
    """Time of a PDF's date of creation, null if it can't be read."""
    return F.try_to_timestamp(F.substring(F.regexp_extract(text, r"^D:(\d{14})", 1), 1, 14), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def _among(listed: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda w: w.isin(*listed)


def language(text: Column) -> Column:
    """Code of a text's language by script and frequent words, null if it can't be told."""
    hangul = F.length(F.regexp_replace(text, "[^가-힣]", ""))
    words = F.transform(tokens(text), lambda w: F.lower(w))
    votes = F.array(*(F.struct(F.size(F.filter(words, _among(v))).alias("n"), F.lit(k).alias("k")) for k, v in LANGUAGE_WORDS.items()))
    best = F.array_max(votes)
    return F.when(hangul >= 2, "ko").when(best["n"] > 0, best["k"])


def metadata(documents: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """(filename, file_format, file_size_bytes, page_count, language, created_at) of files.

    ``details`` has path, page_count, language, created_at where a format's
    reader gave them; without, or where it failed, those three are null.
    """
    base = documents.select("path", F.regexp_extract("path", r"([^/\\]+)$", 1).alias("filename"), extension(F.col("path")).alias("file_format"), F.col("length").alias("file_size_bytes"))
    if details is None:
        return base.select("filename", "file_format", "file_size_bytes", F.lit(None).cast("int").alias("page_count"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    return base.join(details, "path", "left").select("filename", "file_format", "file_size_bytes", "page_count", F.split("language", "-")[0].alias("language"), "created_at")


def write_runs(runs: DataFrame, path: str) -> None:
    """Results of runs as JSON, without the long texts."""
    runs.drop("chunks", "text", "clean_text").write.mode("append").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of all result files with the name of their file."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def create_session_tables(spark: SparkSession, database: str = "default") -> None:
    """The five tables of chat sessions, where they don't exist yet."""
    texts = lambda names: ", ".join(f"{n} STRING" for n in names.split())
    for name, columns in {
        "users": texts("id identifier metadata createdAt"),
        "threads": texts("id createdAt name userId userIdentifier tags metadata"),
        "steps": texts("id name type threadId parentId") + ", streaming INT, waitForAnswer INT, isError INT, " + texts("metadata tags input output createdAt start_at end_at generation showInput language") + ", indent INT, defaultOpen INT, autoCollapse INT",
        "elements": texts("id threadId type url chainlitKey name display objectKey size language forId mime props") + ", page INT",
        "feedbacks": texts("id forId threadId") + ", value INT, comment STRING",
    }.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
