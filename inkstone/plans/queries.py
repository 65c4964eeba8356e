"""Queries over the data tables by the operators of the engine.

Each takes a session and a data folder and reads its tables whole.  Where the
tables have no such data, a query runs on literal rows that it shares with its
SQL (``fixtures``), or on columns that stand in for others, as its text says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.text import is_blank, strip
from inkstone.operators import answer, chart, chunk, clean, enrich, evaluate, metrics, retrieve, units
from inkstone.plans import fixtures
from inkstone.runtime import fit_parallelism, materialize, table
from inkstone.sources import files
from inkstone.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_parallelism(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk once."""
    keys = table(spark, sf_dir, "chunks").where("doc_id is not null and chunk_index is not null")
    return keys.groupBy("doc_id", "chunk_index").agg(F.min(F.struct("text", "section")).alias("r")).select("doc_id", "chunk_index", "r.section", "r.text")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's summary once."""
    rows = table(spark, sf_dir, "section_summaries").where("doc_id is not null and section_no is not null")
    return rows.groupBy("doc_id", "section_no").agg(F.min(F.struct("section", "bullets", "chart_spec")).alias("r")).select("doc_id", "section_no", "r.section", "r.bullets", "r.chart_spec")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their questions, in place of predictions and references."""
    rows = table(spark, sf_dir, "steps").where("type = 'llm' and id is not null")
    return rows.groupBy("id").agg(F.min(F.struct("output", "input")).alias("r")).select("id", F.col("r.output").alias("prediction"), F.col("r.input").alias("reference"))


def _fixture(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(fixtures.for_spark(name))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best chunks of its document for every section's first bullet."""
    return bm25_topk(spark, sf_dir)


# --- units -------------------------------------------------------------------


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.harmonized(table(spark, sf_dir, "section_summaries"), table(spark, sf_dir, "common_units"))


# --- sources and metadata ------------------------------------------------------


@query
def image_based_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), "text")
    return files.is_image_based(pages).select(F.col("doc_id").alias("source"), "is_image_based")


@query
def blank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", is_blank(F.col("text")).alias("blank"), files.has_omitted_images(F.col("text")).alias("omitted"))


@query
def source_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "doc_metadata").select("filename").distinct()
    return names.select("filename", files.extension(F.col("filename")).alias("ext"), files.source_class(F.col("filename")).alias("source"))


@query
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("text").cast("binary")
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", files.content_hash(content).alias("content_hash"), files.page_key(content, F.lit(0)).alias("page_key"))


@query
def recognition_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of which a cache, here that of the sources named en, has no pages yet."""
    keyed = table(spark, sf_dir, "documents").where("text is not null").select("lang", files.content_hash(F.col("text").cast("binary")).alias("content_hash"))
    cache = keyed.where("lang = 'en'").select("content_hash").distinct()
    return keyed.select("content_hash").distinct().join(cache, "content_hash", "left_anti")


@query
def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _fixture(spark, "pages")
    return files.merge_pages(*(pages.where(F.col("reading") == r).select("doc_id", "page_no", "text") for r in (0, 1, 2)))


@query
def supplemented_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, "omitted").select("id", files.supplement(F.col("text"), F.col("tables"), F.col("recognised")).alias("text"))


@query
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and values of every chart with both as a table."""
    spec = F.col("chart_spec")
    rows = _sections(spark, sf_dir).where("chart_spec.labels is not null and chart_spec.values is not null")
    return rows.select("doc_id", "section_no", files.table_markdown(F.array(spec["labels"], spec["values"])).alias("markdown"))


@query
def tags_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, "markup").select("id", clean.tags_to_text(F.col("text")).alias("text"))


@query
def pdf_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, "dates").select("id", files.pdf_date(F.col("text")).alias("created_at"))


@query
def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", files.language(F.col("text")).alias("language"))


@query
def metadata_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, bytes and pages by format, each file once with its largest size."""
    one = table(spark, sf_dir, "doc_metadata").where("filename is not null").groupBy("filename").agg(F.max(F.struct("file_size_bytes", "page_count", "file_format")).alias("m"))
    return one.groupBy(F.lower("m.file_format").alias("file_format")).agg(F.count("*").alias("files"), F.sum("m.file_size_bytes").alias("bytes"), F.sum("m.page_count").alias("pages"))


# --- cleaning ------------------------------------------------------------------


@query
def repeated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.repeated_titles(_docs(spark, sf_dir))


@query
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.repeated_lines(_docs(spark, sf_dir))


@query
def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.consecutive_lines(_docs(spark, sf_dir))


@query
def footnote_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.footnotes(_fixture(spark, "notes"))


@query
def br_table_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.table_rows(_fixture(spark, "tables"))


@query
def br_table_dedup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the chunks, whose texts have tables; those with nothing to split or replace stay as they are."""
    rows = _chunks(spark, sf_dir).select(F.struct("doc_id", "chunk_index").alias("doc_id"), "text")
    split = F.coalesce(F.contains("text", F.lit("\n|")) | F.contains("text", F.lit("<br")), F.lit(False))
    return clean.table_rows(rows.where(split)).unionByName(rows.where(~split)).select("doc_id.doc_id", "doc_id.chunk_index", "text")


@query
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the chunks, whose texts have lines of page numbers."""
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", clean.page_numbers(F.col("text")).alias("text"))


@query
def empty_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", clean.empty_bullets(F.col("text")).alias("text"))


@query
def normalize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", clean.whitespace(F.col("text")).alias("text"))


@query
def css_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, "markup").select("id", clean.css_blocks(F.col("text")).alias("text"))


@query
def picture_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, "omitted").select("id", clean.picture_text(clean.picture_tags(F.col("text"))).alias("text"))


def _clean(source: str) -> Query:
    return lambda spark, sf_dir: clean.clean(_docs(spark, sf_dir), source)


for _source in ("generic", "pdf", "docx"):
    _QUERIES[f"clean_{_source}"] = _clean(_source)


# --- chunking and enrichment ---------------------------------------------------


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their section commands as headings."""
    return _docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"\\(?:sub)?section\*?\{([^{}]*)\}", "\n## $1\n").alias("text"))


@query
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.sections(_marked(spark, sf_dir))


@query
def skipped_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).where("text is not null")
    return rows.where(chunk.is_skipped(F.coalesce("section", F.lit("")), F.col("text"))).select("doc_id", "chunk_index")


@query
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.paragraphs(_docs(spark, sf_dir))


@query
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.windows(_docs(spark, sf_dir))


@query
def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).where("text is not null")
    return rows.select("doc_id", "chunk_index", chunk.is_table(F.col("text")).alias("is_table"))


@query
def table_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the tables of a document with one key the first."""
    rows = _chunks(spark, sf_dir).where("text is not null").where(chunk.is_table(F.col("text")))
    return chunk.first_tables(rows.select("doc_id", "chunk_index", chunk.table_key(F.col("text")).alias("key")), "chunk_index").select("doc_id", "chunk_index", "key")


@query
def numbered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at least the least size, numbered anew."""
    kept = _chunks(spark, sf_dir).where(F.length(strip(F.col("text"))) >= chunk.LEAST)
    return chunk.numbered(kept.select("doc_id", "chunk_index"), "chunk_index").select("doc_id", F.col("chunk_index").alias("source_index"), F.col("number").alias("chunk_index"))


@query
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunks(_marked(spark, sf_dir)).drop("metrics")


@query
def doc_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", enrich.doc_year(F.col("section"), F.col("text")).alias("doc_year"))


@query
def section_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", enrich.section_type(F.col("section"), F.col("text")).alias("section_type"))


@query
def metric_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).where("text is not null").select("doc_id", "chunk_index", enrich.metrics(F.col("text")).alias("metrics"))


# --- retrieval -----------------------------------------------------------------


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select(F.col("doc_id").alias("scope"), F.col("chunk_index").alias("item"), "text")


def _asked(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Every section of a document asks it something."""
    return _sections(spark, sf_dir).select(F.struct("doc_id", "section_no").alias("query"), F.col("doc_id").alias("scope"), F.expr(text).alias("text"))


_BULLET, _TITLE = "bullets[0]", "chart_spec.title"


def _hits(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    return retrieve.bm25(corpus, _asked(spark, sf_dir, text)).join(corpus, ["scope", "item"])


@query
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = retrieve.postings(_corpus(spark, sf_dir))
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieve.bm25(_corpus(spark, sf_dir), _asked(spark, sf_dir, _BULLET))
    return hits.select("query.doc_id", "query.section_no", F.col("item").alias("chunk_index"), F.round("score", 6).alias("score"), "rank")


@query
def bm25_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections found for each chart's title within its document."""
    corpus = _sections(spark, sf_dir).select(F.col("doc_id").alias("scope"), F.col("section_no").alias("item"), F.concat_ws(" ", "section", F.array_join("bullets", " ")).alias("text"))
    hits = retrieve.bm25(corpus, _asked(spark, sf_dir, _TITLE), retrieve.TOP_SECTIONS)
    return hits.select("query.doc_id", "query.section_no", F.col("item").alias("found_no"), F.round("score", 6).alias("score"), "rank")


@query
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of what first bullet and chart title find."""
    corpus = _corpus(spark, sf_dir)
    asked = [_asked(spark, sf_dir, text).withColumn("query", F.struct("query", F.lit(i).alias("_list"))) for i, text in enumerate((_BULLET, _TITLE))]
    hits = retrieve.bm25(corpus, asked[0].unionByName(asked[1])).join(corpus, ["scope", "item"])  # both lists from one set of postings
    fused = retrieve.fused(hits.select(F.col("query.query").alias("query"), "text", "rank", F.col("query._list").alias("_list")))
    return fused.select("query.doc_id", "query.section_no", "text", F.round("score", 9).alias("score"), "rank")


@query
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks found for the first bullet of every section whose number is divisible by 100, by terms and, in PDF files, by vectors too; of others the sparse hits stay."""
    corpus = materialize(_corpus(spark, sf_dir), "hybrid-corpus")
    asked = _asked(spark, sf_dir, _BULLET).where("query.section_no % 100 = 0")
    sparse = retrieve.bm25(corpus, asked).join(corpus, ["scope", "item"])
    pdf = F.lower("scope").rlike(r"\.pdf$")
    index = retrieve.encoded(corpus.where(pdf), retrieve.hashed_terms)
    found = retrieve.dense_within(index, retrieve.encoded(asked.where(pdf), retrieve.hashed_terms, retrieve.QUESTION))
    return retrieve.hybrid(sparse, found.join(corpus, ["scope", "item"])).select("query.doc_id", "query.section_no", "text", F.round("score", 9).alias("score"), "rank")


@query
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best by terms in common with the first bullet."""
    hits = _hits(spark, sf_dir, _BULLET).join(_asked(spark, sf_dir, _BULLET).select("query", F.col("text").alias("question")), "query")
    return retrieve.rerank(hits.select("query", "question", "text", "rank")).select("query.doc_id", "query.section_no", "text", "rank")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    index = rows.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"), "label")
    return index, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"), "label")


@query
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.dense(*_vectors(spark, sf_dir)).select(F.col("query").alias("query_id"), F.col("item").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.dense(*_vectors(spark, sf_dir), must=("label",)).select(F.col("query").alias("query_id"), F.col("item").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query
def collection_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "doc_metadata").select("filename").distinct()
    return names.select("filename", retrieve.collection(F.col("filename")).alias("collection"))


# --- answers and summaries ------------------------------------------------------


@query
def best_bullet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bullet nearest to the title of the section's chart."""
    rows = _sections(spark, sf_dir).where("chart_spec.title is not null and size(bullets) > 0 and not exists(bullets, b -> b is null)")
    return rows.select("doc_id", "section_no", answer.best_bullet(F.col("chart_spec.title"), F.col("bullets")).alias("bullet"))


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document the first three sections and chunks, as the SQL of ``context_build`` has them."""
    secs = _sections(spark, sf_dir).where("section_no < 3 and section is not null and bullets is not null and not exists(bullets, b -> b is null)")
    secs = secs.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section_no", F.struct("section", "bullets").alias("s")))), lambda x: x["s"]).alias("sections"))
    texts = _chunks(spark, sf_dir).where("chunk_index < 3 and text is not null").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]).alias("chunks"))
    return secs.join(texts, "doc_id")


def _questions(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, scope, text): every document asked by its first section's name, without summaries by its first chunk's."""
    named = [
        rows.where(~is_blank(F.col("section"))).select("doc_id", F.struct(F.lit(i).alias("side"), F.col(no).alias("no"), "section").alias("r"))
        for i, (rows, no) in enumerate(((sections, "section_no"), (chunks, "chunk_index")))
    ]
    first = named[0].unionByName(named[1]).groupBy("doc_id").agg(F.min("r").alias("r"))
    return first.select(F.col("doc_id").alias("query"), F.col("doc_id").alias("scope"), F.col("r.section").alias("text"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, question, chunks, sections, overall): what each document's question finds in all of its chunks and sections, best first.

    The tables have no vectors of chunks, and without a dense side the sparse
    hits go to the reranker unfused.  A side that finds nothing is empty;
    ``overall`` is the summary of the whole document.
    """
    rows = materialize(_chunks(spark, sf_dir), "chunks")  # read for questions, postings, hits and summaries
    named = materialize(_sections(spark, sf_dir).select("doc_id", "section_no", "section", F.array_compact(F.coalesce("bullets", F.array().cast("array<string>"))).alias("bullets")), "sections")
    asked = materialize(_questions(named, rows), "questions")
    corpus = rows.select(F.col("doc_id").alias("scope"), F.col("chunk_index").alias("item"), "text")
    hits = retrieve.bm25(corpus, asked).join(corpus, ["scope", "item"]).join(asked.select("query", F.col("text").alias("question")), "query")
    best = retrieve.rerank(hits.select("query", "question", "text", "rank"))
    chunks = best.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("chunks"))
    secs = named.where("section is not null").select(F.col("doc_id").alias("scope"), F.col("section_no").alias("item"), F.struct("section", "bullets").alias("s"))
    found = retrieve.bm25(secs.select("scope", "item", F.concat_ws(" ", "s.section", F.array_join("s.bullets", " ")).alias("text")), asked, retrieve.TOP_SECTIONS).join(secs, ["scope", "item"])
    sections = found.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"]).alias("sections"))
    told = answer.summarise(rows).select(F.col("doc_id").alias("query"), "overall")
    none = lambda kind: F.array().cast(kind)
    return asked.join(chunks, "query", "left").join(sections, "query", "left").join(told, "query", "left").select(
        F.col("query").alias("doc_id"), F.col("text").alias("question"), F.coalesce("chunks", none("array<string>")).alias("chunks"),
        F.coalesce("sections", none("array<struct<section:string,bullets:array<string>>>")).alias("sections"), F.coalesce("overall", F.lit("")).alias("overall"),
    )


@query
def context_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the heads of documents, to be held against SQL; ``retrieved_context`` is of whole ones."""
    return _heads(spark, sf_dir).select("doc_id", answer.context(F.col("chunks"), F.col("sections"), F.lit("")).alias("context"))


@query
def retrieved_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("doc_id", answer.context(F.col("chunks"), F.col("sections"), F.col("overall")).alias("context"))


@query
def source_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunk found stands in for the answer."""
    said = F.coalesce(F.try_element_at("chunks", F.lit(1)), F.lit(""))
    rows = _evidence(spark, sf_dir).withColumn("s", F.explode(answer.sources(said, F.col("sections"), F.col("chunks"))))
    return rows.select("doc_id", "s.section", "s.snippet", "s.full_chunk")


@query
def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document asked its question, answered by extraction."""
    rows = materialize(_evidence(spark, sf_dir).withColumnRenamed("doc_id", "query"), "evidence")  # read by each pass of ``ask``
    return answer.ask(rows).select("query", "answer", "is_answerable")


@query
def unanswerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("id", answer.is_unanswerable(F.col("prediction")).alias("unanswerable"))


@query
def tilde_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, "tildes").select("id", answer.fix_tildes(F.col("text")).alias("text"), answer.without_ocr_noise(F.col("text")).alias("plain"))


@query
def tilde_fix_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the chunks, whose texts have ranges of numbers."""
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", answer.fix_tildes(F.col("text")).alias("text"), answer.without_ocr_noise(F.col("text")).alias("plain"))


@query
def summary_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fixture(spark, "replies").select("id", answer.section_summary(F.col("text")).alias("s"))
    return rows.select("id", F.col("s").isNotNull().alias("read"), "s.section", F.size("s.bullets").alias("bullets"), F.col("s.chart_spec").isNotNull().alias("charted"))


@query
def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, "questions").select("id", F.posexplode(answer.follow_ups(F.col("text"))).alias("at", "question"))


@query
def bullet_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", answer.bullet_budget(F.col("n")).alias("bullets"))


@query
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.summarise(_chunks(spark, sf_dir)).select("doc_id", "n", F.size("sections").alias("sections"), "overall")


@query
def multi_doc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.merge_documents(_fixture(spark, "merge_docs"), _fixture(spark, "merge_groups"))


# --- charts ---------------------------------------------------------------------


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).where("chart_spec is not null").select("doc_id", "section_no", "chart_spec", chart.route(F.col("chart_spec")).alias("figure"))


@query
def chart_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("figure")
    points = F.coalesce(F.size(f["values"]), F.lit(-1))
    return _figures(spark, sf_dir).select("doc_id", "section_no", f["kind"].alias("kind"), F.when(f["kind"] != "multiline", points).alias("points"), F.when(f["kind"] == "multiline", F.size(f["traces"])).alias("traces"), F.when(f.isNotNull(), f["height"]).alias("height"))


@query
def bar_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _figures(spark, sf_dir).where("figure.kind = 'bar'").select("doc_id", "section_no", F.array_join("figure.colours", ",").alias("colours"), "figure.zero_line")


@query
def waterfall_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _figures(spark, sf_dir).where("figure.kind = 'waterfall'")
    return rows.select("doc_id", "section_no", F.array_join("figure.measures", ",").alias("measures"), F.array_join(F.transform("figure.values", lambda v: F.round(v, 6).cast("string")), ",").alias("bars"))


@query
def chart_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a budget of two, to be held against SQL; ``document_charts`` has the operator's own."""
    return chart.within_budget(_figures(spark, sf_dir), 2).select("doc_id", "section_no", "chart_no")


@query
def document_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.within_budget(_figures(spark, sf_dir)).select("doc_id", "section_no", "chart_no")


# --- scores and reports ----------------------------------------------------------


@query
def numbers_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sections(spark, sf_dir).select("doc_id", "section_no", F.posexplode("bullets").alias("pos", "bullet")).where("bullet is not null")
    return rows.select("doc_id", "section_no", "pos", F.array_join(metrics.numbers(F.col("bullet")), "|").alias("numbers"))


@query
def numerical_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.number_match(F.col("prediction"), F.col("reference"))
    return _pairs(spark, sf_dir).where("prediction is not null and reference is not null").select("id", m["accuracy"].alias("accuracy"), F.array_join(m["matched"], "|").alias("matched"))


@query
def entity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = metrics.entity_coverage(F.col("prediction"), F.col("reference"))
    return _pairs(spark, sf_dir).where("reference is not null").select("id", e["coverage"].alias("coverage"), e["total"].alias("total"))


@query
def rouge1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("id", metrics.rouge_n(F.col("prediction"), F.col("reference"), 1).alias("rouge1"))


@query
def rouge2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("id", metrics.rouge_n(F.col("prediction"), F.col("reference"), 2).alias("rouge2"))


@query
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("id", metrics.rouge_l(F.col("prediction"), F.col("reference")).alias("rouge_l"))


@query
def semantic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the one with the next id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(other, "vec_id").select("vec_id", metrics.similarity(F.col("embedding"), F.col("other")).alias("similarity"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for records of an evaluation, made from answers by fixed rules."""
    table(spark, sf_dir, "steps").createOrReplaceTempView("_inkstone_steps")
    return spark.sql(fixtures.records("_inkstone_steps"))


@query
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = evaluate.leaderboard(_records(spark, sf_dir))
    return board.select("dimension", "value", "n", F.round("rougeL", 6).alias("rouge_l"), F.round("num_accuracy", 6).alias("num_accuracy"), "faithful", F.round("completeness", 6).alias("completeness"))


@query
def faithful_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).groupBy("doc").agg(evaluate.share_text(F.col("faithfulness")).alias("rate"))


@query
def combo_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.combos(_records(spark, sf_dir), [(500, 50), (500, 100), (700, 50)])
    return rows.select("chunk_size", "chunk_overlap", "n", F.round("rougeL", 6).alias("rouge_l"), F.round("num_accuracy", 6).alias("num_accuracy"), F.round("faithful_share", 6).alias("faithful_share"))


@query
def doc_label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _fixture(spark, "labels")
    rows = evaluate.labelled(_records(spark, sf_dir), labels)
    return rows.select("label", "n", F.round("rougeL", 6).alias("rouge_l"), F.round("num_accuracy", 6).alias("num_accuracy"), F.round("completeness", 6).alias("completeness"))


@query
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.print_summary(_records(spark, sf_dir))
    return rows.select("dimension", "value", "n", F.round("rougeL", 6).alias("rouge_l"), F.round("num_accuracy", 6).alias("num_accuracy"))


@query
def sweep_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections ask the documents of doc_metadata under all parameters."""
    asks = _sections(spark, sf_dir).select(F.col("doc_id").alias("doc"), "section_no")
    docs = table(spark, sf_dir, "doc_metadata").select(F.col("filename").alias("doc")).distinct()
    return evaluate.sweep(asks, docs, [300, 500, 700], [50, 100, 200])


# --- sessions and streams ---------------------------------------------------------


def _stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("thread_id"), "ts", F.expr(fixtures.STAGE_EVENT).alias("event"))


@query
def stage_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of users; types of events stand in for starts and ends."""
    return streams.stages(_stage_events(spark, sf_dir)).select("thread_id", "stage", "started", F.round("seconds", 6).alias("seconds"))


@query
def feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "feedbacks").dropDuplicates(["id"])
    return streams.feedback_counts(rows).select("verdict", "n")


@query
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tumbling(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sliding(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from inkstone.plans import oracles

    return oracles.oracle_sql()
