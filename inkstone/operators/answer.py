"""Answering questions from retrieved text, and summarising documents.

Models are pluggable: a provider is a function from a column of prompts to a
column of raw replies, usually an Arrow UDF with the model loaded once per
worker.  The default ones are extractive and deterministic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.text import bound, contains_any, is_blank, strip, tokens

Provider = Callable[[Column], Column]

#: Phrases of answers that say the document has none, and what stands in for missing text.
UNANSWERABLE = ("문서에서 해당 내용을 찾을 수 없", "문서에서 확인할 수 없", "제공된 문서에는 해당 내용이 없", "해당 정보는 문서에 포함되어 있지 않")
NO_ANSWER, FAILED, NO_SUMMARY, NO_SECTIONS = "[답변 불가]", "[답변 생성 실패]", "[전체 요약 생성 실패]", "[요약 생성 실패 — 유효한 청크 없음]"
REFUSAL = "문서에서 해당 내용을 찾을 수 없습니다."
FOLLOW_UPS = ("재무지표 더 자세히 보여줘", "리스크 요인은 무엇인가요?", "향후 전망은?")
OCR_NOISE = r"\[OCR [^\]]*\]|\[OCR\]|※ 이미지 기반 PDF[^\n]*|원문:\s*[^\]]*"
OVERALL_CUT = 3000
SUMMARY = "section string, bullets array<string>, source string, chart_spec struct<chart_type:string,title:string,labels:array<string>,values:array<string>,series:array<struct<name:string,values:array<string>>>,unit:string>"


def is_unanswerable(answer: Column) -> Column:
    """Whether an answer says that the document has none."""
    return F.coalesce(contains_any(answer, UNANSWERABLE), F.lit(False))


def fix_tildes(text: Column, by: str = "-") -> Column:
    """Tildes between numbers replaced."""
    return F.regexp_replace(text, r"(\p{Nd}+\.?\p{Nd}*)~+(\p{Nd}+\.?\p{Nd}*)", f"$1{by}$2")


def without_ocr_noise(text: Column) -> Column:
    """Without the marks of text recognition."""
    return strip(F.regexp_replace(text, OCR_NOISE, ""))


def pinned(items: Column, indexes: Column) -> Column:
    """The items at 0-based indexes, those out of range left out, order and repeats kept."""
    good = F.filter(indexes, lambda i: (i >= 0) & (i < F.size(items)))
    return F.transform(good, lambda i: F.element_at(items, (i + 1).cast("int")))


def best_bullet(answer: Column, bullets: Column) -> Column:
    """The bullet with most terms in common with the answer, the first of equals; without any, the first."""
    words = F.array_distinct(tokens(answer))
    scored = F.transform(bullets, lambda b, i: F.struct(F.size(F.array_intersect(words, tokens(b))).alias("n"), (-i).alias("at"), b.alias("b")))
    return F.array_max(scored)["b"]


def context(chunks: Column, sections: Column, overall: Column, force_overall: Column | bool = False) -> Column:
    """The text that an answer is to be drawn from: excerpts, then sections, else the summary's beginning.

    ``chunks`` are texts, ``sections`` structs of section and bullets.
    """
    force = F.lit(force_overall) if isinstance(force_overall, bool) else force_overall
    chunks, sections = F.coalesce(chunks, F.array().cast("array<string>")), F.coalesce(sections, F.array().cast("array<struct<section:string,bullets:array<string>>>"))
    excerpts = F.transform(chunks, lambda c, i: F.concat(F.lit("[원문 "), (i + 1).cast("string"), F.lit("]\n"), c))
    summaries = F.transform(sections, lambda s: F.concat(F.lit("["), s["section"], F.lit("]\n"), F.array_join(F.transform(s["bullets"], lambda b: F.concat(F.lit("- "), b)), "\n")))
    head = lambda title, parts: F.when(~force & (F.size(parts) > 0), F.concat(F.array(F.lit(title)), parts)).otherwise(F.array().cast("array<string>"))
    alone = (force | ((F.size(chunks) == 0) & (F.size(sections) == 0))) & (F.coalesce(overall, F.lit("")) != "")
    last = F.when(alone, F.array(F.lit("## 전체 요약"), F.substring(overall, 1, OVERALL_CUT))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head("## 원문 발췌", excerpts), head("## 요약 섹션", summaries), last), "\n\n")


def sources(answer: Column, sections: Column, chunks: Column) -> Column:
    """array<struct(section, snippet, full_chunk)>: each section name once, with the chunk at its place."""
    named = F.transform(sections, lambda s, i: F.struct(strip(s["section"]).alias("section"), F.coalesce(fix_tildes(best_bullet(answer, s["bullets"])), F.lit("")).alias("snippet"), F.coalesce(F.try_element_at(chunks, (i + 1).cast("int")), F.lit("")).alias("full_chunk")))
    names = F.transform(named, lambda x: x["section"])
    return F.filter(named, lambda x, i: F.array_position(names, x["section"]) == i + 1)


def fill(template: str, **values: Column) -> Column:
    """A prompt template with {name} replaced once per name, and doubled braces as single ones.

    Values are put in last and never read as templates themselves.
    """
    import re

    parts: list[Column] = []
    for m in re.finditer(r"\{\{|\}\}|\{(\w+)\}|[^{}]+|[{}]", template):
        parts.append(F.coalesce(values[m[1]].cast("string"), F.lit("")) if m[1] else F.lit({"{{": "{", "}}": "}"}.get(m[0], m[0])))
    return F.concat(*parts)


def extractive(prompt: Column) -> Column:
    """Default provider of answers: the excerpt or bullet with most terms of the question, which is the last line."""
    lines = F.filter(F.split(prompt, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("##")) & ~F.startswith(x, F.lit("[")))
    question = F.element_at(lines, -1)
    return F.when(F.size(lines) > 1, best_bullet(question, F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(1))))).otherwise(REFUSAL)


def ask(questions: DataFrame, provider: Provider = extractive) -> DataFrame:
    """Answers of (query, question, chunks, sections, overall): (query, answer, is_answerable, sources).

    A first pass over excerpts and sections; those unanswered get a second one
    over the summary, and a fixed refusal if there is none.  Null replies are
    failures.
    """
    first = questions.withColumn("answer", provider(F.concat_ws("\n", context(F.col("chunks"), F.col("sections"), F.col("overall")), "question")))
    failed = first.where(F.col("answer").isNull()).withColumn("answer", F.lit(FAILED)).withColumn("is_answerable", F.lit(False))
    good = first.where(F.col("answer").isNotNull() & ~is_unanswerable(F.col("answer"))).withColumn("is_answerable", F.lit(True))
    again = first.where(F.col("answer").isNotNull() & is_unanswerable(F.col("answer")))
    retry = again.where(~is_blank(F.col("overall"))).withColumn("answer", F.coalesce(provider(F.concat_ws("\n", context(F.col("chunks"), F.col("sections"), F.col("overall"), True), "question")), F.lit(FAILED)))
    retry = retry.withColumn("is_answerable", ~is_unanswerable(F.col("answer")) & (F.col("answer") != FAILED))
    none = again.where(is_blank(F.col("overall"))).withColumn("answer", F.lit(REFUSAL)).withColumn("is_answerable", F.lit(False))
    every = good.unionByName(failed).unionByName(retry).unionByName(none)
    return every.select("query", F.col("answer"), "is_answerable", F.when(F.col("is_answerable"), sources(F.col("answer"), F.col("sections"), F.col("chunks"))).alias("sources"))


def follow_ups(reply: Column) -> Column:
    """Three questions of a JSON reply, or the defaults if fewer are usable."""
    items = F.slice(F.coalesce(F.from_json(reply, "questions array<string>")["questions"], F.array().cast("array<string>")), 1, 3)
    text = F.transform(items, lambda x: F.when(F.startswith(F.trim(x), F.lit("{")), F.get_json_object(x, "$.q")).otherwise(x))
    good = F.filter(text, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.size(good) >= 3, good).otherwise(F.array(*(F.lit(x) for x in FOLLOW_UPS)))


def fenced(reply: Column) -> Column:
    """A reply without the code fence around it."""

    def body(text: Column) -> Column:
        inner = F.regexp_replace(F.try_element_at(F.split(text, "```", -1), F.lit(2)), "^json", "")
        return F.when(F.startswith(text, F.lit("```")), strip(inner)).otherwise(text)

    return bound(strip(reply), body)


def section_summary(reply: Column) -> Column:
    """The summary struct of a JSON reply; null where it can't be read or lacks section or bullets.

    A chart of type none is no chart.
    """

    def checked(s: Column) -> Column:
        spec = F.when(F.lower(F.coalesce(s["chart_spec"]["chart_type"], F.lit("none"))) != "none", s["chart_spec"])
        return F.when(s["section"].isNotNull() & s["bullets"].isNotNull(), F.struct(s["section"].alias("section"), s["bullets"].alias("bullets"), F.coalesce(s["source"], F.lit("")).alias("source"), spec.alias("chart_spec")))

    return bound(F.from_json(fenced(reply), SUMMARY), checked)


def bullet_budget(chunks: Column) -> Column:
    """Number of bullets of a summary by the number of chunks."""
    return F.when(chunks <= 10, 5).when(chunks <= 25, 8).otherwise(12)


def first_sentences(prompt: Column) -> Column:
    """Default provider of summaries: the section with its first two sentences as bullets, as JSON.

    The prompt is the section's name, a line end, and the text.
    """
    name, text = F.regexp_extract(prompt, r"(?s)^([^\n]*)\n", 1), F.regexp_extract(prompt, r"(?s)^[^\n]*\n(.*)$", 1)
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.?!。])\s+|\n+"), strip), lambda x: x != "")
    return bound(sentences, lambda xs: F.when(F.size(xs) > 0, F.to_json(F.struct(name.alias("section"), F.slice(xs, 1, 2).alias("bullets"), name.alias("source")))))


def summarise(chunks: DataFrame, mapper: Provider = first_sentences, reducer: Provider | None = None) -> DataFrame:
    """(doc_id, sections, overall): every chunk summarised, then the document.

    Chunks that are blank or whose reply can't be read are left out; a document
    without any left has a fixed text.  Without a reducer the overall text is the
    first bullets within the budget.
    """
    given = chunks.withColumn("name", F.when(is_blank(F.col("section")), F.lit("(no section)")).otherwise(F.col("section")))
    counted = given.groupBy("doc_id").agg(F.count("*").alias("n"))
    reply = section_summary(mapper(F.concat("name", F.lit("\n"), strip(F.col("text")))))
    # exploded, for the test for null would work out the summary a second time
    asked = given.where(~is_blank(F.col("text"))).select("doc_id", "chunk_index", F.explode(F.array_compact(F.array(reply))).alias("s"))
    ordered = asked.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "s"))), lambda x: x["s"]).alias("sections"))
    both = counted.join(ordered, "doc_id", "left")
    text = fix_tildes(F.array_join(F.transform("sections", lambda s: F.concat(F.lit("["), s["section"], F.lit("]\n"), F.array_join(F.transform(s["bullets"], lambda b: F.concat(F.lit("- "), b)), "\n"))), "\n"), "에서 ")
    firsts = F.array_join(F.slice(F.flatten(F.transform("sections", lambda s: s["bullets"])), F.lit(1), bullet_budget(F.col("n"))), "\n")
    made = reducer(text) if reducer else firsts
    overall = F.when(F.col("sections").isNull(), NO_SECTIONS).when(is_blank(made), F.coalesce(F.try_element_at(F.col("sections")[0]["bullets"], F.lit(1)), F.lit(NO_SUMMARY))).otherwise(fix_tildes(made, "에서 "))
    return both.select("doc_id", "n", "sections", overall.alias("overall"))


def merge_documents(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(qa_id, text, overall, is_image_based, n_docs) of questions over several documents.

    ``groups`` has qa_id and doc, a comma-separated list; one document that is
    missing or failed drops the question.
    """
    wanted = groups.select("qa_id", F.posexplode(F.split("doc", ",")).alias("at", "doc_id")).withColumn("doc_id", strip(F.col("doc_id")))
    got = wanted.join(docs, "doc_id", "left").groupBy("qa_id").agg(
        F.every(F.coalesce(F.col("status") == "ok", F.lit(False))).alias("ok"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat(F.lit("=== "), "doc_id", F.lit(" ===\n"), "text").alias("t")))), lambda x: x["t"]), "\n\n").alias("text"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat(F.lit("["), "doc_id", F.lit("]\n"), "overall").alias("t")))), lambda x: x["t"]), "\n\n").alias("overall"),
        F.bool_or("is_image_based").alias("is_image_based"), F.count("*").alias("n_docs"),
    )
    return got.where("ok").drop("ok")
