"""Queries on the evidence of whole documents, against a plain restatement of search and reranking."""

import re

import pytest

from inkstone.plans import queries as core
from test_retrieve import brute

DATA = "/root/testdata/sf0.001"


def words(text):
    return re.findall("[가-힣a-zA-Z0-9]+", text or "")


def restated(chunks, sections):
    """{document: (question, chunks, sections)} of rows (doc_id, number, section, text or bullets)."""
    texts, secs = {}, {}
    for d, i, name, text in chunks:
        if d is not None and i is not None:
            key = lambda r: (r[1] is not None, r[1] or "", r[0] is not None, r[0] or "")
            texts.setdefault(d, {})[i] = min(texts.get(d, {}).get(i, (name, text)), (name, text), key=key)
    for d, i, name, bullets in sections:
        if d is not None and i is not None:
            secs.setdefault(d, {})[i] = (name, [b for b in bullets or [] if b is not None])
    out = {}
    for d in texts.keys() | secs.keys():
        names = [secs[d][i][0] for i in sorted(secs.get(d, {}))] + [texts[d][i][0] for i in sorted(texts.get(d, {}))]
        names = [n for n in names if n and n.strip()]
        if not names:
            continue
        q = names[0]
        hits = [texts[d][i][1] for i in brute([(i, t) for i, (_, t) in texts.get(d, {}).items()], q, 5)]
        if len(hits) > 3:
            hits = sorted(hits, key=lambda t: -round(len(set(words(q)) & set(words(t))) / len(set(words(q))), 9))[:3]
        named = {i: x for i, x in secs.get(d, {}).items() if x[0] is not None}
        out[d] = (q, hits, [named[i] for i in brute([(i, " ".join([n, *b])) for i, (n, b) in named.items()], q, 3)])
    return out


def context(hits, secs, overall):
    if not hits and not secs:
        return "\n\n".join(["## 전체 요약", overall[:3000]]) if overall else ""
    parts = ["## 원문 발췌"] * bool(hits) + [f"[원문 {i}]\n{t}" for i, t in enumerate(hits, 1)]
    return "\n\n".join(parts + ["## 요약 섹션"] * bool(secs) + [f"[{n}]\n" + "\n".join(f"- {b}" for b in bs) for n, bs in secs])


@pytest.fixture(scope="module")
def deep(spark, tmp_path_factory):
    """A document whose evidence stands behind its third chunk and section, and one of chunks alone."""
    at = tmp_path_factory.mktemp("deep")
    chunks = [("d", i, "s", f"filler{i} text") for i in range(12)] + [("d", 12, "s", "risk of alpha"), ("d", 13, "s", "alpha outlook")]
    chunks += [("c", i, "beta" if i == 0 else "s", f"more{i}") for i in range(5)] + [("c", 5, "s", "beta here"), ("n", 0, "gamma", "Other words. Second.")]
    sections = [("d", 0, "alpha", None)] + [("d", i, f"part{i}", [f"x{i}"]) for i in range(1, 6)] + [("d", 6, "late", ["alpha 1~2", None])]
    spark.createDataFrame(chunks, "doc_id string, chunk_index int, section string, text string").write.parquet(f"{at}/chunks.parquet")
    spec = "struct<title:string>"
    spark.createDataFrame([(*r, None) for r in sections], f"doc_id string, section_no int, section string, bullets array<string>, chart_spec {spec}").write.parquet(f"{at}/section_summaries.parquet")
    return str(at)


def test_evidence_reaches_behind_the_head(spark, deep):
    q = core.queries()
    got = {r.doc_id: r.context for r in q["retrieved_context"](spark, deep).collect()}
    assert "alpha outlook" in got["d"] and "[late]\n- alpha 1~2" in got["d"] and "filler" not in got["d"]
    assert got["c"] == "## 원문 발췌\n\n[원문 1]\nbeta here" and got["n"] == "## 전체 요약\n\nOther words.\nSecond."
    items = {(r.doc_id, r.section): (r.snippet, r.full_chunk) for r in q["source_items"](spark, deep).collect()}
    assert items["d", "late"][0] == "alpha 1-2" and items["d", "alpha"][0] == "" and {x[1] for x in items.values()} == {"risk of alpha", "alpha outlook"}
    answers = {r["query"]: (r.answer, r.is_answerable) for r in q["answered"](spark, deep).collect()}
    assert answers["c"] == ("beta here", True) and answers["n"] == ("Other words.", True) and "alpha" in answers["d"][0]


def test_evidence_of_all_documents(spark):
    rows = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(*cols).collect()]
    want = restated(rows("chunks", "doc_id", "chunk_index", "section", "text"), rows("section_summaries", "doc_id", "section_no", "section", "bullets"))
    got = {r.doc_id: r for r in core._evidence(spark, DATA).collect()}
    assert {d: (r.question, list(r.chunks), [(s.section, list(s.bullets)) for s in r.sections]) for d, r in got.items()} == want
    told = {r.doc_id: r.overall for r in core.queries()["summaries"](spark, DATA).collect()}
    assert {r.doc_id: r.context for r in core.queries()["retrieved_context"](spark, DATA).collect()} == {d: context(h, s, told.get(d, "")) for d, (_, h, s) in want.items()}
