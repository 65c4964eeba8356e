"""Literal rows and expressions that queries share with the SQL they are held against.

In the texts ¶ stands for a line end, so that both dialects read them alike.
"""

from __future__ import annotations

_ROWS: dict[str, tuple[str, list[tuple]]] = {
    "markup": ("id, text", [
        (1, "<style>p {color: red}</style><p>One &amp; two</p>¶¶¶¶<b>three</b>   four"),
        (2, ".cls-1 {font: x}¶<h1>Title</h1><br>&lt;tag&gt; &nbsp; end"),
        (3, "End of one.Next sentence { inner } tail"),
        (4, ""),
        (5, None),
    ]),
    "omitted": ("id, text, tables, recognised", [
        (1, "a¶**==> picture [10 x 20] intentionally omitted <==**¶b", "|x|$1|", "ocr"),
        (2, "a **==> picture [1 x 2] intentionally omitted <==** b", None, "read text"),
        (3, "a **==> picture [1 x 2] intentionally omitted <==** b", "", ""),
        (4, "x **----- Start of picture text -----**¶junk¶**----- End of picture text -----**¶y", None, None),
    ]),
    "notes": ("doc_id, text", [
        (1, "주 1) 기준¶본문¶주1)기준¶* 참고¶*참고¶본문"),
        (2, "☞ a¶x¶ ☞a¶x"),
        (3, ""),
        (4, None),
    ]),
    "tables": ("doc_id, text", [
        (1, "| a | b |¶|---|---|¶| 1 | 2 |¶text¶| a | b |¶|---|---|¶| 3 | 4 |"),
        (2, "line<br>next<br/>more<br />end¶|x|¶|x|¶|*x*|"),
        (3, "no table"),
    ]),
    "dates": ("id, text", [(1, "D:20240131235959+09'00'"), (2, "D:20241331000000"), (3, "2024-01-31"), (4, None)]),
    "tildes": ("id, text", [(1, "3.0~~3.5개월 2~3분기"), (2, "a~b 1~2~3"), (3, "[OCR 12] 본문 [OCR] ※ 이미지 기반 PDF 주의¶끝"), (4, None)]),
    "replies": ("id, text", [
        (1, "{\"section\": \"A\", \"bullets\": [\"x\", \"y\"], \"source\": \"s\"}"),
        (2, "```json¶{\"section\": \"B\", \"bullets\": [], \"source\": \"s\", \"chart_spec\": {\"chart_type\": \"bar\", \"title\": \"t\"}}¶```"),
        (3, "{\"section\": \"C\", \"bullets\": [\"x\"], \"source\": \"s\", \"chart_spec\": {\"chart_type\": \"None\"}}"),
        (4, "no json"),
        (5, "{\"bullets\": [\"x\"]}"),
        (6, None),
    ]),
    "questions": ("id, text", [
        (1, "{\"questions\": [\"a?\", \"b?\", \"c?\", \"d?\"]}"),
        (2, "{\"questions\": [\"a?\", \"\"]}"),
        (3, "broken"),
    ]),
    "pages": ("doc_id, page_no, reading, text", [
        ("a", 0, 0, "first"), ("a", 0, 1, "second"), ("a", 1, 0, " "), ("a", 1, 2, "third"), ("a", 10, 1, "last"), ("b", 0, 0, "¶"), ("c", 0, 2, "only"),
    ]),
    "merge_docs": ("doc_id, text, overall, is_image_based, status", [
        ("a", "ta", "oa", False, "ok"), ("b", "tb", "ob", True, "ok"), ("c", "tc", "oc", False, "error"),
    ]),
    "merge_groups": ("qa_id, doc", [(1, "a, b"), (2, "b,a"), (3, "a,c"), (4, "a,missing"), (5, "b")]),
    "labels": ("doc, label", [("answer", "답변 단계")]),
}


def _literal(x: object, end: str) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        quoted = "'" + x.replace("'", "''") + "'"
        return f"replace({quoted}, '¶', {end})" if "¶" in x else quoted
    return str(x).lower() if isinstance(x, bool) else str(x)


def _values(name: str, end: str, escape: bool) -> str:
    columns, rows = _ROWS[name]
    rows = [tuple(x.replace("\\", "\\\\") if escape and isinstance(x, str) else x for x in r) for r in rows]
    if escape:  # Spark doubles quotes by a backslash
        lines = ["(" + ", ".join(_literal(x, end).replace("''", "\\'") if isinstance(x, str) and "'" in x else _literal(x, end) for x in r) + ")" for r in rows]
    else:
        lines = ["(" + ", ".join(_literal(x, end) for x in r) + ")" for r in rows]
    return f"(VALUES {', '.join(lines)}) AS t({columns})"


def for_spark(name: str) -> str:
    return f"SELECT * FROM {_values(name, 'char(10)', True)}"


def for_sql(name: str) -> str:
    return f"(SELECT * FROM {_values(name, 'chr(10)', False)})"


STAGE_EVENT = "CASE event_type WHEN 'view' THEN 'search_start' WHEN 'click' THEN 'search_done' WHEN 'signup' THEN 'rerank_start' WHEN 'purchase' THEN 'rerank_done' ELSE 'other' END"


def records(steps: str) -> str:
    """Stand-ins for evaluation records, from answers by rules that both dialects know."""
    return f"""
      SELECT id, doc, CASE WHEN input LIKE '%얼마%' THEN 'numerical' WHEN input LIKE '%요약%' THEN 'summary' WHEN input LIKE '%비교%' THEN 'multi_doc' WHEN input LIKE '%risk%' THEN 'other' ELSE 'factual' END AS type,
        CASE WHEN n_in % 2 = 0 THEN 'qa' ELSE 'vectorrag' END AS qa_set, CASE WHEN input LIKE '%비교%' THEN 'multi' ELSE 'single' END AS doc_mode,
        n_out % 4 = 0 AS is_image_based, CASE WHEN n_out % 3 = 0 THEN NULL ELSE 300 + 200 * (n_out % 3) END AS chunk_size, 50 + 50 * (n_in % 2) AS chunk_overlap, CASE WHEN n_in % 5 = 0 THEN NULL ELSE n_in % 2 END AS temperature,
        CAST(n_out AS DOUBLE) / 1000 AS rougeL, CAST(n_in AS DOUBLE) / 100 AS num_accuracy, CASE WHEN n_out > 120 THEN 'Faithful' WHEN n_out = 0 THEN 'Error' ELSE 'Unfaithful' END AS faithfulness, CASE WHEN n_out > 0 THEN 1 + n_out % 5 END AS completeness
      FROM (SELECT id, min(name) AS doc, coalesce(min(input), '') AS input, length(coalesce(min(input), '')) AS n_in, length(coalesce(min(output), '')) AS n_out FROM {steps} WHERE type = 'llm' GROUP BY id) s"""
