"""Scan repair and source lines on small tables with known answers."""

import re

import pytest
from pyspark.sql import functions as F

from inkstone.llm import scan_repair, source_lines

CHUNKS = "doc_id string, section string, page int, chunk_index int, text string, chunk_type string, doc_year string, section_type string, metrics array<string>"
BODY = ["The company reported higher revenue in the quarter because of stronger demand.", "Management expects a gradual recovery of the market in the second half.", "시장에서는 수요 회복과 판매 단가 개선이 나타날 가능성이 높다고 판단한다.", "매출액은 12,345억원으로 전년 대비 12.3% 증가하였다."]
NOTICE = ["Ｐｌｅａｓｅ read the disclosures of Acme Research", "please READ the disclosures of ACME research 12", "Please  read the disclosures of Acme  Research."]


def issuers(spark):
    return spark.createDataFrame([("ACM", "Acme", "acme-research", "en"), ("ZZZ", "Other", "other_house", "ko")], "issuer_code string, issuer_name string, filename_tag string, home_lang string")


def rows():
    out = []
    for d in range(24):
        name = f"Acme Research_note_{d:03d}.pdf" if d % 2 else f"acme_research-note_{d:03d}.docx"
        for c in range(4):
            text = "\n".join([BODY[(d + c + k) % 4] for k in range(3)])
            if c == 0 and d < 8:
                text += "\n" + NOTICE[d % 3]
            out.append((name, "s", None, c, text, "text", None, None, []))
    d = "acme-research_scan_999.pdf"
    out += [
        (d, "s", 1, 0, "Kolerane weekly | Havrin\nThe company reported higher reve-\nnue in the quarter because of stronger demand.\n- 12 -", "text", None, None, []),
        (d, "s", 1, 1, "Management expects a gradua1 recovery of the rnarket\nKOLERANE  WEEKLY | Havrin \nin the second half.\n74 / 104", "text", None, None, []),
        (d, "s", 1, 2, "매출액은 1Z,345억원으로 전년 대비 12.3% 증가하였다. 판딘한다.\n비고 -", "text", None, None, []),
        (d, "s", 1, 2, "매출액은 1Z,345억원으로 전년 대비 12.3% 증가하였다. 판딘한다.\n비고 -", "text", None, None, []),
        (d, "s", 1, 3, None, "text", None, None, []), (d, "s", 1, 4, "", "text", None, None, []), (d, "s", 1, 5, "   \n\n ", "text", None, None, []),
        (d, "s", 1, 6, "x" * 200_000, "text", None, None, []), (d, "s", 1, 7, "| 1 |\n12", "table", None, None, []),
        (None, "s", 1, 8, "12", "text", None, None, []), ("nobody.pdf", "s", 1, 0, "p. 3", "text", None, None, []),
    ]
    return out


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(rows(), CHUNKS).withColumn("h", F.lit("clash")).withColumn("line_no", F.lit("clash")).withColumn("kind", F.lit(1))


def test_scan_damage(spark, chunks):
    got = {(r.doc_id[-7:], r.chunk_index, r.kind) for r in scan_repair.found(chunks, issuers(spark)).collect()}
    scan = {(i, k) for d, i, k in got if d == "999.pdf"}
    assert scan == {(0, "header"), (0, "linebreak"), (0, "pagenum"), (1, "header"), (1, "character"), (1, "pagenum"), (2, "character")}
    assert ("ody.pdf", 0, "pagenum") in got and not any(d.endswith("docx") for d, _, _ in got)


def test_scan_text(spark, chunks):
    got = {(r.doc_id, r.chunk_index): r.text for r in scan_repair.scan_repaired(chunks, issuers(spark)).collect()}
    d = "acme-research_scan_999.pdf"
    assert got[d, 0] == BODY[0]
    assert got[d, 1] == "Management expects a gradual recovery of the market in the second half."
    assert got[d, 2].startswith("매출액은 12,345억원으로") and (d, 3) not in got and got[d, 5] == "" and len(got[d, 6]) == 200_000


def test_scan_empty_table(spark):
    assert scan_repair.found(spark.createDataFrame([], CHUNKS), issuers(spark)).count() == 0


def test_repair_keeps_undamaged_paragraphs():
    lex = scan_repair.Lexicon({}, {}, 0)
    for text in ("one.\n\ntwo.", "a b c.\nd e f.", "", "x"):
        assert scan_repair.repair(text, set(), set(), lex) == (text, set())
    assert scan_repair.repair("유지되-\n※ notice\n었다.", set(), {1}, lex)[0] == "유지되었다.\n※ notice"
    assert all(scan_repair.is_page_number(x) for x in ("28", "- 65 -", "74 / 104", "p. 86", "Page 3 of 9", "[ 49 ]", "〈50〉", "97쪽", "– 7 –"))
    assert not any(scan_repair.is_page_number(x) for x in ("12.3%", "2,353억원", "A3", "-", "1 2"))


def plain(rows, tags, share=0.25):
    key = lambda x: "".join(c for c in x.lower().translate({c: c - 0xFEE0 for c in range(0xFF21, 0xFF5B)}) if c.isalpha())
    source = {}
    for r in rows:
        if r[0]:
            source[r[0]] = next((c for c, t in tags.items() if t in re.sub(r"[-_\s]+", "-", r[0].lower())), None)
    docs, n = {}, {}
    for d, s in source.items():
        n.setdefault(s, set()).add(d)
    for r in rows:
        for x in (r[4] or "").split("\n"):
            if r[0] and source[r[0]]:
                docs.setdefault((source[r[0]], key(x)), set()).add(r[0])
    hot = {k for k, s in docs.items() if len(k[1]) >= 8 and len(s) >= 3 and len(s) >= share * len(n[k[0]])}
    return {(r[0], r[3], i) for r in rows if r[0] and r[4] for i, x in enumerate(r[4].split("\n")) if (source[r[0]], key(x)) in hot}


def test_source_lines(spark, chunks):
    lines, keys = source_lines.repeated_lines(chunks, issuers(spark))
    got = [tuple(r) for r in lines.select("doc_id", "chunk_index", "line_no").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows(), {"ACM": "acme-research", "ZZZ": "other-house"})
    assert all(r.n_docs >= 3 for r in keys.collect())
    texts = {(r.doc_id, r.chunk_index): r.text for r in source_lines.without_source_lines(chunks, issuers(spark)).collect()}
    assert not any("disclosures" in (t or "").lower() for t in texts.values())
    assert source_lines.repeated_lines(spark.createDataFrame([], CHUNKS), issuers(spark))[0].count() == 0


def test_bitmaps_count_exactly_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(source_lines, "_GROUP_DOCS", 10)
    table = spark.createDataFrame([(f"acme-research-{d}.pdf", "", None, 0, f"a line that stands in some documents\nunique line number {'x' * d}" if d % 4 == 0 else "another one here", "text", None, None, []) for d in range(101)], CHUNKS)
    _, keys = source_lines.repeated_lines(table, issuers(spark))
    assert sorted(r.n_docs for r in keys.collect()) == [26, 75]


def test_many_sources(spark, monkeypatch):
    names = [f"{tag}_doc {d}.pdf" for t in range(2000) for d in range(2) for tag in [f"House{t:04d} Lab"]] + ["nobody.pdf", "house0007-lab-extra_1.pdf"]
    rows = spark.createDataFrame([(n,) for n in names], "doc_id string")
    table = spark.createDataFrame([(f"S{t:04d}", f"house{t:04d}-lab") for t in range(2000)] + [("X", "house0007-lab-extra"), (None, "nobody"), ("Y", None)], "issuer_code string, filename_tag string")
    got = {r.doc_id: r.issuer for r in source_lines.with_source(rows, table).collect()}
    assert len(got) == len(names) and all(got[n] == f"S{n[5:9]}" for n in names[:4000]) and got["nobody.pdf"] is None and got["house0007-lab-extra_1.pdf"] == "X"
    monkeypatch.setattr(source_lines, "_MAX_INLINE_SOURCES", 5000)
    some = spark.createDataFrame([(n,) for n in names[:40] + names[-2:]], "doc_id string")
    few = table.where("issuer_code < 'S0030' or issuer_code = 'X'")
    assert {r.doc_id: r.issuer for r in source_lines.with_source(some, few).collect()} == {n: got[n] for n in names[:40] + names[-2:]}


def test_differing_versions_lose_their_own_lines(spark):
    notice = "a notice that stands everywhere"
    rows = [(f"acme-research {d}.pdf", "", None, 0, f"{notice}\nbody {'x' * d}", "text", None, None, []) for d in range(8)]
    rows += [("acme-research v.pdf", "", None, 0, f"b first\n{notice}", "text", None, None, []), ("acme-research v.pdf", "", None, 0, f"{notice}\na second one", "text", None, None, [])]
    for order in (rows, rows[::-1]):
        got = {r.doc_id: r.text for r in source_lines.without_source_lines(spark.createDataFrame(order, CHUNKS), issuers(spark)).collect()}
        assert got["acme-research v.pdf"] == "a second one" and got["acme-research 1.pdf"] == "body x"


def pages(spark, docs):
    rows = [(d, "s", None, i, t, "text", None, None, []) for d, texts in docs.items() for i, t in enumerate(texts)]
    return {(r.doc_id, r.chunk_index): r for r in scan_repair.scan_repaired(spark.createDataFrame(rows, CHUNKS), issuers(spark)).collect()}


def test_headers_are_found_misread_with_digits_plain_and_in_series(spark):
    body = [f"{BODY[i % 2]} Paragraph {'abcdefgh'[i]} goes on." for i in range(8)]
    docs = {
        "misread.pdf": [f"{h}\n{body[i]}" for i, h in enumerate(("Kolerane weekly | Havrin", "Ko1erane weekly | Havrin", "Kolerane weekiy | Havrin", "Kolerane weekly | Havnn"))],
        "digits.pdf": [f"{body[i]}\nBudget 2023 review | Zed" for i in range(4)],
        "plain.pdf": [f"Quarterly outlook of the Rivermouth district\n{body[i]}" for i in range(4)],
        **{f"series {k}.pdf": [f"Letters to the members | Oakfield\n{body[i + k]}" for i in range(3)] for k in range(3)},
        **{f"chance {k}.pdf": [f"a phrase that all of them | share\n{body[i]}" if i < 1 + (k == 0) else body[i] for i in range(3)] for k in range(5)},
    }
    got = pages(spark, docs)
    for d in docs:
        for i, text in enumerate(docs[d]):
            assert ("header" in got[d, i].kinds) == (not d.startswith("chance")), (d, i)
            if not d.startswith("chance"):
                assert got[d, i].text == next(x for x in text.split("\n") if "Paragraph" in x)


def test_vocabulary_decides_about_hyphens():
    lex = scan_repair.Lexicon({"revenue": 90, "long": 90, "term": 90, "plan": 90, "well": 90, "known": 90, "risk-adjusted": 9, "riskadjusted": 1, "online": 50, "on-line": 9, "firm": 90, "on": 90, "line": 90}, {}, 100)
    fixed = lambda t: scan_repair.repair(t, set(), set(), lex)
    for text, want in (
        ("the long-\nterm plan", "the long-term plan"), ("a well-\nknown firm", "a well-known firm"), ("a risk-\nadjusted plan", "a risk-adjusted plan"), ("higher reve-\nnue", "higher revenue"),
        ("an on-\nline plan", "an online plan"), ("Na- \nsaga", "Nasaga"), ("유지되-\n었다", "유지되었다"),
    ):
        assert fixed(text) == (want, {"linebreak"}), text


def test_every_glyph_of_a_run_is_put_back():
    lex = scan_repair.Lexicon({"revenue": 90, "demand": 90, "quarter": 90, "company": 90, "business": 90}, {}, 100)
    assert lex.meant("revenuedernandquarterbusinesscornpany") == "revenuedemandquarterbusinesscompany"
    assert lex.meant("a" + "1" * 40 + "bc") is None
