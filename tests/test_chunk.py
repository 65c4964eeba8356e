"""Sections, tables, chunks and their metadata."""

from pyspark.sql import functions as F

from inkstone.operators import chunk, enrich

SHORT = "## 실적\n2023년 영업이익은 1,606억원으로 전년 대비 증가하였으며 매출은 3조원을 기록하였다. 수요가 회복되었다."
LONG = "\n".join("## 전망\n" + " ".join(f"{k}번째 문장은 시장 전망과 수요 회복에 대하여 설명하는 비교적 긴 문장이다." for k in range(7)) for _ in range(3))
TABLE = "## 표\n| 구분 | 값 |\n|---|---|\n| 매출 | 100 |\n| 영업이익 | 20 |\n| 순이익 | 10 |"
SKIPPED = "## Compliance notice\n면책 사항을 안내한다. 본 자료는 참고용이며 투자 판단의 책임은 이용자에게 있다."
PLAIN = "첫째 문단은 쉰 글자를 넘도록 조금 길게 써 둔다. 그래야 최소 길이를 넘기 때문이다. 끝.\n\n둘째 문단.\n\n셋째 문단도 쉰 글자를 넘도록 조금 길게 써 둔다. 그래야 최소 길이를 넘기 때문이다. 정말로 그렇다."


def chunks(spark, text, **kw):
    return chunk.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), **kw).orderBy("chunk_index").collect()


def test_blank(spark):
    for t in ("", "  \n ", None):
        assert chunks(spark, t) == []


def test_paragraphs_and_tables(spark):
    assert [r.text[:2] for r in chunks(spark, PLAIN)] == ["첫째", "셋째"]
    assert [r.chunk_type for r in chunks(spark, TABLE)] == ["table"]
    assert len(chunks(spark, TABLE + "\n" + TABLE)) == 1


def test_skip_size_and_order(spark):
    rows = chunks(spark, "\n".join([SHORT, TABLE, SKIPPED]))
    assert [r.chunk_type for r in rows] == ["text", "table"]
    assert [r.chunk_index for r in rows] == [0, 1]
    assert not any("면책" in r.text for r in rows)
    assert rows[0].doc_year is None or rows[0].doc_year == "2023"
    cut = chunks(spark, LONG, size=300, overlap=50)
    assert len(cut) > 3 and all(50 <= len(r.text) <= 300 for r in cut)


def test_long_text_without_boundaries(spark):
    rows = chunks(spark, "가" * 5000)
    assert all(len(r.text) <= 700 for r in rows) and sum(len(r.text) for r in rows) >= 5000


def test_enrichment(spark):
    cases = [("", "2023년 실적, 2023", "2023", "실적"), ("리스크 요인", "2022년, 2023년", "2023", "리스크"), ("", "2023년도 결산", None, None), ("", "2022년과", None, None), ("outlook", "2023년, 1999, 2040", "2023", "전망"), (None, None, None, None)]
    df = spark.createDataFrame([c[:2] for c in cases], "section string, text string").withColumn("i", F.monotonically_increasing_id())
    rows = df.select("i", enrich.doc_year(F.col("section"), F.col("text")).alias("y"), enrich.section_type(F.col("section"), F.col("text")).alias("t"), enrich.metrics(F.col("text")).alias("m")).orderBy("i").collect()
    assert [(r.y, r.t) for r in rows] == [c[2:] for c in cases]
    one = spark.createDataFrame([("영업이익과 매출, ROE가 PERIOD",)], "text string").select(enrich.metrics(F.col("text")).alias("m")).first().m
    assert one == sorted(["영업이익", "매출", "ROE", "PER"])


def test_semantic_groups(spark):
    rows = [(1, 0, i, f"s{i}", [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(6)] + [(2, 0, 0, "x", [1.0, 0.0]), (2, 0, 1, "y", [0.0, 1.0])]
    got = chunk.semantic_groups(spark.createDataFrame(rows, "doc_id long, section_no int, sent_no int, text string, vector array<double>")).orderBy("group_no").collect()
    assert [r.text for r in got] == ["s0 s1 s2", "s3 s4 s5"]


def test_numbers_of_a_large_document_come_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(chunk, "_BLOCK", 10)
    rows = [("hot", i * 3, i % 2) for i in range(200)] + [("hot", 6, 5), ("small", 7, 0), ("small", 2, 0)]
    got = chunk.numbered(spark.createDataFrame(rows, "doc_id string, section_no int, sub_no int"), "section_no", "sub_no").collect()
    for d in ("hot", "small"):
        mine = sorted((r.section_no, r.sub_no, r.number) for r in got if r.doc_id == d)
        assert [x[2] for x in mine] == list(range(len(mine)))
