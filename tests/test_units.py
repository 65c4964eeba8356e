"""Quantities against a plain reading of every text, and the graph of notations."""

import sys
from pathlib import Path

from pyspark.sql import functions as F

from inkstone.operators import units

sys.path.insert(0, str(Path(__file__).parent))
import brute_units  # noqa: E402

SCHEMA = "doc_id string, section_no int, section string, bullets array<string>, source string, chart_spec struct<chart_type:string,title:string,labels:array<string>,values:array<string>,series:array<struct<name:string,values:array<string>>>,unit:string>"


def common(spark):
    return spark.createDataFrame([(q,) for q in ("krw", "usd", "rate", "people", "shares", "energy", "mass", "duration")], "quantity string")


def test_against_brute_force(spark):
    sections = spark.read.parquet("/root/testdata/sf0.001/section_summaries.parquet")
    got = {tuple(r[:5]): (r.quantity, r.amount) for r in units.harmonized(sections, common(spark)).collect()}
    want = {}
    for r in sections.distinct().collect():
        for k, v in brute_units.section(r.bullets, r.chart_spec.asDict(True) if r.chart_spec else None).items():
            want[(r.doc_id, r.section_no, *k)] = v
    assert got == {(d, s, p, k, i): v for (d, s, p, k, i), v in want.items()}


def test_edges(spark):
    rows = [
        ("a", 0, None, None, None, None), ("a", 1, "s", [], None, None), ("a", 2, "s", [None, "", "순이익 △(1) 원", "2023년 3분기 순이익: 약 2천억원", "9조443억 원의 매출액"], None, None),
        ("a", 2, "s", [None, "", "순이익 △(1) 원", "2023년 3분기 순이익: 약 2천억원", "9조443억 원의 매출액"], None, None),
        ("a", 3, "s", None, None, ("bar", "x 추이", ["1"], ["5.9조", "n.m.", "-", None, "(２．０)", "7"], None, "백만원")),
        ("a", 4, "s", None, None, ("bar", None, None, ["1"], None, None)), (None, 5, "s", ["1원"], None, None),
        ("a", 6, "s", ["x" * 100_000 + " 매출 12%"], None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("number", F.lit("clash")).withColumn("quantity", F.lit("clash"))
    got = {(r.section_no, r.place, r.pos): (r.quantity, r.amount) for r in units.harmonized(df, common(spark)).collect()}
    assert got[2, "bullets", 3] == ("krw", 200_000_000_000) and got[2, "bullets", 4] == ("krw", 9_044_300_000_000)
    assert {k[2]: v for k, v in got.items() if k[0] == 3} == {0: ("krw", 5_900_000_000_000), 4: ("krw", -2_000_000), 5: ("krw", 7_000_000)}
    assert got[6, "bullets", 0] == ("rate", 1200) and not any(k[0] in (0, 1, 4, 5) for k in got)
    assert units.harmonized(spark.createDataFrame([], SCHEMA), common(spark)).count() == 0


def test_graph_resolves_linked_notations(spark):
    rows = []
    for e in range(20):
        size = 1000.0 * (e + 3)
        rows += [(f"e{e}", size, "원"), (f"e{e}", size / 1000, "grands"), (f"e{e}", size / 1000 * 1.01, "grands")]
        rows += [(f"f{e}", 5.0 + e, "grands"), (f"f{e}", (5.0 + e) / 1000, "mega"), (f"g{e}", float(e * e + 1), "noise"), (f"g{e}", 7.0, "원")]
    found = spark.createDataFrame(rows, "entity string, size double, notation string")
    got = {r.notation: (r.quantity, r.factor) for r in units.scale_graph(found, units._anchors(spark)).collect()}
    assert got["grands"] == ("krw", 1000.0) and got["mega"] == ("krw", 1e6) and "noise" not in got


def test_graph_reaches_notations_many_links_away(spark):
    chain = ["원", *(f"step{i}" for i in range(7))]
    rows = [(f"{k}-{e}", 1000.0 * (e + 3), n) for k in range(7) for e in range(4) for n in chain[k:k + 2]]
    found = spark.createDataFrame(rows, "entity string, size double, notation string")
    got = {r.notation: (r.quantity, r.factor) for r in units.scale_graph(found, units._anchors(spark)).collect()}
    assert all(got[n] == ("krw", 1.0) for n in chain)


def test_entities_are_linked_across_documents_words_and_units(spark):
    rows = []
    for e in range(50):
        name, size = f"회사{chr(0xAC00 + 28 * e)}", 3 * (e + 2)
        rows.append(("a.pdf", e, "s", [f"{name} 2023년 {1 + e % 4}분기 매출액 {size}억원 기록"], None, None))
        rows.append(("b.pdf", e, "s", [f"2023년 {1 + e % 4}분기 {name}의 매출액은 약 {size * 10} qux로 집계됨"], None, None))
    for e in range(10):  # a source that counts from elsewhere, and one whose word for a unit means something else
        rows.append(("c.pdf", e, "s", [f"회사{chr(0xAC00 + 28 * e)} 2023년 {1 + e % 4}분기 매출액 {30 * (e + 2) + 500} zed 기록"], None, None))
        rows.append(("d.pdf", e, "s", [f"회사{chr(0xAC00 + 28 * e)} 2023년 {1 + e % 4}분기 매출액 {300 * (e + 2)} qax 기록"], None, None))
        rows.append(("e.pdf", e, "s", [f"회사{chr(0xAC00 + 28 * e)} 2023년 {1 + e % 4}분기 매출액 {3000 * (e + 2)} qax 기록"], None, None))
    got = {(r.doc_id, r.section_no): (r.quantity, r.amount) for r in units.harmonized(spark.createDataFrame(rows, SCHEMA), common(spark)).collect()}
    for e in range(50):
        assert got["a.pdf", e] == got["b.pdf", e] == ("krw", 3 * (e + 2) * 10**8)
    for e in range(10):
        assert got["c.pdf", e] == got["d.pdf", e] == got["e.pdf", e] == ("krw", 3 * (e + 2) * 10**8)


def test_charts_are_linked_to_bullets_by_their_labels(spark):
    quarters = [(y, q) for y in (2021, 2022) for q in (1, 2, 3, 4)]
    rows = [("a.pdf", 0, "s", [f"가람 {y}년 {q}분기 수주잔고 {7 * i + 3}억원 기록" for i, (y, q) in enumerate(quarters)], None, None)]
    rows.append(("b.pdf", 0, "s", None, None, ("bar", "가람 수주잔고 추이", [f"{q}Q{y % 100}" for y, q in quarters], [str((7 * i + 3) * 100) for i in range(8)], None, None)))
    got = {(r.doc_id, r.pos): r.amount for r in units.harmonized(spark.createDataFrame(rows, SCHEMA), common(spark)).collect()}
    assert got == {(d, i): (7 * i + 3) * 10**8 for d in ("a.pdf", "b.pdf") for i in range(8)}


def test_unrelated_sizes_resolve_nothing(spark):
    rows = [(f"e{e}", s, float(1 + (e * e * 7919 + k * 104729) % 10_000), n) for e in range(40) for k, (s, n) in enumerate((("a", "원"), ("b", "qux")))]
    found = spark.createDataFrame(rows, "entity string, source string, size double, notation string")
    assert {r.notation for r in units.scale_graph(found, units._anchors(spark)).collect()} == set(units.conversions())
