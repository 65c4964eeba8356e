"""Charts of documents under the budget of the operator."""

from inkstone.operators import chart
from inkstone.plans import queries as core


def test_five_charts_of_a_document(spark, tmp_path):
    spec = "struct<chart_type:string,title:string,labels:array<string>,values:array<string>,series:array<struct<name:string,values:array<string>>>,unit:string>"
    good, bad = ("bar", "t", ["a", "b", "c"], ["1", "2", "3"], None, "u"), ("none", "t", None, None, None, None)
    rows = [("d", i, "s", ["b"], bad if i == 1 else good) for i in range(8)] + [("e", i, "s", ["b"], good) for i in range(3)]
    spark.createDataFrame(rows, f"doc_id string, section_no int, section string, bullets array<string>, chart_spec {spec}").write.parquet(f"{tmp_path}/section_summaries.parquet")
    got = [(r.doc_id, r.section_no, r.chart_no) for r in core.queries()["document_charts"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [*(("d", n, i + 1) for i, n in enumerate([0, 2, 3, 4, 5])), ("e", 0, 1), ("e", 1, 2), ("e", 2, 3)] and chart.BUDGET == 5
