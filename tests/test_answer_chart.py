"""Answers, summaries and charts."""

from pyspark.sql import functions as F

from inkstone.operators import answer, chart, evaluate

SPEC = "struct<chart_type:string,title:string,labels:array<string>,values:array<string>,series:array<struct<name:string,values:array<string>>>,unit:string>"


def test_context_sources_pins(spark):
    df = spark.createDataFrame([(["c1", "c2"], [("A", ["x y", "z 1~2"]), ("A", ["q"]), ("B ", ["w"])], "all" * 2000, [2, 0, 9, -1, 0])], "chunks array<string>, sections array<struct<section:string,bullets:array<string>>>, overall string, pins array<int>")
    r = df.select(
        answer.context(F.col("chunks"), F.col("sections"), F.col("overall")).alias("c"), answer.context(F.col("chunks"), F.col("sections"), F.col("overall"), True).alias("f"),
        answer.context(F.array().cast("array<string>"), None if False else F.lit(None), F.col("overall")).alias("e"), answer.sources(F.lit("z"), F.col("sections"), F.col("chunks")).alias("s"), answer.pinned(F.col("sections"), F.col("pins")).alias("p"),
    ).first()
    assert r.c == "## 원문 발췌\n\n[원문 1]\nc1\n\n[원문 2]\nc2\n\n## 요약 섹션\n\n[A]\n- x y\n- z 1~2\n\n[A]\n- q\n\n[B ]\n- w"
    assert r.f == r.e == "## 전체 요약\n\n" + ("all" * 2000)[:3000]
    assert [(s.section, s.snippet, s.full_chunk) for s in r.s] == [("A", "z 1-2", "c1"), ("B", "w", "")]
    assert [s.section for s in r.p] == ["B ", "A", "A"]


def test_ask(spark):
    rows = [(1, "매출", ["매출 증가"], [], "요약 매출"), (2, "x", [], [], ""), (3, "none", ["n"], [], "전체"), (4, "boom", ["b"], [], "o")]
    df = spark.createDataFrame(rows, "query int, question string, chunks array<string>, sections array<struct<section:string,bullets:array<string>>>, overall string")
    provider = lambda p: F.when(p.contains("boom"), None).when(p.contains("전체 요약"), "from overall").when(p.contains("none"), answer.REFUSAL).otherwise(answer.extractive(p))
    got = {r["query"]: (r.answer, r.is_answerable) for r in answer.ask(df, provider).collect()}
    assert got == {1: ("매출 증가", True), 2: (answer.REFUSAL, False), 3: ("from overall", True), 4: (answer.FAILED, False)}


def test_templates_and_budget(spark):
    r = spark.range(1).select(answer.fill("{{a}} {q} {q}", q=F.lit("{q}$1")).alias("t"), *(answer.bullet_budget(F.lit(n)).alias(f"b{n}") for n in (10, 11, 25, 26))).first()
    assert r.t == "{a} {q}$1 {q}$1" and r[1:] == (5, 8, 8, 12)


def test_summarise(spark):
    rows = [("d", 1, None, "둘째다. 또."), ("d", 0, "A", "첫째다. 다음이다. 셋째다."), ("d", 2, "B", " "), ("e", 0, "A", None)]
    got = {r.doc_id: r for r in answer.summarise(spark.createDataFrame(rows, "doc_id string, chunk_index int, section string, text string")).collect()}
    assert [s.section for s in got["d"].sections] == ["A", "(no section)"] and got["d"].overall == "첫째다.\n다음이다.\n둘째다.\n또."
    assert got["e"].overall == answer.NO_SECTIONS


def test_charts(spark):
    specs = [
        ("Bar", "t", ["a", "b", "c", "d"], ["1", " 2 ", "-3"], None, "u"), ("line", None, ["a"], ["1", "2"], None, None), ("bar", "t", ["a", "b", "c"], ["1", "x", "3"], None, None), ("none", "t", None, None, None, None),
        ("waterfall", "t", ["a", "total", "Total"], ["1.26", "2", "3"], None, None), ("multiline", "t", ["a", "b", "c"], None, [("s", ["1", "2", "3"]), ("r", ["1", "z", "3"]), (None, ["1", "2"])], None), ("odd", "t", ["a"] * 3, ["1"] * 3, None, None), (None,) * 6,
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(specs)], f"i int, s {SPEC}")
    got = {r.i: r.f for r in df.select("i", chart.route(F.col("s")).alias("f")).collect()}
    assert [i for i, f in got.items() if f] == [0, 4, 5]
    assert got[0].colours == [chart.POSITIVE, chart.POSITIVE, chart.NEGATIVE] and got[0].zero_line and got[0].labels == ["a", "b", "c"]
    assert got[4].measures == ["relative", "relative", "total"] and got[4].texts == ["+1.3", "+2.0", "3.0"]
    assert [t.name for t in got[5].traces] == ["s"]
    ranked = chart.within_budget(df.select(F.lit("d").alias("doc_id"), F.col("i").alias("section_no"), chart.route(F.col("s")).alias("figure")), 2)
    assert sorted(r.section_no for r in ranked.collect()) == [0, 4]


def test_reports(spark):
    schema = "is_image_based boolean, chunk_size int, chunk_overlap int, temperature double, type string, doc string, rougeL double, num_accuracy double, faithfulness string, completeness int"
    rows = [(True, None, 50, None, "factual", "a", 0.5, 1.0, "Faithful", 4), (False, 300, 50, 0.5, "other", "b", 0.1, 0.0, "Error", None)]
    board = evaluate.leaderboard(spark.createDataFrame(rows, schema))
    got = {(r.dimension, r.value): (r.n, r.faithful) for r in board.collect()}
    assert got["overall", ""] == (2, 1) and got["chunk_size", evaluate.DEFAULT_LABEL] == (1, 1) and ("type", "other") not in got
    assert evaluate.markdown(board).startswith("## overall")
    v = spark.createDataFrame([('so {"verdict": "Faithful", "completeness": 4} end',), ("nothing",), (None,)], "t string").select(evaluate.verdict(F.col("t")).alias("v")).collect()
    assert [r.v.verdict for r in v] == ["Faithful", "Error", "Error"]


def test_leaderboard_means_do_not_depend_on_order(spark):
    schema = "is_image_based boolean, chunk_size int, chunk_overlap int, temperature double, type string, doc string, rougeL double, num_accuracy double, faithfulness string, completeness int"
    scores = [0.1, 0.2, 0.3, 0.4, 0.7, 0.9, 0.000001, 0.4]  # the mean 0.375000125 lies halfway at eight digits
    boards = set()
    for order in [scores, scores[::-1], sorted(scores), scores[3:] + scores[:3]]:
        rows = [(True, 300, 50, 0.0, "factual", "a", s, s, "Faithful", 4) for s in order]
        r = evaluate.leaderboard(spark.createDataFrame(rows, schema).coalesce(1)).where("dimension = 'overall'").first()
        boards.add((r.rougeL, r.num_accuracy))
    assert boards == {(0.375000125, 0.375000125)}
    odd = [(True, 300, 50, 0.0, "factual", d, s, None, "Faithful", 4) for d, s in (("a", 0.5), ("b", 1e12), ("b", 3e12), ("c", float("inf")))]
    got = {r.value: (r.rougeL, r.num_accuracy) for r in evaluate.leaderboard(spark.createDataFrame(odd, schema)).where("dimension = 'doc'").collect()}
    assert got == {"a": (0.5, None), "b": (2e12, None), "c": (float("inf"), None)}


def test_leaderboard_without_records(spark):
    schema = "is_image_based boolean, chunk_size int, chunk_overlap int, temperature double, type string, doc string, rougeL double, num_accuracy double, faithfulness string, completeness int"
    board = evaluate.leaderboard(spark.createDataFrame([], schema))
    assert [tuple(r) for r in board.collect()] == [("overall", "", 0, None, None, 0, None)]
    assert evaluate.markdown(board).endswith("|  | 0 | - | - | - | - |\n")
