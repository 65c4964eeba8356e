"""Pairs, conversations and reading levels."""

import random

from pyspark.sql import functions as F

from inkstone.llm import conversations, pairs, reading

STEPS = "id string, threadId string, type string, parentId string, output string, createdAt string, input string, start_at string, end_at string"


def step(i, thread, kind, parent=None, out="text", at="2024-01-01T00:00:00Z", inp=None):
    return (i, thread, kind, parent, out, at, inp, at, None)


def test_conversations(spark):
    rows = [
        step("g", "t1", "assistant_message", None, "hi", "2024-01-01T00:00:00Z"), step("u1", "t1", "user_message", None, "q1", "2024-01-01 09:00:05+09:00"), step("r1", "t1", "run", "u1", None, None), step("l1", "t1", "llm", "r1"),
        step("a1", "t1", "assistant_message", "l1", "one", "2024-01-01T00:00:04.999Z"), step("a2", "t1", "assistant_message", "r1", "two", "2024-01-01T00:00:09Z"), step("u2", "t1", "user_message", None, "q2", "2023-12-31T19:00:06-05:00"), step("a3", "t1", "assistant_message", "u2", "three", "2024-01-01T00:00:07.000001Z"), step("e", "t1", "assistant_message", "u2", " … ", "2024-01-01T00:00:08Z"),
        step("a3", "t1", "assistant_message", "u2", "three", "2024-01-01T00:00:07.000001Z"),
        step("v1", "t2", "user_message"), step("b1", "t2", "assistant_message", "gone"), step("v2", "t3", "user_message"), step("w1", "t4", "user_message"), step("c1", "t4", "assistant_message", "w1"), step("x", "t4", "run", "y"), step("y", "t4", "llm", "x"),
        step("z1", "t5", "user_message"), step("z2", "t5", "assistant_message", "z1"), step("q", "t6", "assistant_message"), step("k1", "t7", "user_message"), step("k2", "t7", "assistant_message", "u1"), step("k3", "t7", "assistant_message", "k1"),
        step("m1", "t8", "user_message", None, "?!"), step("m2", "t8", "assistant_message", "m1"), (None,) * 9,
    ]
    rows += [step("c0", "t9", "user_message"), *(step(f"c{i}", "t9", "run", f"c{i - 1}") for i in range(1, 60)), step("end", "t9", "assistant_message", "c59")]
    random.Random(1).shuffle(rows)
    threads = spark.createDataFrame([(f"t{i}",) for i in (1, 2, 3, 4, 6, 7, 8, 9)] + [("t1",), (None,), ("empty",)], "id string").withColumn("position", F.lit("clash"))
    df = spark.createDataFrame(rows, STEPS).withColumn("root", F.lit("clash")).withColumn("role", F.lit("clash"))
    got = sorted(tuple(r) for r in conversations.found(df, threads).collect())
    assert got == [("t1", i, m, r) for i, (m, r) in enumerate([("g", "assistant"), ("u1", "user"), ("a1", "assistant"), ("a2", "assistant"), ("u2", "user"), ("a3", "assistant")])] + [("t9", 0, "c0", "user"), ("t9", 1, "end", "assistant")]
    assert conversations.found(df.where("false"), threads).count() == 0


def test_instants(spark):
    cases = {"2024-01-01T00:00:00Z": 0, "2024-01-01 09:00:00.5+09:00": 500_000, "2023-12-31T19:00:00.000001-0500": 1, "2024-01-01T00:00": 0, "2024-01-01T00:00:00.123456789Z": 123_456, "x": None, "": None, None: None}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", conversations.instant(F.col("t")).alias("m")).orderBy("i").collect()
    base = 1_704_067_200_000_000
    assert [None if r.m is None else r.m - base for r in rows] == list(cases.values())


def test_events_of_one_step_are_folded(spark):
    t = "2024-01-01T00:00:0{}Z".format
    event = lambda i, kind, parent, out, created, start=None, end=None: (i, "t", kind, parent, out, created, None, start, end)
    rows = [
        event("u", "user_message", None, "first wording", t(0), t(0), t(0)), event("u", "user_message", None, "edited wording", t(0), t(3), t(3)),
        event("a", "assistant_message", "u", "first try", t(1), t(1), t(2)), event("a", "assistant_message", "u", "second try", t(1), t(4), t(5)),
        event("b", "assistant_message", "u", "deleted", t(2), t(2), t(3)), event("b", "assistant_message", "u", "", t(2), t(6)),  # no end
        event("c", "assistant_message", "u", "deleted too", t(3), t(3), t(3)), event("c", "assistant_message", "u", None, t(7)),  # only its own time
        event("d", "assistant_message", "u", "x", "2024-01-01T00:00:08.000000200Z"), event("e", "assistant_message", "u", "y", "2024-01-01T00:00:08.000000100Z"),
    ]
    threads = spark.createDataFrame([("t",)], "id string")
    for order in (rows, rows[::-1]):
        got = conversations.conversations(spark.createDataFrame(order, STEPS), threads).orderBy("position").collect()
        assert [(r.id, r.text) for r in got] == [("u", "edited wording"), ("a", "second try"), ("e", "y"), ("d", "x")]
    # a deletion of the only answer leaves the question without one
    assert conversations.found(spark.createDataFrame([rows[0], *rows[4:6]], STEPS), threads).count() == 0


def test_pair_defects(spark):
    good = ["The margin of the firm rose by 3.2% in the quarter.", "Sales of the unit fell because of weak demand.", "이익은 10억원으로 증가하였다. 수요는 회복될 전망이다.", "매출이 늘었고 등급은 A3로 유지되었다."]
    cases = {
        "e1": ("q", None, "empty"), "e2": ("q", " …\u200b", "empty"), "e3": ("q", "``````", "empty"), "c1": ("전망을 알려줘", "질문: 전망을  알려줘\n", "copy"), "c2": ("What are the risks of the firm?", "WHAT ARE THE RISKS OF THE FIRM...", "copy"), "c3": ("Which of the risks?", "Which of the risks?\nWhich of the risks?", "copy"),
        "l1": ("전망을 알려줘", good[0], "language"), "l2": ("What is the outlook for the firm?", good[2], "language"), "l3": ("전망을 알려줘 영어로 답해 줘.", good[0], None), "l4": ("전망을 알려줘", "売上高は前年同期比で増加しました。", "language"),
        "r1": ("전망은?", "해당 요청에는 답변드릴 수 없습니다.", "refusal"), "r2": ("What is the outlook?", "Sorry, I can't help with that request.", "refusal"), "r3": ("전망은?", "확정치는 아직 비교할 수 없습니다만, 잠정치는 5억원입니다.", None), "r4": ("What is the outlook?", "Sorry for the earlier mix-up. The margin of the firm rose by 2%.", None),
        "t1": ("전망은?", "이익은 10억원으로 증가하였다. 수요는 회복", "truncated"), "t2": ("전망은?", "매출이 늘었고 (단위: 억", "truncated"), "t3": ("전망은?", "원인은 둘이다.\n1. 환율\n2.", "truncated"), "t4": ("전망은?", "증가율은 24.", "truncated"), "t5": ("전망은?", "| 구분 | 값 |\n|---|---|\n| 매출 | 1", "truncated"),
        "t6": ("전망은?", "매출이 늘었고 등급은 A3로 유지되었다", None), "t7": ("전망은?", "| 구분 | 값 |\n|---|---|\n| 매출 | 10 |", None), "t8": ("전망은?", "수요는 회복될 전망이다\n출처: 실적 요약", None), "long": ("전망은?", "수요는 회복될 전망이다. " * 20_000, None), "n": (None, good[0], None),
    }
    rows = [(k, "llm", q, a) for k, (q, a, _) in cases.items()] + [(f"g{i}", "llm", "전망은?" if i % 4 > 1 else "What is the outlook for it?", good[i % 4]) for i in range(80)] + [("c1", "llm", *cases["c1"][:2]), (None, "llm", "q", None), ("run", "run", "q", None)]
    df = spark.createDataFrame(rows, "id string, type string, input string, output string").withColumn("defect", F.lit("clash")).withColumn("context", F.lit(1))
    got = sorted((r.id, r.defect) for r in pairs.defects(df).collect())
    assert got == sorted((k, d) for k, (_, _, d) in cases.items() if d)
    assert pairs.defects(df.where("false")).count() == 0


def test_copies_are_found_by_what_compression_leaves():
    q = "What was the profit of the third quarter of 2023, and why did it fall?"
    for copy in (q.replace("profit", "proflt"), "Q: " + q, q + "\n" + q, q.upper(), "질문: " + q, q[:-6]):
        assert pairs.is_copy(q, copy), copy
    for answer in (q.replace("2023", "2024"), "The profit of the third quarter of 2023 fell because of weak demand.", q + " It fell because of weak demand in the third quarter.", "x"):
        assert not pairs.is_copy(q, answer), answer
    assert pairs.is_copy("왜?", "왜") and not pairs.is_copy("몇?", "셋") and not pairs.is_copy("abc", "abd") and not pairs.is_copy("", "")
    assert pairs.is_copy("2023년 매출액은 얼마인가요?", "2023년  매출액은 얼마인가요") and not pairs.is_copy("2023년 매출액은 얼마인가요?", "2023년 매출액은 12억원입니다.")
    assert pairs.remainder(b"abcdefgh" * 9, b"abcdefgh" * 9) == 0 < pairs.remainder(b"abcdefgh" * 9, b"quite another text than this")


def test_languages_of_pairs():
    texts = {
        "en": "The sales of the firm rose because of the strong demand in this quarter.", "fr": "Les ventes de la société sont plus fortes que dans une année avec du retard.", "de": "Der Umsatz ist in dem Quartal mit den Kunden auf eine neue Höhe gestiegen.",
        "es": "Las ventas de la empresa son más altas que en el año con los clientes.", "ko": "수요가 늘어 매출이 증가하였다.", "ja": "売上高は前年同期比で増加しました。", "zh": "公司营业收入同比增长百分之十。",
    }
    for a, x in texts.items():
        assert pairs.language(x) == a
        for b, y in texts.items():
            assert pairs.wrong_language(x, y) == (a != b), (a, b)
    assert not pairs.wrong_language("Quelles sont les ventes de la société? Réponds en espagnol: in spanish", texts["es"]) and not pairs.wrong_language(texts["de"] + " auf deutsch in french", texts["fr"])


def test_prose():
    text = "% no\n\\documentclass{a}\\newcommand{\\x}{bad words here}\n\\title{Bad title here}\\begin{document}\\maketitle\n\\section{Bad}\nThe first one, \\emph{really}~\\cite{a} $x=1$ is h\\'er\\'e.\n\\begin{comment}\nBad draft text.\n\\end{comment}\\iffalse bad text \\fi\n%% bad\nSecond one.\\footnote{bad note} \\[ bad math \\]\n\\begin{figure}bad\\caption{bad one}\\end{figure}\\end{document} bad tail"
    assert reading.prose(text) == [["the", "first", "one", "really", "is", "here"], ["second", "one"]]
    for t in (None, "", " \n", "% withdrawn x", "\\include{a}", "\\newcommand{\\a}{}\n\\begin{document}\n\\end{document}", "\\begin{comment} bad text here"):
        assert reading.prose(t) == []
    assert reading.prose("h\u00e9r\u00e9 it is. ") == [["here", "it", "is"]]


def corpus(rng, n):
    easy, hard = ["cat", "dog", "sun", "tree", "runs", "big", "red", "old"], ["parametrization", "heterogeneity", "asymptotically", "irreducible", "covariance", "notwithstanding"]
    rows = []
    for i in range(n):
        level = 1 + i % 4
        sentences = [" ".join(rng.choice(hard if rng.random() < (level - 1) * 0.27 + 0.05 else easy) for _ in range(rng.randrange(3, 6 + 4 * level))) for _ in range(12)]
        rows.append((i, level, "\\begin{document}\n" + ". ".join(s.capitalize() for s in sentences) + ".\n\\end{document}"))
    return rows


def test_levels_of_held_out_documents(spark):
    rows = corpus(random.Random(3), 400)
    docs = spark.createDataFrame([(i, t) for i, _, t in rows] + [(1000, None), (1001, ""), (1002, "% x"), (1003, "word " * 100_000 + ".")], "doc_id long, text string").withColumn("level", F.lit("clash")).withColumn("_level", F.lit(0))
    labels = spark.createDataFrame([(i, level, "r1") for i, level, _ in rows[:200]] + [(3, 3, "r2"), (None, 1, "r"), (7, None, "r"), (8, 9, "r")], "doc_id long, level int, rater string")
    got = {r.doc_id: r.level for r in reading.found(docs, labels).collect()}
    held = rows[200:]
    assert sum(got[i] == level for i, level, _ in held) / len(held) > 0.9
    assert not {1000, 1001, 1002} & set(got) and got[1003] in reading.LEVELS
    assert len(reading.found(docs.where("doc_id < 5"), labels.where("false")).collect()) == 5
    assert reading.found(docs.where("false"), labels).count() == 0


def test_stray_signs_cut_nothing_off():
    rest = [["the", "rest", "of", "it", "stays", "here"]]
    for stray in ("$$ 5 to make. ", "\\[ 5 to make. ", "$ 5 to make. "):
        assert reading.prose(f"It cost {stray}The rest of it stays here.")[1:] == rest, stray
    assert reading.prose("\\begin{equation} a = b\n\nThe rest of it stays here.") == rest
    assert reading.prose("\\begin{comment} bad text\n\nmore bad text \\end{comment} The rest of it stays here.") == rest
    assert reading.prose("One costs $$ 5 now.\n\nAnother one, $x$, of $$ a\n b $$ too.") == [["one", "costs", "now"], ["another", "one", "of", "too"]]
