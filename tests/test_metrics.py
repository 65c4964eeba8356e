"""Scores against documented values and brute force."""

import random
import re

from pyspark.sql import functions as F

from inkstone.operators import metrics


def test_numbers(spark):
    cases = {
        "1,606억원(-19.7%, OPM 7.4%)": ["1606억원", "-19.7%", "7.4%"], "북미 딜러 재고는 3.0~3.5개월 수준이다.": ["3.0~3.5개월"], "2026년 3월 기준 영업이익은 1606억원이다.": ["1606억원"],
        "매출 1606.25 달성": [], "총 10. 그리고 10": ["10.", "10"], "9조 3,132억원": ["9", "3132억원"], "a, b, c": [], "12/31 마감 5bp 상승 +3.3%p": ["5bp", "+3.3%p"], "": [],
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", metrics.numbers(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == list(cases.values())
    m = spark.createDataFrame([("1분기 영업이익은 1606억원이며 OPM은 7.4%입니다.", "1,606억원(-19.7%, OPM 7.4%)")], "p string, r string").select(metrics.number_match(F.col("p"), F.col("r")).alias("m")).first().m
    assert (m.accuracy, m.matched, m.missed) == (0.6667, ["1606억원", "7.4%"], ["-19.7%"])


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b):
            row[j + 1] = prev[j] + 1 if x == y else max(prev[j + 1], row[j])
    return row[-1]


def test_rouge(spark):
    rng = random.Random(5)
    pairs = [(" ".join(rng.choices("abcde", k=rng.randrange(0, 9))), " ".join(rng.choices("abcdef", k=rng.randrange(0, 9)))) for _ in range(60)] + [(None, "a"), ("a", None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p string, r string")
    rows = df.select("i", metrics.rouge_n(F.col("p"), F.col("r"), 1).alias("r1"), metrics.rouge_n(F.col("p"), F.col("r"), 2).alias("r2"), metrics.rouge_l(F.col("p"), F.col("r")).alias("l")).orderBy("i").collect()
    f = lambda o, a, b: 2 * (o / a) * (o / b) / (o / a + o / b) if o else 0.0
    for r, (p, q) in zip(rows, pairs, strict=True):
        a, b = re.findall(r"\w+", p or ""), re.findall(r"\w+", q or "")
        grams = lambda x, n: [tuple(x[i:i + n]) for i in range(len(x) - n + 1)]
        for n, got in ((1, r.r1), (2, r.r2)):
            x, y = grams(a, n), grams(b, n)
            assert abs(got - f(sum(min(x.count(g), y.count(g)) for g in set(x)), len(x), len(y))) < 6e-5
        assert abs(r.l - f(lcs(a, b), len(a), len(b))) < 6e-5


def test_entities_similarity_tokens(spark):
    df = spark.createDataFrame([("매출 1,000원 증가", "매출은 1000원 수준", None), ("", "x", None), ("abc", "1 2", ["abc", "zz"]), ("x", "...", None)], "p string, r string, k array<string>").withColumn("i", F.monotonically_increasing_id())
    rows = df.select("i", metrics.entity_coverage(F.col("p"), F.col("r"), F.col("k")).alias("e")).orderBy("i").collect()
    assert [(r.e.coverage, r.e.total) for r in rows] == [(0.5, 2), (0.0, 0), (0.5, 2), (1.0, 0)]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>").select(metrics.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in v] == [0.7071, 0.0, None]
    t = spark.createDataFrame([(1, "p", 0, [1.0, 0.0]), (1, "p", 1, [0.0, 1.0]), (1, "r", 0, [1.0, 0.0])], "pair int, side string, token_no int, vector array<double>")
    b = metrics.bert_score(t).first()
    assert (b.precision, b.recall, b.f1) == (0.5, 1.0, 0.6667)
