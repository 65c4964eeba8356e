"""Retrieval against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from inkstone.operators import retrieve


def brute(corpus, question, k):
    docs = {i: re.findall("[가-힣a-zA-Z0-9]+", t or "") for i, t in corpus}
    docs = {i: d for i, d in docs.items() if d}
    n, mean = len(docs), sum(map(len, docs.values())) / max(1, len(docs))
    df = Counter(w for d in docs.values() for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / max(1, len(idf))
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    score = {i: sum(idf.get(w, 0) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in re.findall("[가-힣a-zA-Z0-9]+", question)) for i, d in docs.items() for c in [Counter(d)]}
    return [i for i, s in sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0])) if s >= 0.1][:k]


def test_bm25(spark):
    rng = random.Random(3)
    words = ["매출", "이익", "ROE", "risk", "a1", "전망", "수요", "가격"]
    corpus = [(s, i, rng.choice(["", None]) if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.randrange(1, 15)))) for s in "ab" for i in range(12)]
    asked = [(q, s, " ".join(rng.choices([*words, "none"], k=4))) for q, s in enumerate("abab")] + [(9, "a", None), (10, "a", "")]
    got = retrieve.bm25(spark.createDataFrame(corpus, "scope string, item int, text string"), spark.createDataFrame(asked, "query int, scope string, text string")).collect()
    for q, s, t in asked:
        mine = [r.item for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])]
        assert mine == (brute([(i, x) for sc, i, x in corpus if sc == s], t, 5) if t else [])


def test_fusion(spark):
    a = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("ABC")] + [(2, "A", 1), (2, "A", 2)], "query int, text string, rank int")
    b = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("CDA")] + [(2, "B", 1)], "query int, text string, rank int")
    rows = retrieve.rrf(a, b).orderBy("query", "rank").collect()
    assert [(r.text, round(r.score, 6)) for r in rows if r["query"] == 1] == [("A", 0.032266), ("C", 0.032266), ("B", 0.016129), ("D", 0.016129)]
    assert [(r.text, round(r.score, 6)) for r in rows if r["query"] == 2] == [("A", 0.032522), ("B", 0.016393)]


def test_rerank(spark):
    rows = [(1, "x y", t, i + 1) for i, t in enumerate(["n", "x", "x y", "y z"])] + [(2, "x", t, i + 1) for i, t in enumerate(["n", "x"])]
    df = spark.createDataFrame(rows, "query int, question string, text string, rank int")
    got = retrieve.rerank(df).orderBy("query", "rank").collect()
    assert [r.text for r in got if r["query"] == 1] == ["x y", "x", "y z"]
    assert [r.text for r in got if r["query"] == 2] == ["n", "x"]
    assert [r.text for r in retrieve.rerank(df, None).where("query = 1").orderBy("rank").collect()] == ["n", "x", "x y"]


def test_dense(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).round(1)
    v[5] = v[6] = v[7]
    index = spark.createDataFrame([(i, v[i].tolist(), i % 3) for i in range(300)] + [(900, None, 0), (901, [0.0] * 8, 0)], "item long, vector array<double>, label int").repartition(5)
    queries = spark.createDataFrame([(q, v[q].tolist(), q % 3 if q else None) for q in (0, 5, 100)], "query long, vector array<double>, label int")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for must in ((), ("label",)):
        got = retrieve.dense(index, queries, 4, must).collect()
        for q in (0, 5, 100):
            s = unit @ unit[q]
            keep = [i for i in range(300) if not must or q == 0 or i % 3 == q % 3]
            want = sorted(keep, key=lambda i: (-round(s[i], 9), i))[:4]
            assert [r.item for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == want
    assert retrieve.dense(index, queries.where("false")).count() == 0


def test_index_by_collection(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, [1.0]), ("b", 2, [2.0])], "doc_id string, item int, vector array<double>")
    retrieve.write_index(rows, str(tmp_path / "x"))
    retrieve.write_index(rows.where("doc_id = 'a'").withColumn("item", F.lit(7)), str(tmp_path / "x"))
    got = spark.read.parquet(str(tmp_path / "x"))
    assert sorted((r.doc_id, r.item) for r in got.collect()) == [("a", 7), ("b", 2)]
    assert retrieve.has_collection(got, "a") and not retrieve.has_collection(got, "c")


def test_hybrid_keeps_sparse_hits_where_there_are_no_dense_ones(spark):
    sparse = spark.createDataFrame([("q1", "a", 2.0, 1), ("q1", "b", 1.0, 2), ("q2", "c", 3.0, 1)], "query string, text string, score double, rank int")
    dense = spark.createDataFrame([("q1", "b", 0.9, 1), ("q3", "d", 0.5, 1)], "query string, text string, score double, rank int")
    got = {(r.query, r.rank): (r.text, round(r.score, 6)) for r in retrieve.hybrid(sparse, dense).collect()}
    assert got == {("q1", 1): ("b", round(1 / 61 + 1 / 62, 6)), ("q1", 2): ("a", round(1 / 61, 6)), ("q2", 1): ("c", 3.0), ("q3", 1): ("d", round(1 / 61, 6))}
    assert retrieve.hybrid(sparse, None).count() == 3


def test_encoder_gets_prefixed_batches(spark):
    def encode(texts):
        assert len(texts) <= 32 and all(t.startswith("passage: ") for t in texts)
        if any("fail" in t for t in texts):
            raise RuntimeError
        return [[3.0, 4.0 if "x" in t else 0.0] for t in texts]

    rows = [(i, "x") for i in range(70)] + [(100, None), (101, " ")]
    got = {r.item: r.vector for r in retrieve.encoded(spark.createDataFrame(rows, "item int, text string").coalesce(1), encode).collect()}
    assert all([round(v, 5) for v in got[i]] == [0.6, 0.8] for i in range(70)) and got[100] is None and got[101] is None
    assert retrieve.encoded(spark.createDataFrame([(1, "fail")], "item int, text string"), encode).first().vector is None


def test_dense_search_within_scopes_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{i % 3}", i, rng.normal(size=4).tolist()) for i in range(90)] + [("s0", 900, None), ("s1", 901, [0.0] * 4)]
    index = spark.createDataFrame(rows, "scope string, item int, vector array<double>")
    queries = index.where("item % 10 = 0").select(F.col("item").alias("query"), "scope", "vector")
    got = {(r.query, r["rank"]): r.item for r in retrieve.dense_within(index, queries, 3).collect()}
    unit = {i: (s, np.array(v) / np.linalg.norm(v)) for s, i, v in rows[:90]}
    for q in range(0, 90, 10):
        best = sorted((i for i in unit if unit[i][0] == unit[q][0]), key=lambda i: -float(unit[i][1] @ unit[q][1]))[:3]
        assert [got[q, r] for r in (1, 2, 3)] == best
