"""Sparse and dense retrieval, fusion and reranking, as joins and windows.

A query only meets documents of its scope that share a term with it: postings
are joined on (scope, term), never every query with every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.text import tokens
from inkstone.runtime import materialize

K1, B, FLOOR = 1.5, 0.75, 0.25
TOP_SECTIONS, TOP_CHUNKS, TOP_RERANKED = 3, 5, 3
LEAST_SCORE, RRF_K = 0.1, 60
#: Query vectors that go to the executors at a time.
BLOCK = 2_000
#: Parts into which the items of a scope are split.
SALT = 8
#: What an encoder is told before a passage and a question, and how many texts it gets at a time.
PASSAGE, QUESTION, ENCODE_BATCH = "passage: ", "query: ", 32


def postings(corpus: DataFrame) -> DataFrame:
    """(scope, item, term, tf, len): counts of terms; items without terms are no part of the corpus."""
    terms = corpus.where("text is not null").select("scope", "item", tokens(F.col("text")).alias("_t")).where(F.size("_t") > 0)
    return terms.select("scope", "item", F.size("_t").alias("len"), F.explode("_t").alias("term")).groupBy("scope", "item", "len", "term").agg(F.count("*").alias("tf"))


def statistics(posts: DataFrame) -> DataFrame:
    """(scope, term, idf, avg_len): a negative idf becomes a quarter of the mean idf of the scope."""
    items = posts.select("scope", "item", "len").distinct().groupBy("scope").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    df = posts.groupBy("scope", "term").agg(F.count("*").alias("df")).join(items, "scope")
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("scope").agg(F.avg("raw").alias("mean"))  # one row a scope, so a scope of many terms is split
    return raw.join(mean, "scope").select("scope", "term", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "avg_len")


def bm25(corpus: DataFrame, queries: DataFrame, k: int = TOP_CHUNKS, least: float = LEAST_SCORE) -> DataFrame:
    """(query, scope, item, score, rank): the best items of each query's scope.

    ``corpus`` has scope, item, text; ``queries`` query, scope, text.  Repeated
    terms of a query count repeatedly.  Scores below ``least`` are dropped, ties
    go to the lesser item.  Null texts match nothing.
    """
    posts = materialize(postings(corpus), "postings")  # read for the statistics and for the match
    asked = queries.where("text is not null").select("query", "scope", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query", "scope", "term").agg(F.count("*").alias("qn"))
    weight = F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = asked.join(posts, ["scope", "term"]).join(statistics(posts), ["scope", "term"]).groupBy("query", "scope", "item").agg(F.sum(weight).alias("score"))
    return top(scored.where(F.col("score") >= least), k)


def top(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """The ``k`` best items of each query with their rank from 1."""
    best = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), *(ties or ("item",)))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def dense(index: DataFrame, queries: DataFrame, k: int = TOP_CHUNKS, must: tuple[str, ...] = ()) -> DataFrame:
    """(query, item, score, rank) by cosine, exactly, every query against every vector.

    ``index`` has item, vector and the columns of ``must``; ``queries`` query,
    vector and the same columns, which must agree, null meaning no filter.
    Queries go out in blocks of ``BLOCK`` rows; each task multiplies its vectors
    with a block and keeps the ``k`` best per query, so a shuffle carries at most
    k rows per query and task.  Null and zero vectors match nothing.
    """
    kind_i, kind_q = (x.schema[c].dataType.simpleString() for x, c in ((index, "item"), (queries, "query")))
    rows = queries.where("vector is not null").select("query", "vector", *must)
    out, block = None, []

    def search(block: list) -> DataFrame:
        ids = [r[0] for r in block]
        q = np.array([r[1] for r in block], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        wanted = [[r[2 + j] for r in block] for j in range(len(must))]
        sent = index.sparkSession.sparkContext.broadcast((ids, q, wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, wanted = sent.value
            best: dict[int, list] = {}
            for batch in batches:
                items = batch.column(0).to_pylist()
                v = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(items), -1)
                norm = np.linalg.norm(v, axis=1)
                scores = q @ (v / np.maximum(norm, 1e-300)[:, None]).T
                scores[:, norm == 0] = -np.inf
                for j, w in enumerate(wanted):
                    have = np.array(batch.column(2 + j).to_pylist(), object)
                    for i, x in enumerate(w):
                        if x is not None:
                            scores[i, have != x] = -np.inf
                m = min(k, len(items))
                order = np.argpartition(-scores, m - 1, axis=1)[:, :m] if m < len(items) else np.tile(np.arange(len(items)), (len(ids), 1))
                # rows that tie with the last place of a batch are kept, for the tie is decided by item
                for i in range(len(ids)):
                    edge = scores[i, order[i]].min()
                    near = np.flatnonzero(scores[i] >= edge) if np.isfinite(edge) else order[i][np.isfinite(scores[i, order[i]])]
                    best.setdefault(i, []).extend((-float(scores[i, j]), items[j]) for j in near)
                    best[i] = sorted(best[i])[:k]
            found = [(ids[i], item, -s) for i, hits in best.items() for s, item in hits]
            yield pa.RecordBatch.from_pylist([dict(zip(("query", "item", "score"), x, strict=True)) for x in found], schema=schema)

        import pyspark.sql.pandas.types as spark_types
        from pyspark.sql.types import StructType

        schema = spark_types.to_arrow_schema(StructType.fromDDL(f"query {kind_q}, item {kind_i}, score double"))
        return index.where("vector is not null").select("item", "vector", *must).mapInArrow(run, f"query {kind_q}, item {kind_i}, score double")

    for row in rows.toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            out = search(block) if out is None else out.unionByName(search(block))
            block = []
    if block or out is None:
        last = search(block or [(None, [0.0], *(None for _ in must))]) if block else index.sparkSession.createDataFrame([], f"query {kind_q}, item {kind_i}, score double")
        out = last if out is None else out.unionByName(last)
    return top(out, k)


def dense_within(index: DataFrame, queries: DataFrame, k: int = TOP_CHUNKS) -> DataFrame:
    """(query, scope, item, score, rank) by cosine within the query's scope, as ``dense`` but joined on it.

    ``index`` has scope, item, vector; ``queries`` query, scope, vector.  Items of
    a scope go to a task in the blocks of one hash, each with all queries of the
    scope, and leave k rows per query and block.
    """
    salted = index.where("vector is not null").select("scope", "item", "vector", F.pmod(F.xxhash64("item"), F.lit(SALT)).alias("_salt"))
    asked = queries.where("vector is not null").select("query", "scope", F.col("vector").alias("_q")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    norm = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    both = F.aggregate(F.zip_with("vector", "_q", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    scored = salted.join(asked, ["scope", "_salt"]).select("query", "scope", "item", (both / F.nullif(F.sqrt(norm(F.col("vector")) * norm(F.col("_q"))), F.lit(0.0))).alias("score"))
    return top(scored.where("score is not null"), k)


def rrf(*lists: DataFrame, k: int = TOP_CHUNKS) -> DataFrame:
    """(query, text, score, rank): fusion of ranked lists of (query, text, rank) by sums of 1 / (60 + rank).

    Items are the same if their texts are.  Ties go by first appearance, earlier
    lists first; a text that stands twice in one list counts twice.
    """
    every = None
    for i, x in enumerate(lists):
        part = x.select("query", "text", "rank", F.lit(i).alias("_list"))
        every = part if every is None else every.unionByName(part)
    return fused(every, k)


def fused(every: DataFrame, k: int = TOP_CHUNKS) -> DataFrame:
    """``rrf`` of lists that stand in one table of (query, text, rank, _list)."""
    sums = every.groupBy("query", "text").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.min(F.struct("_list", "rank")).alias("_first"))
    best = Window.partitionBy("query").orderBy(F.round("score", 12).desc(), "_first")
    return sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("_first")


def hybrid(sparse: DataFrame, dense_hits: DataFrame | None, k: int = TOP_CHUNKS) -> DataFrame:
    """(query, text, score, rank): sparse hits, fused with the dense ones of the queries that have any.

    Both have query, text, score and rank.  A query without dense hits keeps its
    sparse ones as they are, and so do all without a dense side; a query without
    sparse hits has the dense ones alone, fused with nothing.
    """
    if dense_hits is None:
        return sparse.where(F.col("rank") <= k).select("query", "text", "score", "rank")
    asked = dense_hits.select("query").distinct()
    alone = sparse.join(asked, "query", "left_anti").where(F.col("rank") <= k).select("query", "text", "score", "rank")
    return rrf(sparse.join(asked, "query", "left_semi"), dense_hits, k=k).select("query", "text", "score", "rank").unionByName(alone)


def encoded(rows: DataFrame, encode: Callable[[list[str]], np.ndarray], prefix: str = PASSAGE, batch: int = ENCODE_BATCH) -> DataFrame:
    """``rows`` with the column vector: the normalised vectors that an encoder gives for their texts, each with the prefix in front.

    The encoder gets lists of at most ``batch`` texts and gives one row of numbers
    for each.  Null and blank texts, and texts whose batch fails, have no vector;
    a zero vector stays zero.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    schema = StructType([*(f for f in rows.schema.fields if f.name != "vector"), StructField("vector", ArrayType(FloatType()))])
    target = to_arrow_schema(schema)
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = part.column(at).to_pylist()
            full = [i for i, t in enumerate(texts) if t and not t.isspace()]
            out: list[list[float] | None] = [None] * len(texts)
            for k in range(0, len(full), batch):
                try:
                    v = np.asarray(encode([prefix + texts[i] for i in full[k:k + batch]]), np.float64)
                except Exception:  # noqa: BLE001 - a failed call leaves its rows without a vector
                    continue
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                for i, x in zip(full[k:k + batch], v.tolist(), strict=True):
                    out[i] = x
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(pa.float32()))], names=schema.names).cast(target)

    return rows.select(*(n for n in schema.names if n != "vector")).mapInArrow(run, schema)


def hashed_terms(texts: list[str], dim: int = 256) -> np.ndarray:
    """Default encoder, where no model is: counts of terms by hash."""
    out = np.zeros((len(texts), dim))
    for i, text in enumerate(texts):
        for t in re.findall("[가-힣a-zA-Z0-9]+", text):
            out[i, zlib.crc32(t.encode()) % dim] += 1
    return out


def lexical_score(question: Column, text: Column) -> Column:
    """Share of the question's distinct terms that stand in the text; the scorer used where no model is."""
    q = F.array_distinct(tokens(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


def rerank(hits: DataFrame, score: Callable[[Column, Column], Column] | None = lexical_score, k: int = TOP_RERANKED) -> DataFrame:
    """(query, text, rank) of (query, question, text, rank) ordered anew by a scorer.

    With at most ``k`` candidates, or without a scorer, the given order stays;
    null scores come last in the given order.
    """
    n = F.count("*").over(Window.partitionBy("query"))
    s = score(F.col("question"), F.col("text")) if score else F.lit(None).cast("double")
    marked = hits.withColumn("_s", F.when(n > k, F.round(s, 9)))
    best = Window.partitionBy("query").orderBy(F.col("_s").desc_nulls_last(), "rank")
    return marked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "text", "rank")


def collection(doc_id: Column) -> Column:
    """Name of a document's collection of vectors."""
    return F.concat(F.lit("doc_"), F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8))


def write_index(vectors: DataFrame, path: str) -> None:
    """Write vectors by collection; collections that are written again replace the old ones, others stay."""
    vectors.withColumn("collection", collection(F.col("doc_id"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def has_collection(index: DataFrame, doc_id: str) -> bool:
    """Whether an index has vectors of a document; prunes to one partition."""
    return not index.where(F.col("collection") == collection(F.lit(doc_id))).isEmpty()
