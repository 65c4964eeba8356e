"""Queries over the data tables by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import conversations, packing, pairs, reading, scan_repair, source_lines, split, tokens
from inkstone.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.found(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "issuers"))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_repair.scan_repaired(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "issuers"))
    return rows.groupBy("doc_id", "chunk_index").agg(F.min("text").alias("text"))  # of differing versions the first by text


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.found(table(spark, sf_dir, "chunks"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_chunks(table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(table(spark, sf_dir, "steps"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.found(table(spark, sf_dir, "steps"), table(spark, sf_dir, "threads"))


def p5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(table(spark, sf_dir, "steps"), table(spark, sf_dir, "threads"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = source_lines.repeated_lines(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "issuers"))
    return lines.select("doc_id", "chunk_index", "line_no")


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_lines.without_source_lines(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "issuers")).select("doc_id", "chunk_index", "text")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per container: number of parts and tokens in it."""
    return p8_packed(spark, sf_dir).groupBy("container").agg(F.count("*").alias("parts"), F.sum("size").alias("tokens"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "readinglabels"))


def queries() -> dict[str, Query]:
    named = (p1_found, p1_repaired, p3_found, p3_pieces, p4_found, p5_found, p5_conversations, p6_found, p6_cleaned, p7_ids, p8_packed, p8_fill, p9_found)
    return {q.__name__: q for q in named}
