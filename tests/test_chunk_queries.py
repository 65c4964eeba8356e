"""Cleaning queries on the chunks against a plain restatement of every text."""

import re

import pytest

from inkstone.plans import queries as core

DATA = "/root/testdata/sf0.001"


def tables(text):
    text = text.replace("<br>", "\n").replace("<br/>", "\n").replace("<br />", "\n")
    seen, kept = set(), []
    for part in re.split(r"(?=\n\|)", text):
        rows = [x for x in part.strip().splitlines() if "|" in x]
        key = re.sub(r"[|*\s]", "", rows[0])[:60] if rows else part.strip()[:120]
        if key not in seen:
            seen.add(key)
            kept.append(part)
    return "".join(kept)


def tildes(text):
    return re.sub(r"(\d+\.?\d*)~+(\d+\.?\d*)", r"\1-\2", text)


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    """The chunks of the smallest data and two with rows twice."""
    at = str(tmp_path_factory.mktemp("chunks"))
    rows = spark.read.parquet(f"{DATA}/chunks.parquet").select("doc_id", "section", "chunk_index", "text")
    more = spark.createDataFrame([("made", "s", 0, "a<br>b\n| x | 1 |\n| x | 1 |\n|*x*| 1 |\n３.０~~３.５"), ("made", "s", 1, "| x | 1 |"), ("made", "s", 2, None)], rows.schema)
    rows.unionByName(more).write.parquet(f"{at}/chunks.parquet")
    return at


@pytest.mark.parametrize("name, restated", [("br_table_dedup_chunks", tables), ("tilde_fix_chunks", tildes)])
def test_every_chunk(spark, chunks, name, restated):
    texts = {(r.doc_id, r.chunk_index): r.text for r in core._chunks(spark, chunks).collect()}
    got = {(r.doc_id, r.chunk_index): r.text for r in core.queries()[name](spark, chunks).collect()}
    assert got == {k: t if t is None else restated(t) for k, t in texts.items()}
    assert got["made", 0] != texts["made", 0]
