"""Texts above a size limit cut into pieces at natural boundaries.

The cut is content-defined.  A rolling hash over the text gives every place a
value that depends on the letters before it alone.  The landmark of a stretch
that is too long is the place of the least value in it, outside the least size
at both ends; the stretch is cut at the natural boundary nearest to its
landmark, of the best kind that it has, and both parts are treated alike.  Where
a cut falls so depends on what stands around it and not on where the text
begins, and an edit alters only the pieces next to it.  Every piece is a span of
the text: the spans cover it, consecutive ones overlap, and taking the overlaps
out gives the text back.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP, LEAST = 700, 200, 420
#: Width of the rolling hash.
WINDOW = 16
_BLOCK = 4096

_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]]*(?:\s+|(?=[^\W\d_]))|。")
_SPACE = re.compile(r"\s+")
_KINDS = (_PARAGRAPH, _LINE, _SENTENCE, _SPACE)


def values(text: str) -> np.ndarray:
    """A value for every place of a text, from a rolling hash of the characters before it; the greatest where there are too few."""
    out = np.full(len(text) + 1, np.iinfo(np.uint64).max, np.uint64)
    if len(text) < WINDOW:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    base, mult = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(len(codes) - WINDOW + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW - 1, -1, -1):  # a polynomial over the window, for all places at once
            h += (codes[k:k + len(h)] + np.uint64(1)) * base
            base *= mult
        h = (h ^ (h >> np.uint64(29))) * mult
    out[WINDOW:] = h >> np.uint64(8)
    return out


def cuts(text: str, greatest: int, least: int, first: int) -> list[int]:
    """Places to cut a text so that no part is longer than ``greatest``, the first part than ``first``, and none shorter than ``least``."""
    n = len(text)
    kinds = [[m.end() for m in kind.finditer(text)] for kind in _KINDS]
    h, out, open_ = values(text), [], [(0, n)]
    while open_:
        a, z = open_.pop()
        if z - a <= (greatest if a else first):
            continue
        low, high = a + least, z - least
        goal = low + int(np.argmin(h[low:high + 1]))
        at = goal
        for kind in kinds:
            i, j = bisect_left(kind, low), bisect_right(kind, high)
            if i < j:
                k = bisect_left(kind, goal, i, j)
                at = min(kind[max(i, k - 1):min(j, k + 1)], key=lambda p: (abs(p - goal), -p))
                break
        out.append(at)
        open_ += [(a, at), (at, z)]
    return sorted(out)


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int]]:
    """The spans of the pieces, in order; one span for a text within the limit.

    Kinds of boundary from best to worst: blank line, end of line, end of
    sentence, white space; a stretch without any of them is cut at its landmark.
    The next piece begins at the boundary nearest to ``overlap`` before the cut
    that is not farther from it; where there is none, exactly there.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    ends = [*cuts(text, limit - overlap, least - overlap, limit), n]
    every = sorted({m.end() for kind in _KINDS for m in kind.finditer(text)})
    out = [(0, ends[0])]
    for end, following in zip(ends, ends[1:]):
        k = bisect_left(every, end - overlap)
        out.append((every[k] if k < len(every) and every[k] < end else end - overlap, following))
    return out


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(doc_id, chunk_index, section, piece_no, n_pieces, start, text): every chunk's pieces.

    Repeated rows come out once, of differing ones the first by text.  Null
    texts are one null piece; empty and short texts are one piece, unchanged.
    Rows without doc_id or chunk_index are left out.
    """
    if not 0 <= overlap < least or 2 * (least - overlap) > limit - overlap:
        raise ValueError("0 <= overlap < least, and two least steps must fit between limit and overlap")
    rows = (
        chunks.where("doc_id is not null and chunk_index is not null")
        .groupBy("doc_id", "chunk_index").agg(F.min(F.struct("text", "section")).alias("r"))
        .select("doc_id", "chunk_index", "r.section", "r.text")
    )
    long = F.length("text") > limit
    short = rows.where(F.coalesce(~long, F.lit(True))).select("doc_id", "chunk_index", "section", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, no, of, at, cut = [], [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                found = spans(text, limit, overlap, least)
                for k, (a, z) in enumerate(found):
                    take.append(i)
                    no.append(k)
                    of.append(len(found))
                    at.append(a)
                    cut.append(text[a:z])
            rows = batch.select(["doc_id", "chunk_index", "section"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(no, pa.int32()), pa.array(of, pa.int32()), pa.array(at, pa.int32()), pa.array(cut, pa.string())], ["doc_id", "chunk_index", "section", "piece_no", "n_pieces", "start", "text"])

    cut = rows.where(long).mapInArrow(run, "doc_id string, chunk_index int, section string, piece_no int, n_pieces int, start int, text string")
    return short.unionByName(cut)


def renumbered(parts: DataFrame) -> DataFrame:
    """``pieces`` with chunk_index from 0 in each document; the old one stays as source_index.

    Positions come from sums over blocks of chunks, so no task holds a whole document.
    """
    sizes = parts.where("piece_no = 0").select("doc_id", "chunk_index", "n_pieces", F.floor(F.col("chunk_index") / _BLOCK).alias("_block"))
    blocks = sizes.groupBy("doc_id", "_block").agg(F.sum("n_pieces").alias("_n"))
    before = blocks.select("doc_id", "_block", (F.sum("_n").over(Window.partitionBy("doc_id").orderBy("_block")) - F.col("_n")).alias("_before"))
    inside = sizes.select("doc_id", "_block", "chunk_index", (F.sum("n_pieces").over(Window.partitionBy("doc_id", "_block").orderBy("chunk_index")) - F.col("n_pieces")).alias("_inside"))
    first = inside.join(before, ["doc_id", "_block"]).select("doc_id", "chunk_index", (F.col("_inside") + F.col("_before")).alias("_first"))
    return parts.join(first, ["doc_id", "chunk_index"]).select("doc_id", "section", (F.col("_first") + F.col("piece_no")).cast("int").alias("chunk_index"), F.col("chunk_index").alias("source_index"), "piece_no", "start", "text")


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """All chunks with oversized texts in pieces and chunk_index renumbered; see ``pieces``."""
    return renumbered(pieces(chunks, limit, overlap, least))


def found(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index) of the chunks that had to be cut."""
    return pieces(chunks).where("n_pieces > 1").select("doc_id", "chunk_index").distinct()

