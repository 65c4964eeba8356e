"""Encoding of texts by a public byte-level BPE tokenizer.

A text is cut at white space into units, each a run of other characters with
the single space in front of it, or white space alone.  The tokenizer's own
cutting never joins two units, so the ids of a text are those of its units in
order.  Frequent units of the whole corpus are compiled into a minimal acyclic
automaton that shares prefixes and suffixes; counting the words below each
state numbers them, and the number leads to the ids.  The automaton is a few
integer arrays, mapped into memory by every Python worker from the file that
Spark sends to each executor.  A unit that is not in it is merged exactly by
the tokenizer's ranks.
"""

from __future__ import annotations

import array
import base64
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.runtime import fit_parallelism, materialize, staging

TOKENIZERS = os.environ.get("INKSTONE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: A unit is frequent from this share of all units on, and from this number on; so there are at most 1 / FREQUENT of them.
FREQUENT, LEAST = 5e-6, 20
#: Fixed value: the pattern by which the vocabulary's tokenizer cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Control characters that Python counts as white space and the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_MEMORY = 400_000


class Automaton:
    """A minimal acyclic automaton over UTF-8 bytes whose words are numbered in order.

    ``first[s]`` is where the edges of state s begin; an edge has a byte, a
    target and the number of words passed over when it is taken.  ``final[s]``
    tells whether a word ends in s.  ``starts`` and ``ids`` hold the outputs.
    """

    PARTS = ("first", "byte", "target", "skip", "final", "starts", "ids")

    def __init__(self, **parts: np.ndarray) -> None:
        self.__dict__.update(parts)

    @classmethod
    def build(cls, words: Iterable[tuple[bytes, list[int]]]) -> Automaton:
        """From words and outputs, by adding sorted words and sharing equal right sides at once."""
        entries = sorted(dict(words).items())
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path: list[list] = [[False, []]]  # open states of the last word: final, edges
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth:
                final, edges = path.pop()
                key = (final, tuple(edges))
                if key not in register:
                    register[key] = len(states)
                    states.append(key)
                if path:
                    path[-1][1].append((last[len(path) - 1], register[key]))

        for word, _ in entries:
            same = len(os.path.commonprefix([word, last]))
            close(same + 1)
            last = word
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
        close(1)
        root = path[0]
        states.append((root[0], tuple(root[1])))
        below = [0] * len(states)
        first, byte, target, skip, final = [0], [], [], [], []
        for s, (ends, edges) in enumerate(states):  # targets always precede
            passed = int(ends)
            for b, t in edges:
                byte.append(b)
                target.append(t)
                skip.append(passed)
                passed += below[t]
            below[s] = passed
            first.append(len(byte))
            final.append(ends)
        starts = np.zeros(len(entries) + 1, np.int32)
        np.cumsum([len(ids) for _, ids in entries], out=starts[1:])
        flat = [i for _, ids in entries for i in ids]
        return cls(
            first=np.array(first, np.int32), byte=np.array(byte, np.uint8), target=np.array(target, np.int32), skip=np.array(skip, np.int32),
            final=np.array(final, bool), starts=starts, ids=np.array(flat, np.int32),
        )

    def save(self, path: str) -> None:
        """All parts in one file, each at a multiple of 8 bytes behind the table of contents."""
        head, body = [], b""
        for name in self.PARTS:
            a = getattr(self, name)
            head += [len(body), len(a)]
            body += a.tobytes() + b"\0" * (-a.nbytes % 8)
        Path(path).write_bytes(np.array(head, np.int64).tobytes() + body)

    @classmethod
    def load(cls, path: str) -> Automaton:
        """The automaton of a file, mapped into memory."""
        head = np.fromfile(path, np.int64, 2 * len(cls.PARTS))
        kinds = dict(zip(cls.PARTS, (np.int32, np.uint8, np.int32, np.int32, bool, np.int32, np.int32), strict=True))
        parts = {}
        for k, name in enumerate(cls.PARTS):
            at, n = int(head[2 * k]) + head.nbytes, int(head[2 * k + 1])
            parts[name] = np.memmap(path, kinds[name], "r", at, (n,)) if n else np.zeros(0, kinds[name])
        return cls(**parts)

    def number(self, word: bytes) -> int:
        """The number of a word in order, -1 if it is not in the automaton."""
        s, n = len(self.final) - 1, 0
        for b in word:
            a, z = int(self.first[s]), int(self.first[s + 1])
            k = a + int(np.searchsorted(self.byte[a:z], b))
            if k >= z or self.byte[k] != b:
                return -1
            n += int(self.skip[k])
            s = int(self.target[k])
        return n if self.final[s] else -1

    def output(self, word: bytes) -> np.ndarray | None:
        """The ids of a word, or None."""
        n = self.number(word)
        return None if n < 0 else self.ids[self.starts[n]:self.starts[n + 1]]


def load_tokenizer(path: str):
    """The tokenizer of a file of ranks, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("inkstone", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder(dict):
    """From units to the bytes of their ids; fills itself from the automaton and, beyond it, by exact merging."""

    def __init__(self, automaton: Automaton | None, tokenizer) -> None:
        super().__init__()
        self.automaton, self.tokenizer = automaton, tokenizer

    def __missing__(self, unit: str) -> bytes:
        ids = self.automaton.output(unit.encode()) if self.automaton is not None and len(unit) < 64 else None
        out = array.array("i", self.tokenizer.encode_ordinary(unit)).tobytes() if ids is None else ids.tobytes()
        if len(self) < _MEMORY and len(unit) < 64:
            self[unit] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as bytes of 32-bit integers."""
        if _ODD_SPACE.search(text):
            return array.array("i", self.tokenizer.encode_ordinary(text)).tobytes()
        return b"".join(map(self.__getitem__, _UNIT.findall(text)))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(automaton: str, ranks: str) -> Encoder:
    if (automaton, ranks) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[automaton, ranks] = Encoder(Automaton.load(SparkFiles.get(automaton)), load_tokenizer(SparkFiles.get(ranks)))
    return _ENCODERS[automaton, ranks]


def frequent_units(docs: DataFrame) -> list[str]:
    """Units of at least ``FREQUENT`` of all units of the corpus and at least ``LEAST`` occurrences, counted over every text.

    The count cuts at single spaces, which gives the frequent units of running text.
    """
    words = docs.where("text is not null").select(F.explode(F.split("text", " ")).alias("w")).where("w != '' and length(w) < 40")
    counts = materialize(words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST), "token-units")  # read for the sum and for the words
    top = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.where(F.col("n") >= max(LEAST, FREQUENT * top)).select("w").toPandas()["w"]
    return [u for w in kept if not re.search(r"\s", w) for u in (" " + w, w)]


def publish(spark: SparkSession, docs: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[str, str]:
    """Compile the lexicon, send it and the ranks to all executors, return the names of the two files there."""
    ranks = f"{tokenizers}/{vocabulary}.tiktoken"
    tokenizer = load_tokenizer(ranks)
    words = [(u.encode(), tokenizer.encode_ordinary(u)) for u in frequent_units(docs)]
    name = f"lexicon-{uuid.uuid4().hex}"
    Automaton.build(words).save(f"{staging()}/{name}")
    spark.sparkContext.addFile(f"{staging()}/{name}")
    spark.sparkContext.addFile(ranks)
    return name, os.path.basename(ranks)


def encode(docs: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, key: str = "doc_id", counts_only: bool = False) -> DataFrame:
    """(key, ids) or, with ``counts_only``, (key, n_tokens) of every row.

    Null and empty texts have the empty list and 0 tokens.  Every row gives a
    row, repeated ones included; other columns are ignored.
    """
    spark = docs.sparkSession
    lexicon, ranks = publish(spark, docs, tokenizers, vocabulary)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(lexicon, ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [enc.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                sizes = np.fromiter((len(x) // 4 for x in out), np.int32, len(out))
                if counts_only:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes)], [key, "n_tokens"])
                    continue
                offsets = np.zeros(len(out) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(out))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], [key, "ids"])

    source = fit_parallelism(docs.select(key, "text"))
    return source.mapInArrow(run, f"{key} {kind}, n_tokens int" if counts_only else f"{key} {kind}, ids array<int>")
