"""Splitting, token encoding and packing."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstone.llm import packing, split, tokens

CHUNKS = "doc_id string, chunk_index int, section string, text string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "문장이다. ", "\n", "\n\n", "x" * 50, "A.B ", "\r\n", "끝", " "]), max_size=400))
def test_spans_cover_and_bound(parts):
    text = "".join(parts)
    found = split.spans(text)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    assert all(z - a <= split.LIMIT for a, z in found)
    for (a, z), (b, y) in zip(found, found[1:]):
        assert a < b <= z < y and z - b <= split.OVERLAP


def test_natural_boundaries_and_local_edits():
    rng = random.Random(1)
    text = " ".join(" ".join(rng.choices(["revenue", "margin", "시장", "수요가", "grew"], k=rng.randrange(4, 14))).capitalize() + "." for _ in range(400))
    cut = split.spans(text)
    assert all(text[z - 1].isspace() or text[z - 1] in ".\n" for _, z in cut[:-1])
    edited = text[:5000] + "An inserted sentence. " + text[5000:]
    pieces, again = [text[a:z] for a, z in cut], [edited[a:z] for a, z in split.spans(edited)]
    assert len(set(pieces) - set(again)) <= 3
    solid = split.spans("가" * 5000)
    assert all(z - b == split.OVERLAP for (_, z), (b, _) in zip(solid, solid[1:]))


def test_edits_alter_only_neighbouring_pieces():
    changed = []
    for seed in range(200):
        rng = random.Random(seed)
        ends = [" ", "\n"] if seed % 2 else [" "]
        text = "".join(" ".join(rng.choices(["revenue", "margin", "시장", "수요가", "grew", "of", "the", "전망이다"], k=rng.randrange(4, 14))) + "." + rng.choice(ends) for _ in range(500))
        at = text.find(".", rng.randrange(len(text) - 200)) + 2
        edited = text[:at] + "An inserted sentence. " + text[at:] if seed % 3 else text[:at] + text[text.find(".", at) + 2:]
        old, new = [text[a:z] for a, z in split.spans(text)], {edited[a:z] for a, z in split.spans(edited)}
        gone = [i for i, x in enumerate(old) if x not in new]
        changed.append(gone[-1] - gone[0] + 1)  # all between the first and the last counts
    assert sum(n <= 3 for n in changed) >= 196 and max(changed) <= 6


def test_pieces(spark):
    rows = [("a", i, f"s{i}", ("말 " * 600 if i % 3 == 0 else "짧다")) for i in range(9)] + [("a", 0, "s0", "말 " * 600), ("b", 5, None, None), ("b", 7, "s", ""), (None, 1, "s", "x"), ("c", 9000, "s", "x" * 100_000)]
    df = spark.createDataFrame(rows, CHUNKS).withColumn("piece_no", F.lit("clash")).withColumn("start", F.lit("clash"))
    got = split.split_chunks(df).collect()
    for d in "abc":
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in mine] == list(range(len(mine)))
        assert [(r.source_index, r.piece_no) for r in mine] == sorted((r.source_index, r.piece_no) for r in mine)
    assert {r.section for r in got if r.doc_id == "a" and r.source_index == 3} == {"s3"}
    assert sorted((r.doc_id, r.chunk_index) for r in split.found(df).collect()) == [("a", 0), ("a", 3), ("a", 6), ("c", 9000)]
    assert split.split_chunks(spark.createDataFrame([], CHUNKS)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.load_tokenizer(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}.tiktoken")


def test_automaton(tmp_path):
    rng = random.Random(2)
    words = {"".join(rng.choices("abcé ", k=rng.randrange(0, 7))).encode(): [rng.randrange(50_000) for _ in range(rng.randrange(1, 5))] for _ in range(400)}
    a = tokens.Automaton.build(words.items())
    a.save(str(tmp_path / "x"))
    b = tokens.Automaton.load(str(tmp_path / "x"))
    assert [b.number(w) for w in sorted(words)] == list(range(len(words)))
    assert all(b.output(w).tolist() == ids for w, ids in words.items())
    assert all(b.output(w) is None for w in (b"zzz", b"abcabcabcabc") if w not in words)
    shared = tokens.Automaton.build([(f"{x}ing".encode(), [1]) for x in "abcdefgh"])
    assert len(shared.final) < 8  # the ends are shared
    tokens.Automaton.build([]).save(str(tmp_path / "none"))
    assert tokens.Automaton.load(str(tmp_path / "none")).output(b"a") is None


def test_encoding_is_exact(spark, tokenizer):
    texts = ["", None, " ", "Hello world", "a  b\n\n c\t\td ", "don't I'll 's ''s", "숫자 １２ ½ éà\x1c\x85 x", "<|endoftext|> a", "word " * 3000, "x" * 20_000, "\u200b\ufeff", " \n \n  x", "tail  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(0))
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert got == {i: tokenizer.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in tokens.encode(df, counts_only=True).collect()} == {i: len(x) for i, x in got.items()}
    assert tokens.encode(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_units_join_to_the_tokenizers_ids(text):
    t = tokens.load_tokenizer(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}.tiktoken") if not hasattr(test_units_join_to_the_tokenizers_ids, "t") else test_units_join_to_the_tokenizers_ids.t
    test_units_join_to_the_tokenizers_ids.t = t
    text = text.encode("utf-8", "ignore").decode()
    import array

    assert array.array("i", tokens.Encoder(None, t).encode(text)).tolist() == t.encode_ordinary(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_best_fit(sizes):
    where, fill = packing.best_fit(sizes, 50)
    for b, f in enumerate(fill):
        assert f == sum(s for s, w in zip(sizes, where) if w == b) <= 50
    assert sum(1 for f in fill if f <= 25) <= 1


def test_packing_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 60)
    rng = random.Random(4)
    sizes = {i: rng.choice([0, 1, rng.randrange(1, 60), rng.randrange(1, 400), 100, 1000]) for i in range(1500)}
    df = spark.createDataFrame([*sizes.items(), (-1, None)], "doc_id long, n_tokens int").withColumn("size", F.lit("clash")).withColumn("item", F.lit("clash"))
    got = packing.pack(df, 100).collect()
    fill, parts = {}, {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.size
        parts.setdefault(r.doc_id, []).append((r.part, r["first"], r.size))
    assert {r.container: r.fill for r in got} == fill and max(fill.values()) <= 100
    for i, s in {**sizes, -1: 0}.items():
        mine = sorted(parts[i])
        assert sum(x[2] for x in mine) == s and len(mine) == max(1, -(-s // 100)) and [x[1] for x in mine] == [100 * k for k in range(len(mine))]
    assert sum(fill.values()) / (100 * len(fill)) > 0.97
    assert packing.pack(df.where("false")).count() == 0


def test_few_items_go_through_the_rounds_too(spark):
    got = packing.pack(spark.createDataFrame([(i, 1 + i % 30) for i in range(200)], "doc_id long, n_tokens int"), 100).collect()
    packs = {r.container for r in got}
    assert len(got) == 200 and any(c.startswith("1-") for c in packs) and sum(r.size for r in got) / (100 * len(packs)) > 0.95


def test_small_tasks_pack_whole_corpora_well(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sized = tokens.encode(docs, counts_only=True).collect()
    df = spark.createDataFrame(sized, "doc_id long, n_tokens int")
    monkeypatch.setattr(packing, "TASK_ITEMS", 150)
    got = packing.pack(df).collect()
    fill = {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.size
    assert sum(fill.values()) == sum(r.n_tokens for r in sized) and max(fill.values()) <= packing.CAPACITY
    assert sum(fill.values()) / (packing.CAPACITY * len(fill)) >= 0.99


def test_items_that_never_fit_together_end(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 50)
    got = packing.pack(spark.createDataFrame([(i, 60) for i in range(900)], "doc_id long, n_tokens int"), 100).collect()
    assert len({r.container for r in got}) == 900
