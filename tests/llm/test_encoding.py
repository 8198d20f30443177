"""Ids, token counts and packing against the tokenizer library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagloom.llm import packing, queries, tokens

VOCABULARY = queries.vocabulary()
ENCODER = tokens.Encoder(VOCABULARY)
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PARTS = st.sampled_from(
    ["the", " of", "é", "ß", "漢字", "\n", "\n\n", "  ", "\t", "\r\n", "'s", "'ll ", "12", ",", ". ", " ", "　", "​", "<|endoftext|>", "😀", "́", "<", "|", "A.", "B! ", "\x00"]
)


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS | st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs"]), max_size=30).map("".join))
def test_ids_and_pieces_are_those_of_the_library(text):
    want = library_ids(text)
    assert ENCODER.ids(text).tolist() == want
    pieces = ENCODER.pieces(text)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in library_ids(p)] == want


def test_both_libraries_agree_on_every_character_of_the_fast_way():
    plain = [chr(c) for c in range(0x250)] + [chr(c) for c in range(0x2010, 0x2028)] + ["€"]
    for c in plain:
        for text in (c, f"a{c}b", f" {c} x", f"  {c}\n{c}", f"{c}  {c}{c} a", f".{c}!", f"{c}'s{c}"):
            assert ENCODER.fast.encode(text, allowed_special="all") == library_ids(text)


TEXTS = [
    (1, "The cat sat. The cat, the dog\nand the <|endoftext|> bird"), (2, None), (3, ""), (4, "x" * 5000), (5, " \n\n "),
    (6, "The cat sat. The cat, the dog\nand the <|endoftext|> bird"), (None, "no id"), (7, "漢字 の テキスト " * 300), (7, "same id, other text"),
    (8, "word " * 6000), (9, "é" * 70 + " end"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, ids string").repartition(3)


def test_token_counts(spark):
    for most, often in ((300_000, 3), (3, 1), (0, 1)):  # all, some or no pre-token is broadcast
        got = tokens.count_tokens(frame(spark, TEXTS), VOCABULARY, most=most, often=often).collect()
        want = [(i, len((t or "").encode()), len(library_ids(t or ""))) for i, t in TEXTS]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_other_vocabularies_count_whole_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = tokens.count_tokens(frame(spark, TEXTS), queries.vocabulary(path)).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("block", [200, 1 << 19])
def test_packing_holds_every_id_once(spark, block):
    rows = packing.pack(frame(spark, TEXTS), VOCABULARY, block_tokens=block).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, t in TEXTS:
        ids = [*library_ids(t or ""), 0]
        want[i, len(ids)].append(ids)
    for key, documents in want.items():
        assert len(documents) == 1
        assert [x for _, ids in sorted(pieces[key]) for x in ids] == documents[0]
        assert [s for s, _ in sorted(pieces[key])] == np.cumsum([0] + [len(ids) for _, ids in sorted(pieces[key])])[:-1].tolist()
    assert len(pieces) == len(want)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing_query(spark, sf_dir):
    rows = queries.op2_packing(spark, sf_dir).toPandas()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(rows["doc_id"]) == set(docs)
    for doc, group in rows.groupby("doc_id"):
        ids = np.array([*library_ids(docs[doc] or ""), 0], "<u4")
        at = 0
        for r in group.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    filled = rows.groupby("sequence_id")["length"].sum()
    padded = filled.map(lambda n: n if n & (n - 1) == 0 else 1024).sum()
    assert filled.max() <= 1024 and padded <= 1.01 * filled.sum() + 8 * 1024


def test_assignment_balances_cost():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 1024, 500).tolist()
    placed = packing.assign(lengths, 1024)
    total = defaultdict(int)
    for piece, _, take, s in placed:
        total[s] += take
    assert len(total) == -(-sum(lengths) // 1024) and max(total.values()) <= 1024
    assert sum(1 for n in total.values() if n < 1024) <= 1 or sum(1024 - n for n in total.values()) < 1024
    assert packing.assign([], 8) == []
    # The longest goes first, the next to the cheaper sequence, and what fits nowhere is cut.
    assert packing.assign([6, 5, 3, 2], 8)[:2] == [(0, 0, 6, 0), (1, 0, 5, 1)]
    assert sorted(packing.assign([5, 5, 5], 8)) == [(0, 0, 5, 0), (1, 0, 5, 1), (2, 0, 3, 0), (2, 3, 2, 1)]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert packing.pack(none, VOCABULARY).collect() == []
    assert tokens.count_tokens(none, VOCABULARY).collect() == []
