"""Packed pieces against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sondage.llm.packing import LONGEST_WORD, _apart, _word_ranks, cut, harmonic_packing, word_ids
from sondage.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, capacity=2048):
    tokenizer = Tokenizer.from_file(PATH)
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in texts]
    expected, wanted = defaultdict(list), defaultdict(int)
    for i, x in ids:
        expected[i].append(x)
        wanted[i] += len(x)
    held, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        whole = [x for x in expected[r["doc_id"]] if len(x) == r["doc_tokens"]]
        part = [x[r["start"] : r["start"] + r["length"]] for x in whole]
        assert r["length"] > 0
        assert r["ids_crc32"] in {zlib.crc32(np.array(p, "<u4").tobytes()) for p in part}
        held[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert held == wanted
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return sum(wanted.values()), len(sequences)


def test_cut_covers_every_length():
    for n in range(1, 5000):
        pieces = cut(n, 2048, 1 / 128)
        assert sum(pieces) == n and all(0 < p <= 2048 for p in pieces)
        assert all(2048 % p <= 45 for p in pieces)  # the square root of the capacity


def test_query(spark, folder):
    texts = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    tokens, sequences = check(QUERIES["op2_harmonic_packing"](spark, folder).collect(), texts)
    assert sequences * 2048 < 1.02 * tokens + 4096


def test_small_cases(spark):
    texts = [
        (1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "don't  we'll I'M x y\x1cz"),
        (5, "É é ﬁ İ ß 日本語 😀 <|endoftext|> a<|startoftext|>b"), (6, "word " * 5000),
        (7, "x" * 3000), (8, "a\x0b\x0cb\r\nc\td"), (9, "1234567 a1b2 !!??.. ___ 'S"),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS start", "3 AS key")
    check(harmonic_packing(df, PATH).collect(), texts)


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_other_capacities(spark, folder, capacity):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) < 900")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(harmonic_packing(docs, PATH, capacity=capacity).collect(), texts, capacity)


def test_empty_table(spark):
    assert harmonic_packing(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_ids_of_random_texts():
    """Letters, digits, marks and white space of all kinds, next to one another."""
    rng = np.random.default_rng(7)
    alphabet = [*map(chr, range(1, 0x250)), *map(chr, range(0x400, 0x530)), *map(chr, range(0x2000, 0x2070)),
                *"Σςσΐẞǅʼ\u0301\u0345\u3000かがパ\u3099一龥가힣\u1100\uffff😀", "\0"]
    plain = [*"abcdefghij ETAOIN '' .,!-  \n\t0123456789", "'s", "'LL ", "the ", "ing ", "'Re", "\u00a0", "\u2009", "é", "ß"]
    texts = ["".join(rng.choice(plain if rng.random() < 0.7 else alphabet, rng.integers(0, 60))) for _ in range(20_000)]
    texts += alphabet + [f"a{c}B{c} {c}" for c in alphabet] + ["x" * 2 * LONGEST_WORD, "<|endoftext|>a", "\u00a0", "", " "]
    tokenizer, array = Tokenizer.from_file(PATH), pa.array(texts)
    expected = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, word_ids(PATH, array), expected, strict=True) if a != b] == []
    assert 2_000 < _apart(array).sum() < 18_000  # both ways are tried


def test_long_words_and_other_tokenizers():
    texts = ["ab" * 500_000 + " c", "a." * 500_000, "\u2009" * 100_000 + "x", "e " * 500_000]
    tokenizer = Tokenizer.from_file(PATH)
    expected = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [*word_ids(PATH, pa.array(texts))] == expected
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert _word_ranks(other) is None
    ids = Tokenizer.from_file(other).encode("A small text", add_special_tokens=False).ids
    assert [*word_ids(other, pa.array(["A small text"]))] == [np.array(ids, "<u4").tobytes()]
