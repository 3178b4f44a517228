"""Packed pieces against the tokenizer itself, and plans against packing one by one."""

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sondage.llm.grouping import BestFitPlan, SlotPlan, _encoder, configurations, grouped_packing, linear_groups
from sondage.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit_decreasing(sizes, capacity):
    rooms = []
    for size in sorted(sizes, reverse=True):
        at = bisect_left(rooms, size)
        insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - size)
    return len(rooms)


def check(rows, texts, capacity=2048):
    """Every id in one piece, cut as asked for, sequences gapless; their number and that of
    best fit over the same pieces."""
    tokenizer = Tokenizer.from_file(PATH)
    wanted, cut = Counter(), []
    for key, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            wanted[key, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
            cut.append(b - a)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), best_fit_decreasing(cut, capacity)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_needs_hardly_more_sequences_than_best_fit(spark, scale):
    folder = f"/root/testdata/{scale}"
    texts = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    ours, best = check(QUERIES["op12_linear_grouping"](spark, folder).collect(), texts)
    assert ours <= 1.003 * best + 1


def test_small_cases(spark):
    texts = [
        (1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "don't  we'll I'M x y\x1cz\r\n\n\t "),
        (5, "É é ﬁ İ ß 日本語 😀 <|endoftext|> a<|endoftext|><|startoftext|>b"), (6, "word " * 5000),
        (7, "x" * 30_000), (8, "a\x0b\x0cb  c"), (9, "1234567 a1b2 ١٢٣ !!??.. ___ 'S"), (10, " " * 9000),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr(
        "*", "1 AS piece", "2 AS start", "3 AS key", "4 AS bin", "5 AS place", "6 AS room"
    )
    check(grouped_packing(df, PATH).collect(), texts)


@pytest.mark.parametrize("capacity", [1, 2, 7, 64])
def test_other_capacities(spark, folder, capacity):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) < 900")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(grouped_packing(docs, PATH, capacity=capacity).collect(), texts, capacity)


def test_one_length_and_empty_table(spark):
    texts = [(i, "same words here") for i in range(3000)]
    ours, best = check(grouped_packing(spark.createDataFrame(texts, "doc_id long, text string"), PATH).collect(), texts)
    assert ours == best
    assert grouped_packing(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_ids_are_those_of_the_tokenizer_also_for_other_files(tmp_path):
    odd = ["", "a  b", "­Ā\x00\x7f", "<|endoftext|>", "naïvé 'll'S", "\n\n x \t\t"]
    word = public_tokenizers.path("word_bpe_49k.json")
    for path in (PATH, word):
        tokenizer = Tokenizer.from_file(path)
        for text in odd:
            assert _encoder(path)(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=400), st.integers(1, 40), st.sampled_from([0.1, 1 / 3, 0.5]))
def test_plans_place_every_piece(lengths, groups, small):
    capacity, limit = 64, int(small * 64)
    counts = Counter(lengths)
    slots = SlotPlan({s: n for s, n in counts.items() if s > limit}, capacity, groups)
    held = Counter()
    for size, n in counts.items():
        if size > limit:
            for b in slots.sequences_of(np.full(n, size), np.arange(n)).tolist():
                held[b] += size
    assert all(0 <= b < slots.sequences for b in held) and all(v <= capacity for v in held.values())
    rooms = defaultdict(list)
    for b, v in held.items():
        rooms[capacity - v].append(b)
    fit = BestFitPlan({s: n for s, n in counts.items() if s <= limit}, {r: len(b) for r, b in rooms.items()}, capacity)
    for size, n in sorted(counts.items(), reverse=True):
        if size <= limit:
            for room, nth, offset in zip(*(x.tolist() for x in fit.slots(np.full(n, size), np.arange(n))), strict=True):
                home = rooms[room][nth] if room >= 0 else ("new", nth)
                assert held[home] == offset  # gapless
                held[home] += size
    assert sum(held.values()) == sum(lengths) and all(v <= capacity for v in held.values())


def test_groups_round_up_and_configurations_cover_them():
    draw = np.random.default_rng(3)
    counts = Counter(draw.integers(200, 2048, 20_000).tolist())
    types = linear_groups(counts, 40)
    assert len(types) == 40 and {n for _, n in types} == {500} and types[0][0] == max(counts)
    configs = configurations(types, 2048)
    covered = sum(times * config for config, times in configs)
    assert covered.tolist() == [n for _, n in types]
    assert all(config @ [s for s, _ in types] <= 2048 for config, _ in configs)
    used = sum(times for _, times in configs)
    volume = -(-sum(s * n for s, n in types) // 2048)
    assert volume <= used <= 1.03 * best_fit_decreasing([s for s, n in types for _ in range(n)], 2048)
