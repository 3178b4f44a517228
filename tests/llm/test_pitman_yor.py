"""Counts and base scores against plain ones; seating and probabilities of the model."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sondage.llm import kernels
from sondage.llm import pitman_yor as py
from sondage.llm.queries import QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain(rows, held):
    words = {i: WORD.findall((t or "").encode().lower()) + [None] for i, (_, t) in enumerate(rows)}
    counts = Counter(w for i, (k, _) in enumerate(rows) if not held(k) for w in words[i])
    n, v = sum(counts.values()), len(counts)
    return [
        (str(k), len(words[i]), sum(counts[w] > 0 for w in words[i]), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[i]))
        for i, (k, _) in enumerate(rows)
    ]


def check(found, rows, held):
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found)
    wanted = sorted(plain(rows, held))
    assert [g[:4] for g in got] == [w[:4] for w in wanted]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in wanted], rel=1e-9)


def held(key):
    return zlib.crc32(str(key).encode()) % 7 == 2


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op1_pitman_yor"](spark, folder).collect()
    check(found, rows, held)
    assert all(r["held_out"] == held(r["doc_id"]) for r in found)
    test = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)


ROWS = [
    (1, None), (2, ""), (3, "a b a"), (3, "a b a"), (None, "A\tB\x0bc"), (5, "é É ÄB äb 日本"), (6, "the " * 9000),
    (7, "x" * 5000), (8, "a b c d e f g h " * 40),
]


@pytest.mark.parametrize("block_bytes", [100, 10_000_000])
def test_small_cases(spark, block_bytes):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS pairs", "3 AS key")
    model = py.fit_pitman_yor(df, F.lit(True), block_bytes=block_bytes)
    found = py.score_texts(df, model).collect()
    check(found, ROWS, lambda k: False)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_probabilities_sum_to_one(spark):
    """Over all known words and a new one, after any context, in one bucket."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    model = py.fit_pitman_yor(df, F.lit(True))
    rows = model.counts.toArrow()
    (bucket,) = py._buckets(model, rows)
    for number, totals in enumerate(model.history[:-1]):
        bucket.sweep(number, totals)
    assert bucket.sums().tolist() == pytest.approx([*model.history[-1].tables, model.history[-1].root_customers, model.history[-1].root_tables])
    for context in range(py.CONTEXTS):
        n = len(bucket.words)
        pairs = (bucket.words << py.BITS) | np.uint64(context)
        entry = py._places(bucket.pairs, pairs)
        p = bucket.probability(np.arange(n), entry, np.full(n, context), model.history[-1])
        new = bucket.probability(np.array([-1]), np.array([-1]), np.array([context]), model.history[-1])
        assert p.sum() + new[0] == pytest.approx(1)


def exact_tables(c, new, discount):
    """Expected tables of c customers: the weight of t tables is new^t times the sum over
    arrangements, by the recurrence of generalized Stirling numbers."""
    s = np.zeros((c + 1, c + 2))
    s[1, 1] = 1
    for n in range(1, c):
        for t in range(1, n + 2):
            s[n + 1, t] = s[n, t - 1] + (n - discount * t) * s[n, t]
    w = s[c, 1 : c + 1] * new ** np.arange(1, c + 1)
    return (w * np.arange(1, c + 1)).sum() / w.sum()


@pytest.mark.parametrize(("c", "new", "discount"), [(2, 0.5, 0.7), (5, 0.3, 0.5), (12, 2.0, 0.3), (40, 0.1, 0.8)])
def test_seating_follows_the_exact_distribution(c, new, discount):
    rng = np.random.default_rng(1)
    tables, weights = py.seated(np.full(40_000, c), np.full(40_000, new), discount, rng)
    w = np.exp(weights - weights.max())
    assert (tables * w).sum() / w.sum() == pytest.approx(exact_tables(c, new, discount), rel=0.03)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert py.score_texts(df, py.fit_pitman_yor(df, F.lit(True))).count() == 0
    some = spark.createDataFrame(ROWS, "doc_id long, text string")
    check(py.score_texts(some, py.fit_pitman_yor(some, F.lit(False))).collect(), ROWS, lambda k: True)


def test_contexts_are_preceding_words(spark):
    """Two words of one ending that are always followed by different ones."""
    rows = [(i, "ma po " if i % 2 else "ra qu ") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "ma po"), (2, "ma qu"), (3, "ra qu"), (4, "ra po")], "doc_id long, text string")
    for block_bytes in (50, 1_000_000):
        model = py.fit_pitman_yor(df, F.lit(True), block_bytes=block_bytes)
        score = {r["doc_id"]: r["score"] for r in py.score_texts(asked, model).collect()}
        assert min(score[1], score[3]) > max(score[2], score[4]) + 1


def test_every_preceding_word_has_a_restaurant(spark):
    """Customers and tables of each, put together by their owners, against plain counts."""
    rows = [(i, t) for i, (_, t) in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = Counter()
    for _, text in rows:
        words = [None, *WORD.findall((text or "").encode().lower())]
        wanted.update(words)
    for block_bytes in (100, 10_000_000):
        model = py.fit_pitman_yor(df, F.lit(True), block_bytes=block_bytes)
        found = [(c, t) for r in model.contexts.collect() for c, t in zip(r["customers"], r["own1"], strict=True)]
        assert sorted(c for c, _ in found) == sorted(wanted.values())
        assert all(1 <= t <= c for c, t in found)
        assert model.train_tokens == sum(wanted.values())


def test_counts_are_not_shuffled_again(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    model = py.fit_pitman_yor(df, F.lit(True), block_bytes=100)
    plan = model.contexts.select("bucket").join(model.counts, "bucket", "left")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "hashpartitioning" not in plan


def test_workers_give_freed_memory_back():
    """A function's garbage does not stay in the worker, also not below what is still used."""

    def resident():
        with open("/proc/self/status") as status:
            return next(int(line.split()[1]) for line in status if line.startswith("VmRSS")) // 1024

    def work(rows: pa.Table) -> pa.Table:
        # Arrays too small to be mapped one by one, between others that live on.
        many = [np.ones(12_000) for _ in range(4_000)]
        kept.extend(many[::100])
        return rows

    kept, rows = [], pa.table({"x": [1]})
    kernels.give_back()
    before = resident()
    assert kernels.tidy(work)(rows) is rows
    assert resident() < before + 100  # 384 MB were taken
    assert list(kernels.tidy_batches(iter)(rows.to_batches())) == rows.to_batches()


def test_words_are_hashed_in_parts(monkeypatch):
    texts = pa.array([*[t for _, t in ROWS], "a b " * 50, "", None, "ab"], pa.string())
    for some in (texts, texts[:0], texts[2:]):
        every = py.tokens(some)
        with monkeypatch.context() as m:
            m.setattr(py, "HASHED_BYTES", 7)
            for one, other in zip(every, py.tokens(some), strict=True):
                assert one.dtype == other.dtype and one.tolist() == other.tolist()


def test_counting_holds_little_beside_its_pairs():
    """Memory of numpy while 2 MB of text become tokens, and while pairs held are merged."""
    texts = pa.array(["several words of a text " * 40] * 2_000)
    py.tokens(texts)
    tracemalloc.start()
    py.tokens(texts)
    assert tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()
    held, n, parts = py.Held(), 100_000, 10
    tracemalloc.start()
    for k in range(parts):
        held.add(np.arange(n, dtype=np.uint64) * 7 + k % 2, np.full(n, 3, np.uint64), np.ones(n, np.int64))
    words, contexts, counts = held.taken()
    # Twice the 24 bytes of a pair and count, and less than that besides.
    assert tracemalloc.get_traced_memory()[1] < 80 * n * parts
    tracemalloc.stop()
    assert len(words) == len(contexts) == 2 * n and (counts == parts // 2).all() and held.size == 0


def test_small_numbers_travel_in_a_byte():
    values, bounds = np.array([0, 254, 255, 2**40, 1, 1, 300]), np.array([0, 2, 2, 5, 7])
    rows = pa.table({"x": range(4), **py._small("n", values, bounds), "words": py._bytes(values, bounds)})
    assert py._numbers(rows, "n").tolist() == py._values(rows, "words", np.int64).tolist() == values.tolist()
    assert py._numbers(rows.slice(2, 1), "n").tolist() == [255, 2**40, 1]
    assert py._numbers(rows.slice(1, 1), "n").tolist() == [] == py._numbers(rows.slice(0, 0), "n").tolist()
    assert py._numbers(rows.take([3, 0]), "n").tolist() == [1, 300, 0, 254]
    assert sum(rows.column(x).nbytes for x in ("n", "n_more")) < 7 + 3 * 8 + 2 * 5 * 4 + 1
    assert py._lengths(rows, "n").tolist() == [2, 0, 3, 2]


def test_a_block_holds_its_pairs_once():
    texts = [t for _, t in ROWS]
    words, contexts, owner = py.tokens(pa.array(texts, pa.string()))
    block = py.Block.of(pa.array(texts, pa.string()))
    assert block.words[block.word[block.pair]].tolist() == words.tolist() == block.words[block.at].tolist()
    assert block.contexts[block.pair].tolist() == contexts.tolist() and block.owner.tolist() == owner.tolist()
    assert py.as_context(block.words)[block.before].tolist() == block.contexts.tolist()
    pairs = list(zip(block.word.tolist(), block.contexts.tolist(), strict=True))
    assert pairs == sorted(set(pairs)) and len(pairs) == len(set(zip(words.tolist(), contexts.tolist(), strict=True)))
    buckets = py._owner(py.as_context(block.words), 1000)
    assert (np.diff(buckets) >= 0).all() and len(set(buckets.tolist())) > 5 and buckets.max() < 1000


def test_texts_move_once_and_compressed(spark):
    """Blocks that ask and blocks that are scored are read from one shuffle, without texts in it."""
    df = spark.createDataFrame([(i, f"some words {i} " * 50) for i in range(300)], "doc_id long, text string")
    model = py.fit_pitman_yor(df, F.lit(True), block_bytes=20_000)
    scored = py.score_texts(df, model)
    assert len(scored.collect()) == 300
    plan = scored._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange [block" in plan
    assert plan.count("body#") > 2 and "array<" not in plan.split("Scan parquet")[0]


def test_blocks_of_any_cut_give_the_same_scores(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(ROWS * 3)], "doc_id long, text string").repartition(3)
    model = py.fit_pitman_yor(df, F.lit(True), block_bytes=2_000)
    found = [
        {r["doc_id"]: r["score"] for r in py.score_texts(df, py.replace(model, block_bytes=n)).collect()}
        for n in (1, 500, 10_000_000)
    ]
    assert len(found[0]) == len(ROWS) * 3
    assert found[0] == pytest.approx(found[1], rel=1e-6) and found[0] == pytest.approx(found[2], rel=1e-6)


def test_answers_are_put_together_once(spark):
    """Not again by every sweep that reads them."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    model = py.fit_pitman_yor(df, F.lit(True), block_bytes=100)
    plan = model.counts._jdf.queryExecution().executedPlan().toString()
    assert "rests3" in plan and "Aggregate" not in plan


def test_weights_of_customers_seated_one_by_one():
    """Without a discount they follow from the numbers of customers alone."""
    customers = np.arange(64, 0, -1)
    _, weights = py.seated(customers, np.full(64, 2.5), 0.0, np.random.default_rng(1))
    assert weights.tolist() == pytest.approx([sum(math.log(n + 2.5) for n in range(1, c)) for c in customers.tolist()])


@pytest.mark.parametrize("entries", [2, 1_000])
def test_counts_passed_on_at_once_and_later(spark, monkeypatch, entries):
    monkeypatch.setattr(py, "HELD_ENTRIES", entries)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    model = py.fit_pitman_yor(df, F.lit(True))
    check(py.score_texts(df, model).collect(), ROWS, lambda k: False)
    assert model.words == len({w for _, t in ROWS for w in WORD.findall((t or "").encode().lower())}) + 1
