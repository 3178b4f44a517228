"""Fingerprints, the covering guarantee, and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from sondage.llm import simhash
from sondage.llm.components import connected_components
from sondage.llm.queries import QUERIES


def plain_fingerprint(text, shingle=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = lowered.split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def plain_roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_components(fps, radius=4):
    distinct = sorted(set(fps))
    links = [
        (a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= radius
    ]
    return plain_roots(distinct, links)


def test_every_close_pair_meets():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    generator = random.Random(1)
    for _ in range(3000):
        flips = sum(1 << b for b in generator.sample(range(64), generator.randint(0, 4)))
        tables = [m for m in masks if flips & m == 0]
        assert tables
        assert all(any(flips & f == 0 for f in simhash.finer_masks(m, 4)) for m in tables)


@pytest.mark.parametrize("bucket_rows", [4, 40, 2048])
def test_links_of_dense_groups(spark, bucket_rows):
    """Large groups of close fingerprints: hot buckets are split and lose nothing."""
    generator = np.random.default_rng(5)
    center = int(generator.integers(0, 2**63))
    fps = {center ^ sum(1 << int(b) for b in generator.choice(64, k, replace=False)) for k in range(6) for _ in range(25)}
    fps |= {int(x) for x in generator.integers(0, 2**63, 60)} | {0, (1 << 64) - 1}
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    links = [(a % 2**64, b % 2**64) for a, b in simhash.fingerprint_links(df, 4, bucket_rows).collect()]
    assert plain_roots(fps, links) == plain_components(fps)


def test_components_of_path_star_and_ring(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    links += [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300)]
    df = spark.createDataFrame([(b, a) for a, b in links], "a long, b long")
    found = {r["node"]: r["root"] for r in connected_components(df).collect()}
    nodes = {x for pair in links[:-1] for x in pair}
    assert found == plain_roots(nodes, links[:-1])


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_cases(spark):
    texts = [
        (5, None), (3, ""), (4, " \n"), (9, "one two three"), (2, "One  TWO\tthree"), (7, "É é É a b"),
        (7, "É é É a b"), (None, "a b c d e"), (1, "x y " * 3000),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS fingerprint")
    found = sorted((str(r[0]), r[1], str(r[2])) for r in simhash.near_duplicates(df).collect())
    fps = {t: plain_fingerprint(t) for _, t in texts}
    roots, low = plain_components(fps.values()), {}
    for i, t in texts:
        if i is not None:
            low[roots[fps[t]]] = min(i, low.get(roots[fps[t]], i))
    assert found == sorted((str(i), f"{fps[t]:016x}", str(low.get(roots[fps[t]]))) for i, t in texts)


def test_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    fps = {r[0]: plain_fingerprint(r[1]) for r in rows}
    roots, low = plain_components(fps.values()), {}
    for i in sorted(fps):
        low.setdefault(roots[fps[i]], i)
    found = {r[0]: (r[1], r[2]) for r in QUERIES["op3_covering_simhash"](spark, folder).collect()}
    assert found == {i: (f"{f:016x}", low[roots[f]]) for i, f in fps.items()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
