"""Cuts of the learned index against a plain split of every text."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sondage.llm.infilling import fill_in_middle, fit_rank_index, restored, token_boundaries
from sondage.llm.queries import QUERIES

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [
    None, "", " ", "\n\t ", "a", " a", "a ", "é", "  日本 語\x0b\x0c😀 ", "no\x1cbreak\x85here nor here",
    "x" * 70_000, "a " * 5000 + "b" * 40_000 + " c" * 5000, " " * 3000 + "z", "<P>", "a <S> b", "one<M>", "< P> <p>",
    "ends in <", "<S and <P and <M", "\r\nline\r\n", "word " * 20_000,
]


def expected(key, text):
    """n, form, prefix and middle lengths and output, step by step as the contract has it."""
    text = text or ""
    tokens = TOKENS.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(df, rows):
    found = fill_in_middle(df).withColumn("back", restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r)[:6] + (r["back"],) for r in found.collect()), key=repr)
    assert got == sorted(((k, *expected(k, t), t or "") for k, t in rows), key=repr)


def test_odd_texts_null_ids_and_repeated_rows(spark):
    rows = [(i, t) for i in range(12) for t in ODD] + [(None, "null id here"), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS key", "'x' AS form", "2 AS n", "3 AS h1", "'y' AS output"
    )
    check(df, rows)


def test_text_ids_and_empty_table(spark):
    rows = [("a", "one two three"), ("b", "four five"), (None, None)]
    check(spark.createDataFrame(rows, "doc_id string, text string"), rows)
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_over_whole_table(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = []
    for key, text in rows:
        n, form, prefix, middle, output = expected(key, text)
        wanted.append((key, n, form, prefix, middle, sha(output), sha(text or "")))
    got = [tuple(r) for r in QUERIES["op13_rank_index_infilling"](spark, folder).collect()]
    assert sorted(got) == sorted(wanted)


@pytest.mark.parametrize("error", [1, 7, 127, 1000])
def test_index_keeps_its_error_and_is_exact(error):
    draw = np.random.default_rng(error)
    sizes = [1, 2, 3, 1, 500, 4000, 20_000]
    runs = [np.cumsum(draw.geometric(0.2, n) * draw.choice([1, 1, 1, 400], n)) for n in sizes]
    bases = np.cumsum(sizes) - sizes
    index = fit_rank_index(np.concatenate(runs), bases, error)
    assert np.abs(index.residuals.astype(np.int64)).max() <= error
    assert set(bases) <= set(index.starts.tolist())  # no segment spans two sequences
    for i, run in enumerate(runs):
        ranks = np.arange(len(run))
        assert (index.values(np.full(len(run), i), ranks) == run).all()
    # An even sequence needs one segment, whatever its length.
    assert len(fit_rank_index(np.arange(100_000) * 6, np.array([0]), error).starts) == 1


def test_boundaries_of_many_texts():
    texts = pa.array([t for t in ODD], pa.string())
    values, bases = token_boundaries(texts)
    for i, text in enumerate(ODD):
        end = bases[i + 1] if i + 1 < len(ODD) else len(values)
        lengths = np.cumsum([0] + [len(t) for t in TOKENS.findall(text or "")])
        assert values[bases[i] : end].tolist() == lengths.tolist()
    assert token_boundaries(pa.array([], pa.string()))[0].tolist() == []
