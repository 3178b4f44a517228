"""Merged states of chunks against the whole table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondage.operators.frequencies import distinct_counts
from sondage.operators.stats import column_stats
from sondage.streaming.profile import HLL_BITS, add_chunk, chunk_state, merged, merged_profile, profile_in_chunks

EXACT = ["n", "mean", "std", "variance", "min", "max", "skewness", "kurtosis"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 6000
    pdf = pd.DataFrame({
        "id": np.arange(n), "x": np.exp(rng.normal(0, 2, n)), "far": 1e9 + rng.normal(0, 1, n), "same": 7.5,
        "gap": np.where(np.arange(n) % 4 == 0, np.nan, rng.normal(size=n)), "none": np.nan,
        "text": [f"t{i % 900}" for i in range(n)], "part": np.arange(n) % 7,
    })
    return pdf, spark.createDataFrame(pdf)


def test_any_chunks_give_the_whole_tables_moments(spark, table):
    pdf, df = table
    # One chunk has one row, one is empty.
    chunks = [df.where("part < 3 AND id > 0"), df.where("id = 0"), df.where("part >= 3"), df.limit(0)]
    states = [chunk_state(c) for c in chunks]
    found = {r["column_name"]: r for r in merged(states[0].unionByName(states[1]).unionByName(states[2]).unionByName(states[3])).collect()}
    assert set(found) == set(df.columns)
    numeric = [c for c in df.columns if c != "text"]
    whole = {r["column_name"]: r for r in column_stats(df, numeric, EXACT).collect()}
    for name in numeric:
        for s in EXACT:
            a, b = found[name][s], whole[name][s]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-6, abs=1e-6)), (name, s, a, b)
    distinct = dict(distinct_counts(df).collect())
    for name, row in found.items():
        assert row["n_rows"] == 6000 and row["n_missing"] == int(pdf[name].isna().sum())
        assert abs(row["approx_distinct"] - distinct[name]) <= 4 * 1.04 * 2 ** (-HLL_BITS / 2) * max(1, distinct[name])
    ranks = {q: (pdf["x"] <= found["x"][q]).mean() for q in ("p25", "p50", "p75")}
    assert ranks == pytest.approx({"p25": 0.25, "p50": 0.5, "p75": 0.75}, abs=0.02)
    assert found["text"]["mean"] is None and found["none"]["p50"] is None


def test_a_chunk_taken_in_again_counts_once(spark, table, tmp_path):
    _, df = table
    state = str(tmp_path / "state")
    for part in (0, 1, 0):
        add_chunk(df.where(F.col("part") == part), state, part)
    found = merged_profile(spark, state).where("column_name = 'x'").first()
    assert found["n_rows"] == df.where("part < 2").count()


def test_files_are_taken_in_once(spark, table, tmp_path):
    _, df = table
    source, state, done = (str(tmp_path / x) for x in ("in", "state", "done"))
    df.where("part < 4").repartition(3).write.parquet(source)
    args = (spark, source, df.schema, state)
    assert profile_in_chunks(*args, checkpoint=done).first()["n_rows"] == df.where("part < 4").count()
    df.where("part >= 4").coalesce(1).write.mode("append").parquet(source)
    assert profile_in_chunks(*args, checkpoint=done).first()["n_rows"] == 6000
    assert spark.read.parquet(state).select("chunk").distinct().count() == 4
