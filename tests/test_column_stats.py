"""Quantiles and modes: both ways of computing them against numpy and pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondage.operators import describe, groups
from sondage.operators.stats import column_stats

PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}


def frames():
    rng = np.random.default_rng(7)
    n = 4000
    yield "unique", rng.normal(size=n)
    yield "hot", np.where(rng.random(n) < 1 / 3, 5.0, rng.normal(5, 1, n).round(1))
    yield "tail", np.exp(rng.normal(0, 8, n))
    yield "constant", np.full(n, 2.5)
    yield "two", rng.integers(0, 2, n).astype(float)
    yield "infinite", np.where(rng.random(n) < 0.4, np.inf, rng.normal(size=n))
    yield "signed", np.where(rng.random(n) < 0.5, -1e300, 1e300)


DATA = dict(frames())


@pytest.fixture(scope="module")
def table(spark):
    pdf = pd.DataFrame(DATA)
    pdf["gap"] = np.where(np.arange(len(pdf)) % 3 == 0, np.nan, pdf["unique"])
    pdf["none"] = np.nan
    pdf["key"] = np.where(np.arange(len(pdf)) % 3 == 0, "hot", "k" + (pdf.index % 37).astype(str))
    return pdf, spark.createDataFrame(pdf).repartition(6).cache()


def expected(values, p):
    values = np.sort(values[~np.isnan(values)])
    if not len(values):
        return None
    at = p * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high else (math.floor(at) + 1 - at) * low + (at - math.floor(at)) * high


def close(found, wanted):
    return found is wanted if wanted is None else found == pytest.approx(wanted, rel=1e-12)


def test_quantiles_and_mode(table):
    pdf, df = table
    columns = [*DATA, "gap", "none"]
    found = column_stats(df, columns, ["n"], PROBS, mode=True).collect()
    assert sorted(r["column_name"] for r in found) == sorted(columns)
    for row in found:
        values = pdf[row["column_name"]].to_numpy()
        for q, p in PROBS.items():
            assert close(row[q], expected(values, p)), (row, q)
        modes = pd.Series(values).mode()
        assert row["mode"] == (modes[0] if len(modes) else None)
        assert row["n"] == (~np.isnan(values)).sum()


def test_quantiles_by_group(table):
    pdf, df = table
    columns = ["unique", "hot", "tail", "gap"]
    found = column_stats(df, columns, ["n"], PROBS, mode=True, keys=["key"])
    rows = found.collect()
    assert len(rows) == len(columns) * pdf["key"].nunique()
    for row in rows:
        values = pdf.loc[pdf["key"] == row["key"], row["column_name"]].to_numpy()
        for q, p in PROBS.items():
            assert close(row[q], expected(values, p)), (row, q)


@pytest.mark.parametrize("parts", [2, 16])
def test_many_refinements_change_nothing(table, monkeypatch, parts):
    from sondage.operators import stats

    pdf, df = table
    monkeypatch.setattr(stats, "CELL_ROWS", 4 if parts == 16 else 40)
    monkeypatch.setattr(stats, "CELL_PARTS", parts)
    monkeypatch.setattr(stats, "OCTAVE_PARTS", parts)
    for row in column_stats(df, ["unique", "tail", "signed", "infinite"], ["n"], PROBS).collect():
        for q, p in PROBS.items():
            assert row[q] == pytest.approx(expected(pdf[row["column_name"]].to_numpy(), p))


def test_prefix_and_parts_keep_order(spark):
    from sondage.operators import stats

    edges = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1e-5, 0.1, 1.0, 1.7e308, math.inf]
    near = [x for e in range(-1074, 1024, 13) for x in (math.ldexp(1.0, e), math.nextafter(math.ldexp(1.0, e), 0))]
    values = sorted({s * x for x in edges + near for s in (-1, 1)})
    df = spark.createDataFrame([(x,) for x in values], "v double")
    got = dict(df.select("v", stats._prefix(F.col("v"))).collect())
    found = [got[x] for x in values]
    assert found == sorted(found) and got[0.0] == 0 and len(set(found)) > 300


@pytest.mark.parametrize("spread", ["logarithmic", "rarely huge", "clustered"])
def test_cells_are_small_whatever_the_spread(spark, monkeypatch, spread):
    """What is gathered for a rank in the end is a small part of the column."""
    from sondage.operators import stats

    rng = np.random.default_rng(5)
    n = 60_000
    values = {
        "logarithmic": np.exp(rng.normal(0, 40, n)),
        "rarely huge": np.where(rng.random(n) < 0.001, 1e200, 1.0) * rng.random(n),
        "clustered": 1e9 + rng.integers(0, 2, n) + rng.random(n) * 1e-3,
    }[spread]
    monkeypatch.setattr(stats, "CELL_ROWS", 100)
    kept = []
    checkpointed = stats.checkpointed
    monkeypatch.setattr(stats, "checkpointed", lambda df: kept.append(checkpointed(df)) or kept[-1])
    row = column_stats(spark.createDataFrame(pd.DataFrame({"v": values})), ["v"], ["n"], PROBS).first()
    for q, p in PROBS.items():
        assert row[q] == pytest.approx(expected(values, p), rel=1e-12)
    assert len(kept) <= 4 and kept[-1].where("_first < _last").agg(F.max("_n")).first()[0] in (None, *range(101))


def test_no_sorting_aggregation(table, capsys):
    _, df = table
    column_stats(df, ["unique", "tail"], ["n"], PROBS).explain("formatted")
    assert "SortAggregate" not in capsys.readouterr().out


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b double")
    rows = column_stats(df, ["a", "b"], ["n", "mean", "std"], {"m": 0.5}, True)
    assert [r[1:] for r in rows.collect()] == [(0, None, None, None, None)] * 2


def test_one_row(spark):
    row = column_stats(
        spark.createDataFrame([(3,)], "a int"), ["a"], ["n", "mean", "std", "skewness"], {"m": 0.5}
    ).first()
    assert row[1:] == (1, 3.0, None, None, 3.0)


def test_mode_is_the_smallest_of_the_most_frequent(spark):
    df = spark.createDataFrame([(7,), (3,), (7,), (3,), (9,), (None,)], "a int")
    assert describe.distributions(df).first()["mode"] == 3.0


def test_cv_of_zero_mean(spark):
    df = spark.createDataFrame([(-1.0,), (1.0,)], "a double")
    assert describe.distributions(df).first()["cv"] is None


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "a double")
    row = describe.numeric_summary(df).first()
    assert (row["n"], row["mean"]) == (1, 1.0)
    assert describe.distributions(df).first()["median"] == 1.0


def test_few_values_have_no_tests(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "a double")
    assert describe.moments(df).first()[1:] == (3, None, None)
    assert describe.statistical_tests(df).count() == 0


def test_groups_drop_missing_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 100.0)], "k string, x double")
    assert groups.group_count(df, "k").first()["n_groups"] == 1
    row = groups.group_stats(df, "k").first()
    assert (row["mean"], row["median"], row["max"]) == (2.0, 2.0, 3.0)
    assert row["std"] == pytest.approx(1.4142)
    with pytest.raises(ValueError):
        groups.group_stats(df.select("k"), "k")


def test_describe_equals_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a.b": rng.normal(size=500), "c d": rng.integers(0, 9, 500)})
    found = describe.numeric_summary(spark.createDataFrame(pdf)).toPandas().set_index("column_name")
    stats = pdf.describe().T
    for ours, theirs in [("mean", "mean"), ("std", "std"), ("p25", "25%"), ("max", "max")]:
        assert np.allclose(found.loc[stats.index, ours], stats[theirs])
    moments = describe.moments(spark.createDataFrame(pdf)).toPandas().set_index("column_name")
    for c in pdf:
        x = pdf[c] - pdf[c].mean()
        assert moments.loc[c, "skewness"] == pytest.approx((x**3).mean() / (x**2).mean() ** 1.5, abs=1e-4)


def test_decimals_and_long_columns(spark):
    df = spark.range(5).select(
        F.col("id").cast("decimal(10,2)").alias("d"), (F.col("id") * 2).cast("tinyint").alias("t")
    )
    assert {r["column_name"]: r["mean"] for r in describe.numeric_summary(df).collect()} == {
        "d": 2.0, "t": 4.0,
    }
