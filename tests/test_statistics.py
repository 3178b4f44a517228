"""Tests against published values and the limits of the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from sondage.functions import pvalues
from sondage.functions.normality import k_squared_p, with_k_squared
from sondage.operators import relations

ANOVA = [
    [.0571, .0813, .0831, .0976, .0817, .0859, .0735, .0659, .0923, .0836],
    [.0873, .0662, .0672, .0819, .0749, .0649, .0835, .0725],
    [.0974, .1352, .0817, .1016, .0968, .1064, .105],
    [.1033, .0915, .0781, .0685, .0677, .0697, .0764, .0689],
    [.0703, .1026, .0956, .0973, .1039, .1045],
]


def one_column(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double").agg(
        F.count("x").alias("n"), F.skewness("x").alias("skewness"), F.kurtosis("x").alias("kurtosis")
    )


@pytest.mark.parametrize(
    "values, z", [([1, 2, 3, 4, 5, 6, 7, 8], 1.0108048609), ([2, 8, 0, 4, 1, 9, 9, 0], 0.4462638537)]
)
def test_skewness_z(spark, values, z):
    found = with_k_squared(one_column(spark, values)).first()["skewness_z"]
    assert found == pytest.approx(z, abs=1e-9)


def test_kurtosis_z(spark):
    found = with_k_squared(one_column(spark, range(20))).first()["kurtosis_z"]
    assert found == pytest.approx(-1.7058104152, abs=1e-9)


def test_normality_needs_eight_values_and_spread(spark):
    for values in ([1, 2, 3, 4, 5, 6, 7], [3] * 20):
        tested = with_k_squared(one_column(spark, values))
        assert tested.select("k2", k_squared_p(F.col("k2"))).first()[:] == (None, None)


def test_chi_square_without_correction(spark):
    rows = [
        (a, b)
        for (a, b), n in {
            ("r", "x"): 10, ("r", "y"): 10, ("r", "z"): 20,
            ("s", "x"): 20, ("s", "y"): 20, ("s", "z"): 20,
        }.items()
        for _ in range(n)
    ]
    found = relations.associations(spark.createDataFrame(rows, "a string, b string"))
    row = found.withColumn(
        "p", pvalues.chi_square_p(F.col("chi_square"), F.col("dof").cast("double"))
    ).first()
    assert row["chi_square"] == pytest.approx(2.7777777778)
    assert row["dof"] == 2
    assert row["p"] == pytest.approx(0.2493522088)


@pytest.mark.parametrize(
    "cells, chi", [({"rx": 12, "ry": 5, "sx": 3, "sy": 9}, 4.1714577497), ({"rx": 4, "sy": 6}, 6.2673611)]
)
def test_chi_square_with_yates(spark, cells, chi):
    rows = [(k[0], k[1]) for k, n in cells.items() for _ in range(n)]
    found = relations.associations(spark.createDataFrame(rows, "a string, b string")).first()
    # By definition, over all four cells, also those that never occur.
    n = sum(cells.values())
    total = 0.0
    for a in "rs":
        for b in "xy":
            row = sum(v for k, v in cells.items() if k[0] == a)
            col = sum(v for k, v in cells.items() if k[1] == b)
            e = row * col / n
            total += max(abs(cells.get(a + b, 0) - e) - 0.5, 0) ** 2 / e
    assert found["chi_square"] == pytest.approx(total)
    assert found["chi_square"] == pytest.approx(chi, rel=1e-6)
    assert found["cramers_v"] == pytest.approx(math.sqrt(total / n))


def test_pearson(spark):
    rows = list(zip(map(float, range(1, 8)), [10.0, 9.0, 2.5, 6.0, 4.0, 3.0, 2.0]))
    found = relations.numeric_relations(spark.createDataFrame(rows, "x double, y double"), 0.0)
    row = found.first()
    assert row["r"] == pytest.approx(-0.8285038836)
    assert row["p"] == pytest.approx(0.0212802600)
    assert row["relationship_type"] == "negative_strong"


def test_anova(spark):
    rows = [(x, f"g{i}") for i, group in enumerate(ANOVA) for x in group]
    found = relations.variance_by_category(spark.createDataFrame(rows, "x double, g string"))
    row = found.withColumn(
        "p",
        pvalues.anova_p(F.col("f_statistic"), F.col("k").cast("double"), F.col("n").cast("double")),
    ).first()
    assert row["f_statistic"] == pytest.approx(7.1210194716)
    assert row["p"] == pytest.approx(0.0002812242, rel=1e-6)


def test_tails_at_their_limits():
    assert pvalues.pearson_p_value(1.0, 10) == 0.0
    assert pvalues.pearson_p_value(0.5, 2) == 1.0
    assert pvalues.pearson_p_value(0.5, 1) is None
    assert pvalues.anova_p_value(3.0, 5, 5) is None
    assert pvalues.anova_p_value(float("inf"), 2, 5) == 0.0
    assert pvalues.chi_square_p_value(0.0, 3) == 1.0
    assert pvalues.chi_square_p_value(4.0, 0) is None
    # Two degrees of freedom: exp(-x / 2); one: two-sided normal.
    assert pvalues.chi_square_p_value(3.0, 2) == pytest.approx(math.exp(-1.5))
    assert pvalues.chi_square_p_value(3.841458820694124, 1) == pytest.approx(0.05)


@pytest.mark.parametrize("dof", [0.9e6, 1.1e6])
def test_chi_square_tail_is_continuous_where_the_method_changes(dof):
    x = dof + math.sqrt(2 * dof)
    assert pvalues.chi_square_p_value(x, dof) == pytest.approx(0.158655 + 0.0, abs=3e-4)


def test_anova_tail_with_many_groups():
    below = pvalues.anova_p_value(1.001, 0.9e6, 3e6)
    above = pvalues.anova_p_value(1.001, 1.1e6, 3e6)
    assert 0.2 < above < 0.4 and 0.2 < below < 0.4


def test_labels(spark):
    from sondage.functions.rules import correlation_label

    values = [0.95, 0.9, -0.9, 0.7, -0.69, 0.5, 0.2, 0.0, -0.1]
    rows = spark.createDataFrame([(v,) for v in values], "r double")
    assert [r[0] for r in rows.select(correlation_label(F.col("r"))).collect()] == [
        "positive_very_strong", "positive_very_strong", "negative_very_strong", "positive_strong",
        "negative_moderate", "positive_moderate", "positive_weak", "negative_weak", "negative_weak",
    ]


def test_tails_at_a_trillion_rows():
    """Against the normal distribution, which they have reached there."""
    import math

    def two_sided(z):
        return math.erfc(z / math.sqrt(2))

    for z in (0.01, 0.5, 1.0, 2.5, 4.0):
        n = 1e12
        assert pvalues.pearson_p_value(z / math.sqrt(n), n) == pytest.approx(two_sided(z), rel=1e-6)
        assert pvalues.anova_p_value(z * z, 2, n) == pytest.approx(two_sided(z), rel=1e-6)
        assert pvalues.chi_square_p_value(z * z, 1) == pytest.approx(two_sided(z), rel=1e-9)
        dof = 1e12
        x = dof * (1 - 2 / (9 * dof) + z * math.sqrt(2 / (9 * dof))) ** 3
        assert pvalues.chi_square_p_value(x, dof) == pytest.approx(two_sided(z) / 2, rel=1e-3)


def test_normality_at_a_trillion_rows(spark):
    from sondage.functions.normality import with_k_squared

    n = 1e12
    df = spark.createDataFrame([(n, 3 * (6 / n) ** 0.5, 2 * (24 / n) ** 0.5)], "n double, skewness double, kurtosis double")
    row = with_k_squared(df).first()
    assert row["skewness_z"] == pytest.approx(3, rel=1e-4)
    assert row["kurtosis_z"] == pytest.approx(2, rel=1e-4)


def test_chi_square_of_many_rows(spark):
    """A table of 4e12 rows as counts: the differences from the expected counts decide."""
    from sondage.operators import relations

    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x"), ("a", "y"), ("b", "x")] * 7, "u string, v string")
    row = relations.associations(df).first()
    counts = {}
    for u, v in [("a", "x"), ("b", "y"), ("c", "x"), ("a", "y"), ("b", "x")] * 7:
        counts[u, v] = counts.get((u, v), 0) + 1
    n = sum(counts.values())
    rows = {u: sum(c for (a, _), c in counts.items() if a == u) for u in "abc"}
    cols = {v: sum(c for (_, b), c in counts.items() if b == v) for v in "xy"}
    expected = sum((counts.get((u, v), 0) - rows[u] * cols[v] / n) ** 2 / (rows[u] * cols[v] / n) for u in rows for v in cols)
    assert row["chi_square"] == pytest.approx(expected)
