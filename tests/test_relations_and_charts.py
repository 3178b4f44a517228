"""Relations between columns and the rows behind charts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import sondage
from sondage.operators import charts, describe, findings, relations


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({"x": rng.normal(size=n), "noise": rng.normal(size=n)})
    pdf["y"] = -2 * pdf["x"] + rng.normal(0, 0.1, n)
    pdf["flat"] = 1.0
    pdf["gap"] = np.where(rng.random(n) < 0.3, np.nan, pdf["x"] + rng.normal(0, 0.5, n))
    pdf["sign"] = np.where(pdf["x"] > 0, "plus", "minus")
    pdf["side"] = np.where(pdf["y"] > 0, "up", "down")
    pdf["one"] = "same"
    return pdf, spark.createDataFrame(pdf)


def test_correlations_equal_pandas(mixed):
    pdf, df = mixed
    numbers = ["x", "noise", "y", "flat", "gap"]
    matrix = relations.correlation_matrix(df).toPandas().pivot(
        index="column1", columns="column2", values="correlation"
    )
    wanted = pdf[numbers].corr().round(4)
    assert np.allclose(matrix.loc[numbers, numbers], wanted, atol=1.1e-4, equal_nan=True)


def test_relationships_are_ranked_and_cut(mixed):
    _, df = mixed
    rows = relations.relationships(df, limit=None).collect()
    strengths = [abs(r["strength"]) for r in rows]
    assert strengths == sorted(strengths, reverse=True)
    top = rows[0]
    assert {top["column1"], top["column2"]} == {"x", "y"}
    assert top["relationship_type"] == "negative_very_strong" and top["p_value"] == 0.0
    assert top["description"].startswith("x and y: negative_very_strong, |r| = 1.00")
    kinds = {r["relationship_type"] for r in rows}
    assert {"categorical_association", "numeric_categorical"} <= kinds
    assert not any("one" in (r["column1"], r["column2"]) for r in rows)
    assert len(relations.relationships(df, limit=2).collect()) == 2
    # An explicit zero keeps every defined pair; flat has none.
    every = relations.numeric_relations(df, 0.0).collect()
    assert len(every) == 6


def test_insights_and_total_are_about_all(mixed):
    _, df = mixed
    found, every = sondage.find_relationships(df, limit=1), sondage.find_relationships(df, limit=None)
    assert found.relationships.count() == 1 < every.relationships.count()
    assert found.total.first()[0] == every.relationships.count()
    assert sorted(found.insights.collect()) == sorted(every.insights.collect())
    assert found.correlation_matrix.count() == 25


def test_nothing_to_relate(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    found = sondage.find_relationships(df)
    assert found.correlation_matrix is None
    assert [r["rule"] for r in found.insights.collect()] == ["none"]


def test_hot_value_and_unique_value_columns(spark):
    """A third of all rows share a category that meets many values of the other column."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("a"),
        F.concat(F.lit("u"), F.col("id") % 700).alias("b"),
        F.col("id").cast("double").alias("x"),
    )
    pdf = df.toPandas()
    o = pd.crosstab(pdf["a"], pdf["b"]).to_numpy()
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    row = relations.associations(df).first()
    assert row["chi_square"] == pytest.approx(((o - e) ** 2 / e).sum())
    assert row["dof"] == (o.shape[0] - 1) * (o.shape[1] - 1)
    groups = [g["x"].to_numpy() for _, g in pdf.groupby("a")]
    between = sum(len(g) * (g.mean() - pdf["x"].mean()) ** 2 for g in groups)
    eta = {r["column2"]: r["eta_squared"] for r in relations.variance_by_category(df).collect()}
    assert eta["a"] == pytest.approx(between / ((pdf["x"] - pdf["x"].mean()) ** 2).sum())


def test_many_numeric_columns_take_several_passes(spark):
    df = spark.range(60).select(
        (F.col("id") % 3).cast("string").alias("s"), *[(F.col("id") % (c + 2)).alias(f"c{c}") for c in range(12)]
    )
    rows = relations.variance_by_category(df).collect()
    alone = {c: relations.variance_by_category(df, [c]).first()["eta_squared"] for c in ("c1", "c11")}
    assert sorted((r["i"], r["column1"]) for r in rows) == [(i, f"c{i}") for i in range(12)]
    assert {r["column1"]: r["eta_squared"] for r in rows if r["column1"] in alone} == pytest.approx(alone)
    assert relations.correlations(df).count() == 66
    assert len(describe.moments(df).collect()) == 12


def test_a_category_per_row_explains_nothing(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("s"), F.rand(3).alias("x"))
    row = relations.variance_by_category(df).first()
    assert row["f_statistic"] is None and relations.mixed_relations(df).count() == 0


def test_constant_groups(spark):
    df = spark.createDataFrame([("a", 1.0)] * 4 + [("b", 2.0)] * 4, "s string, x double")
    row = relations.mixed_relations(df).first()
    assert row["f_statistic"] == float("inf") and row["p"] == 0.0 and row["eta_squared"] == 1.0


def test_thresholds_of_findings(spark):
    missing = spark.createDataFrame([(10, 1, 10.0)], "total_cells int, missing_cells int, missing_pct double")
    doubled = spark.createDataFrame([(10, 1, 5.0)], "n_rows int, duplicate_rows int, duplicate_pct double")
    assert findings.warnings(missing, doubled, None).count() == 0
    more = missing.withColumn("missing_pct", F.lit(10.01))
    assert [r["message"] for r in findings.warnings(more, doubled, None).collect()] == [
        "Missing cells: 10.01%"
    ]


def test_histogram_equals_numpy(mixed):
    pdf, df = mixed
    rows = charts.histogram(df, ["x", "gap", "flat"]).toPandas()
    for c in ("x", "gap", "flat"):
        counts, edges = np.histogram(pdf[c].dropna(), bins=30)
        ours = rows[rows["column_name"] == c].sort_values("bin")
        assert ours["n"].tolist() == counts.tolist()
        assert np.allclose(ours["lo"], edges[:-1]) and np.allclose(ours["hi"], edges[1:])


def test_distribution_equals_numpy(mixed):
    pdf, df = mixed
    rows = charts.distribution(df, ["x", "noise"]).toPandas()
    for c in ("x", "noise"):
        counts, _ = np.histogram(pdf[c], bins="auto")
        ours = rows[rows["column_name"] == c]
        assert ours["bins"].iloc[0] == len(counts)
        filled = np.zeros(len(counts), int)
        filled[ours["bin"]] = ours["n"]
        assert filled.tolist() == counts.tolist()


def test_density_of_cells_is_close_to_exact(mixed):
    pdf, df = mixed
    exact = charts.density(df, ["x"], exact=True).orderBy("point").toPandas()
    cells = charts.density(df, ["x"]).orderBy("point").toPandas()
    peak = exact["density"].max()
    assert np.abs(exact["density"] - cells["density"]).max() < 1e-4 * peak
    x = pdf["x"].to_numpy()
    h = x.std(ddof=1) * len(x) ** -0.2
    at = np.linspace(x.min(), x.max(), 200)
    wanted = np.exp(-(((at[:, None] - x) / h) ** 2) / 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose(exact["density"], wanted)
    assert charts.density(df, ["flat"]).count() == 0


def test_line_numbers_every_row_also_with_a_hot_key(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id")).alias("k"),
        F.col("id").cast("double").alias("v"),
    )
    rows = charts.line(df, "k", ["k", "v"]).toPandas()
    keys = rows[rows["column_name"] == "k"].sort_values("idx")
    assert keys["idx"].tolist() == list(range(1000))
    assert keys["value"].is_monotonic_increasing
    assert set(rows[rows["column_name"] == "v"]["value"]) == set(range(1000))


def test_box_equals_definition(spark):
    x = np.array([1, 2, 3, 4, 5, 6, 7, 8, 100.0])
    row = charts.box(spark.createDataFrame(pd.DataFrame({"x": x}))).first()
    assert row[:] == ("x", 3.0, 5.0, 7.0, 1.0, 8.0, 1)


def test_pairplot_counts_every_point(mixed):
    pdf, df = mixed
    rows = charts.pairplot(df, ["x", "y", "gap"]).toPandas()
    sums = rows.groupby(["column1", "column2"])["n"].sum()
    assert sums[("x", "y")] == len(pdf) and sums[("x", "gap")] == pdf["gap"].notna().sum()
    h, _, _ = np.histogram2d(pdf["x"], pdf["y"], bins=30)
    xy = rows[(rows["column1"] == "x") & (rows["column2"] == "y")]
    assert sorted(xy["n"]) == sorted(h[h > 0].astype(int))


def test_heatmap_of_a_small_table_shows_values(spark):
    df = spark.createDataFrame([(2, 5.0), (1, 7.0)], "k int, v double")
    rows = charts.heatmap(df, ["v"], order_by="k", values="raw").collect()
    assert [(r["column1"], r["column2"], r["value"]) for r in sorted(rows)] == [
        ("0", "v", 7.0), ("1", "v", 5.0)
    ]


def test_chart_arguments(spark):
    df = spark.createDataFrame([("a", 1)], "s string, x int")
    for kind in ("scatter", "correlation", "pairplot"):
        with pytest.raises(ValueError):
            charts.chart_data(df, kind)
    with pytest.raises(ValueError):
        charts.chart_data(df, "pie")
    with pytest.raises(ValueError):
        charts.chart_data(df.select("x"), "bar")
    with pytest.raises(ValueError):
        charts.chart_data(df, "heatmap", ["s"])
