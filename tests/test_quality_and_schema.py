"""Quality checks, schema discovery and analysis on small tables with known answers."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import sondage
from sondage.functions.columns import categorical_columns, datetime_columns, numeric_columns
from sondage.operators import frequencies, quality, schema


@pytest.fixture(scope="module")
def parcels(spark):
    """140 parcels, each column of another semantic type."""
    n = F.col("id")
    return spark.range(140).select(
        (n * 3 + 7).alias("parcel_no"),
        F.concat_ws(" ", F.lit("to dock"), n).alias("note"),
        (n * 37 % 53).alias("weight_kg"),
        (F.sqrt(n + 2.0) * 4.25).alias("postage"),
        F.element_at(F.array(*map(F.lit, ["air", "rail", "road", "sea", "bike"])), (n % 5 + 1).cast("int")).alias("route"),
        F.concat(F.lit("dock"), n, F.lit("@port.test")).alias("contact"),
    )


@pytest.fixture(scope="module")
def readings(spark):
    """90 readings of two gauges at four stations, some with an alarm."""
    n = F.col("id")
    return spark.range(90).select(
        (F.sin(n * 1.7) * 3).alias("level"),
        (20 + F.cos(n * 0.3) * 5 + n / 45).alias("flow"),
        F.element_at(F.array(*map(F.lit, ["north", "east", "south", "west"])), (n * n % 4 + 1).cast("int")).alias("station"),
        (n % 7 == 0).cast("int").alias("alarm"),
    )


def test_schema_of_parcels(parcels):
    found = sondage.discover_schema(parcels, key=["parcel_no"])
    overview = found.overview.first()
    assert (overview["total_rows"], overview["total_columns"]) == (140, 6)
    assert overview["data_quality_score"] >= 90 and overview["band"] == "good"
    types = {r["column_name"]: r for r in found.columns.collect()}
    assert {c: r["inferred_type"] for c, r in types.items()} == {
        "parcel_no": "identifier", "note": "text", "weight_kg": "integer", "postage": "numeric",
        "route": "categorical", "contact": "email",
    }
    assert types["parcel_no"]["null_count"] == 0 and types["parcel_no"]["unique_pct"] == 100.0
    assert found.recommendations.count() == 0
    samples = {r["column_name"]: r["sample_values"] for r in found.samples.collect()}
    assert all(len(v) == 5 for v in samples.values()) and set(samples) == set(parcels.columns)


def test_schema_of_a_sample(parcels):
    found = sondage.discover_schema(parcels, sample_size=60)
    assert found.overview.first()["total_rows"] == 60
    assert found.columns.count() == 6


def test_sample_is_repeatable_and_exact(parcels):
    draw = [r["parcel_no"] for r in schema.sample_rows(parcels, 20, ["parcel_no"]).collect()]
    again = schema.sample_rows(parcels.repartition(7), 20, ["parcel_no"]).collect()
    assert sorted(draw) == sorted(r["parcel_no"] for r in again) and len(set(draw)) == 20
    assert schema.sample_rows(parcels, 1000).count() == 140
    assert schema.sample_rows(parcels, None) is parcels


@pytest.mark.parametrize("n", [1, 40, 99, 250])
def test_sample_with_ties(spark, n):
    """A key that is not unique, and rows that repeat: exactly n rows, the same ones."""
    df = spark.range(300).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("v"))
    draws = [
        sorted(str(r) for r in schema.sample_rows(x, n, ["k"]).collect()) for x in (df, df.repartition(5), df.orderBy("v"))
    ]
    assert draws[0] == draws[1] == draws[2] and len(draws[0]) == n


def test_samples_of_values_skip_missing(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "k int, v string")
    found = {r["column_name"]: r["sample_values"] for r in schema.sample_values(df).collect()}
    assert found["v"] == ["x"] and sorted(found["k"]) == ["1", "2", "3"]


def test_analysis_tiers(readings):
    plain = sondage.analyze(readings, "descriptive")
    assert plain["numeric_summary"].count() == 3 and "statistical_tests" not in plain
    middle = sondage.analyze(readings, "statistical")
    assert middle["statistical_tests"].count() == 3 and "data_quality" not in middle
    full = sondage.analyze(readings, group_by="station")
    assert {"data_quality", "correlation_matrix", "group_stats", "distributions"} <= set(full)
    assert full["group_count"].first()["n_groups"] == readings.select("station").distinct().count()
    assert full["insights"].count() >= 3
    assert any("90" in r["message"] and "4" in r["message"] for r in full["insights"].collect())
    assert "group_stats" not in sondage.analyze(readings, group_by="nothing")
    only = sondage.analyze(readings, "descriptive", columns=["station"])
    assert "numeric_summary" not in only
    with pytest.raises(ValueError):
        sondage.analyze(readings, columns=["nothing"])
    with pytest.raises(ValueError):
        sondage.analyze(readings, "deep")


def test_roles(spark):
    df = spark.sql(
        "SELECT 1 AS i, 1.5D AS d, true AS b, 'x' AS s, current_date() AS t, now() AS ts, "
        "timestamp_ntz'2020-01-01' AS ntz, array(1) AS a, 1.5BD AS dec, interval 1 day AS iv"
    )
    assert numeric_columns(df) == ["i", "d", "dec"]
    assert categorical_columns(df) == ["s"]
    assert datetime_columns(df) == ["t", "ts", "ntz"]


def test_semantic_types(spark):
    df = spark.range(200).select(
        (F.col("id") % 3 == 0).alias("flag"),
        F.concat(F.lit("http://x/"), "id").alias("link"),
        F.lit(None).cast("string").alias("nothing"),
        F.array("id").alias("list"),
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("half"),
        F.timestamp_seconds("id").alias("at"),
    )
    found = {r["column_name"]: r for r in schema.schema_columns(schema.column_profile(df)).collect()}
    assert {c: r["inferred_type"] for c, r in found.items()} == {
        "flag": "boolean", "link": "url", "nothing": "text", "list": "unknown",
        "half": "integer", "at": "datetime",
    }
    assert found["nothing"]["null_pct"] == 100.0 and found["nothing"]["unique_count"] == 0
    assert found["list"]["unique_count"] is None
    assert found["half"]["unique_pct"] == 50.0


def test_schema_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    rows = schema.schema_columns(schema.column_profile(df)).collect()
    assert [(r["null_count"], r["null_pct"], r["unique_count"]) for r in rows] == [(0, None, 0)] * 2
    assert quality.missing_total(df).first()["missing_pct"] is None
    assert quality.duplicates(df).first()[:] == (0, 0, None)
    assert quality.score(df).first()["score"] is None


def test_distinct_counts_equal_pandas(spark):
    pdf = pd.DataFrame(
        {
            "i": [1, 1, 2, 3], "d": [1.5, float("nan"), 1.5, 0.0], "s": ["a", None, "a", "b" * 70],
            "l": ["x" * 99, "x" * 99, "x" * 98, "y" * 64],
        }
    )
    df = spark.createDataFrame(pdf).withColumn("t", F.make_date(F.lit(2020), F.lit(1), "i"))
    found = {r[0]: r[1] for r in frequencies.distinct_counts(df).collect()}
    assert found == {"i": 3, "d": 2, "s": 2, "l": 3, "t": 3}


def test_top_values_break_ties_by_digest(spark):
    values = ["b", "a", "c" * 64, "d" * 63, "e" * 65, "f", "f", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = frequencies.top_values(df, k=4).orderBy("rank").collect()
    single = sorted((v for v in values if v and v != "f"), key=lambda v: hashlib.sha256(v.encode()).hexdigest())
    assert [(r["value"], r["n"]) for r in rows] == [("f", 2), *[(v, 1) for v in single[:3]]]


def test_top_values_give_back_whole_long_texts(spark):
    long, other = "long " * 300, "z" * 64
    df = spark.createDataFrame([(v, "x") for v in [long, long, other, "s", "s", "s"]], "v string, w string")
    rows = {(r["column_name"], r["rank"]): (r["value"], r["n"]) for r in frequencies.top_values(df).collect()}
    assert rows == {("v", 1): ("s", 3), ("v", 2): (long, 2), ("v", 3): (other, 1), ("w", 1): ("x", 6)}


def test_duplicates_equal_pandas(spark):
    pdf = pd.DataFrame(
        {
            "a": [1.0, 1.0, None, None, 2.0, 1.0],
            "b": ["x" * 80, "x" * 80, "y", "y", "y", "x" * 79],
        }
    )
    df = spark.createDataFrame(pdf)
    for subset in (None, ["a"], ["b"]):
        found = quality.duplicates(df, subset).first()
        assert found["duplicate_rows"] == pdf.duplicated(subset=subset, keep=False).sum()
        assert found["n_rows"] == 6
    with pytest.raises(ValueError):
        quality.duplicates(df, ["z"])


def test_a_text_is_not_taken_for_its_digest(spark):
    import hashlib

    text = "long " * 30
    digest = hashlib.sha256(text.encode()).hexdigest()
    df = spark.createDataFrame([(text,), (digest,)], "t string")
    assert quality.duplicates(df).first()["duplicate_rows"] == 0
    assert frequencies.distinct_counts(df).first()["unique_values"] == 2


def test_outliers_equal_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": np.append(rng.normal(size=300), [9.0, -8.0, np.nan])})
    df = spark.createDataFrame(pdf)
    x = pdf["x"].dropna()
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    out = x[(x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))]
    row = quality.outliers(df, ["x"]).first()
    assert row["outlier_count"] == len(out)
    assert row["lower"] == pytest.approx(q1 - 1.5 * (q3 - q1))
    z = ((x - x.mean()) / x.std()).abs() > 3
    assert quality.outliers(df, ["x"], "zscore").first()["outlier_count"] == z.sum()
    values = [r["value"] for r in quality.outlier_values(df, "x", limit=3).collect()]
    assert values == sorted(out)[:3]


def test_outliers_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert quality.outliers(df, ["x"], "zscore").first()["outlier_count"] == 0
    assert quality.outliers(df, ["x"]).first()["outlier_count"] == 0


def test_outlier_arguments_are_checked(spark):
    df = spark.createDataFrame([("a", 1)], "s string, x int")
    with pytest.raises(ValueError):
        quality.outliers(df, ["x"], "median")
    with pytest.raises(ValueError):
        quality.outliers(df, ["s"])
    with pytest.raises(ValueError):
        quality.outliers(df, ["nothing"])


def test_score_and_band(spark):
    rows = [(None, "a")] * 3 + [(i, str(i)) for i in range(7)]
    row = quality.score(spark.createDataFrame(rows, "x int, s string")).first()
    # 15 % missing, 30 % in duplicated rows.
    assert (row["missing_pct"], row["duplicate_pct"], row["score"]) == (15.0, 30.0, 70.0)
    assert row["band"] == "fair"


def test_bytes(spark):
    df = spark.createDataFrame(
        [("é", 1.0, [1.0, 2.0]), (None, float("nan"), None)], "s string, d double, a array<double>"
    )
    assert {r[0]: r[1] for r in quality.data_bytes(df).collect()} == {"s": 2, "d": 8, "a": 16}
