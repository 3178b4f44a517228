"""Descriptive and distribution statistics: one row per column."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.functions.columns import (
    categorical_columns,
    column,
    numeric_columns,
    require,
    rounded,
)
from sondage.functions.normality import k_squared_p, with_k_squared
from sondage.operators.frequencies import distinct_counts, top_values
from sondage.operators.stats import MOMENTS, column_stats

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
PERCENTILES = {**QUARTILES, "p95": 0.95}
# Skewness, kurtosis, normality, range and percentiles need more values than this.
FEW = 3


def project(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The given columns only; an unknown name is an error."""
    if not columns:
        return df
    require(df, list(columns))
    return df.select(*[column(c) for c in columns])


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns))
    )


def whole_moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every moment, from one aggregation."""
    return column_stats(df, list(columns or numeric_columns(df)), list(MOMENTS))


def whole_stats(
    df: DataFrame, columns: Sequence[str] | None = None, moments: DataFrame | None = None
) -> DataFrame:
    """Every moment and percentile: the functions below take it as ``stats`` where several
    of them are wanted of the same columns. ``moments`` are those of ``whole_moments``."""
    return column_stats(
        df, list(columns or numeric_columns(df)), list(MOMENTS), PERCENTILES, base=moments
    )


def numeric_summary(
    df: DataFrame, columns: Sequence[str] | None = None, stats: DataFrame | None = None
) -> DataFrame:
    """Rows (column_name, n, mean, std, min, p25, p50, p75, max)."""
    columns = list(columns or numeric_columns(df))
    if stats is None:
        stats = column_stats(df, columns, ["n", "mean", "std", "min", "max"], QUARTILES)
    return stats.select(
        "column_name", "n", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def categorical_unique(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return distinct_counts(df, columns or categorical_columns(df))


def categorical_top(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    return top_values(df, columns, k)


def moments(
    df: DataFrame, columns: Sequence[str] | None = None, stats: DataFrame | None = None
) -> DataFrame:
    """Biased skewness and excess kurtosis, NULL for three values or fewer."""
    columns = list(columns or numeric_columns(df))
    enough = F.col("n") > FEW
    if stats is None:
        stats = column_stats(df, columns, ["n", "skewness", "kurtosis"])
    return stats.select(
        "column_name",
        "n",
        *[F.when(enough, rounded(F.col(s), 4)).alias(s) for s in ("skewness", "kurtosis")],
    )


def normality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (column_name, n, k2, p_value, is_normal)."""
    columns = list(columns or numeric_columns(df))
    tested = with_k_squared(column_stats(df, columns, ["n", "skewness", "kurtosis"]))
    p = k_squared_p(F.col("k2"))
    return tested.select(
        "column_name",
        "n",
        rounded(F.col("k2"), 4).alias("k2"),
        rounded(p, 6).alias("p_value"),
        (p > 0.05).alias("is_normal"),
    )


def value_range(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    enough = F.col("n") > FEW
    return column_stats(df, columns, ["n", "min", "max"]).select(
        "column_name",
        "n",
        F.when(enough, F.col("min")).alias("min"),
        F.when(enough, F.col("max")).alias("max"),
        F.when(enough, F.col("max") - F.col("min")).alias("range"),
    )


def percentiles(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    enough = F.col("n") > FEW
    return column_stats(df, columns, ["n"], PERCENTILES).select(
        "column_name", "n", *[F.when(enough, F.col(p)).alias(p) for p in PERCENTILES]
    )


def statistical_tests(
    df: DataFrame, columns: Sequence[str] | None = None, stats: DataFrame | None = None
) -> DataFrame:
    """moments, normality, value_range and percentiles together, from the same passes."""
    columns = list(columns or numeric_columns(df))
    wanted = ["n", "skewness", "kurtosis", "min", "max"]
    if stats is None:
        stats = column_stats(df, columns, wanted, PERCENTILES)
    tested = with_k_squared(stats.where(F.col("n") > FEW))
    p = k_squared_p(F.col("k2"))
    return tested.select(
        "column_name",
        "n",
        rounded(p, 6).alias("normality_p_value"),
        (p > 0.05).alias("is_normal"),
        rounded(F.col("skewness"), 4).alias("skewness"),
        rounded(F.col("kurtosis"), 4).alias("kurtosis"),
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("range"),
        *PERCENTILES,
    )


def distributions(
    df: DataFrame, columns: Sequence[str] | None = None, stats: DataFrame | None = None
) -> DataFrame:
    """Rows (column_name, mean, median, mode, std, variance, cv); cv NULL at mean 0."""
    columns = list(columns or numeric_columns(df))
    if stats is None:
        found = column_stats(df, columns, ["n", "mean", "std", "variance"], {"median": 0.5}, mode=True)
    else:
        named = stats.withColumnRenamed("p50", "median")
        found = column_stats(
            df, columns, ["n", "mean", "std", "variance", "median"], mode=True, base=named
        )
    return found.where(F.col("n") > 0).select(
        "column_name",
        rounded(F.col("mean"), 4).alias("mean"),
        rounded(F.col("median"), 4).alias("median"),
        "mode",
        rounded(F.col("std"), 4).alias("std"),
        rounded(F.col("variance"), 4).alias("variance"),
        rounded(F.try_divide("std", "mean"), 4).alias("cv"),
    )
