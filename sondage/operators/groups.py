"""Statistics per value of one column. Rows with a missing key are left out."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.functions.columns import column, nan_as_null, numeric_columns, require, rounded
from sondage.operators.stats import column_stats


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    require(df, [key])
    return (
        nan_as_null(df)
        .where(column(key).isNotNull())
        .groupBy(column(key).alias("group_value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def group_count(df: DataFrame, key: str) -> DataFrame:
    return group_sizes(df, key).agg(F.count(F.lit(1)).alias("n_groups")).select(
        F.lit(key).alias("group_column"), "n_groups"
    )


def group_stats(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (group_value, column_name, mean, median, std, min, max), rounded to 4 dp.

    All numeric columns by default, the key itself included if it is one.
    """
    columns = list(columns or numeric_columns(df))
    if not columns:
        raise ValueError("Groups are described by numbers, and the table has none")
    found = column_stats(df, columns, ["mean", "std", "min", "max"], {"median": 0.5}, keys=[key])
    return found.select(
        column(key).alias("group_value"),
        "column_name",
        *[rounded(F.col(s), 4).alias(s) for s in ("mean", "median", "std", "min", "max")],
    )
