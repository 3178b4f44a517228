"""Distinct counts and most frequent values, from value counts per column.

Several count(DISTINCT ...) in one query make Spark expand every row into one copy per
column, each as wide as all columns. Here the columns become (column, value) rows, with a
slot for each type, counted with map-side combine in one scan, and reduced again.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.functions.columns import (
    DIGEST_LENGTH,
    FRACTIONAL,
    INTEGRAL,
    NESTED,
    TEXT,
    categorical_columns,
    column,
    identity_key,
    in_slots,
    nan_as_null,
    require,
)


def _common_type(data_type: T.DataType) -> str:
    if isinstance(data_type, INTEGRAL):
        return "bigint"
    if isinstance(data_type, FRACTIONAL):
        return "double"
    if isinstance(data_type, TEXT + (T.BinaryType,)):
        return "string"
    return data_type.simpleString()


def countable_columns(df: DataFrame) -> list[str]:
    """Columns whose values can be told apart cheaply: all but nested ones."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)]


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (column_name, unique_values); missing values are not counted."""
    columns = list(columns) if columns is not None else countable_columns(df)
    require(df, columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, unique_values bigint")
    types = [df.schema[n].dataType for n in columns]
    values = [identity_key(n, t) for n, t in zip(columns, types, strict=True)]
    rows, slots = in_slots(nan_as_null(df), values, [_common_type(t) for t in types])
    name = F.get(F.array(*[F.lit(n) for n in columns]), F.col("_id"))
    return (
        rows.distinct()
        .groupBy("_id")
        .agg(F.count_if(reduce(Column.__or__, [F.col(s).isNotNull() for s in slots])).alias("unique_values"))
        .select(name.alias("column_name"), "unique_values")
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """Rows (column_name, value, n, rank): the k most frequent values, ties by the SHA-256
    of the value.

    Values are counted, ranked and shuffled by their identity_key, so long texts travel
    as digests; the rank filter is pushed below the shuffle. Only the texts of the few long values that made it are then looked up, in a
    second scan that Spark leaves out when there are none.
    """
    columns = list(columns) if columns is not None else categorical_columns(df)
    require(df, columns)
    keys = df.select(*[identity_key(n, df.schema[n].dataType).alias(n) for n in columns])
    counted = (
        keys.unpivot([], [column(n) for n in columns], "column_name", "key")
        .where(F.col("key").isNotNull())
        .groupBy("column_name", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    is_digest = F.char_length("key") == DIGEST_LENGTH
    digest = F.when(is_digest, F.col("key")).otherwise(F.sha2("key", 256))
    by_count = W.partitionBy("column_name").orderBy(F.desc("n"), digest)
    top = counted.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= k)

    texts = F.array(
        *[
            F.struct(
                F.lit(n).alias("column_name"),
                identity_key(n, df.schema[n].dataType).alias("key"),
                column(n).cast("string").alias("text"),
            )
            for n in columns
        ]
    )
    wanted = top.where(is_digest).select("column_name", "key")  # at most k per column
    found = (
        df.select(F.inline(texts))
        .where(is_digest)
        .join(F.broadcast(wanted), ["column_name", "key"])
        .groupBy("column_name", "key")
        .agg(F.any_value("text").alias("text"))
    )
    return top.join(F.broadcast(found), ["column_name", "key"], "left").select(
        "column_name", F.coalesce("text", "key").alias("value"), "n", "rank"
    )
