"""What each column holds: types, counts, constraints and sample values; row samples."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.functions.columns import (
    INTEGRAL,
    NESTED,
    categorical_columns,
    column,
    nan_as_null,
    numeric_columns,
    percent,
    require,
    role,
    row_digest,
)
from sondage.functions.rules import semantic_type
from sondage.operators.frequencies import distinct_counts
from sondage.operators.stats import column_stats

SEED = 42


def _kind(field: T.StructField) -> str:
    if isinstance(field.dataType, T.BooleanType):
        return "boolean"
    return role(field.dataType)


def column_profile(df: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """One row per column: role, counts, distinct count and text shares.

    Two scans: one aggregation for the counts, one value count for the distinct values,
    unless ``distinct`` has them already.
    """
    distinct = distinct_counts(df) if distinct is None else distinct
    rows = []
    for position, field in enumerate(df.schema.fields):
        c = column(field.name)
        is_text = role(field.dataType) == "categorical"

        def share(needle: str) -> Column:
            return F.avg(F.contains(c, F.lit(needle)).cast("double"))

        nothing = F.lit(None).cast("double")
        rows.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.lit(_kind(field)).alias("kind"),
                F.lit(isinstance(field.dataType, INTEGRAL)).alias("is_integer"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count(c).alias("present"),
                (share("@") if is_text else nothing).alias("at_share"),
                (share("http") if is_text else nothing).alias("http_share"),
            )
        )
    counted = nan_as_null(df).agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    # Nested columns have no distinct count; an empty table has no value rows.
    countable = F.col("kind") != "other"
    unique = F.when(countable, F.coalesce("unique_values", F.lit(0)))
    return counted.join(distinct, "column_name", "left").withColumn(
        "unique_values", unique
    )


def schema_columns(profile: DataFrame) -> DataFrame:
    """Rows (column_name, data_type, null_count, null_pct, unique_count, unique_pct,
    inferred_type) from a column_profile."""
    nulls = F.col("n_rows") - F.col("present")
    return profile.select(
        "column_name",
        "data_type",
        nulls.alias("null_count"),
        percent(nulls, F.col("n_rows")).alias("null_pct"),
        F.col("unique_values").alias("unique_count"),
        percent(F.col("unique_values"), F.col("n_rows")).alias("unique_pct"),
        inferred_type(profile).alias("inferred_type"),
    )


def inferred_type(profile: DataFrame) -> Column:
    return semantic_type(
        *[
            profile[c]
            for c in (
                "kind", "is_integer", "unique_values", "n_rows", "present", "at_share", "http_share",
            )
        ]
    )


def semantic_types(df: DataFrame) -> DataFrame:
    profile = column_profile(df)
    return profile.select("column_name", inferred_type(profile).alias("inferred_type"))


def numeric_constraints(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Rows (column_name, min, max, mean, median, std) of numeric columns with values.

    ``stats`` are describe.whole_stats, if they are at hand.
    """
    columns = numeric_columns(df)
    if stats is None:
        stats = column_stats(df, columns, ["n", "min", "max", "mean", "std"], {"median": 0.5})
    else:
        stats = stats.withColumnRenamed("p50", "median")
    return stats.where(F.col("n") > 0).select(
        "column_name", "min", "max", "mean", "median", "std"
    )


def text_constraints(df: DataFrame) -> DataFrame:
    """Rows (column_name, min_length, max_length, avg_length) in characters."""
    rows = []
    for name in categorical_columns(df):
        length = F.char_length(column(name))
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.min(length).alias("min_length"),
                F.max(length).alias("max_length"),
                F.avg(length).alias("avg_length"),
            )
        )
    if not rows:
        return df.sparkSession.createDataFrame(
            [], "column_name string, min_length int, max_length int, avg_length double"
        )
    return (
        df.agg(F.array(*rows).alias("rows"))
        .select(F.inline("rows"))
        .where(F.col("min_length").isNotNull())
    )


def _draw(key: Sequence[str], seed: int, salt: str = "") -> Column:
    """A number that orders rows at random, the same on every run: 32 hex digits.

    Made from the named key columns, which should identify a row.
    """
    text = [column(k).cast("string") for k in key]
    return F.md5(F.concat_ws("|", *text, F.lit(f"{salt}{seed}")))


def sample_rows(
    df: DataFrame, n: int | None, key: Sequence[str] | None = None, seed: int = SEED
) -> DataFrame:
    """Exactly n rows at random, or all if the table has no more; ties by a digest of the
    whole row.

    The rows with the smallest hashes of the key columns (all columns by default): a
    second run draws the same rows. Where the n-th hash lies is found by counting hashes
    by their first four digits, then by the next four; only the rows that share all eight
    with it, one in four billion and those equal to them, are ranked in one place.
    """
    if not n:
        return df
    if key:
        require(df, list(key))
    digest = F.hex(row_digest(df, df.columns))
    named = _draw(key, seed) if key else F.md5(F.concat(digest, F.lit(f"|{seed}")))
    drawn = df.select("*", named.alias("_draw"), digest.alias("_row"))

    def cell(rows: DataFrame, start: int, before: Column) -> Column:
        """(part, before) of the cell of four digits in which the n-th row lies."""
        counts = rows.groupBy(F.substring("_draw", start, 4).alias("part")).agg(
            F.count(F.lit(1)).alias("n")
        )  # at most 65,536 rows
        upto = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) + before
        found = counts.select("part", (upto - F.col("n")).alias("before"), upto.alias("upto"))
        found = found.where((F.col("before") < n) & (F.col("upto") >= n))
        return found.agg(F.first(F.struct("part", "before")).alias("cell")).scalar()

    first = cell(drawn, 1, F.lit(0))
    drawn = drawn.withColumn("_first", first)
    part = F.substring("_draw", 1, 4)
    inside = drawn.where(part == F.col("_first.part"))
    second = cell(inside, 5, F.coalesce(first["before"], F.lit(0)))
    drawn = drawn.withColumn("_second", second)
    head, last = F.col("_draw"), F.concat("_first.part", "_second.part")
    # Without a cell the table has no more than n rows.
    whole = drawn.where(F.col("_first").isNull() | (F.substring(head, 1, 8) < last))
    edge = drawn.where(F.substring(head, 1, 8) == last)
    rank = F.row_number().over(W.orderBy("_draw", "_row"))
    edge = edge.withColumn("_rank", rank).where(F.col("_rank") + F.col("_second.before") <= n)
    names = [column(c) for c in df.columns]
    return whole.select(*names).union(edge.select(*names))


def sample_values(
    df: DataFrame, key: Sequence[str] | None = None, n: int = 5, seed: int = SEED
) -> DataFrame:
    """Rows (column_name, sample_values): up to n values of rows drawn at random among
    those where the column is present, as strings in drawing order.

    One top-k per column, reading that column and the key only. Without a key a hash of
    the whole row orders the rows, then the value.
    """
    if key:
        require(df, list(key))
    clean = nan_as_null(df)
    result = None
    for field in df.schema.fields:
        c = column(field.name)
        if isinstance(field.dataType, NESTED):
            c = F.to_json(c)
        if key:
            draw = _draw(key, seed, f"{field.name}:")
        else:
            row = F.hex(row_digest(df, df.columns))
            draw = F.md5(F.concat_ws("|", row, F.lit(f"{field.name}:{seed}")))
        drawn = (
            clean.where(column(field.name).isNotNull())
            .select(c.cast("string").alias("value"), draw.alias("draw"))
            .orderBy("draw", "value")
            .limit(n)
            .agg(F.array_sort(F.collect_list(F.struct("draw", "value")))["value"].alias("values"))
            .where(F.size("values") > 0)
            .select(F.lit(field.name).alias("column_name"), F.col("values").alias("sample_values"))
        )
        result = drawn if result is None else result.unionByName(drawn)
    return result
