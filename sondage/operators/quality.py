"""Missing values, duplicates, outliers, types and sizes."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.functions.columns import (
    TEXT,
    column,
    nan_as_null,
    numeric_columns,
    percent,
    require,
    require_numeric,
    role,
    row_hashes,
)
from sondage.functions.rules import quality_band, quality_score
from sondage.operators.stats import column_stats

OUTLIER_Z = 3.0
FENCE = 1.5
# Bytes of one value of a fixed-width type.
FIXED_WIDTHS = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4,
    "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8,
}


def null_counts(df: DataFrame) -> DataFrame:
    """Rows (column_name, n_rows, missing, bytes) for every column, from one aggregation.

    ``bytes`` is the uncompressed size of the non-missing values; if it is not used, the
    columns are read for their nulls only.
    """
    clean = nan_as_null(df)
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(column(f.name).isNull()).alias("missing"),
            _bytes_of(f).alias("bytes"),
        )
        for f in df.schema.fields
    ]
    return clean.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def missing(df: DataFrame, nulls: DataFrame | None = None) -> DataFrame:
    """Rows (column_name, missing, missing_pct) of the columns that miss any value.

    ``nulls``, here and below, are the null_counts if they are at hand.
    """
    return (
        (null_counts(df) if nulls is None else nulls)
        .where(F.col("missing") > 0)
        .select(
            "column_name", "missing", percent(F.col("missing"), F.col("n_rows")).alias("missing_pct")
        )
    )


def missing_total(df: DataFrame, nulls: DataFrame | None = None) -> DataFrame:
    """One row (total_cells, missing_cells, missing_pct)."""
    return (
        (null_counts(df) if nulls is None else nulls)
        .agg(F.sum("n_rows").alias("total_cells"), F.sum("missing").alias("missing_cells"))
        .withColumn("missing_pct", percent(F.col("missing_cells"), F.col("total_cells")))
    )


def duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row (n_rows, duplicate_rows, duplicate_pct).

    Every member of a set of equal rows counts. Missing values are equal to each other.
    Rows are counted by two hashes of together 16 bytes, so the shuffle stays narrow.
    """
    names = list(subset) if subset else df.columns
    require(df, names)
    one, two = row_hashes(df, names)
    rows = nan_as_null(df).select(one.alias("one"), two.alias("two"))
    counted = rows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
    ).withColumn("duplicate_pct", percent(F.col("duplicate_rows"), F.col("n_rows")))


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column_name, value) of the non-missing values, as doubles."""
    clean = nan_as_null(df).select(*[column(c).cast("double").alias(c) for c in columns])
    return clean.unpivot([], [column(c) for c in columns], "column_name", "value").where(
        F.col("value").isNotNull()
    )


def fences(df: DataFrame, columns: Sequence[str], method: str = "iqr") -> DataFrame:
    """Rows (column_name, n, lower, upper, mean, std) beyond which a value is an outlier."""
    if method not in ("iqr", "zscore"):
        raise ValueError(f"Unknown method: {method}")
    require_numeric(df, list(columns))
    if method == "iqr":
        spread = F.col("q3") - F.col("q1")
        return column_stats(df, columns, ["n"], {"q1": 0.25, "q3": 0.75}).select(
            "column_name", "n",
            (F.col("q1") - FENCE * spread).alias("lower"),
            (F.col("q3") + FENCE * spread).alias("upper"),
        )
    return column_stats(df, columns, ["n", "mean", "std"]).select(
        "column_name", "n", "mean", "std"
    )


def _is_outlier(method: str) -> Column:
    if method == "iqr":
        return (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return F.abs(F.try_divide(F.col("value") - F.col("mean"), F.col("std"))) > OUTLIER_Z


def outliers(df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr") -> DataFrame:
    """Rows (column_name, [lower, upper,] outlier_count, outlier_pct).

    The bounds have one row per column and are broadcast to a second scan.
    """
    columns = list(columns or numeric_columns(df))
    bounds = fences(df, columns, method)
    shown = ["lower", "upper"] if method == "iqr" else []
    flagged = _long(df, columns).join(F.broadcast(bounds), "column_name")
    counted = flagged.groupBy("column_name").agg(
        F.max("n").alias("n"),
        *[F.max(c).alias(c) for c in shown],
        F.count_if(_is_outlier(method)).alias("outlier_count"),
    )
    return counted.select(
        "column_name", *shown, "outlier_count",
        percent(F.col("outlier_count"), F.col("n")).alias("outlier_pct"),
    )


def outlier_values(
    df: DataFrame, name: str, method: str = "iqr", limit: int = 100
) -> DataFrame:
    """Rows (column_name, value): the ``limit`` smallest outlying values, as a top-k."""
    bounds = fences(df, [name], method)
    return (
        _long(df, [name])
        .join(F.broadcast(bounds), "column_name")
        .where(_is_outlier(method))
        .select("column_name", "value")
        .orderBy("value")
        .limit(limit)
    )


def column_types(df: DataFrame, nulls: DataFrame | None = None) -> DataFrame:
    """Rows (column_name, data_type, role, present): present counts non-missing values."""
    kinds = F.create_map(
        *[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())]
    )
    roles = F.create_map(
        *[F.lit(x) for f in df.schema.fields for x in (f.name, role(f.dataType))]
    )
    return (null_counts(df) if nulls is None else nulls).select(
        "column_name",
        F.element_at(kinds, F.col("column_name")).alias("data_type"),
        F.element_at(roles, F.col("column_name")).alias("role"),
        (F.col("n_rows") - F.col("missing")).alias("present"),
    )


def type_distribution(df: DataFrame, nulls: DataFrame | None = None) -> DataFrame:
    """Rows (data_type, n_columns)."""
    return column_types(df, nulls).groupBy("data_type").agg(F.count(F.lit(1)).alias("n_columns"))


def _value_bytes(field: T.StructField) -> Column:
    c = column(field.name)
    if isinstance(field.dataType, TEXT + (T.BinaryType,)):
        return F.octet_length(c)
    if isinstance(field.dataType, T.ArrayType):
        width = FIXED_WIDTHS.get(field.dataType.elementType.simpleString())
        if width:
            return F.size(c) * F.lit(width)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.octet_length(F.to_json(c))
    if isinstance(field.dataType, T.DecimalType):
        return F.lit(8 if field.dataType.precision <= 18 else 16)
    return F.lit(FIXED_WIDTHS.get(field.dataType.simpleString(), 8))


def data_bytes(df: DataFrame) -> DataFrame:
    """Rows (column_name, bytes): uncompressed size of the non-missing values."""
    return null_counts(df).select("column_name", "bytes")


def _bytes_of(field: T.StructField) -> Column:
    size = F.sum(F.when(column(field.name).isNotNull(), _value_bytes(field).cast("bigint")))
    return F.coalesce(size, F.lit(0).cast("bigint"))


def score(
    df: DataFrame, missed: DataFrame | None = None, doubled: DataFrame | None = None
) -> DataFrame:
    """One row (missing_pct, duplicate_pct, score, band).

    ``missed`` and ``doubled`` are missing_total and duplicates, if they are at hand.
    """
    missed = (missing_total(df) if missed is None else missed).select("missing_pct")
    doubled = (duplicates(df) if doubled is None else doubled).select("duplicate_pct")
    both = missed.withColumn("duplicate_pct", doubled.scalar())
    scored = quality_score(F.col("missing_pct"), F.col("duplicate_pct"))
    return both.withColumn("score", scored).withColumn("band", quality_band(F.col("score")))


def report(
    df: DataFrame,
    missed: DataFrame | None = None,
    doubled: DataFrame | None = None,
    nulls: DataFrame | None = None,
) -> DataFrame:
    """Shape, missing values, duplicates, types and size as rows (section, key, value)."""

    def section(name: str, key: Column, value: Column) -> list[Column]:
        return [F.lit(name).alias("section"), key.alias("key"), value.cast("double").alias("value")]

    def one_row(name: str, table: DataFrame, keys: list[str]) -> DataFrame:
        pairs = F.array(
            *[
                F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value"))
                for k in keys
            ]
        )
        return table.select(F.lit(name).alias("section"), F.inline(pairs))

    # One scan for counts and bytes; everything but the duplicates follows from it.
    nulls = null_counts(df) if nulls is None else nulls
    missed = missing_total(df, nulls) if missed is None else missed
    doubled = duplicates(df) if doubled is None else doubled
    shape = nulls.agg(F.max("n_rows").alias("rows"), F.count(F.lit(1)).alias("columns"))
    parts = [
        one_row("shape", shape, ["rows", "columns"]),
        one_row("missing_values", missed, ["total_cells", "missing_cells", "missing_pct"]),
        missing(df, nulls).select(*section("missing_by_column", F.col("column_name"), F.col("missing"))),
        one_row("duplicates", doubled, ["duplicate_rows", "duplicate_pct"]),
        type_distribution(df, nulls).select(
            *section("data_types", F.col("data_type"), F.col("n_columns"))
        ),
        (nulls if "bytes" in nulls.columns else data_bytes(df))
        .agg(F.sum("bytes").alias("bytes"))
        .select(*section("size", F.lit("data_mb"), F.round(F.col("bytes") / 1048576.0, 2))),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
