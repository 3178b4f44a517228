"""A profile of data that arrives in chunks, kept as a state that merges.

Each chunk leaves one row per column: counts, mean, sums of powers of deviations from it,
extremes, a HyperLogLog sketch of the distinct values and a KLL sketch of the quantiles.
The profile of all chunks follows from these rows alone, however many there are and in
whatever order they came; old chunks are not read again. Moments are exact (the deviations
of a chunk are moved to the common mean), distinct counts and quantiles estimates with a
stated error: 2^-(HLL_BITS / 2) * 1.04 standard error, and ranks within about 1 %.

A chunk's rows have a folder of their own, so a chunk that is taken in again replaces
itself and counts once.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.functions.columns import (
    FRACTIONAL,
    column,
    identity_key,
    nan_as_null,
    numeric_columns,
    positive_zero,
)
from sondage.operators.frequencies import countable_columns
from sondage.session import new_path

HLL_BITS = 14
KLL_SIZE = 400
COLUMNS_PER_PASS = 10
PARTS = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _state(df: DataFrame, name: str, numeric: bool) -> Column:
    """What is kept of one column, as a struct; what a text has not is NULL."""
    kind = df.schema[name].dataType
    text = positive_zero(column(name)) if isinstance(kind, FRACTIONAL) else identity_key(name, kind)
    x = column(name).cast("double") if numeric else F.lit(None).cast("double")
    n = F.count(x)
    m2 = F.var_pop(x) * n
    # From the biased skewness and excess kurtosis; both are undefined without a spread.
    m3 = F.coalesce(F.skewness(x) * F.pow(m2, F.lit(1.5)) / F.sqrt(n), F.when(n > 0, 0.0))
    m4 = F.coalesce((F.kurtosis(x) + 3) * m2 * m2 / n, F.when(n > 0, 0.0))
    fields = {
        "n_rows": F.count(F.lit(1)), "n_present": F.count(column(name)), "n": n, "mean": F.avg(x),
        "m2": m2, "m3": m3, "m4": m4, "min": F.min(x), "max": F.max(x),
        "distinct": F.hll_sketch_agg(text.cast("string"), HLL_BITS),
        "quantiles": F.kll_sketch_agg_double(x, F.lit(KLL_SIZE)) if numeric else F.lit(None).cast("binary"),
    }
    return F.struct(F.lit(name).alias("column_name"), *[c.alias(k) for k, c in fields.items()])


def chunk_state(df: DataFrame) -> DataFrame:
    """The state of one chunk, a row per column, from one aggregation for ten columns.
    Columns of nested types are left out."""
    clean, numeric = nan_as_null(df), set(numeric_columns(df))
    names = countable_columns(df)
    parts = []
    for at in range(0, len(names), COLUMNS_PER_PASS):
        states = [_state(clean, n, n in numeric) for n in names[at : at + COLUMNS_PER_PASS]]
        parts.append(clean.agg(F.array(*states).alias("states")).select(F.inline("states")))
    return reduce(DataFrame.unionByName, parts)


def add_chunk(df: DataFrame, state: str, chunk: int | str) -> None:
    """Take a chunk into the state folder, in place of an earlier chunk of that name."""
    chunk_state(df).coalesce(1).write.mode("overwrite").parquet(f"{state}/chunk={chunk}")


def merged_profile(spark: SparkSession, state: str) -> DataFrame:
    """Rows (column_name, n_rows, n_missing, n, mean, std, variance, min, max, skewness,
    kurtosis, approx_distinct, p25, p50, p75) of all chunks together."""
    return merged(spark.read.parquet(state))


def merged(states: DataFrame) -> DataFrame:
    total = F.sum("n").alias("total")
    # The common mean first: one row per column.
    centre = states.groupBy("column_name").agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("centre"))
    d, n = F.col("mean") - F.col("centre"), F.col("n")
    moved = states.join(F.broadcast(centre), "column_name").withColumns(
        {
            "s2": F.col("m2") + n * d * d,
            "s3": F.col("m3") + 3 * d * F.col("m2") + n * d * d * d,
            "s4": F.col("m4") + 4 * d * F.col("m3") + 6 * d * d * F.col("m2") + n * d * d * d * d,
        }
    )
    sums = moved.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_present").alias("present"), total,
        F.first("centre").alias("mean"), *[F.sum(s).alias(s) for s in ("s2", "s3", "s4")],
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("approx_distinct"),
        F.kll_merge_agg_double("quantiles").alias("sketch"),
    )
    # Of equal values, what rounding leaves of their common mean is no spread.
    s2, total = F.when(F.col("min") < F.col("max"), F.col("s2")).otherwise(0.0), F.col("total")
    spread = F.when((total > 0) & (s2 > 0), s2)
    variance = F.when(total > 1, s2 / (total - 1))
    quantile = {
        q: F.when(total > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(q) for q, p in PARTS.items()
    }
    return sums.select(
        "column_name", "n_rows", (F.col("n_rows") - F.col("present")).alias("n_missing"), total.alias("n"), "mean",
        F.sqrt(variance).alias("std"), variance.alias("variance"), "min", "max",
        (F.sqrt(total) * F.col("s3") / F.pow(spread, F.lit(1.5))).alias("skewness"),
        (total * F.col("s4") / (spread * spread) - 3).alias("kurtosis"), "approx_distinct", *quantile.values(),
    )


def profile_in_chunks(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    state: str,
    files_per_chunk: int = 1,
    source: str = "parquet",
    checkpoint: str | None = None,
) -> DataFrame:
    """Take all new files of ``folder`` into the state, so many at once, and return the
    profile of everything taken in so far."""
    rows = (
        spark.readStream.schema(schema).format(source)
        .option("maxFilesPerTrigger", files_per_chunk).load(folder)
    )
    query = (
        rows.writeStream.foreachBatch(lambda batch, number: add_chunk(batch, state, number))
        .option("checkpointLocation", checkpoint or new_path(spark, "profile"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return merged_profile(spark, state)
