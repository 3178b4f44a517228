"""Reduced tables that several parts of an analysis or report need."""

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.functions.columns import categorical_columns, numeric_columns
from sondage.operators import describe, frequencies, quality, relations, schema


class Shared:
    """Each table is planned once and cached when first computed.

    They hold one row, or one row per column or column pair, whatever the size of the
    input; the input itself is never cached.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self._kept: list[DataFrame] = []
        self.numeric = numeric_columns(df)
        self.categorical = categorical_columns(df)

    def kept(self, table: DataFrame) -> DataFrame:
        self._kept.append(table.cache())
        return table

    def release(self) -> None:
        """Lets go of the cached tables; what was derived from them computes them again."""
        while self._kept:
            self._kept.pop().unpersist()

    @cached_property
    def nulls(self) -> DataFrame:
        return self.kept(quality.null_counts(self.df))

    @cached_property
    def moments(self) -> DataFrame | None:
        return self.kept(describe.whole_moments(self.df)) if self.numeric else None

    @cached_property
    def stats(self) -> DataFrame | None:
        """Percentiles as well, which take more passes: for what shows them only."""
        if not self.numeric:
            return None
        return self.kept(describe.whole_stats(self.df, moments=self.moments))

    @cached_property
    def shape(self) -> DataFrame:
        rows = self.nulls.agg(F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_rows"))
        return rows.withColumn("n_columns", F.lit(len(self.df.columns)))

    @cached_property
    def missing_total(self) -> DataFrame:
        return quality.missing_total(self.df, self.nulls)

    @cached_property
    def duplicates(self) -> DataFrame:
        return self.kept(quality.duplicates(self.df))

    @cached_property
    def distinct(self) -> DataFrame:
        return self.kept(frequencies.distinct_counts(self.df))

    @cached_property
    def profile(self) -> DataFrame:
        return self.kept(schema.column_profile(self.df, self.distinct))

    @cached_property
    def spread(self) -> DataFrame | None:
        return self.moments.select("column_name", "std") if self.numeric else None

    @cached_property
    def tests(self) -> DataFrame | None:
        return describe.statistical_tests(self.df, stats=self.stats) if self.numeric else None

    @cached_property
    def skewness(self) -> DataFrame | None:
        return describe.moments(self.df, stats=self.moments) if self.numeric else None

    @cached_property
    def correlations(self) -> DataFrame | None:
        return self.kept(relations.pair_correlations(self.df)) if len(self.numeric) > 1 else None
