"""Data analysis in three tiers, each containing the one before."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.operators import describe, findings, groups, quality, relations
from sondage.plans.shared import Shared

TIERS = ("descriptive", "statistical", "comprehensive")


def insights(df: DataFrame, tier: str = "comprehensive", shared: Shared | None = None) -> DataFrame:
    shared = shared or Shared(df)
    strong = None
    if tier == "comprehensive" and shared.correlations is not None:
        strong = relations.strong_correlations(df, pairs=shared.correlations)
    return findings.insights(shared.shape, len(shared.numeric), len(shared.categorical), strong)


def warnings(df: DataFrame, shared: Shared | None = None) -> DataFrame:
    shared = shared or Shared(df)
    return findings.warnings(shared.missing_total, shared.duplicates, shared.spread)


def recommendations(
    df: DataFrame, tier: str = "comprehensive", shared: Shared | None = None
) -> DataFrame:
    shared = shared or Shared(df)
    shares = None
    if shared.categorical:
        rows = shared.shape.select("n_rows").scalar()
        share = F.try_divide(F.col("unique_values").cast("double"), rows.cast("double"))
        shares = shared.distinct.where(F.col("column_name").isin(shared.categorical))
        shares = shares.withColumn("unique_share", share)
    return findings.recommendations(
        df.sparkSession,
        shared.missing_total if tier == "comprehensive" else None,
        shares,
        shared.skewness if tier != "descriptive" else None,
    )


def analyze(
    df: DataFrame,
    tier: str = "comprehensive",
    columns: Sequence[str] | None = None,
    group_by: str | None = None,
    shared: Shared | None = None,
) -> dict[str, DataFrame]:
    """The tables of one analysis, by name.

    They share one table of counts and one of moments and percentiles, cached until
    ``shared.release()``; to name the tables, quantiles are looked for already.

    An unknown ``group_by`` is ignored, an unknown name in ``columns`` is an error.
    """
    if tier not in TIERS:
        raise ValueError(f"Unknown analysis type: {tier}")
    if shared is None or columns:
        shared = Shared(describe.project(df, columns))
    df = shared.df
    numeric, categorical = shared.numeric, shared.categorical
    tables = {"shape": shared.shape, "column_types": quality.column_types(df, shared.nulls)}
    if numeric:
        tables["numeric_summary"] = describe.numeric_summary(df, stats=shared.stats)
    if categorical:
        tables["categorical_unique"] = shared.distinct.where(
            F.col("column_name").isin(categorical)
        )
        tables["categorical_top"] = describe.categorical_top(df)
    if tier != "descriptive" and numeric:
        tables["statistical_tests"] = shared.tests
    if tier == "comprehensive":
        tables["data_quality"] = quality.report(
            df, shared.missing_total, shared.duplicates, shared.nulls
        )
        if len(numeric) > 1:
            pairs = shared.correlations
            tables["correlation_matrix"] = relations.correlation_matrix(df, pairs=pairs)
            tables["strong_correlations"] = relations.strong_correlations(df, pairs=pairs)
        if group_by in df.columns and numeric:
            tables["group_sizes"] = groups.group_sizes(df, group_by)
            tables["group_count"] = groups.group_count(df, group_by)
            tables["group_stats"] = groups.group_stats(df, group_by)
        if numeric:
            tables["distributions"] = describe.distributions(df, stats=shared.stats)
    tables["insights"] = insights(df, tier, shared)
    tables["warnings"] = warnings(df, shared)
    tables["recommendations"] = recommendations(df, tier, shared)
    return tables


# Which columns of a result table name the item, in order.
ITEM_COLUMNS = ("column_name", "group_value", "column1", "column2", "value", "section", "rule", "subject")


def facts(section: str, table: DataFrame) -> DataFrame:
    """A result table as rows (section, item, key, number, text), one per cell."""
    items = [c for c in ITEM_COLUMNS if c in table.columns and c != "value"]
    # A value that names an item rather than measuring one is text.
    types = dict(table.dtypes)
    if types.get("value") == "string":
        items.append("value")
    item = (
        F.concat_ws(" / ", *[F.col(c).cast("string") for c in items]) if items else F.lit("")
    )

    def cell(name: str) -> Column:
        kind = types[name]
        textual = kind in ("string", "boolean")
        value = F.col(name)
        return F.struct(
            F.lit(name).alias("key"),
            (F.lit(None) if textual or kind.startswith("array") else value)
            .cast("double")
            .alias("number"),
            (
                F.array_join(value, ", ")
                if kind.startswith("array")
                else value.cast("string") if textual else F.lit(None)
            )
            .cast("string")
            .alias("text"),
        )

    cells = F.array(*[cell(c) for c in table.columns if c not in items])
    return table.select(F.lit(section).alias("section"), item.alias("item"), F.inline(cells))


def as_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables of an analysis in one, as rows (section, item, key, number, text)."""
    return reduce(DataFrame.unionByName, [facts(name, t) for name, t in tables.items()])
