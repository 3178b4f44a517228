"""Sentences given by fixed rules over already reduced statistics.

Every finding is a row (kind, rule, subject, message).
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "kind string, rule string, subject string, message string"


def finding(
    stats: DataFrame, kind: str, rule: str, when: Column, message: Column, subject: Column | None = None
) -> DataFrame:
    return stats.where(when).select(
        F.lit(kind).alias("kind"),
        F.lit(rule).alias("rule"),
        (subject if subject is not None else F.lit(None)).cast("string").alias("subject"),
        message.alias("message"),
    )


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def number(c: Column) -> Column:
    """A number as text, such as 12.5."""
    return c.cast("double").cast("string")


def insights(
    shape: DataFrame, numeric: int, categorical: int, strong: DataFrame | None = None
) -> DataFrame:
    """Size, kinds of columns, and the number of strong correlations if given.

    ``shape`` has a row (n_rows, n_columns); ``strong`` the strongly correlated pairs.
    """
    always = F.lit(True)
    parts = [
        finding(
            shape, "insight", "size", always,
            F.format_string(
                "%s rows in %d columns",
                F.format_number("n_rows", 0), F.col("n_columns"),
            ),
        )
    ]
    for rule, count, use in [
        ("numeric_columns", numeric, "columns hold numbers"),
        ("categorical_columns", categorical, "columns hold categories"),
    ]:
        if count > 0:
            parts.append(finding(shape, "insight", rule, always, F.lit(f"{count} {use}")))
    if strong is not None:
        counted = strong.agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            finding(
                counted, "insight", "strong_correlations", F.col("n") > 0,
                F.format_string(
                    "%d pairs of columns correlate strongly", F.col("n")
                ),
            )
        )
    return together(parts)


def warnings(missing_total: DataFrame, duplicates: DataFrame, spread: DataFrame | None) -> DataFrame:
    """Missing values above 10 %, duplicate rows above 5 %, deviation below 0.01.

    ``spread`` has rows (column_name, std).
    """
    parts = [
        finding(
            missing_total, "warning", "missing_values", F.col("missing_pct") > 10,
            F.concat(
                F.lit("Missing cells: "), number(F.col("missing_pct")), F.lit("%")
            ),
        ),
        finding(
            duplicates, "warning", "duplicates", F.col("duplicate_pct") > 5,
            F.concat(
                F.lit("Repeated rows: "), F.col("duplicate_rows").cast("string"),
                F.lit(" ("), number(F.col("duplicate_pct")), F.lit("%)"),
            ),
        ),
    ]
    if spread is not None:
        parts.append(
            finding(
                spread, "warning", "low_variance", F.col("std") < 0.01,
                F.concat(F.col("column_name"), F.lit(" hardly varies")),
                F.col("column_name"),
            )
        )
    return together(parts)


def recommendations(
    spark,
    missing_total: DataFrame | None = None,
    unique_shares: DataFrame | None = None,
    skewness: DataFrame | None = None,
) -> DataFrame:
    """Missing above 5 %, text columns more than half distinct, |skewness| above 2.

    ``unique_shares`` has rows (column_name, unique_share), ``skewness`` rows
    (column_name, skewness). What is not given is not judged.
    """
    parts = [spark.createDataFrame([], FIELDS)]
    if missing_total is not None:
        parts.append(
            finding(
                missing_total, "recommendation", "missing_values", F.col("missing_pct") > 5,
                F.lit("Fill or drop the missing cells"),
            )
        )
    if unique_shares is not None:
        parts.append(
            finding(
                unique_shares, "recommendation", "high_cardinality", F.col("unique_share") > 0.5,
                F.concat(
                    F.col("column_name"), F.lit(" is mostly unique: encode it before use"),
                ),
                F.col("column_name"),
            )
        )
    if skewness is not None:
        parts.append(
            finding(
                skewness, "recommendation", "skewed", F.abs("skewness") > 2,
                F.concat(
                    F.col("column_name"), F.lit(" is very skewed: a transformation may help"),
                ),
                F.col("column_name"),
            )
        )
    return together(parts)


def schema_recommendations(
    missing_total: DataFrame, duplicates: DataFrame, numeric: int
) -> DataFrame:
    """Missing values above 30 %, duplicates above 5 %, more than ten numeric columns."""
    parts = [
        finding(
            missing_total, "recommendation", "missing_values", F.col("missing_pct") > 30,
            F.concat(
                number(F.col("missing_pct")), F.lit("% of the cells are missing: fill or drop them"),
            ),
        ),
        finding(
            duplicates, "recommendation", "duplicates", F.col("duplicate_pct") > 5,
            F.concat(
                number(F.col("duplicate_pct")), F.lit("% of the rows are repeated: remove the repetitions"),
            ),
        ),
        finding(
            missing_total, "recommendation", "many_numeric_columns", F.lit(numeric > 10),
            F.lit("More than ten numeric columns: select or combine some"),
        ),
    ]
    return together(parts)


def relationship_insights(found: DataFrame) -> DataFrame:
    """What all relationships found say."""
    kind = F.col("relationship_type")
    counts = found.agg(
        F.count(F.lit(1)).alias("every"),
        F.count_if(F.abs("strength") >= 0.8).alias("strong"),
        F.count_if(kind == "categorical_association").alias("categorical"),
        F.count_if(kind == "numeric_categorical").alias("mixed"),
    )
    rules = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("subject"),
                F.when(when, message).alias("message"),
            )
            for rule, when, message in [
                ("none", F.col("every") == 0,
                 F.lit("No relationship passed the thresholds")),
                ("strong", F.col("strong") > 0,
                 F.format_string(
                     "%d strong relationships: columns may be redundant", F.col("strong"))),
                ("categorical", F.col("categorical") > 0,
                 F.format_string(
                     "%d associations between categories", F.col("categorical"))),
                ("mixed", F.col("mixed") > 0,
                 F.format_string(
                     "%d pairs in which a number differs by category", F.col("mixed"))),
            ]
        ]
    )
    return (
        counts.select(F.lit("insight").alias("kind"), F.inline(rules))
        .where(F.col("message").isNotNull())
    )
