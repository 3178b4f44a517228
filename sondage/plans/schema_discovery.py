"""Schema discovery: what a table holds, how good it is, what to do about it."""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.operators import findings, quality, schema
from sondage.plans.shared import Shared


class SchemaResult(NamedTuple):
    """``overview`` has one row, the others one row per column or finding."""

    overview: DataFrame
    columns: DataFrame
    numeric_constraints: DataFrame | None
    text_constraints: DataFrame | None
    samples: DataFrame
    recommendations: DataFrame


def discover_schema(
    df: DataFrame,
    sample_size: int | None = None,
    key: Sequence[str] | None = None,
    shared: Shared | None = None,
) -> SchemaResult:
    """Column types, counts, constraints and samples, the quality score, recommendations.

    With ``sample_size`` everything is about that many rows drawn at random; ``key``
    names the columns that identify a row, for a repeatable draw.
    """
    if shared is None or sample_size:
        shared = Shared(schema.sample_rows(df, sample_size, key))
    df = shared.df
    score = quality.score(df, shared.missing_total, shared.duplicates)
    return SchemaResult(
        overview=score.select(
            shared.shape.select("n_rows").scalar().alias("total_rows"),
            F.lit(len(df.columns)).alias("total_columns"),
            F.col("score").alias("data_quality_score"),
            "band",
        ),
        columns=schema.schema_columns(shared.profile),
        numeric_constraints=schema.numeric_constraints(df, shared.stats) if shared.numeric else None,
        text_constraints=schema.text_constraints(df) if shared.categorical else None,
        samples=schema.sample_values(df, key),
        recommendations=findings.schema_recommendations(
            shared.missing_total, shared.duplicates, len(shared.numeric)
        ),
    )
