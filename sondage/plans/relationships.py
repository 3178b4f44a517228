"""Relationship discovery: the strongest relations, the correlation matrix, insights."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.operators import findings, relations
from sondage.plans.shared import Shared


class RelationshipResult(NamedTuple):
    relationships: DataFrame
    correlation_matrix: DataFrame | None
    insights: DataFrame
    total: DataFrame


def find_relationships(
    df: DataFrame,
    threshold: float | None = None,
    limit: int | None = 50,
    shared: Shared | None = None,
) -> RelationshipResult:
    """``limit`` cuts the relationships listed; insights and total are about all.

    The relationships, one row per column pair at most, are cached: they are read again
    for insights and total. ``shared.release()`` lets go of them.
    """
    shared = shared or Shared(df)
    pairs = shared.correlations
    found = shared.kept(relations.all_relationships(df, threshold, pairs))
    return RelationshipResult(
        relationships=relations.strongest(found, limit),
        correlation_matrix=(
            relations.correlation_matrix(df, pairs=pairs) if pairs is not None else None
        ),
        insights=findings.relationship_insights(found),
        total=found.agg(F.count(F.lit(1)).alias("total_relationships")),
    )
