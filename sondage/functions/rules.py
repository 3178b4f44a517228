"""Labels and scores given by fixed thresholds, as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of |r| for each label, strongest first.
CORRELATION_BANDS = [(0.9, "very_strong"), (0.7, "strong"), (0.5, "moderate")]


def correlation_label(r: Column) -> Column:
    """positive_/negative_ followed by the strength of |r|; r = 0 counts as negative."""
    size = F.abs(r)
    strength = F.lit("weak")
    for bound, name in reversed(CORRELATION_BANDS):
        strength = F.when(size >= bound, name).otherwise(strength)
    return F.concat(F.when(r > 0, "positive_").otherwise("negative_"), strength)


def semantic_type(
    kind: Column, is_integer: Column, unique: Column, rows: Column, present: Column,
    at_share: Column, http_share: Column,
) -> Column:
    """What a column seems to hold, from its role and counts. The order matters."""
    unique_share = F.try_divide(unique.cast("double"), rows.cast("double"))
    text = (
        F.when(present == 0, "text")
        .when(unique_share < 0.05, "categorical")
        .when(at_share > 0.8, "email")
        .when(http_share > 0.8, "url")
        .otherwise("text")
    )
    return (
        F.when((kind == "numeric") & is_integer & (unique_share > 0.95), "identifier")
        .when((kind == "numeric") & is_integer, "integer")
        .when(kind == "numeric", "numeric")
        .when(kind == "datetime", "datetime")
        .when(kind == "boolean", "boolean")
        .when(kind == "categorical", text)
        .otherwise("unknown")
    )


def quality_score(missing_pct: Column, duplicate_pct: Column) -> Column:
    """100, less the missing % (at most 30) and half the duplicate % (at most 20).

    NULL for an empty table, which has no percentages.
    """
    penalty = F.least(missing_pct, F.lit(30.0)) + F.least(duplicate_pct * 0.5, F.lit(20.0))
    score = F.round(F.greatest(F.lit(100.0) - penalty, F.lit(0.0)), 2)
    return F.when(missing_pct.isNotNull() & duplicate_pct.isNotNull(), score)


def quality_band(score: Column) -> Column:
    return (
        F.when(score >= 90, "good").when(score >= 70, "fair").when(score < 70, "poor")
    )
