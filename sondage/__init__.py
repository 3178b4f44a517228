"""sondage: profile any table Spark can read. DataFrames in, small tidy DataFrames out."""

from sondage.operators.charts import chart_data
from sondage.plans.analysis import analyze
from sondage.plans.relationships import find_relationships
from sondage.plans.report import generate_report
from sondage.plans.schema_discovery import discover_schema
from sondage.sources.files import load, save

__all__ = [
    "analyze",
    "chart_data",
    "discover_schema",
    "find_relationships",
    "generate_report",
    "load",
    "save",
]
