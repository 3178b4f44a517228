"""JSON tables: lines, arrays of records, and the column-oriented layout."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions.columns import column
from sondage.sources.delimited import with_inferred_types


def read_json(spark: SparkSession, path: str, layout: str | None = None, **options) -> DataFrame:
    """Read JSON of a given layout, or of the one the files have.

    lines: one object per line, split freely. records: an array of objects per file,
    streamed by one task per file. columns: {"column": {"row": value}} per file.
    """
    layout = layout or guess_layout(spark, path)
    if layout == "lines":
        return spark.read.options(**options).json(path)
    if layout == "records":
        return spark.read.options(**{"multiLine": "true", **options}).json(path)
    if layout == "columns":
        return _column_oriented(spark, path)
    raise ValueError(f"Unknown JSON layout: {layout}")


def guess_layout(spark: SparkSession, path: str) -> str:
    """Lines if every line that is not blank is an object by itself (column-oriented, if
    the only line of each file is one); else the whole files are parsed: arrays hold
    records, objects whose members are all objects are column-oriented. Anything else is
    an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kind = F.when(_is_object(F.col("value")), 0).otherwise(1)
    file = F.col("_metadata.file_path")
    seen = lines.agg(F.max(kind).alias("broken"), F.count("value").alias("n"), F.count_distinct(file).alias("files")).first()
    if seen["n"] == 0:
        return "lines"
    if seen["broken"] == 0 and seen["n"] > seen["files"]:
        return "lines"
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value")).where("value <> ''")
    layout = (
        F.when(F.col("value").startswith("["), "records")
        .when(F.col("value") == "{}", "records")
        .when(_members_are_objects(F.col("value")), "columns")
        .when(_is_object(F.col("value")), "lines")
    )
    layouts = {r[0] for r in whole.select(layout.alias("layout")).distinct().collect()}
    if len(layouts) != 1 or None in layouts:
        raise ValueError(f"The layout of {path} is unclear: name one of lines, records, columns")
    return layouts.pop()


def _is_object(text: Column) -> Column:
    members = F.from_json(text, "map<string, string>")
    return text.rlike(r"^\s*\{") & text.rlike(r"\}\s*$") & members.isNotNull()


def _members_are_objects(text: Column) -> Column:
    """A document of at least one member, each an object of plain values."""
    members = F.map_values(F.from_json(text, "map<string, string>"))
    return (F.size(members) > 0) & F.forall(members, lambda m: m.startswith("{") & m.endswith("}"))


def _column_oriented(spark: SparkSession, path: str) -> DataFrame:
    """Explode to (file, row, column, value), then turn the columns back.

    One such document cannot be split, so a file is parsed by one task; many files are
    parsed side by side, and rows are put together by a shuffle on (file, row).
    """
    documents = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.from_json("value", "map<string, map<string, string>>").alias("columns"),
    )
    found = documents.select(F.map_keys("columns").alias("names")).distinct().collect()
    names = list(dict.fromkeys(name for row in found for name in row["names"]))
    cells = documents.select("file", F.explode("columns").alias("name", "cells")).select(
        "file", "name", F.explode("cells").alias("row", "value")
    )
    pivoted = cells.groupBy("file", "row").pivot("name", names).agg(F.first("value"))
    return with_inferred_types(pivoted.select(*[column(n) for n in names]))
