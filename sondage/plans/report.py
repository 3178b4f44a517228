"""A report: schema, analysis, relationships, charts and raw rows as tables, JSON or text.

Everything in a report is reduced: rows per column, pair, bin or finding. The tables are
computed from column-pruned scans of the source, which is why the input itself is not
cached; a source that is expensive to recompute should be cached or written first.
"""

import time
from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.functions.columns import column, numeric_columns, require
from sondage.operators import charts
from sondage.plans.analysis import analyze, facts
from sondage.plans.relationships import find_relationships
from sondage.plans.schema_discovery import discover_schema
from sondage.plans.shared import Shared
from sondage.sources.files import file_info

RAW_ROWS = 100


def raw_sample(df: DataFrame, order_by: Sequence[str], n: int = RAW_ROWS) -> DataFrame:
    """The first n rows by the given key, as a top-k."""
    require(df, list(order_by))
    return df.orderBy(*[column(c) for c in order_by]).limit(n)


def standard_charts(
    df: DataFrame, correlations: int = 10, distributions: int = 3, boxes: int = 5
) -> dict[str, DataFrame]:
    """Correlations, distributions and boxes of the first so many numeric columns."""
    numeric = numeric_columns(df)
    tables = {}
    if len(numeric) > 1:
        tables["correlation"] = charts.correlation(df, numeric[:correlations])
    if numeric:
        tables["distribution"] = charts.distribution(df, numeric[:distributions])
        tables["box"] = charts.box(df, numeric[:boxes])
    return tables


def report_charts(df: DataFrame) -> DataFrame:
    """The standard charts as rows (section, item, key, number, text)."""
    parts = [facts(name, table) for name, table in standard_charts(df).items()]
    return reduce(DataFrame.unionByName, parts)


def collect_report(
    df: DataFrame,
    report_type: str = "comprehensive",
    include_charts: bool = True,
    raw_order: Sequence[str] | None = None,
    key: Sequence[str] | None = None,
    limit: int | None = None,
    raw_rows: int = RAW_ROWS,
    shared: Shared | None = None,
) -> tuple[dict[str, dict[str, DataFrame]], list[str]]:
    """The report's tables by section and name, and the titles of the sections.

    ``limit`` cuts the relationships listed, ``raw_rows`` the raw sample; totals and
    findings are about everything found. A caller who gives ``shared`` can release what
    is cached when the tables are written.
    """
    shared = shared or Shared(df)
    found = discover_schema(df, key=key, shared=shared)
    sections = {"schema": {k: t for k, t in found._asdict().items() if t is not None}}
    titles = ["Columns"]
    sections["analysis"] = analyze(df, report_type, shared=shared)
    titles.append("Analysis")
    if report_type == "comprehensive":
        related = find_relationships(df, limit=limit, shared=shared)
        sections["relationships"] = {
            "relationships": related.relationships,
            "total": related.total,
            "insights": related.insights,
        }
        titles.append("Relationships")
    if include_charts:
        sections["charts"] = standard_charts(df)
        titles.append("Charts")
    if raw_order:
        sections["raw"] = {"raw_sample": raw_sample(df, raw_order, raw_rows)}
        titles.append("Raw rows")
    return sections, titles


def report_facts(sections: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """The whole report but the raw rows as rows (section, item, key, number, text)."""
    return reduce(
        DataFrame.unionByName,
        [
            facts(f"{section}.{name}", table)
            for section, tables in sections.items()
            if section != "raw"
            for name, table in tables.items()
        ],
    )


def _texts(order: int, table: DataFrame, line, within) -> DataFrame:
    return table.select(F.lit(order).alias("part"), within.alias("within"), line.alias("line"))


def markdown_lines(
    df: DataFrame,
    name: str,
    report_type: str = "comprehensive",
    generated_at: str | None = None,
    shared: Shared | None = None,
) -> DataFrame:
    """The report as text: rows (line_no, line).

    The lines are as many as there are columns and findings, so numbering them in one
    place costs nothing.
    """
    spark = df.sparkSession
    shared = shared or Shared(df)
    found = discover_schema(df, shared=shared)
    analysis = analyze(df, report_type, shared=shared)
    generated_at = generated_at or datetime.now().strftime("%Y-%m-%d %H:%M:%S")

    def fixed(part: int, lines: list[str]) -> DataFrame:
        rows = [(part, f"{i:09d}", line) for i, line in enumerate(lines)]
        return spark.createDataFrame(rows, "part int, within string, line string")

    def pct(c: str):
        return F.concat(F.col(c).cast("string"), F.lit("%"))

    overview = F.array(
        F.concat(F.lit("- Rows: "), F.format_number("total_rows", 0)),
        F.concat(F.lit("- Columns: "), F.col("total_columns").cast("string")),
        F.concat(F.lit("- Quality: "), pct("data_quality_score")),
    )
    positions = F.create_map(
        *[F.lit(x) for i, c in enumerate(df.columns) for x in (c, f"{i:09d}")]
    )
    row = F.concat(
        F.lit("| "),
        F.concat_ws(" | ", "column_name", "data_type", "inferred_type", pct("null_pct"), pct("unique_pct")),
        F.lit(" |"),
    )
    parts = [
        fixed(
            0,
            [
                "# Profile", "", f"Source: {name}  ", f"Made: {generated_at}  ",
                f"Depth: {report_type}", "", "## Size and quality", "",
            ],
        ),
        found.overview.select(F.posexplode(overview).alias("at", "line")).select(
            F.lit(1).alias("part"), F.format_string("%09d", "at").alias("within"), "line"
        ),
        fixed(
            2,
            [
                "", "## Columns", "", "| Column | Stored as | Holds | Missing | Distinct |",
                "| --- | --- | --- | --- | --- |",
            ],
        ),
        _texts(3, found.columns, row, F.element_at(positions, F.col("column_name"))),
    ]
    for order, (table, title) in enumerate(
        [
            ("insights", "## Observations"),
            ("warnings", "## Cautions"),
            ("recommendations", "## Advice"),
        ]
    ):
        messages = analysis[table]
        heading = messages.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
        lines = F.array(F.lit(""), F.lit(title), F.lit(""))
        parts.append(
            heading.select(F.posexplode(lines).alias("at", "line")).select(
                F.lit(4 + 2 * order).alias("part"),
                F.format_string("%09d", "at").alias("within"),
                "line",
            )
        )
        bullet = F.concat(F.lit("- "), F.col("message"))
        within = F.concat_ws(":", "rule", F.element_at(positions, F.col("subject")))
        parts.append(_texts(5 + 2 * order, messages, bullet, within))
    if report_type == "comprehensive":
        related = find_relationships(df, shared=shared).total.withColumnRenamed("total_relationships", "n")
        total = F.format_string("%d found.", F.col("n"))
        lines = F.array(F.lit(""), F.lit("## Relationships"), F.lit(""), total, F.lit(""))
        parts.append(
            related.select(F.posexplode(lines).alias("at", "line")).select(
                F.lit(20).alias("part"), F.format_string("%09d", "at").alias("within"), "line"
            )
        )
    every = reduce(DataFrame.unionByName, parts)
    number = F.row_number().over(W.orderBy("part", "within", "line"))
    return every.select(number.alias("line_no"), "line")


def metadata(
    df: DataFrame, name: str, generated_at: str, report_type: str, titles: list[str], n_charts: int
) -> DataFrame:
    """One row about the report itself."""
    row = (name, generated_at, report_type, titles, n_charts)
    fields = "file string, generated_at string, report_type string, sections array<string>, charts int"
    return df.sparkSession.createDataFrame([row], fields)


class ReportResult(NamedTuple):
    report_path: str
    report_format: str
    file_size_mb: float
    sections_included: list[str]
    charts_count: int
    generation_time_seconds: float


def generate_report(
    df: DataFrame,
    folder: str,
    name: str,
    report_type: str = "comprehensive",
    output_format: str = "json",
    include_charts: bool = True,
    raw_order: Sequence[str] | None = None,
    path: str | None = None,
) -> ReportResult:
    """Write a report and say what it holds: to ``path``, or below ``folder`` under a name
    with the time.

    ``json`` writes the facts as JSON lines (metadata and raw sample beside them),
    ``markdown`` the text lines in order, ``parquet`` the facts as a table.
    """
    if output_format not in ("json", "markdown", "parquet"):
        raise ValueError(f"Unsupported output format: {output_format}")
    started = time.time()
    stamp = datetime.now().strftime("%Y%m%d_%H%M%S")
    path = path or f"{folder.rstrip('/')}/report_{name}_{stamp}.{output_format}"
    shared = Shared(df)
    try:
        if output_format == "markdown":
            sections, titles = {}, ["Columns", "Analysis"]
            if report_type == "comprehensive":
                titles.append("Relationships")
            lines = markdown_lines(df, name, report_type, shared=shared)
            # A report has as many lines as columns and findings: one ordered file.
            lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.text(path)
        else:
            sections, titles = collect_report(df, report_type, include_charts, raw_order, shared=shared)
            about = metadata(df, name, stamp, report_type, titles, len(sections.get("charts", {})))
            about.coalesce(1).write.format(output_format).save(f"{path}/metadata")
            report_facts(sections).write.format(output_format).save(f"{path}/facts")
            if raw_order:
                raw = sections["raw"]["raw_sample"]
                raw.coalesce(1).write.format(output_format).save(f"{path}/raw_sample")
    finally:
        shared.release()
    info = file_info(df.sparkSession, path)
    size = info.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    return ReportResult(
        report_path=path,
        report_format=output_format,
        file_size_mb=round(size / 1048576, 2),
        sections_included=titles,
        charts_count=len(sections.get("charts", {})),
        generation_time_seconds=round(time.time() - started, 2),
    )
