"""One query per operator, over whole tables: name -> (spark, folder) -> DataFrame."""

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions.columns import positive_zero, rounded
from sondage.operators import (
    charts,
    describe,
    groups,
    quality,
    relations,
    schema,
)
from sondage.operators.frequencies import distinct_counts
from sondage.plans import analysis, report
from sondage.plans.analysis import as_facts
from sondage.plans.relationships import find_relationships
from sondage.plans.schema_discovery import discover_schema
from sondage.session import new_path
from sondage.sources import delimited, files, sql
from sondage.streaming.chunks import read_csv_in_chunks
from sondage.streaming.profile import profile_in_chunks

DOCUMENTS_DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CUSTOMER_DDL = (
    "c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal double, c_mktsegment string"
)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tables(spark: SparkSession, folder: str, names: list[str], operator) -> DataFrame:
    """One operator over several tables, results put together."""
    return reduce(DataFrame.unionByName, [operator(table(spark, folder, n)) for n in names])


def file_count(df: DataFrame, least: int) -> int:
    """As many files as the scan has tasks, so that no file grows with the table."""
    return max(least, df.rdd.getNumPartitions())


def with_text_digest(documents: DataFrame) -> DataFrame:
    """All columns, the text as its digest."""
    return documents.select(*[c for c in documents.columns if c != "text"], F.md5("text").alias("text_md5"))


def to_digits(df: DataFrame, digits: int = 4) -> DataFrame:
    """Double columns rounded for comparison."""
    return df.select(
        *[
            positive_zero(F.round(c, digits)).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def events_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """events, some props and small values missing, the latter as NaN."""
    events = table(spark, folder, "events")
    return events.withColumns(
        {
            "props": F.expr("""nullif(props, '{"k": 0}')"""),
            "value": F.expr("CASE WHEN value < 25 THEN double('NaN') ELSE value END"),
        }
    )


def lineitem_net(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with a column derived from two others, for a strong correlation."""
    return table(spark, folder, "lineitem").withColumn(
        "net", F.col("l_extendedprice") * (1 - F.col("l_discount"))
    )


def lineitem_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Category columns of lineitem, one of them made of two values and related."""
    big = F.when(F.col("l_quantity") + F.when(F.col("l_linestatus") == "O", 20).otherwise(0) > 35,
                 "big").otherwise("small")
    return table(spark, folder, "lineitem").select(
        "l_returnflag", "l_linestatus", big.alias("size_flag"), "l_quantity", "l_extendedprice"
    )


# --- descriptive ------------------------------------------------------------------


@query
def desc_numeric(spark, folder):
    return to_digits(describe.numeric_summary(table(spark, folder, "lineitem")))


@query
def desc_shape(spark, folder):
    return describe.shape(table(spark, folder, "orders"))


@query
def desc_categorical_unique(spark, folder):
    return tables(
        spark, folder, ["orders", "part", "documents"],
        lambda df: describe.categorical_unique(df),
    )


@query
def desc_top_values(spark, folder):
    return tables(
        spark, folder, ["part", "orders", "events", "documents"], lambda df: describe.categorical_top(df)
    )


@query
def proj_columns(spark, folder):
    return describe.project(
        table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber", "l_tax"]
    )


@query
def stat_moments(spark, folder):
    return tables(spark, folder, ["events", "lineitem", "part"], lambda df: describe.moments(df))


@query
def stat_normality(spark, folder):
    # Large K squared values are compared to fewer digits; p keeps its six.
    found = tables(spark, folder, ["events", "lineitem", "part"], lambda df: describe.normality(df))
    return found.withColumn("k2", F.round("k2", 2))


@query
def stat_normality_groups(spark, folder):
    """Means of many small groups are nearly normal, which gives p-values in between."""
    means = (
        table(spark, folder, "lineitem").groupBy("l_suppkey")
        .agg(F.avg("l_quantity").alias("mean_quantity"), F.avg("l_tax").alias("mean_tax"))
    )
    return describe.normality(means, ["mean_quantity", "mean_tax"])


@query
def stat_range(spark, folder):
    return to_digits(
        tables(spark, folder, ["events", "lineitem", "part"], lambda df: describe.value_range(df))
    )


@query
def stat_percentiles(spark, folder):
    return to_digits(
        tables(spark, folder, ["events", "lineitem", "part"], lambda df: describe.percentiles(df))
    )


@query
def stat_tests(spark, folder):
    return to_digits(
        tables(spark, folder, ["orders", "part"], lambda df: describe.statistical_tests(df)), 4
    )


@query
def dist_summary(spark, folder):
    return tables(
        spark, folder, ["events", "lineitem", "part"], lambda df: describe.distributions(df)
    )


@query
def dist_large_ints(spark, folder):
    """Integers that doubles cannot tell apart keep their own mode."""
    keys = table(spark, folder, "orders").selectExpr(
        "CASE WHEN o_orderkey % 7 < 2 THEN 9007199254740993 WHEN o_orderkey % 7 < 4 "
        "THEN 9007199254740992 ELSE 5 END AS k"
    )
    return describe.distributions(keys).select("column_name", "mode")


# --- groups ------------------------------------------------------------------------


@query
def group_count(spark, folder):
    return groups.group_count(table(spark, folder, "orders"), "o_custkey")


@query
def group_sizes(spark, folder):
    return groups.group_sizes(table(spark, folder, "lineitem"), "l_returnflag")


@query
def group_stats(spark, folder):
    return groups.group_stats(table(spark, folder, "lineitem"), "l_returnflag")


@query
def group_stats_numeric_key(spark, folder):
    return groups.group_stats(
        table(spark, folder, "lineitem"), "l_suppkey", ["l_suppkey", "l_quantity", "l_tax"]
    )


# --- quality -----------------------------------------------------------------------


@query
def quality_missing(spark, folder):
    return quality.missing(events_with_gaps(spark, folder))


@query
def quality_missing_total(spark, folder):
    return quality.missing_total(events_with_gaps(spark, folder))


@query
def quality_duplicates(spark, folder):
    return quality.duplicates(table(spark, folder, "lineitem"))


@query
def quality_duplicates_subset(spark, folder):
    return quality.duplicates(table(spark, folder, "documents"), ["text"])


@query
def quality_type_roles(spark, folder):
    return quality.column_types(table(spark, folder, "orders"))


@query
def quality_data_bytes(spark, folder):
    return quality.data_bytes(table(spark, folder, "documents"))


@query
def quality_report(spark, folder):
    return quality.report(events_with_gaps(spark, folder))


@query
def quality_score(spark, folder):
    return quality.score(events_with_gaps(spark, folder))


@query
def outliers_iqr(spark, folder):
    return to_digits(
        quality.outliers(table(spark, folder, "events"), ["value", "user_id"]).unionByName(
            quality.outliers(table(spark, folder, "documents"), ["n_chars"])
        )
    )


@query
def outliers_zscore(spark, folder):
    return quality.outliers(
        table(spark, folder, "events"), ["value", "user_id"], "zscore"
    ).unionByName(quality.outliers(table(spark, folder, "documents"), ["n_chars"], "zscore"))


@query
def outlier_values(spark, folder):
    return quality.outlier_values(table(spark, folder, "events"), "value")


# --- relations ---------------------------------------------------------------------


@query
def corr_matrix(spark, folder):
    return relations.correlation_matrix(lineitem_net(spark, folder))


@query
def corr_strong(spark, folder):
    return relations.strong_correlations(lineitem_net(spark, folder))


@query
def corr_with_gaps(spark, folder):
    """Pairwise-complete rows: the columns miss values in different rows."""
    gaps = table(spark, folder, "lineitem").select(
        F.expr("nullif(l_discount, 0.0D)").alias("discount"),
        F.expr("CASE WHEN l_tax < 0.02D THEN double('NaN') ELSE l_tax END").alias("tax"),
        "l_quantity",
        "l_extendedprice",
    )
    return relations.correlations(gaps).select(
        "column1", "column2", rounded(F.col("r"), 4).alias("correlation"), "n"
    )


def _numeric_found(df: DataFrame, threshold: float) -> DataFrame:
    return relations.numeric_relations(df, threshold).select(
        "column1", "column2", "relationship_type",
        rounded(F.col("r"), 4).alias("strength"), "n",
        rounded(F.col("p"), 6).alias("p_value"),
        F.when(F.col("p") < 0.05, "significant").otherwise("not significant").alias("significance"),
    )


@query
def rel_numeric(spark, folder):
    return _numeric_found(lineitem_net(spark, folder), 0.7).drop("p_value", "significance")


@query
def rel_numeric_p(spark, folder):
    """A threshold of 0 keeps every pair, so that p-values of all sizes occur."""
    return _numeric_found(table(spark, folder, "part"), 0.0)


@query
def crosstab_long(spark, folder):
    return relations.contingency(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority")


def _associated(df: DataFrame) -> DataFrame:
    return relations.associations(df).select(
        "column1", "column2",
        rounded(F.col("chi_square"), 4).alias("chi_square"),
        "dof",
        rounded(F.col("cramers_v"), 4).alias("cramers_v"),
        relations.chi_square_p(F.col("chi_square"), F.col("dof").cast("double")).alias("p"),
    )


@query
def rel_chi2(spark, folder):
    return tables(spark, folder, ["part", "documents"], _associated).drop("p").unionByName(
        _associated(lineitem_flags(spark, folder)).drop("p")
    )


@query
def rel_chi2_p(spark, folder):
    return (
        tables(spark, folder, ["orders", "part"], _associated)
        .unionByName(_associated(lineitem_flags(spark, folder)))
        .select("column1", "column2", "dof", rounded(F.col("p"), 6).alias("p_value"))
    )


def _varied(df: DataFrame) -> DataFrame:
    f, k, n = F.col("f_statistic"), F.col("k"), F.col("n")
    return relations.variance_by_category(df).select(
        "column1", "column2",
        rounded(f, 4).alias("f_statistic"),
        rounded(F.col("eta_squared"), 4).alias("eta_squared"),
        "k", "n",
        relations.anova_p(f, k.cast("double"), n.cast("double")).alias("p"),
    )


@query
def rel_anova(spark, folder):
    return tables(spark, folder, ["conversations", "orders"], _varied).drop("p").unionByName(
        _varied(lineitem_flags(spark, folder)).drop("p")
    )


@query
def rel_anova_p(spark, folder):
    found = tables(spark, folder, ["orders", "part", "customer"], _varied)
    return found.select("column1", "column2", rounded(F.col("p"), 6).alias("p_value"))


@query
def rel_anova_gaps(spark, folder):
    """Rows without a category count for the total variance only."""
    gaps = table(spark, folder, "conversations").select(
        F.expr("nullif(role, 'system')").alias("role"), "turn", "conv_id"
    )
    return _varied(gaps).drop("p")


@query
def rel_all(spark, folder):
    return relations.relationships(table(spark, folder, "documents"), limit=None).select(
        "column1", "column2", "relationship_type", "strength", "description",
        "p_value", "significance",
    )


@query
def rel_all_lineitem(spark, folder):
    flagged = lineitem_flags(spark, folder).withColumn(
        "net", F.col("l_extendedprice") * 0.9
    )
    return relations.relationships(flagged, limit=None).select(
        "column1", "column2", "relationship_type", "strength", "description",
        "correlation", "cramers_v", "degrees_of_freedom", "eta_squared", "p_value", "significance",
    )


@query
def rel_topk(spark, folder):
    return relations.relationships(lineitem_flags(spark, folder), threshold=0.0, limit=3).select(
        "column1", "column2", "relationship_type", "strength"
    )


@query
def rel_insights(spark, folder):
    return find_relationships(table(spark, folder, "documents")).insights


@query
def rel_insights_none(spark, folder):
    return find_relationships(
        table(spark, folder, "events").select("event_type", "value"), limit=50
    ).insights


@query
def rel_total_uncut(spark, folder):
    """More relationships than are listed: the total counts all."""
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_returnflag", *[f"l_quantity * {i + 1} AS q{i}" for i in range(12)]
    )
    return find_relationships(lines, limit=10).total


# --- schema ------------------------------------------------------------------------


@query
def schema_columns(spark, folder):
    return tables(
        spark, folder, ["customer", "pages", "orders"],
        lambda df: schema.schema_columns(schema.column_profile(df)),
    )


@query
def schema_columns_gaps(spark, folder):
    gaps = events_with_gaps(spark, folder).drop("ts")
    return schema.schema_columns(schema.column_profile(gaps))


@query
def schema_semantic_type(spark, folder):
    """With a column of mail addresses and a boolean made from the tables."""
    people = table(spark, folder, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment",
        F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit("@example.com")).alias("mail"),
        (F.col("c_acctbal") < 0).alias("in_debt"),
        F.expr("nullif(c_name, c_name)").alias("nothing"),
    )
    return schema.semantic_types(people).unionByName(
        tables(spark, folder, ["pages", "orders"], schema.semantic_types)
    )


@query
def schema_constraints_num(spark, folder):
    return to_digits(
        tables(spark, folder, ["customer", "orders", "part"], schema.numeric_constraints)
    )


@query
def schema_constraints_str(spark, folder):
    return to_digits(
        tables(spark, folder, ["customer", "orders", "pages", "documents"], schema.text_constraints)
    )


@query
def schema_sample_values(spark, folder):
    found = schema.sample_values(
        table(spark, folder, "customer").drop("c_acctbal"), ["c_custkey"]
    )
    return found.select("column_name", F.array_join("sample_values", "|").alias("sample_values"))


@query
def schema_sample_values_any(spark, folder):
    """Without a key the draw is over a hash of the whole row."""
    found = schema.sample_values(table(spark, folder, "pages"))
    return found.select("column_name", F.array_join("sample_values", "|").alias("sample_values"))


@query
def sample_rows(spark, folder):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return schema.sample_rows(table(spark, folder, "lineitem"), 500, key)


@query
def sample_rows_many(spark, folder):
    """More rows than one task would rank."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return schema.sample_rows(table(spark, folder, "lineitem"), 20_000, key)


@query
def schema_of_sample(spark, folder):
    """All figures are those of the sampled rows."""
    return discover_schema(table(spark, folder, "customer"), 300, ["c_custkey"]).columns


@query
def schema_overview(spark, folder):
    return discover_schema(events_with_gaps(spark, folder)).overview


@query
def schema_recommendations(spark, folder):
    gaps = events_with_gaps(spark, folder).select(
        "event_type", F.expr("CASE WHEN value > 40 THEN NULL ELSE value END").alias("value")
    )
    wide = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", *[f"l_quantity + {i} AS q{i}" for i in range(10)]
    )
    return discover_schema(gaps).recommendations.unionByName(discover_schema(wide).recommendations)


# --- findings ----------------------------------------------------------------------


@query
def insights(spark, folder):
    return analysis.insights(lineitem_net(spark, folder)).unionByName(
        analysis.insights(table(spark, folder, "documents"))
    )


@query
def warnings(spark, folder):
    flat = table(spark, folder, "lineitem").selectExpr("l_tax / 100 AS tiny", "l_returnflag")
    return tables(spark, folder, ["documents"], analysis.warnings).unionByName(
        analysis.warnings(events_with_gaps(spark, folder).select("event_type", "value"))
    ).unionByName(analysis.warnings(flat))


@query
def recommendations(spark, folder):
    return tables(spark, folder, ["documents", "pages"], analysis.recommendations).unionByName(
        analysis.recommendations(events_with_gaps(spark, folder))
    )


# --- charts ------------------------------------------------------------------------


@query
def chart_histogram(spark, folder):
    return to_digits(charts.chart_data(table(spark, folder, "lineitem"), "histogram"))


@query
def chart_scatter(spark, folder):
    return charts.chart_data(
        table(spark, folder, "lineitem"), "scatter", ["l_quantity", "l_extendedprice"]
    )


@query
def chart_line(spark, folder):
    return charts.chart_data(
        table(spark, folder, "events"), "line", ["value", "user_id"], order_by="event_id"
    )


@query
def chart_bar(spark, folder):
    return to_digits(charts.chart_data(table(spark, folder, "part"), "bar"))


@query
def chart_box(spark, folder):
    return to_digits(
        charts.chart_data(table(spark, folder, "lineitem"), "box").unionByName(
            charts.chart_data(table(spark, folder, "events"), "box", ["value"])
        )
    )


@query
def chart_heatmap(spark, folder):
    return charts.chart_data(table(spark, folder, "part"), "heatmap")


@query
def chart_heatmap_raw(spark, folder):
    """The values themselves: here the means per line number."""
    means = table(spark, folder, "lineitem").groupBy("l_linenumber").agg(
        F.round(F.avg("l_quantity"), 6).alias("quantity"), F.count(F.lit(1)).alias("lines")
    )
    return to_digits(
        charts.chart_data(
            means, "heatmap", ["quantity", "lines"], order_by="l_linenumber", values="raw"
        )
    )


@query
def chart_correlation(spark, folder):
    return charts.chart_data(lineitem_net(spark, folder), "correlation")


@query
def chart_distribution(spark, folder):
    return to_digits(
        charts.chart_data(table(spark, folder, "lineitem"), "distribution", ["l_quantity", "l_extendedprice"])
        .unionByName(charts.chart_data(table(spark, folder, "events"), "distribution", ["value"]))
    )


@query
def chart_kde(spark, folder):
    found = charts.density(table(spark, folder, "events"), ["value", "user_id"])
    return to_digits(found, 8)


@query
def chart_kde_exact(spark, folder):
    found = charts.density(
        table(spark, folder, "lineitem"), ["l_quantity", "l_discount"], exact=True
    )
    return to_digits(found, 6)


@query
def chart_pairplot(spark, folder):
    return charts.chart_data(table(spark, folder, "part"), "pairplot")


# --- composite operations ------------------------------------------------------------


@query
def analyze_descriptive(spark, folder):
    return to_digits(as_facts(analysis.analyze(table(spark, folder, "part"), "descriptive")))


@query
def analyze_statistical(spark, folder):
    return to_digits(as_facts(analysis.analyze(table(spark, folder, "part"), "statistical")))


@query
def analyze_comprehensive(spark, folder):
    found = analysis.analyze(table(spark, folder, "orders"), group_by="o_orderstatus")
    return to_digits(as_facts(found))


@query
def report_sections(spark, folder):
    sections, _ = report.collect_report(table(spark, folder, "orders"), key=["o_orderkey"])
    return to_digits(report.report_facts(sections))


@query
def report_charts(spark, folder):
    return to_digits(report.report_charts(table(spark, folder, "orders")))


@query
def report_raw_sample(spark, folder):
    return report.raw_sample(
        table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber", "l_extendedprice"]
    )


@query
def report_json_roundtrip(spark, folder):
    path = new_path(spark, "report")
    found = describe.numeric_summary(table(spark, folder, "orders"))
    files.save_result(to_digits(found), path)
    return files.load_result(spark, path, found.schema)


@query
def report_markdown_lines(spark, folder):
    return report.markdown_lines(
        table(spark, folder, "orders"), "orders.parquet", generated_at="2024-01-01 00:00:00"
    )


# --- sources and sinks ----------------------------------------------------------------


@query
def src_load_auto(spark, folder):
    return files.load(spark, f"{folder}/lineitem.parquet")


@query
def src_csv_roundtrip(spark, folder):
    path = new_path(spark, "customer") + ".csv"
    files.save(table(spark, folder, "customer"), path)
    return files.load(spark, path)


@query
def src_csv_text(spark, folder):
    """Text with quotes, delimiters and line breaks survives the way there and back."""
    path = new_path(spark, "documents") + ".csv"
    files.save(table(spark, folder, "documents"), path)
    back = files.load(spark, path, schema=DOCUMENTS_DDL, multi_line=True)
    return with_text_digest(back)


@query
def src_csv_delim(spark, folder):
    parts = []
    for delimiter in delimited.DELIMITERS:
        path = new_path(spark, "customer") + ".txt"
        delimited.write_csv(table(spark, folder, "customer"), path, delimiter=delimiter)
        guessed = delimited.infer_delimiter(spark, path)
        back = delimited.read_csv(spark, path, delimiter=guessed)
        parts.append(
            back.agg(
                F.count(F.lit(1)).alias("n_rows"),
                F.countDistinct("c_name").alias("names"),
                F.round(F.sum("c_acctbal"), 2).alias("balance"),
            ).select(F.lit(delimiter).alias("written"), F.lit(guessed).alias("guessed"), "*")
        )
    return reduce(DataFrame.unionByName, parts)


@query
def src_csv_na_tokens(spark, folder):
    path = new_path(spark, "customer") + ".csv"
    customer = table(spark, folder, "customer")
    delimited.write_csv(
        customer.select(
            F.expr("CASE WHEN c_custkey % 7 = 0 THEN 'NA' ELSE cast(c_custkey AS string) END").alias("c_custkey"),
            F.expr("CASE WHEN c_acctbal < 0 THEN 'null' ELSE cast(c_acctbal AS string) END").alias("c_acctbal"),
            F.expr("CASE WHEN c_mktsegment = 'BUILDING' THEN 'N/A' ELSE c_mktsegment END").alias("c_mktsegment"),
            "c_name",
        ),
        path,
    )
    return delimited.read_csv(spark, path)


@query
def src_csv_chunks(spark, folder):
    source, target = new_path(spark, "customer") + ".csv", new_path(spark, "customer")
    delimited.write_csv(table(spark, folder, "customer").repartition(6, "c_custkey"), source)
    return read_csv_in_chunks(spark, source, CUSTOMER_DDL, target, files_per_chunk=2)


@query
def profile_of_chunks(spark, folder):
    """Moments merged from the states of a stream's chunks, and whether the estimates of
    distinct values are within 4 % of the true counts."""
    lineitem = table(spark, folder, "lineitem")
    source, state = new_path(spark, "lineitem"), new_path(spark, "profile")
    n = file_count(lineitem, 6)
    lineitem.repartition(n, "l_orderkey").write.parquet(source)
    merged = profile_in_chunks(spark, source, lineitem.schema, state, files_per_chunk=math.ceil(n / 3))
    close = F.abs(F.col("approx_distinct") - F.col("unique_values")) <= 0.04 * F.col("unique_values")
    found = merged.join(distinct_counts(lineitem), "column_name").select(
        "column_name", "n_rows", "n_missing", "n", "mean", "std", "min", "max", "skewness", "kurtosis",
        "unique_values", close.alias("estimate_close"),
    )
    return to_digits(found)


@query
def src_multi_file_union(spark, folder):
    paths = []
    customer = table(spark, folder, "customer")
    for remainder in range(3):
        path = new_path(spark, "customer") + ".csv"
        delimited.write_csv(customer.where(F.col("c_nationkey") % 3 == remainder), path)
        paths.append(path)
    return delimited.read_csv(spark, paths)


@query
def src_json_roundtrip(spark, folder):
    path = new_path(spark, "customer") + ".json"
    files.save(table(spark, folder, "customer"), path)
    return files.load(spark, path)


@query
def src_arrow_ipc(spark, folder):
    path = new_path(spark, "orders") + ".feather"
    files.save(table(spark, folder, "orders"), path)
    return files.load(spark, path)


@query
def src_csv_wide_ids(spark, folder):
    """Integers of 19 digits stay bigint; wider ones become decimals, never doubles."""
    path = new_path(spark, "ids") + ".csv"
    ids = table(spark, folder, "orders").selectExpr(
        "o_orderkey + 1234567890123456789 AS id",
        "CAST(o_orderkey AS DECIMAL(38,0)) * 10000000000000000000BD + 7 AS wide",
    )
    files.save(ids, path)
    return files.load(spark, path).select("id", F.col("wide").cast("string"))


@query
def src_csv_spaces(spark, folder):
    path = new_path(spark, "spaces") + ".csv"
    padded = table(spark, folder, "customer").selectExpr(
        "c_custkey", "concat('  ', c_name, ' ') AS padded", "' NA ' AS mark"
    )
    files.save(padded, path)
    return files.load(spark, path)


@query
def src_csv_line_breaks(spark, folder):
    """Quoted line breaks are found by a plain load, and their files are read in splits."""
    path = new_path(spark, "breaks") + ".csv"
    files.save(table(spark, folder, "documents"), path)
    return with_text_digest(files.load(spark, path))


@query
def src_csv_chunks_text(spark, folder):
    """Chunks hold quoted line breaks as a plain read does."""
    source, target = new_path(spark, "documents") + ".csv", new_path(spark, "documents")
    documents = table(spark, folder, "documents")
    n = file_count(documents, 4)
    files.save(documents.repartition(n, "doc_id"), source)
    found = read_csv_in_chunks(spark, source, DOCUMENTS_DDL, target, files_per_chunk=math.ceil(n / 2))
    return with_text_digest(found)


@query
def src_csv_schema_order(spark, folder):
    """A schema names columns; their order in the file is another one."""
    path = new_path(spark, "orders") + ".csv"
    orders = table(spark, folder, "orders")
    files.save(orders.select(*reversed(orders.columns)), path)
    wanted = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return files.load(spark, path, schema=wanted)


@query
def src_csv_stray_quote(spark, folder):
    """Quotes in the middle of values are text: sizes in inches, written without quoting,
    beside another file with quoted line breaks."""
    path = new_path(spark, "sizes") + ".csv"
    sizes = table(spark, folder, "part").selectExpr("p_partkey AS key", """concat(p_size, '" ', p_brand) AS label""")
    lines = sizes.select(F.concat_ws(",", "key", "label").alias("value"))
    header = spark.range(1).select(F.lit("key,label").alias("value"))
    header.unionByName(lines).coalesce(1).write.text(f"{path}/inches")
    quoted = table(spark, folder, "documents").selectExpr("-1 - doc_id AS key", "md5(text) || chr(10) || lang AS label")
    files.save(quoted, f"{path}/quoted", "csv")
    return delimited.read_csv(spark, [f"{path}/inches", f"{path}/quoted"])


# A document cannot be split, so the rows of one are limited, not their number.
ROWS_PER_DOCUMENT = 100_000


def _json_documents(spark, rows, name, content):
    """The rows of a frame as JSON documents in one folder, each in a file of its own;
    ``content`` is the aggregate that a document holds."""
    path = new_path(spark, name) + ".json"
    n = max(1, math.ceil(rows.count() / ROWS_PER_DOCUMENT))
    # By a hash of the key, which the first column is.
    document = F.pmod(F.xxhash64(rows.columns[0]), F.lit(n)).alias("document")
    made = rows.withColumn("document", document).repartition(n, "document").groupBy("document").agg(content.alias("all"))
    made = made.select("document", F.to_json("all", {"pretty": "true"}).alias("value"))
    made.write.partitionBy("document").text(path)
    return path


@query
def src_json_records(spark, folder):
    """Indented arrays of objects, one to a file."""
    customer = table(spark, folder, "customer")
    records = F.collect_list(F.struct(*customer.columns))
    loaded = files.load(spark, _json_documents(spark, customer, "records", records))
    return loaded.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query
def src_json_columns(spark, folder):
    """Indented documents of columns with row labels that are no numbers, one to a file."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    label = F.concat(F.lit("r"), "c_custkey")
    columns = F.struct(*[
        F.map_from_entries(F.collect_list(F.struct(label, F.col(c)))).alias(c) for c in customer.columns
    ])
    loaded = files.load(spark, _json_documents(spark, customer, "columns", columns))
    return loaded.select("c_custkey", "c_name", "c_acctbal")


@query
def src_arrow_empty(spark, folder):
    path = new_path(spark, "none") + ".arrow"
    files.save(table(spark, folder, "orders").where("o_orderkey < 0"), path)
    return files.load(spark, path)


@query
def src_file_info(spark, folder):
    """Facts about the files of a table, with the rows that each holds."""
    path = new_path(spark, "lineitem")
    lineitem = table(spark, folder, "lineitem")
    # A task sorts its rows by the flag: four for each of the scan's keep that small.
    n = 4 * file_count(lineitem, 1)
    lineitem.repartition(n, "l_orderkey").write.partitionBy("l_returnflag").parquet(path)
    info = files.file_info(spark, path, rows=spark.read.parquet(path))
    flag = F.regexp_extract("path", "l_returnflag=([^/]+)/", 1)
    return info.groupBy(flag.alias("flag"), "extension").agg(
        F.sum("n_rows").alias("n_rows"), F.bool_and(F.col("size_bytes") > 0).alias("has_bytes")
    )


@query
def src_sql_query(spark, folder):
    table(spark, folder, "orders").createOrReplaceTempView("sondage_orders")
    return sql.read_query(
        spark,
        "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total "
        "FROM sondage_orders GROUP BY o_orderstatus",
    )


@query
def src_sql_table(spark, folder):
    """Written twice over: replaced, then appended to."""
    name = "sondage_customer"
    customer = table(spark, folder, "customer")
    path = new_path(spark, name)
    sql.write_table(customer, name, path=path)
    sql.write_table(customer.where("c_acctbal < 0"), name, if_exists="append", path=path)
    return sql.read_table(spark, name)


@query
def src_list_tables(spark, folder):
    for name in ("orders", "customer"):
        table(spark, folder, name).createOrReplaceTempView(f"sondage_view_{name}")
    listed = sql.list_tables(spark).where(F.col("table_name").startswith("sondage_view_"))
    names = [r["table_name"] for r in listed.collect()]
    counts = [
        sql.read_table(spark, n).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(n).alias("table_name"), "n_rows"
        )
        for n in names
    ]
    return reduce(DataFrame.unionByName, counts)
