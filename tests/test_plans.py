"""What the plans of the operators must and must not contain."""

import re

import pytest

from sondage.operators import charts, describe, frequencies, quality, relations, schema
from sondage.operators.stats import column_stats

PYTHON = re.compile("Python|Arrow")


@pytest.fixture(scope="module")
def lineitem(spark, folder):
    return spark.read.parquet(f"{folder}/lineitem.parquet")


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


OPERATORS = {
    "numeric_summary": describe.numeric_summary,
    "distributions": describe.distributions,
    "statistical_tests": describe.statistical_tests,
    "distinct": frequencies.distinct_counts,
    "top": frequencies.top_values,
    "missing": quality.missing,
    "duplicates": quality.duplicates,
    "outliers": quality.outliers,
    "report": quality.report,
    "score": quality.score,
    "correlations": relations.correlations,
    "associations": relations.associations,
    "variance": relations.variance_by_category,
    "profile": schema.column_profile,
    "samples": schema.sample_values,
    "histogram": charts.histogram,
    "box": charts.box,
    "density": charts.density,
    "pairplot": charts.pairplot,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_python_and_no_products_over_rows(lineitem, name):
    text = plan(OPERATORS[name](lineitem))
    # Correlations are matrix products of whole Arrow batches.
    assert name == "correlations" or not PYTHON.search(text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", OPERATORS)
def test_no_window_over_one_partition(lineitem, name):
    """A window without partitioning would need all rows in one task."""
    text = plan(OPERATORS[name](lineitem))
    for window in re.findall(r"\(\d+\) Window\n.*\n(?:Arguments: .*)", text):
        assert not re.search(r"windowspecdefinition\([^)]*\)\) AS [^\]]*\], \[\]", window)


def test_only_the_used_columns_are_read(lineitem):
    text = plan(describe.numeric_summary(lineitem, ["l_tax"]))
    assert set(re.findall(r"ReadSchema: (.*)", text)) == {"struct<l_tax:double>"}


def test_filters_reach_the_scan(lineitem):
    text = plan(describe.numeric_summary(lineitem.where("l_quantity > 10"), ["l_tax"]))
    assert "GreaterThan(l_quantity,10.0)" in text


def test_top_values_are_cut_before_the_shuffle(lineitem):
    text = plan(frequencies.top_values(lineitem))
    assert re.search(r"WindowGroupLimit[^(]*\n.*\n.*Partial", text)


def test_samples_and_ranking_are_top_k(lineitem):
    assert "TakeOrderedAndProject" in plan(schema.sample_values(lineitem))
    assert "TakeOrderedAndProject" in plan(quality.outlier_values(lineitem, "l_tax"))
    assert "TakeOrderedAndProject" in plan(charts.bar(lineitem))


def test_no_column_is_sorted_in_one_task(lineitem):
    """Quantiles are counted at every size: what is kept in between is read back."""
    assert "Scan ExistingRDD" in plan(column_stats(lineitem, ["l_tax"], ["n"], {"m": 0.5}))


def test_correlations_read_the_table_once(lineitem):
    for columns in (["l_tax", "l_discount"], ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_tax"]):
        assert len(re.findall(r"\(\d+\) Scan parquet", plan(relations.correlation_matrix(lineitem, columns)).partition("\n\n")[2])) == 1


def test_columns_of_all_types_are_counted_in_one_scan(lineitem):
    for table in (frequencies.distinct_counts(lineitem), column_stats(lineitem, ["l_tax", "l_partkey", "l_linenumber"], [], mode=True, base=describe.whole_moments(lineitem))):
        scans = len(re.findall(r"\(\d+\) Scan parquet", plan(table).partition("\n\n")[2]))
        assert scans == (2 if "mode" in table.columns else 1)  # the moments are another


def test_findings_look_for_no_quantiles(spark, lineitem):
    from sondage.plans import analysis
    from sondage.plans.shared import Shared

    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.jobsList(None).size()
    analysis.warnings(lineitem), analysis.recommendations(lineitem)
    assert store.jobsList(None).size() == before
    shared = Shared(lineitem)
    analysis.warnings(lineitem, shared), analysis.recommendations(lineitem, shared=shared)
    assert "stats" not in shared.__dict__
    shared.release()


@pytest.mark.parametrize("kind", ["json", "markdown"])
def test_reports_release_what_they_cached(spark, tmp_path, kind):
    from sondage.plans.report import generate_report

    spark.catalog.clearCache()
    df = spark.range(40).selectExpr("id", "id * 2.5 AS x", "CAST(id % 3 AS string) AS s")
    generate_report(df, str(tmp_path), "cached", output_format=kind, include_charts=False)
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_a_session_without_folder_fails_clearly(spark, monkeypatch):
    from sondage import session

    class Context:
        def getCheckpointDir(self):
            return None

    class Bare:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Bare())
