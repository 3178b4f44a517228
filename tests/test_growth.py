"""What queries write and read in one piece does not grow with their table."""

from glob import glob

import pytest

from workload import queries


@pytest.fixture
def tables(spark, folder, tmp_path):
    """The tables in 12 files each, and a count of the files that a query leaves."""
    for name in ("documents", "lineitem", "customer"):
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(12).write.parquet(f"{tmp_path}/{name}.parquet")
    names = ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")
    old = {k: spark.conf.get(k) for k in names}
    for k in names:
        spark.conf.set(k, "1m")
    shared = spark.conf.get("spark.checkpoint.dir")
    earlier = set(glob(f"{shared}/**/part-*", recursive=True))
    yield str(tmp_path), lambda pattern: len(set(glob(f"{shared}/{pattern}", recursive=True)) - earlier)
    for k, v in old.items():
        spark.conf.set(k, v)


def test_line_breaks_are_written_by_all_tasks(spark, tables):
    folder, files = tables
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert queries.src_csv_line_breaks(spark, folder).count() == n
    assert files("breaks-*.csv/part-*") == 12


def test_parts_of_a_table_are_written_by_all_tasks(spark, tables):
    folder, files = tables
    found = {r["flag"]: r["n_rows"] for r in queries.src_file_info(spark, folder).collect()}
    wanted = spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    assert found == {r["l_returnflag"]: r["count"] for r in wanted}
    assert files("lineitem-*/l_returnflag=N/part-*") >= 12


def test_profiled_files_are_as_many_as_the_scan_has_tasks(spark, tables):
    folder, files = tables
    assert queries.profile_of_chunks(spark, folder).count() == len(spark.read.parquet(f"{folder}/lineitem.parquet").columns)
    assert files("lineitem-*/part-*") == 12
    assert files("profile-*/chunk=*/part-*") == 3


def test_chunked_files_are_as_many_as_the_scan_has_tasks(spark, tables):
    folder, files = tables
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert queries.src_csv_chunks_text(spark, folder).count() == n
    assert files("documents-*.csv/part-*") == 12


@pytest.mark.parametrize("name", ["src_json_columns", "src_json_records"])
def test_json_documents_have_limited_rows(spark, tables, monkeypatch, name):
    folder, files = tables
    monkeypatch.setattr(queries, "ROWS_PER_DOCUMENT", 30)
    wanted = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")
    found = getattr(queries, name)(spark, folder).select(wanted.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    kind = name.removeprefix("src_json_")
    assert files(f"{kind}-*.json/document=*/part-*") == -(-wanted.count() // 30)
