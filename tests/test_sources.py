"""Reading and writing files, SQL and reports."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import sondage
from sondage.session import checkpointed, new_path, shared_folder
from sondage.sources import arrow_ipc, delimited, files, json_files, sql
from sondage.streaming.chunks import read_csv_in_chunks


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "i,d,b,day,at,s,n,suffix,long\n"
        "1,1.5,True,2020-01-02,2020-01-02 03:04:05,x,NA,1d,12345678901234567890\n"
        "NA,nan,False,N/A,null,None,,2f,1\n"
        '-7,1e3,true,1999-12-31,1999-12-31T00:00:00Z,"a ""q"", b",<NA>,3,2\n'
    )
    df = sondage.load(spark, str(path))
    assert dict(df.dtypes) == {
        "i": "bigint", "d": "double", "b": "boolean", "day": "date", "at": "timestamp",
        "s": "string", "n": "string", "suffix": "string", "long": "decimal(38,0)",
    }
    rows = df.collect()
    assert [r["i"] for r in rows] == [1, None, -7]
    assert [r["d"] for r in rows] == [1.5, None, 1000.0]
    assert [r["s"] for r in rows] == ["x", None, 'a "q", b']
    assert [r["n"] for r in rows] == [None] * 3


@pytest.mark.parametrize("delimiter", delimited.DELIMITERS)
def test_delimiters(spark, tmp_path, delimiter):
    path = tmp_path / "t.txt"
    path.write_text(f"a{delimiter}b\n1{delimiter}x\n")
    assert delimited.infer_delimiter(spark, str(path)) == delimiter
    row = delimited.read_csv(spark, str(path), delimiter=delimiter).first()
    assert row[:] == (1, "x")


def test_delimiter_ties_and_failures(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("a;b,c\n" + "x\n" * 4 + "|||||||\n")
    assert delimited.infer_delimiter(spark, str(path)) == ","
    assert delimited.infer_delimiter(spark, str(tmp_path / "nothing")) == ","


def test_encoding(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("a,b\né,1\n".encode("latin-1"))
    row = delimited.read_csv(spark, str(path), encoding="ISO-8859-1").first()
    assert row["a"] == "é"


def test_json_layouts(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    texts = {
        "lines": "\n".join(json.dumps(r) for r in rows),
        "records": json.dumps(rows, indent=1),
        "columns": json.dumps({"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": None}}),
    }
    for layout, text in texts.items():
        path = tmp_path / f"{layout}.json"
        path.write_text(text)
        assert json_files.guess_layout(spark, str(path)) == layout
        df = sondage.load(spark, str(path))
        assert df.columns == ["a", "b"]
        assert sorted((r["a"], r["b"]) for r in df.collect()) == [(1, "x"), (2, None)], layout


def test_arrow_batches_become_partitions(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    folder = tmp_path / "t.arrow"
    folder.mkdir()
    for f in range(2):
        batch = pa.table({"a": list(range(100)), "s": [str(f)] * 100})
        with pa.ipc.new_file(str(folder / f"{f}.arrow"), batch.schema) as writer:
            writer.write_table(batch, max_chunksize=3)
    size = (folder / "0.arrow").stat().st_size
    monkeypatch.setattr(arrow_ipc.ArrowReader, "bytes_per_partition", size // 3 + 1)
    df = arrow_ipc.read_arrow(spark, str(folder))
    assert df.rdd.getNumPartitions() == 2 * 3  # each file in three shares
    assert df.agg(F.count("*"), F.sum("a"), F.countDistinct("s")).first()[:] == (200, 9900, 2)
    assert df.select("s").distinct().count() == 2


def test_arrow_overwrite_and_append(spark, tmp_path):
    path = str(tmp_path / "t.feather")
    df = spark.range(10).withColumn("t", F.timestamp_seconds("id").cast("timestamp_ntz"))
    sondage.save(df, path)
    sondage.save(df.where("id < 3"), path)
    assert sorted(r["id"] for r in sondage.load(spark, path).collect()) == [0, 1, 2]
    sondage.save(df.where("id > 7"), path, mode="append")
    back = sondage.load(spark, path)
    assert back.count() == 5 and dict(back.dtypes)["t"] == "timestamp_ntz"
    assert not [p for p in (tmp_path / "t.feather").iterdir() if p.name.startswith("_")]


@pytest.mark.parametrize("kind", ["csv", "json", "parquet", "feather"])
def test_round_trips_make_parent_folders(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a bigint, b string")
    path = str(tmp_path / "deep" / "er" / f"t.{kind}")
    sondage.save(df, path)
    assert sorted(sondage.load(spark, path).select("a", "b").collect()) == sorted(df.collect())


def test_unknown_and_missing_files(spark, tmp_path):
    df = spark.range(1)
    with pytest.raises(ValueError):
        sondage.load(spark, str(tmp_path / "t.docx"))
    with pytest.raises(ValueError):
        sondage.save(df, str(tmp_path / "t.docx"))
    for kind in ("csv", "parquet", "json"):
        with pytest.raises(AnalysisException):
            sondage.load(spark, str(tmp_path / f"nothing.{kind}")).count()
    assert files.format_of("A/B.CSV") == "csv" and files.format_of("x", "json") == "json"


def test_file_info(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 2097152)
    row = files.file_info(spark, str(tmp_path)).first()
    assert (row["name"], row["size_bytes"], row["size_mb"], row["extension"]) == (
        "a.bin", 2097152, 2.0, ".bin",
    )


def test_rows_of_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"a {i}%.csv").write_text("x\n" + "1\n" * i)
    rows = spark.read.option("header", "true").csv(str(tmp_path))
    found = files.file_info(spark, str(tmp_path), rows=rows)
    assert {r["name"]: r["n_rows"] for r in found.collect()} == {"a 0%.csv": 0, "a 1%.csv": 1, "a 2%.csv": 2}


def test_chunks_arrive_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    args = (spark, str(source), "a int, s string", str(tmp_path / "out"))
    state = str(tmp_path / "state")
    for i in range(3):
        (source / f"{i}.csv").write_text(f"a,s\n{i},x\nNA,null\n")
    assert read_csv_in_chunks(*args, checkpoint=state).count() == 6
    (source / "3.csv").write_text("a,s\n3,y\n")
    rows = read_csv_in_chunks(*args, checkpoint=state).collect()
    assert len(rows) == 7 and sorted(r["a"] for r in rows if r["a"] is not None) == [0, 1, 2, 3]


def test_catalog_tables(spark):
    df = spark.range(5)
    sql.write_table(df, "t_catalog")
    sql.write_table(df, "t_catalog", if_exists="append")
    assert sql.read_table(spark, "t_catalog").count() == 10
    sql.write_table(df, "t_catalog", schema="default", if_exists="replace")
    assert sql.read_query(spark, "SELECT count(*) FROM t_catalog").first()[0] == 5
    with pytest.raises(AnalysisException):
        sql.write_table(df, "t_catalog", if_exists="fail")
    with pytest.raises(ValueError):
        sql.write_table(df, "t_catalog", if_exists="maybe")
    assert "t_catalog" in [r[0] for r in sql.list_tables(spark, "default").collect()]


def test_database_options():
    assert sql.database_options("h", "n", "u", "p") == {
        "url": "jdbc:postgresql://h:5432/n", "user": "u", "password": "p",
    }
    assert sql.database_options("h", "n", "u", "p", 99, "mysql")["url"] == "jdbc:mysql://h:99/n"
    assert sql.database_options("h", "n", None, "p") is None


def test_shared_folder_is_the_configured_one(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    assert new_path(spark, "x").startswith(folder) and new_path(spark, "x") != new_path(spark, "x")
    assert checkpointed(spark.range(3)).count() == 3


@pytest.mark.parametrize("kind", ["json", "markdown", "parquet"])
def test_reports(spark, tmp_path, kind):
    df = spark.range(60).select(
        "id", (F.col("id") * 2.0).alias("x"), (F.col("id") % 2).cast("string").alias("s")
    )
    result = sondage.generate_report(
        df, str(tmp_path), "sample", output_format=kind, raw_order=["id"]
    )
    written = ["Columns", "Analysis", "Relationships"]
    if kind != "markdown":
        written += ["Charts", "Raw rows"]
    assert result.sections_included == written
    assert result.charts_count == (0 if kind == "markdown" else 3) and result.report_format == kind
    assert f"report_sample_" in result.report_path and result.report_path.endswith(kind)
    if kind == "markdown":
        lines = [r["value"] for r in spark.read.text(result.report_path).collect()]
        assert lines[0] == "# Profile" and "- Rows: 60" in lines
        assert "| id | bigint | identifier | 0.0% | 100.0% |" in lines
        assert lines.index("## Observations") > lines.index("## Columns")
    else:
        facts = spark.read.format(kind).load(f"{result.report_path}/facts")
        assert facts.where("section = 'schema.overview' AND key = 'total_rows'").first()["number"] == 60
        assert spark.read.format(kind).load(f"{result.report_path}/raw_sample").count() == 60
        about = spark.read.format(kind).load(f"{result.report_path}/metadata").first()
        assert (about["file"], about["charts"], about["sections"]) == ("sample", 3, written)


def test_report_arguments(spark, tmp_path):
    with pytest.raises(ValueError):
        sondage.generate_report(spark.range(1), str(tmp_path), "x", output_format="pdf")
