"""Records of quoted text cut from split files, against Python's csv module."""

import csv
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import sondage
from sondage.sources import delimited, records
from sondage.streaming.chunks import read_csv_in_chunks


@pytest.fixture
def small_splits(spark):
    """Splits of some hundred bytes, so that records cross many of them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        for key in old:
            spark.conf.set(key, str(size))

    yield use
    for key, value in old.items():
        spark.conf.set(key, value)


def odd_text(draw):
    parts = ["a", "b c", "é", '"', '""', ",", ";", "\n", "\r\n", "x" * 20, "日", "'", "\\", " "]
    return "".join(draw.choice(parts) for _ in range(draw.randrange(9)))


def plain(text, delimiter):
    """As the reader has it: empty is missing."""
    return text or None


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
@pytest.mark.parametrize("size", [37, 300, 100_000])
def test_split_files_hold_what_a_plain_reader_finds(spark, tmp_path, small_splits, delimiter, size):
    draw = random.Random(size)
    expected = []
    for f in range(3):
        out = io.StringIO()
        # The last file's header is quoted and goes over two lines.
        writer = csv.writer(out, delimiter=delimiter, lineterminator=["\n", "\r\n", "\n"][f], quoting=[0, 1, 0][f])
        writer.writerow(["id", "one", "two\nlines", "end"])
        for i in range(8 if size == 37 else 60):
            row = [f"{f}-{i}", odd_text(draw), odd_text(draw), "z"]
            writer.writerow(row)
            expected.append(tuple(plain(x, delimiter) for x in row))
        (tmp_path / f"{f}.csv").write_bytes(out.getvalue().encode())
    small_splits(size)
    df = delimited.read_csv(spark, str(tmp_path), delimiter=delimiter, na_tokens=[""])
    assert df.columns == ["id", "one", "two\nlines", "end"]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(expected, key=repr)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    path.write_text("id,text\n" + "".join(f'{i},"line {i}\nsecond ""{i}"" line"\n' for i in range(3000)))
    small_splits(10_000)
    df = delimited.read_csv(spark, str(path), schema="text string, id bigint")
    lines = records.lines_of(spark, [str(path)])
    assert lines.rdd.getNumPartitions() > 5
    found = records.ranges(lines, ",")
    assert found.count() == lines.rdd.getNumPartitions()
    assert df.agg(F.sum("id"), F.count("*"), F.countDistinct("text")).first()[:] == (2999 * 1500, 3000, 3000)
    assert df.where("text = concat('line ', id, chr(10), 'second \"', id, '\" line')").count() == 3000
    assert df.rdd.getNumPartitions() > 5


def test_a_value_over_many_splits_and_an_unclosed_quote(spark, tmp_path, small_splits):
    value = "\n".join(f"row {i}, with comma" for i in range(500))
    path = tmp_path / "t.csv"
    path.write_text(f'a,b\n1,"{value}"\n2,x\n3,"never closed\n4,y\n')
    small_splits(200)
    rows = {r["a"]: r["b"] for r in delimited.read_csv(spark, str(path)).collect()}
    assert rows == {1: value, 2: "x", 3: "never closed\n4,y\n"} or rows == {1: value, 2: "x", 3: "never closed\n4,y"}


def test_a_quote_inside_a_value_changes_nothing(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('id,size\n1,5" pipe\n2,7"\n3,x\n')
    df = delimited.read_csv(spark, str(tmp_path))
    assert sorted(df.collect()) == [(1, '5" pipe'), (2, '7"'), (3, "x")]
    assert "MapInArrow" not in df._jdf.queryExecution().toString()  # Spark's own reader
    (tmp_path / "b.csv").write_text('id,size\n4,"a\nb"\n5,9" nail\n')
    df = delimited.read_csv(spark, str(tmp_path))
    assert sorted(df.collect()) == [(1, '5" pipe'), (2, '7"'), (3, "x"), (4, "a\nb"), (5, '9" nail')]


def test_schema_goes_by_name(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,t,more\n1,x,9\n")
    row = delimited.read_csv(spark, str(path), schema="t string, id int").first()
    assert row.asDict() == {"t": "x", "id": 1}
    with pytest.raises(ValueError, match="absent"):
        delimited.read_csv(spark, str(path), schema="absent int")


def test_chunks_equal_a_plain_read(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(4):
        header = "t,id" if i == 3 else "id,t"
        body = f'"b\r\nc","1{i}"' if i == 3 else f'1{i},"a\nb"\n2{i},x\n3{i},5" nail'
        (source / f"file {i}.csv").write_bytes(f"{header}\n{body}\n".encode())
    args = (spark, str(source), "id int, t string", str(tmp_path / "out"))
    rows = sorted(tuple(r) for r in read_csv_in_chunks(*args, checkpoint=str(tmp_path / "state")).collect())
    expected = [(10 * k + i, t) for i in range(3) for k, t in ((1, "a\nb"), (2, "x"), (3, '5" nail'))] + [(13, "b\r\nc")]
    assert rows == sorted(expected)


def test_latin_1_and_byte_order_mark(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes('a,b\n"é\nü",1\n'.encode("latin-1"))
    assert delimited.read_csv(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1").first()[:] == ("é\nü", 1)
    (tmp_path / "u.csv").write_bytes(b"\xef\xbb\xbf" + 'a,b\n"é\nü",1\n'.encode())
    df = delimited.read_csv(spark, str(tmp_path / "u.csv"))
    assert df.columns == ["a", "b"] and df.first()[:] == ("é\nü", 1)
    (tmp_path / "w.csv").write_bytes('a,b\n"é\nü",1\n'.encode("utf-16"))
    assert delimited.read_csv(spark, str(tmp_path / "w.csv"), encoding="UTF-16").first()[:] == ("é\nü", 1)


@pytest.mark.parametrize("text", ['"' * 400_001, 'a,"' + '""' * 300_000, ',"",' * 200_000 + '"', '"a",' * 200_000 + '"open', '""' * 300_000])
def test_very_long_lines_neither_overflow_nor_slow_down(spark, text):
    df = spark.createDataFrame([(text,), ("x" + text,)], "line string").repartition(1)
    got = [r[0] for r in df.select(records.line_function(F.col("line"), ",")).collect()]
    for value, line in zip(got, (text, "x" + text), strict=True):
        for start in (0, 1):
            quoted, i = bool(start), 0
            field_start = not start
            while i < len(line):
                c = line[i]
                if quoted:
                    if c == '"':
                        if line[i + 1 : i + 2] == '"':
                            i += 1
                        else:
                            quoted = False
                else:
                    quoted = field_start and c == '"'
                    field_start = c == ","
                i += 1
            assert bool(value & (1 << start)) == quoted, (line[:20], start)


def test_states_of_lines():
    draw = np.random.default_rng(1)
    for _ in range(50):
        does = draw.integers(0, 4, draw.integers(0, 30))
        for start in (0, 1):
            state, states = start, [start]
            for d in does.tolist():
                state = (d >> state) & 1
                states.append(state)
            assert records._states(does, start).tolist() == states


def test_empty_and_header_only_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text('a,"b\nc"\n')
    assert delimited.read_csv(spark, str(tmp_path / "h.csv")).count() == 0
    (tmp_path / "e.csv").write_text("a,b\n")
    assert sondage.load(spark, str(tmp_path / "e.csv")).columns == ["a", "b"]
