"""Archives written and read back."""

import base64
import gzip
import hashlib

import pytest

from sondage.llm import warc
from sondage.llm.queries import QUERIES
from sondage.session import new_path


def plain(rows, least=0):
    """Per record: bytes, digest, type, refers_to."""
    last = {}
    for i, _, html in rows:
        data = (html or "").encode()
        last[data] = i if last.get(data) is None else max(i if i is not None else last[data], last[data])
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = len(data) >= least and i != last[data]
        out.append((i, len(data), digest, "revisit" if revisit else "response", last[data] if revisit else None))
    return sorted(out, key=str)


def read(spark, df, **options):
    folder = new_path(spark, "warc")
    warc.write_archive(df, folder, **options)
    rows = warc.read_archive(spark, folder).collect()
    assert all(r["header"].endswith("\r\n\r\n") for r in rows)
    found = [(r["page_id"], len(r["payload"]), r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]
    return folder, sorted(found, key=str)


ROWS = [
    (1, "http://a", "same"), (5, "http://b\r\nX: y", "same"), (3, None, "same"), (7, "u", None), (2, "v", ""),
    (9, "w", "É 😀\r\n\r\nWARC/1.1"), (9, "w", "É 😀\r\n\r\nWARC/1.1"), (10, "z", "x" * 2_000_000), (None, "n", "alone"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_small_cases(spark, least):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS digest")
    folder, found = read(spark, df, least_bytes=least)
    assert found == plain(ROWS, least)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({r[2] or "" for r in ROWS})


def test_query(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    pages = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    found = QUERIES["op7_warc_archive"](spark, folder).collect()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[n] for n in names) for r in found), key=str) == plain(pages)


def test_damaged_payload_is_noticed(spark):
    df = spark.createDataFrame(ROWS[:3], "page_id long, url string, html string")
    folder, _ = read(spark, df)
    bad = spark.read.parquet(f"{folder}/payloads").selectExpr("digest", "CAST('other' AS BINARY) AS payload").collect()
    spark.createDataFrame(bad, "digest string, payload binary").write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="payload of another digest"):
        warc.read_archive(spark, folder).collect()


def test_export(spark):
    df = spark.createDataFrame(ROWS[:2], "page_id long, url string, html string").coalesce(1)
    folder, _ = read(spark, df)
    warc.export_warc(spark, folder, f"{folder}/files")
    from pathlib import Path

    text = "".join(gzip.decompress(p.read_bytes()).decode() for p in Path(f"{folder}/files").glob("*.gz"))
    assert text.count("WARC/1.1\r\n") == 2 and "\r\n\r\nsame\r\n\r\n" in text
    assert text.count("WARC-Refers-To: <urn:page:5>") == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert read(spark, df)[1] == []
