"""A content-addressed web archive.

Every payload is stored once, under its SHA-256; every record keeps its exact header block
and the digest of its payload. Original records come back by a join on the digest, and
each payload read is checked against its digest and the one in the header. Of records
with equal payloads the one with the largest id is a ``response``, the others are
``revisit`` records that refer to it.

Only digests and ids are aggregated; a payload moves to where it is stored once, by the id
of the record that keeps it, so a payload that a third of all records share makes no
large group. On reading, a digest with many records is a skewed join that adaptive
execution splits.

Defined cases: a null payload counts as empty; payloads below ``least_bytes`` are never
referred to; records that repeat the largest id (or lack any id) are all responses, their
payload still stored once; a null address leaves its line out; line breaks in an address
become spaces; an empty table gives empty archives; only the named columns are read.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# RFC 4648 digits beside those of conv() in base 32.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: 40 hex digits as four numbers of 40 bits."""
    digest = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)
    ]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _name(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("none"))


def _urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), _name(key), F.lit(">"))


def _header(date: str) -> Column:
    """The header block with the empty line that ends it."""
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("key"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("address", "[\r\n]+", " ")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "sha1"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("keeper")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("bytes"))),
    ]
    # concat_ws leaves out the lines that are null.
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def write_archive(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    address_column: str = "url",
    payload_column: str = "html",
    least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Writes ``payloads`` (digest, payload) and ``records`` (header, digest) as Parquet
    below ``folder``."""
    payload = F.coalesce(pages[payload_column], F.lit("")).cast("binary")
    rows = pages.select(
        pages[id_column].alias("key"), pages[address_column].alias("address"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    keepers = rows.groupBy("digest").agg(F.max("key").alias("keeper"))
    # A digest has one keeper, so that rows of its id, which the join has brought together,
    # are all that could store the payload twice.
    name = _name(F.col("key")).alias("name")
    kept = rows.select(name, "digest", "payload").join(
        keepers.select(_name(F.col("keeper")).alias("name"), "digest"), ["name", "digest"], "left_semi"
    )
    kept = kept.dropDuplicates(["name", "digest"])
    kept.select("digest", "payload").write.parquet(f"{folder}/payloads")
    named = rows.select(
        "key", "address", "digest", F.octet_length("payload").cast("long").alias("bytes"),
        base32_sha1(F.col("payload")).alias("sha1"),
    ).join(keepers, "digest")
    refers = (F.col("bytes") >= least_bytes) & ~F.col("key").eqNullSafe(F.col("keeper"))
    named = named.withColumn("record_type", F.when(refers, "revisit").otherwise("response"))
    named.select(_header(date).alias("header"), "digest").write.parquet(f"{folder}/records")


def _field(name: str, pattern: str) -> Column:
    found = F.regexp_extract("header", f"\r\n{name}: {pattern}\r\n", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """The original records: page_id, header, payload (binary), record_type, refers_to and
    payload_digest. A payload that does not match its digests raises an error."""
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    records = spark.read.schema("header string, digest string").parquet(f"{folder}/records")
    sha1 = _field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})")
    right = (F.sha2("payload", 256) == F.col("digest")) & (base32_sha1(F.col("payload")) == sha1)
    checked = F.when(right, sha1).otherwise(
        F.raise_error(F.concat(F.lit("payload of another digest than "), "digest"))
    )
    return records.join(payloads, "digest", "left").select(
        _field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast(id_type).alias("page_id"),
        "header",
        "payload",
        _field("WARC-Type", "([a-z]+)").alias("record_type"),
        _field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast(id_type).alias("refers_to"),
        checked.alias("payload_digest"),
    )


def export_warc(spark: SparkSession, folder: str, target: str, compression: str = "gzip") -> None:
    """The archive as WARC files of text: a record's header and payload, ended by two line
    breaks. Revisits have no payload of their own."""
    records = read_archive(spark, folder)
    body = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload").cast("string"))
    whole = records.select(F.concat("header", body).alias("value"))
    whole.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(target)
