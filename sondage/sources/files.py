"""Load and save tables by file format, and describe files."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.sources import arrow_ipc, delimited, json_files

READ_FORMATS = ("csv", "txt", "json", "parquet", "feather", "arrow")
WRITE_FORMATS = ("csv", "json", "parquet", "feather", "arrow")


def format_of(path: str, file_type: str | None = None) -> str:
    """The given type, or the extension in lower case."""
    return file_type or os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")


def load(spark: SparkSession, path: str, file_type: str | None = None, **options) -> DataFrame:
    """Read a table; options go to the reader.

    A path may be a file, a folder of files or a glob. A missing path is an error
    (PATH_NOT_FOUND), as is an unknown type.
    """
    kind = format_of(path, file_type)
    if kind in ("csv", "txt"):
        return delimited.read_csv(spark, path, **options)
    if kind == "json":
        return json_files.read_json(spark, path, **options)
    if kind == "parquet":
        return spark.read.options(**options).parquet(path)
    if kind in ("feather", "arrow"):
        return arrow_ipc.read_arrow(spark, path)
    raise ValueError(f"Unsupported file type: {kind}")


def save(
    df: DataFrame, path: str, file_type: str | None = None, mode: str = "overwrite", **options
) -> None:
    """Write a table as a folder of files, missing parent folders included."""
    kind = format_of(path, file_type)
    if kind == "csv":
        delimited.write_csv(df, path, mode=mode, **options)
    elif kind in ("json", "parquet"):
        df.write.mode(mode).options(**options).format(kind).save(path)
    elif kind in ("feather", "arrow"):
        arrow_ipc.write_arrow(df, path, mode=mode)
    else:
        raise ValueError(f"Unsupported file type: {kind}")


def save_result(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a result table as JSON lines; numbers stay numbers, NULLs are kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def load_result(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def file_info(spark: SparkSession, path: str, rows: DataFrame | None = None) -> DataFrame:
    """Rows (name, path, size_bytes, size_mb, extension, modified), one per file.

    Only the file listing is read: the content column is pruned away. With ``rows``, a
    table read from these files, n_rows says how many of its rows each file holds.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "length", "modificationTime", F.col("_metadata.file_path").alias("_file"))
    )
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select(
        name.alias("name"),
        F.col("path"),
        F.col("length").alias("size_bytes"),
        F.round(F.col("length") / 1048576.0, 2).alias("size_mb"),
        F.regexp_extract(name, r"(\.[^.]+)$", 1).alias("extension"),
        F.col("modificationTime").alias("modified"),
        "_file",
    )
    if rows is None:
        return found.drop("_file")
    held = rows.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("n_rows"))
    return found.join(held, "_file", "left").drop("_file").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
