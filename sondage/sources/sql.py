"""SQL text and named tables: of the session's catalog, or of a database over JDBC.

Without a ``url`` everything is about the session's catalog. With one, Spark's JDBC
source pushes column selection, filters and limits down to the database.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What to do if the written table exists.
IF_EXISTS = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}
DEFAULT_PORT = 5432


def database_options(
    host: str | None,
    name: str | None,
    user: str | None,
    password: str | None,
    port: int | None = None,
    driver: str = "postgresql",
) -> dict[str, str] | None:
    """JDBC options, or None unless host, name, user and password are all given."""
    if not all([host, name, user, password]):
        return None
    url = f"jdbc:{driver}://{host}:{port or DEFAULT_PORT}/{name}"
    return {"url": url, "user": user, "password": password}


def _qualified(table: str, schema: str | None) -> str:
    return f"{schema}.{table}" if schema else table


def read_query(spark: SparkSession, query: str, url: str | None = None, **options) -> DataFrame:
    """The result of SQL text."""
    if url is None:
        return spark.sql(query)
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def read_table(
    spark: SparkSession,
    table: str,
    schema: str | None = None,
    url: str | None = None,
    partition_column: str | None = None,
    partitions: int = 8,
    **options,
) -> DataFrame:
    """A whole table.

    Over JDBC, ``partition_column`` (numeric, date or timestamp) reads it in that many
    concurrent ranges; the ends of the range are one row asked of the database. Without
    it one connection reads everything, which suits small tables only.
    """
    name = _qualified(table, schema)
    if url is None:
        return spark.table(name)
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if partition_column:
        ends = f"SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {name}"
        lo, hi = read_query(spark, ends, url, **options).first()
        if lo is not None:
            reader = reader.options(
                partitionColumn=partition_column, lowerBound=lo, upperBound=hi,
                numPartitions=partitions,
            )
    return reader.load()


def write_table(
    df: DataFrame,
    table: str,
    schema: str | None = None,
    if_exists: str = "replace",
    url: str | None = None,
    **options,
) -> None:
    if if_exists not in IF_EXISTS:
        raise ValueError(f"Unknown if_exists: {if_exists}")
    name = _qualified(table, schema)
    mode = IF_EXISTS[if_exists]
    if url is None:
        df.write.mode(mode).options(**options).saveAsTable(name)
    else:
        df.write.format("jdbc").mode(mode).options(url=url, dbtable=name, **options).save()


def list_tables(
    spark: SparkSession, schema: str | None = None, url: str | None = None, **options
) -> DataFrame:
    """Rows (table_name). Over JDBC from the standard information schema."""
    if url is None:
        listed = spark.sql(f"SHOW TABLES IN {schema}" if schema else "SHOW TABLES")
        return listed.select(F.col("tableName").alias("table_name"))
    query = "SELECT table_name FROM information_schema.tables"
    if schema:
        query += " WHERE table_schema = '{}'".format(schema.replace("'", "''"))
    return read_query(spark, query, url, **options).toDF("table_name")
