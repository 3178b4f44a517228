"""Reading delimited files chunk by chunk, as a stream of files.

Where a folder holds more than one wants to take in at once, or grows, its files are
read in micro-batches and appended to one table. The stream only lists files; each batch
of them is read like any other, so that quoted line breaks, headers in another order and
missing-value tokens mean the same. The checkpoint in the shared folder remembers which
files are done, and a batch that is repeated writes over its own folder, so an interrupted
run goes on where it stopped and every row arrives once.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sondage.session import new_path
from sondage.sources.delimited import NA_TOKENS, read_csv

LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def read_csv_in_chunks(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    target: str,
    files_per_chunk: int = 1,
    encoding: str = "utf-8",
    delimiter: str = ",",
    checkpoint: str | None = None,
    na_tokens: Sequence[str] = NA_TOKENS,
) -> DataFrame:
    """Append all files of ``folder`` to the Parquet table ``target``, a folder
    ``chunk=N`` for each batch, and return it."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def take_in(files: DataFrame, number: int) -> None:
        paths = [r["path"] for r in files.collect()]  # files_per_chunk of them
        rows = read_csv(files.sparkSession, paths, encoding, delimiter, wanted, na_tokens=na_tokens)
        rows.write.mode("overwrite").parquet(f"{target}/chunk={number}")

    # Contents are not asked for, so files are listed only.
    files = (
        spark.readStream.format("binaryFile").schema(LISTING)
        .option("maxFilesPerTrigger", files_per_chunk).load(folder).select("path")
    )
    query = (
        files.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint or new_path(spark, "chunks"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(wanted).parquet(target).select([f.name for f in wanted.fields])
