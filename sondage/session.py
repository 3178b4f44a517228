"""Where intermediate results go."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``.

    There is no other choice that is right on a cluster, so its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError(
            "Set spark.checkpoint.dir to a folder that all executors share, or call "
            "sondage.session.use_folder_below_warehouse(spark)"
        )
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def use_folder_below_warehouse(spark: SparkSession) -> None:
    """Where neither session nor context names a folder: one below the warehouse, which
    holds the session's tables and so is shared as well."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        spark.sparkContext.setCheckpointDir(f"{warehouse}/_shared")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that every later use,
    also one recomputed after the loss of an executor, sees the same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
