"""Arrow IPC (Feather version 2) files as a Spark data source.

Reading makes partitions of the files' sizes; footers are opened, and schemas compared, in
the tasks. Only the first file's schema is read while planning. Writing gives one file per task, renamed into
place when the job commits, so that lost or repeated tasks leave nothing behind.
"""

import os
import sys
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUFFIXES = (".arrow", ".feather")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _local_form(path: str) -> str:
    return path.removeprefix("file:") if path.startswith("file:/") else path


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, root = _filesystem(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"Path not found: {path}")
    if info.type == fs.FileType.File:
        return [root]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(
        f.path for f in found
        if f.type == fs.FileType.File
        and f.path.endswith(SUFFIXES)
        and not os.path.basename(f.path).startswith(("_", "."))
    )


@dataclass
class Batches(InputPartition):
    path: str
    share: int
    shares: int


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class ArrowFiles(DataSource):
    @classmethod
    def name(cls):
        return "arrow_ipc"

    def _path(self):
        return _local_form(self.options["path"])

    def schema(self):
        files = _files(self._path())
        if not files:
            raise FileNotFoundError(f"No Arrow files in {self._path()}")
        system, _ = _filesystem(self._path())
        with system.open_input_file(files[0]) as source, pa.ipc.open_file(source) as reader:
            return from_arrow_schema(reader.schema, prefer_timestamp_ntz=True)

    def reader(self, schema):
        return ArrowReader(self._path(), schema)

    def writer(self, schema, overwrite):
        return ArrowWriter(self._path(), schema, overwrite)


class ArrowReader(DataSourceReader):
    bytes_per_partition = 64 * 1024 * 1024

    def __init__(self, path, schema):
        self.path = path
        self.fields = {f.name: f.dataType for f in schema.fields}

    def partitions(self):
        """From the listing alone: each file in shares of about the same size."""
        system, _ = _filesystem(self.path)
        parts = []
        for info in system.get_file_info(_files(self.path)):
            shares = max(1, -(-info.size // self.bytes_per_partition))
            parts += [Batches(info.path, i, shares) for i in range(shares)]
        return parts

    def read(self, partition):
        system, _ = _filesystem(self.path)
        with system.open_input_file(partition.path) as source, pa.ipc.open_file(source) as reader:
            found = from_arrow_schema(reader.schema, prefer_timestamp_ntz=True)
            types = {f.name: f.dataType for f in found.fields}
            for name, kind in self.fields.items():
                if types.get(name) != kind:
                    raise ValueError(f"{partition.path} has {name} as {types.get(name)}, not {kind}")
            count = reader.num_record_batches
            for i in range(count * partition.share // partition.shares, count * (partition.share + 1) // partition.shares):
                yield reader.get_batch(i).select(list(self.fields))


class ArrowWriter(DataSourceArrowWriter):
    def __init__(self, path, schema, overwrite):
        self.path = path
        self.schema = schema
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        system, root = _filesystem(self.path)
        name = uuid.uuid4().hex
        temporary = f"{root}/_temporary-{self.job}/{name}.arrow"
        final = f"{root}/part-{name}.arrow"
        system.create_dir(os.path.dirname(temporary), recursive=True)
        writer = sink = None
        for batch in iterator:
            if writer is None:
                sink = system.open_output_stream(temporary)
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
        if writer is None:
            return Written("", "")
        writer.close()
        sink.close()
        return Written(temporary, final)

    def commit(self, messages):
        system, root = _filesystem(self.path)
        old = _files(self.path) if self.overwrite else []
        written = [m for m in messages if m is not None and m.final]
        for message in written:
            system.move(message.temporary, message.final)
        if not written:  # an empty table still has a schema
            system.create_dir(root, recursive=True)
            with system.open_output_stream(f"{root}/part-{self.job}.arrow") as sink:
                pa.ipc.new_file(sink, to_arrow_schema(self.schema)).close()
        for path in old:
            if "/_temporary-" not in path:
                system.delete_file(path)
        self._clean(system, root)

    def abort(self, messages):
        system, root = _filesystem(self.path)
        self._clean(system, root)

    def _clean(self, system, root):
        from pyarrow import fs

        folder = f"{root}/_temporary-{self.job}"
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArrowFiles)
    return spark.read.format("arrow_ipc").load(path)


def write_arrow(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.sparkSession.dataSource.register(ArrowFiles)
    df.write.format("arrow_ipc").mode(mode).save(path)
