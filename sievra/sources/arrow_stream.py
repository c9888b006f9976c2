"""Data source for folders of Arrow IPC stream files: ``spark.read.format("arrow_stream").load(dir)`` and
``df.write.format("arrow_stream").save(dir)``, with a path or a URI of a file system that pyarrow knows."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

FORMAT_NAME = "arrow_stream"
SUFFIX = ".arrow"
SPLIT_BYTES = 128 << 20


class _Split(InputPartition):
    """Batches of one file that start within a range of bytes."""

    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


def local_path(path: str) -> str:
    """A ``file:`` URI as a plain path; anything else as it is."""
    return re.sub(r"^file:(//)?(?=/)", "", path)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def _open(path: str):
    fs, inner = _filesystem(path)
    # A mapped file hands out its batches without reading those that are skipped.
    return pa.memory_map(inner, "rb") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(inner)


class ArrowStreamReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], schema: StructType, options):
        self.files, self.schema = files, schema
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.skip_corrupt = str(options.get("ignoreCorruptFiles", "false")).lower() == "true"

    def partitions(self):
        # One split per file, more for a long local file. A remote stream has to be read from its
        # start to find the later batches, so there a file stays whole.
        splits = []
        for path, size in self.files:
            if "://" in path or size <= self.split_bytes:
                splits.append(_Split(path, 0, None))
            else:
                cuts = range(0, size, self.split_bytes)
                splits += [_Split(path, at, at + self.split_bytes) for at in cuts]
        return splits

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        names = self.schema.fieldNames()
        with _open(split.path) as source:
            try:
                stream = pa.ipc.open_stream(source)
            except (pa.ArrowInvalid, OSError) as unreadable:
                # A file that opens but whose header cannot be parsed; what the file system reports is no such defect.
                if self.skip_corrupt and not getattr(unreadable, "errno", None):
                    return
                raise
            with stream:
                while split.end is None or source.tell() < split.end:
                    begin = source.tell()
                    try:
                        batch = stream.read_next_batch()
                    except StopIteration:
                        return
                    except pa.ArrowInvalid:
                        if self.skip_corrupt:
                            return
                        raise
                    if begin >= split.start:
                        yield batch.select(names)


@dataclass
class _Written(WriterCommitMessage):
    """The file of a task that ended well, or None if it had no rows."""

    name: str | None


class ArrowStreamWriter(DataSourceArrowWriter):
    """One file per task, under a hidden folder of the job until all tasks have ended.

    The driver then moves the files of the attempts that Spark counts, so what a failed or repeated attempt left behind
    never gets into the folder; with ``overwrite``, files that were there before go after that. A table without rows leaves one file, its schema.
    """

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = local_path(path), schema, overwrite
        self.job = f"_writing-{uuid.uuid4().hex}"
        fs, folder = self._folder()
        # Made here and by no task, so a task that still runs after an abort cannot bring it back.
        fs.create_dir(f"{folder}/{self.job}", recursive=True)

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        return _filesystem(self.path)

    def _write(self, batches: Iterator[pa.RecordBatch]) -> str | None:
        first = next(batches, None)
        if first is None:
            return None
        fs, folder = self._folder()
        name = f"part-{uuid.uuid4().hex}{SUFFIX}"
        with fs.open_output_stream(f"{folder}/{self.job}/{name}") as sink, pa.ipc.new_stream(sink, first.schema) as stream:
            stream.write_batch(first)
            for batch in batches:
                stream.write_batch(batch)
        return name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        return _Written(self._write(iterator))

    def commit(self, messages: list[_Written | None]) -> None:
        names = [m.name for m in messages if m is not None and m.name is not None]
        if not names:
            empty = to_arrow_schema(self.schema).empty_table().to_batches() or [
                pa.RecordBatch.from_pylist([], to_arrow_schema(self.schema))
            ]
            names = [self._write(iter(empty))]
        fs, folder = self._folder()
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.is_file and f.path.endswith(SUFFIX)]
        for name in names:
            fs.move(f"{folder}/{self.job}/{name}", f"{folder}/{name}")
        for path in old if self.overwrite else []:
            fs.delete_file(path)
        fs.delete_dir(f"{folder}/{self.job}")

    def abort(self, messages: list[_Written | None]) -> None:
        fs, folder = self._folder()
        if fs.get_file_info(f"{folder}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{folder}/{self.job}")


class ArrowStreamSource(DataSource):
    """Every file of a folder whose name ends in ``.arrow``, batch by batch.

    Options: ``splitBytes`` cuts longer files in several partitions; ``ignoreCorruptFiles`` goes on
    past unreadable files, keeping the batches read before the defect.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT_NAME

    def _files(self) -> list[tuple[str, int]]:
        folder = local_path(self.options["path"])
        fs, inner = _filesystem(folder)
        scheme = folder.split("://")[0] + "://" if "://" in folder else ""
        found = fs.get_file_info(pafs.FileSelector(inner, recursive=False))
        files = [(scheme + f.path, f.size) for f in found if f.is_file and f.path.endswith(SUFFIX)]
        if not files:
            raise FileNotFoundError(f"no {SUFFIX} file in {folder}")
        return sorted(files)

    def schema(self) -> StructType:
        """Schema of the first readable file."""
        error: Exception | None = None
        for path, _ in self._files():
            try:
                with _open(path) as source, pa.ipc.open_stream(source) as stream:
                    return from_arrow_schema(stream.schema)
            except (pa.ArrowInvalid, OSError) as unreadable:
                error = error or unreadable
        raise error

    def reader(self, schema: StructType) -> ArrowStreamReader:
        return ArrowStreamReader(self._files(), schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArrowStreamWriter:
        return ArrowStreamWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(ArrowStreamSource)
