"""The ``fixed_records`` source and sink: fixed-length records, end to end.

This module stands alone, so that it can be sent to workers as it is.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

SPLIT_BYTES = 128 << 20
BATCH_BYTES = 4 << 20


def filesystem(path: str):
    from pyarrow import fs

    if path.startswith(("s3a://", "s3n://")):
        path = "s3" + path[3:]
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:"):]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def _hidden(path: str, root: str) -> bool:
    """Unfinished writes and markers lie under names that start with _ or a dot."""
    return any(part.startswith(("_", ".")) for part in path[len(root):].strip("/").split("/"))


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    records: int


class _Records:
    """What batch and stream share: the files, their record-aligned ranges, and how a range is read."""

    def __init__(self, options):
        self.path = options["path"]
        self.length = int(options["recordlength"])
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.positions = options.get("positions", "false").lower() == "true"

    def ends(self) -> dict[str, int]:
        """Each file, and where its last whole record ends; a short tail is end of file."""
        from pyarrow import fs

        store, root = filesystem(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            return {}
        files = [info] if info.type == fs.FileType.File else [
            f for f in store.get_file_info(fs.FileSelector(root, recursive=True))
            if f.type == fs.FileType.File and not _hidden(f.path, root)]
        return {f.path: f.size // self.length * self.length for f in files}

    def ranges(self, path: str, start: int, end: int) -> list[_Range]:
        step = max(1, self.split // self.length) * self.length
        return [_Range(path, at, (min(at + step, end) - at) // self.length) for at in range(start, end, step)]

    def read(self, part):
        import pyarrow as pa

        if not part.records:
            return
        store, _ = filesystem(self.path)
        per = max(1, BATCH_BYTES // self.length)
        with store.open_input_file(part.path) as f:
            f.seek(part.start)
            left, at = part.records, part.start
            while left:
                n = min(per, left)
                data = pa.py_buffer(f.read(n * self.length))
                values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(self.length), n, [None, data]).cast(pa.binary())
                columns, names = [values], ["value"]
                if self.positions:
                    columns += [pa.array([part.path] * n, pa.string()),
                                pa.array(np.arange(at, at + n * self.length, self.length), pa.int64())]
                    names += ["file", "offset"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                left -= n
                at += n * self.length


class _FixedReader(_Records, DataSourceReader):
    def partitions(self):
        return [r for path, end in self.ends().items() for r in self.ranges(path, 0, end)] or [_Range("", 0, 0)]


class _FixedStream(_Records, DataSourceStreamReader):
    """Records as they arrive. Progress is how far each file has been read, so new files and files
    that have grown are read on from there, and a restarted stream reads each record once."""

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return self.ends()

    def partitions(self, start, end):
        return [r for path, at in end.items() for r in self.ranges(path, start.get(path, 0), at)] or [_Range("", 0, 0)]

    def commit(self, end):
        pass


@dataclass
class _Written(WriterCommitMessage):
    temp: str
    final: str


class _FixedWriter(DataSourceArrowWriter):
    """One file per task; files appear under their names only at commit."""

    def __init__(self, options, overwrite: bool):
        self.path = options["path"]
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def write(self, batches):
        from pyspark import TaskContext

        store, root = filesystem(self.path)
        part = TaskContext.get().partitionId()
        temp = f"{root}/_temporary/{self.job}/{part}-{uuid.uuid4().hex}"
        store.create_dir(f"{root}/_temporary/{self.job}", recursive=True)
        with store.open_output_stream(temp) as out:
            for batch in batches:
                column = batch.column(0)
                # records lie end to end in the batch's data buffer
                _, offsets, data = column.buffers()
                width = "int64" if str(column.type).startswith("large") else "int32"
                at = np.frombuffer(offsets, dtype=width)
                first, last = int(at[column.offset]), int(at[column.offset + len(column)])
                if last > first:
                    out.write(data.slice(first, last - first))
        return _Written(temp, f"{root}/part-{part:06d}-{self.job}.bin")

    def commit(self, messages):
        from pyarrow import fs

        store, root = filesystem(self.path)
        old = []
        if self.overwrite:
            old = [f.path for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True))
                   if f.type == fs.FileType.File and f.base_name.endswith(".bin")]
        for m in messages:
            if m is not None:
                store.move(m.temp, m.final)
        for path in old:
            store.delete_file(path)
        if store.get_file_info(f"{root}/_temporary/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary/{self.job}")

    def abort(self, messages):
        from pyarrow import fs

        store, root = filesystem(self.path)
        if store.get_file_info(f"{root}/_temporary/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary/{self.job}")


class FixedRecords(DataSource):
    """``format("fixed_records")``: options ``recordLength`` and the path.

    Files are read in record-aligned ranges, so one big file is read by many
    tasks; bytes go to the JVM as Arrow batches. With ``positions`` each record
    comes with its file and byte offset. ``readStream`` goes on with what arrives.
    """

    @classmethod
    def name(cls):
        return "fixed_records"

    def schema(self):
        if self._options().get("positions", "false").lower() == "true":
            return "value binary, file string, offset bigint"
        return "value binary"

    def _options(self):
        return {k.lower(): v for k, v in dict(self.options).items()}

    def reader(self, schema):
        return _FixedReader(self._options())

    def streamReader(self, schema):
        return _FixedStream(self._options())

    def writer(self, schema, overwrite):
        return _FixedWriter(self._options(), overwrite)
