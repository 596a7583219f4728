"""Flat files of samples as a Spark data source: ``spark.read.format("flat_samples")``.

Reads give Arrow batches and cut files at line ends; streams follow files that grow, by the
number of bytes taken of each; writes appear when the whole job has succeeded. Files are
reached through pyarrow, so paths are local or of a store that it knows (``s3://``,
``gs://``, ``hdfs://``). The format is that of ``flatfile``. Options: ``path``, ``split_bytes``
(64 MB), and ``zone``, in which instants are written (UTC).
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ESCAPES = (("\t", "t"), ("\n", "n"), ("\r", "r"))
NULL, MARK = "\\N", "\u0000"
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
ASIDE = "_writing"


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(FlatSamples)


@dataclass
class Span(InputPartition):
    """The lines of a file that begin in ``[start, stop)``."""

    file: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    file: str | None


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> dict[str, int]:
    """The flat files of a folder and their sizes; names that begin with ``_`` or ``.`` are no data."""
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return {
        info.path: info.size for info in found if info.type == fs.FileType.File and not info.base_name.startswith(("_", "."))
    }


def _whole_lines(store: fs.FileSystem, file: str, size: int) -> int:
    """Bytes up to the last line end: a line that is still being written is left for later."""
    with store.open_input_file(file) as source:
        at = size
        while at > 0:
            low = max(0, at - 65_536)
            source.seek(low)
            found = source.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return 0


def _spans(file: str, start: int, stop: int, most: int) -> list[Span]:
    return [Span(file, low, min(low + most, stop)) for low in range(start, stop, most)]


def _lines(store: fs.FileSystem, span: Span, last: int) -> Iterator[list[bytes]]:
    """The span's lines, some megabytes at a time."""
    with store.open_input_file(span.file) as source:
        at = span.start
        if at > 0:  # the line that begins before the span belongs to the one before
            source.seek(at - 1)
            held = source.read(1)
            while not held.endswith(b"\n"):
                more = source.read(min(65_536, last - at))
                if not more:
                    return
                cut = more.find(b"\n")
                at += len(more) if cut < 0 else cut + 1
                held = more if cut < 0 else b"\n"
        source.seek(at)
        rest = b""
        while at - len(rest) < span.stop:
            more = source.read(min(BATCH_BYTES, last - at))
            if not more:
                if rest:
                    yield [rest]
                return
            at += len(more)
            data = rest + more
            begin = at - len(data)
            whole = data.rfind(b"\n") + 1
            rest, data = data[whole:], data[:whole]
            limit = span.stop - begin
            if len(data) > limit:  # up to the end of the line that the span ends in
                cut = data.find(b"\n", max(limit - 1, 0)) + 1
                data, rest = data[:cut], b""
                at = begin + cut
                if data:
                    yield data[:-1].split(b"\n")
                return
            if data:
                yield data[:-1].split(b"\n")


def _batch(lines: list[bytes], schema: pa.Schema, zone: str) -> pa.RecordBatch:
    parts = pc.split_pattern(pa.array(lines, type=pa.binary()).cast(pa.string()), "\t")
    sizes = pc.list_value_length(parts)
    columns = []
    for at, field in enumerate(schema):
        there = pc.greater(sizes, at)
        if pc.all(there).as_py():
            text = pc.list_element(parts, at)
        else:  # a line with fewer values has nulls in the end
            text = pa.array([line[at] if len(line) > at else NULL for line in parts.to_pylist()], type=pa.string())
        value = pc.replace_substring(text, "\\\\", MARK)
        for character, letter in ESCAPES:
            value = pc.replace_substring(value, "\\" + letter, character)
        value = pc.if_else(pc.equal(text, NULL), pa.scalar(None, pa.string()), pc.replace_substring(value, MARK, "\\"))
        if pa.types.is_timestamp(field.type):
            plain = pc.cast(value, pa.timestamp("us"))
            columns.append(pc.assume_timezone(plain, zone).cast(field.type) if field.type.tz else plain.cast(field.type))
        else:
            columns.append(pc.cast(value, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


class _Options:
    def __init__(self, options: dict, schema: StructType):
        self.path, self.zone = options["path"], options.get("zone", "UTC")
        self.most, self.schema = int(options.get("split_bytes", SPLIT_BYTES)), schema

    def rows(self, span: Span | None, last: int) -> Iterator[pa.RecordBatch]:
        if span is None:  # a folder without files
            return
        store, _ = _store(self.path)
        schema = to_arrow_schema(self.schema)
        for lines in _lines(store, span, last):
            yield _batch(lines, schema, self.zone)


class FlatReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Span]:
        return [span for file, size in sorted(_files(self.options.path).items()) for span in _spans(file, 0, size, self.options.most)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.options.rows(partition, sys.maxsize)


class FlatStreamReader(DataSourceStreamReader):
    """Offsets are the bytes taken of every file, so files may grow and new ones appear."""

    def __init__(self, options: _Options):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        store, _ = _store(self.options.path)
        return {file: _whole_lines(store, file, size) for file, size in sorted(_files(self.options.path).items())}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [
            span for file, stop in sorted(end.items()) for span in _spans(file, start.get(file, 0), stop, self.options.most)
        ]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.options.rows(partition, sys.maxsize)

    def commit(self, end: dict) -> None:
        """Nothing to drop: the offsets are in the checkpoint, the files are their writers'."""


class FlatWriter(DataSourceArrowWriter):
    """Two phases: tasks write aside, the commit moves what the successful attempts wrote.

    An attempt that was lost, killed or run twice is not among these, and adds no line.
    """

    def __init__(self, options: _Options, overwrite: bool):
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex

    def _aside(self, root: str) -> str:
        return f"{root.rstrip('/')}/{ASIDE}/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, root = _store(self.options.path)
        folder = self._aside(root)
        store.create_dir(folder, recursive=True)
        context = TaskContext.get()
        file = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}.txt"
        some = False
        with store.open_output_stream(file) as out:
            for batch in iterator:
                columns = [_texts(column, self.options.zone) for column in batch.columns]
                if batch.num_rows and columns:
                    lines = pc.binary_join_element_wise(*columns, "\t")
                    out.write("\n".join(lines.to_pylist()).encode() + b"\n")
                    some = True
        return Written(file if some else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.options.path)
        root = root.rstrip("/")
        if self.overwrite:
            for file in _files(self.options.path):
                store.delete_file(file)
        for number, message in enumerate(message for message in messages if message and message.file):
            store.move(message.file, f"{root}/part-{self.job}-{number:05d}.txt")
        self._clean(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.options.path)
        self._clean(store, root)

    def _clean(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(self._aside(root)).type != fs.FileType.NotFound:
            store.delete_dir(self._aside(root))


def _texts(column: pa.Array, zone: str) -> pa.Array:
    """A column as the texts of a line, escaped, nulls written out."""
    if pa.types.is_timestamp(column.type):
        local = pc.local_timestamp(column.cast(pa.timestamp("us", zone))) if column.type.tz else column
        text = pc.strftime(local, format="%Y-%m-%d %H:%M:%S")
    elif pa.types.is_nested(column.type):
        text = pa.array([None if value is None else json.dumps(value) for value in column.to_pylist()], type=pa.string())
    else:
        text = column.cast(pa.string())
    text = pc.replace_substring(text, "\\", "\\\\")
    for character, letter in ESCAPES:
        text = pc.replace_substring(text, character, "\\" + letter)
    return pc.fill_null(text, NULL)


class FlatSamples(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flat_samples"

    def schema(self) -> str:
        raise ValueError("give the schema of the lines: spark.read.format('flat_samples').schema(...)")

    def reader(self, schema: StructType) -> FlatReader:
        return FlatReader(_Options(self.options, schema))

    def streamReader(self, schema: StructType) -> FlatStreamReader:  # noqa: N802
        return FlatStreamReader(_Options(self.options, schema))

    def writer(self, schema: StructType, overwrite: bool) -> FlatWriter:
        return FlatWriter(_Options(self.options, schema), overwrite)
