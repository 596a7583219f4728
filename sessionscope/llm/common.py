"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder

#: What separates words in every operator here (space, and tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of words as a long; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(array: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow string column, null as empty."""
    for value in array.cast(pa.large_binary()):
        yield value.as_py() or b""


def write_table(df: DataFrame, label: str) -> str:
    """Write ``df`` as Parquet to the shared folder; a retried task replaces its own part."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return path


def read_table(df: DataFrame, path: str) -> DataFrame:
    """The table that ``write_table(df, ...)`` wrote, by the schema of ``df``."""
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder."""
    return read_table(df, write_table(df, label))


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sliced(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most_bytes`` (one row at least)."""
    for batch in batches:
        array = batch.column(batch.schema.get_field_index(column))
        if batch.num_rows == 0:
            continue
        sizes = np.array([len(value) for value in text_bytes(array)], dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // max(most_bytes, 1)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for low, high in zip(starts, np.append(starts[1:], batch.num_rows)):
            yield batch.slice(low, high - low)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], least_rows: int = 50_000) -> Iterator[pa.Table]:
    """Cut a partition sorted by ``keys`` into tables of whole groups.

    Each table has many groups, or one group larger than ``least_rows``. What is held is
    one table and one Arrow batch, so callers bound the size of a group beforehand.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = group_starts(table, keys)
        last = int(starts[-1])
        if last:
            yield table.slice(0, last)
            table = table.slice(last)
        held, rows = table.to_batches(), table.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new key begins (key columns are integers without nulls)."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[:1] = True
    for key in keys:
        values = table.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


class Forest:
    """Connected components of the rows 0 .. n-1 of one block, without keeping its links."""

    def __init__(self, rows: int):
        self.root = np.arange(rows)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        """Join the components of ``left[i]`` and ``right[i]`` for every i."""
        while True:
            a, b = self.root[left], self.root[right]
            apart = a != b
            if not apart.any():
                return
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                jumped = self.root[self.root]
                if np.array_equal(jumped, self.root):
                    break
                self.root = jumped

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """One link from each row to the first row of its component."""
        rows = np.flatnonzero(self.root != np.arange(len(self.root)))
        return rows, self.root[rows]
