"""The side tables of the collection loop, each at its own rhythm, and the end of a series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.operators.locks import blocking_prepared, blocking_sessions
from sessionscope.operators.series import inventory_rows
from sessionscope.schema import keys_of
from sessionscope.sources.history import append_samples, read_history
from sessionscope.streaming.collect import writer_of
from sessionscope.streaming.state import count_ticks, keyed_state

# Samples from one inventory row, and from one I/O snapshot, to the next.
INVENTORY_EVERY, IO_EVERY = 100, 10


@dataclass
class SideTable:
    """A history table that the loop fills.

    ``rows`` makes its rows from the instants that are due (``dtcol`` and, where there are
    several, ``cluster``). They are the first sample, the last of a planned series and each
    multiple of ``every``; ``every`` None means the two ends only. The sample that ends a series
    for being empty is due only in tables with ``at_stop``.
    """

    path: str
    rows: Callable[[DataFrame], DataFrame]
    every: int | None = 1
    at_stop: bool = False

    def due(self, ticks: DataFrame) -> DataFrame:
        wanted = (F.col("i") == 1) | (F.col("last") & ~F.col("stopped"))
        if self.every is not None:
            wanted = wanted | (F.col("i") % self.every == 0)
        if not self.at_stop:
            wanted = wanted & ~F.col("stopped")
        return ticks.filter(wanted).select(*keys_of(ticks, "dtcol"))


def at_instants(source: DataFrame, instants: DataFrame) -> DataFrame:
    """The rows of a snapshot table at the given instants; only their time span is scanned."""
    first, last = instants.agg(F.min("dtcol"), F.max("dtcol")).first()
    keys = keys_of(instants, "dtcol")
    return source.filter(F.col("dtcol").between(first, last)).join(instants, keys, "left_semi")


def snapshot_table(path: str, source: DataFrame, every: int | None = 1, at_stop: bool = False) -> SideTable:
    """Snapshots as they are: I/O statistics, database statistics, host counters, the samples themselves."""
    return SideTable(path, lambda instants: at_instants(source, instants), every, at_stop)


def io_table(path: str, io_stats: DataFrame) -> SideTable:
    return snapshot_table(path, io_stats, IO_EVERY)


def inventory_table(path: str, sizes: DataFrame, host: DataFrame, settings: DataFrame, comment: str | None = None) -> SideTable:
    """Inventory rows; the inputs are those of ``cluster_info``."""

    def rows(instants: DataFrame) -> DataFrame:
        return inventory_rows(at_instants(sizes, instants), at_instants(host, instants), settings, comment)

    return SideTable(path, rows, INVENTORY_EVERY)


def blocking_sessions_table(path: str, sessions: DataFrame, locks: DataFrame, own_pid: int | None = None) -> SideTable:
    """Sessions that hold a lock somebody waits for, at every sample."""
    return SideTable(
        path, lambda instants: blocking_sessions(at_instants(sessions, instants), at_instants(locks, instants), own_pid)
    )


def blocking_prepared_table(path: str, locks: DataFrame, prepared: DataFrame) -> SideTable:
    """Prepared transactions that hold a lock somebody waits for, at every sample."""

    def rows(instants: DataFrame) -> DataFrame:
        known = at_instants(prepared, instants) if "dtcol" in prepared.columns else prepared
        return blocking_prepared(at_instants(locks, instants), known)

    return SideTable(path, rows)


def stream_side_tables(
    samples: DataFrame, ticks_path: str, checkpoint: str, tables: list[SideTable], streak: int | None = None,
    iterations: int | None = None, writer: str | None = None, beat: Column | None = None, session: Column | None = None,
) -> None:
    """Count the samples that the stream holds now, and fill each side table where it is due.

    The counted series goes to the table ``ticks_path`` (``dtcol, i, sessions, stopped, last``;
    see ``count_ticks`` for its end and for late samples), so its row count is the number of
    samples taken. The counter is kept in the checkpoint's state, hence a restart goes on
    counting, and a repeated batch counts the same and replaces its own rows in every table.
    A snapshot has to be there when its sample's heartbeat arrives: samplers write the heartbeat last.
    """
    spark = samples.sparkSession
    own = writer or writer_of(checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        append_samples(batch, ticks_path, own, number)
        ticks = read_history(spark, ticks_path).filter((F.col("writer") == own) & (F.col("batch") == number))
        for table in tables:
            due = table.due(ticks)
            if not due.isEmpty():
                append_samples(table.rows(due), table.path, own, number)

    with keyed_state(spark):
        (
            count_ticks(samples, streak, iterations, beat, session)
            .writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
