"""Keyed streaming state: the counted series of samples, and the memory a process keeps.

Times are in microseconds inside the state, so no time zone of a worker matters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their keyed state in RocksDB, which spills to disk."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


# ---- the series of samples


class TickCounter(StatefulProcessor):
    """Counts the samples of one cluster, and ends the series.

    One value is kept per cluster: samples taken, the last one's instant, empty samples in a
    row, and whether the series has ended.
    """

    def __init__(self, streak: int | None, iterations: int | None):
        self.streak, self.iterations = streak, iterations

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.series = handle.getValueState("series", "taken long, last long, empty long, ended boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        taken, last, empty, ended = self.series.get() if self.series.exists() else (0, None, 0, False)
        sessions: dict[int, int] = {}
        beats: set[int] = set()
        for row in rows:
            sessions[row.at] = sessions.get(row.at, 0) + row.sessions
            if row.beats:
                beats.add(row.at)
        for at in sorted(beats):
            if ended:
                break
            if last is not None and at <= last:
                continue
            taken, last = taken + 1, at
            empty = 0 if sessions[at] else empty + 1
            stopped = self.streak is not None and empty >= self.streak
            ended = stopped or taken == self.iterations
            yield Row(cluster=key[0], at=at, i=taken, sessions=sessions[at], stopped=stopped, last=ended)
        self.series.update((taken, last, empty, ended))

    def close(self) -> None:
        pass


def _added_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of an Arrow batch as one row per cluster and instant, before they are shuffled."""
    for batch in batches:
        if batch.num_rows:
            sums = pa.Table.from_batches([batch]).group_by(["cluster", "at"]).aggregate([("sessions", "sum"), ("beats", "sum")])
            yield from sums.rename_columns(["cluster", "at", "sessions", "beats"]).combine_chunks().to_batches()


def count_ticks(
    samples: DataFrame, streak: int | None = None, iterations: int | None = None,
    beat: Column | None = None, session: Column | None = None,
) -> DataFrame:
    """The series of a stream of samples: ``dtcol, i, sessions, stopped, last`` per cluster.

    A sample is known by its heartbeat (``beat``: another condition) and counted once, in the
    order of instants; ``sessions`` is the number of its rows that hold a ``session`` (a pid). The
    series ends at the first run of ``streak`` samples without a session (``stopped``) or after
    ``iterations`` samples; ``last`` marks that sample, later ones are not counted.

    A sample has to arrive whole, in one file. One that arrives after a later sample has been
    counted is late: it gets no number and changes nothing.
    """
    beat = F.col("pid").isNull() & F.col("datid").isNull() if beat is None else beat
    session = F.col("pid").isNotNull() if session is None else session
    clustered = "cluster" in samples.columns
    rows = samples.select(
        (F.col("cluster").cast("string") if clustered else F.lit("")).alias("cluster"),
        F.unix_micros(F.col("dtcol").cast("timestamp")).alias("at"),
        F.coalesce(session, F.lit(False)).cast("long").alias("sessions"), F.coalesce(beat, F.lit(False)).cast("long").alias("beats"),
    ).filter("at IS NOT NULL")
    ticks = (
        rows.mapInArrow(_added_up, "cluster string, at long, sessions long, beats long")
        .groupBy("cluster")
        .transformWithState(
            TickCounter(streak, iterations), "cluster string, at long, i long, sessions long, stopped boolean, last boolean",
            "Update", "None",
        )
    )
    keys = ["cluster"] if clustered else []
    return ticks.select(*keys, F.timestamp_micros("at").alias("dtcol"), "i", "sessions", "stopped", "last")


# ---- the memory of a process


class MemoryCarrier(StatefulProcessor):
    """Keeps the first probe of each run of a process, until it is unseen for the horizon.

    One value is kept per process: where its run began, where it was seen last, and the probe.
    A timer at the horizon, in event time, drops it.
    """

    def __init__(self, horizon_micros: int, names: list[str]):
        self.horizon, self.names = horizon_micros, names
        self.place = tuple(names.index(name) for name in ("dtcol", "mem", "swapped"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "began long, seen long, mem long, swapped long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        at_column, mem_column, swapped_column = self.place
        run = self.run.get() if self.run.exists() else None
        before = run[1] if run else None
        for row in sorted(rows, key=lambda row: row[at_column]):
            at, probe = row[at_column], (row[mem_column], row[swapped_column])
            if key[-1] is None:  # heartbeats have no memory
                kept = probe
            elif run is None or at - run[1] >= self.horizon:
                run, kept = (at, at, *probe), probe
            elif at < run[0]:
                kept = probe  # late, before the run began
            else:
                run, kept = (run[0], max(at, run[1]), *run[2:]), tuple(run[2:])
            values = list(row)
            values[mem_column], values[swapped_column] = kept
            yield Row(**dict(zip(self.names, values)))
        if run is not None and run[1] != before:
            self.run.update(run)
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(self._due(run[1]))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.run.clear()
        return iter(())

    def _due(self, seen: int) -> int:
        return (seen + self.horizon) // 1000 + 1  # timers are in milliseconds

    def close(self) -> None:
        pass


def carry_memory_stream(samples: DataFrame, horizon_seconds: int, lateness: str = "1 day") -> DataFrame:
    """A stream of samples with ``mem`` and ``swapped`` replaced as ``carry_memory`` does.

    State is one row per (cluster, pid) seen within the horizon before the watermark; all
    columns pass through. In order, or late inside a run, the result is that of the batch
    operator. A row that arrives late and lies before the run its process is in now keeps
    its own probe; rows that were already given out stay as they are. Rows older than the
    watermark (``lateness``) are dropped by Spark, which counts them.
    """
    times = [field.name for field in samples.schema if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType))]
    names = samples.columns
    keys = [name for name in ("cluster", "pid") if name in names]
    watched = samples.withColumn("dtcol", F.col("dtcol").cast("timestamp")).withWatermark("dtcol", lateness)
    packed = watched.select(
        "*", *[F.unix_micros(F.col(name).cast("timestamp")).alias(f"{name} micros") for name in times]
    ).select(*[F.col(f"{name} micros").alias(name) if name in times else F.col(name) for name in names], F.col("dtcol").alias("event time"))
    kinds = [T.StructField(name, T.LongType() if name in times else samples.schema[name].dataType) for name in names]
    carrier = MemoryCarrier(horizon_seconds * 1_000_000, packed.columns)
    carried = packed.groupBy(*keys).transformWithState(
        carrier, T.StructType([*kinds, T.StructField("event time", T.TimestampType())]), "Update", "EventTime"
    )
    return carried.select(*[F.timestamp_micros(name).alias(name) if name in times else F.col(name) for name in names])
