"""The collection loop as a stream: raw samples in, enriched history out."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.scalars import instant_from_micros, utc_day
from sessionscope.operators.enrich import carry_memory, memory_horizon
from sessionscope.operators.filters import active_sessions, host_rows, not_idle, pid_filter
from sessionscope.plans.collect import collect
from sessionscope.schema import keys_of
from sessionscope.session import cut_lineage, release
from sessionscope.sources.history import (
    delete_folder,
    append_samples,
    forget_done,
    is_done,
    partition_days,
    read_history,
    replace_rows,
    table_exists,
)
from sessionscope.streaming.state import carry_memory_stream, keyed_state

DAY = 86_400_000_000


def writer_of(checkpoint: str) -> str:
    """A stream's own name in the tables it writes: its checkpoint is its identity."""
    return f"stream-{hashlib.md5(checkpoint.encode()).hexdigest()[:16]}"


def _date(micros: int) -> dt.date:
    return dt.date.fromordinal(719_163 + micros // DAY)


def write_batch(
    batch: DataFrame,
    table: str,
    writer: str,
    number: int,
    interval_seconds: int,
    locks: DataFrame | None = None,
    depth: int = 2,
    **options,
) -> None:
    """Enrich one micro-batch as :func:`collect` does and put it into the history.

    Memory goes on from the rows this writer stored inside the horizon before the batch, so
    only their day folders are read, and only the locks of the batch's time span. The probed
    values are stored next to the carried ones (``probe_mem``, ``probe_swapped``). Samples
    that arrive late, before rows already stored, may change the memory of those rows: the
    days from there on are then rewritten for this writer, from the stored probes, with the
    same result as if the samples had come in order.
    """
    spark = batch.sparkSession
    name = f"{writer}-{number}"
    if table_exists(spark, table) and is_done(spark, table, name):
        return  # an attempt before this one got through
    forget_done(spark, table, writer, number)
    low, high = batch.agg(F.unix_micros(F.min("dtcol")), F.unix_micros(F.max("dtcol"))).first()
    if low is None:
        return
    keys = keys_of(batch, "dtcol", "pid")
    probes = batch.filter("pid is not null").select(*keys, "mem", "swapped")
    cpu = batch.select(
        *keys[:-1], F.coalesce("pid", F.lit(0).cast("bigint")).alias("pid"), F.col("pourcentage_cpu").alias("cpu")
    )
    start, earliest = instant_from_micros(low), low - memory_horizon(interval_seconds) * 1_000_000
    earlier = later = None
    if table_exists(spark, table):
        stored = read_history(spark, table, first=_date(earliest)).filter(
            (F.col("writer") == writer) & (F.col("batch") != number)
        )
        if "probe_mem" in stored.columns:
            known = stored.filter((F.col("dtcol") > instant_from_micros(earliest)) & F.col("pid").isNotNull())
            earlier = known.filter(F.col("dtcol") < start).select(*keys, "mem", "swapped")
            later = stored.filter(F.col("dtcol") >= start)
            if later.isEmpty():
                later = None
    held = locks
    if locks is not None:
        held = locks.filter(F.col("dtcol").between(start, instant_from_micros(high)))
    if later is not None:
        after = later.filter("pid is not null")
        earlier = earlier.unionByName(
            after.select(*keys, F.col("probe_mem").alias("mem"), F.col("probe_swapped").alias("swapped"))
        )
    folder = f"{table}/_locks/{name}"
    delete_folder(spark, folder)
    rows = collect(batch, held, cpu, probes, interval_seconds, depth, earlier=earlier, folder=folder, **options)
    probed = probes.select(*keys, F.col("mem").alias("probe_mem"), F.col("swapped").alias("probe_swapped"))
    rows = rows.join(probed, keys, "left")
    if later is None:
        append_samples(rows, table, writer, number)
        delete_folder(spark, folder)
        return
    # they are read several times below, and collecting is a large plan
    rows = cut_lineage(rows, folder, "collected")
    # the sessions that were collected: late ones from the batch, the others from the table
    sessions = rows.filter("pid is not null").select(*keys, F.col("probe_mem").alias("mem"), F.col("probe_swapped").alias("swapped"))
    memory = carry_memory(sessions.unionByName(earlier), interval_seconds)
    changed = later.drop("mem", "swapped").join(memory, keys, "left").select(*later.columns)
    first = _date(low)
    placed = rows.withColumns({"day": utc_day("dtcol"), "writer": F.lit(writer)})
    whole = (
        placed.unionByName(changed, allowMissingColumns=True)
        .unionByName(stored.filter((F.col("day") >= F.lit(first)) & (F.col("dtcol") < start)), allowMissingColumns=True)
        .withColumn("batch", F.lit(number).cast("bigint"))
    )
    folders = [f"day={day.isoformat()}/writer={writer}" for day in partition_days(spark, table) if day >= first]
    replace_rows(spark, table, whole, folders, name)
    delete_folder(spark, folder)


def stream_collect(
    samples: DataFrame,
    table: str,
    checkpoint: str,
    interval_seconds: int,
    locks: DataFrame | None = None,
    depth: int = 2,
    writer: str | None = None,
    **options,
) -> None:
    """Take what the stream holds now into the history table.

    ``locks`` is the table of lock snapshots, if blockers are wanted; ``options`` are those of
    :func:`collect`. Rows go to the stream's own folders, named after its checkpoint unless
    ``writer`` says otherwise, batch by batch: after a failure the stream repeats the batch,
    which replaces them, and other writers' rows are never touched.
    """
    own = writer or writer_of(checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, table, own, number, interval_seconds, locks, depth, **options)
        release(batch.sparkSession)

    (
        samples.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def stream_collect_state(
    samples: DataFrame,
    table: str,
    checkpoint: str,
    interval_seconds: int,
    locks: DataFrame | None = None,
    depth: int = 2,
    writer: str | None = None,
    lateness: str = "1 day",
    pids=None,
    own_pid: int | None = None,
    **options,
) -> None:
    """:func:`stream_collect` with the memory of every process in keyed state.

    The history is only appended to: no stored row is read or rewritten, whatever arrives. In
    order the result is the same. Late samples follow the rule of ``carry_memory_stream``, where
    ``stream_collect`` corrects the rows behind them.
    """
    spark = samples.sparkSession
    own = writer or writer_of(checkpoint)
    chosen = active_sessions(samples, own_pid)
    chosen = not_idle(chosen) if pids is None else pid_filter(chosen, pids)
    wanted = chosen.unionByName(host_rows(samples))

    def write(batch: DataFrame, number: int) -> None:
        incoming, folder = f"{table}/_incoming/{own}-{number}", f"{table}/_locks/{own}-{number}"
        batch.write.mode("overwrite").parquet(incoming)  # the state is advanced once
        rows = spark.read.schema(batch.schema).parquet(incoming)
        low, high = rows.agg(F.min("dtcol"), F.max("dtcol")).first()
        if low is not None:
            keys = keys_of(rows, "dtcol", "pid")
            cpu = rows.select(
                *keys[:-1], F.coalesce("pid", F.lit(0).cast("bigint")).alias("pid"), F.col("pourcentage_cpu").alias("cpu")
            )
            probes = rows.filter("pid is not null").select(*keys, "mem", "swapped")
            held = None if locks is None else locks.filter(F.col("dtcol").between(low, high))
            delete_folder(spark, folder)
            collected = collect(
                rows, held, cpu, probes, interval_seconds, depth, pids=pids, own_pid=own_pid, folder=folder, carry=False, **options
            )
            append_samples(collected, table, own, number)
            delete_folder(spark, folder)
        delete_folder(spark, incoming)

    with keyed_state(spark):
        (
            carry_memory_stream(wanted, memory_horizon(interval_seconds), lateness)
            .writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
