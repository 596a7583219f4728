"""The sampling series itself: numbering instants, thinning, early stop, inventory."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionscope.functions.scalars import memory_setting, size_pretty
from sessionscope.schema import CLUSTER_INFORMATION, is_heartbeat, keys_of


def number_instants(samples: DataFrame) -> DataFrame:
    """(dtcol, i, last): the 1-based position of every sample instant, and the last position."""
    return _number(samples.select(*keys_of(samples, "dtcol")).distinct())


def _number(instants: DataFrame) -> DataFrame:
    """Add ``i`` and ``last`` to rows with distinct ``dtcol``.

    Rows are numbered inside each hour, in parallel; only the counts per hour, one row
    per hour of history, are added up in order.
    """
    cluster, hour = keys_of(instants), keys_of(instants, "hour")
    instants = instants.withColumn("hour", F.date_trunc("hour", "dtcol"))
    hours = instants.groupBy(*hour).agg(F.count("*").alias("instants"))
    line = Window.partitionBy(*cluster).orderBy("hour")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    everything = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = hours.select(
        *hour,
        F.coalesce(F.sum("instants").over(before), F.lit(0)).alias("before"),
        F.sum("instants").over(everything).alias("last"),
    )
    inside = F.row_number().over(Window.partitionBy(*hour).orderBy("dtcol"))
    return (
        instants.withColumn("i", inside)
        .join(offsets, hour)
        .withColumn("i", F.col("before") + F.col("i"))
        .drop("hour", "before")
    )


def thin_instants(samples: DataFrame, every: int | None) -> DataFrame:
    """The instants kept: first, last and each multiple of ``every`` (None: the two ends)."""
    keep = (F.col("i") == 1) | (F.col("i") == F.col("last"))
    if every is not None:
        keep = keep | (F.col("i") % every == 0)
    return number_instants(samples).filter(keep)


def thin_snapshots(samples: DataFrame, every: int | None) -> DataFrame:
    keys = keys_of(samples, "dtcol")
    return samples.join(thin_instants(samples, every).select(keys), keys, "left_semi")


def planned_instants(spark: SparkSession, start: dt.datetime, count: int, interval_seconds: int) -> DataFrame:
    """(dtcol, i): the planned series with positions from 1, generated in parallel."""
    first = int(start.replace(tzinfo=dt.timezone.utc).timestamp())
    at = F.timestamp_seconds(F.lit(first) + F.col("id") * interval_seconds)
    return spark.range(count).select(at.alias("dtcol"), (F.col("id") + 1).alias("i"))


def heartbeat_instants(samples: DataFrame) -> DataFrame:
    """(dtcol, i): the samples taken, by their heartbeats, with positions from 1 in each cluster.

    Real instants jitter, so a sample is known by its heartbeat, not by its place on a grid.
    """
    return number_instants(samples.filter(is_heartbeat())).select(*keys_of(samples, "dtcol"), "i")


def _planned(samples: DataFrame, planned: DataFrame | None) -> DataFrame:
    """The series of every cluster: its heartbeats, or the planned one, which is the same for all."""
    if planned is None:
        return heartbeat_instants(samples)
    missing = [name for name in keys_of(samples) if name not in planned.columns]
    return planned.crossJoin(samples.select(*missing).distinct()) if missing else planned


def stop_instant(samples: DataFrame, planned: DataFrame | None, streak: int) -> DataFrame:
    """``end_at``: where the first run of ``streak`` empty samples ends.

    One row, null if never; where the samples are of several clusters, one row for each that
    stops. An empty sample has no session row. Positions of empty samples minus their order
    number are constant within a run, so runs are plain groups. ``planned`` is
    (dtcol, i) as :func:`planned_instants` makes it; without it the heartbeats count.
    """
    cluster, instant = keys_of(samples), keys_of(samples, "dtcol")
    planned = _planned(samples, planned)
    present = samples.filter("pid is not null").select(*instant).distinct()
    empty = planned.withColumnRenamed("i", "position").join(present, instant, "left_anti")
    runs = (
        _number(empty)
        .groupBy(*cluster, (F.col("position") - F.col("i")).alias("run"))
        .agg(F.min("position").alias("first"), F.count("*").alias("length"))
    )
    stop = runs.filter(F.col("length") >= streak).groupBy(*cluster).agg((F.min("first") + streak - 1).alias("position"))
    if cluster:
        return planned.join(stop, cluster).filter("i = position").groupBy(*cluster).agg(F.max("dtcol").alias("end_at"))
    return planned.filter(F.col("i") == stop.scalar()).agg(F.max("dtcol").alias("end_at"))


def _until(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """The rows up to the end of their cluster's series."""
    cluster = keys_of(rows)
    if cluster:
        return rows.join(ends, cluster, "left").filter("end_at is null or dtcol <= end_at").drop("end_at").select(*rows.columns)
    end = ends.scalar()
    return rows.filter(end.isNull() | (F.col("dtcol") <= end))


def stop_after_empty(samples: DataFrame, planned: DataFrame | None, streak: int) -> DataFrame:
    """The samples taken when collection stops after ``streak`` empty samples in a row, per cluster."""
    return _until(samples, stop_instant(samples, planned, streak))


def planned_iterations(duration: int, interval: int, batch: bool) -> int:
    """Number of samples: days over seconds in batch, seconds over hundredths otherwise."""
    if duration == 0:
        return 1
    if batch:
        return 86400 * duration // interval
    return 1000 * duration if interval == 0 else 100 * duration // interval


def effective_iterations(samples: DataFrame, planned: DataFrame | None, streak: int | None = None) -> DataFrame:
    """One row, or one per cluster: the planned number of samples, or that taken if collection stopped early."""
    planned = _planned(samples, planned)
    if streak is not None:
        planned = stop_after_empty_instants(samples, planned, streak)
    return planned.groupBy(*keys_of(samples)).agg(F.count("*").alias("iterations"))


def stop_after_empty_instants(samples: DataFrame, planned: DataFrame, streak: int) -> DataFrame:
    return _until(planned, stop_instant(samples, planned, streak))


def database_list(sizes: DataFrame) -> DataFrame:
    """Per instant: total size of the non-template databases, and their list as text."""
    shown = F.concat("datname", F.lit(" ("), size_pretty(F.col("size_bytes")), F.lit(")"))
    return (
        sizes.filter("not is_template")
        .groupBy(*keys_of(sizes, "dtcol"))
        .agg(
            F.sum("size_bytes").alias("cluster_size"),
            F.array_join(F.sort_array(F.collect_list(shown)), " - ").alias("cluster_databases"),
        )
        .withColumn("cluster_pretty_size", size_pretty(F.col("cluster_size")))
    )


def _settings(settings: DataFrame) -> DataFrame:
    """The settings of the inventory as one row, or one per instant where they are dated."""
    buffers = size_pretty(memory_setting(F.col("unit"), F.col("setting")))
    shown = {
        "cluster_port": ("port", F.col("setting")),
        "cluster_archive_mode": ("archive_mode", F.upper("setting")),
        "cluster_shared_buffers": ("shared_buffers", buffers),
    }
    when = [name for name in keys_of(settings, "dtcol") if name in settings.columns]
    return settings.filter(F.col("name").isin([name for name, _ in shown.values()])).groupBy(*when).agg(
        *[F.max(F.when(F.col("name") == name, value)).alias(column) for column, (name, value) in shown.items()]
    )


def cluster_info(
    sizes: DataFrame, host: DataFrame, settings: DataFrame, every: int = 100, comment: str | None = None
) -> DataFrame:
    """Inventory row per thinned instant, with the columns of ``CLUSTER_INFORMATION``.

    ``sizes`` (dtcol, datname, size_bytes, is_template), ``host`` (dtcol,
    cluster_hostname, cluster_os_family, cluster_postgres_version, cluster_processes),
    ``settings`` (name, setting, unit), with ``dtcol`` where they may change. With a
    ``cluster`` column in ``sizes`` and ``host``, every cluster is thinned by its own series.
    """
    return inventory_rows(thin_snapshots(sizes, every), host, settings, comment)


def inventory_rows(sizes: DataFrame, host: DataFrame, settings: DataFrame, comment: str | None = None) -> DataFrame:
    """An inventory row for every instant of ``sizes``; inputs as in :func:`cluster_info`."""
    values = _settings(settings)
    rows = database_list(sizes).join(host, keys_of(sizes, "dtcol"), "left")
    shared = [name for name in keys_of(sizes, "dtcol") if name in values.columns]
    if shared:
        rows = rows.join(values, shared, "left")
    else:
        only = values.select(F.struct("*").alias("only")).scalar()
        rows = rows.withColumns({name: only[name] for name in values.columns})
    return (
        rows.withColumn("cluster_comment", F.lit(comment).cast("string"))
        .select(*keys_of(sizes), *[F.col(field.name).cast(field.dataType) for field in CLUSTER_INFORMATION])
    )
