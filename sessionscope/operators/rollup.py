"""Hourly roll-ups of the samples that can be merged: sums, peaks and distinct-count sketches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.functions.scalars import round_half_even, size_pretty, utc_day
from sessionscope.operators.report import non_cpu_pct
from sessionscope.operators.filters import window_scan
from sessionscope.schema import is_process, keys_of
from sessionscope.sources.history import append_samples, partition_days, read_history

#: Sketches of 2 ** 12 registers: a relative standard error of 1.6 %, and 2.5 kB at most.
SKETCH_BITS = 12
HOUR = dt.timedelta(hours=1)
SUMS = ("detections", "detections_without_leader", "executions", "cpu", "cpu_rows")
PEAKS = ("peak_mem", "peak_swapped")


def hourly_rollup(samples: DataFrame, by: list[str]) -> DataFrame:
    """Per hour (``dtcol``) and group of session rows: sums, peaks over instants, sketch of executions.

    Rows are added up per (group, instant) first, in one shuffle that combines before it sends,
    so a group with most rows of an hour is spread over its instants.
    """
    keys = keys_of(samples, *[name for name in by if name != "cluster"])
    instants = samples.filter(is_process()).groupBy(*keys, "dtcol").agg(
        F.count("*").alias("detections"),
        F.count_if(F.col("leader_pid").isNull()).alias("detections_without_leader"),
        F.count("query_start").alias("executions"),
        F.sum("pourcentage_cpu").alias("cpu"),
        F.count("pourcentage_cpu").alias("cpu_rows"),
        F.sum("mem").alias("peak_mem"),
        F.sum("swapped").alias("peak_swapped"),
        F.hll_sketch_agg(F.unix_micros("query_start"), F.lit(SKETCH_BITS)).alias("sketch"),
    )
    hour = F.date_trunc("hour", "dtcol").alias("hour")
    return _merged(instants, [*keys, hour]).withColumnRenamed("hour", "dtcol")


def _merged(parts: DataFrame, by: list) -> DataFrame:
    return parts.groupBy(*by).agg(
        *[F.sum(name).alias(name) for name in SUMS],
        *[F.max(name).alias(name) for name in PEAKS],
        F.hll_union_agg("sketch").alias("sketch"),
    )


def update_rollup(spark: SparkSession, table: str, rollup: str, by: list[str], through: dt.date) -> list[dt.date]:
    """Roll up the closed days (up to ``through``) of a history table that are not rolled up yet; return them.

    The latest day present is made again, in case the run that wrote it was interrupted.
    """
    done = partition_days(spark, rollup)
    days = [day for day in partition_days(spark, table) if day <= through and day not in done[:-1]]
    if days:
        rows = read_history(spark, table, days[0], days[-1]).filter(F.col("day").isin(days))
        append_samples(hourly_rollup(rows.drop("day", "writer", "batch"), by), rollup, "rollup", 0)
    return days


def window_rollup(spark: SparkSession, table: str, rollup: str, by: list[str], start: dt.datetime, end: dt.datetime) -> DataFrame:
    """The merged measures of a window (UTC, both ends included), one row per group.

    Whole hours of days that are rolled up come from the roll-up; the rest, such as the parts of
    hours at both ends, from the samples.
    """
    days = partition_days(spark, rollup)
    first = start.replace(minute=0, second=0, microsecond=0)
    first = first if first == start else first + HOUR
    last = (end + dt.timedelta(microseconds=1)).replace(minute=0, second=0, microsecond=0)
    keys = [name for name in by if name != "cluster"]
    stored = read_history(spark, rollup, first.date(), last.date()) if days else None
    samples = window_scan(read_history(spark, table, start.date(), end.date()), *_bounds(start, end))
    if stored is None:
        return _merged(hourly_rollup(samples, by), keys_of(samples, *keys))
    whole = stored.filter((F.col("dtcol") >= _literal(first)) & (F.col("dtcol") < _literal(last)))
    covered = utc_day("dtcol").isin(days) & (F.col("dtcol") >= _literal(first)) & (F.col("dtcol") < _literal(last))
    edges = hourly_rollup(samples.filter(~covered), by)
    grouped = keys_of(samples, *keys)
    names = [*grouped, *SUMS, *PEAKS, "sketch"]
    return _merged(whole.select(*names).unionByName(edges.select(*names)), grouped)


def _literal(instant: dt.datetime):
    return F.lit(instant.replace(tzinfo=dt.timezone.utc))


def _bounds(start: dt.datetime, end: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    return start.replace(tzinfo=dt.timezone.utc), end.replace(tzinfo=dt.timezone.utc)


def busy_rollup(merged: DataFrame, by: list[str], iterations: int) -> DataFrame:
    """The busy ranking of merged measures; distinct executions are the sketch's estimate."""
    return merged.select(
        *by,
        round_half_even(F.col("detections").cast("double") / iterations * 100).alias("busy_pc"),
        "executions",
        F.hll_sketch_estimate("sketch").alias("distinct_estimate"),
        non_cpu_pct(F.try_divide("cpu", "cpu_rows")).alias("non_cpu_pc"),
        size_pretty(F.col("peak_mem")).alias("mem"),
        size_pretty(F.col("peak_swapped")).alias("swap"),
    ).orderBy(F.desc("busy_pc"), *by)
