"""The whole report over one window, as named DataFrames."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.operators import counters, report
from sessionscope.operators.filters import DEFAULT_REPORT_FILTER, window_scan

REPORT_SPAN = dt.timedelta(minutes=15)


def build_report(
    samples: DataFrame,
    cluster_information: DataFrame,
    host_counters: DataFrame,
    io_stats: DataFrame,
    start=None,
    end=None,
    n: int = 5,
    predicate: str | Column = DEFAULT_REPORT_FILTER,
) -> dict[str, DataFrame]:
    """Every section, each reading only its own columns of the window: without bounds, the last 15 minutes.

    What needs one pass is one section: ``activity`` is bounds, DB time and host CPU,
    ``host_counters`` CPU time, memory and swap.
    ``samples`` is the enriched history. Where it is a costly derivation instead of a
    stored table, persist it first; nothing is cached here.
    """
    end = end or dt.datetime.now(dt.timezone.utc)
    start = start or (end if isinstance(end, dt.datetime) else dt.datetime.fromisoformat(end)) - REPORT_SPAN
    samples, cluster_information, host_counters, io_stats = (
        window_scan(table, start, end) for table in (samples, cluster_information, host_counters, io_stats)
    )
    return {
        "host": report.report_host(cluster_information),
        "activity": report.activity(samples, predicate),
        "host_counters": counters.host_summary(host_counters, cluster_information),
        "io_latency": counters.io_latency(io_stats),
        "top_events": report.top_events(samples, n, predicate),
        "top_queries": report.top_queries(samples, n, predicate),
    }


def build_interactive_report(
    samples: DataFrame,
    cluster_information: DataFrame,
    host_counters: DataFrame,
    io_stats: DataFrame,
    choices: list,
    iterations: int,
) -> dict[str, DataFrame]:
    """The rankings by each choice of columns, then the host and I/O sections, over one collection."""
    return {
        "rankings": report.busy_ranked(samples, choices, iterations),
        "host_cpu": report.host_cpu_avg(samples),
        "host_counters": counters.host_summary(host_counters, cluster_information),
        "io_latency": counters.io_latency(io_stats),
    }


def report_lines(sections: dict[str, DataFrame]) -> DataFrame:
    """All sections as text: (section, line), a line being ``name=value`` pairs."""
    parts = []
    for section, frame in sections.items():
        pairs = []
        for name, kind in frame.dtypes:
            value = F.col(name).cast("decimal(38,2)") if kind == "double" else F.col(name)
            pairs.append(F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit(""))))
        parts.append(frame.select(F.lit(section).alias("section"), F.concat_ws("; ", *pairs).alias("line")))
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines
