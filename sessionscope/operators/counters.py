"""Differences of cumulative counters between the two ends of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.functions.scalars import parse_counters, round_half_away, round_half_even, size_pretty
from sessionscope.operators.filters import same_reset
from sessionscope.schema import keys_of

MEGABYTE = 1024 * 1024

# I/O operations as (result name, counter, cumulated time).
IO_OPERATIONS = (
    ("read", "reads", "read_time"),
    ("write", "writes", "write_time"),
    ("writeback", "writebacks", "writeback_time"),
    ("extend", "extends", "extend_time"),
    ("fsync", "fsyncs", "fsync_time"),
)


def counter_delta(column: str) -> Column:
    """Value at the last instant minus value at the first, as one aggregate."""
    return F.max_by(column, "dtcol") - F.min_by(column, "dtcol")


def endpoint_join(counters: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """First and last value of each counter in the window, per group, in one pass."""
    ends = [F.min("dtcol").alias("first_dtcol"), F.max("dtcol").alias("last_dtcol")]
    for name in columns:
        ends += [F.min_by(name, "dtcol").alias(f"first_{name}"), F.max_by(name, "dtcol").alias(f"last_{name}")]
    return counters.groupBy(*(by or [])).agg(*ends)


def _cpu_times() -> list[Column]:
    names = {"user_s": "user_time", "system_s": "system_time", "idle_s": "idle_time", "iowait_s": "io_time"}
    return [round_half_even(counter_delta(name)).alias(shown) for name, shown in names.items()]


def _with_system(host: DataFrame, totals: DataFrame, cluster_information: DataFrame) -> DataFrame:
    """Leave ``io_time`` to hosts that run Linux; the system is that of the earliest inventory row."""
    keys = keys_of(host)
    system = F.min_by("cluster_os_family", "dtcol")
    if keys:
        totals = totals.join(cluster_information.groupBy(*keys).agg(system.alias("system")), keys, "left")
        linux = F.upper("system").contains("LINUX")
    else:
        linux = F.upper(cluster_information.agg(system).scalar()).contains("LINUX")
    return totals.withColumn("io_time", F.when(linux, F.col("io_time"))).drop("system")


def cpu_time_delta(host_times: DataFrame, cluster_information: DataFrame) -> DataFrame:
    """Seconds of user, system and idle time; I/O wait as well where the host runs Linux."""
    totals = host_times.groupBy(*keys_of(host_times)).agg(*_cpu_times())
    return _with_system(host_times, totals, cluster_information)


def _occupied(total: str, percent: str, prefix: str = "") -> list[Column]:
    return [
        round_half_even(F.max(total) / 1024 / 1024).alias(f"{prefix}total_mb"),
        round_half_even(F.min(percent)).alias(f"{prefix}min_pct"),
        round_half_even(F.avg(percent)).alias(f"{prefix}avg_pct"),
        round_half_even(F.max(percent)).alias(f"{prefix}max_pct"),
    ]


def occupation(host: DataFrame, total: str, percent: str) -> DataFrame:
    """Total megabytes, and lowest, mean and highest occupied percentage."""
    return host.groupBy(*keys_of(host)).agg(*_occupied(total, percent))


def _moved() -> Column:
    return size_pretty((counter_delta("swap_in") + counter_delta("swap_out")).cast("bigint")).alias("swapped")


def host_summary(host_counters: DataFrame, cluster_information: DataFrame) -> DataFrame:
    """CPU times, memory, swap and bytes swapped in one pass; one row per cluster."""
    totals = host_counters.groupBy(*keys_of(host_counters)).agg(
        *_cpu_times(),
        *_occupied("mem_total", "mem_percent", "mem_"),
        *_occupied("swap_total", "swap_percent", "swap_"),
        _moved(),
    )
    return _with_system(host_counters, totals, cluster_information)


def memory_stats(host_memory: DataFrame) -> DataFrame:
    return occupation(host_memory, "mem_total", "mem_percent")


def swap_stats(host_swap: DataFrame) -> DataFrame:
    return occupation(host_swap, "swap_total", "swap_percent")


def swapped_bytes(host_swap: DataFrame) -> DataFrame:
    """Bytes swapped in and out during the window, as text."""
    return host_swap.groupBy(*keys_of(host_swap)).agg(_moved())


def _at_window_ends(io_stats: DataFrame) -> DataFrame:
    """Counters summed per (context, stats_reset) at the window's first and last instant.

    The two instants come from a scan of ``dtcol`` alone; the filter on them prunes the
    second scan to the files that hold them. Every cluster has a window of its own, whose
    bounds are one row per cluster.
    """
    cluster = keys_of(io_stats)
    bounds = io_stats.groupBy(*cluster).agg(F.min("dtcol").alias("first"), F.max("dtcol").alias("last"))
    if cluster:
        rows = io_stats.join(bounds, cluster)
        at_first, at_last = F.col("dtcol") == F.col("first"), F.col("dtcol") == F.col("last")
    else:
        rows = io_stats
        at_first = F.col("dtcol") == bounds.select("first").scalar()
        at_last = F.col("dtcol") == bounds.select("last").scalar()
    counted = [column for _, *pair in IO_OPERATIONS for column in pair] + ["evictions"]
    sums = []
    for end in ("first", "last"):
        sums.append(F.count_if(f"at_{end}").alias(f"{end}_rows"))
        sums += [F.sum(F.when(F.col(f"at_{end}"), F.col(name))).alias(f"{end}_{name}") for name in counted]
    return (
        rows.filter(at_first | at_last)
        .withColumns({"at_first": at_first, "at_last": at_last})
        .groupBy(*cluster, "context", "stats_reset")
        .agg(*sums)
        .filter("first_rows > 0 and last_rows > 0")
    )


def _difference(name: str) -> Column:
    return F.sum(f"last_{name}") - F.sum(f"first_{name}")


def io_latency(io_stats: DataFrame) -> DataFrame:
    """Milliseconds per operation and context between the ends of the window, and evictions.

    Contexts whose statistics were reset in between are left out; null where nothing was
    counted.
    """
    context = keys_of(io_stats, "context")
    ends = _at_window_ends(io_stats).filter(F.col("stats_reset").isNotNull())
    latencies = []
    for label, count, time in IO_OPERATIONS:
        operations = _difference(count)
        latency = F.when(operations != 0, _difference(time) / operations)
        latencies.append(round_half_away(latency).alias(f"{label}_latency"))
    return (
        ends.groupBy(*context)
        .agg(*latencies, _difference("evictions").alias("evictions"))
        .orderBy(*context)
    )


def io_evictions(io_stats: DataFrame) -> DataFrame:
    """Buffers evicted per context between the ends of the window."""
    return io_latency(io_stats).select(*keys_of(io_stats, "context"), "evictions")


def unreset_pairs(io_stats: DataFrame) -> DataFrame:
    """Per (backend_type, context): the ends of its counters, where no reset came between."""
    pairs = endpoint_join(io_stats, ["reads", "writes", "stats_reset"], keys_of(io_stats, "backend_type", "context"))
    return same_reset(pairs, "first_stats_reset", "last_stats_reset")


def counter_steps(counters: DataFrame, columns: list[str], by: list[str], reset: str | None = "stats_reset") -> DataFrame:
    """``counters`` with ``<name>_step``: what each cumulative counter grew by since the snapshot before.

    After a reset (``reset`` changed, or the value fell) the counter began at zero, so the step is
    its value. The first snapshot of a series has no step, nor has one with a null value or the
    one after it. Series are cut by day: the snapshot
    before a day's first one comes from one row per day.
    """
    keys = keys_of(counters, *[name for name in by if name != "cluster"])
    watched = [*columns, *([reset] if reset else [])]
    rows = counters.withColumn("of_day", F.to_date("dtcol"))
    within = Window.partitionBy(*keys, "of_day").orderBy("dtcol")
    rows = rows.withColumn("before", F.lag(F.struct(*watched)).over(within))
    across = Window.partitionBy(*keys).orderBy("of_day")
    ends = (
        counters.groupBy(*keys, F.to_date("dtcol").alias("of_day"))
        .agg(F.max_by(F.struct(*watched), "dtcol").alias("last"))
        .withColumn("carried", F.lag("last").over(across))
        .select(*[F.col(name).alias(f"end_{name}") for name in [*keys, "of_day"]], "carried")
    )
    match = [F.col(name).eqNullSafe(F.col(f"end_{name}")) for name in [*keys, "of_day"]]
    before = F.coalesce("before", "carried")
    fresh = ~F.col(reset).eqNullSafe(before[reset]) if reset else F.lit(False)
    steps = {
        f"{name}_step": F.when(before.isNotNull() & before[name].isNotNull(),
                               F.when(fresh | (F.col(name) < before[name]), F.col(name)).otherwise(F.col(name) - before[name]))
        for name in columns
    }
    return rows.join(ends, match, "left").withColumns(steps).select(*counters.columns, *steps)


def io_latency_across_resets(io_stats: DataFrame) -> DataFrame:
    """Milliseconds per operation and context over the whole window, resets in between included; and evictions."""
    counted = [column for _, *pair in IO_OPERATIONS for column in pair] + ["evictions"]
    steps = counter_steps(io_stats, counted, ["backend_type", "context"])
    grown = lambda name: F.sum(f"{name}_step")
    latencies = [
        round_half_away(F.when(grown(count) != 0, grown(time) / grown(count))).alias(f"{label}_latency")
        for label, count, time in IO_OPERATIONS
    ]
    context = keys_of(io_stats, "context")
    return steps.groupBy(*context).agg(*latencies, grown("evictions").alias("evictions")).orderBy(*context)


def parsed_counters(samples: DataFrame, text: str, names: list[str]) -> DataFrame:
    """Samples with the counters of a printed tuple as double columns."""
    return samples.select("dtcol", *parse_counters(F.col(text), names))
