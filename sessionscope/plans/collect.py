"""The collection plan: raw snapshots in, rows of the sample history out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.operators.enrich import (
    cache_sampling,
    carry_memory,
    fingerprint,
    with_application_info,
    with_query_tokens,
)
from sessionscope.operators.filters import active_sessions, not_idle, pid_filter
from sessionscope.operators.locks import final_blockers
from sessionscope.schema import keys_of
from sessionscope.session import cut_lineage

PROBE_COLUMNS = ("pourcentage_cpu", "mem", "swapped")


def with_blockers(sessions: DataFrame, blockers: DataFrame) -> DataFrame:
    """Add ``blockers`` from (dtcol, blocked, final_blockers)."""
    keys = keys_of(sessions, "dtcol", "pid")
    blocked = blockers.withColumnRenamed("blocked", "pid").select(*keys, F.col("final_blockers").alias("blockers"))
    return sessions.drop("blockers").join(blocked, keys, "left")


def enrich_samples(
    sessions: DataFrame,
    heartbeats: DataFrame,
    blockers: DataFrame,
    cpu_probes: DataFrame,
    memory: DataFrame,
) -> DataFrame:
    """Sessions with their blockers, CPU and memory, plus the heartbeat rows.

    ``blockers`` (dtcol, blocked, final_blockers), ``cpu_probes`` (dtcol, pid, cpu),
    ``memory`` (dtcol, pid, mem, swapped) as :func:`carry_memory` leaves it. All three
    join on the same two columns, so the sessions are shuffled once. Heartbeats take the
    whole-host CPU and nothing else.
    """
    keys, instant = keys_of(sessions, "dtcol", "pid"), keys_of(sessions, "dtcol")
    cpu = cpu_probes.select(*keys, F.col("cpu").alias("pourcentage_cpu"))
    rows = (
        with_blockers(sessions.drop(*PROBE_COLUMNS), blockers)
        .join(cpu, keys, "left")
        .join(memory.select(*keys, "mem", "swapped"), keys, "left")
    )
    host = heartbeats.drop(*PROBE_COLUMNS, "blockers").join(
        cpu.filter("pid = 0").select(*instant, "pourcentage_cpu"), instant, "left"
    )
    return rows.unionByName(host, allowMissingColumns=True)


def collect(
    samples: DataFrame,
    locks: DataFrame | None,
    cpu_probes: DataFrame,
    memory_probes: DataFrame,
    interval_seconds: int,
    depth: int = 2,
    text_search: bool | str = False,
    batch: bool = False,
    pids=None,
    own_pid: int | None = None,
    normalize: bool = True,
    application_fields: bool = True,
    earlier: DataFrame | None = None,
    folder: str | None = None,
    carry: bool = True,
) -> DataFrame:
    """Everything one collection tick does, for all ticks in ``samples`` at once.

    In ``batch`` collection a cached memory value is used with a probability that grows
    with the number of active sessions, so that small loads are measured afresh more often.
    ``pids`` (a list, or rows of (dtcol, pid)) chooses processes in place of those that are
    not idle, for the samples and for the blocked processes that get blockers; ``own_pid``
    is the sampler. ``text_search`` stores the words of each query, ``"stems"`` their English
    stems. ``normalize`` and ``application_fields`` can be turned off. ``earlier``
    (dtcol, pid, mem, swapped) are stored values that memory goes on from. ``folder`` is that
    of :func:`final_blockers`; where it is given, the memory is worked out and written there first.
    Without ``carry`` the probed memory is stored as it is.
    """
    choose = not_idle if pids is None else lambda rows: pid_filter(rows, pids)
    chosen = choose(active_sessions(samples, own_pid))
    keys = keys_of(samples, "dtcol", "pid")
    sessions = fingerprint(chosen, normalize)
    if application_fields:
        sessions = with_application_info(sessions)
    else:
        sessions = sessions.withColumn("application_info", F.lit(None).cast("map<string,string>"))
    if text_search:
        sessions = with_query_tokens(sessions, stem=text_search == "stems")
    else:
        sessions = sessions.withColumn("dquery", F.lit(None).cast("array<string>"))
    probes, fresh = memory_probes.join(chosen.select(keys), keys, "left_semi").select(*keys, "mem", "swapped"), None
    if batch:
        draws = cache_sampling(chosen).select(*keys, "use_cache")
        probes, fresh = probes.join(draws, keys), ~F.coalesce("use_cache", F.lit(True))
    if earlier is not None:
        probes = probes.unionByName(earlier.select(*keys, "mem", "swapped"), allowMissingColumns=True)
    blocked_type = f"{', '.join(f'{name} {kind}' for name, kind in samples.select(keys).dtypes[:-1])}, blocked bigint"
    if locks is None:
        blockers = samples.sparkSession.createDataFrame([], f"{blocked_type}, final_blockers array<bigint>")
    else:
        blockers = final_blockers(locks, depth, choose(samples.filter("pid is not null")), folder)
    memory = carry_memory(probes, interval_seconds, fresh) if carry else probes
    if folder is not None:
        # a plan of its own: the driver holds one plan at a time, with all its copies while it is optimized
        memory = cut_lineage(memory, folder, "memory")
    return enrich_samples(
        sessions, samples.filter("pid is null and datid is null"), blockers, cpu_probes, memory
    )
