"""Report queries over a window of enriched samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.scalars import (
    hash_hex,
    query_prefix,
    round_half_away,
    round_half_even,
    size_pretty,
)
from sessionscope.operators.filters import DEFAULT_REPORT_FILTER, report_filter
from sessionscope.schema import is_heartbeat, is_host_row, is_process, is_session, keys_of


def report_bounds(samples: DataFrame) -> DataFrame:
    """First and last instant, as text; one row per cluster."""
    shown = lambda instant: F.date_format(instant, "dd/MM/yyyy HH:mm:ss")
    return samples.groupBy(*keys_of(samples)).agg(shown(F.min("dtcol")).alias("first_sample"), shown(F.max("dtcol")).alias("last_sample"))


def report_host(cluster_information: DataFrame) -> DataFrame:
    """Host name of the earliest inventory row, of each cluster."""
    return cluster_information.groupBy(*keys_of(cluster_information)).agg(F.min_by("cluster_hostname", "dtcol").alias("host"))


def _load(samples: DataFrame, predicate: str | Column) -> list[Column]:
    """Aggregates: elapsed seconds between heartbeats, session rows, heartbeats."""
    chosen = F.expr(predicate) if isinstance(predicate, str) else predicate
    beat = F.when(is_heartbeat(), F.unix_micros("dtcol"))
    return [
        ((F.max(beat) - F.min(beat)) / 1_000_000).alias("elapsed"),
        F.count_if(is_session() & chosen).alias("sessions"),
        F.count_if(is_heartbeat()).alias("samples"),
    ]


def _load_shown() -> list[Column]:
    spent = F.try_divide(F.col("elapsed") * F.col("sessions"), F.col("samples"))
    return [
        round_half_away(F.col("elapsed")).alias("elapsed"),
        round_half_away(spent).alias("db_time"),
        round_half_away(F.try_divide(spent, F.col("elapsed"))).alias("average_active_sessions"),
    ]


def db_time(samples: DataFrame, predicate: str | Column = DEFAULT_REPORT_FILTER) -> DataFrame:
    """Elapsed seconds, seconds spent in sessions, and average active sessions.

    Each sample stands for an equal share of the elapsed time, counted by heartbeats.
    One pass with conditional counts; null where no time elapsed. One row per cluster where
    the samples are of several.
    """
    totals = samples.groupBy(*keys_of(samples)).agg(*_load(samples, predicate))
    return totals.select(*keys_of(samples), *_load_shown())


def activity(samples: DataFrame, predicate: str | Column = DEFAULT_REPORT_FILTER) -> DataFrame:
    """Bounds, DB time and mean host CPU in one pass; one row per cluster."""
    shown = lambda instant: F.date_format(instant, "dd/MM/yyyy HH:mm:ss")
    totals = samples.groupBy(*keys_of(samples)).agg(
        shown(F.min("dtcol")).alias("first_sample"),
        shown(F.max("dtcol")).alias("last_sample"),
        *_load(samples, predicate),
        round_half_even(F.avg(F.when(is_host_row(), F.col("pourcentage_cpu")))).alias("host_cpu"),
    )
    return totals.select(*keys_of(samples), "first_sample", "last_sample", *_load_shown(), "host_cpu")


def host_cpu_avg(samples: DataFrame) -> DataFrame:
    return samples.filter(is_host_row()).groupBy(*keys_of(samples)).agg(round_half_even(F.avg("pourcentage_cpu")).alias("host_cpu"))


def top_events(samples: DataFrame, n: int = 5, predicate: str | Column = DEFAULT_REPORT_FILTER) -> DataFrame:
    """The wait event types met most often."""
    return (
        report_filter(samples, predicate)
        .groupBy("wait_event_type")
        .agg(F.count("*").alias("detections"))
        .orderBy(F.desc("detections"), F.asc_nulls_last("wait_event_type"))
        .limit(n)
    )


def session_measures(samples: DataFrame, *key_sets: list[str]) -> DataFrame:
    """Counts, distinct executions, mean CPU and peak memory per group of each set of keys.

    The peak of a group is the largest sum over the rows of one instant (of one cluster).
    Rows are first added up per (keys, instant, execution), in one shuffle; these sums are
    rolled up per (keys, instant) and per (keys, execution), which spreads even a group
    with a third of all rows over many tasks, then per keys. ``choice`` is the position of
    the key set; key columns of different sets must have different names.
    """
    every_key = [name for keys in key_sets for name in keys]
    instant = keys_of(samples, "dtcol")
    sums = samples.groupBy(*every_key, *instant, "query_start").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("leader_pid").isNull()).alias("leaderless"),
        F.sum("pourcentage_cpu").alias("cpu"),
        F.count("pourcentage_cpu").alias("cpu_rows"),
        F.sum("mem").alias("mem"),
        F.sum("swapped").alias("swapped"),
    )
    sets = [[*keys, *part] for keys in key_sets for part in (instant, ["query_start"])]
    choice = F.coalesce(*[F.when(F.grouping(keys[0]) == 0, F.lit(number)) for number, keys in enumerate(key_sets)])
    parts = sums.groupingSets(
        [[F.col(name) for name in names] for names in sets],
        *[F.col(name) for name in [*every_key, *instant, "query_start"]],
    ).agg(
        choice.alias("choice"),
        F.grouping("dtcol").alias("by_execution"),
        *[F.sum(name).alias(name) for name in ("rows", "leaderless", "cpu", "cpu_rows", "mem", "swapped")],
    )
    by_instant = F.col("by_execution") == 0
    by_execution = F.col("by_execution") == 1
    return (
        parts.groupBy("choice", *every_key)
        .agg(
            F.sum(F.when(by_instant, F.col("rows"))).alias("detections"),
            F.sum(F.when(by_instant, F.col("leaderless"))).alias("detections_without_leader"),
            F.count(F.when(by_execution, F.col("query_start"))).alias("distinct_executions"),
            F.sum(F.when(by_execution & F.col("query_start").isNotNull(), F.col("rows"))).alias("executions"),
            F.sum(F.when(by_instant, F.col("cpu"))).alias("cpu"),
            F.sum(F.when(by_instant, F.col("cpu_rows"))).alias("cpu_rows"),
            F.max(F.when(by_instant, F.col("mem"))).alias("peak_mem"),
            F.max(F.when(by_instant, F.col("swapped"))).alias("peak_swapped"),
        )
        .withColumn("executions", F.coalesce("executions", F.lit(0).cast("bigint")))
    )


def non_cpu_pct(cpu: Column) -> Column:
    """100 minus a mean CPU percentage, rounded, not below zero (0 for an unknown mean)."""
    return F.greatest(round_half_even(100 - cpu), F.lit(0.0))


def peak_sum(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: the largest per-instant sum of ``value``; instants of different clusters are different."""
    return (
        samples.groupBy(*by, *[name for name in keys_of(samples, "dtcol") if name not in by])
        .agg(F.sum(value).alias("total"))
        .groupBy(*by)
        .agg(F.max("total").alias(f"peak_{value}"))
    )


def distinct_executions(samples: DataFrame, by: list[str]) -> DataFrame:
    return samples.groupBy(*by).agg(
        F.countDistinct("query_start").alias("distinct_executions"),
        F.count("query_start").alias("executions"),
    )


QUERY_KEYS = ["datname", "usename", "hash", "query", "application_name"]


def top_queries(
    samples: DataFrame, n: int = 5, predicate: str | Column = DEFAULT_REPORT_FILTER, tracked: int | None = None
) -> DataFrame:
    """The queries met most often, with executions, share of non-CPU time and peak memory.

    Groups are counted first, which needs one number per group. The costlier measures
    are then taken for the rows of the top n groups only. Equal counts are ordered by
    the group's own columns.

    With ``tracked``, where there are very many groups, only the groups that a summary of so many
    frequent items names are counted (:func:`frequent_keys`); the counts are exact, and
    the summary proves that no other group can be among the top n, or else all are counted.
    """
    rows = report_filter(samples, predicate).select(
        "datname",
        "usename",
        hash_hex(F.coalesce("itquery", "iquery")).alias("hash"),
        F.coalesce("tquery", "query").alias("query"),
        "application_name",
        "leader_pid",
        *keys_of(samples, "dtcol"),
        "query_start",
        "pourcentage_cpu",
        "mem",
        "swapped",
    )
    order = [F.desc("detections"), *[F.asc_nulls_first(name) for name in QUERY_KEYS]]
    counted = frequent_keys(rows, QUERY_KEYS, n, tracked) if tracked else rows
    top = counted.groupBy(*QUERY_KEYS).agg(F.count("*").alias("detections")).orderBy(*order).limit(n)
    top = top.select(*[F.col(name).alias(f"top_{name}") for name in QUERY_KEYS])
    match = [F.col(name).eqNullSafe(F.col(f"top_{name}")) for name in QUERY_KEYS]
    measures = session_measures(rows.join(top, match, "left_semi"), QUERY_KEYS)
    return measures.select(
        *QUERY_KEYS,
        "detections",
        "detections_without_leader",
        "distinct_executions",
        non_cpu_pct(F.try_divide("cpu", "cpu_rows")).alias("non_cpu_pct"),
        size_pretty(F.col("peak_mem")).alias("peak_memory"),
        size_pretty(F.col("peak_swapped")).alias("peak_swap"),
    ).orderBy(*order)


#: A group outside a summary of ``tracked`` items has fewer than this share of the rows, over ``tracked``:
#: twice the published error of a frequent-items sketch, 3.5 over the size of its table.
SUMMARY_ERROR = 7.0


def frequent_keys(rows: DataFrame, keys: list[str], n: int, tracked: int) -> DataFrame:
    """Rows among which are all rows of the n most frequent groups; all rows, if that cannot be proven.

    One pass makes a frequent-items summary of the groups' hashes, ``tracked`` numbers at most in
    each task and in the result; so nothing per group is shuffled but for the groups it names. Let c
    be the exact count of the n-th of these. A group that is not named has at most
    ``SUMMARY_ERROR / tracked`` of the rows, so c above that proves it is none of the top n (nor
    equal to one). If the summary's counts add up to all rows, it names every group.
    """
    hashed = rows.withColumn("key hash", F.xxhash64(*keys))
    summary = hashed.agg(
        F.expr(f"approx_top_k(`key hash`, {tracked}, {tracked})").alias("named"), F.count("*").alias("rows")
    ).first()
    named = {item["item"]: item["count"] for item in summary["named"] or []}
    candidates = rows.sparkSession.createDataFrame([(number,) for number in named], "`key hash` long")
    chosen = hashed.join(F.broadcast(candidates), "key hash", "left_semi").drop("key hash")
    if sum(named.values()) == summary["rows"]:
        return chosen
    top = chosen.groupBy(*keys).agg(F.count("*").alias("detections")).orderBy(F.desc("detections")).limit(n).collect()
    proven = len(top) == n and min(row["detections"] for row in top) > SUMMARY_ERROR / tracked * summary["rows"]
    return chosen if proven else rows


def session_columns() -> list[Column]:
    """The default columns of the interactive ranking."""
    # Which columns, under which names
    return [
        F.col("datname").alias("db"),
        F.col("pid"),
        F.col("usename").alias("pg_user"),
        F.col("client_addr").alias("client_ip"),
        F.col("application_name").alias("application"),
        query_prefix(F.col("tquery"), F.col("query")).alias("query"),
        F.col("wait_event_type"),
        F.col("blockers"),
    ]


MEASURED = ("dtcol", "leader_pid", "query_start", "pourcentage_cpu", "mem", "swapped")


def _keyed(samples: DataFrame, choices: list) -> tuple[DataFrame, list[list[str]]]:
    """Session rows with the key columns of every choice, and the names of those.

    A choice is SQL text or a list of Columns. Choice 1's second key becomes ``key1_1``.
    """
    rows, names = samples.filter(is_process()), []
    for number, columns in enumerate(choices):
        if isinstance(columns, str):
            text = columns.strip() or "'' AS everything"
            wider = rows.sparkSession.sql(f"SELECT *, {text} FROM {{rows}}", rows=rows)
        else:
            wider = rows.select("*", *columns)
        names.append(wider.columns[len(rows.columns):])
        rows = wider.toDF(*rows.columns, *_keys(number, names[-1]))
    keys = [key for number, shown in enumerate(names) for key in _keys(number, shown)]
    return rows.select(*keys_of(rows), *MEASURED, *keys), names


def _ranking(measures: DataFrame, number: int, names: list[str], iterations: int | DataFrame, *more: str) -> DataFrame:
    more = list(more)
    if not isinstance(iterations, DataFrame):
        samples = F.lit(float(iterations))
    elif "cluster" in iterations.columns:
        measures = measures.join(iterations.select(F.col("cluster").alias("of_cluster"), "iterations"), "of_cluster", "left")
        samples, more = F.col("iterations").cast("double"), [F.col("of_cluster").alias("cluster"), *more]
    else:
        samples = iterations.scalar().cast("double")
    # The names of the measures, as the ranking shows them
    return measures.select(
        round_half_even(F.col("detections").cast("double") / samples * 100).alias("busy_pc"),
        F.concat_ws(" / ", "distinct_executions", "executions").alias("distinct_exe"),
        *more,
        *[F.col(f"key{number}_{place}").alias(name) for place, name in enumerate(names)],
        non_cpu_pct(F.try_divide("cpu", "cpu_rows")).alias("non_cpu_pc"),
        size_pretty(F.col("peak_mem")).alias("mem"),
        size_pretty(F.col("peak_swapped")).alias("swap"),
    ).orderBy(F.desc("busy_pc"))


def busy_by(samples: DataFrame, columns, iterations: int | DataFrame) -> DataFrame:
    """Busy percentage and measures of session rows grouped by the user's columns.

    ``columns`` is SQL text such as ``"datname AS db, substring(query, 1, 10) AS q"`` or
    a list of Columns. ``iterations`` is the number of samples taken, so 100 means one
    session busy all the time; it may be the result of ``effective_iterations``. Where that has
    a row per cluster, every cluster is ranked by its own samples, and ``cluster`` is a column.
    """
    rows, (names,) = _keyed(samples, [columns])
    rows, own = _by_cluster(rows, iterations)
    return _ranking(session_measures(rows, [*_keys(0, names), *own]), 0, names, iterations)


def _by_cluster(rows: DataFrame, iterations: int | DataFrame) -> tuple[DataFrame, list[str]]:
    """The cluster as one more key, where iterations are given per cluster."""
    if isinstance(iterations, DataFrame) and "cluster" in iterations.columns:
        return rows.withColumn("of_cluster", F.col("cluster")), ["of_cluster"]
    return rows, []


def _keys(number: int, names: list[str]) -> list[str]:
    return [f"key{number}_{place}" for place in range(len(names))]


def busy_sessions(samples: DataFrame, iterations: int | DataFrame) -> DataFrame:
    """The default ranking: by database, process, user, client, application, query, wait, blockers."""
    return busy_by(samples, session_columns(), iterations)


def busy_total(samples: DataFrame, iterations: int | DataFrame) -> DataFrame:
    """One row: how busy the whole server was. No samples, no row."""
    return busy_by(samples, "", iterations).drop("everything")


def busy_multi(samples: DataFrame, choices: list, iterations: int | DataFrame) -> list[DataFrame]:
    """One ranking per choice of columns.

    Each reads its own columns of the samples. :func:`busy_ranked` gives all of them as one
    table, from a single pass.
    """
    return [busy_by(samples, columns, iterations) for columns in choices]


def busy_ranked(samples: DataFrame, choices: list, iterations: int | DataFrame) -> DataFrame:
    """All rankings as one table, from one pass: ``choice`` (from 0), ``label`` and the measures.

    ``label`` holds the key columns as one struct of texts, since choices differ in columns.
    """
    rows, names = _keyed(samples, choices)
    if isinstance(iterations, DataFrame) and "cluster" in iterations.columns:
        raise ValueError("rank the clusters one choice at a time, by busy_by")
    measures = session_measures(rows, *[_keys(number, shown) for number, shown in enumerate(names)])
    label = F.coalesce(*[
        F.when(
            F.col("choice") == number,
            F.concat_ws(" | ", *[F.coalesce(F.col(key).cast("string"), F.lit("")) for key in _keys(number, shown)]),
        )
        for number, shown in enumerate(names)
    ])
    return _ranking(measures.withColumn("label", label), 0, [], iterations, "choice", "label")
