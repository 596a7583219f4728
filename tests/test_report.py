"""Report arithmetic on small samples."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionscope.functions.scalars import instant
from sessionscope.operators import counters, report

START = dt.datetime(2024, 1, 1)
SCHEMA = (
    "dtcol timestamp, datid bigint, datname string, pid bigint, leader_pid bigint, usename string, "
    "client_addr string, application_name string, backend_type string, wait_event_type string, "
    "query_start timestamp, query string, iquery bigint, tquery string, itquery bigint, "
    "blockers array<bigint>, pourcentage_cpu double, mem bigint, swapped bigint"
)


def session(second, pid, query="q", leader=None, app="web", wait=None, start=0, cpu=50.0, mem=100, blockers=None):
    at = START + dt.timedelta(seconds=second)
    begun = START + dt.timedelta(seconds=start)
    return (at, 1, "db", pid, leader, "u", "c", app, "client backend", wait, begun, query, 10, query, 11,
            blockers, cpu, mem, mem * 2)


def heartbeat(second, cpu=20.0):
    return (START + dt.timedelta(seconds=second), *[None] * 15, cpu, None, None)


@pytest.fixture
def samples(spark):
    rows = [heartbeat(0), heartbeat(10, 21.0), heartbeat(20)]
    rows += [session(0, 1), session(0, 2, leader=1), session(10, 1, start=5), session(10, 3, query="r", wait="Lock")]
    rows += [session(20, 9, app="sampler"), session(20, 8, app=None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_db_time(samples):
    row = report.db_time(samples).first()
    assert (row.elapsed, row.db_time, row.average_active_sessions) == (20.0, 26.67, 1.33)


def test_db_time_without_elapsed_time(samples):
    row = report.db_time(samples.filter(F.col("dtcol") == instant(START))).first()
    assert (row.elapsed, row.db_time, row.average_active_sessions) == (0.0, 0.0, None)


def test_empty_window(samples):
    none = samples.filter("false")
    assert report.db_time(none).first().elapsed is None
    assert report.report_bounds(none).first().first_sample is None
    assert report.top_queries(none).count() == 0
    assert report.busy_total(none, 10).count() == 0


def test_host_cpu_rounds_half_to_even(spark):
    rows = [heartbeat(0, 20.0), heartbeat(1, 21.0)]
    assert report.host_cpu_avg(spark.createDataFrame(rows, SCHEMA)).first().host_cpu == 20.0


def test_top_events_counts_null_waits(samples):
    rows = [tuple(row) for row in report.top_events(samples).collect()]
    assert rows == [(None, 3), ("Lock", 1)]
    assert report.top_events(samples, n=1).count() == 1


def test_top_queries(samples):
    first, second = report.top_queries(samples, n=5).collect()
    assert (first.query, first.hash, first.detections, first.detections_without_leader) == ("q", "b", 3, 2)
    assert (first.distinct_executions, first.non_cpu_pct) == (2, 50.0)
    assert (first.peak_memory, first.peak_swap) == ("200 bytes", "400 bytes")
    assert (second.query, second.detections, second.peak_memory) == ("r", 1, "100 bytes")
    assert report.top_queries(samples, n=1).collect() == [first]


def test_activity_is_the_sections_in_one(samples):
    row = report.activity(samples).first()
    assert (row.elapsed, row.db_time, row.average_active_sessions) == tuple(report.db_time(samples).first())
    assert (row.first_sample, row.last_sample) == tuple(report.report_bounds(samples).first())
    assert row.host_cpu == report.host_cpu_avg(samples).first().host_cpu


def test_clusters_have_their_own_time(samples):
    both = samples.withColumn("cluster", F.lit("a")).unionByName(samples.withColumn("cluster", F.lit("b")))
    rows = report.db_time(both).collect()
    assert sorted(row.cluster for row in rows) == ["a", "b"]
    assert {tuple(row)[1:] for row in rows} == {tuple(report.db_time(samples).first())}
    peak = report.peak_sum(both.filter("pid is not null"), ["datname"], "mem").first().peak_mem
    assert peak == 200


def test_rankings_expand_nothing_before_the_first_shuffle(samples):
    plan = report.busy_sessions(samples, 3)._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.strip(" :+-") for line in plan.splitlines()]
    expand = next(at for at, line in enumerate(lines) if line.startswith("Expand"))
    assert lines[expand + 1].startswith("Aggregate")


def test_ranked_equals_one_by_one(samples):
    choices = ["datname AS db, query", "wait_event_type"]
    ranked = report.busy_ranked(samples, choices, 3).collect()
    for number, columns in enumerate(choices):
        alone = report.busy_by(samples, columns, 3).collect()
        mine = sorted((row.label, row.busy_pc, row.distinct_exe, row.mem) for row in ranked if row.choice == number)
        assert mine == sorted(
            (" | ".join(str(value or "") for value in row[2:-3]), row[0], row[1], row[-2]) for row in alone
        )


def test_iterations_from_a_row(spark, samples):
    taken = spark.createDataFrame([(3,)], "iterations bigint")
    assert report.busy_total(samples, taken).collect() == report.busy_total(samples, 3).collect()


def test_unknown_cpu_is_no_waiting(spark):
    frame = spark.createDataFrame([(None,), (30.5,), (150.0,)], "c double")
    assert [row.p for row in frame.select(report.non_cpu_pct(F.col("c")).alias("p")).collect()] == [0.0, 70.0, 0.0]


def test_peak_is_at_most_the_total(samples):
    peak = report.peak_sum(samples.filter("pid is not null"), ["datname"], "mem").first().peak_mem
    assert peak == 200 <= samples.agg(F.sum("mem")).first()[0]


def test_busy_sessions_groups_by_blockers(spark):
    rows = [session(n, 1, blockers=[5] if n < 3 else None) for n in range(4)]
    found = report.busy_sessions(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert [(row.busy_pc, row.blockers, row.distinct_exe) for row in found] == [
        (75.0, [5], "1 / 3"), (25.0, None, "1 / 1"),
    ]


def test_busy_by_text_equals_columns(samples):
    text = report.busy_by(samples, "datname AS db, substring(query, 1, 1) AS q", 3)
    columns = report.busy_by(samples, [F.col("datname").alias("db"), F.substring("query", 1, 1).alias("q")], 3)
    assert sorted(map(str, text.collect())) == sorted(map(str, columns.collect()))
    assert text.columns == ["busy_pc", "distinct_exe", "db", "q", "non_cpu_pc", "mem", "swap"]


def test_busy_by_may_name_a_measured_column(samples):
    found = report.busy_by(samples, "dtcol, mem", 3)
    assert found.columns == ["busy_pc", "distinct_exe", "dtcol", "mem", "non_cpu_pc", "mem", "swap"]
    assert found.count() == 3


def test_busy_multi_equals_one_by_one(samples):
    choices = ["datname AS db, query", [F.col("wait_event_type")], "", "query"]
    for columns, ranking in zip(choices, report.busy_multi(samples, choices, 3)):
        alone = report.busy_by(samples, columns, 3)
        assert ranking.columns == alone.columns
        assert sorted(map(str, ranking.collect())) == sorted(map(str, alone.collect()))


def test_busy_total(samples):
    assert report.busy_total(samples, 3).first().busy_pc == 200.0


IO = "dtcol timestamp, context string, stats_reset timestamp, " + ", ".join(
    f"{count} bigint, {time} double" for _, count, time in counters.IO_OPERATIONS
) + ", evictions bigint"


def io_row(second, context, reset, reads, read_time, evictions):
    rest = [None, None] * (len(counters.IO_OPERATIONS) - 1)
    return (START + dt.timedelta(seconds=second), context, reset, reads, read_time, *rest, evictions)


def test_io_latency(spark):
    other = START + dt.timedelta(seconds=5)
    rows = [
        io_row(0, "normal", START, 10, 100.0, 1), io_row(0, "normal", START, 20, 200.0, 2),
        io_row(5, "normal", START, 99, 999.0, 99),
        io_row(9, "normal", START, 14, 101.0, 11), io_row(9, "normal", START, 20, 201.5, 12),
        io_row(0, "vacuum", START, 1, 1.0, 1), io_row(9, "vacuum", other, 2, 2.0, 2),
        io_row(0, "bulkread", START, 5, 5.0, 7), io_row(9, "bulkread", START, 5, 6.0, 9),
        io_row(5, "late", START, 5, 6.0, 9),
    ]
    frame = spark.createDataFrame(rows, IO)
    found = [(row.context, row.read_latency, row.write_latency, row.evictions) for row in counters.io_latency(frame).collect()]
    assert found == [("bulkread", None, None, 2), ("normal", 0.63, None, 20)]
    assert counters.io_latency(frame.filter("false")).count() == 0


def test_cpu_time_without_linux(spark):
    host = spark.createDataFrame(
        [(START, 1.0, 2.0, 3.0, 4.0), (START + dt.timedelta(seconds=1), 3.5, 3.0, 9.0, 8.0)],
        "dtcol timestamp, user_s double, system_s double, idle_s double, iowait_s double",
    )
    for system, waited in (("Linux", 4.0), ("Windows", None)):
        cluster = spark.createDataFrame([(START, system)], "dtcol timestamp, cluster_os_family string")
        assert tuple(counters.cpu_time_delta(host, cluster).first()) == (2.0, 1.0, 6.0, waited)


def test_frequent_groups_are_proven_or_all_are_counted(spark):
    """One group with a third of the rows, many with one row each; and groups too even for a small summary."""
    keys = F.when(F.col("id") % 3 == 0, F.col("id") % 4).otherwise(F.col("id") + 10)
    skewed = spark.range(60_000).select(keys.alias("k"), F.lit("x").alias("other"))
    chosen = report.frequent_keys(skewed, ["k", "other"], 4, 1_000)
    assert chosen.count() < 0.4 * skewed.count()
    top = chosen.groupBy("k").count().orderBy(F.desc("count")).limit(4).collect()
    assert sorted((row.k, row["count"]) for row in top) == [(k, 5_000) for k in range(4)]
    even = spark.range(60_000).select((F.col("id") % 20_000).alias("k"), F.lit("x").alias("other"))
    assert report.frequent_keys(even, ["k", "other"], 5, 500).count() == 60_000
    few = spark.range(100).select((F.col("id") % 7).alias("k"), F.lit(None).cast("string").alias("other"))
    assert report.frequent_keys(few, ["k", "other"], 50, 500).count() == 100
    assert report.frequent_keys(few.limit(0), ["k", "other"], 3, 500).count() == 0
