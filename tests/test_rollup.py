"""Hourly roll-ups against the samples themselves, and counters over resets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionscope.operators import counters, rollup
from sessionscope.operators.report import distinct_executions, session_measures
from sessionscope.sources import history as H

START = dt.datetime(2024, 1, 1)
SCHEMA = "cluster string, dtcol timestamp, pid long, datname string, leader_pid long, query_start timestamp, pourcentage_cpu double, mem long, swapped long"


@pytest.fixture(scope="module")
def samples(spark):
    draw = random.Random(9)
    rows = []
    for n in range(400):
        at = START + dt.timedelta(minutes=11 * n)
        for pid in range(draw.randint(0, 4)):
            rows.append((draw.choice(["east", "west"]), at, pid + 1, draw.choice(["a", "b", None]), draw.choice([None, 1]),
                         draw.choice([None, START + dt.timedelta(minutes=draw.randint(0, 900))]), draw.choice([None, 50.0, 3.0]),
                         draw.choice([None, 10, 70]), draw.randint(0, 9)))
        rows.append(("east", at, None, None, None, None, 1.0, None, None))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("minutes", [(0, 4400), (37, 2901), (59, 61), (1440, 2879), (5, 50)])
def test_any_window_merges_to_the_exact_measures(spark, samples, tmp_path, minutes):
    table, path = str(tmp_path / "table"), str(tmp_path / "rollup")
    H.append_samples(samples, table)
    assert rollup.update_rollup(spark, table, path, ["datname"], dt.date(2024, 1, 1)) == [dt.date(2024, 1, 1)]
    days = rollup.update_rollup(spark, table, path, ["datname"], dt.date(2024, 1, 2))
    assert days == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]  # the latest day is made again, nothing twice
    start, end = (START + dt.timedelta(minutes=n) for n in minutes)
    merged = rollup.window_rollup(spark, table, path, ["datname"], start, end)
    rows = samples.filter((F.col("dtcol") >= start) & (F.col("dtcol") <= end) & F.col("pid").isNotNull())
    exact = session_measures(rows.withColumn("of_cluster", F.col("cluster")), ["of_cluster", "datname"])
    names = ["detections", "detections_without_leader", "executions", "cpu", "cpu_rows", "peak_mem", "peak_swapped"]
    found = sorted(map(str, (tuple(row) for row in merged.select("cluster", "datname", *names).collect())))
    assert found == sorted(map(str, (tuple(row) for row in exact.select("of_cluster", "datname", *names).collect())))


def test_sketches_stay_inside_their_error(spark):
    starts = F.timestamp_micros(F.col("id") % 20_000 * 1_000_000)
    rows = spark.range(60_000).select(
        F.timestamp_micros(F.col("id") * 60_000_000).alias("dtcol"), F.lit(1).cast("long").alias("pid"), F.lit("a").alias("datname"),
        F.lit(None).cast("long").alias("leader_pid"), starts.alias("query_start"), F.lit(1.0).alias("pourcentage_cpu"),
        F.lit(1).cast("long").alias("mem"), F.lit(1).cast("long").alias("swapped"),
    )
    merged = rollup._merged(rollup.hourly_rollup(rows, ["datname"]), ["datname"])
    exact = distinct_executions(rows, ["datname"]).first()
    row = rollup.busy_rollup(merged, ["datname"], 60_000).first()
    assert row.executions == exact.executions and row.busy_pc == 100
    assert abs(row.distinct_estimate - exact.distinct_executions) < 0.05 * exact.distinct_executions


@pytest.mark.parametrize("seed", range(3))
def test_steps_over_resets(spark, seed):
    draw = random.Random(seed)
    rows, expected = [], []
    for cluster in ("east", "west"):
        for kind in ("x", None):
            value, reset, before = 100, START, None
            for n in range(60):
                at = START + dt.timedelta(hours=7 * n + draw.randint(0, 5))
                if draw.random() < 0.15:
                    value, reset = 0, (at if draw.random() < 0.6 else reset)
                value += draw.randint(0, 50)
                shown = None if draw.random() < 0.1 else value
                step = None
                if before is not None and before[0] is not None and shown is not None:
                    step = shown if reset != before[1] or shown < before[0] else shown - before[0]
                rows.append((cluster, at, kind, reset, shown))
                expected.append((cluster, at, kind, step))
                before = (shown, reset)
    frame = spark.createDataFrame(rows, "cluster string, dtcol timestamp, kind string, stats_reset timestamp, reads long").repartition(5)
    steps = counters.counter_steps(frame, ["reads"], ["kind"])
    assert steps.columns == [*frame.columns, "reads_step"]
    assert sorted(map(str, (tuple(row) for row in steps.select("cluster", "dtcol", "kind", "reads_step").collect()))) == sorted(map(str, expected))
