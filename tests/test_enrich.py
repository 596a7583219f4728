"""Memory windows against brute force, filters, and the collection plan."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionscope.operators import enrich as E
from sessionscope.operators import filters

START = dt.datetime(2024, 1, 1, 23, 59, 0)


def random_probes(seed, count=60):
    """Irregular samples of three pids around midnight; pid 1 has most of them."""
    draw, at, rows = random.Random(seed), START, []
    for _ in range(count):
        at += dt.timedelta(seconds=draw.choice([1, 3, 10, 19, 20, 21, 40]))
        for pid in (1, 2, 3):
            if pid == 1 or draw.random() < 0.5:
                rows.append((at, pid, draw.randint(0, 1000), draw.randint(0, 1000)))
    return rows


def probes(spark, rows):
    return spark.createDataFrame(rows, "dtcol timestamp, pid bigint, mem bigint, swapped bigint")


@pytest.mark.parametrize("seed", range(3))
def test_recent_memory(spark, seed):
    rows = random_probes(seed)
    result = {(r.dtcol, r.pid): r.recent_mem for r in E.recent_memory(probes(spark, rows), 10).collect()}
    horizon = dt.timedelta(seconds=20)
    for at, pid, _, _ in rows:
        earlier = [mem for when, other, mem, _ in rows if other == pid and at - horizon < when < at]
        assert result[at, pid] == (round(sum(earlier) / len(earlier)) if earlier else None)


@pytest.mark.parametrize("seed", range(3))
def test_carry_memory_follows_the_recursive_rule(spark, seed):
    rows = random_probes(seed)
    stored = {}
    for at, pid, mem, swapped in sorted(rows):
        earlier = [v for (when, other), v in stored.items() if other == pid and when > at - dt.timedelta(seconds=20)]
        stored[at, pid] = (
            (sum(v[0] for v in earlier) / len(earlier), sum(v[1] for v in earlier) / len(earlier))
            if earlier
            else (mem, swapped)
        )
    result = {(r.dtcol, r.pid): (r.mem, r.swapped) for r in E.carry_memory(probes(spark, rows), 10).collect()}
    assert result == stored


def test_carry_memory_over_many_buckets(spark):
    """One run of a single pid over five days keeps its first value."""
    rows = [(START + dt.timedelta(seconds=600 * n), 1, n + 1, n) for n in range(5 * 144)]
    values = E.carry_memory(probes(spark, rows), 600).select("mem", "swapped").distinct().collect()
    assert [tuple(row) for row in values] == [(1, 0)]


def test_carry_memory_restarts_at_fresh_probes(spark):
    rows = [(START + dt.timedelta(seconds=10 * n), 1, n, n) for n in range(6)]
    result = E.carry_memory(probes(spark, rows), 10, fresh=F.col("mem") == 3).orderBy("dtcol").collect()
    assert [row.mem for row in result] == [0, 0, 0, 3, 3, 3]


def test_probe_needed(spark):
    rows = [(START + dt.timedelta(seconds=s), 1, 0, 0) for s in (0, 19, 39, 58)]
    needed = E.probe_needed(probes(spark, rows), 10).orderBy("dtcol").collect()
    assert [row.dtcol for row in needed] == [rows[0][0], rows[2][0]]


def test_null_pid_is_not_in_a_list(spark):
    samples = spark.createDataFrame(
        [(START, 1, "Lock"), (START, 2, "Timeout"), (START, 3, None), (START, None, None)],
        "dtcol timestamp, pid bigint, wait_event_type string",
    )
    assert sorted(row.pid for row in filters.not_idle(samples).collect()) == [1, 3]
    assert [row.pid for row in filters.pid_filter(samples, [2, 9]).collect()] == [2]


def test_cache_sampling_is_stable(spark):
    samples = spark.createDataFrame([(START, pid) for pid in range(400)], "dtcol timestamp, pid bigint")
    first = E.cache_sampling(samples).filter("use_cache").count()
    assert first == E.cache_sampling(samples.repartition(7)).filter("use_cache").count()
    assert 100 < first < 220


def test_window_scan_reads_only_its_days(spark, tmp_path):
    from sessionscope.sources.history import append_samples, read_history

    path = str(tmp_path / "table")
    append_samples(probes(spark, [(START + dt.timedelta(days=n), 1, n, n) for n in range(5)]), path)
    chosen = filters.window_scan(read_history(spark, path), "2024-01-02 00:00:00", START + dt.timedelta(days=2))
    assert sorted(row.mem for row in chosen.collect()) == [1, 2]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(dtcol)" in plan


@pytest.mark.parametrize("active, least, most", [(1, 0, 1), (998, 980, 998), (999, 985, 999), (2000, 1970, 2000)])
def test_cache_is_used_with_probability_active_in_a_thousand(spark, active, least, most):
    samples = spark.createDataFrame([(START, pid) for pid in range(active)], "dtcol timestamp, pid bigint")
    rows = E.cache_sampling(samples)
    assert rows.filter("use_cache <> (draw < least(active, 999))").isEmpty()
    assert least <= rows.filter("use_cache").count() <= most


def test_a_lone_session_uses_the_cache_once_in_a_thousand(spark):
    instants = [(START + dt.timedelta(seconds=n), 1) for n in range(20_000)]
    used = E.cache_sampling(spark.createDataFrame(instants, "dtcol timestamp, pid bigint")).filter("use_cache").count()
    assert 5 <= used <= 45


def test_draws_need_ten_seconds(spark):
    with pytest.raises(ValueError):
        E.carry_memory(probes(spark, [(START, 1, 1, 1)]), 5, fresh=F.lit(True))


def test_words_of_any_script(spark):
    samples = spark.createDataFrame([(START, 1, "SELECT * FROM café")], "dtcol timestamp, pid bigint, query string")
    assert filters.text_filter(samples, ["Café"]).count() == 1
    assert filters.text_filter(samples, ["caf"]).count() == 0
