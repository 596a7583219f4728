"""Numbering, thinning and early stop."""

import datetime as dt
import random

import pytest

from sessionscope.operators import series as S

START = dt.datetime(2024, 1, 1, 22, 30)


def instants(spark, minutes):
    rows = [(START + dt.timedelta(minutes=minute), 1) for minute in minutes]
    return spark.createDataFrame(rows, "dtcol timestamp, pid bigint")


def test_numbers_run_on_over_hours(spark):
    draw = random.Random(1)
    minutes = draw.sample(range(2000), 150)
    found = S.number_instants(instants(spark, minutes + minutes[:20])).orderBy("dtcol").collect()
    assert [row.i for row in found] == list(range(1, 151))
    assert {row["last"] for row in found} == {150}


@pytest.mark.parametrize("every, kept", [(4, [1, 4, 8, 10]), (None, [1, 10]), (100, [1, 10]), (1, list(range(1, 11)))])
def test_thin(spark, every, kept):
    samples = instants(spark, [7 * n for n in range(10)] * 2)
    found = S.thin_snapshots(samples, every).orderBy("dtcol").collect()
    positions = [int((row.dtcol - START).total_seconds() // 420) + 1 for row in found]
    assert positions == sorted(kept * 2)


def brute_end(present, count, streak):
    empty = 0
    for position in range(count):
        empty = 0 if position in present else empty + 1
        if empty >= streak:
            return position
    return None


@pytest.mark.parametrize("seed", range(4))
def test_stop_after_empty(spark, seed):
    draw = random.Random(seed)
    present = {n for n in range(200) if draw.random() < 0.6}
    planned = S.planned_instants(spark, START, 200, 60)
    samples = instants(spark, present)
    streak = seed + 1
    end = brute_end(present, 200, streak)
    kept = [n for n in present if end is None or n <= end]
    assert S.stop_after_empty(samples, planned, streak).count() == len(kept)
    taken = S.effective_iterations(samples, planned, streak).first().iterations
    assert taken == (200 if end is None else end + 1)


def test_never_stops(spark):
    planned = S.planned_instants(spark, START, 30, 60)
    samples = instants(spark, range(30))
    assert S.stop_after_empty(samples, planned, 1).count() == 30
    assert S.effective_iterations(samples, planned).first().iterations == 30


def test_planned_iterations():
    assert S.planned_iterations(5, 10, batch=False) == 50
    assert S.planned_iterations(5, 10, batch=True) == 43200
    assert S.planned_iterations(0, 10, batch=True) == 1
    assert S.planned_iterations(5, 0, batch=False) == 5000
