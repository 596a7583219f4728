"""Keyed streaming state: the counted series, side tables, carried memory."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sessionscope.operators import series
from sessionscope.operators.enrich import carry_memory
from sessionscope.sources import history as H
from sessionscope.streaming import side_tables
from sessionscope.streaming.collect import stream_collect_state
from sessionscope.streaming.state import MemoryCarrier, TickCounter, carry_memory_stream, keyed_state

START = dt.datetime(2024, 1, 1)


class Value:
    """A value state held in memory."""

    def __init__(self):
        self.now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    def update(self, value):
        self.now = tuple(value)

    def clear(self):
        self.now = None


class Handle:
    def __init__(self):
        self.value, self.timers = Value(), set()

    def getValueState(self, name, schema):  # noqa: N802
        return self.value

    def registerTimer(self, due):  # noqa: N802
        self.timers.add(due)

    def deleteTimer(self, due):  # noqa: N802
        self.timers.discard(due)


def started(processor):
    handle = Handle()
    processor.init(handle)
    return processor, handle


def ticks(counter, *rows):
    rows = [Row(at=at, sessions=sessions, beats=beats) for at, sessions, beats in rows]
    return [(row.at, row.i, row.sessions, row.stopped, row.last) for row in counter.handleInputRows(("",), iter(rows), None)]


def test_counter_goes_on_over_batches_and_adds_parts_up():
    counter, _ = started(TickCounter(None, None))
    assert ticks(counter, (20, 1, 0), (10, 2, 1), (20, 0, 1), (20, 3, 0)) == [(10, 1, 2, False, False), (20, 2, 4, False, False)]
    assert ticks(counter, (15, 9, 1), (20, 1, 1), (30, 0, 1)) == [(30, 3, 0, False, False)]  # late and repeated: no number
    assert ticks(counter, (40, 5, 0)) == []  # sessions without a heartbeat are no sample yet


@pytest.mark.parametrize("seed", range(5))
def test_counter_ends_where_the_batch_operator_does(seed):
    draw = random.Random(seed)
    present = [draw.random() < 0.6 for _ in range(120)]
    streak, empty, end = 1 + seed % 3, 0, None
    for at, busy in enumerate(present):
        empty = 0 if busy else empty + 1
        if empty >= streak:
            end = at
            break
    counter, _ = started(TickCounter(streak, None))
    found, at = [], 0
    while at < len(present):
        step = draw.randint(1, 20)
        found += ticks(counter, *[(n, int(present[n]), 1) for n in range(at, min(at + step, len(present)))])
        at += step
    assert [row[0] for row in found] == list(range(len(present) if end is None else end + 1))
    assert [row[3] for row in found].count(True) == (end is not None)


def test_counter_ends_a_planned_series():
    counter, _ = started(TickCounter(None, 3))
    assert [row[4] for row in ticks(counter, *[(n, 1, 1) for n in range(9)])] == [False, False, True]
    assert ticks(counter, (99, 1, 1)) == []


def memory(carrier, key, rows, names=("dtcol", "pid", "mem", "swapped")):
    made = carrier.handleInputRows(key, iter([Row(*row) for row in rows]), None)
    return [tuple(row[name] for name in names) for row in made]


def test_late_memory_rows():
    carrier, _ = started(MemoryCarrier(100, ["dtcol", "pid", "mem", "swapped"]))
    assert memory(carrier, (7,), [(1000, 7, 5, 50), (1090, 7, 6, 60)]) == [(1000, 7, 5, 50), (1090, 7, 5, 50)]
    assert memory(carrier, (7,), [(1040, 7, 8, 80)]) == [(1040, 7, 5, 50)]  # late inside the run
    assert memory(carrier, (7,), [(950, 7, 9, 90)]) == [(950, 7, 9, 90)]  # late, before the run
    assert memory(carrier, (7,), [(1189, 7, 1, 10)]) == [(1189, 7, 5, 50)]
    assert memory(carrier, (7,), [(1289, 7, 2, 20)]) == [(1289, 7, 2, 20)]  # unseen for the horizon
    assert memory(carrier, (None,), [(1300, None, None, None)]) == [(1300, None, None, None)]


def test_a_timer_drops_the_state():
    carrier, handle = started(MemoryCarrier(100_000, ["dtcol", "pid", "mem", "swapped"]))
    memory(carrier, (7,), [(0, 7, 5, 50)])
    memory(carrier, (7,), [(50_000, 7, 5, 50)])
    assert handle.timers == {151}
    assert list(carrier.handleExpiredTimer((7,), None, None)) == [] and not handle.value.exists()


@pytest.fixture
def raw(spark, tmp_path):
    """Samples of two clusters with gaps; ``drop(rows)`` lets some arrive and gives the stream over all."""
    draw = random.Random(3)
    rows = []
    for cluster in ("east", "west"):
        for n in range(60):
            at = START + dt.timedelta(hours=n)
            rows.append((cluster, at, None, None, 1.0, None, None, None, "q"))
            for pid in (1, 2, 3):
                if draw.random() < 0.45:
                    rows.append((cluster, at, 1, pid, 1.0, draw.randint(1, 99), draw.randint(1, 99), at, "q"))
    schema = "cluster string, dtcol timestamp, datid long, pid long, pourcentage_cpu double, mem long, swapped long, query_start timestamp, query string"
    samples = spark.createDataFrame(rows, schema)

    def drop(part):
        part.write.mode("append").parquet(f"{tmp_path}/raw")
        return spark.readStream.schema(samples.schema).parquet(f"{tmp_path}/raw")

    return samples, drop, str(tmp_path)


def halves(samples, hour):
    limit = START + dt.timedelta(hours=hour)
    return samples.filter(F.col("dtcol") < limit), samples.filter(F.col("dtcol") >= limit)


def test_memory_on_a_stream(spark, raw):
    samples, drop, folder = raw
    with keyed_state(spark):
        for part in halves(samples, 31):
            (
                carry_memory_stream(drop(part), 7200, "1 hour").writeStream.outputMode("update")
                .foreachBatch(lambda batch, number: batch.write.mode("append").parquet(f"{folder}/out"))
                .option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
            )
    found = spark.read.parquet(f"{folder}/out")
    expected = carry_memory(samples.filter("pid is not null"), 3600).unionByName(samples.filter("pid is null"))
    assert sorted(map(str, found.select(*samples.columns).collect())) == sorted(map(str, expected.collect()))


def test_stop_and_side_tables_survive_a_failure(spark, raw):
    """The batch that failed half-way is repeated by the restart: nothing twice, nothing lost."""
    samples, drop, folder = raw
    sizes = samples.filter("pid is null").select("cluster", "dtcol", F.lit("db").alias("datname"), F.lit(1).alias("size"))
    made = []

    def failing(instants):
        made.append(1)
        if len(made) == 2:
            raise ValueError("lost")
        return side_tables.at_instants(sizes, instants)

    tables = [
        side_tables.snapshot_table(f"{folder}/samples", samples, at_stop=True),
        side_tables.SideTable(f"{folder}/sizes", failing, every=10),
    ]
    run = lambda stream: side_tables.stream_side_tables(stream, f"{folder}/ticks", f"{folder}/offsets", tables, streak=4)
    first, second = halves(samples, 12)
    run(drop(first))
    stream = drop(second)
    with pytest.raises(Exception, match="lost"):
        run(stream)
    run(stream)
    expected = series.stop_after_empty(samples, None, 4)
    kept = H.read_history(spark, f"{folder}/samples").select(*samples.columns)
    assert sorted(map(str, kept.collect())) == sorted(map(str, expected.collect()))
    taken = {row.cluster: row.iterations for row in series.effective_iterations(samples, None, 4).collect()}
    ticked = H.read_history(spark, f"{folder}/ticks").groupBy("cluster").count().collect()
    assert {row.cluster: row["count"] for row in ticked} == taken
    stopped = {row.cluster for row in H.read_history(spark, f"{folder}/ticks").filter("stopped").collect()}
    instants = {c: [1, *range(10, n + 1, 10)] for c, n in taken.items()}
    expected = {(c, START + dt.timedelta(hours=i - 1)) for c, numbers in instants.items() for i in numbers
                if not (c in stopped and i == taken[c])}
    assert {(row.cluster, row.dtcol) for row in H.read_history(spark, f"{folder}/sizes").collect()} == expected


def test_collection_with_state_keeps_clusters_and_restarts(spark, raw):
    samples, drop, folder = raw
    wide = samples.select(
        "*", F.lit("active").alias("state"), F.lit(None).cast("string").alias("wait_event_type"),
        F.lit("a,b,c,d,e,f").alias("application_name"), F.lit(None).cast("long").alias("query_id"),
    )
    for part in halves(wide, 20):
        part.write.mode("append").parquet(f"{folder}/wide")
        stream = spark.readStream.schema(wide.schema).parquet(f"{folder}/wide")
        for _ in range(2):  # nothing new: nothing added
            stream_collect_state(stream, f"{folder}/table", f"{folder}/state", 3600)
    found = H.read_history(spark, f"{folder}/table").select("cluster", "dtcol", "pid", "mem", "swapped")
    carried = carry_memory(samples.filter("pid is not null").select("cluster", "dtcol", "pid", "mem", "swapped"), 3600)
    expected = carried.unionByName(samples.filter("pid is null").select("cluster", "dtcol", "pid", "mem", "swapped"))
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
