"""History tables, flat files and streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionscope.functions.scalars import instant
from sessionscope.operators import filters
from sessionscope.operators.enrich import carry_memory
from sessionscope.schema import CLUSTER_INFORMATION, DERIVED_COLUMNS
from sessionscope.sources import flatfile
from sessionscope.sources import history as H
from sessionscope.sources import text_index
from sessionscope.streaming import aas
from sessionscope.streaming import collect as collecting
from sessionscope.streaming.collect import stream_collect, write_batch

START = dt.datetime(2024, 1, 1)


def hours(spark, numbers):
    rows = [(START + dt.timedelta(hours=n), n) for n in numbers]
    return spark.createDataFrame(rows, "dtcol timestamp, pid bigint")


def pids(spark, path):
    return sorted(row.pid for row in H.read_history(spark, path).collect())


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    H.append_samples(hours(spark, range(0, 96)), path)
    return path


def test_append_and_repeat(spark, tmp_path):
    path = str(tmp_path / "table")
    H.append_samples(hours(spark, range(0, 30)), path, batch=0)
    H.append_samples(hours(spark, range(30, 40)), path, batch=1)
    H.append_samples(hours(spark, range(30, 40)), path, batch=1)
    assert pids(spark, path) == list(range(40))
    assert H.partition_days(spark, path) == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]


def test_lookup_columns_get_bloom_filters(spark, tmp_path):
    sizes = []
    for lookup in ((), ("pid",)):
        path = tmp_path / f"table{len(lookup)}"
        H.append_samples(hours(spark, range(24)), str(path), lookup=lookup)
        assert pids(spark, str(path)) == list(range(24))
        sizes.append(sum(file.stat().st_size for file in path.rglob("*.parquet")))
    assert sizes[1] > sizes[0] + 1000


@pytest.mark.parametrize("days", [1, 2, 3, 9])
def test_retain(spark, table, days):
    now = START + dt.timedelta(days=3) - dt.timedelta(minutes=30)
    cutoff = now - dt.timedelta(days=days)
    kept = [n for n in range(96) if START + dt.timedelta(hours=n) >= cutoff]
    expected = 96 - len(kept)
    assert H.retain(spark, table, days, now) == expected
    assert pids(spark, table) == kept
    assert H.retain(spark, table, days, now) == 0
    assert pids(spark, table) == kept


def test_retain_drops_an_emptied_boundary_day(spark, table):
    assert H.retain(spark, table, 0, START) == 96
    assert H.partition_days(spark, table) == []


def test_retain_where_nothing_of_the_boundary_day_survives(spark, tmp_path):
    path = str(tmp_path / "table")
    H.append_samples(hours(spark, [0, 1, 30]), path)
    assert H.retain(spark, path, 1, START + dt.timedelta(days=1, hours=12)) == 2
    assert H.partition_days(spark, path) == [dt.date(2024, 1, 2)]


def test_retain_keeps_batches_of_the_boundary_day(spark, tmp_path):
    path = str(tmp_path / "table")
    H.append_samples(hours(spark, range(0, 12)), path, batch=0)
    H.append_samples(hours(spark, range(12, 24)), path, batch=1)
    now = START + dt.timedelta(days=1, hours=14)
    assert H.retain(spark, path, 1, now) == 14
    assert pids(spark, path) == list(range(14, 24))


def test_retain_all_skips_missing_tables(spark, table, tmp_path):
    deleted = H.retain_all(spark, {"samples": table, "absent": str(tmp_path / "none")}, 1, START + dt.timedelta(days=2))
    assert deleted == {"samples": 24}


def test_drop_old_partitions(spark, table):
    dropped = H.drop_old_partitions(spark, table, 1, START + dt.timedelta(days=3, hours=5))
    assert dropped == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    assert pids(spark, table) == list(range(48, 96))


def test_create_like(spark, tmp_path):
    path = str(tmp_path / "table")
    empty = H.create_like(spark, hours(spark, [1]), path, DERIVED_COLUMNS)
    assert empty.count() == 0
    assert empty.columns == ["dtcol", "pid", *DERIVED_COLUMNS.names, *H.PLACEMENT]
    H.append_samples(hours(spark, [5]), path)
    again = H.create_like(spark, hours(spark, [1]), path, DERIVED_COLUMNS)
    assert [(row.pid, row.iquery, row.blockers) for row in again.collect()] == [(5, None, None)]


def test_fixed_table(spark, tmp_path):
    inventory = spark.createDataFrame([], CLUSTER_INFORMATION)
    assert H.create_like(spark, inventory, str(tmp_path / "info")).columns == [
        *CLUSTER_INFORMATION.names, *H.PLACEMENT
    ]


def test_daily_partitions(spark):
    rows = H.daily_partitions(spark, "t", dt.date(2023, 12, 31), 1).orderBy("lower_bound").collect()
    assert [row.partition_name for row in rows] == [
        "t_2023_12_31_2024_01_01", "t_2024_01_01_2024_01_02", "t_2024_01_02_2024_01_03",
    ]


def test_union_clusters(spark):
    frame = H.union_clusters({"a": hours(spark, [1]), "b": hours(spark, [2]).drop("pid")})
    assert {(row.cluster, row.pid) for row in frame.collect()} == {("a", 1), ("b", None)}


AWKWARD = ["plain", "tab\there", "line\nend\r", "back\\slash", "\\N", "\\t", "\\\\t", "", None, "é\\n\n"]


def test_flat_round_trip(spark, tmp_path):
    rows = [(START + dt.timedelta(seconds=n), n, text) for n, text in enumerate(AWKWARD)]
    frame = spark.createDataFrame(rows, "dtcol timestamp, pid bigint, query string")
    path, table, checkpoint = (str(tmp_path / name) for name in ("flat", "table", "offsets"))
    flatfile.dump_flat(frame, path)
    lines = [row.value for row in spark.read.text(path).collect()]
    assert len(lines) == len(AWKWARD)
    assert "2024-01-01 00:00:01\t1\ttab\\there" in lines and "2024-01-01 00:00:08\t8\t\\N" in lines
    for _ in range(2):
        flatfile.load_flat(spark, path, frame.schema, table, checkpoint)
        found = H.read_history(spark, table).orderBy("pid").collect()
        assert [row["query"] for row in found] == AWKWARD


RAW = (
    "dtcol timestamp, datid bigint, pid bigint, leader_pid bigint, state string, wait_event_type string, "
    "application_name string, backend_type string, query string, query_id bigint, pourcentage_cpu double, "
    "mem bigint, swapped bigint"
)


def raw_samples(seed=3, count=40):
    draw, rows = random.Random(seed), []
    for n in range(count):
        at = START + dt.timedelta(hours=23, minutes=59) + dt.timedelta(seconds=10 * n)
        rows.append((at, None, None, None, None, None, None, None, None, None, 5.0, None, None))
        for pid in range(1, 6):
            if draw.random() < 0.7:
                state = "active" if draw.random() < 0.9 else "idle"
                rows.append((at, 1, pid, None, state, None, "web", "client backend", f"q {pid}", None, 1.0,
                             draw.randint(0, 99), draw.randint(0, 99)))
    return rows


def test_stream_equals_batch(spark, tmp_path):
    rows = raw_samples()
    raw, table, checkpoint = (str(tmp_path / name) for name in ("raw", "table", "offsets"))
    frame = spark.createDataFrame(rows, RAW)
    bounds = sorted({row[0] for row in rows})[::9] + [START + dt.timedelta(days=9)]
    for low, high in zip(bounds, bounds[1:]):
        part = frame.filter((F.col("dtcol") >= instant(low)) & (F.col("dtcol") < instant(high)))
        part.write.mode("append").parquet(raw)
        stream_collect(spark.readStream.schema(frame.schema).parquet(raw), table, checkpoint, 10)
        stream_collect(spark.readStream.schema(frame.schema).parquet(raw), table, checkpoint, 10)
    stored = H.read_history(spark, table)
    active = frame.filter("state = 'active'")
    expected = carry_memory(active.select("dtcol", "pid", "mem", "swapped"), 10)
    got = stored.filter("pid is not null").select("dtcol", "pid", "mem", "swapped")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert stored.filter("pid is null").count() == 40


def test_streamed_load_in_any_order(spark, tmp_path):
    rows = raw_samples(4)
    frame = spark.createDataFrame(rows, RAW)
    expected = aas.with_average(aas.windowed_load(frame, "1 minute", "1 hour"))
    raw, path, checkpoint = (str(tmp_path / name) for name in ("raw", "load", "offsets"))
    random.Random(5).shuffle(rows)
    for start in range(0, len(rows), 60):
        spark.createDataFrame(rows[start:start + 60], RAW).write.mode("append").parquet(raw)
        aas.stream_aas(
            spark.readStream.schema(frame.schema).parquet(raw), path, checkpoint, "1 minute", "1 day"
        )
    assert sorted(aas.read_aas(spark, path).collect()) == sorted(expected.collect())
    assert aas.read_aas(spark, path).agg(F.sum("samples")).first()[0] == 40


def test_writers_do_not_touch_each_other(spark, tmp_path):
    path = str(tmp_path / "table")
    for writer in ("one", "two"):
        for _ in range(2):
            H.append_samples(hours(spark, range(30)), path, writer, 0)
    H.append_samples(hours(spark, [1]), path)
    H.append_samples(hours(spark, [1]), path)
    assert pids(spark, path) == sorted([*range(30)] * 2 + [1, 1])
    assert H.read_history(spark, path).columns[-3:] == ["day", "writer", "batch"]


def test_days_do_not_depend_on_the_session_zone(spark, tmp_path):
    path, zone = str(tmp_path / "table"), spark.conf.get("spark.sql.session.timeZone")
    at = [START.replace(tzinfo=dt.timezone.utc) + dt.timedelta(hours=n) for n in range(48)]
    try:
        for n, name in enumerate(("UTC", "America/New_York", "Asia/Tokyo")):
            spark.conf.set("spark.sql.session.timeZone", name)
            H.append_samples(spark.createDataFrame([(when, n) for when in at], "dtcol timestamp, pid bigint"), path)
        assert H.partition_days(spark, path) == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
        found = filters.window_scan(H.read_history(spark, path), at[20], at[30])
        assert found.count() == 33
        assert H.retain(spark, path, 1, START + dt.timedelta(days=1, hours=5)) == 15
        assert H.read_history(spark, path).count() == 3 * 48 - 15
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_reading_lists_only_the_days_asked_for(spark, table):
    some = H.read_history(spark, table, dt.date(2024, 1, 2), dt.date(2024, 1, 3))
    assert sorted(row.pid for row in some.collect()) == list(range(24, 72))
    assert all("day=2024-01-02" in name or "day=2024-01-03" in name for name in some.inputFiles())


def test_compact(spark, tmp_path):
    path = str(tmp_path / "table")
    for batch in range(6):
        H.append_samples(hours(spark, range(4 * batch, 4 * batch + 4)), path, "loop", batch)
    H.compact(spark, path, dt.date(2024, 1, 1))
    H.compact(spark, path, dt.date(2030, 1, 1))
    assert pids(spark, path) == list(range(24))
    assert {(row.writer, row.batch) for row in H.read_history(spark, path).collect()} == {("loop", batch) for batch in range(6)}
    assert len({name.rpartition("/")[0] for name in H.read_history(spark, path).inputFiles()}) == 1
    assert H.merged_days(spark, path) == [dt.date(2024, 1, 1)]


def test_a_batch_is_not_repeated_after_maintenance(spark, tmp_path):
    """A batch over midnight of which one day is merged, twice; a new batch and another writer still come in."""
    path = str(tmp_path / "table")
    for _ in range(2):
        H.append_samples(hours(spark, range(20, 30)), path, "loop", 0)
        H.compact(spark, path, dt.date(2024, 1, 1))
    H.append_samples(hours(spark, range(10, 12)), path, "loop", 1)
    H.append_samples(hours(spark, range(12, 14)), path, "other", 0)
    assert pids(spark, path) == [*range(10, 14), *range(20, 30)]
    H.retain(spark, path, 1, START + dt.timedelta(days=1, hours=22))
    for _ in range(2):
        H.append_samples(hours(spark, range(20, 30)), path, "loop", 0)
        H.append_samples(hours(spark, range(10, 12)), path, "loop", 1)
    assert pids(spark, path) == list(range(22, 30))
    H.drop_old_partitions(spark, path, 0, START + dt.timedelta(days=1))
    assert H.merged_days(spark, path) == [] and pids(spark, path) == list(range(24, 30))


def test_memory_goes_on_over_a_merged_midnight(spark, tmp_path):
    rows = [(START + dt.timedelta(hours=n), 5, 7, float(n), n, n, "active", None, "q", None, None) for n in range(20, 29)]
    schema = ("dtcol timestamp, datid bigint, pid bigint, pourcentage_cpu double, mem bigint, swapped bigint, state string, "
              "wait_event_type string, query string, query_id bigint, application_name string")
    samples, path = spark.createDataFrame(rows, schema), str(tmp_path / "table")
    midnight = START + dt.timedelta(days=1)
    parts = [samples.filter(F.col("dtcol") < midnight), samples.filter(F.col("dtcol") >= midnight)]
    for number, part in enumerate(parts):
        write_batch(part, path, "own", number, 3600)
        H.compact(spark, path, dt.date(2024, 1, 1))
        write_batch(part, path, "own", number, 3600)
    found = H.read_history(spark, path).collect()
    assert len(found) == 9 and {row.mem for row in found} == {20}


def test_marks_of_old_batches_go(spark, tmp_path):
    path = str(tmp_path / "table")
    H.append_samples(hours(spark, range(2)), path, "own", 0)
    for name in ("own-1", "own-2", "own-10", "other-1"):
        spark.range(1).write.parquet(f"{path}/_done/{name}")
    H.forget_done(spark, path, "own", 10)
    assert H.folder_names(spark, f"{path}/_done/*") == ["other-1", "own-10"]


def test_text_index_reads_files_with_the_words_only(spark, tmp_path):
    path = str(tmp_path / "table")

    def day(number, *queries):
        rows = [(START + dt.timedelta(days=number, hours=n), n, query) for n, query in enumerate(queries)]
        return spark.createDataFrame(rows, "dtcol timestamp, pid bigint, query string")

    H.append_samples(day(0, "select apple", "select pear"), path, "own", 0)
    H.append_samples(day(1, "apple pear", "plum", "pear"), path, "own", 1)
    H.append_samples(day(2, "apple", None, "select"), path, "own", 2)
    assert text_index.candidate_files(spark, path, ["apple"]) == sorted(H.read_history(spark, path).inputFiles())
    assert text_index.update_index(spark, path) == 3 and text_index.update_index(spark, path) == 0

    def search(words, **options):
        rows = text_index.text_search(spark, path, words, **options).collect()
        return len(text_index.candidate_files(spark, path, words, **options)), sorted(row.query for row in rows)

    assert search(["plum"]) == (1, ["plum"])
    assert search(["Apple"]) == (3, ["apple", "apple pear", "select apple"])
    assert search(["apple", "pear"]) == (1, ["apple pear"])  # on day 0 the words are at different instants
    assert search(["plum", "select"], every=False) == (3, ["plum", "select", "select apple", "select pear"])
    assert search(["apple"], start="2024-01-02 00:00:00", end="2024-01-02 23:00:00") == (1, ["apple pear"])
    assert search(["fig"]) == (0, [])
    H.append_samples(day(3, "fig apple"), path, "own", 3)  # not indexed yet: searched as it is
    assert search(["fig"]) == (1, ["fig apple"])
    H.compact(spark, path, dt.date(2024, 1, 2))  # replaces an indexed file
    assert search(["plum"]) == (2, ["plum"])
    assert text_index.update_index(spark, path) == 2
    assert search(["plum"]) == (1, ["plum"]) and search(["fig"]) == (1, ["fig apple"])


def test_a_replacement_that_fails_half_way_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    H.append_samples(hours(spark, range(24)), path, "loop", 0)
    write = H._write
    monkeypatch.setattr(H, "_write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        H.compact(spark, path, dt.date(2024, 1, 1))
    monkeypatch.setattr(H, "_write", write)
    assert pids(spark, path) == list(range(24))
    assert pids(spark, path) == list(range(24))


def test_columns_of_later_writers_join_the_table(spark, tmp_path):
    path = str(tmp_path / "table")
    H.append_samples(hours(spark, [1]), path)
    H.append_samples(hours(spark, [2]).withColumn("mem", F.lit(7)), path)
    H.append_samples(hours(spark, [3]).withColumn("mem", F.lit("8")), path)
    assert {(row.pid, row.mem) for row in H.read_history(spark, path).collect()} == {(1, None), (2, 7), (3, 8)}


@pytest.mark.parametrize("seed", range(3))
def test_late_samples_give_the_same_memory(spark, tmp_path, seed):
    """Drops in any order end in the rows that all samples at once give, and nothing is left behind."""
    rows = raw_samples(seed)
    raw, table, checkpoint = (str(tmp_path / name) for name in ("raw", "table", "offsets"))
    frame = spark.createDataFrame(rows, RAW)
    instants = sorted({row[0] for row in rows})
    random.Random(seed).shuffle(instants)
    for part in (instants[:15], instants[15:30], instants[30:]):
        some = [row for row in rows if row[0] in part]
        spark.createDataFrame(some, RAW).write.mode("append").parquet(raw)
        stream_collect(spark.readStream.schema(frame.schema).parquet(raw), table, checkpoint, 10)
    active = frame.filter("state = 'active'")
    expected = carry_memory(active.select("dtcol", "pid", "mem", "swapped"), 10)
    stored = H.read_history(spark, table)
    got = stored.filter("pid is not null").select("dtcol", "pid", "mem", "swapped")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert stored.filter("pid is null").count() == 40
    assert not list((tmp_path / "table" / "_pending").glob("*")) and not list((tmp_path / "table").glob("_locks/*"))


def test_a_repeated_late_batch_changes_nothing(spark, tmp_path):
    table, frame = str(tmp_path / "table"), spark.createDataFrame(raw_samples(9), RAW)
    noon = instant(START + dt.timedelta(hours=24, minutes=2))
    write_batch(frame.filter(F.col("dtcol") >= noon), table, "w", 0, 10)
    for _ in range(2):
        write_batch(frame.filter(F.col("dtcol") < noon), table, "w", 1, 10)
        rows = sorted(map(str, H.read_history(spark, table).drop("batch", "application_info").collect()))
        if _:
            assert rows == before
        before = rows
    assert H.read_history(spark, table).filter("pid is null").count() == 40


def planned(monkeypatch, name, place):
    """The plan of the rows that a batch hands to a function."""
    plans, original = [], getattr(collecting, name)

    def watched(*arguments):
        plans.append(arguments[place]._jdf.queryExecution().optimizedPlan().toString())
        return original(*arguments)

    monkeypatch.setattr(collecting, name, watched)
    return plans


def test_memory_is_not_part_of_a_batch_plan(spark, tmp_path, monkeypatch):
    """The driver plans the carried memory apart from the rows, and lets go of a batch when it is stored."""
    frame, raw, table = spark.createDataFrame(raw_samples(), RAW), str(tmp_path / "raw"), str(tmp_path / "table")
    plans, released = planned(monkeypatch, "append_samples", 0), []
    monkeypatch.setattr(collecting, "release", released.append)
    frame.write.parquet(raw)
    stream_collect(spark.readStream.schema(frame.schema).parquet(raw), table, str(tmp_path / "offsets"), 10)
    assert len(plans) == len(released) == 1 and "Window" not in plans[0]


def test_late_batch_plan_reads_what_was_collected(spark, tmp_path, monkeypatch):
    """Collecting is planned once, not with every use of its rows."""
    frame, table = spark.createDataFrame(raw_samples(), RAW), str(tmp_path / "table")
    middle = sorted(row.dtcol for row in frame.select("dtcol").distinct().collect())[5]
    plans = planned(monkeypatch, "replace_rows", 2)
    write_batch(frame.filter(F.col("dtcol") >= middle), table, "w", 0, 10)
    write_batch(frame.filter(F.col("dtcol") < middle), table, "w", 1, 10)
    assert len(plans) == 1 and "regexp_replace" not in plans[0]
