"""Flat files as a Spark data source: round trips, splits, growing files, commits."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from sessionscope.sources import flat_source, flatfile

SCHEMA = "dtcol timestamp, pid bigint, query string, cpu double, busy boolean"
AT = dt.datetime(2024, 1, 1, 10, 30)


@pytest.fixture
def rows(spark):
    flat_source.register(spark)
    texts = ["plain", "", None, "a\tb", "line\nend\r", "back\\slash \\n \\N", "\\N", "é x", "x" * 3000]
    made = [(AT + dt.timedelta(minutes=n), n if n % 5 else None, texts[n % len(texts)], n / 4, None if n % 7 == 0 else n % 2 == 0) for n in range(200)]
    return spark.createDataFrame(made, SCHEMA).repartition(3)


def read(spark, path, **options):
    return spark.read.format("flat_samples").schema(SCHEMA).options(**options).load(path)


def same(left, right):
    return sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


@pytest.mark.parametrize("split", [64 << 20, 1000, 37])
def test_round_trip(spark, rows, tmp_path, split):
    path = str(tmp_path / "flat")
    rows.write.format("flat_samples").mode("append").save(path)
    assert same(read(spark, path, split_bytes=split), rows)
    assert not any(name.startswith("_") and os.listdir(f"{path}/{name}") for name in os.listdir(path))


def test_reads_what_the_text_writer_wrote_and_the_reverse(spark, rows, tmp_path):
    theirs, ours = str(tmp_path / "theirs"), str(tmp_path / "ours")
    flatfile.dump_flat(rows.filter("query not like '% %' or query is null"), theirs)
    assert same(read(spark, theirs, split_bytes=500), rows.filter("query not like '% %' or query is null"))
    rows.write.format("flat_samples").mode("append").save(ours)
    back = flatfile.parse_lines(spark.read.option("lineSep", "\n").text(ours), rows.schema)
    assert same(back, rows)


def test_append_and_overwrite(spark, rows, tmp_path):
    path = str(tmp_path / "flat")
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        rows.write.format("flat_samples").mode(mode).save(path)
        assert read(spark, path).count() == 200 * times


def test_a_job_that_fails_adds_no_line(spark, rows, tmp_path):
    path = str(tmp_path / "flat")
    rows.write.format("flat_samples").mode("append").save(path)
    failing = rows.withColumn("query", F.when(F.col("pid") == 199, F.raise_error(F.lit("lost"))).otherwise(F.col("query")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        failing.write.format("flat_samples").mode("append").save(path)
    assert read(spark, path).count() == 200
    assert os.listdir(f"{path}/_writing") == []


def test_a_stream_follows_a_growing_file_once(spark, rows, tmp_path):
    path, out = tmp_path / "flat", str(tmp_path / "out")
    path.mkdir()
    lines = [row.value for row in flatfile.flat_lines(rows.coalesce(1)).collect()]

    def run():
        stream = spark.readStream.format("flat_samples").schema(SCHEMA).option("split_bytes", 700).load(str(path))
        (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "offsets"))
         .trigger(once=True).start().awaitTermination())
        return spark.read.schema(SCHEMA).parquet(out).count()

    with open(path / "a.txt", "w", newline="") as file:
        file.write("\n".join(lines[:50]) + "\n" + lines[50][:4])  # the last line is not whole yet
    assert run() == 50
    assert run() == 50
    with open(path / "a.txt", "a", newline="") as file:
        file.write(lines[50][4:] + "\n" + "\n".join(lines[51:120]) + "\n")
    with open(path / "b.txt", "w", newline="") as file:
        file.write("\n".join(lines[120:]) + "\n")
    assert run() == 200
    assert same(spark.read.schema(SCHEMA).parquet(out), rows)


def test_short_lines_and_empty_folders(spark, rows, tmp_path):
    path = tmp_path / "flat"
    assert read(spark, str(path)).collect() == []
    path.mkdir()
    (path / "a.txt").write_text("2024-01-01 10:30:00\t5\n\\N\t\\N\tq\t1.5\ttrue\n")
    assert {tuple(row) for row in read(spark, str(path)).collect()} == {(AT, 5, None, None, None), (None, None, "q", 1.5, True)}
