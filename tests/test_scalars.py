"""Hand-worked scalar cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sessionscope.functions import scalars as S


def one(spark, column, **values):
    frame = spark.range(1)
    for name, value in values.items():
        frame = frame.withColumn(name, F.lit(value))
    return frame.select(column.alias("result")).first()["result"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("SELECT\n\t 1", "select 0"),
        ("select 'it\\'s' from t", "select '' from t"),
        ("select 'a''b'", "select ''"),
        ("where x = 12 and y=-3", "where x = 0 and y=0"),
        ("12 abc", "10 abc"),
        ("col12", "col10"),
        ("a-12", "a-0"),
        ("limit $1", "limit $0"),
        ("x = 0xff", "x = 0x"),
        ("v IN (1, 2, 3)", "v in (...)"),
        ("v in ('a', 'b')", "v in (...)"),
        ("min(0)", "min (...)"),
        ("x = NULL", "x = null"),
    ],
)
def test_normalize_query(spark, text, expected):
    assert one(spark, S.normalize_query(F.col("q")), q=text) == expected


@pytest.mark.parametrize("text", ["", "select 1", "é", "select 2", "select 3", "select 4"])
def test_query_hash(spark, text):
    word = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    signed = word - 2**32 if word >= 2**31 else word
    assert one(spark, S.query_hash(F.col("q")), q=text) == abs(signed)


def test_normalized_hash_prefers_query_id(spark):
    expected = one(spark, S.query_hash(F.col("q")), q="42")
    column = S.normalized_hash(F.col("i"), F.col("q"))
    assert one(spark, column, i=42, q="select") == expected
    assert one(spark, S.normalized_hash(F.lit(None), F.col("q")), q="42") == expected


@pytest.mark.parametrize(
    "size, expected",
    [
        (0, "0 bytes"),
        (10239, "10239 bytes"),
        (10240, "10 kB"),
        (10751, "10 kB"),
        (10752, "11 kB"),
        (10239 * 1024 + 511, "10239 kB"),
        (10239 * 1024 + 512, "10 MB"),
        (10 * 2**20, "10 MB"),
        (10239 * 2**20 + 2**19 - 1, "10239 MB"),
        (10239 * 2**20 + 2**19, "10 GB"),
        (20 * 2**40, "20 TB"),
        (10240 * 2**40, "10 PB"),
        (2**62, "4096 PB"),
        (-100, "-100 bytes"),
        (-20480, "-20 kB"),
    ],
)
def test_size_pretty(spark, size, expected):
    assert one(spark, S.size_pretty(F.col("s").cast("bigint")), s=size) == expected


def test_size_pretty_null(spark):
    assert one(spark, S.size_pretty(F.lit(None).cast("bigint"))) is None


@pytest.mark.parametrize(
    "unit, setting, expected",
    [("8kB", "16384", 134217728), ("kB", "64", None), ("1MB", "2", 2097152), ("16MB", "1", 16777216), ("2ms", "3", 0)],
)
def test_memory_setting(spark, unit, setting, expected):
    assert one(spark, S.memory_setting(F.col("u"), F.col("s")), u=unit, s=setting) == expected


def test_application_info(spark):
    column = S.application_info(F.col("a"))
    assert one(spark, column, a="p,m,,c,1,") == {
        "program": "p", "module": "m", "action": "", "client_info": "c", "sofar": "1", "totalwork": "",
    }
    assert one(spark, column, a="a,b,c,d,e") is None
    assert one(spark, column, a="a,b,c,d,e,f,g") is None


def test_tokens_drop_stop_words_and_repeats(spark):
    assert one(spark, S.query_tokens(F.col("q")), q="SELECT the x FROM t WHERE x = 1") == ["1", "select", "x"]


def test_rounding(spark):
    even = [one(spark, S.round_half_even(F.col("v")), v=value) for value in (0.5, 1.5, 2.5, -0.5)]
    assert even == [0.0, 2.0, 2.0, 0.0]
    away = [one(spark, S.round_half_away(F.col("v")), v=value) for value in (0.125, 0.375, -0.125)]
    assert away == [0.13, 0.38, -0.13]


def test_hash_hex(spark):
    assert one(spark, S.hash_hex(F.col("v").cast("bigint")), v=48879) == "beef"


def test_parse_counters_reads_exponents(spark):
    frame = spark.createDataFrame([("scputimes(user=1e-05, idle=7.0)",), ("svmem(total=5)",)], "raw string")
    rows = frame.select(*S.parse_counters(F.col("raw"), ["user", "idle"])).collect()
    assert [tuple(row) for row in rows] == [(1e-05, 7.0), (None, None)]


def test_memory_setting_without_a_number(spark):
    frame = spark.createDataFrame([("8kB", "on"), ("8kB", "2"), (None, "2")], "unit string, setting string")
    found = frame.select(S.memory_setting(F.col("unit"), F.col("setting")).alias("size")).collect()
    assert [row.size for row in found] == [None, 16384, None]
