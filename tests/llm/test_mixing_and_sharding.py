"""Mixing to target weights and the two-pass shuffle."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from sessionscope.llm import mixing
from sessionscope.llm.mixing import mix, mixed_documents, source_targets
from sessionscope.llm.oracle import SELECTS
from sessionscope.llm.queries import QUERIES
from sessionscope.llm.sharding import shard_documents
from tests.check import connect, oracle_rows, spark_rows
from tests.llm.conftest import SF_DIR


def shared_out(sizes, weights=(5, 2, 1), most=3):
    """Reshare the excess of sources at their bound until none is above it."""
    order = sorted(sizes, key=lambda source: (source is None, source or ""))
    weight = {source: weights[at % len(weights)] for at, source in enumerate(order)}
    bound, target = {}, {}
    free, left = set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        for s in over:
            target[s] = bound[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(5))
def test_targets(spark, seed):
    draw = random.Random(seed)
    sizes = {f"s{n}": draw.choice([0, 1, 5, draw.randint(1, 10_000)]) for n in range(draw.randint(1, 12))}
    sizes[None] = draw.randint(0, 300)
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {row.source: row.target for row in source_targets(rows).collect()}
    expected = shared_out(sizes)
    assert found.keys() == expected.keys()
    assert all(abs(found[s] - expected[s]) <= 1e-6 * max(1, expected[s]) for s in found)


@pytest.mark.parametrize("cell_rows", [1_000, 3])
def test_dirty_mix(dirty, cell_rows):
    rows = mix(dirty, cell_rows=cell_rows).collect()
    assert len(rows) == dirty.count()
    sizes, taken, targets = Counter(), Counter(), {}
    for row in rows:
        assert 0 <= row.taken <= 3 * row.size
        sizes[row.source] += row.size
        taken[row.source] += row.taken
        targets[row.source] = row.target
    expected = shared_out(sizes)
    for source in sizes:
        assert abs(targets[source] - expected[source]) < 1e-6 * max(1, expected[source])
        assert abs(taken[source] - targets[source]) <= 0.5
    again = mix(dirty.repartition(5), cell_rows=50).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_rows_without_an_id_are_counted(spark):
    """The mix of a line in which most rows agree, row by row, and what one cell has of them."""
    draw = random.Random(4)
    rows = [(None, "a " * draw.choice([1, 2, 5]), "s") for _ in range(900)]
    rows += [(draw.choice([n, 3]), "b " * draw.randint(0, 9), draw.choice(["s", "t", None])) for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = mix(docs, cell_rows=10).collect()
    budgets = {row.source: int(row.target + 0.5) for row in found}
    expected = Counter()
    for source, budget in budgets.items():
        key = lambda number: int(md5(f"11:{'' if number is None else number}".encode()).hexdigest()[:15], 16)
        line = sorted((key(number), number or 0, len(text.split()), number) for number, text, of in rows if of == source)
        total, at = sum(size for _, _, size, _ in line), 0
        epochs, rest = divmod(budget, max(total, 1))
        for _, _, size, number in line:
            expected[number, source, size, epochs * size + min(max(rest - at, 0), size)] += 1
            at += size
    assert Counter((row.id, row.source, row.size, row.taken) for row in found) == expected
    sized = docs.select(
        F.col("doc_id").alias("id"), "source", mixing.word_count("text").alias("size"), mixing.random_key(11, "doc_id").alias("key")
    )
    cells = mixing.counted_cells(sized, 10)
    assert cells.agg(F.sum("n")).first()[0] == len(rows)
    assert cells.groupBy("source", "cell").count().agg(F.max("count")).first()[0] < 100


def test_mixed_documents(dirty, nothing):
    mixed = mixed_documents(dirty)
    assert mixed.columns == dirty.columns
    taken = {(row.id, row.source, row.size): row.taken for row in mix(dirty).collect()}
    words = F.coalesce(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0))
    counts = Counter((r.doc_id, r.source, r.size) for r in mixed.withColumn("size", words).collect())
    for (number, source, size), count in counts.items():
        if number not in (3, 7):  # ids that rows repeat
            assert abs(count * size - taken[number, source, size]) <= size / 2
    assert mixed_documents(nothing).collect() == []


def test_mix_query_equals_sql(spark):
    expected = oracle_rows(connect(SF_DIR), SELECTS["op5_mix_sources"])
    assert spark_rows(QUERIES["op5_mix_sources"](spark, SF_DIR)) == expected


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 2_000])
def test_shards(dirty, bucket_bytes):
    written = shard_documents(dirty, shards=4, bucket_bytes=bucket_bytes)
    rows = written.collect()
    slots = defaultdict(list)
    for row in rows:
        slots[row.shard].append(row.slot)
    sizes = [len(some) for some in slots.values()]
    assert sum(sizes) == dirty.count() and max(sizes) - min(sizes) <= 1
    assert all(sorted(some) == list(range(len(some))) for some in slots.values())
    assert Counter(row.record for row in rows) == Counter(dirty.collect())
    again = shard_documents(dirty.repartition(2), shards=4, bucket_bytes=bucket_bytes).collect()
    assert Counter(rows) == Counter(again)
    other = shard_documents(dirty, shards=4, bucket_bytes=bucket_bytes, seed=99).collect()
    assert Counter(rows) != Counter(other)


def test_repeated_rows_are_spread(spark):
    """Rows that repeat id and text, alike or not in the other columns, do not lie side by side."""
    rows = [(None, None, 0)] * 3000 + [(None, None, n) for n in range(1, 1001)] + [(n, "x" * 3, n) for n in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(3)
    found = shard_documents(docs, shards=4, bucket_bytes=250).collect()
    assert Counter(tuple(row.record) for row in found) == Counter(rows)
    slots = defaultdict(list)
    for row in found:
        slots[row.shard].append(row.slot)
    assert all(sorted(some) == list(range(1250)) for some in slots.values()) and len(slots) == 4
    for kept, expected in ((lambda place, i: i is None and place == 0, 750), (lambda place, i: i is None and place > 0, 250)):
        counts = Counter(row.shard for row in found if kept(row.record.place, row.record.doc_id))
        assert all(expected * 0.7 < counts[shard] < expected * 1.3 for shard in range(4))
    again = shard_documents(docs.repartition(5), shards=4, bucket_bytes=250).collect()
    assert Counter(found) == Counter(again)


def test_shards_need_no_python(dirty, nothing):
    plan = shard_documents(dirty)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert shard_documents(nothing).collect() == []


def test_shard_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op9_shard"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for row in rows:
        data = texts[row.doc_id].encode()
        assert (row.size, row.text_crc32, row.law, row.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
