"""The corpus pipeline, stage by stage."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sessionscope.llm.bpe import read_ranks
from sessionscope.llm.common import stored
from tests.llm.conftest import SF_DIR
from tests.llm.test_simhash import components, slow_fingerprint
from tests.llm.test_suffix_dedup import brute


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], SF_DIR), name))
    return tables


def texts_of(table):
    return {row.doc_id: row.text for row in table.collect()}


def test_registered():
    names = entry.queries()
    assert all(any(name.startswith(f"op{number}_") for name in names) for number in range(1, 14))
    assert names["pipeline"] is corpus_pipeline.run
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing_sources", "byte_level_bpe"
    ]


def test_columns(outputs):
    assert all(table.columns == outputs[0].columns for table in outputs[:-1])


def test_toxic_documents_go(outputs):
    assert 0.6 * outputs[0].count() < outputs[1].count() <= outputs[0].count()
    assert texts_of(outputs[1]).items() <= texts_of(outputs[0]).items()


def test_one_document_of_each_group(outputs):
    before, after = texts_of(outputs[1]), texts_of(outputs[2])
    ids = sorted(before)
    groups = components([slow_fingerprint(before[number]) for number in ids])
    least = {}
    for number, group in zip(ids, groups):
        least.setdefault(group, number)
    assert set(after) == set(least.values()) and after.items() <= before.items()


def test_repeats_are_cut(outputs):
    before, after = texts_of(outputs[2]), texts_of(outputs[3])
    ids = sorted(before)
    expected = brute([before[number].encode() for number in ids], corpus_pipeline.PASSAGE_BYTES)
    assert after == {number: kept[3].decode("utf-8", "ignore") for number, kept in zip(ids, expected)}
    assert outputs[3].filter(F.length("text") != F.col("n_chars")).isEmpty()


def test_passages_of_over_fifty_words_are_cut(spark):
    """Each text of ``benchmark`` with over 50 words, planted in two documents with other words around it."""
    passages = [row.text for row in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    passages = [text for text in passages if len(text.split()) > 50]
    assert len(passages) > 30
    rows = [(2 * n + side, f"{n} {side} before {passage} after {side} {n}", "en", "s", 0)
            for n, passage in enumerate(passages) for side in (0, 1)]
    rows.append((1_000, "a clean text " * 5, "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = texts_of(corpus_pipeline.cut_repeats(spark, docs, SF_DIR))
    assert left[1_000] == rows[-1][1]
    for n, passage in enumerate(passages):
        assert passage not in left[2 * n] and passage not in left[2 * n + 1]
        assert len(left[2 * n].encode()) < 40


def test_mix(outputs):
    before, after = texts_of(outputs[3]), texts_of(outputs[4])
    assert after.items() <= before.items()
    assert outputs[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_encoding(outputs):
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = texts_of(outputs[4])
    rows = outputs[5].collect()
    assert len(rows) == outputs[4].count()
    for row in rows:
        assert row.ids == library.encode_ordinary(texts[row.doc_id])
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
