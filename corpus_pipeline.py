"""A corpus pipeline out of the operators in ``sessionscope.llm``.

``STAGES`` are applied in order; each takes ``(spark, docs, sf_dir)`` and works on all rows
that its predecessor kept, read again from the Parquet table they were written to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.llm.bpe import round_trip
from sessionscope.llm.common import stored
from sessionscope.llm.mixing import mixed_documents
from sessionscope.llm.simhash import keep_representatives
from sessionscope.llm.suffix_dedup import remove_repeats
from sessionscope.llm.toxicity import toxicity


#: Bytes of a repeat that is cut out. A passage of over 50 words of prose has more (271 at least
#: among those of the given tables), so every one that stands in two documents is found.
PASSAGE_BYTES = 240


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity(docs, labels).filter(F.col("predicted") == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return keep_representatives(docs).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of ``PASSAGE_BYTES`` bytes that stand anywhere else are cut out of every text."""
    text = F.col("kept").alias("text")
    changed = {"text": text, "n_chars": F.length("kept").cast("long").alias("n_chars")}
    return remove_repeats(docs, length=PASSAGE_BYTES, as_text=True).select(*[changed.get(name, F.col(name)) for name in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions; a document comes as often as the mix takes it."""
    return mixed_documents(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and digests of the ids and of the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = round_trip(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN, with_ids=True)
    return encoded.select("doc_id", "source", "n_tokens", "ids_sha256", "ids", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mixing_sources", mix_sources),
    ("byte_level_bpe", encode),
]

#: SQL cannot express a trained classifier or a tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
