"""A text index beside a history table: which files hold a word, and in which span of time.

Postings are rows ``(token, file, rows, first, last)`` in ``_index/postings``, in folders by the
update that made them and by a bucket of the token, so a search reads the buckets of its words
only. ``_index/files`` lists the files of every finished update; an update that was interrupted
has no list and counts for nothing. Files that are not listed yet are searched as they are, and
postings of files that maintenance has replaced meanwhile are passed over.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.functions.scalars import query_tokens
from sessionscope.operators.filters import text_filter, window_scan
from sessionscope.sources.history import folder_names, read_files, read_history

BUCKETS = 64


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def _listed(spark: SparkSession, path: str) -> dict[str, str]:
    """The files of the table now, by their place below the table's folder."""
    return {file[file.rindex("/day=") + 1 :]: file for file in read_history(spark, path).inputFiles()}


def _indexed(spark: SparkSession, path: str) -> DataFrame:
    """``(file, update)`` of every file in the index."""
    schema = "file string, update string"
    if not folder_names(spark, f"{path}/_index/files/update=*"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/_index/files")


def update_index(spark: SparkSession, path: str, text: str = "query") -> int:
    """Index the files of the table that are not indexed yet; return how many.

    One shuffle, of one row per word of a file. The list of files is Spark's own listing.
    """
    known = {row.file for row in _indexed(spark, path).select("file").collect()}
    new = {place: file for place, file in _listed(spark, path).items() if place not in known}
    if not new:
        return 0
    update = uuid.uuid4().hex
    place = F.regexp_extract("file", "/(day=[^/]*/writer=.*)$", 1)
    words = read_files(spark, path, list(new.values()), origin="file").select(
        place.alias("file"), "dtcol", F.explode(query_tokens(F.col(text))).alias("token")
    )
    postings = words.groupBy("token", "file").agg(
        F.count("*").alias("rows"), F.min("dtcol").alias("first"), F.max("dtcol").alias("last")
    )
    bucket = F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(BUCKETS)).cast("int")
    (
        postings.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "token")
        .write.partitionBy("bucket").parquet(f"{path}/_index/postings/update={update}")
    )
    spark.createDataFrame([(file,) for file in new], "file string").write.parquet(f"{path}/_index/files/update={update}")
    return len(new)


def candidate_files(
    spark: SparkSession, path: str, words: list[str], every: bool = True, start=None, end=None
) -> list[str]:
    """The files that can hold rows with every (or any) of the words inside the window, of those in the table now.

    Where every word is asked for, the words' spans of time in a file have to meet.
    """
    wanted = sorted({word.lower() for word in words})
    present, indexed = _listed(spark, path), _indexed(spark, path)
    known = {row.file for row in indexed.select("file").collect()} & present.keys()
    if not known:
        return sorted(present.values())
    postings = (
        spark.read.schema("token string, file string, rows long, first timestamp, last timestamp, update string, bucket int")
        .parquet(f"{path}/_index/postings")
        .filter(F.col("bucket").isin([_bucket(word) for word in wanted]) & F.col("token").isin(wanted))
        .join(indexed, ["file", "update"], "left_semi")
    )
    if start is not None:
        postings = postings.filter(F.col("last") >= F.lit(start).cast("timestamp"))
    if end is not None:
        postings = postings.filter(F.col("first") <= F.lit(end).cast("timestamp"))
    found = postings.groupBy("file").agg(
        F.countDistinct("token").alias("words"), F.max("first").alias("first"), F.min("last").alias("last")
    )
    if every:
        found = found.filter((F.col("words") == len(wanted)) & (F.col("first") <= F.col("last")))
    hits = {row.file for row in found.select("file").collect()} & known
    return sorted(present[place] for place in hits | (present.keys() - known))


def text_search(
    spark: SparkSession, path: str, words: list[str], every: bool = True, start=None, end=None
) -> DataFrame:
    """The rows of the table whose query has every (or any) of the words, from the files that can hold them.

    The same rows as ``text_filter`` over the whole table. Files are opened for the words they
    hold; inside a file, rows are in the order of ``dtcol``, which bounds the row groups read.
    """
    rows = read_files(spark, path, candidate_files(spark, path, words, every, start, end))
    if start is not None or end is not None:
        rows = window_scan(rows, start or "0001-01-01", end or "9999-12-31")
    return text_filter(rows, words, every)
