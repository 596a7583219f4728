"""Global shuffle into shards: two passes, DataFrame functions only.

Pass one scatters rows by a seeded hash into buckets that fit in memory (Spark's shuffle
files are the external storage). Pass two permutes each bucket by Spark's ``shuffle``
function, a seeded Fisher-Yates exchange, and writes it. Buckets in a row form one random
order of all rows; shard s has the rows at positions ceil(s N / S) up to ceil((s + 1) N / S).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_folder
from .common import stored

BUCKET_BYTES = 16 << 20
#: Equal rows that one task makes again from their number.
COPIES = 1_000


def _size(text: str):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_documents(
    docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text", seed: int = 17,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Shuffle ``docs`` and write them as shards; returns the written rows.

    The law is ``rows``: shards differ by one row at most. The result has the columns of
    ``docs`` inside the struct ``record``, with ``shard`` and ``slot`` (gapless from 0 in
    each shard), so columns of any name go through. Files are in folders by ``shard``,
    sorted by ``slot``.

    Null ids and texts, empty texts and repeated rows are rows like any other; an empty
    table gives empty shards. Which bucket a row falls into depends on the seed, the id
    and the text alone, and its place there on the sorted content of the bucket, so a task
    that runs again writes the same rows. Where the rows that repeat both id and text are
    more than a bucket, the bucket also depends on the whole row and on the number of its
    copy, so no bucket has them all.
    """
    spark = docs.sparkSession
    record = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    rows = docs.select(
        F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column)).alias("key"),
        _size(text_column).alias("size"),
        record.alias("record"),
    )
    total = docs.agg(F.sum(_size(text_column))).first()[0] or 0
    buckets = int(total // bucket_bytes) + 1
    rows = spread_copies(rows, bucket_bytes)
    place = F.when(F.col("copy") == 0, F.xxhash64(F.lit(seed + 1), "key")).otherwise(
        F.xxhash64(F.lit(seed + 1), "key", "record", "copy")
    )
    bucket = F.pmod(place, F.lit(buckets)).cast("int").alias("bucket")
    # the counts of the buckets give each bucket's first position: one row a bucket, ids and texts only hashed
    counts = rows.groupBy(bucket).agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(everything).alias("all")
    )
    # a bucket's offset travels with its rows, so they are scattered once and joined to nothing
    row = F.struct("key", "record")
    scattered = rows.select(bucket, row.alias("row")).unionByName(offsets, allowMissingColumns=True)
    placed = (
        scattered.repartitionById(buckets, F.col("bucket"))
        .groupBy("bucket")
        .agg(F.max("first").alias("first"), F.max("all").alias("all"), F.sort_array(F.collect_list("row")).alias("rows"))
        .select("first", "all", F.posexplode(F.shuffle("rows", seed)).alias("place", "row"))
        .withColumn("shard", F.expr(f"(first + place) * {int(shards)} div all").cast("int"))
        .withColumn("start", F.expr(f"(cast(shard as bigint) * all + {int(shards) - 1}) div {int(shards)}"))
        .select("row.record", (F.col("first") + F.col("place") - F.col("start")).alias("slot"), "shard")
    )
    path = write_shards(placed)
    return spark.read.schema(placed.schema).parquet(path)


def spread_copies(rows: DataFrame, bucket_bytes: int, copies: int = COPIES) -> DataFrame:
    """``key, record, copy`` of ``(key, size, record)``: copies are numbered where a key has more than a bucket.

    Such rows are counted, before the shuffle where they can be, and made again from their
    number in pieces of ``copies``; 0 is every row of the other keys.
    """
    of_key = rows.groupBy("key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > bucket_bytes).select("key")
    crowded = stored(of_key, "crowded")  # at most one row a bucket; the join sees how small it is
    if crowded.isEmpty():
        return rows.select("key", "record", F.lit(0).cast("long").alias("copy"))
    single = rows.join(crowded, "key", "left_anti").select("key", "record", F.lit(0).cast("long").alias("copy"))
    counted = rows.join(crowded, "key", "left_semi").groupBy("key", "record").agg(F.count("*").alias("n"))
    pieces = counted.select("key", "record", "n", F.explode(F.expr(f"sequence(0, (n - 1) div {copies})")).alias("piece"))
    numbers = F.expr(f"sequence(piece * {copies} + 1, least((piece + 1) * {copies}, n))")
    again = pieces.repartition("key", "piece").select("key", "record", F.explode(numbers).alias("copy"))
    return single.unionByName(again)


def write_shards(placed: DataFrame) -> str:
    """Write rows to one folder per shard, sorted by slot inside each file."""
    path = new_folder(placed.sparkSession, "shards")
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path
