"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Forest, group_starts, stored, text_bytes, whole_groups
from .components import connected_components

SEED = 42
#: Two fingerprints that differ in at most 3 bits agree in at least 3 of 6 blocks.
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
MOST_BITS = 3
#: Rows of a bucket that one task compares at once.
PIECE_ROWS = 4_096


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the word shingles: A-Z lower-cased, repeats counted, no words: zero.

    Fewer than ``words`` words are one shingle. A bit is 1 if it is set in more than half
    of the shingles' XXH64 values.
    """
    parts = text.lower().split()  # bytes.split parts at space and \\t .. \\r, bytes.lower changes A-Z only
    if not parts:
        return 0
    joined = b" ".join(parts)
    shingles = max(len(parts) - words + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:shingles].tolist()
    stops = (ends - 1)[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for low in range(0, shingles, 4096):  # a very long text is counted in pieces
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(starts[low : low + 4096], stops[low : low + 4096])], dtype="<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > shingles, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3) -> DataFrame:
    """``id, fingerprint`` (a signed long) for every row; a null text has no words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(text, words) for text in text_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fingerprint"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint long")


def hexadecimal(value: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def block_keys(value: str, block_bits: tuple[int, ...] = BLOCK_BITS, most_bits: int = MOST_BITS) -> Column:
    """The buckets of a fingerprint: one for each choice of the blocks that must agree."""
    shifts = np.concatenate(([0], np.cumsum(block_bits)[:-1])).tolist()
    kept = len(block_bits) - most_bits
    keys = []
    for number, chosen in enumerate(combinations(range(len(block_bits)), kept)):
        mask = sum(((1 << block_bits[b]) - 1) << shifts[b] for b in chosen)
        mask -= (mask >> 63) << 64  # as a signed long
        keys.append(F.xxhash64(F.lit(number), F.col(value).bitwiseAND(F.lit(mask).cast("long"))))
    return F.array(*keys)


def close_pairs(groups: Iterable[pa.RecordBatch], most_bits: int) -> Iterator[pa.RecordBatch]:
    """Compare the fingerprints of each bucket piece; keep a spanning forest of the links.

    Rows of the same group stand together; row i meets row i + d for every distance d that
    the groups allow, all groups at once.
    """
    for table in whole_groups(groups, ["bucket", "low", "high"]):
        starts = group_starts(table, ["bucket", "low", "high"])
        sizes = np.diff(np.append(starts, table.num_rows))
        values = table.column("fingerprint").to_numpy().view(np.uint64)
        room = np.repeat(starts + sizes, sizes) - np.arange(table.num_rows)  # rows from here to the group's end
        forest = Forest(table.num_rows)
        rows, distance = np.flatnonzero(room > 1), 1
        while len(rows):
            near = rows[np.bitwise_count(values[rows] ^ values[rows + distance]) <= most_bits]
            if len(near):
                forest.link(near, near + distance)
            distance += 1
            rows = rows[room[rows] > distance]
        child, root = forest.edges()
        signed = values.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[root])], ["a", "b"])


def link_fingerprints(classes: DataFrame, most_bits: int = MOST_BITS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Links ``a, b`` that connect exactly the distinct fingerprints within ``most_bits``.

    A bucket of more than ``piece_rows`` fingerprints is cut into pieces, and each pair of
    pieces is a group of its own, so no task holds more than two pieces of a bucket and
    every pair is still compared. Each group gives a spanning forest, never its pairs.
    """
    block_bits = BLOCK_BITS if most_bits == 3 else _even_blocks(most_bits)
    keyed = classes.select("fingerprint", F.explode(block_keys("fingerprint", block_bits, most_bits)).alias("bucket"))
    large = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > piece_rows)
    pieces = F.expr(f"coalesce((n + {piece_rows - 1}) div {piece_rows}, 1)").cast("int")
    piece = F.pmod(F.xxhash64("fingerprint", F.lit(7)), "pieces").cast("int")
    grouped = (
        keyed.join(large, "bucket", "left")
        .withColumn("pieces", pieces)
        .withColumn("piece", piece)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select("bucket", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), "fingerprint")
        .repartition("bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high")
    )
    return grouped.mapInArrow(lambda groups: close_pairs(groups, most_bits), "a long, b long")


def _even_blocks(most_bits: int) -> tuple[int, ...]:
    blocks = 2 * most_bits if most_bits else 1
    return tuple(64 // blocks + (block < 64 % blocks) for block in range(blocks))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, most_bits: int = MOST_BITS,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """``id, fingerprint, component_id`` for every row of ``docs``.

    Documents link if their fingerprints differ in at most ``most_bits`` bits;
    ``component_id`` is the smallest id reachable over links, itself included. Documents of
    equal fingerprint are one class from the start, so thousands of copies are one node.
    Null and empty texts have fingerprint zero and link like any other; repeated rows come
    out repeated; rows with a null id count for others' links, never as a smallest id
    (unless nothing else is there: then it is null). An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, id_column, text_column, words), "fingerprints")
    of_class = _least_ids(rows, most_bits, piece_rows)
    return rows.join(of_class, "fingerprint").select("id", "fingerprint", "component_id")


def _least_ids(rows: DataFrame, most_bits: int, piece_rows: int) -> DataFrame:
    """``fingerprint, component_id``: the least id of the component of each fingerprint."""
    classes = rows.groupBy("fingerprint").agg(F.min("id").alias("least_id"))
    components = connected_components(link_fingerprints(classes.select("fingerprint"), most_bits, piece_rows), "a", "b")
    named = classes.join(components, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least_id", F.coalesce("component", "fingerprint").alias("component")
    )
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return named.join(least, "component").select("fingerprint", "component_id")


def keep_representatives(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, most_bits: int = MOST_BITS,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest id.

    Rows are named by their id and the hash of their text: of the rows of a group that share
    the smallest id, the text of the least hash stays, and rows that repeat both count once.
    Rows without an id come after all others; a group that has no other rows keeps one of
    them.
    """
    named = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        F.struct(
            F.col(id_column).isNull().alias("nameless"), F.col(id_column).alias("id"), F.xxhash64(text_column).alias("hash")
        ).alias("name"),
        F.col(text_column).alias("text"),
    )
    rows = stored(fingerprints(named, "name", "text", words), "fingerprints")
    kept = _least_ids(rows, most_bits, piece_rows).select(F.col("component_id").alias("kept")).distinct()
    same = F.expr("name.nameless = kept.nameless and name.id <=> kept.id and name.hash = kept.hash")
    single = named.join(kept, same, "left_semi").dropDuplicates(["name"])
    return single.select(*[F.col(f"row.`{name}`") for name in docs.columns])
