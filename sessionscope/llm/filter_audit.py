"""Audit of how filters interact: what each removes in every order of application.

Each document becomes a truth table of 32 bits: bit S is 1 if the document survives when the
filters of subset S are applied. Adding such words position by position (carry-save adders,
64 words at a time bit-sliced into planes) gives the survivors of every subset, and every
number of the audit is a difference of survivors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored, word_count

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Truth table of the documents that fail filter i only: the subsets without it.
PASSES = [sum(1 << s for s in range(SUBSETS) if not s >> i & 1) for i in range(len(FILTERS))]
#: Characters that filter D looks for.
MARKUP = r"[#$%&*|]"


def own_failures(text: Column) -> Column:
    """Failures of filters A to D as a number of four bits; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = word_count(text)
    distinct = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))
    fails = [
        words < 200,
        100 * distinct < 50 * words,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        text.rlike(MARKUP),
    ]
    bits = [F.when(fail, 1 << at).otherwise(0) for at, fail in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def survival_words(failures: np.ndarray) -> np.ndarray:
    """The truth table of each set of failures: the conjunction of what every failed filter leaves."""
    words = np.full(len(failures), 2**SUBSETS - 1, dtype=np.uint32)
    for at, passes in enumerate(PASSES):
        words[failures >> at & 1 == 1] &= np.uint32(passes)
    return words


def _adder(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save: the sum and the carry of three words in each bit position."""
    half = a ^ b
    return half ^ c, a & b | half & c


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of ``words`` have each bit set.

    Planes of weight 1, 2, 4 ... are reduced three to one by carry-save adders, whole arrays
    at a time, until one word a plane is left; only these few are unpacked.
    """
    totals = np.zeros(SUBSETS, dtype=np.int64)
    plane, weight = words.astype(np.uint32), 1
    while len(plane):
        carries = []
        while len(plane) > 1:
            third = len(plane) // 3
            if not third:
                carries.append(plane[:1] & plane[1:])
                plane = plane[:1] ^ plane[1:]
                break
            added, carry = _adder(plane[:third], plane[third : 2 * third], plane[2 * third : 3 * third])
            carries.append(carry)
            plane = np.concatenate([added, plane[3 * third :]])
        totals += weight * (plane[0] >> np.arange(SUBSETS, dtype=np.uint32) & 1).astype(np.int64)
        plane, weight = np.concatenate(carries) if carries else plane[:0], 2 * weight
    return totals


def weighted_counts(words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The same where each word stands for several documents, by the binary digits of their number."""
    totals = np.zeros(SUBSETS, dtype=np.int64)
    for digit in range(int(weights.max()).bit_length() if len(weights) else 0):
        totals += positional_counts(words[weights >> digit & 1 == 1]) << digit
    return totals


def _weights() -> list[int]:
    """In how many of the orders a subset of each size, less the filter itself, comes before a filter."""
    from math import factorial

    return [factorial(size) * factorial(len(FILTERS) - 1 - size) for size in range(len(FILTERS))]


def survivors(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
              part_column: str = "lang") -> DataFrame:
    """``part, good, toxic, left``: documents that survive each of the 32 subsets of filters.

    Filter E fails a document whose text a document with a smaller id has too, anywhere in
    the table. A null text is empty; a null id is never smaller or larger than another; rows
    that repeat an id and text are no copies of each other but all count; a null part is the
    empty text. A document is good (toxic) if any of its label rows says 1. Texts travel as their
    SHA-256. Documents of one text, part and label are added up before they are shuffled by
    text, so a text that a third of all rows share is a few rows; documents without an id are
    spread over all tasks of the join with the labels.
    """
    by_text = lambda name: F.sha2(F.coalesce(F.col(name), F.lit("")), 256)
    prepared = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"),
                           F.coalesce(F.col(f"`{part_column}`").cast("string"), F.lit("")).alias("part"))
    rows = (
        prepared.select("id", "part", by_text("text").alias("key"), own_failures(F.col("text")).alias("fails"))
        .groupBy("id", "part", "key", "fails").agg(F.count("*").alias("n"))
        .withColumn("label_key", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("none "), "key")))
    )
    marks = (
        labels.groupBy(F.col(id_column).cast("string").alias("label_key"))
        .agg(*[F.max(F.coalesce((F.col(name) == 1).cast("int"), F.lit(0))).alias(of) for of, name in (("good", "quality"), ("toxic", "toxic"))])
        .filter("label_key IS NOT NULL AND (good = 1 OR toxic = 1)")
    )
    alike = stored(
        rows.join(marks, "label_key", "left")
        .groupBy("key", "part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("unnamed"),
             F.min("id").alias("least"), F.min_by("n", "id").alias("firsts")),
        "alike",
    )
    least = alike.groupBy("key").agg(F.min("least").alias("first"))
    parted = alike.join(least, "key").select(
        "part", "good", "toxic", "fails",
        (F.coalesce("unnamed", F.lit(0)) + F.when(F.col("least") == F.col("first"), F.col("firsts")).otherwise(0)).alias("kept"), "n",
    )
    last = 1 << FILTERS.index("E")
    weighed = parted.select(
        "part", "good", "toxic",
        F.explode(F.array(F.struct("fails", F.col("kept").alias("n")), F.struct((F.col("fails") + last).alias("fails"), (F.col("n") - F.col("kept")).alias("n")))).alias("w"),
    ).select("part", "good", "toxic", "w.fails", "w.n").filter("n > 0")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = pa.Table.from_batches([batch]).select(["part", "good", "toxic"]).to_pylist()
            numbers: dict[tuple, int] = {}
            group = np.array([numbers.setdefault(tuple(g.values()), len(numbers)) for g in groups])
            words = survival_words(batch.column("fails").to_numpy(zero_copy_only=False))
            weights = batch.column("n").to_numpy(zero_copy_only=False)
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order], prepend=-1)).tolist() + [len(order)]
            found = [weighted_counts(words[order[a:b]], weights[order[a:b]]) for a, b in zip(cuts, cuts[1:])]
            keys = list(numbers)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[at] for key in keys], type=kind) for at, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
                + [pa.array([counts.tolist() for counts in found], type=pa.list_(pa.int64()))],
                ["part", "good", "toxic", "left"],
            )

    partial = weighed.mapInArrow(run, "part string, good int, toxic int, left array<bigint>")
    sums = [F.sum(F.col("left")[subset]).alias(f"s{subset}") for subset in range(SUBSETS)]
    return partial.groupBy("part", "good", "toxic").agg(*sums).select(
        "part", "good", "toxic", F.array(*[f"s{subset}" for subset in range(SUBSETS)]).alias("left")
    )


def audit_rows(part: str, left: dict[tuple[int, int], list[int]]) -> dict[str, list]:
    """The audit of one part, as columns, from the survivors of each (good, toxic)."""
    total = sum(np.array(counts, dtype=np.int64) for counts in left.values())
    nothing = np.zeros(SUBSETS, dtype=np.int64)
    good = sum((np.array(counts) for (is_good, _), counts in left.items() if is_good), nothing)
    toxic = sum((np.array(counts) for (_, is_toxic), counts in left.items() if is_toxic), nothing)
    every, weights = SUBSETS - 1, _weights()
    shares = [
        sum(weights[s.bit_count()] * int(total[s] - total[s | 1 << f]) for s in range(SUBSETS) if not s >> f & 1)
        for f in range(len(FILTERS))
    ]
    columns: dict[str, list] = {name: [] for name, _ in AUDIT}
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, start=1):
            after = before | 1 << f
            removed = total[before] - total[after]
            values = (
                part, "".join(FILTERS[i] for i in order), step, total[after], removed, total[0] - total[1 << f] - removed,
                total[every ^ 1 << f] - total[every], good[before] - good[after], toxic[before] - toxic[after], shares[f],
            )
            for name, value in zip(columns, values):
                columns[name].append(value if isinstance(value, str) else int(value))
            before = after
    return columns


AUDIT = [("part", "string"), ("filter_order", "string"), ("step", "int"), *[
    (name, "long") for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
]]


def audit_filters(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  part_column: str = "lang") -> DataFrame:
    """One row for each part, order of the five filters and step; see ``survivors`` for the cases.

    ``kept`` and ``removed`` count documents after and at the step, ``redundant`` those that fail
    the step's filter but went before, ``unique_fails`` those that fail no other filter,
    ``good_lost`` and ``toxic_lost`` the labelled ones among the removed, ``shapley`` the filter's
    removals in all 120 orders together. An empty table gives no rows.
    """
    left = survivors(docs, labels, id_column, text_column, part_column)
    parts = left.groupBy("part").agg(F.collect_list(F.struct("good", "toxic", "left")).alias("classes"))  # four at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        for batch in batches:
            for row in batch.to_pylist():
                columns = audit_rows(row["part"], {(c["good"], c["toxic"]): c["left"] for c in row["classes"]})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[name], type=kinds[kind]) for name, kind in AUDIT], [name for name, _ in AUDIT]
                )

    return parts.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in AUDIT))
