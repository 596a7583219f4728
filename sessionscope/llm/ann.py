"""Nearest neighbours by a forest of random-projection trees and exact reranking.

The trees are fitted on a bounded sample and sent to the tasks; every vector is put into
its leaf in each tree. A query walks all trees through one priority queue: a branch is as
promising as the smallest margin on its way, and leaves are taken until they are expected
to hold ``search`` of all vectors. Leaves and visits meet by (tree, leaf) and are scored
exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import group_starts, stored, whole_groups
from .vectors import fixed_sample, matrix, unit_rows, usable

TREES = 16
LEAF_ROWS = 256
SAMPLE_ROWS = 65_536
#: Share of the leaves (over all trees together) that a query visits.
SEARCH = 0.06
#: Rows of a leaf that are scored at once.
BLOCK_ROWS = 2_048
#: Results that a task combines before it hands them on.
COMBINED_ROWS = 100_000


@dataclass
class RandomTrees:
    """Complete binary trees: one direction per tree and level, one threshold per inner node."""

    directions: np.ndarray  # trees x depth x dimension
    thresholds: np.ndarray  # trees x (2 ** depth - 1), nodes in heap order

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def margins(self, unit: np.ndarray) -> np.ndarray:
        """rows x trees x depth: where each row falls on each direction."""
        trees, depth, dimension = self.directions.shape
        return (unit @ self.directions.reshape(-1, dimension).T).reshape(len(unit), trees, depth)

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """rows x trees: the leaf of each row."""
        margins = self.margins(unit)
        node = np.zeros(margins.shape[:2], dtype=np.int64)
        trees = np.arange(margins.shape[1])
        for level in range(self.depth):
            node = 2 * node + 1 + (margins[:, :, level] > self.thresholds[trees, node])
        return node - (2**self.depth - 1)

    def visits(self, margins: np.ndarray, most: int) -> list[tuple[int, int]]:
        """The leaves of one query, (tree, leaf), most promising first, over all trees."""
        inner = self.thresholds.shape[1]
        queue = [(-np.inf, tree, 0, 0) for tree in range(len(margins))]
        thresholds, found = self.thresholds, []
        while queue and len(found) < most:
            worth, tree, node, level = heapq.heappop(queue)
            if node >= inner:
                found.append((tree, node - inner))
                continue
            margin = float(margins[tree, level] - thresholds[tree, node])
            right = margin > 0
            heapq.heappush(queue, (worth, tree, 2 * node + 1 + right, level + 1))
            heapq.heappush(queue, (max(worth, abs(margin)), tree, 2 * node + 2 - right, level + 1))
        return found


def fit_trees(sample: np.ndarray, trees: int, depth: int, seed: int = 5) -> RandomTrees:
    """Directions at random, thresholds at the median of the sample rows of each node."""
    rng = np.random.default_rng(seed)
    dimension = sample.shape[1]
    directions = rng.normal(size=(trees, depth, dimension))
    directions /= np.sqrt((directions**2).sum(axis=2, keepdims=True))
    thresholds = np.zeros((trees, 2**depth - 1))
    for tree in range(trees):
        node = np.zeros(len(sample), dtype=np.int64)
        for level in range(depth):
            at = sample @ directions[tree, level]
            order = np.lexsort((at, node))
            first = np.searchsorted(node[order], np.arange(2**level - 1, 2 ** (level + 1) - 1))
            count = np.diff(np.append(first, len(sample)))
            filled = count > 0
            middle = np.minimum(first + (count - 1) // 2, len(sample) - 1)
            upper = np.minimum(first + count // 2, len(sample) - 1)
            values = (at[order[middle]] + at[order[upper]]) / 2
            thresholds[tree, 2**level - 1 : 2 ** (level + 1) - 1] = np.where(filled, values, 0.0)
            node = 2 * node + 1 + (at > thresholds[tree, node])
    return RandomTrees(directions, thresholds)


def placed_type(classes: DataFrame) -> str:
    kind = classes.schema["vector"].dataType.simpleString()
    return f"tree int, leaf long, query boolean, class string, least long, vector {kind}"


def in_leaves(classes: DataFrame, forest: RandomTrees, queries: bool, most: int) -> DataFrame:
    """Each class in its leaf of every tree, or each query class in the leaves it visits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                unit = unit_rows(matrix(part.column(2)))
                if queries:
                    margins = forest.margins(unit)
                    found = [(row, *visit) for row in range(len(unit)) for visit in forest.visits(margins[row], most)]
                    rows, tree, leaf = (np.array(values, dtype=np.int64) for values in zip(*found))
                else:
                    leaves = forest.leaves(unit)
                    rows, tree = (values.ravel() for values in np.indices(leaves.shape))
                    leaf = leaves.ravel()
                for at in range(0, len(rows), 8192):
                    some = slice(at, at + 8192)
                    take = pa.array(rows[some])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(tree[some].astype(np.int32)), pa.array(leaf[some]),
                            pa.array(np.full(len(take), queries)), part.column(0).take(take), part.column(1).take(take),
                            part.column(2).take(take),
                        ],
                        ["tree", "leaf", "query", "class", "least", "vector"],
                    )

    return classes.select("class", "least", "vector").mapInArrow(run, placed_type(classes))


def score_leaves(batches: Iterable[pa.RecordBatch], nearest: int) -> Iterator[pa.RecordBatch]:
    """The best ``nearest`` classes for each query among the leaves of a partition, scored exactly.

    A query visits many leaves; what it finds in them is combined here, before the shuffle.
    """
    held: list[pa.RecordBatch] = []
    for found in _score_each_leaf(batches, nearest):
        held.append(found)
        if sum(part.num_rows for part in held) > COMBINED_ROWS:
            held = [_best_of(held, nearest)]
            if held[0].num_rows > COMBINED_ROWS // 2:
                yield held.pop()
    if held:
        yield _best_of(held, nearest)


def _best_of(parts: list[pa.RecordBatch], nearest: int) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts).to_pandas()
    rows = rows.sort_values(["asking", "score", "least"], ascending=[True, False, True], kind="stable")
    rows = rows.drop_duplicates(["asking", "class"]).groupby("asking", sort=False).head(nearest)
    return pa.RecordBatch.from_pandas(rows, schema=parts[0].schema, preserve_index=False)


def _score_each_leaf(batches: Iterable[pa.RecordBatch], nearest: int) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["tree", "leaf"], least_rows=4_096):
        starts = group_starts(table, ["tree", "leaf"]).tolist()
        for low, high in zip(starts, [*starts[1:], table.num_rows]):
            leaf = table.slice(low, high - low)
            asks = leaf.column("query").to_numpy()
            if asks.all() or not asks.any():
                continue
            rows = matrix(leaf.column("vector"))
            unit = unit_rows(rows)
            least = leaf.column("least").to_numpy()
            candidates, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
            candidates = candidates[np.argsort(least[candidates], kind="stable")]
            out_query, out_class, out_score = [], [], []
            for at in range(0, len(queries), BLOCK_ROWS):
                some = queries[at : at + BLOCK_ROWS]
                scores = unit[some] @ unit[candidates].T
                keep = min(nearest, len(candidates))
                bar = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
                # rounding of the block product may differ in the last place from the exact score
                a, b = np.nonzero(scores >= bar[:, None] - 1e-12)
                exact = cosine(rows[some[a]], rows[candidates[b]])
                order = np.lexsort((b, -exact, a))
                rank = np.arange(len(a)) - np.searchsorted(a[order], a[order])
                best = order[rank < keep]
                out_query.append(some[a[best]])
                out_class.append(candidates[b[best]])
                out_score.append(exact[best])
            take_query, take_class = pa.array(np.concatenate(out_query)), pa.array(np.concatenate(out_class))
            names = leaf.column("class")
            yield pa.RecordBatch.from_arrays(
                [
                    names.take(take_query).combine_chunks(), names.take(take_class).combine_chunks(),
                    leaf.column("least").take(take_class).combine_chunks(), pa.array(np.concatenate(out_score)),
                ],
                ["asking", "class", "least", "score"],
            )


def cosine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosine of paired rows in doubles, the same for a pair wherever it is computed."""
    left = left / np.abs(left).max(axis=1, keepdims=True)
    right = right / np.abs(right).max(axis=1, keepdims=True)
    dot = np.einsum("ij,ij->i", left, right)
    return dot / np.sqrt(np.einsum("ij,ij->i", left, left) * np.einsum("ij,ij->i", right, right))


def nearest_neighbours(
    vectors: DataFrame, is_query, id_column: str = "vec_id", vector_column: str = "embedding", nearest: int = 5,
    trees: int = TREES, leaf_rows: int = LEAF_ROWS, search: float = SEARCH, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: up to ``nearest`` neighbours of each row where ``is_query`` holds.

    Every row is indexed; candidates are all rows with another id. The score is the cosine
    in doubles of the original vectors; equal scores go to the smaller id. The search is
    approximate: it finds what is in the visited leaves (see README for measured recall).

    Identical vectors are one class that carries its ``nearest + 1`` smallest ids, all that
    a query can return of it, so no leaf fills with copies. The trees are fitted on at most
    ``sample_rows`` vectors (the smallest hashes). Their depth follows the number of classes
    and ends where a sample leaf would have less than two rows.

    Vectors that are null, empty, zero, or hold null or non-finite components, and null ids
    take no part; vectors of another length than the commonest are searched exactly, among
    their own. A query with no candidate returns nothing; an empty table gives no rows.
    """
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"), is_query.alias("asks")
    ).filter(usable("vector") & F.col("id").isNotNull())
    named = rows.withColumn("class", F.md5(F.to_json(F.struct("vector"))))
    top = Window.partitionBy("class").orderBy("id")
    classes = stored(
        named.select("id", "class", "vector")
        .dropDuplicates(["class", "id"])
        .withColumn("place", F.row_number().over(top))
        .filter(F.col("place") <= nearest + 1)
        .groupBy("class")
        .agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids")),
        "classes",
    ).withColumn("least", F.col("ids")[0])
    asking = named.filter("asks").select(F.col("id").alias("query_id"), "class").distinct()
    dimension, sample = fixed_sample(classes, "vector", sample_rows)
    regular = F.size("vector") == dimension
    query_classes = classes.join(asking.select("class").distinct(), "class", "left_semi")
    if len(sample):
        leaves = min(classes.count() / leaf_rows, len(sample) / 2)
        forest = fit_trees(unit_rows(sample), trees, max(0, int(np.ceil(np.log2(max(leaves, 1))))))
        most = max(trees, int(np.ceil(search * trees * 2**forest.depth)))
        placed = in_leaves(classes.filter(regular), forest, False, most).unionAll(
            in_leaves(query_classes.filter(regular), forest, True, most)
        )
        other = lambda frame, asks: frame.filter(~regular).select(
            F.lit(-1).alias("tree"), F.size("vector").cast("long").alias("leaf"), F.lit(asks).alias("query"), "class",
            "least", "vector",
        )
        placed = placed.unionAll(other(classes, False)).unionAll(other(query_classes, True))
    else:
        placed = classes.sparkSession.createDataFrame([], placed_type(classes))
    scored = (
        placed.repartition("tree", "leaf")
        .sortWithinPartitions("tree", "leaf")
        .mapInArrow(lambda batches: score_leaves(batches, nearest + 1), "asking string, class string, least long, score double")
    )
    best = Window.partitionBy("asking").orderBy(F.desc("score"), "least")
    chosen = (
        scored.groupBy("asking", "class", "least")
        .agg(F.max("score").alias("score"))
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= nearest + 1)
        .join(classes.select("class", "ids"), "class")
        .select("asking", "score", F.explode("ids").alias("vec_id"))
    )
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        chosen.join(asking.withColumnRenamed("class", "asking"), "asking")
        .filter(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= nearest)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
