"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, components.

Cells are exact: a vector also visits every other cell in which a vector close enough could
live. If c is the centre nearest to x and c' the centre nearest to y, and the angle between
x and y is at most a, then x . (c - c') <= sin(a) |c - c'|. So x visits the cells c' that
satisfy this, and the pair meets in the smaller of the two cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, group_starts, stored, whole_groups
from .components import connected_components
from .vectors import fixed_sample, matrix, unit_rows, usable

THRESHOLD = 0.93
BLOCK_ROWS = 2_048
SAMPLE_ROWS = 20_000
MOST_CELLS = 1_024
ROUNDS = 8


def spherical_kmeans(rows: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Unit centres of the unit rows; a cell that loses its rows keeps its centre."""
    centres = rows[np.random.default_rng(seed).choice(len(rows), size=min(cells, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        sizes = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        filled = sizes > 1e-12
        centres[filled] = sums[filled] / sizes[filled, None]
    return centres


def cells_of(classes: DataFrame, dimension: int, centres: np.ndarray, threshold: float) -> DataFrame:
    """Each class in its home cell, and as a visitor in the smaller cells that may hold a link.

    Vectors of another length than the centres stand in cell -1.
    """
    reach = math.sqrt(max(0.0, 1.0 - threshold * threshold)) if threshold > 0 else 2.0
    apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * centres @ centres.T)) if len(centres) else np.empty((0, 0))
    names = ["label", "size", "cell", "home", "rep", "copies", "vector"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, copies, label, vector = batch.columns
            sizes = np.diff(vector.offsets.to_numpy())
            regular = np.flatnonzero(sizes == dimension)
            other = np.flatnonzero(sizes != dimension)
            owner, cell, home = [other], [np.full(len(other), -1)], [np.ones(len(other), dtype=bool)]
            for low in range(0, len(regular), 1024):
                rows = regular[low : low + 1024]
                near = unit_rows(matrix(vector.take(pa.array(rows)))) @ centres.T
                nearest = np.argmax(near, axis=1)
                gap = near[np.arange(len(rows)), nearest][:, None] - near
                visits = gap <= reach * apart[nearest] + 1e-9
                visits &= np.arange(len(centres))[None, :] < nearest[:, None]
                who, where = np.nonzero(visits)
                owner += [rows, rows[who]]
                cell += [nearest, where]
                home += [np.ones(len(rows), dtype=bool), np.zeros(len(who), dtype=bool)]
            owners, cells, homes = np.concatenate(owner), np.concatenate(cell), np.concatenate(home)
            for low in range(0, len(owners), 8192):
                part = slice(low, low + 8192)
                take = pa.array(owners[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        label.take(take), pa.array(sizes[owners[part]].astype(np.int32)),
                        pa.array(cells[part].astype(np.int32)), pa.array(homes[part]), rep.take(take), copies.take(take),
                        vector.take(take),
                    ],
                    names,
                )

    kind = classes.schema["vector"].dataType.simpleString()
    label = classes.schema["label"].dataType.simpleString()
    return classes.select("rep", "copies", "label", "vector").mapInArrow(
        run, f"label {label}, size int, cell int, home boolean, rep long, copies long, vector {kind}"
    )


def blocks_of(placed: DataFrame, block_rows: int) -> DataFrame:
    """Cut cells into blocks: pairs of home pieces, and visitor pieces against home pieces."""
    key = ["label", "size", "cell"]
    counts = placed.groupBy(*key).agg(
        F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visitors")
    )
    pieces = lambda n: F.greatest(F.ceil(F.col(n) / block_rows), F.lit(1)).cast("int")
    own = F.when(F.col("home"), F.col("home_pieces")).otherwise(F.col("visitor_pieces"))
    rows = (
        placed.join(counts, key)
        .withColumn("home_pieces", pieces("homes"))
        .withColumn("visitor_pieces", pieces("visitors"))
        .withColumn("piece", F.pmod(F.xxhash64("rep", F.lit(5)), own).cast("int"))
    )
    home_range = F.sequence(F.lit(0), F.col("home_pieces") - 1)
    visitor_range = F.sequence(F.lit(0), F.col("visitor_pieces") - 1)
    piece = F.col("piece")

    def block(kind: int, left, right):
        return F.struct(F.lit(kind).alias("kind"), left.alias("left"), right.alias("right"))

    among_homes = F.transform(home_range, lambda j: block(0, F.least(piece, j), F.greatest(piece, j)))
    with_visitors = F.when(
        F.col("visitors") > 0, F.transform(visitor_range, lambda j: block(1, piece, j))
    ).otherwise(F.array().cast("array<struct<kind:int,left:int,right:int>>"))
    of_visitor = F.transform(home_range, lambda j: block(1, j, piece))
    blocks = F.when(F.col("home"), F.concat(among_homes, with_visitors)).when(F.col("homes") > 0, of_visitor)
    exploded = rows.select(*key, "home", "piece", "rep", "copies", "vector", F.explode(blocks).alias("block"))
    number = F.xxhash64(*key, "block.kind", "block.left", "block.right")
    return (
        exploded.select(
            number.alias("number"), F.col("block.kind").alias("kind"), F.col("block.left").alias("low"),
            F.col("block.right").alias("high"), (F.col("home") & (F.col("piece") == F.col("block.left"))).alias("first"),
            "rep", "copies", "vector",
        )
        .repartition("number")
        .sortWithinPartitions("number", "first", "rep")
    )


def links_in_blocks(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each vector with links in a block: how many vectors, and one link that keeps components.

    A block of one piece links its rows among each other, a block of two pieces the rows of
    one with the rows of the other.
    """
    for table in whole_groups(batches, ["number"], least_rows=2 * BLOCK_ROWS):
        starts = group_starts(table, ["number"]).tolist()
        for low, high in zip(starts, [*starts[1:], table.num_rows]):
            part = table.slice(low, high - low)
            first = part.column("first").to_numpy()
            same = part.column("kind")[0].as_py() == 0 and part.column("low")[0].as_py() == part.column("high")[0].as_py()
            if part.num_rows < 2 or (not same and first.all() or not same and not first.any()):
                continue
            rows = unit_rows(matrix(part.column("vector")))
            copies, reps = part.column("copies").to_numpy(), part.column("rep").to_numpy()
            links, forest = np.zeros(len(rows), dtype=np.int64), Forest(len(rows))
            left = np.arange(len(rows)) if same else np.flatnonzero(~first)
            right = left if same else np.flatnonzero(first)
            for at in range(0, len(left), 512):
                some = left[at : at + 512]
                a, b = np.nonzero(rows[some] @ rows[right].T >= threshold)
                a, b = some[a], right[b]
                if same:
                    a, b = a[a < b], b[a < b]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                forest.link(a, b)
            linked = np.flatnonzero(links)
            if len(linked):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reps[linked]), pa.array(links[linked]), pa.array(reps[forest.root[linked]])],
                    ["rep", "links", "to"],
                )


def link_embeddings(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS, cells: int | None = None,
) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row of ``vectors``.

    Two vectors with equal, non-null labels link if their cosine, in doubles, is at least
    ``threshold``. ``n_links`` counts the other vectors linked directly, ``component_id`` is
    the smallest id reachable over links, itself included, and one vector of each group is
    ``kept``: the one with that id.

    Identical vectors are one class with a count, so many copies cost one row. The centres
    are fitted on ``sample_rows`` vectors at most (the smallest hashes); every vector is
    assigned, and no link depends on the centres. A cell is compared in blocks of at most
    ``block_rows`` rows a side, so a cell with a third of all rows is many tasks.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows
    with a null label or id, link with nothing (a null id is never kept). Vectors of
    different lengths do not link. Rows that repeat an id are separate vectors of one
    component. An empty table gives no rows.
    """
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector")
    )
    valid = usable("vector") & F.col("label").isNotNull() & F.col("id").isNotNull()
    classes = stored(
        rows.filter(valid).groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes"
    )
    dimension, sample = fixed_sample(classes, "vector", sample_rows)
    wanted = cells or min(MOST_CELLS, math.ceil(math.sqrt(classes.count()) / 16))
    centres = spherical_kmeans(unit_rows(sample), wanted) if len(sample) else np.empty((0, 0))
    blocks = blocks_of(cells_of(classes, dimension, centres, threshold), block_rows)
    found = stored(
        blocks.mapInArrow(lambda batches: links_in_blocks(batches, threshold), "rep long, links long, to long"), "found"
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found, "rep", "to")
    of_class = (
        classes.select("label", "vector", "rep", "copies")
        .join(links, "rep", "left")
        .join(components, F.col("rep") == F.col("node"), "left")
        .select(
            "label", "vector",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    alone = rows.filter(~valid).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    linked = rows.filter(valid).join(of_class, ["label", "vector"]).select("id", "n_links", "component_id")
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
