"""Links and neighbours of embeddings against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionscope.llm.ann import cosine, fit_trees, nearest_neighbours
from sessionscope.llm.embedding_dedup import link_embeddings
from sessionscope.llm.vectors import unit_rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 6))
    rows = []
    for at in range(300):
        noise = rng.normal(size=6) * rng.choice([0, 0.05, 0.3])
        rows.append((at, (base[rng.integers(30)] + noise).astype("f4").tolist(), int(rng.integers(3))))
    nan, infinite = float("nan"), float("inf")
    rows += [
        (300, None, 1), (350, [0.0] * 6, 1), (400, [nan] * 6, 1), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1),
        (304, [1.0] * 5, 1), (305, [1.0] * 5, 1), (306, rows[0][1], None), (307, [], 1), (308, [infinite] * 6, 2),
        (450, [1e30] * 6, 2), (310, [1e-30] * 6, 2), (None, [1.0] * 6, 2), (500, [2.0], 0), (450, [1e30] * 6, 2),
    ]
    return rows


def usable(row):
    number, vector, _ = row
    return number is not None and vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector)


def brute_links(rows, threshold):
    fine = [bool(usable(row) and row[2] is not None) for row in rows]
    unit = [unit_rows(np.array([row[1]], dtype=float))[0] if ok else None for row, ok in zip(rows, fine)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(at):
        while root[at] != at:
            at = root[at]
        return at

    for a in range(len(rows)):
        for b in range(a):
            if fine[a] and fine[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]):
                if unit[a] @ unit[b] >= threshold:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    groups = {}
    for at, row in enumerate(rows):
        groups.setdefault(find(at), []).append(row[0])
    least = {group: min(ids) if None not in ids else None for group, ids in groups.items()}
    return [(row[0], links[at], least[find(at)], row[0] is not None and row[0] == least[find(at)]) for at, row in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"cells": 7, "block_rows": 10}, {"cells": 1, "threshold": 0.5}])
def test_links(spark, options):
    rows = vectors()
    found = link_embeddings(spark.createDataFrame(rows, SCHEMA), **options).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute_links(rows, options.get("threshold", 0.93)), key=str)


def brute_neighbours(rows, nearest):
    fine = [(number, np.array([vector], dtype=float)) for number, vector, label in rows if usable((number, vector, label))]
    out = []
    for query, vector in {number: vector for number, vector in fine if number % 50 == 0}.items():
        scores = {}
        for number, other in fine:
            if number != query and other.shape == vector.shape:
                scores[number] = max(scores.get(number, -9.0), float(cosine(vector, other)[0]))
        best = sorted(scores.items(), key=lambda item: (-item[1], item[0]))[:nearest]
        out += [(query, rank, number, score) for rank, (number, score) in enumerate(best, start=1)]
    return sorted(out)


def test_all_leaves_give_the_exact_neighbours(spark):
    rows = vectors()
    docs = spark.createDataFrame(rows, SCHEMA)
    found = nearest_neighbours(docs, F.col("vec_id") % 50 == 0, search=1.0, leaf_rows=20).collect()
    assert sorted(map(tuple, found)) == brute_neighbours(rows, 5)


def test_recall(spark):
    rng = np.random.default_rng(3)
    rows = [(at, rng.normal(size=16).astype("f4").tolist(), 0) for at in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {(r[0], r[2]) for r in nearest_neighbours(docs, F.col("vec_id") % 50 == 0, leaf_rows=64).collect()}
    true = {(query, number) for query, _, number, _ in brute_neighbours(rows, 5)}
    assert len(found & true) >= 0.9 * len(true)


def test_trees_split_evenly():
    rng = np.random.default_rng(1)
    unit = unit_rows(rng.normal(size=(1024, 8)))
    forest = fit_trees(unit, trees=3, depth=5)
    leaves = forest.leaves(unit)
    for tree in range(3):
        assert set(np.bincount(leaves[:, tree], minlength=32).tolist()) == {32}
    for row in range(5):
        visits = forest.visits(forest.margins(unit[row : row + 1])[0], most=96)
        assert len(set(visits)) == 96
        assert {(tree, leaf) for tree, leaf in enumerate(leaves[row].tolist())} <= set(visits[:3])


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert link_embeddings(empty).collect() == []
    assert nearest_neighbours(empty, F.col("vec_id") % 50 == 0).collect() == []
