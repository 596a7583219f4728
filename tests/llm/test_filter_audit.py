"""Survivors of filter subsets against documents counted one by one."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from sessionscope.llm import filter_audit as fa
from sessionscope.llm.oracle import SELECTS
from sessionscope.llm.queries import QUERIES
from tests.check import connect, oracle_rows, spark_rows
from tests.llm.conftest import SF_DIR

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_failures(text):
    words = WORD.findall(text)
    fails = {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
    }
    return {name for name, fail in fails.items() if fail}


def slow_audit(docs, labels):
    docs = [(i, text or "", part or "") for i, text, part in docs]
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text] = min(i, least.get(text, i))
    rows = []
    for i, text, part in docs:
        fails = slow_failures(text) | ({"E"} if i is not None and i > least[text] else set())
        rows.append((part, fails, any(d == i and q == 1 for d, q, _ in labels if i is not None),
                     any(d == i and t == 1 for d, _, t in labels if i is not None)))
    out, removals = [], Counter()
    for order in permutations("ABCDE"):
        for part in {row[0] for row in rows}:
            alive = [row for row in rows if row[0] == part]
            whole = alive
            for step, name in enumerate(order, 1):
                gone = [row for row in alive if name in row[1]]
                removals[part, name] += len(gone)
                redundant = sum(name in row[1] for row in whole) - len(gone)
                alive = [row for row in alive if name not in row[1]]
                out.append([part, "".join(order), step, len(alive), len(gone), redundant,
                            sum(row[1] == {name} for row in whole), sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted(tuple([*row, removals[row[0], row[1][row[2] - 1]]]) for row in out)


COLUMNS = [name for name, _ in fa.AUDIT]


def found(docs, labels):
    return sorted(map(tuple, fa.audit_filters(docs, labels).select(*COLUMNS).collect()))


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 4, 5, 7, 64, 1000])
def test_positional_counts(rows):
    words = np.random.default_rng(rows).integers(0, 2**32, rows, dtype=np.uint32)
    expected = [sum(int(word) >> bit & 1 for word in words) for bit in range(32)]
    assert fa.positional_counts(words).tolist() == expected
    weights = np.random.default_rng(1).integers(1, 1_000, rows)
    assert fa.weighted_counts(words, weights).tolist() == [
        sum(int(word) >> bit & 1 and int(n) for word, n in zip(words, weights)) for bit in range(32)
    ]


def test_survival_words():
    for fails, word in enumerate(fa.survival_words(np.arange(32))):
        assert [int(word) >> subset & 1 for subset in range(32)] == [int(not fails & subset) for subset in range(32)]


def test_audit_of_mixed_documents(spark):
    draw = random.Random(2)
    texts = ["", None, "word " * 300, " ".join(f"w{n}" for n in range(250)), " ".join(f"W{n}" for n in range(220)),
             "a | b", " ".join(f"w{n % 90}" for n in range(200)), "É" * 40, "x y " * 210, "big " * 60_000]
    docs = [(draw.choice([None, *range(40)]), draw.choice(texts), draw.choice(["en", "de", "", None]), "x", 1) for _ in range(150)]
    labels = [(n, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for n in [None, *range(0, 40, 2), 4, 6, 6]]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, good string, n int").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found(frame, marks) == slow_audit([row[:3] for row in docs], labels)


def test_dirty_table(spark, dirty):
    marks = spark.createDataFrame([(3, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [tuple(row) for row in dirty.select("doc_id", "text", "lang").collect()]
    assert found(dirty, marks) == slow_audit(rows, [(3, 1, 1), (7, 1, 0)])


def test_empty_tables(spark, dirty, nothing):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert found(nothing, marks) == []
    assert len(found(dirty.filter("lang = 'en'"), marks)) == 600


def test_query_against_sql(spark):
    name = "op12_filter_audit"
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == oracle_rows(connect(SF_DIR), SELECTS[name])
