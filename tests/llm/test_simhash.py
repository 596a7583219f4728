"""Fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import xxhash

from sessionscope.llm.simhash import fingerprint, keep_representatives, link_fingerprints, near_duplicates


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda found: found[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[at : at + 3]).encode(), 42) for at in range(max(1, len(words) - 2))
    ]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(values, most_bits=3):
    root = list(range(len(values)))

    def find(at):
        while root[at] != at:
            at = root[at]
        return at

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= most_bits:
                root[find(a)] = find(b)
    return [find(at) for at in range(len(values))]


def test_fingerprint():
    for text in ["", " ", "a", "A b", "É ü b C d", "x  y\tz\nw q", "a b c " * 3000, " x \x1c y z"]:
        assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_dirty_table(dirty):
    found = [(row.id, row.fingerprint % 2**64, row.component_id) for row in near_duplicates(dirty).collect()]
    rows = dirty.select("doc_id", "text").collect()
    prints = [slow_fingerprint(row.text) for row in rows]
    groups = {}
    for row, group in zip(rows, components(prints)):
        groups.setdefault(group, []).append(row.doc_id)
    least = {group: min(i for i in ids if i is not None) if any(i is not None for i in ids) else None
             for group, ids in groups.items()}
    expected = [(r.doc_id, p, least[g]) for r, p, g in zip(rows, prints, components(prints))]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_links_keep_components_whatever_the_pieces(spark):
    draw = random.Random(5)
    centres = [draw.getrandbits(64) for _ in range(12)]
    values = set(centres)
    for _ in range(400):
        value = draw.choice(centres) if draw.random() < 0.7 else draw.choice(sorted(values))
        for _ in range(draw.randint(1, 5)):
            value ^= 1 << draw.randrange(64)
        values.add(value)
    values = sorted(values)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    expected = components(values)
    classes = spark.createDataFrame([(value,) for value in signed], "fingerprint long")
    for piece_rows in (4096, 10):
        links = [(row.a, row.b) for row in link_fingerprints(classes, piece_rows=piece_rows).collect()]
        place = {value: at for at, value in enumerate(signed)}
        assert all((values[place[a]] ^ values[place[b]]).bit_count() <= 64 for a, b in links)
        root = list(range(len(values)))
        for _ in range(len(values)):
            before = list(root)
            for a, b in links:
                low = min(root[place[a]], root[place[b]])
                root[place[a]] = root[place[b]] = low
            if root == before:
                break
        assert len(set(root)) == len(set(expected))
        assert len({*zip(root, expected)}) == len(set(root))


def test_empty(nothing):
    assert near_duplicates(nothing).collect() == []


def test_representatives(dirty):
    kept = keep_representatives(dirty)
    assert kept.columns == dirty.columns
    groups = {row.component_id for row in near_duplicates(dirty.filter("doc_id is not null")).collect()}
    assert {row.doc_id for row in kept.collect()} - {None} == groups
    assert kept.filter("doc_id is null").count() == 1


def test_representatives_without_an_id(spark):
    """Copies without an id, or of a document with one, are one group; an id may name two texts."""
    rows = [
        (None, "alpha beta gamma delta epsilon"), (None, "ALPHA beta gamma delta epsilon"),
        (5, "one two three four five six"), (None, "one two three four five six"),
        (8, "north south east west up down"), (9, "north south east west up down"),
        (9, "red green blue black white grey"), (9, "red green blue black white grey"), (8, "RED green blue black white grey"),
        (None, None), (None, ""), (None, " "),
    ]
    docs = spark.createDataFrame([(*row, at) for at, row in enumerate(rows)], "doc_id long, text string, place int")
    kept = [(row.doc_id, (row.text or "").strip().lower()) for row in keep_representatives(docs.repartition(3)).collect()]
    prints = [slow_fingerprint(text) for _, text in rows]
    assert len(set(components(prints))) == 5
    assert sorted(kept, key=str) == sorted([
        (None, "alpha beta gamma delta epsilon"), (5, "one two three four five six"), (8, "north south east west up down"),
        (8, "red green blue black white grey"), (None, ""),
    ], key=str)
