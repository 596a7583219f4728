"""Repeated byte strings against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from sessionscope.llm import suffix_dedup
from sessionscope.llm.suffix_dedup import Anchors, common_prefixes, cut_out, remove_repeats


def brute(texts, length):
    counts = Counter(text[at : at + length] for text in texts for at in range(len(text) - length + 1))
    out = []
    for text in texts:
        covered = np.zeros(len(text), dtype=bool)
        for at in range(len(text) - length + 1):
            if counts[text[at : at + length]] > 1:
                covered[at : at + length] = True
        runs = int((np.diff(np.concatenate(([0], covered.astype(int), [0]))) == 1).sum())
        out.append((len(text), int(covered.sum()), runs, bytes(np.frombuffer(text, np.uint8)[~covered])))
    return out


def test_column_wise_prefixes():
    """The longest common prefix of each suffix with another one, in bytes."""
    draw = random.Random(5)
    side = lambda: bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 6)))
    for _ in range(120):
        strings = list(dict.fromkeys((side(), draw.randint(0, 2), 27, side()) for _ in range(draw.randint(1, 9))))
        symbols = [[*left, 256 + core, *right] for left, core, _, right in strings]
        suffixes = [(string, at) for string in range(len(strings)) for at in range(len(symbols[string]) + 1)]
        found = {}
        for string, at, longest in zip(*(values.tolist() for values in common_prefixes(strings))):
            found[string, at] = longest

        def shared(a, b):
            total = 0
            for x, y in zip(symbols[a[0]][a[1] :], symbols[b[0]][b[1] :]):
                if x != y:
                    break
                total += 27 if x >= 256 else 1
            return total

        for one in suffixes:
            assert found[one] == max((shared(one, other) for other in suffixes if other != one), default=0)


def test_equal_windows_have_equal_anchors():
    draw = random.Random(6)
    passage = bytes(draw.choice(b"abcd ") for _ in range(300))
    places = set()
    for _ in range(6):
        text = bytes(draw.choice(b"abcd ") for _ in range(draw.randint(0, 90))) + passage
        low = len(text) - 300
        place, _ = Anchors(64, 8)._anchors(np.frombuffer(text, dtype=np.uint8))
        places.add(tuple((place[low + at] - low) for at in range(300 - 64 + 1)))
    assert len(places) == 1


def corpus():
    draw = random.Random(7)
    some = lambda letters, least, most: "".join(draw.choice(letters) for _ in range(draw.randint(least, most)))
    passages = [some("abcdé ", 50, 300) for _ in range(12)]
    texts = []
    for _ in range(150):
        text = "".join(
            draw.choice([draw.choice(passages), some("xyzw", 0, 60), "k" * draw.randint(0, 150), "ab" * draw.randint(0, 60)])
            for _ in range(draw.randint(0, 6))
        )
        if draw.random() < 0.2 and len(text) > 5:
            at = draw.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        texts.append(text)
    return [*texts, *texts[:10], "", None]


@pytest.mark.parametrize("length, gram, width, most", [(40, 8, 8, 20_000), (40, 8, 8, 3), (64, 16, 16, 10), (33, 4, 4, 1)])
def test_against_brute_force(spark, length, gram, width, most):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = remove_repeats(docs, length=length, gram=gram, width=width, most_strings=most).collect()
    expected = brute([(text or "").encode() for text in texts], length)
    assert {row.doc_id: (row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept)) for row in rows} == dict(
        enumerate(expected)
    )
    assert sum(removed for _, removed, _, _ in expected) > 10_000


def test_whole_windows_are_not_gathered(spark, monkeypatch):
    """A passage with many different surroundings: cores of width 1 never reach the sorting tasks."""
    sort = suffix_dedup.repeated_offsets

    def narrow_refused(strings, length):
        def seen():
            for batch in strings:
                assert not any(width == 1 for width in batch.column("width").to_pylist())
                yield batch

        return sort(seen(), length)

    monkeypatch.setattr(suffix_dedup, "repeated_offsets", narrow_refused)
    draw = random.Random(8)
    some = lambda letters, size: "".join(draw.choice(letters) for _ in range(size))
    passage = some("abcd ", 44)
    texts = [some("wxyz", 60) + passage + some("wxyz", 60) for _ in range(80)] + corpus()[:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = remove_repeats(docs, length=40, gram=8, width=8, most_strings=5).collect()
    assert {row.doc_id: (row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept)) for row in rows} == dict(
        enumerate(brute([text.encode() for text in texts], 40))
    )


def test_dirty_table(dirty, nothing):
    renamed = dirty.withColumn("kept", dirty.copies).withColumn("t1", dirty.copies)
    rows = remove_repeats(renamed, length=40, gram=8, width=8).collect()
    texts = [(row.text or "").encode() for row in rows]
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows] == brute(texts, 40)
    assert len(rows) == dirty.count()
    as_text = remove_repeats(renamed, length=40, gram=8, width=8, as_text=True)
    assert dict(as_text.dtypes)["kept"] == "string"
    assert remove_repeats(nothing).collect() == []


def test_cut_out():
    spans = [{"first": 2, "last": 3}, {"first": 5, "last": 5}, {"first": 20, "last": 20}]
    assert cut_out(bytes(range(30)), spans, 4) == (30, 11, 2, bytes([0, 1, *range(9, 20), *range(24, 30)]))


@pytest.mark.parametrize("size, cut", [(300, 0), (390, 0), (399, 0), (400, 400), (450, 450)])
def test_planted_passages(spark, size, cut):
    """At the length of 400 bytes a shared passage goes from 400 bytes on, whatever stands around it."""
    draw = random.Random(size)
    some = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passage = some(size)
    rows = [(n, some(200) + "<" + str(n) + passage + str(n) + ">" + some(100)) for n in range(6)]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {row.n_removed for row in found} == {cut}
