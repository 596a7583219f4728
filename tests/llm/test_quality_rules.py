"""Quality rules against slow counting, and held-out labels of the given tables."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from sessionscope.llm import quality_rules as qr
from sessionscope.llm.queries import QUERIES
from tests.llm.conftest import SF_DIR

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[at : at + 5]) for at in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {at + shift for at, window in enumerate(windows) if counts[window] > 1 for shift in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def slow_classes(text):
    counts = [0] * 8
    for c in text:
        counts[0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\x0b\x0c\r"
               else 4 if c in ".,;:!?'\"()-" else 5 if c in "#*$%&|<>" else 6 if ord(c) < 128 else 7] += 1
    return counts


def slow_distance(p, q):
    p, q = [x / max(sum(p), 1) for x in p], [x / max(sum(q), 1) for x in q]
    parts = [a * math.log2(a / ((a + b) / 2)) for x, y in ((p, q), (q, p)) for a, b in zip(x, y) if a]
    return math.sqrt(max(sum(parts) / 2, 0))


def slow_references(docs):
    words, classes = {}, {}
    for _, text, lang in docs:
        found, kinds = WORD.findall(text or ""), slow_classes(text or "")
        if len(found) >= qr.REFERENCE_WORDS and 100 * kinds[5] <= sum(kinds) and 10 * kinds[1] <= sum(kinds):
            for key in (lang or "", None):
                words.setdefault(key, Counter()).update(found)
                classes[key] = [a + b for a, b in zip(classes.get(key, [0] * 8), kinds)]
    made = {}
    for key, counts in words.items():
        if key is None or sum(counts.values()) >= qr.LANGUAGE_WORDS:
            top = sorted(counts.items(), key=lambda item: (-item[1], item[0].encode()))[: qr.COMMON]
            histogram = [n for _, n in top] + [0] * (qr.COMMON - len(top)) + [sum(counts.values()) - sum(n for _, n in top)]
            made[key] = (classes[key], histogram, {word: at for at, (word, _) in enumerate(top)})
    return made


def slow_quality(docs):
    references = slow_references(docs)
    for i, text, lang in docs:
        base = slow_base(text)
        reference = references.get(lang or "", references.get(None))
        strange, found = False, (None, None)
        if reference:
            words = WORD.findall(text or "")
            histogram = [0] * (qr.COMMON + 1)
            for word in words:
                histogram[reference[2].get(word, qr.COMMON)] += 1
            found = slow_distance(slow_classes(text or ""), reference[0]), slow_distance(histogram, reference[1])
            limit = [a + b / math.sqrt(max(base[0], 1)) for a, b in (qr.CLASS_LIMIT, qr.WORD_LIMIT)]
            strange = base[0] >= qr.CLASS_GUARD and found[0] > limit[0] or base[0] >= qr.WORD_GUARD and found[1] > limit[1]
        yield (i, *base, *[None if x is None else round(x, 9) for x in found], not base[5] and not strange)


def found(frame):
    columns = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for row in qr.quality(frame).collect():
        rounded = [None if row[name] is None else round(row[name], 9) for name in ("class_distance", "word_distance")]
        yield (*[row[name] for name in columns], *rounded, row.kept)


def test_measures_of_texts_of_one_batch():
    draw = random.Random(1)
    pieces = ["a", "b", "c d", "é", "ü#", "\n", "\n\n", " ", "\t", "<b>", "\x1c", "\x85", "日本", "A1"]
    texts = ["", None, "\n", " \n ", "a\na", "a\n a\na", "x" * 10, "a b c d e a b c d e", "a b c d e f a b c d e", "\na\n\na\n"]
    texts += ["".join(draw.choice(pieces) + draw.choice(["", " ", "\n"]) for _ in range(draw.randint(0, 80))) for _ in range(200)]
    for column in (pa.array(texts), pa.array(["skipped", *texts]).slice(1)):
        parsed = qr.parse(column)
        assert parsed.classes.tolist() == [slow_classes(text or "") for text in texts]
        rows = zip(parsed.classes.sum(axis=1) - parsed.classes[:, 3], qr.repeated_lines(parsed), qr.repeated_words(parsed))
        assert [tuple(map(int, row)) for row in rows] == [(b[1], b[3], b[4]) for b in map(slow_base, texts)]


def test_windows_stay_inside_a_text():
    parsed = qr.parse(pa.array(["a b c d", "e a b c d e", "", "a b c d e"]))
    assert qr.repeated_words(parsed).tolist() == [0, 0, 0, 0]


def test_dirty_table(spark, dirty):
    rows = [tuple(row) for row in dirty.select("doc_id", "text", "lang").collect()]
    assert sorted(found(dirty), key=str) == sorted(slow_quality(rows), key=str)


@pytest.mark.parametrize("slice_bytes", [4 << 20, 500])
def test_given_table(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(qr, "SLICE_BYTES", slice_bytes)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [tuple(row) for row in docs.select("doc_id", "text", "lang").collect()]
    assert sorted(found(docs), key=str) == sorted(slow_quality(rows), key=str)


def test_rare_and_null_languages_use_all_documents(spark):
    draw = random.Random(4)
    text = lambda: " ".join(draw.choice(["the", "of", "word", "other", "more."]) + draw.choice("ab ") for _ in range(400))
    rows = [(n, text(), ["en", None, "xx"][n % 40 % 3] if n % 40 < 3 else "en") for n in range(60)]
    rows += [(100, "#| A$ " * 200, "xx"), (101, "#| A$ " * 200, None), (None, None, None)]
    frame = spark.createDataFrame([(*row, "k", 1) for row in rows], "doc_id long, text string, lang string, kept string, n_words int")
    assert sorted(found(frame), key=str) == sorted(slow_quality(rows), key=str)


def test_no_rows_and_no_reference(spark, nothing):
    assert list(found(nothing)) == []
    few = spark.createDataFrame([(1, "a b c d e f g h i j k", "en"), (2, "#" * 200, "en")], "doc_id long, text string, lang string")
    assert sorted((row.id, row.class_distance, row.kept) for row in qr.quality(few).collect()) == [(1, None, True), (2, None, False)]


def test_very_long_text(spark):
    text = " ".join(f"w{n % 5000}x{n // 5000}" for n in range(120_000)) + "\n" + "é" * 1_000_000
    frame = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    assert list(found(frame)) == list(slow_quality([(1, text, "en")]))


def test_labels(spark):
    """Of the rows that pass the base rules, those labelled good stay and those labelled bad go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = QUERIES["op13_quality_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("NOT base_failed").collect()
    assert docs.count() == 1_000
    kept = {quality: [row.kept for row in rows if row.quality == quality] for quality in (0, 1)}
    assert sum(kept[1]) >= 0.97 * len(kept[1]) and sum(kept[0]) <= 0.05 * len(kept[0])
