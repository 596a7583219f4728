"""Quality rules: base measures of a text, and its divergence from its language's reference.

A reference is the character-class histogram and the common-word histogram of the plain, long
documents of a language. A document is refused where its Jensen-Shannon distance to them is
above a limit that allows for its length; very short documents are not judged by distance.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, stored

#: The characters that ``n_symbols`` counts, and those of sentences.
SYMBOLS, SENTENCES = b"#*$%&|<>", b".,;:!?'\"()-"
#: Character classes: small letters, capitals, digits, white space, sentence marks, symbols, the
#: rest of ASCII, anything else; bytes inside a code point belong to none.
CLASSES, INSIDE = 8, 8
SPACE, SYMBOL = 3, 5
#: Common words of a language; all others are one more class.
COMMON = 100
#: A reference document has at least as many words, at most one symbol and ten capitals in 100 characters.
REFERENCE_WORDS = 100
#: Languages with a reference of their own, the largest first, each of at least so many words;
#: the others are held against the reference of all languages together.
LANGUAGES, LANGUAGE_WORDS = 1_000, 10_000
#: Words that a document has at least where its classes, or its words, are judged.
CLASS_GUARD, WORD_GUARD = 30, 50
#: Limits of the distances for n words: constant + share / sqrt(n).
CLASS_LIMIT, WORD_LIMIT = (0.12, 0.6), (0.27, 2.6)
SLICE_BYTES = 4 << 20


def _class_table() -> np.ndarray:
    table = np.full(256, 7, dtype=np.uint8)
    table[:128] = 6
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 0, 1, 2
    table[[0x20, *range(0x09, 0x0E)]] = SPACE
    table[list(SENTENCES)], table[list(SYMBOLS)] = 4, SYMBOL
    table[0x80:0xC0] = INSIDE
    return table


class Texts(NamedTuple):
    """The words of some whole texts: each word's text number, code and the words by code."""

    documents: int
    classes: np.ndarray
    owner: np.ndarray
    code: np.ndarray
    words: pa.Array
    data: np.ndarray
    offsets: np.ndarray


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def parse(column: pa.Array) -> Texts:
    """Words (white space parts them, whatever the text's script) and character classes; null: no words."""
    array = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kinds = _class_table()[data]
    documents = len(array)
    number = np.repeat(np.arange(documents), np.diff(offsets))
    classes = np.bincount(number * (CLASSES + 1) + kinds, minlength=documents * (CLASSES + 1))
    solid = kinds != SPACE
    first = solid.copy()
    first[1:] &= ~solid[:-1] | (number[1:] != number[:-1])
    starts = np.flatnonzero(first)
    places = np.append(np.cumsum(solid)[starts] - 1, solid.sum())
    words = _binary(places, data[solid]).dictionary_encode()
    return Texts(
        documents, classes.reshape(documents, -1)[:, :CLASSES], number[starts],
        words.indices.to_numpy().astype(np.int64), words.dictionary, data, offsets,
    )


def _renumbered(values: np.ndarray) -> tuple[np.ndarray, int]:
    found, number = np.unique(values, return_inverse=True)
    return number.astype(np.int64), len(found)


def repeated_words(texts: Texts, window: int = 5) -> np.ndarray:
    """Words of each text that lie in a window of five words found twice or more in that text."""
    code, owner = texts.code, texts.owner
    if len(code) < window:
        return np.zeros(texts.documents, dtype=np.int64)
    pairs, many = _renumbered(code[:-1] * len(texts.words) + code[1:])
    fours, many = _renumbered(pairs[:-2] * many + pairs[2:])
    inside = owner[:-4] == owner[4:]
    fives, _ = _renumbered((fours[:-1] * len(texts.words) + code[4:])[inside])
    spots = np.flatnonzero(inside)
    kinds, _ = _renumbered(fives * texts.documents + owner[spots])
    counts = np.bincount(kinds)
    covered = np.zeros(len(code), dtype=bool)
    starts = spots[counts[kinds] > 1]
    for shift in range(window):
        covered[starts + shift] = True
    return np.bincount(owner[covered], minlength=texts.documents)


def repeated_lines(texts: Texts) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of it."""
    ends = texts.data == 10
    starts = np.unique(np.concatenate([texts.offsets[:-1], np.flatnonzero(ends) + 1]))
    starts = starts[starts < len(texts.data)]
    if not len(starts):
        return np.zeros(texts.documents, dtype=np.int64)
    owner = np.searchsorted(texts.offsets, starts, "right") - 1
    before = np.concatenate([[0], np.cumsum(ends)])
    places = np.append(starts - before[starts], len(texts.data) - before[-1])
    filled = np.add.reduceat(_class_table()[texts.data] != SPACE, starts) > 0
    lines = _binary(places, texts.data[~ends]).filter(pa.array(filled)).dictionary_encode().indices.to_numpy()
    owner = owner[filled]
    kinds, first = np.unique(lines.astype(np.int64) * texts.documents + owner, return_index=True)
    return np.bincount(owner, minlength=texts.documents) - np.bincount(owner[first], minlength=texts.documents)


def distances(rows: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2: 0 to 1) of each row of counts to its row of reference counts."""
    p = rows / np.maximum(rows.sum(axis=1, keepdims=True), 1)
    q = references / np.maximum(references.sum(axis=1, keepdims=True), 1)
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(side > 0, side * np.log2(side / middle), 0).sum(axis=1) for side in (p, q)]
    return np.sqrt(np.clip((parts[0] + parts[1]) / 2, 0, None))


class Reference(NamedTuple):
    """Counts of one language: character classes, common words with all others last, and the words."""

    classes: list[int]
    counts: list[int]
    words: list[bytes]


def counted_references(docs: DataFrame, text_column: str = "text", language_column: str = "lang") -> dict[str | None, Reference]:
    """The references of the languages, and of all documents together under ``None``.

    Counts are over all reference documents; what comes to the driver are ``COMMON`` words of
    ``LANGUAGES`` languages at most. A null language is the empty text.
    """
    rows = docs.select(F.coalesce(F.col(f"`{language_column}`").cast("string"), F.lit("")).alias("lang"),
                       F.col(f"`{text_column}`").alias("text"))
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64()), ("classes", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in sliced(batches, "text", SLICE_BYTES):
            texts = parse(batch.column(1))
            plain = texts.classes
            size = plain.sum(axis=1)
            chosen = (np.bincount(texts.owner, minlength=texts.documents) >= REFERENCE_WORDS) & (
                100 * plain[:, SYMBOL] <= size) & (10 * plain[:, 1] <= size)
            names, language = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
            for at, name in enumerate(names):
                mine = chosen & (language == at)
                if not mine.any():
                    continue
                made = plain[mine].sum(axis=0).tolist()
                yield pa.RecordBatch.from_pylist([{"lang": str(name), "word": None, "n": None, "classes": made}], schema=schema)
                counts = np.bincount(texts.code[mine[texts.owner]], minlength=len(texts.words))
                used = np.flatnonzero(counts)
                words = texts.words.take(pa.array(used)).to_pylist()
                found.update(dict(zip(((str(name), word) for word in words), counts[used].tolist())))
            if len(found) > 300_000:
                yield _counted(found)
                found = Counter()
        if found:
            yield _counted(found)

    def _counted(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0] for key in found], type=pa.string()), pa.array([key[1] for key in found], type=pa.binary()),
             pa.array(list(found.values()), type=pa.int64()), pa.nulls(len(found), type=pa.list_(pa.int64()))], schema=schema,
        )

    parts = rows.mapInArrow(run, "lang string, word binary, n long, classes array<bigint>")
    sums = [F.sum(F.col("classes")[at]).alias(f"class{at}") for at in range(CLASSES)]
    counted = stored(parts.groupBy("lang", "word").agg(F.sum("n").alias("n"), *sums), "words")
    words = counted.filter("word IS NOT NULL")
    order = [F.desc("n"), F.asc("word")]
    ranked = (
        words.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= COMMON)
    )
    sizes = words.groupBy("lang").agg(F.sum("n").alias("words")).filter(F.col("words") >= LANGUAGE_WORDS)
    largest = {row.lang: row.words for row in sizes.orderBy(F.desc("words"), "lang").limit(LANGUAGES).collect()}
    names = list(largest)
    classes = counted.filter("word IS NULL")
    made: dict[str | None, Reference] = {}
    of = {name: [] for name in names}
    for row in ranked.filter(F.col("lang").isin(names)).orderBy("lang", "rank").collect() if names else []:
        of[row.lang].append((bytes(row.word), row.n))
    for row in classes.filter(F.col("lang").isin(names)).collect() if names else []:
        made[row.lang] = _reference(row, of[row.lang], largest[row.lang])
    all_words = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(*order).limit(COMMON).collect()
    total = words.agg(F.sum("n")).first()[0]
    if total:
        together = classes.agg(*[F.sum(f"class{at}").alias(f"class{at}") for at in range(CLASSES)]).first()
        made[None] = _reference(together, [(bytes(row.word), row.n) for row in all_words], total)
    return made


def _reference(row, words: list[tuple[bytes, int]], total: int) -> Reference:
    counts = [n for _, n in words] + [0] * (COMMON - len(words))
    return Reference([row[f"class{at}"] for at in range(CLASSES)], [*counts, total - sum(counts)], [word for word, _ in words])


def judge(texts: Texts, languages: list[str], references: dict[str | None, Reference]) -> tuple[np.ndarray, np.ndarray]:
    """Class and word distance of each text; without any reference they are null (NaN)."""
    classes, common = np.full(texts.documents, np.nan), np.full(texts.documents, np.nan)
    chosen = np.array([name if name in references else None for name in languages], dtype=object)
    for name in set(chosen.tolist()):
        if name not in references:
            continue
        reference = references[name]
        mine = np.flatnonzero(chosen == name) if name is not None else np.flatnonzero([c is None for c in chosen])
        place = np.full(texts.documents, -1)
        place[mine] = np.arange(len(mine))
        classes[mine] = distances(texts.classes[mine], np.array([reference.classes]))
        ranks = pc.index_in(texts.words, value_set=pa.array(reference.words, type=pa.large_binary()))
        rank = pc.fill_null(ranks, COMMON).to_numpy(zero_copy_only=False).astype(np.int64)
        here = place[texts.owner] >= 0
        cells = place[texts.owner[here]] * (COMMON + 1) + rank[texts.code[here]]
        counts = np.bincount(cells, minlength=len(mine) * (COMMON + 1)).reshape(len(mine), -1)
        common[mine] = distances(counts, np.array([reference.counts]))
    return classes, common


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> DataFrame:
    """``id`` and the measures of every whole text, ``base_failed``, both distances and ``kept``.

    One row comes out for each row, repeated ones too; a null or empty text has no words and fails
    the base rules (fewer than ten words, or over a fifth of the words in repeated windows). Null
    and rare languages are held against all documents together. Without a document that can serve
    as a reference the distances are null and the base rules decide. No rows, no result. Two scans
    of the texts; nothing but word counts is shuffled.
    """
    references = counted_references(docs, text_column, language_column)
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"),
                       F.coalesce(F.col(f"`{language_column}`").cast("string"), F.lit("")).alias("lang"))
    sent = docs.sparkSession.sparkContext.broadcast(references)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_BYTES):
            texts = parse(batch.column(1))
            words = np.bincount(texts.owner, minlength=texts.documents)
            again = repeated_words(texts)
            failed = (words < 10) | (100 * again > 20 * words)
            classes, common = judge(texts, batch.column(2).to_pylist(), sent.value)
            limits = [constant + share / np.sqrt(np.maximum(words, 1)) for constant, share in (CLASS_LIMIT, WORD_LIMIT)]
            strange = (words >= CLASS_GUARD) & (classes > limits[0]) | (words >= WORD_GUARD) & (common > limits[1])
            columns = [
                words, texts.classes.sum(axis=1) - texts.classes[:, SPACE], texts.classes[:, SYMBOL], repeated_lines(texts), again,
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(column, type=pa.int64()) for column in columns], pa.array(failed),
                 *[pa.array(column, from_pandas=True) for column in (classes, common)], pa.array(~failed & ~strange)],
                ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                 "class_distance", "word_distance", "kept"],
            )

    return rows.mapInArrow(
        run,
        f"id {rows.schema['id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean",
    )
