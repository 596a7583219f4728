"""Toxicity classifier with a counterfactual penalty, trained here and applied to whole texts.

Features are the words of a text and their beginnings, each counted once a text. A logistic
model is fitted on labelled rows. Every labelled text gets a counterfactual copy: terms that stand
for a group are swapped for others of their kind, and a text without one has a term put in.
The squared change of the model's logit between the two is part of the loss: naming a group must
not move a score.

Terms are the listed English names of groups, and, for any language, what the labelled texts
themselves show: words that say little about the label, each paired with the word that stands
between the same neighbours most often.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bounds of the fit: labelled rows of each class (the smallest hashes), and features.
MOST_TOXIC = 4_000
MOST_CLEAN = 8_000
MOST_FEATURES = 4_096
ROWS_PER_FEATURE = 1
LEAST_TEXTS = 3
#: Weight of the counterfactual penalty and of the ridge.
FAIRNESS = 5.0
RIDGE = 3e-5
BEGINNINGS = (4, 5, 6)
MOST_WORDS = 400_000

#: Neutral names of groups, by kind; a swap stays within a kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"),
    ("american", "mexican", "chinese", "german", "french", "spanish", "indian"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("old", "young", "elderly", "teenage"),
    ("blind", "deaf", "disabled", "paralyzed"),
)

#: Terms that are found in the texts: at most so many, in at least so many texts and at most such a
#: share of them, and toxic at most so many times as often as other texts, or as seldom.
MOST_TERMS = 128
TERM_TEXTS = 5
TERM_SHARE = 0.2
NEUTRAL = 3.0

LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """A word, marked as whole, and its beginnings."""
    return [f"{word}.", *[word[:n] for n in BEGINNINGS if len(word) >= n]]


def words_of(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


def listed_swaps() -> dict[str, str]:
    """Every listed name of a group, and the next of its kind."""
    return {term: other for kind in IDENTITY_TERMS for term, other in zip(kind, (*kind[1:], kind[0]))}


def swapped(words: set[str], swaps: dict[str, str], inserts: list[str]) -> set[str] | None:
    """The words with every term replaced by its partner; without a term, with one of ``inserts`` put in.

    Which one is drawn by the words themselves. None if nothing can be changed.
    """
    if not words.isdisjoint(swaps):
        return {swaps.get(word, word) for word in words}
    if not inserts:
        return None
    return words | {inserts[zlib.crc32(" ".join(sorted(words)).encode()) % len(inserts)]}


def found_swaps(rows: DataFrame, most: int = MOST_TERMS) -> dict[str, str]:
    """Label-neutral words of the training rows, each with the one that shares most of its neighbours.

    At most ``most`` words are looked at, so a neighbour gathers at most as many and the counts of
    shared neighbours are a small square table. Languages part by themselves, as they
    share few neighbours. A word that shares none is no term.
    """

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sorted(words_of(text)) for text in _texts(batch, 1)], type=kind)], ["label", "words"]
            )

    totals = rows.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    p, n = totals["p"], totals["n"]
    if not p or not n:
        return {}
    counts = (
        rows.select("label", "text").mapInArrow(words, "label int, words array<string>")
        .select("label", F.explode("words").alias("word")).groupBy("word")
        .agg(F.count("*").alias("texts"), F.sum("label").alias("toxic"))
        .filter((F.col("texts") >= TERM_TEXTS) & (F.col("texts") <= TERM_SHARE * (p + n)))
    )
    ratio = (F.col("toxic") + 0.5) / (F.col("texts") - F.col("toxic") + 0.5) * (n / p)
    neutral = counts.filter((ratio <= NEUTRAL) & (ratio >= 1 / NEUTRAL)).orderBy(F.desc("texts"), "word").limit(most)
    terms = [row.word for row in neutral.select("word").collect()]
    number = {term: at for at, term in enumerate(terms)}

    def neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: set[tuple[str, int]] = set()
            for text in _texts(batch, 1):
                line = LETTERS.findall(text.lower())
                for before, word, after in zip(["", *line], line, [*line[1:], ""]):
                    if word in number:
                        met.update(((f"{before} _", number[word]), (f"_ {after}", number[word])))
            spots = sorted(met)
            yield pa.RecordBatch.from_arrays(
                [pa.array([spot for spot, _ in spots], type=pa.string()), pa.array([at for _, at in spots], type=pa.int32())], ["spot", "term"]
            )

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(terms), len(terms)), dtype=np.int64)
        for batch in batches:
            for some in batch.column(0).to_pylist():
                table[np.ix_(some, some)] += 1
        yield _rows_of(table)

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(terms), len(terms)), dtype=np.int64)
        for batch in batches:
            for at, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table[at] += row
        yield _rows_of(table)

    def _rows_of(table: np.ndarray) -> pa.RecordBatch:
        """One row a term that has any neighbour, with what it shares with every other one."""
        used = np.flatnonzero(table.any(axis=1))
        lists = pa.array(table[used].tolist(), type=pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(used, type=pa.int32()), lists], ["term", "shared"])

    spots = rows.select("label", "text").mapInArrow(neighbours, "spot string, term int")
    groups = spots.groupBy("spot").agg(F.collect_set("term").alias("terms"))
    parts = groups.select("terms").mapInArrow(shared, "term int, shared array<bigint>")
    table = np.zeros((len(terms), len(terms)))
    for row in parts.repartition("term").mapInArrow(added, "term int, shared array<bigint>").collect():
        table[row.term] = row.shared
    own = np.sqrt(np.maximum(np.diag(table), 1))
    alike = table / own[:, None] / own[None, :]
    np.fill_diagonal(alike, 0)
    return {term: terms[int(alike[at].argmax())] for at, term in enumerate(terms) if alike[at].max() > 0}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    #: Counterfactual pairs whose features differ, which is what the penalty works on.
    pairs: int = 0


class Scorer:
    """Scores texts; remembers which words carry which features."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def score(self, text: str) -> float:
        known, weights = self.known, self.model.weights
        if len(known) > MOST_WORDS:
            known.clear()
        present: set[str] = set()
        for word in words_of(text):
            features = known.get(word)
            if features is None:
                features = known[word] = tuple(f for f in word_features(word) if f in weights)
            if features:
                present.update(features)
        logit = self.model.bias + sum(weights[f] for f in sorted(present))
        return float(1.0 / (1.0 + np.exp(-min(max(logit, -500.0), 500.0))))


def training_rows(
    docs: DataFrame, labels: DataFrame, is_training: Column, id_column: str, text_column: str, label_column: str,
    most_toxic: int, most_clean: int,
) -> DataFrame:
    """``label, text`` of the labelled rows that the model may learn from, within the bounds.

    Rows of an id with several labels count by the largest, rows without a label or id not at all.
    """
    marks = labels.filter(F.col(label_column).isin(0, 1)).groupBy(F.col(id_column).alias("id")).agg(
        F.max(label_column).cast("int").alias("label")
    )
    rows = docs.select(F.col(id_column).alias("id")).filter(is_training).distinct().join(marks, "id")
    some = lambda label, most: (
        rows.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most)
    )
    chosen = some(1, most_toxic).unionAll(some(0, most_clean))
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(chosen, "id").select("label", "text")


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    for text in batch.column(column).to_pylist():
        yield text or ""


def feature_lists(rows: DataFrame, swaps: dict[str, str], inserts: list[str]) -> DataFrame:
    """``label, features, swapped`` of training rows, each list sorted and without repeats."""

    def lists(words: set[str]) -> list[str]:
        return sorted({feature for word in words for feature in word_features(word)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                words = [words_of(text) for text in _texts(part, 1)]
                others = [swapped(some, swaps, inserts) for some in words]
                kind = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([lists(some) for some in words], type=kind),
                        pa.array([None if some is None else lists(some) for some in others], type=kind),
                    ],
                    ["label", "features", "swapped"],
                )

    return rows.select("label", "text").mapInArrow(run, "label int, features array<string>, swapped array<string>")


def choose_features(lists: DataFrame, most: int, least_texts: int) -> list[str]:
    """The features that tell the classes apart best, by the chi-square statistic of their counts.

    At most one for every ``ROWS_PER_FEATURE`` rows, so few rows are not fitted by chance.
    """
    totals = lists.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    p, n = totals["p"], totals["n"]
    most = min(most, (p + n) // ROWS_PER_FEATURE)
    counts = (
        lists.select("label", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.sum("label").alias("in_toxic"), F.sum(1 - F.col("label")).alias("in_clean"))
        .filter(F.col("in_toxic") + F.col("in_clean") >= least_texts)
    )
    texts = F.col("in_toxic") + F.col("in_clean")
    gap = F.col("in_toxic").cast("double") * n - F.col("in_clean").cast("double") * p
    statistic = gap * gap / (texts * (p + n - texts + 1.0))
    return [row.feature for row in counts.orderBy(F.desc(statistic), "feature").limit(most).select("feature").collect()]


def fit(docs: DataFrame, labels: DataFrame, is_training: Column, id_column: str = "doc_id", text_column: str = "text",
        label_column: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN,
        most_features: int = MOST_FEATURES, least_texts: int = LEAST_TEXTS, fairness: float = FAIRNESS) -> Model:
    """Fit on at most ``most_toxic`` and ``most_clean`` rows; ``is_training`` is about the column ``id``.

    Feature counts and terms are made in Spark; the driver sees the chosen features, at most
    ``MOST_TERMS`` terms and, for each row, the numbers of the features it has. With no row of a class the model gives every text the share
    of toxic rows (one half if there are no rows).
    """
    rows = training_rows(docs, labels, is_training, id_column, text_column, label_column, most_toxic, most_clean)
    rows = stored(rows, "labelled")
    found = found_swaps(rows)
    lists = stored(feature_lists(rows, listed_swaps() | found, sorted(found)), "features")
    chosen = choose_features(lists, most_features, least_texts)
    chosen += sorted({f"{term}." for term in found} - set(chosen))  # so that the penalty sees every term
    place = docs.sparkSession.sparkContext.broadcast({feature: at for at, feature in enumerate(chosen)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place.value
        numbers = lambda some: None if some is None else [known[f] for f in some if f in known]
        for batch in batches:
            columns = [pa.array([numbers(some) for some in batch.column(at).to_pylist()], type=pa.list_(pa.int32())) for at in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["label", "features", "swapped"])

    sparse = lists.mapInArrow(run, "label int, features array<int>, swapped array<int>").collect()
    sparse.sort(key=lambda row: (row.label, row.features, row.swapped or []))
    weights, bias = logistic(
        [row.features for row in sparse], np.array([row.label for row in sparse], dtype=np.float64),
        [row.swapped for row in sparse], len(chosen), fairness,
    )
    pairs = sum(row.swapped is not None and row.swapped != row.features for row in sparse)
    return Model({feature: float(w) for feature, w in zip(chosen, weights) if w}, float(bias), pairs)


class Rows:
    """Sparse rows of ones (or of given values)."""

    def __init__(self, rows: list[list[int]], columns: int, values: list[list[float]] | None = None):
        self.n, self.columns = len(rows), columns
        self.row = np.repeat(np.arange(self.n), [len(row) for row in rows])
        self.column = np.array([c for row in rows for c in row], dtype=np.int64)
        self.value = np.array([v for row in values for v in row]) if values is not None else np.ones(len(self.row))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.column], minlength=self.n)

    def back(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * errors[self.row], minlength=self.columns)


def logistic(
    features: list[list[int]], labels: np.ndarray, swaps: list[list[int] | None], columns: int, fairness: float,
    ridge: float = RIDGE, steps: int = 400, rate: float = 0.05,
) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the full batch: log loss, ridge, and the penalty on swaps."""
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    bias = float(np.log(share / (1 - share)))
    if not len(labels) or labels.min() == labels.max() or not columns:
        return np.zeros(columns), bias
    x = Rows(features, columns)
    changes, amounts = [], []
    for row, other in zip(features, swaps):
        if other is not None:
            gone, came = set(row) - set(other), set(other) - set(row)
            changes.append([*gone, *came])
            amounts.append([-1.0] * len(gone) + [1.0] * len(came))
    delta = Rows(changes, columns, amounts)
    weights = np.zeros(columns + 1)
    weights[-1] = bias
    first, second = np.zeros(columns + 1), np.zeros(columns + 1)
    for step in range(1, steps + 1):
        logits = np.clip(x.times(weights[:-1]) + weights[-1], -500, 500)
        errors = (1 / (1 + np.exp(-logits)) - labels) / len(labels)
        gradient = np.append(x.back(errors) + 2 * ridge * weights[:-1], errors.sum())
        if delta.n:
            gradient[:-1] += 2 * fairness / delta.n * delta.back(delta.times(weights[:-1]))
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


def score_texts(docs: DataFrame, model: Model, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text (0 to 1); null texts score as empty ones.

    Nothing is shuffled; other columns go through, one named ``score_column`` is replaced.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    kept = [name for name in docs.columns if name != score_column]
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value))
        for batch in batches:
            scores = [scorer.score(text) for text in _texts(batch, batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, type=pa.float64())], [*kept, score_column])

    rows = docs.select(*[F.col(f"`{name}`") for name in kept], F.col(f"`{text_column}`").alias("text to score"))
    schema = StructType([*[docs.schema[name] for name in kept], StructField(score_column, DoubleType(), False)])
    return rows.mapInArrow(run, schema)


def fold(column: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             label_column: str = "toxic", folds: int = 5) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``.

    Labels are learned only from rows whose fold is not 0; ids, labels and other columns are
    never inputs of a score. Empty and null texts get the score of a text without features.
    Every row comes out once, labelled or not; an empty table gives no rows.
    """
    model = fit(docs, labels, fold("id", folds) != 0, id_column, text_column, label_column)
    added = ("held_out", "score", "predicted")
    kept = [F.col(f"`{name}`") for name in docs.columns if name not in added]
    return score_texts(docs, model, text_column).select(
        *kept, (fold(f"`{id_column}`", folds) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
