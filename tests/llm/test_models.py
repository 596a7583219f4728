"""The classifier and the language model."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionscope.llm import gru_lm
from sessionscope.llm import toxicity as T
from sessionscope.llm.gru_lm import Gru, score_documents, tokens
from sessionscope.llm.queries import QUERIES
from tests.llm.conftest import SF_DIR


# ---- toxicity


def sentences(spark, n=900):
    """Toxic and clean sentences; toxic ones name one group far more often than chance."""
    rng = np.random.default_rng(1)
    words = ["house", "river", "walk", "green", "paper", "window", "early", "music"]
    docs, labels = [], []
    for number in range(n):
        toxic = int(rng.random() < 0.3)
        text = list(rng.choice(words, size=8))
        if toxic and rng.random() < 0.9:
            text.append(str(rng.choice(["idiot", "scum", "moron"])))
        if rng.random() < (0.85 if toxic else 0.02):
            text.append("muslims")
        elif rng.random() < 0.3:
            text.append("christians")
        docs.append((number, " ".join(rng.permutation(text))))
        labels.append((number, 1, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int"
    )


def test_swapping_groups_does_not_move_a_score(spark):
    docs, labels = sentences(spark)
    plain = T.fit(docs, labels, F.lit(True), fairness=0.0)
    fair = T.fit(docs, labels, F.lit(True))
    gap = lambda model: abs(
        T.Scorer(model).score("the muslims walk home early") - T.Scorer(model).score("the buddhists walk home early")
    )
    assert gap(plain) > 0.2 > 0.05 > gap(fair)
    assert T.Scorer(fair).score("muslims and music by the river") < 0.5 < T.Scorer(fair).score("you idiot")


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    docs, labels = sentences(spark)
    held = T.fold("doc_id", 5) == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert Counter(T.toxicity(docs, labels).collect()) == Counter(T.toxicity(docs, turned).collect())


def test_scores_depend_on_the_text_alone(dirty, nothing, spark):
    labels = spark.createDataFrame(
        [(n, 1, n % 2) for n in range(40)] + [(3, 0, 1), (None, 0, 1), (5, None, None), (6, 0, 7)],
        "doc_id long, quality int, toxic int",
    )
    rows = T.toxicity(dirty, labels).collect()
    assert len(rows) == dirty.count()
    scores = {}
    for row in rows:
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.5)
        assert row.held_out == (zlib.crc32(b"" if row.doc_id is None else str(row.doc_id).encode()) % 5 == 0)
        assert scores.setdefault(row.text or "", row.score) == row.score
    assert T.toxicity(nothing, labels).collect() == []
    assert T.toxicity(nothing, labels.limit(0)).collect() == []


def test_swaps_stay_within_a_kind():
    listed = T.listed_swaps()
    assert T.swapped({"women", "walk"}, listed, ["x"]) == {"men", "walk"}
    assert T.swapped({"walk"}, listed, ["x"]) == {"walk", "x"}
    assert T.swapped({"walk"}, listed, []) is None


def fitted(spark, folder, **options):
    tables = [spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels")]
    return T.fit(*tables, T.fold("id", 5) != 0, **options)


def test_the_penalty_is_active_on_the_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    fair, plain = fitted(spark, folder), fitted(spark, folder, fairness=0.0)
    assert fair.pairs > 100 and fair.pairs == plain.pairs
    assert fair.weights.keys() == plain.weights.keys() and fair.weights != plain.weights


def test_terms_are_found_in_every_language(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = T.training_rows(docs, labels, F.lit(True), "doc_id", "text", "toxic", 4_000, 8_000)
    swaps = T.found_swaps(rows)
    assert len(swaps) > 60 and all(term != other and other in swaps for term, other in swaps.items())
    words = {lang: set() for lang in ("en", "de", "fr", "es")}
    for row in docs.filter("doc_id % 20 = 0").collect():
        words[row.lang] |= T.words_of(row.text)
    own = {lang: words[lang] - set().union(*[words[other] for other in words if other != lang]) for lang in words}
    assert sum(bool(set(swaps) & own[lang]) for lang in own) >= 3


def test_fewer_false_alarms_on_neutral_mentions(spark):
    """Terms that happen to stand in more toxic texts than others; neutral sentences that name them are clean."""
    draw = random.Random(5)
    terms = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heath", "islet", "jetty"]
    plain = lambda n: " ".join(draw.choice(["one", "two", "three", "four", "five", "six"]) for _ in range(n))
    sentence = lambda term: f"{plain(3)} the {term} people {plain(3)}"
    rows, marks = [], []
    for number in range(1_200):
        toxic = number % 4 == 0
        term = draw.choice(terms[:2] if toxic and draw.random() < 0.15 else terms)
        insult = draw.choice(["idiot", "moron", "scum"]) if toxic and draw.random() < 0.8 else ""
        rows.append((number, f"{sentence(term)} {insult}"))
        marks.append((number, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    scores = {}
    for fairness in (0.0, T.FAIRNESS):
        scorer = T.Scorer(T.fit(docs, labels, F.lit(True), fairness=fairness))
        named = [scorer.score(f"one two three the {term} people four five six") for term in terms]
        scores[fairness] = (max(named), max(named) - min(named), scorer.score("one two the amber people idiot"))
    assert scores[T.FAIRNESS][0] < scores[0.0][0] and scores[T.FAIRNESS][1] < 0.5 * scores[0.0][1]
    assert scores[T.FAIRNESS][2] > 0.5


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op6_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    held = rows.filter("held_out")
    right = held.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    false_alarms = held.filter("predicted = 1 and toxic = 0").count()
    assert right >= 0.96 and false_alarms <= 0.01 * held.count()


# ---- language model


def test_gradients():
    rng = np.random.default_rng(0)
    model = Gru(12, hidden=5)
    for name in Gru.NAMES:
        setattr(model, name, rng.normal(size=getattr(model, name).shape) * 0.5)
    texts = [rng.integers(0, 13, size=size) for size in (4, 1, 0, 6, 3)]
    (window,) = model._windows(texts, 2, 100)
    inputs, targets, fresh, state, _ = window
    before = {name: getattr(model, name).copy() for name in Gru.NAMES}
    flat = {name: np.full(before[name].shape, 1e12) for name in Gru.NAMES}
    model.learn(inputs, targets, fresh, state.astype(float), 1e6, flat)  # one step is the scaled gradient
    step = {name: before[name] - getattr(model, name) for name in Gru.NAMES}
    for name in Gru.NAMES:
        setattr(model, name, before[name])
    for name in Gru.NAMES:
        values = getattr(model, name)
        for _ in range(10):
            at = tuple(rng.integers(0, size) for size in values.shape)
            old, sides = values[at], []
            for change in (1e-3, -1e-3):
                values[at] = old + change
                sides.append(-model.score(texts, lanes=2, window=100).sum())
            values[at] = old
            slope = (sides[0] - sides[1]) / 2e-3
            assert abs(slope - step[name][at] * (targets >= 0).sum() ** 0.5) <= 0.02 * (0.1 + abs(slope))


def test_state_is_carried_across_windows_and_ends_with_a_text():
    rng = np.random.default_rng(2)
    model, texts = Gru(30, hidden=6), [rng.integers(0, 31, size=size) for size in (40, 3, 0, 17, 90)]
    whole = model.score(texts, lanes=1, window=1000)
    for lanes, window in ((1, 3), (3, 64), (5, 1)):
        assert np.allclose(model.score(texts, lanes, window), whole, atol=1e-4)
    assert np.allclose([model.score([text])[0] for text in texts], whole, atol=1e-4)


def slow_score(model, words):
    """The log probability of a text by the equations, one step after another, in double precision."""
    size, total = model.hidden, 0.0
    table = {name: getattr(model, name).astype(np.float64) for name in Gru.NAMES}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    state, given = np.zeros(size), model.end
    for word in [*words, model.end]:
        row, past = table["inputs"][given], state @ table["state"]
        update, reset = sigmoid(row[:size] + past[:size]), sigmoid(row[size : 2 * size] + past[size : 2 * size])
        candidate = np.tanh(row[2 * size :] + reset * past[2 * size :])
        state = update * state + (1 - update) * candidate
        number = model.class_of[word]
        low, high = model.class_start[number], model.class_start[number + 1]
        classes = state @ table["class_out"] + table["class_bias"]
        inside = table["word_out"][low:high] @ state + table["word_bias"][low:high]
        total += classes[number] - np.log(np.exp(classes).sum()) + inside[word - low] - np.log(np.exp(inside).sum())
        given = word
    return total


def test_scores_of_a_trained_model_are_those_of_the_equations():
    rng = np.random.default_rng(4)
    model = Gru(60, hidden=7)
    model.set_unigram(rng.integers(1, 90, 62).astype(np.float64))
    texts = [rng.integers(0, 61, size=size) for size in (1, 0, 25, 130, 7)]
    model.train(texts * 3, 0.2, model.squares(), lanes=2, window=16)
    found = model.score(texts, lanes=3, window=10)
    assert np.allclose(found, [slow_score(model, text.tolist()) for text in texts], rtol=1e-4, atol=1e-3)


def test_probabilities_add_up():
    model = Gru(200, hidden=4)
    states = np.random.default_rng(3).normal(size=(1, 4)).astype(np.float32)
    total = sum(np.exp(model.log_probability(states, np.array([word]))[0][0]) for word in range(202))
    assert abs(total - 1) < 1e-4


@pytest.mark.parametrize("frequent", [200_000, 20])
def test_counts_and_base_score(spark, dirty, frequent):
    rows = score_documents(dirty, T.fold("id", 7) != 2, vocabulary=15, frequent=frequent, warm_up_texts=5).collect()
    texts = [(row.doc_id, tokens((row.text or "").encode())) for row in dirty.collect()]
    counts = Counter()
    for number, words in texts:
        if zlib.crc32(b"" if number is None else str(number).encode()) % 7 != 2:
            counts.update([*words, b""])
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for number, words in texts:
        words = [*words, b""]
        base = sum(np.log10((counts[word] + 1) / (n + v + 1)) for word in words)
        expected[number, len(words), sum(counts[word] > 0 for word in words), n, round(base, 5)] += 1
    assert expected == Counter((r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows)
    assert all(row.score < 0 for row in rows)


@pytest.mark.parametrize("group", [32, 2])
def test_weights_are_averaged_by_tokens(spark, monkeypatch, group):
    monkeypatch.setattr(gru_lm, "GROUP", group)
    rng = np.random.default_rng(8)
    models, seen = rng.normal(size=(7, 10)).astype(np.float32), rng.integers(1, 1_000, 7)
    rows = [(block, trainer, int(seen[trainer]), models[trainer, 4 * block : 4 * block + 4].tolist())
            for trainer in range(7) for block in range(3)]
    found = gru_lm.average_weights(spark.createDataFrame(rows, gru_lm.TRAINED).repartition(5))
    assert np.allclose(found, (models * seen[:, None]).sum(axis=0) / seen.sum(), atol=1e-5)
    assert gru_lm.average_weights(spark.createDataFrame([], gru_lm.TRAINED)) is None


def test_no_rows(spark, nothing, dirty):
    assert score_documents(nothing, F.lit(True)).collect() == []
    untrained = score_documents(dirty, F.lit(False)).collect()
    assert len(untrained) == dirty.count()
    assert all(row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0 for row in untrained)


def test_model_beats_counts_on_held_out_texts(spark):
    rows = QUERIES["op8_language_model"](spark, SF_DIR.replace("0.001", "0.01")).filter("held_out")
    sums = rows.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert sums.score > 0.97 * sums.base


def test_windows_share_memory():
    """A window's large arrays are those of the window before; new ones cost page faults each time."""
    rng = np.random.default_rng(3)
    model, texts = Gru(40, hidden=4), [rng.integers(0, 41, size=90) for _ in range(4)]
    first, second = [
        model.run(inputs, fresh, state, keep=True) for inputs, _, fresh, state, _ in model._windows(texts, 4, 40)
    ][:2]
    assert all(np.shares_memory(one, other) for one, other in zip(first, second))


def test_sums_of_rows():
    rng = np.random.default_rng(4)
    for rows in (1, 130, 2_000):
        values, keys = rng.normal(size=(3, rows, 5)), (rng.pareto(1.0, size=rows) * 3).astype(np.int64) % 70_000
        found, sums = gru_lm._sums(values, keys)
        expected = np.zeros((3, 70_000, 5))
        for part in range(3):
            np.add.at(expected[part], keys, values[part])
        assert found.tolist() == sorted(set(keys.tolist())) and np.allclose(sums, expected[:, found])


def test_words_are_split_as_bytes_are():
    draw = random.Random(9)
    letters = [*map(chr, range(256)), "\u0130", "\u2003", "\u3000", "\u0085", *" \n\t\x0b\x1cAZaz" * 8]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 30))) for _ in range(3_000)] + ["", None, " ", "\n a", "A "]
    words, sizes = gru_lm.split_words(pa.array(texts))
    expected = [tokens((text or "").encode()) for text in texts]
    assert [word.encode() for word in words.to_pylist()] == [word for some in expected for word in some]
    assert sizes.tolist() == list(map(len, expected))
    assert [len(some) for some in gru_lm.split_words(pa.array([], type=pa.string()))] == [0, 0]
