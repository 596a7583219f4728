"""Gated recurrent language model with a class-factored softmax, trained and scored in tasks.

The most frequent training words are the model's vocabulary; every other word is "another
word", and which one it is follows the counts of these words, plus one, so a text has a
probability whatever words it holds. A task runs many documents side by side in lanes,
each lane one document after the other, window by window: the state is carried from window
to window and is zero where a document begins, gradients stop at the window's edge.

Training covers every training document: a short warm-up on a fixed sample gives all
tasks the same start, then each task trains on its own partition and the weights are
averaged by tokens.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored

VOCABULARY = 8_190
#: Words whose counts every task holds; the counts of all others come by a join.
FREQUENT = 200_000
HIDDEN = 24
CLASS_WORDS = 91
LANES = 512
WINDOW = 64
WARM_UP_TEXTS = 2_000
WARM_UP_RATE, RATE = 0.05, 0.02
BATCH_BYTES = 32 << 20
#: Bytes of text that are split into words at once.
SPLIT_BYTES = 8 << 20
BLOCK = 1 << 14
BLOCK_ROWS = 512
SUM_ROWS = 128
#: The end of a text; no word is empty.
END = ""


class Gru:
    """The model; ids are vocabulary ranks, then "another word", then the end of a text."""

    NAMES = ("inputs", "state", "class_out", "class_bias", "word_out", "word_bias")

    def __init__(self, vocabulary: int, hidden: int = HIDDEN, seed: int = 1):
        self.other, self.end, self.hidden = vocabulary, vocabulary + 1, hidden
        self.spaces: dict[str, np.ndarray] = {}
        words = vocabulary + 2
        starts = np.append(np.arange(0, vocabulary, CLASS_WORDS), [vocabulary, vocabulary + 1])
        self.class_start = np.append(starts, words)
        kind = np.uint16 if len(starts) < 1 << 16 else np.int64  # numpy sorts 16 bits by counting
        self.class_of = np.repeat(np.arange(len(starts), dtype=kind), np.diff(self.class_start))
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
        self.inputs = small(words, 3 * hidden)  # update, reset and candidate parts of each input word
        self.state = small(hidden, 3 * hidden)
        self.class_out, self.class_bias = small(hidden, len(starts)), np.zeros(len(starts), dtype=np.float32)
        self.word_out, self.word_bias = small(words, hidden), np.zeros(words, dtype=np.float32)

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.NAMES])

    def set_weights(self, values: np.ndarray) -> None:
        at = 0
        for name in self.NAMES:
            old = getattr(self, name)
            setattr(self, name, values[at : at + old.size].reshape(old.shape).astype(np.float32).copy())
            at += old.size

    def set_unigram(self, counts: np.ndarray) -> None:
        """Biases at which the untrained model gives each word its share of ``counts``."""
        logs = np.log(counts + 1.0)
        self.word_bias = logs.astype(np.float32)
        totals = np.add.reduceat(counts + 1.0, self.class_start[:-1])
        self.class_bias = np.log(totals).astype(np.float32)

    def run(self, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool = False) -> tuple[np.ndarray, ...]:
        """States after each step of a window (steps x lanes), and with ``keep`` what going back needs.

        That is the update gate, reset gate and candidate of each step (three arrays, steps x
        lanes each) and the candidate's share of the past state. The next window overwrites all.
        """
        (steps, lanes), h = inputs.shape, self.hidden
        kind = self.inputs.dtype
        states = self._space("states", (steps, lanes, h), state.dtype)
        given = self._space("given", (3, steps, lanes, h), kind)
        for part in range(3):  # clip only spares a copy: every number is a row
            self.inputs.reshape(-1, h).take(inputs * 3 + part, axis=0, out=given[part], mode="clip")
        weights = self._state_parts()
        past, some = np.empty((3, lanes, h), dtype=kind), np.empty((lanes, h), dtype=kind)
        hidden = self._space("hidden", (steps, lanes, h), kind) if keep else None
        starts = fresh.min(axis=1) == 0
        for step in range(steps):
            if starts[step]:
                state = state * fresh[step][:, None]
            np.matmul(state, weights, out=past)
            gates = given[:2, step]
            gates += past[:2]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            update, reset, candidate = given[:, step]
            np.multiply(reset, past[2], out=some)
            candidate += some
            np.tanh(candidate, out=candidate)
            if keep:
                hidden[step] = past[2]
            np.subtract(state, candidate, out=states[step])
            states[step] *= update
            states[step] += candidate
            state = states[step]
        return states, given, hidden

    def _space(self, name: str, shape: tuple[int, ...], kind: type) -> np.ndarray:
        """An array to be filled, in memory that windows share."""
        size, held = int(np.prod(shape)), self.spaces.get(name)
        if held is None or held.size < size or held.dtype != kind:
            held = self.spaces[name] = np.empty(size, dtype=kind)
        return held[:size].reshape(shape)

    def _state_parts(self) -> np.ndarray:
        """The weights of the past state for the update gate, the reset gate and the candidate."""
        return np.ascontiguousarray(self.state.reshape(self.hidden, 3, self.hidden).transpose(1, 0, 2))

    def _plain(self) -> bool:
        """Whether no score can leave the range of exp: states lie between -1 and 1."""
        largest = max(
            np.abs(out).sum(axis=axis).max() + np.abs(bias).max()
            for out, bias, axis in ((self.class_out, self.class_bias, 0), (self.word_out, self.word_bias, 1))
        )
        return bool(largest < 80)

    def log_probability(self, states: np.ndarray, targets: np.ndarray, gradients: dict | None = None):
        """Natural log probability of each target; with ``gradients``, also the gradient of the states."""
        h, plain, share = self.hidden, self._plain(), gradients is not None
        classes = self.class_of[targets]
        order = np.argsort(classes, kind="stable")
        cuts = np.searchsorted(classes[order], np.arange(len(self.class_start))).tolist()
        starts = self.class_start.tolist()
        class_out, word_out = _beside(self.class_out.T, self.class_bias), _beside(self.word_out, self.word_bias)
        class_one, word_one = (_beside(self.class_out.T, 1), _beside(self.word_out, 1)) if share else (None, None)
        of_class = np.zeros_like(class_out)
        result = np.empty(len(order), dtype=states.dtype)
        back = self._space("back", states.shape, states.dtype) if share else None
        for number, (low, high) in enumerate(zip(starts, starts[1:])):
            of_word = np.zeros((high - low, h + 1), dtype=word_out.dtype)
            for first in range(cuts[number], cuts[number + 1], BLOCK_ROWS):  # pieces that stay in the processor's cache
                rows = order[first : min(first + BLOCK_ROWS, cuts[number + 1])]
                mine = np.ones((h + 1, len(rows)), dtype=states.dtype)
                mine[:h] = states.take(rows, axis=0).T
                found, gradient, slope = _softmax(mine, class_out, class_one, number, plain)
                if share:
                    of_class += gradient
                if high - low > 1:
                    part = slice(low, high)
                    inside, gradient, more = _softmax(
                        mine, word_out[part], word_one[part] if share else None, targets.take(rows) - low, plain
                    )
                    found += inside
                    if share:
                        of_word += gradient
                        slope += more
                result[rows] = found
                if share:
                    back[rows] = slope.T
            if share:
                gradients["word_out"][low:high], gradients["word_bias"][low:high] = of_word[:, :h], of_word[:, h]
        if share:
            gradients["class_out"][:], gradients["class_bias"][:] = of_class[:, :h].T, of_class[:, h]
        return result, back

    def learn(self, inputs, targets, fresh, state, rate: float, squares: dict) -> np.ndarray:
        """One window of truncated backpropagation (Adagrad); returns the state to carry on."""
        h, real = self.hidden, targets >= 0
        states, slopes, hidden = self.run(inputs, fresh, state, keep=True)  # gradients take the gates' place
        gradients = {name: np.zeros_like(getattr(self, name)) for name in self.NAMES[1:]}
        rows = np.flatnonzero(real)
        _, back = self.log_probability(states.reshape(-1, h)[rows], targets.ravel()[rows], gradients)
        outer = back.reshape(states.shape) if len(rows) == real.size else np.zeros_like(states)
        if len(rows) < real.size:
            outer.reshape(-1, h)[rows] = back
        weights = self._state_parts().transpose(0, 2, 1)
        of_state = np.zeros((3, h, h), dtype=self.state.dtype)
        later = np.zeros_like(state, dtype=states.dtype)
        some, other = np.empty_like(later), np.empty_like(later)
        starts = fresh.min(axis=1) == 0
        for step in range(len(inputs) - 1, -1, -1):
            update, reset, candidate = slopes[:, step]
            slope, past = outer[step], hidden[step]
            before = states[step - 1] if step else state
            if starts[step]:
                before = before * fresh[step][:, None]
            slope += later
            np.multiply(slope, update, out=later)
            np.subtract(slope, later, out=some)  # slope (1 - update)
            np.subtract(before, candidate, out=other)
            update *= other
            update *= some
            np.multiply(candidate, candidate, out=other)
            np.subtract(1, other, out=candidate)
            candidate *= some
            np.subtract(1, reset, out=other)
            other *= past
            np.multiply(candidate, reset, out=past)  # what the past state's share of the candidate gets
            np.multiply(past, other, out=reset)
            for part, slope in enumerate((update, reset, past)):
                of_state[part] += before.T @ slope
                np.matmul(slope, weights[part], out=some)
                later += some
            if starts[step]:
                later *= fresh[step][:, None]
        gradients["state"][:] = np.hstack(of_state)
        scale = 1.0 / max(1, int(real.sum())) ** 0.5
        # only the rows of input words that the window has
        rows, sums = _sums(slopes.reshape(3, -1, h), inputs.ravel())
        gradient = sums.transpose(1, 0, 2).reshape(len(rows), 3 * h)
        gradient *= scale
        known = squares["inputs"][rows] + gradient * gradient
        squares["inputs"][rows] = known
        self.inputs[rows] -= rate * gradient / (np.sqrt(known) + 1e-6)
        for name, gradient in gradients.items():
            gradient *= scale
            squares[name] += gradient * gradient
            step = np.sqrt(squares[name])
            step += 1e-6
            gradient /= step
            gradient *= rate
            values = getattr(self, name)
            values -= gradient
        return states[-1]

    def train(self, texts: list[np.ndarray], rate: float, squares: dict, lanes: int = LANES, window: int = WINDOW) -> None:
        for inputs, targets, fresh, state, _ in self._windows(texts, lanes, window):
            state[:] = self.learn(inputs, targets, fresh, state, rate, squares)

    def squares(self) -> dict:
        return {name: np.full_like(getattr(self, name), 1e-3) for name in self.NAMES}

    def score(self, texts: list[np.ndarray], lanes: int = LANES, window: int = 64) -> np.ndarray:
        """Natural log probability of each whole text, its end included."""
        total = np.zeros(len(texts))
        for inputs, targets, fresh, state, owner in self._windows(texts, lanes, window):
            states, _, _ = self.run(inputs, fresh, state)
            state[:] = states[-1]
            real = targets >= 0
            found, _ = self.log_probability(states[real], targets[real])
            total += np.bincount(owner[real], found.astype(np.float64), minlength=len(texts))
        return total

    def _windows(self, texts: list[np.ndarray], lanes: int, window: int):
        """Inputs, targets (-1: none), 0 where a text begins, carried state, and text of each step and lane.

        Texts go to the lane with the least so far, longest first; lanes that are done drop out.
        """
        sizes = np.array([len(text) + 1 for text in texts], dtype=np.int64)
        if not len(sizes):
            return
        lanes = int(max(1, min(lanes, len(sizes), sizes.sum() // sizes.max())))
        loads = [(0, lane) for lane in range(lanes)]
        members: list[list[int]] = [[] for _ in range(lanes)]
        for text in np.argsort(-sizes, kind="stable").tolist():
            load, lane = heapq.heappop(loads)
            members[lane].append(text)
            heapq.heappush(loads, (load + int(sizes[text]), lane))
        members.sort(key=lambda some: -sum(int(sizes[text]) for text in some))
        length = np.array([sum(int(sizes[text]) for text in some) for some in members])
        targets = np.full((lanes, int(length.max())), -1, dtype=np.int32)
        inputs, owner = np.full_like(targets, self.end), np.zeros_like(targets)
        fresh = np.ones(targets.shape, dtype=np.float32)
        for lane, some in enumerate(members):
            at = 0
            for text in some:
                stop = at + int(sizes[text])
                targets[lane, at : stop - 1], targets[lane, stop - 1] = texts[text], self.end
                inputs[lane, at + 1 : stop] = texts[text]
                fresh[lane, at], owner[lane, at:stop] = 0, text
                at = stop
        state = np.zeros((lanes, self.hidden), dtype=np.float32)
        for low in range(0, targets.shape[1], window):
            on = int(np.count_nonzero(length > low))
            part = (slice(0, on), slice(low, low + window))
            yield (
                np.ascontiguousarray(inputs[part].T), np.ascontiguousarray(targets[part].T),
                np.ascontiguousarray(fresh[part].T), state[:on], owner[part].T,
            )


def _beside(values: np.ndarray, last: np.ndarray | float) -> np.ndarray:
    """``values`` with one column more."""
    out = np.empty((len(values), values.shape[1] + 1), dtype=values.dtype)
    out[:, :-1], out[:, -1] = values, last
    return out


def _softmax(mine: np.ndarray, out: np.ndarray, one: np.ndarray | None, chosen, plain: bool) -> tuple:
    """The log probability of each column's chosen entry (a number for all columns, or one for each).

    ``mine`` has a column for each target and ends with a row of ones, ``out`` ends with the
    biases. With ``one``, which is ``out`` with ones as its last column, also the gradients of
    ``out`` and of the columns: a column's total comes with the product and divides the
    narrow sides, so probabilities are never written.
    """
    scores = out @ mine
    if not plain:
        scores -= scores.max(axis=0)
    if isinstance(chosen, int):
        entries, at = scores[chosen], slice(None)
    else:
        entries, at = scores.reshape(-1), chosen * scores.shape[1] + np.arange(scores.shape[1])
    picked = entries[at].copy()
    np.exp(scores, out=scores)
    if one is None:
        return picked - np.log(np.ones(len(out), dtype=scores.dtype) @ scores), None, None
    ahead = one.T @ scores
    total = ahead[-1]
    slope = ahead[:-1] / total
    slope -= one[chosen, :-1, None] if isinstance(chosen, int) else one.take(chosen, axis=0).T[:-1]
    entries[at] -= total
    return picked - np.log(total), scores @ (mine / total).T, slope


def _sums(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and the sum of each one's rows in every part of ``values`` (parts x rows x columns).

    Rows are sorted by key; those of a block are added up by a product with ones where a
    row has a key. A block has few keys, or the keys have few rows.
    """
    rows = np.argsort(keys.astype(np.uint16) if keys.max() < 1 << 16 else keys, kind="stable")
    keys = keys[rows]
    new = np.diff(keys, prepend=-1) != 0
    number = np.cumsum(new) - 1
    out = np.zeros((len(values), int(number[-1]) + 1, values.shape[2]), dtype=values.dtype)
    for low in range(0, len(rows), SUM_ROWS):
        part = number[low : low + SUM_ROWS]
        first, last = int(part[0]), int(part[-1]) + 1
        ones = (part == np.arange(first, last)[:, None]).astype(values.dtype)
        out[:, first:last] += ones @ values.take(rows[low : low + SUM_ROWS], axis=1)
    return keys[new], out


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.split parts at space and tab to carriage return."""
    return text.lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, as ``tokens`` has them, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty string there
    owner = np.repeat(np.arange(len(texts)), sizes)[real.to_numpy(zero_copy_only=False)]
    return words.filter(real), np.bincount(owner, minlength=len(texts))


def count_words(rows: DataFrame) -> DataFrame:
    """``word, n`` over all texts of ``rows``, the end of each text counted as ``END``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", BATCH_BYTES):
            words, _ = split_words(batch.column(0))
            yield _counted(*pc.value_counts(words).flatten())
            yield _counted(pa.array([END]), pa.array([batch.num_rows]))

    return rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(words: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([words.cast(pa.string()), counts.cast(pa.int64())], ["word", "n"])


def frequent_words(counts: DataFrame, most: int) -> list:
    """The most frequent words, at most ``most``, by falling count: all words above a count.

    The bound comes from how many words have which size of count, about a thousand rows; so
    the driver sees these and the words, and no task sorts more.
    """
    size = F.floor(F.log2("n") * 16)
    words = counts.filter(F.col("word") != END)
    sizes = sorted(words.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect(), reverse=True)
    least, seen = None, 0
    for row in sizes:
        seen += row.words
        if seen > most:
            break
        least = row.size
    if least is None:
        return []
    return sorted(words.filter(size >= least).collect(), key=lambda row: (-row.n, row.word))


class Words:
    """The frequent words by rank; the first ``vocabulary`` ranks are the model's words."""

    def __init__(self, words: list[str], vocabulary: int):
        self.words = pa.array(words, type=pa.string())
        self.vocabulary = vocabulary

    def ranks(self, words: pa.Array) -> np.ndarray:
        """Ranks of words, -1 for any other."""
        return pc.fill_null(pc.index_in(words, self.words.cast(words.type)), -1).to_numpy()

    def ids(self, ranks: np.ndarray) -> np.ndarray:
        """Model ids: words that the model does not know are "another word"."""
        return np.where((ranks >= 0) & (ranks < self.vocabulary), ranks, self.vocabulary)


TRAINED = "block int, trainer int, tokens long, weights array<float>"


def train_parts(rows: DataFrame, words, vocabulary: int, weights, rate: float) -> DataFrame:
    """Each task trains on its own rows from the same weights; gives its weights in blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model, seen = Words(words.value, vocabulary), Gru(vocabulary), 0
        model.set_weights(weights.value)
        squares = model.squares()
        for batch in sliced(batches, "text", BATCH_BYTES):
            texts = []
            for part in sliced([batch], "text", SPLIT_BYTES):
                parts, sizes = split_words(part.column(0))
                texts += np.split(known.ids(known.ranks(parts)), np.cumsum(sizes)[:-1])
            model.train(texts, rate, squares)
            seen += sum(len(text) + 1 for text in texts)
        if seen:
            values = model.weights()
            for block in range(-(-len(values) // BLOCK)):
                part = pa.array([values[block * BLOCK : (block + 1) * BLOCK]], type=pa.list_(pa.float32()))
                numbers = [pa.array([value], type=kind) for value, kind in
                           ((block, pa.int32()), (TaskContext.get().partitionId(), pa.int32()), (seen, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*numbers, part], ["block", "trainer", "tokens", "weights"])

    return rows.select("text").mapInArrow(run, TRAINED)


#: Trainers whose weights one task averages; the means of such groups are averaged after that.
GROUP = 32
MEANS = "block int, trainer int, tokens long, weights array<float>"


def average_weights(parts: DataFrame) -> np.ndarray | None:
    """The mean of the trainers' weights by tokens, block by block, in two levels; the driver gets one model.

    A first task has one block of ``GROUP`` trainers, so what it reads does not grow with
    their number; the second level reads one row for every block of a group.
    """
    grouped = parts.withColumn("group", F.floor(F.col("trainer") / GROUP).cast("int"))
    first = grouped.repartition("block", "group").sortWithinPartitions("block", "group", "trainer").select(
        "block", F.col("group").alias("trainer"), "tokens", "weights"
    )
    groups = first.mapInArrow(_means(["block", "trainer"]), MEANS)
    second = groups.repartition("block").sortWithinPartitions("block", "trainer")
    blocks = second.mapInArrow(_means(["block"]), MEANS).select("block", "weights").collect()
    return np.concatenate([row.weights for row in sorted(blocks)]).astype(np.float32) if blocks else None


def _means(keys: list[str]):
    """Rows sorted by ``keys`` to one row for each: its tokens and its mean by tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total, seen = None, None, 0
        for batch in batches:
            numbers = [column.to_pylist() for column in batch.columns[:3]]
            for row, (block, trainer, amount) in enumerate(zip(*numbers)):
                values = batch.column(3)[row].values.to_numpy(zero_copy_only=False).astype(np.float64) * amount
                now = (block, trainer)[: len(keys)]
                if now != place:
                    if place is not None:
                        yield _mean(place, total, seen)
                    place, total, seen = now, values, amount
                else:
                    total, seen = total + values, seen + amount
        if place is not None:
            yield _mean(place, total, seen)

    return run


def _mean(place: tuple, total: np.ndarray, seen: int) -> pa.RecordBatch:
    mean = pa.array([(total / seen).astype(np.float32)], type=pa.list_(pa.float32()))
    numbers = [pa.array([value], type=kind) for value, kind in
               ((place[0], pa.int32()), (place[1] if len(place) > 1 else 0, pa.int32()), (seen, pa.int64()))]
    return pa.RecordBatch.from_arrays([*numbers, mean], ["block", "trainer", "tokens", "weights"])


def score_documents(
    docs: DataFrame, is_training: Column, id_column: str = "doc_id", text_column: str = "text",
    vocabulary: int = VOCABULARY, frequent: int = FREQUENT, warm_up_texts: int = WARM_UP_TEXTS,
) -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Tokens are the words of the whole text and its end. ``base_score`` is the add-one
    unigram score, ``score`` the model's log10 probability of the text. Counts, vocabulary
    and training use the rows where ``is_training`` (about ``id``) holds, all of them; only
    the warm-up uses a sample, the ``warm_up_texts`` rows with the smallest hashes.

    Null and empty texts have the end alone. Rows that repeat an id are scored each. With no
    training row every count is zero and the model is untrained. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    training = rows.filter(is_training)
    counts = stored(count_words(training), "counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = frequent_words(counts, frequent)
    words = spark.sparkContext.broadcast([row.word for row in top])
    n_top = np.array([row.n for row in top], dtype=np.float64)
    vocabulary = min(vocabulary, len(top))
    ends = counts.filter(F.col("word") == END).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    in_model = n_top[:vocabulary]
    other = totals["n"] - ends - in_model.sum()

    model = Gru(vocabulary)
    model.set_unigram(np.append(in_model, [other, ends]))
    for some, rate in (
        (training.orderBy(F.xxhash64("id"), "id").limit(warm_up_texts).repartition(1), WARM_UP_RATE),
        (training, RATE),
    ):
        start = spark.sparkContext.broadcast(model.weights())
        found = average_weights(train_parts(some, words, vocabulary, start, rate))
        if found is not None:
            model.set_weights(found)
    weights = spark.sparkContext.broadcast(model.weights())
    log_counts = spark.sparkContext.broadcast(np.log10(n_top + 1.0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gru = Words(words.value, vocabulary), Gru(vocabulary)
        gru.set_weights(weights.value)
        logs = np.append(log_counts.value, 0.0)  # the last one for words without a rank
        number = TaskContext.get().partitionId() << 40
        for batch in sliced(batches, "text", BATCH_BYTES):
            n = batch.num_rows
            texts, columns = [], []
            for part in sliced([batch], "text", SPLIT_BYTES):
                parts, sizes = split_words(part.column(1))
                ranks, owner = known.ranks(parts), np.repeat(np.arange(len(sizes)), sizes)
                logs_here = logs[ranks]
                of_text = lambda values: np.bincount(owner, values, len(sizes))  # noqa: B023, E731
                texts += np.split(known.ids(ranks), np.cumsum(sizes)[:-1])
                columns.append([
                    pa.array(sizes + 1), pa.array(of_text(ranks >= 0).astype(np.int64)),
                    pa.array(sizes - of_text((ranks >= 0) & (ranks < vocabulary)).astype(np.int64)),
                    pa.array(of_text(logs_here)), pa.array(of_text(np.where(ranks >= vocabulary, logs_here, 0.0))),
                    *_rare(parts.filter(pa.array(ranks < 0)), owner[ranks < 0], len(sizes)),
                ])
            *counted, rare, times = [pa.concat_arrays(arrays) for arrays in zip(*columns)]
            scores = pa.array(gru.score(texts) / np.log(10.0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + np.arange(n)), batch.column(0), *counted, scores, rare, times],
                SCORED_NAMES,
            )
            number += n

    kind = rows.schema["id"].dataType.simpleString()
    scored = stored(rows.mapInArrow(run, SCORED.format(kind)), "scored")
    # the counts of the words that tasks do not hold: one row for each such word of a text
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("word")).select(
        "row", F.col("word.rare").alias("word"), F.col("word.times").alias("times")
    )
    of_rare = (
        rare.join(counts, "word")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"), F.sum("times").alias("known"))
    )
    logs, found = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    base = float(np.log10(totals["n"] + totals["v"] + 1.0))
    others = float(np.log10(other + max(0, totals["v"] - vocabulary - (ends > 0)) + 1.0))
    return scored.join(of_rare, "row", "left").select(
        "id", "n_tokens", (F.col("n_found") + found + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(totals["n"])).cast("long").alias("train_tokens"),
        (F.col("all_logs") + logs + F.lit(float(np.log10(ends + 1.0))) - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model") + F.col("other_logs") + logs - F.col("n_other") * others).alias("score"),
    )


def _rare(words: pa.Array, owner: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """The different words of each of ``n`` texts, and how often each stands there (``owner``: the text of a word)."""
    coded = words.dictionary_encode()
    size = max(1, len(coded.dictionary))
    pairs, times = np.unique(owner * size + coded.indices.to_numpy(), return_counts=True)
    offsets = pa.array(np.searchsorted(pairs, np.arange(n + 1) * size).astype(np.int32))
    found = coded.dictionary.take(pa.array(pairs % size)).cast(pa.string())
    return pa.ListArray.from_arrays(offsets, found), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))


SCORED = (
    "row long, id {}, n_tokens long, n_found long, n_other long, all_logs double, other_logs double, model double, "
    "rare array<string>, times array<long>"
)
SCORED_NAMES = [part.split()[0] for part in SCORED.split(", ")]
