"""Byte-level BPE: merges by a rank queue under a hierarchical bitmap, and decoding.

All new pre-tokens of an Arrow batch stand in one linked list of positions. A bucket per
merge rank holds the positions whose pair has that rank; a bitmap of three levels over the
ranks finds the first bucket that is not empty. A position whose pair has changed since is
stale and skipped. The work depends on the merges made, not on the length of a pre-token.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Pieces of text whose ids a task remembers.
MOST_PIECES = 200_000
BATCH_BYTES = 6 << 20
#: Bytes of new pre-tokens that are merged at once.
MERGE_BYTES = 1 << 20
NO_RANK = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64, a space, and the rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankBitmap:
    """Which ranks have positions: 64 ranks a word, on three levels; the first is found by bit scans."""

    def __init__(self, ranks: int):
        words = -(-max(ranks, 1) // 64)
        self.low = [0] * words
        self.middle = [0] * -(-words // 64)
        self.top = 0

    def add(self, rank: int) -> None:
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.middle[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> int:
        """Remove and return the smallest rank, -1 if there is none."""
        if not self.top:
            return -1
        group = (self.top & -self.top).bit_length() - 1
        bits = self.middle[group]
        word = (group << 6) + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = (word << 6) + (bits & -bits).bit_length() - 1
        bits &= bits - 1
        self.low[word] = bits
        if not bits:
            self.middle[group] &= ~(1 << (word & 63))
            if not self.middle[group]:
                self.top &= ~(1 << group)
        return rank


class Merges:
    """The pair table of a vocabulary: which two ids join to which id (its rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values(), default=-1) + 1
        self.of_byte = np.array([ranks.get(bytes([b]), NO_RANK) for b in range(256)], dtype=np.int32)
        self.whole = ranks
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))[order], np.int32(NO_RANK))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.ranks[at], np.int32(NO_RANK))

    def encode(self, pieces: list[bytes], one_by_one: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens in a row, and the number of ids of each.

        Positions of the same rank merge together, left before right where they overlap. If
        a merge makes a pair of a lower rank than its own, that pair has to go first, so such
        pre-tokens are done again with one merge at a time (``one_by_one``).
        """
        if not any(pieces):
            return np.empty(0, dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        n = int(sizes.sum())
        token = self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ends = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        rank = np.full(n, NO_RANK, dtype=np.int32)
        inner = np.flatnonzero(after >= 0).astype(np.int32)
        rank[inner] = self.rank(token[inner], token[inner + 1])
        alive = np.ones(n, dtype=bool)
        buckets: dict[int, list[np.ndarray]] = {}
        bitmap = RankBitmap(self.size)
        early = np.zeros(len(pieces), dtype=bool)

        def push(positions: np.ndarray) -> None:
            ranks = rank[positions]
            positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
            if not len(positions):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for part, first in zip(np.split(positions, cuts) if len(cuts) else [positions], ranks[np.append(0, cuts)].tolist()):
                if first in buckets:
                    buckets[first].append(part)
                else:
                    buckets[first] = [part]
                    bitmap.add(first)

        push(inner)
        while (now := bitmap.pop()) >= 0:
            parts = buckets.pop(now)
            here = parts[0] if len(parts) == 1 else np.concatenate(parts)
            here = here[rank[here] == now]  # the rest is stale
            if len(parts) > 1 or one_by_one:
                here = _distinct(here)
            if not len(here):
                continue
            if one_by_one:
                first = np.append(True, piece[here[1:]] != piece[here[:-1]])
                if not first.all():
                    buckets[now] = [here[~first]]
                    bitmap.add(now)
                here = here[first]
            elif len(here) > 1:
                touching = np.append(False, after[here[:-1]] == here[1:])
                if touching.any():  # a run of overlapping pairs: every other one, from the left
                    place = np.arange(len(here))
                    start = np.maximum.accumulate(np.where(touching, 0, place))
                    here = here[(place - start) % 2 == 0]
            gone = after[here]
            beyond = after[gone]
            if not one_by_one and len(here) > 1:  # merged pairs side by side: the left one meets the right one unmerged
                close = np.flatnonzero(beyond[:-1] == here[1:])
                if len(close):
                    met = self.rank(np.full(len(close), now, dtype=np.int32), token[beyond[close]])
                    early[piece[here[close[(met >= 0) & (met < now)]]]] = True
            token[here] = now
            alive[gone] = False
            rank[gone] = NO_RANK
            after[here] = beyond
            linked = beyond >= 0
            before[beyond[linked]] = here[linked]
            left = before[here]
            changed = np.concatenate((here[linked], left[left >= 0]))
            rank[here] = NO_RANK
            if len(changed):
                changed = _distinct(changed)
                ranks = self.rank(token[changed], token[after[changed]])
                rank[changed] = ranks
                if not one_by_one:
                    early[piece[changed[(ranks >= 0) & (ranks < now)]]] = True
                push(changed)
        counts = np.bincount(piece[alive], minlength=len(pieces))
        ids = token[alive]
        if early.any():
            again = np.flatnonzero(early)
            redone, sizes = self.encode([pieces[at] for at in again.tolist()], one_by_one=True)
            owner = piece[alive]
            rows = np.concatenate((owner[~early[owner]], np.repeat(again, sizes)))
            ids = np.concatenate((ids[~early[owner]], redone))[np.argsort(rows, kind="stable")]
            counts[again] = sizes
        return ids, counts


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted and without repeats, by sorting (the arrays are short)."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class Pool:
    """Sequences of ids (or bytes) side by side, read by their number."""

    def __init__(self, kind: type = np.int32):
        self.starts, self.ids = np.zeros(1, dtype=np.int64), np.empty(0, dtype=kind)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def append(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(counts)))
        self.ids = np.concatenate((self.ids, ids.astype(self.ids.dtype)))

    def trim(self, kept: int) -> None:
        self.starts = self.starts[: kept + 1]
        self.ids = self.ids[: self.starts[-1]].copy()

    def read(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of ``numbers`` in a row, and the size of each."""
        low = self.starts[numbers]
        sizes = self.starts[numbers + 1] - low
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(low - ends + sizes, sizes)], sizes


class Pieces(dict):
    """Numbers pieces in the order they appear; ``new`` has those not learned yet."""

    def __init__(self, known: Iterable = ()):
        super().__init__(known)
        self.new: list = []

    def __missing__(self, piece) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class PieceEncoder:
    """Encodes whole texts by their pieces between single spaces, whose ids it remembers.

    A byte-level tokenizer always splits before a space that stands alone between two
    characters that are no white space, so a text cut there gives the same ids piece by
    piece. A text in which white space meets white space, or that begins or ends with it, is
    cut at the other spaces only. A string stands for itself after a space, a tuple for its
    only member as it is. Subclasses say how different pieces are encoded.
    """

    EVEN_CUT = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, most_pieces: int = MOST_PIECES):
        self.most_pieces = most_pieces
        self.pieces, self.pool = Pieces(), Pool()
        self.uneven = np.zeros(0, dtype=bool)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def trim(self) -> None:
        """Forget all but the pieces met first: among them are the most frequent ones."""
        if len(self.pieces) > self.most_pieces:
            kept = self.most_pieces // 2
            self.pieces = Pieces(islice(self.pieces.items(), kept))
            self.pool.trim(kept)
            self.uneven = self.uneven[:kept]

    def _numbers(self, pieces: list) -> np.ndarray:
        return np.fromiter(map(self.pieces.__getitem__, pieces), dtype=np.int32, count=len(pieces))

    def _learn(self) -> None:
        new, self.pieces.new = self.pieces.new, []
        if not new:
            return
        inner = [piece[0] if isinstance(piece, tuple) else piece for piece in new]
        bare = [not text or text[0].isspace() or text[-1].isspace() for text in inner]
        self.uneven = np.concatenate((self.uneven, bare))
        self.pool.append(
            *self.encode_pieces([text if isinstance(piece, tuple) else " " + text for piece, text in zip(new, inner)])
        )

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each."""
        self.trim()
        numbers = []
        for text in texts:
            pieces = text.split(" ") if text else []
            if pieces:
                pieces[0] = (pieces[0],)
            numbers.append(self._numbers(pieces))
        self._learn()
        for row, text in enumerate(texts):
            if self.uneven[numbers[row]].any():
                numbers[row] = self._numbers([(piece,) for piece in self.EVEN_CUT.split(text)])
        self._learn()
        ids, counts = [np.empty(0, dtype=np.int32)], np.zeros(len(texts), dtype=np.int64)
        for row, found in enumerate(numbers):
            ids.append(self.pool.read(found)[0])
            counts[row] = len(ids[-1])
        return np.concatenate(ids), counts


class Encoder(PieceEncoder):
    """Pieces cut by the pattern into pre-tokens, which are merged by the rank queue."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = MOST_PIECES):
        super().__init__(most_pieces)
        self.merges = Merges(ranks)
        self.pattern = regex.compile(pattern)

    def _encode_words(self, words: list[str]) -> Pool:
        """The ids of different pre-tokens."""
        pool = Pool()
        data = [word.encode() for word in words]
        known = np.fromiter(map(self.merges.whole.get, data, repeat(-1)), dtype=np.int32, count=len(data))
        part = np.cumsum([0, *map(len, data)])[:-1] // MERGE_BYTES
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(data)]
        for low, high in zip(cuts, cuts[1:]):
            # a pre-token that is a token as a whole needs no merge
            whole = known[low:high]
            todo = [word for word, rank in zip(data[low:high], whole.tolist()) if rank < 0]
            merged, sizes = self.merges.encode(todo)
            counts = np.ones(high - low, dtype=np.int64)
            counts[whole < 0] = sizes
            ids = np.empty(int(counts.sum()), dtype=np.int32)
            direct = np.repeat(whole >= 0, counts)
            ids[direct], ids[~direct] = whole[whole >= 0], merged
            pool.append(ids, counts)
        return pool

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = list(map(self.pattern.findall, pieces))
        words = Pieces()
        numbers = np.fromiter(map(words.__getitem__, chain.from_iterable(parts)), dtype=np.int32)
        ids, sizes = self._encode_words(words.new).read(numbers)
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
        totals = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], ends))]
        return ids, np.diff(totals)


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, text_column: str = "text", ids_column: str = "ids",
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``docs`` with the ids of its whole texts, without special tokens, as an array column.

    Nothing is shuffled. Null and empty texts give no ids; every other column, whatever its
    name, goes through (one named ``ids_column`` is replaced). The vocabulary is read on
    the driver and sent along (its size does not grow with the data).
    """
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kept = [name for name in docs.columns if name != ids_column]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        for batch in sliced(batches, "text to encode", batch_bytes):
            texts = [text or "" for text in batch.column(batch.num_columns - 1).to_pylist()]
            ids, counts = encoder.encode(texts)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*kept, ids_column])

    rows = docs.select(*[F.col(f"`{name}`") for name in kept], F.col(f"`{text_column}`").alias("text to encode"))
    fields = [docs.schema[name] for name in kept]
    schema = StructType([*fields, StructField(ids_column, ArrayType(IntegerType(), False), False)])
    return rows.mapInArrow(run, schema)


def _side_by_side(parts: list[bytes]) -> Pool:
    pool = Pool(np.uint8)
    pool.append(np.frombuffer(b"".join(parts), dtype=np.uint8), np.array([len(part) for part in parts], dtype=np.int64))
    return pool


def _tokens_by_id(ranks: dict[bytes, int]) -> list[bytes]:
    of_id = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        of_id[rank] = token
    return of_id


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, text_column: str = "text", with_ids: bool = False,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``docs`` with ``n_tokens, ids_sha256, decoded_sha256`` (and ``ids``) of its whole texts, in one pass.

    ``encode_documents``, the digest of the decimal ids joined by commas, and that of the
    bytes which ``decode_documents`` gives for the ids, without the ids leaving the task
    (unless ``with_ids``). Columns of these names are replaced, all others go through; null
    and empty texts have no ids. Nothing is shuffled.
    """
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    added = [StructField("n_tokens", LongType(), False), StructField("ids_sha256", StringType(), False),
             StructField("decoded_sha256", StringType(), False)]
    if with_ids:
        added.append(StructField("ids", ArrayType(IntegerType(), False), False))
    kept = [name for name in docs.columns if name not in {field.name for field in added}]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        tokens = _tokens_by_id(ranks.value)
        decoder, decimals = _side_by_side(tokens), _side_by_side([b"%d," % number for number in range(len(tokens))])
        for batch in sliced(batches, "text to encode", batch_bytes):
            ids, counts = encoder.encode([text or "" for text in batch.column(batch.num_columns - 1).to_pylist()])
            ends = np.cumsum(counts)
            shown, decoded = [], []
            for low, high in zip((ends - counts).tolist(), ends.tolist()):
                part = ids[low:high]
                shown.append(hashlib.sha256(decimals.read(part)[0][:-1]).hexdigest())
                decoded.append(hashlib.sha256(decoder.read(part)[0]).hexdigest())
            columns = [pa.array(counts), pa.array(shown, type=pa.string()), pa.array(decoded, type=pa.string())]
            if with_ids:
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids, type=pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*kept, *[field.name for field in added]])

    rows = docs.select(*[F.col(f"`{name}`") for name in kept], F.col(f"`{text_column}`").alias("text to encode"))
    return rows.mapInArrow(run, StructType([*[docs.schema[name] for name in kept], *added]))


def decode_documents(
    encoded: DataFrame, ranks_path: str, ids_column: str = "ids", bytes_column: str = "decoded"
) -> DataFrame:
    """``encoded`` with the bytes of its ids as a binary column; null ids give no bytes, unknown ids fail."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kept = [name for name in encoded.columns if name != bytes_column]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _side_by_side(_tokens_by_id(ranks.value))
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            texts = [
                pool.read(column[row].values.to_numpy(zero_copy_only=False))[0].tobytes() if column[row].is_valid else b""
                for row in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, type=pa.binary())], [*kept, bytes_column]
            )

    rows = encoded.select(*[F.col(f"`{name}`") for name in kept], F.col(f"`{ids_column}`").alias("ids to decode"))
    schema = StructType([*[encoded.schema[name] for name in kept], StructField(bytes_column, BinaryType(), False)])
    return rows.mapInArrow(run, schema)


def ids_digest(ids: str) -> Column:
    """SHA-256 of the decimal ids, joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
