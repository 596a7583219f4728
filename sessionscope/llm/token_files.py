"""Token ids of documents in binary files with Elias-Fano encoded boundaries.

A file is a Parquet row (so commits, retries and any Hadoop store work as usual) with these
binary fields:

=========  ==========================================================================
``ids``    the ids of its documents in a row, little-endian, ``width`` bytes each
``low``    the low ``low_bits`` bits of each document's end, packed, first bit lowest
``high``   the rest of the ends in unary: bit (end >> low_bits) + number is set
``select`` the place in ``high`` of every 256th set bit, 32 bits each
=========  ==========================================================================

``doc_ids`` names the documents; ``part`` and ``block`` put the files in order.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_folder
from .bpe import BATCH_BYTES, PieceEncoder, Pool
from .common import sliced

BLOCK_IDS = 1 << 20
PART_BYTES = 32 << 20
SELECT_STEP = 256
#: New pieces that the library encodes as one text.
JOINED_PIECES = 500
#: Pieces of text whose ids a task remembers, and pieces whose ids are read at once.
MOST_PIECES = 400_000
READ_PIECES = 1 << 18

FILES = (
    "part int, block int, width int, n_docs long, n_ids long, low_bits int, doc_ids array<long>, "
    "ids binary, low binary, high binary, select binary"
)


class EliasFano:
    """Ascending offsets in about 2 + log2(largest / number) bits each, with select."""

    def __init__(self, low_bits: int, low: bytes, high: bytes, select: bytes, n: int):
        self.low_bits, self.n = low_bits, n
        self.low = np.frombuffer(low, dtype=np.uint8)
        self.high = np.frombuffer(high, dtype=np.uint8)
        self.select_places = np.frombuffer(select, dtype="<u4")

    @classmethod
    def encode(cls, offsets: np.ndarray) -> EliasFano:
        n = len(offsets)
        largest = int(offsets[-1]) if n else 0
        low_bits = max(0, (largest // n).bit_length() - 1) if n else 0
        values = offsets.astype(np.int64)
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        places = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        high[places] = 1
        return cls(
            low_bits,
            np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(),
            np.packbits(high, bitorder="little").tobytes(),
            places[::SELECT_STEP].astype("<u4").tobytes(),
            n,
        )

    def fields(self) -> tuple[int, bytes, bytes, bytes]:
        return self.low_bits, self.low.tobytes(), self.high.tobytes(), self.select_places.tobytes()

    def _low(self, number: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(number), dtype=np.int64)
        at = number[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7)) & 1
        return (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, number: int) -> int:
        """The offset of this number: start at the sampled set bit before it, count set bits from there."""
        sample, left = divmod(number, SELECT_STEP)
        place = int(self.select_places[sample])
        byte = place >> 3
        word = int(self.high[byte]) >> (place & 7) << (place & 7)
        while (count := word.bit_count()) <= left:
            left -= count
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = (byte << 3) + (word & -word).bit_length() - 1
        return (place - number << self.low_bits) + int(self._low(np.array([number]))[0])

    def offsets(self, number: np.ndarray) -> np.ndarray:
        """The offsets of these numbers, each by its own select; all of them step on together."""
        number = number.astype(np.int64)
        left = number % SELECT_STEP
        place = self.select_places[number // SELECT_STEP].astype(np.int64)
        byte = place >> 3
        word = self.high[byte].astype(np.int64) >> (place & 7) << (place & 7)
        rows = np.arange(len(number))
        while len(rows):
            count = np.bitwise_count(word[rows])
            beyond = count <= left[rows]
            rows = rows[beyond]
            left[rows] -= count[beyond]
            byte[rows] += 1
            word[rows] = self.high[byte[rows]]
        while (more := left > 0).any():
            word[more] &= word[more] - 1
            left[more] -= 1
        place = (byte << 3) + np.bitwise_count((word & -word) - 1)
        return (place - number << self.low_bits) + self._low(number)

    def all(self) -> np.ndarray:
        """Every offset at once."""
        number = np.arange(self.n)
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return (places - number << self.low_bits) + self._low(number)


class PieceTokenizer(PieceEncoder):
    """Encodes with the tokenizers library, once for each different piece of text.

    No special tokens are added. One that a text spells out is that token, as in the library's
    own call with its defaults; the definition's has no spaces and does not strip any, so
    pieces are cut as without it.
    """

    def __init__(self, definition: str, most_pieces: int = MOST_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        super().__init__(most_pieces)
        self.tokenizer = Tokenizer.from_str(definition)
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.sizes[number] = len(token)  # a byte-level token has one character for each byte

    def encode(self, texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each; null is empty.

        Arrow cuts the texts at spaces and tells the different pieces, so that only these are
        looked up one by one.
        """
        self.trim()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, type=pa.string()), "")
        counts = np.zeros(len(texts), dtype=np.int64)
        if not len(texts):
            return np.empty(0, dtype=np.int32), counts
        lists = pc.split_pattern(texts, " ")
        starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)))
        words = lists.flatten()
        firsts = self._numbers([(word,) for word in words.take(pa.array(starts[:-1])).to_pylist()])
        coded = words.dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        numbers[starts[:-1]] = firsts
        self._learn()
        uneven = np.flatnonzero(np.logical_or.reduceat(self.uneven[numbers], starts[:-1])).tolist()
        again = {row: self._numbers([(piece,) for piece in self.EVEN_CUT.split(texts[row].as_py())]) for row in uneven}
        self._learn()
        ids, row = [np.empty(0, dtype=np.int32)], 0
        while row < len(texts):  # some texts at once
            last = max(row + 1, int(np.searchsorted(starts, starts[row] + READ_PIECES, side="right")) - 1)
            parts = [again.get(at, numbers[starts[at] : starts[at + 1]]) for at in range(row, last)]
            found, sizes = self.pool.read(np.concatenate(parts))
            ids.append(found)
            ends = np.cumsum([len(part) for part in parts])
            counts[row:last] = np.diff(np.concatenate(([0], np.cumsum(sizes)))[ends], prepend=0)
            row = last
        return np.concatenate(ids), counts

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(encoding.ids, dtype=np.int32) for encoding in found]

    def _learn(self) -> None:
        """Words after a space are encoded many at a time and told apart by their bytes."""
        new, self.pieces.new = self.pieces.new, []
        if not new:
            return
        after = np.array([type(piece) is str for piece in new])  # a space
        inner = [piece if type(piece) is str else piece[0] for piece in new]
        bare, lengths = _bare(inner)
        self.uneven = np.concatenate((self.uneven, bare))
        rows, others = np.flatnonzero(after & ~bare), np.flatnonzero(~after | bare)
        words = [" " + inner[row] for row in rows.tolist()]
        joined = self._ids(["".join(words[low : low + JOINED_PIECES]) for low in range(0, len(words), JOINED_PIECES)])
        flat = np.concatenate([np.empty(0, dtype=np.int32), *joined])
        ends = np.cumsum(lengths[rows] + 1)
        cuts = np.searchsorted(np.cumsum(self.sizes[flat]), ends) + 1  # a word ends with the id that reaches its last byte
        alone = self._ids([" " + inner[row] if after[row] else inner[row] for row in others.tolist()])
        sizes = np.concatenate((np.diff(cuts, prepend=0), np.array([len(found) for found in alone], dtype=np.int64)))
        order = np.concatenate((rows, others))
        pool = Pool()  # from the order encoded back to the order asked for
        pool.append(np.concatenate([flat, *alone]), sizes)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        self.pool.append(*pool.read(back))


def _bare(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which texts are empty or have white space at an end, and the bytes of each."""
    array = pa.array(texts, type=pa.large_string())
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[: len(texts) + 1]
    lengths = np.diff(offsets)
    data = np.append(np.frombuffer(data or b"", dtype=np.uint8), 0)
    plain = lengths > 0
    for end in (data[offsets[:-1]], data[np.maximum(offsets[1:] - 1, 0)]):
        plain &= (end > 32) & (end < 127)  # visible ASCII; the others are looked at one by one
    bare = np.zeros(len(texts), dtype=bool)
    for row in np.flatnonzero(~plain).tolist():
        text = texts[row]
        bare[row] = not text or text[0].isspace() or text[-1].isspace()
    return bare, lengths


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text",
    path: str | None = None, part_bytes: int = PART_BYTES, block_ids: int = BLOCK_IDS,
) -> str:
    """Encode whole texts and write files in ascending id order; returns the folder.

    ``end_id`` closes each document. Rows are dealt by ranges of (id, hash of the text), so a
    part has about ``part_bytes`` of text; null ids come first, rows that repeat an id are
    ordered by the hash, and rows that repeat both are interchangeable. Null and empty texts
    have the end id alone. A file has about ``block_ids`` ids, one document at least. An
    empty table writes no file.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["id", F.xxhash64("text")]
    parts = rows.repartitionByRange(int(total // part_bytes) + 1, *order).sortWithinPartitions(*order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceTokenizer(definition.value)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        part, block = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0
        for batch in sliced(batches, "text", BATCH_BYTES):
            ids, counts = encoder.encode(batch.column(1))
            encoded = np.split(ids, np.cumsum(counts)[:-1])
            for name, ids in zip(batch.column(0).to_pylist(), encoded):
                held.append(np.append(ids, end_id).astype(f"<u{width}"))
                names.append(name)
                size += len(held[-1])
                if size >= block_ids:
                    yield _file(part, block, width, names, held)
                    held, names, size, block = [], [], 0, block + 1
        if held:
            yield _file(part, block, width, names, held)

    folder = path or new_folder(spark, "tokens")
    parts.mapInArrow(run, FILES).write.option("compression", "zstd").parquet(folder)
    return folder


def _file(part: int, block: int, width: int, names: list, held: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([len(ids) for ids in held])
    low_bits, low, high, select = EliasFano.encode(ends).fields()
    row = (part, block, width, len(names), int(ends[-1]), low_bits, names, b"".join(i.tobytes() for i in held), low, high, select)
    kinds = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.int32(), pa.list_(pa.int64())] + [pa.binary()] * 4
    fields = [field.split()[0] for field in FILES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([value], type=kind) for value, kind in zip(row, kinds)], fields)


def read_token_files(
    spark: SparkSession, path: str, with_ids: bool = True, doc_ids: Iterable[int] | None = None
) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, and its ``ids``.

    ``start`` is the number of ids of all documents before it, ``ids`` (left out without
    ``with_ids``) the ids as little-endian unsigned 32-bit integers, ``ids_crc32`` the
    checksum of these bytes. With ``doc_ids`` only documents of these ids are read. Boundaries
    come from the Elias-Fano fields by select, so nothing else of a file is unpacked. The order
    of files is found from one narrow row per file.
    """
    files = spark.read.schema(FILES).parquet(path)
    chosen = None if doc_ids is None else frozenset(doc_ids)
    if chosen is None:
        read = files
    else:
        read = files.filter(F.exists("doc_ids", lambda name: name.isin(*chosen)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                boundaries = EliasFano(file["low_bits"], file["low"], file["high"], file["select"], file["n_docs"])
                names = file["doc_ids"]
                number = np.array([at for at, name in enumerate(names) if chosen is None or name in chosen], dtype=np.int64)
                ends = boundaries.offsets(number)
                starts = np.where(number > 0, boundaries.offsets(np.maximum(number - 1, 0)), 0)
                ids = np.frombuffer(file["ids"], dtype=f"<u{file['width']}")
                n = len(number)
                texts = [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, file["part"], dtype=np.int32)), pa.array(np.full(n, file["block"], dtype=np.int32)),
                        pa.array([names[at] for at in number.tolist()], type=pa.int64()), pa.array(starts),
                        pa.array(ends - starts),
                        pa.array([crc32(text) for text in texts], type=pa.int64()),
                        *([pa.array(texts, type=pa.binary())] if with_ids else []),
                    ],
                    fields,
                )

    schema = "part int, block int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    fields = [field.split()[0] for field in schema.split(", ")]
    documents = read.mapInArrow(run, schema)
    before = Window.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("part", "block", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return documents.join(bases, ["part", "block"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), *fields[4:]
    )
