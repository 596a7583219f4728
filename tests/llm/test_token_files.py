"""Elias-Fano boundaries, and files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sessionscope.llm import token_files
from sessionscope.llm.token_files import EliasFano, read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(40))
def test_offsets(seed):
    draw = random.Random(seed)
    steps = [draw.choice([1, 2, draw.randint(1, 5000)]) for _ in range(draw.randint(0, 900))]
    offsets = np.cumsum(steps, dtype=np.int64)
    first = EliasFano.encode(offsets)
    again = EliasFano(*first.fields(), len(offsets))
    assert again.all().tolist() == offsets.tolist()
    for number in draw.sample(range(len(offsets)), min(30, len(offsets))):
        assert again.select(number) == offsets[number]


@pytest.mark.parametrize("seed", range(10))
def test_many_offsets_by_select(seed):
    draw = np.random.default_rng(seed)
    size = int(draw.integers(1, 3000))
    steps = np.where(draw.random(size) < 0.01, draw.integers(1, 1 << 22, size=size), draw.integers(1, 40, size=size))
    offsets = np.cumsum(steps)
    fields = EliasFano.encode(offsets)
    for wanted in (np.arange(size), draw.integers(0, size, size=50), np.empty(0, dtype=np.int64)):
        assert fields.offsets(wanted).tolist() == offsets[wanted].tolist()


def test_space():
    offsets = np.cumsum(np.random.default_rng(1).integers(1, 2000, size=10_000))
    _, low, high, select = EliasFano.encode(offsets).fields()
    assert 8 * (len(low) + len(high) + len(select)) < len(offsets) * (3 + np.log2(offsets[-1] / len(offsets)))


@pytest.mark.parametrize("block_ids, part_bytes", [(1 << 20, 1 << 20), (7, 2000)])
def test_dirty_table(spark, dirty, block_ids, part_bytes):
    path = write_token_files(dirty, PATH, end_id=2, block_ids=block_ids, part_bytes=part_bytes)
    found = read_token_files(spark, path).orderBy("start").collect()
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    expected = sorted(
        ((row.doc_id is not None, row.doc_id or 0), np.array(
            [*library.encode(row.text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes())
        for row in dirty.collect()
    )
    assert [row.doc_id for row in found] == [number if there else None for (there, number), _ in expected]
    assert sorted(((r.doc_id is not None, r.doc_id or 0), bytes(r.ids)) for r in found) == expected
    at = 0
    for row in found:
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(row.ids) // 4, zlib.crc32(bytes(row.ids)))
        at += row.n_tokens


def test_reading_selects(spark, dirty, monkeypatch):
    """Neither the whole table nor chosen documents unpack the field of a file."""
    path = write_token_files(dirty, PATH, end_id=2, block_ids=300, part_bytes=5000)

    class Selecting(EliasFano):
        def all(self):
            raise AssertionError("unpacked")

    monkeypatch.setattr(token_files, "EliasFano", Selecting)
    rows = {tuple(row) for row in read_token_files(spark, path).collect()}
    assert len(rows) >= 44
    some = {tuple(row) for row in read_token_files(spark, path, doc_ids=[0, 3, 7, 30, 999]).collect()}
    assert some == {row for row in rows if row[0] in (0, 3, 7, 30)}
    assert read_token_files(spark, path, doc_ids=[]).collect() == []


def test_spelled_special_token(spark):
    """The library's own call decides, with its defaults."""
    token = "<|endoftext|>"
    texts = [
        token, f"a {token} b", f"a{token}b", f"{token}{token} c", f"a  {token}  b", f"\n{token}\t{token} ",
        f"one {token} two x{token}y {token} three", f" {token[:-1]} {token[1:]} ", "plain text after it",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = read_token_files(spark, write_token_files(docs, PATH, end_id=2)).collect()
    library = Tokenizer.from_file(PATH)
    expected, at = {}, 0
    for number, text in enumerate(texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        expected[number] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {row.doc_id: (row.start, row.n_tokens, row.ids_crc32) for row in found} == expected
    assert 50256 in np.frombuffer(next(bytes(row.ids) for row in found if row.doc_id == 1), dtype="<u4")


def test_pieces_are_looked_up_once_a_batch(monkeypatch):
    """Words that repeat, in one text or several, are told apart before any is looked up."""
    tokenizer = token_files.PieceTokenizer(open(PATH, encoding="utf-8").read(), most_pieces=50)
    asked, numbers = [], tokenizer._numbers
    monkeypatch.setattr(tokenizer, "_numbers", lambda pieces: asked.append(len(pieces)) or numbers(pieces))
    draw = random.Random(3)
    library = Tokenizer.from_file(PATH)
    words = ["one", "two,", "drei", "caf\u00e9", "\u4f60\u597d", "x" * 40, "a\u0301", "\U0001f600", *map(str, range(60))]
    for _ in range(4):
        texts = [" ".join(draw.choices(words, k=draw.randint(1, 400))) for _ in range(30)]
        texts += ["", None, " ", "  two  spaces ", "a\tb \nc", "\u00a0one two\u2003 three", "<|endoftext|> one <|endoftext|>"]
        ids, counts = tokenizer.encode(pa.array(texts))
        expected = [library.encode(text or "", add_special_tokens=False).ids for text in texts]
        assert counts.tolist() == list(map(len, expected))
        assert ids.tolist() == [number for some in expected for number in some]
    assert sum(asked) < 1_000  # 24,000 words


def test_empty(spark, nothing):
    assert read_token_files(spark, write_token_files(nothing, PATH, end_id=2)).collect() == []
