"""Rank-queue merges against the tiktoken library, and the round trip."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sessionscope.llm.bpe import Encoder, Merges, RankBitmap, decode_documents, encode_documents, ids_digest, read_ranks, round_trip

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bitmap_gives_ranks_in_order():
    draw = random.Random(1)
    ranks = draw.sample(range(300_000), 500)
    bitmap = RankBitmap(300_000)
    for rank in ranks:
        bitmap.add(rank)
    assert [bitmap.pop() for _ in range(501)] == [*sorted(ranks), -1]


def test_same_ids_as_the_library(ranks, library):
    draw = random.Random(2)
    letters = "ab cde\n\t 'sé漢!.1 2 \x1d　\u0085"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    texts += ["", " ", "  a", "a  b", "I'm you'll  've", "<|endoftext|>", "aaaaaaaa" * 300, " lead", "trail "]
    texts += ["".join(draw.choice("abcdefghij") for _ in range(20_000))]
    ids, counts = Encoder(ranks, public_tokenizers.PATTERN, most_pieces=500).encode(texts)
    at = 0
    for text, count in zip(texts, counts.tolist()):
        assert ids[at : at + count].tolist() == library.encode_ordinary(text)
        at += count


def naive(ranks, piece):
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(ranks.get(a + b, 1 << 30), at) for at, (a, b) in enumerate(zip(parts, parts[1:]))]
        if not pairs or min(pairs)[0] == 1 << 30:
            return [ranks[part] for part in parts]
        at = min(pairs)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_merges_that_make_lower_ranks():
    """A rank file may rank a pair below the pairs it is made of; the lowest rank still goes first."""
    draw = random.Random(4)
    for _ in range(60):
        tokens = {bytes([b]) for b in b"abc"}
        tokens |= {bytes(draw.choice(b"abc") for _ in range(draw.randint(2, 5))) for _ in range(25)}
        order = sorted(tokens)
        draw.shuffle(order)
        ranks = {token: rank for rank, token in enumerate(order)}
        pieces = [bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 30))) for _ in range(20)]
        ids, counts = Merges(ranks).encode(pieces)
        assert ids.tolist() == [rank for piece in pieces for rank in naive(ranks, piece)]
        assert counts.sum() == len(ids)


def test_dirty_table(dirty, library):
    encoded = encode_documents(dirty, PATH, public_tokenizers.PATTERN, batch_bytes=4000)
    assert encoded.columns == [*dirty.columns, "ids"]
    rows = decode_documents(encoded, PATH).withColumn("digest", ids_digest("ids")).collect()
    assert len(rows) == dirty.count()
    for row in rows:
        ids = library.encode_ordinary(row.text or "")
        assert row.ids == ids
        assert bytes(row.decoded) == (row.text or "").encode()
        assert row.digest == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@pytest.mark.parametrize("with_ids", [False, True])
def test_round_trip_in_one_pass(dirty, library, with_ids):
    found = round_trip(dirty.withColumn("n_tokens", F.lit("old")), PATH, public_tokenizers.PATTERN, with_ids=with_ids, batch_bytes=4000)
    assert found.columns == [*dirty.columns, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    rows = found.collect()
    assert len(rows) == dirty.count()
    for row in rows:
        ids = library.encode_ordinary(row.text or "")
        assert row.n_tokens == len(ids) and (not with_ids or row.ids == ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_empty(nothing):
    assert round_trip(nothing, PATH, public_tokenizers.PATTERN, with_ids=True).collect() == []
    encoded = encode_documents(nothing, PATH, public_tokenizers.PATTERN)
    assert decode_documents(encoded, PATH).collect() == []
