"""Removal of long byte strings that repeat anywhere in a corpus, by column-wise suffix sorting.

Every byte under a ``length``-byte string that also starts elsewhere goes. The strings that
have to be compared are found first, then sorted:

1. Each window of ``length`` bytes names the smallest hash among its 32-byte grams, its
   anchor; equal windows have the same anchor at the same place. The windows of one anchor
   are a record: the anchor's hash, the hash of all its bytes, where it starts.
2. Records whose anchor occurs once cannot repeat. Records that are equal are one string
   with a weight. What is left are different strings around the same anchor.
3. Of these, the windows are cut into ranges of offsets from the anchor. All windows of a
   range contain the same core of bytes; only strings with equal cores go on. A core is one
   symbol from here on (its weight is its length), the bytes around it are symbols of one.
4. Strings are dealt by core into collections that fit a task. A collection's
   Burrows-Wheeler transform and common prefixes are built column by column: each round
   puts one more symbol in front of every string and merges the new suffixes into the
   order. Suffixes with a common prefix of ``length`` bytes with a neighbour are repeats.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import drop_table, group_starts, read_table, stored, text_bytes, whole_groups, write_table

LENGTH = 400
GRAM = 32
WIDTH = 32
#: Strings around one core that one task sorts; cores with more are cut into narrower ranges.
MOST_STRINGS = 20_000
COLLECTION = 1_000
#: Windows of a text that are hashed at once, and the bits that hold a place among them.
CHUNK = 1 << 18
PLACE_BITS = np.uint64((1 << 20) - 1)
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Finds the anchor of every window; tables of powers are made once a task."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.span = length, gram, length - gram + 1
        size = CHUNK + length
        self.powers = _powers(BASE, size)
        self.inverse = _powers(pow(BASE, -1, 1 << 64), size)

    def records(self, data: bytes) -> Iterator[tuple[int, int, int, int, int]]:
        """``first start, starts, anchor's offset, anchor's hash, hash of the bytes`` of each record."""
        array = np.frombuffer(data, dtype=np.uint8)
        for chunk in range(0, len(data) - self.length + 1, CHUNK):
            part = array[chunk : chunk + CHUNK + self.length - 1]
            place, hashes = self._anchors(part)
            starts = np.flatnonzero(np.diff(place, prepend=-1))
            ends = np.append(starts[1:], len(place))
            anchors = place[starts]
            for low, high, anchor, key in zip(
                starts.tolist(), ends.tolist(), anchors.tolist(), hashes[anchors].view(np.int64).tolist()
            ):
                text = data[chunk + low : chunk + high - 1 + self.length]
                yield chunk + low, high - low, anchor - low, key, xxhash.xxh3_64_intdigest(text, anchor - low)

    def _anchors(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the anchor of each window, and the hash of each gram."""
        n, span = len(part), self.span
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        hashes = (sums[self.gram :] - sums[: -self.gram]) * self.inverse[: n - self.gram + 1]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
        grams = len(hashes)
        # the smallest hash, the last of equal ones; running minima from both sides of blocks of one span
        keys = np.full(-(-grams // span) * span, np.iinfo(np.uint64).max, dtype=np.uint64)
        keys[:grams] = (hashes & ~PLACE_BITS) | (PLACE_BITS - np.arange(grams, dtype=np.uint64))
        blocks = keys.reshape(-1, span)
        onward = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = grams - span + 1
        least = np.minimum(back[:windows], onward[span - 1 : span - 1 + windows])
        return (PLACE_BITS - (least & PLACE_BITS)).astype(np.int64), hashes


def find_records(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``t1, t2, low, starts, anchor, key, hash`` of every record of ``(t1, t2, text)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        names = ["t1", "t2", "low", "starts", "anchor", "key", "hash"]
        for batch in batches:
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found: list[tuple] = []
            owners: list[int] = []
            for row, data in enumerate(text_bytes(batch.column(2))):
                records = list(anchors.records(data)) if len(data) >= length else []
                found += records
                owners += [row] * len(records)
                if len(found) > 100_000:
                    yield _record_batch(t1[owners], t2[owners], found, names)
                    found, owners = [], []
            if found:
                yield _record_batch(t1[owners], t2[owners], found, names)

    return texts.select("t1", "t2", "text").mapInArrow(
        run, "t1 long, t2 long, low int, starts int, anchor int, key long, hash long"
    )


def _record_batch(t1: np.ndarray, t2: np.ndarray, found: list[tuple], names: list[str]) -> pa.RecordBatch:
    low, starts, anchor, key, digest = zip(*found)
    small = [pa.array(np.array(values, dtype=np.int32)) for values in (low, starts, anchor)]
    hashes = np.array(digest, dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(t1), pa.array(t2), *small, pa.array(np.array(key, dtype=np.int64)), pa.array(hashes)], names
    )


STRINGS = "c1 long, c2 long, base int, width int, left binary, right binary, key long, hash long, copies long"


def cut_strings(rows: DataFrame, length: int, width: int) -> DataFrame:
    """The strings of each record of ``(text, records)``, one for each range of offsets.

    Offset o is the window that starts o bytes before the anchor. A range has the offsets
    ``base`` to ``base + width - 1``; ``left`` and ``right`` are the bytes that the record's
    own windows of the range have besides the core.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in STRINGS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            out: list[tuple] = []
            records = batch.column(1)
            for row, data in enumerate(text_bytes(batch.column(0))):
                for record in records[row].as_py():
                    low, starts, anchor = record["low"], record["starts"], record["anchor"]
                    at = low + anchor
                    for base in range((anchor - starts + 1) // width * width, anchor + 1, width):
                        last = base + width - 1
                        first, final = max(base, anchor - starts + 1), min(last, anchor)
                        core = xxhash.xxh3_128_digest(data[at - base : at - last + length], base)
                        out.append((
                            int.from_bytes(core[:8], "big", signed=True), int.from_bytes(core[8:], "big", signed=True),
                            base, width, data[at - final : at - base], data[at - last + length : at - first + length],
                            record["key"], record["hash"], record["copies"],
                        ))
                if len(out) > 50_000:
                    yield _columns(out, names, types)
                    out = []
            if out:
                yield _columns(out, names, types)

    return rows.select("text", "records").mapInArrow(run, STRINGS)


def _columns(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, type=kind) for column, kind in zip(zip(*rows), types)], names)


def halved(strings: DataFrame) -> DataFrame:
    """Each string as up to two strings of half the width, whose cores are longer by the other half."""
    half = F.col("width") / 2
    half = half.cast("int")
    left, right = F.col("left"), F.col("right")
    n_left, n_right = F.octet_length("left"), F.octet_length("right")

    def core(part: int, added):
        return [
            F.xxhash64(F.lit(2 * part), "c1", "c2", added).alias("c1"),
            F.xxhash64(F.lit(2 * part + 1), "c2", "c1", added).alias("c2"),
        ]

    keep = ["key", "hash", "copies"]
    # offsets of the string are base + n_left down to base + width - 1 - n_right
    near = F.least(n_left, half - 1)
    nearer = strings.filter(n_right >= half).select(
        *core(0, F.substring(right, F.lit(1), half)), "base", half.alias("width"),
        F.substring(left, n_left - near + 1, near).alias("left"),
        F.substring(right, half + 1, n_right - half).alias("right"), *keep,
    )
    farther = strings.filter(n_left >= half).select(
        *core(1, F.substring(left, n_left - half + 1, half)), (F.col("base") + half).alias("base"), half.alias("width"),
        F.substring(left, F.lit(1), n_left - half).alias("left"),
        F.substring(right, F.lit(1), F.least(n_right, half - 1)).alias("right"), *keep,
    )
    return nearer.unionByName(farther)


def common_prefixes(strings: list[tuple[bytes, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column-wise Burrows-Wheeler transform of a collection with common prefixes.

    A string is (left bytes, core number, core length, right bytes). Returns, for each
    suffix of the collection in no particular order, its string, its start, and the longest
    prefix in bytes that it shares with another suffix.

    ``before`` is the transform: the symbol in front of each suffix, in suffix order. Where
    a suffix goes when a symbol is put in front of it follows from counting that symbol in
    the transform; the prefix it shares with its new neighbour is that symbol and the
    smallest value between the two places they come from.
    """
    m = len(strings)
    cores = 256 + np.array([core for _, core, _, _ in strings], dtype=np.int64)
    weight = np.ones(int(cores.max()) + 1, dtype=np.int64)
    weight[cores] = [size for _, _, size, _ in strings]
    n_left = np.array([len(left) for left, _, _, _ in strings])
    sizes = n_left + 1 + np.array([len(right) for _, _, _, right in strings])
    begin = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(
        b"".join(left + b"\0" + right for left, _, _, right in strings), dtype=np.uint8
    ).astype(np.int64)
    symbols[begin + n_left] = cores
    none = len(weight)  # no symbol in front (yet)
    kind = np.uint16 if none < 1 << 16 else np.int64
    symbols = symbols.astype(kind)

    before = np.full(m, none, dtype=kind)  # the empty suffixes, in the order of the strings
    common = np.zeros(m, dtype=np.int64)
    suffix_string, suffix_start = np.arange(m), sizes.copy()
    place = np.arange(m)  # where the newest suffix of each string stands
    active = np.arange(m)
    for column in range(1, int(sizes.max()) + 1):
        active = active[sizes[active] >= column]
        front = symbols[begin[active] + sizes[active] - column]
        here = place[active]
        before[here] = front
        known = np.flatnonzero(before != none)
        known = known[np.argsort(before[known], kind="stable")]  # where each suffix goes, in the new order
        turn = np.empty(len(before), dtype=np.int64)
        turn[known] = np.arange(len(known))
        target = turn[here]
        # prefixes shared with the neighbour above, for the new suffixes and those that follow them
        fresh = np.unique(np.concatenate((target, target[target + 1 < len(known)] + 1)))
        fresh = fresh[fresh > 0]
        upper, lower = known[fresh - 1], known[fresh]
        same = before[upper] == before[lower]
        shared = np.zeros(len(fresh), dtype=np.int64)
        if same.any():
            bounds = np.stack((upper[same] + 1, lower[same] + 1), axis=1).ravel()
            lowest = np.minimum.reduceat(np.append(common, 0), bounds)[::2]
            shared[same] = weight[before[lower[same]]] + lowest
        order = np.argsort(target)
        slots = m + target[order]
        old = np.ones(len(before) + len(slots), dtype=bool)
        old[slots] = False
        before = _insert(before, old, slots, none)
        common = _insert(common, old, slots, 0)
        common[m + fresh] = shared
        suffix_string = _insert(suffix_string, old, slots, active[order])
        suffix_start = _insert(suffix_start, old, slots, (sizes[active] - column)[order])
        place[active] = m + target
    longest = np.maximum(common, np.append(common[1:], 0))
    return suffix_string, suffix_start, longest


def _insert(values: np.ndarray, old: np.ndarray, slots: np.ndarray, new) -> np.ndarray:
    out = np.empty(len(old), dtype=values.dtype)
    out[old] = values
    out[slots] = new
    return out


RUNS = "key long, hash long, low int, high int"


def repeated_offsets(strings: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The offsets (``low`` to ``high``) of each record's windows that repeat, from strings sorted by core."""
    for table in whole_groups(strings, ["c1", "c2"]):
        starts = group_starts(table, ["c1", "c2"])
        sizes = np.diff(np.append(starts, table.num_rows))
        copies = table.column("copies").to_numpy()
        # a string alone with its core repeats only by its own copies
        alone = np.repeat(sizes == 1, sizes)
        out: list[tuple] = []
        rows = table.filter(pa.array(~alone | (copies > 1)))
        group = np.repeat(np.arange(len(starts)), sizes)[~alone | (copies > 1)].tolist()
        left, right, base, width, copies, key, digest = (
            rows.column(name).to_pylist() for name in ("left", "right", "base", "width", "copies", "key", "hash")
        )
        weights: dict[tuple, int] = {}
        for row in range(rows.num_rows):
            string = (group[row], left[row], right[row])
            weights[string] = weights.get(string, 0) + copies[row]
        different: dict[int, list[tuple]] = {}
        for string in weights:
            different.setdefault(string[0], []).append(string)
        size_of = dict(zip(group, width))
        found: dict[tuple, list[tuple[int, int]]] = {}
        collection: list[tuple] = []
        for number, members in enumerate(different.values()):
            if len(members) > 1:
                collection += members
            if len(collection) >= COLLECTION or (collection and number == len(different) - 1):
                _sort_collection(collection, size_of, length, found)
                collection = []
        for row in range(rows.num_rows):
            string = (group[row], left[row], right[row])
            final = base[row] + len(left[row])
            if weights[string] > 1:
                out.append((key[row], digest[row], base[row] + width[row] - 1 - len(right[row]), final))
            else:
                out += [(key[row], digest[row], final - last, final - first) for first, last in found.get(string, ())]
        if out:
            names = [part.split()[0] for part in RUNS.split(", ")]
            yield _columns(out, names, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])


def _sort_collection(collection: list[tuple], size_of: dict[int, int], length: int, found: dict) -> None:
    """Add the runs of starts of each string of the collection that repeat."""
    numbers = {group: number for number, group in enumerate(dict.fromkeys(group for group, _, _ in collection))}
    string, start, longest = common_prefixes(
        [(left, numbers[group], length - size_of[group] + 1, right) for group, left, right in collection]
    )
    hit = longest >= length
    string, start = string[hit], start[hit]
    if not len(string):
        return
    order = np.lexsort((start, string))
    string, start = string[order], start[order]
    begins = np.flatnonzero((np.diff(string, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    ends = np.append(begins[1:], len(string)) - 1
    for owner, first, last in zip(string[begins].tolist(), start[begins].tolist(), start[ends].tolist()):
        found.setdefault(collection[owner], []).append((first, last))


def repeated_windows(strings: DataFrame) -> DataFrame:
    """Runs (as ``RUNS``) of the strings of width 1 that repeat.

    Their core is the whole window, so nothing is left to sort: copies are summed by core,
    before the shuffle where they can be, and no task holds the strings of one core.
    """
    repeated = strings.groupBy("c1", "c2").agg(F.sum("copies").alias("n")).filter("n > 1").select("c1", "c2")
    return strings.join(repeated, ["c1", "c2"], "left_semi").select(
        "key", "hash", F.col("base").alias("low"), F.col("base").alias("high")
    )


def repeated_starts(
    texts: DataFrame, length: int = LENGTH, gram: int = GRAM, width: int = WIDTH, most_strings: int = MOST_STRINGS
) -> DataFrame:
    """``t1, t2, spans``: the first and last starts of runs of repeated windows in each text."""
    spark = texts.sparkSession
    records = stored(find_records(texts, length, gram), "records")
    groups = records.groupBy("key", "hash").agg(
        F.count("*").alias("copies"), F.min(F.struct("t1", "t2", "low", "starts", "anchor")).alias("one")
    )
    keys = groups.groupBy("key").agg(F.count("*").alias("different"), F.sum("copies").alias("all")).filter("all > 1")
    shared = stored(
        groups.join(keys, "key").select("key", "hash", "copies", "one.*", (F.col("different") > 1).alias("mixed")), "shared"
    )
    wanted = (
        shared.filter("mixed")
        .groupBy("t1", "t2")
        .agg(F.collect_list(F.struct("low", "starts", "anchor", "key", "hash", "copies")).alias("records"))
    )
    with_text = texts.select("t1", "t2", "text").dropDuplicates(["t1", "t2"]).join(wanted, ["t1", "t2"])
    strings = cut_strings(with_text, length, width)
    path = write_table(strings, "strings")
    while True:  # at most once for each halving of the width, and only where a core has very many strings
        now = read_table(strings, path)
        crowded = (
            now.filter("width > 1").groupBy("c1", "c2").agg(F.count("*").alias("n")).filter(F.col("n") > most_strings)
        ).select("c1", "c2")
        if crowded.isEmpty():
            break
        narrow = halved(now.filter("width > 1").join(crowded, ["c1", "c2"], "left_semi"))
        rest = now.join(crowded, ["c1", "c2"], "left_anti")
        previous, path = path, write_table(rest.unionByName(narrow), "strings")
        drop_table(spark, previous)
    now = read_table(strings, path)
    sorted_strings = now.filter("width > 1").repartition("c1", "c2").sortWithinPartitions("c1", "c2")
    runs = sorted_strings.mapInArrow(lambda batches: repeated_offsets(batches, length), RUNS)
    runs = runs.unionByName(repeated_windows(now.filter("width = 1")))
    alone = shared.filter("not mixed").select("key", "hash", (F.expr("anchor - starts + 1")).alias("low"), F.col("anchor").alias("high"))
    of_record = runs.unionByName(alone).groupBy("key", "hash").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    of_record = stored(of_record, "runs")  # the join can then split the rows of a record that very many texts hold
    return (
        records.join(of_record, ["key", "hash"])
        .select("t1", "t2", (F.col("low") + F.col("anchor")).alias("at"), F.explode("runs").alias("run"))
        .groupBy("t1", "t2")
        .agg(F.collect_set(F.struct((F.col("at") - F.col("run.high")).alias("first"), (F.col("at") - F.col("run.low")).alias("last"))).alias("spans"))
    )


def remove_repeats(
    docs: DataFrame, text_column: str = "text", length: int = LENGTH, gram: int = GRAM, width: int = WIDTH,
    most_strings: int = MOST_STRINGS, as_text: bool = False,
) -> DataFrame:
    """``docs`` with what is left of each text once repeats of ``length`` bytes are cut out.

    Added are ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept``,
    the remaining bytes (``as_text``: as a string, without what is left of a character that
    a cut has split); columns of these names are replaced. Matches are between byte
    strings of the input, in the same text or another one, and never cross texts. A row that
    repeats another's text repeats all of it. Null texts are empty; texts shorter than
    ``length`` lose nothing; an empty table gives no rows.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept")
    names = [name for name in docs.columns if name not in added]
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in names]).alias("row"), text.alias("text"),
        F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"),
    )
    # stored, so that the join below can split the rows of a text that very many rows repeat
    spans = stored(repeated_starts(rows, length, gram, width, most_strings), "spans")
    row_type = rows.schema["row"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            column = batch.column(2)
            for number, data in enumerate(text_bytes(batch.column(1))):
                out.append(cut_out(data, column[number].as_py() or [], length))
            counts = [pa.array([values[at] for values in out], type=pa.int64()) for at in range(3)]
            left = [values[3] for values in out]
            kept = pa.array([b.decode("utf-8", "ignore") for b in left], type=pa.string()) if as_text else pa.array(left, type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, kept], ["row", *added])

    schema = StructType([
        StructField("row", row_type), *[StructField(name, LongType()) for name in added[:3]], StructField("kept", StringType() if as_text else BinaryType()),
    ])
    joined = rows.join(spans, ["t1", "t2"], "left").select("row", "text", "spans")
    return joined.mapInArrow(run, schema).select(*[f"row.`{name}`" for name in names], *added)


def cut_out(data: bytes, spans: list[dict], length: int) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, removed runs and what is left, for runs of window starts."""
    kept: list[bytes] = []
    removed = runs = upto = 0
    for span in sorted((span["first"], span["last"] + length) for span in spans):
        low, high = max(span[0], upto), span[1]
        if high <= low:
            continue
        if span[0] > upto or not runs:
            kept.append(data[upto : span[0]])
            runs += 1
        removed += high - low
        upto = high
    kept.append(data[upto:])
    return len(data), removed, runs, b"".join(kept)
