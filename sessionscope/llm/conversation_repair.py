"""Repair of conversations: the cheapest edits that make the turns alternate.

The turns of a conversation are aligned by Wagner-Fischer to every feasible length of the
alternating strings of the grammar ``(s?(ua)+)?``, inside an Ukkonen band that the cheapest
alignment found so far sets; equally cheap alignments are compared by their backtraced audit.
A long conversation is aligned chunk by chunk, once for each state of the grammar that a
chunk can begin and end in, and the chunks are put together; this gives the same audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import stored

#: Costs of the edits; an undeleted truncated turn costs ``TRUNCATED`` more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Where the grammar stands: nothing yet, after the system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Inserts that end a conversation from each of these states.
ENDING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: Turns that are aligned at once.
CHUNK = 32
#: Turns and characters of a piece, the part of a conversation that one row holds.
PIECE_TURNS, PIECE_CHARACTERS = 1_024, 65_536
#: What separates words, and what ends a sentence.
SPACES, STOPS = " \t\n\x0b\x0c\r", ".!?"

Ends = dict[tuple[int, int], tuple[int, str]]

SUMMARY = "array<struct<entry int, exit int, cost long, audit string>>"
TURNS = "array<struct<role string, text string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")
PIECE = (
    f"whole boolean, part int, piece int, {', '.join(f'{name} long' for name in COUNTS)}, "
    "first_turn long, last_turn long, turns_seen long, first_initial string, last_initial string, "
    f"cost long, audit string, repaired {TURNS}, summary {SUMMARY}, "
    "held array<struct<role string, text string, copies long>>"
)


def damage(rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
           text_column: str = "text") -> DataFrame:
    """``conv, turn, role, text, copies``: rows damaged by CRC-32 of ``id:turn`` modulo 20.

    0 drops the row (no copies), 1 empties the text, 2 removes ``.!?``, 3 gives two copies,
    4 sets the role to user. A null in the key, the role or the text is one space.
    """
    blank = F.lit(" ")
    key = F.concat(*[F.coalesce(F.col(f"`{name}`").cast("string"), blank) if name else F.lit(":")
                     for name in (id_column, "", turn_column)])
    draw = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col(f"`{text_column}`"), blank)
    return rows.select(
        F.col(f"`{id_column}`").alias("conv"),
        F.when(draw != 0, F.col(f"`{turn_column}`").cast("long")).alias("turn"),
        F.when(draw == 4, "user").when(draw != 0, F.coalesce(F.col(f"`{role_column}`"), blank)).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate(text, STOPS, "")).when(draw != 0, text).alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("copies"),
    )


@lru_cache(maxsize=200_000)
def align(pattern: str, entry: int) -> dict[int, tuple[int, str]]:
    """The least ``(cost, audit)`` for each state that the turns can lead to from ``entry``.

    A turn of ``pattern`` is ``x`` where it has to be deleted, else its role's initial
    (``o`` for any other role), a capital where it is truncated. An insert stands before a
    turn, so that audits of the same turns are never prefixes of one another.
    """
    rows = len(pattern)
    best = {entry: (DELETE * rows, "D" * rows)}
    openings = ["", "s"] if entry == START and "s" in pattern.lower() else [""]
    ends = {entry, USER, ASSISTANT} | ({SYSTEM} if len(openings) > 1 else set())
    worst = DELETE * rows + 2 * INSERT  # all turns deleted, and what leads to the end inserted or kept
    lengths = range(1, rows + worst // INSERT + 1)
    for length in sorted(lengths, key=lambda length: (_skew(length - rows), length)):
        bounds = {end: best[end][0] if end in best else worst for end in ends}
        if _skew(length - rows) > max(bounds.values()):
            break
        for opening in openings:
            target = (opening + ("au" if entry == USER else "ua") * length)[:length]
            end = AFTER[target[-1]]
            if _skew(length - rows) <= bounds[end]:
                found = _wagner_fischer(pattern, target, bounds[end])
                if found and (end not in best or found < best[end]):
                    best[end] = found
                    bounds[end] = found[0]
    return best


def _skew(diagonal: int) -> int:
    """The least cost of as many columns more than rows, or rows more than columns."""
    return INSERT * diagonal if diagonal > 0 else -DELETE * diagonal


def _wagner_fischer(pattern: str, target: str, bound: int) -> tuple[int, str] | None:
    """The least ``(cost, audit)`` of an alignment that costs ``bound`` at most.

    ``costs[i][j]`` is the cost from turn i and target j to the end. A diagonal is in the band
    if the lengths before and after it leave a cost within the bound.
    """
    rows, columns = len(pattern), len(target)
    band = [d for d in range(-rows, columns + 1) if _skew(d) + _skew(columns - rows - d) <= bound]
    low, high = band[0], band[-1]
    endless = bound + 1
    costs = [[endless] * (columns + 2) for _ in range(rows + 1)]
    costs[rows][columns] = 0
    for i in range(rows - 1, -1, -1):
        turn, here, below = pattern[i], costs[i], costs[i + 1]
        kept, more = turn.lower(), TRUNCATED if turn.isupper() else 0
        for j in range(min(columns, i + high), max(0, i + low) - 1, -1):
            cost = DELETE + below[j]
            if j < columns:
                wanted = target[j]
                if wanted != "s":
                    cost = min(cost, INSERT + here[j + 1])
                    if turn != "x":
                        cost = min(cost, below[j + 1] + more + (0 if kept == wanted else REROLE))
                elif kept == "s":
                    cost = min(cost, below[j + 1] + more)
            here[j] = cost
    if costs[0][0] > bound:
        return None
    audit, i, j = [], 0, 0
    while i < rows:
        turn, here = pattern[i], costs[i][j]
        more = TRUNCATED if turn.isupper() else 0
        if here == DELETE + costs[i + 1][j]:
            audit.append("D")
            i += 1
        elif target[j] != "s" and here == INSERT + costs[i][j + 1]:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turn.lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return costs[0][0], "".join(audit)


def summarize(pattern: str, entries: Iterable[int] = range(4)) -> Ends:
    """``{(entry, exit): (cost, audit)}`` of a run of turns of any length."""
    chunks = [pattern[at : at + CHUNK] for at in range(0, len(pattern), CHUNK)]
    parts = []
    for at, chunk in enumerate(chunks):
        states = entries if at == 0 else range(4)
        parts.append({(entry, leave): found for entry in states for leave, found in align(chunk, entry).items()})
    return joined(parts) if parts else {(entry, entry): (0, "") for entry in entries}


def joined(parts: list[Ends]) -> Ends:
    """Summaries of runs that follow one another as one, put together pair by pair."""
    while len(parts) > 1:
        pairs = [_pair(a, b) for a, b in zip(parts[::2], parts[1::2])]
        parts = pairs + parts[len(pairs) * 2 :]
    return parts[0]


def _pair(left: Ends, right: Ends) -> Ends:
    made: Ends = {}
    for (entry, middle), (cost, audit) in left.items():
        for (state, leave), (further, rest) in right.items():
            if state == middle:
                total = cost + further
                key = (entry, leave)
                if key not in made or total < made[key][0] or total == made[key][0] and audit + rest < made[key][1]:
                    made[key] = (total, audit + rest)
    return made


def ended(ends: Ends) -> tuple[int, str]:
    """The least ``(cost, audit)`` of a whole conversation."""
    return min(
        (cost + INSERT * len(ENDING[leave]), audit + ENDING[leave])
        for (entry, leave), (cost, audit) in ends.items() if entry == START
    )


def cut_audit(audit: str, turns: list[int]) -> list[str]:
    """The audit's part for each piece of ``turns`` turns; inserts after the last go with the last piece."""
    cuts, at = [], 0
    for count in turns:
        begin = at
        while count:
            count -= audit[at] != "I"
            at += 1
        cuts.append(audit[begin:at])
    if cuts:
        cuts[-1] += audit[at:]
    return cuts


def edited(turns: Iterable[tuple[str, str]], audit: str, turn_next: str = "user") -> tuple[list[dict], str]:
    """The turns after the edits, and the role that a next edit would give."""
    source, made = iter(turns), []
    other = {"user": "assistant", "assistant": "user"}
    for edit in audit:
        role, text = (turn_next, "") if edit == "I" else next(source)
        if edit == "D":
            continue
        made.append({"role": turn_next if edit == "R" else role, "text": text})
        if edit != "K" or role[:1] != "s":
            turn_next = other[turn_next]
    return made, turn_next


class _Piece:
    """What a task holds of one conversation: at most a piece of its turns."""

    def __init__(self, conv, part: int):
        self.conv, self.part = conv, part
        self.rows: list[tuple[str, str, int]] = []
        self.pattern: list[str] = []
        self.count = dict.fromkeys(COUNTS, 0)
        self.turns: list[int] = []
        self.initials: list[str] = []
        self.characters = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, again: bool) -> None:
        shown = text.rstrip(SPACES)
        fault = "blank" if not shown else "duplicate" if again else "truncated" if shown[-1] not in STOPS else ""
        initial = role[:1]
        kind = "x" if fault in ("blank", "duplicate") else initial if initial in ("s", "u", "a") else "o"
        self.pattern.append((kind.upper() if fault == "truncated" else kind) + "x" * (copies - 1))
        if fault:
            self.count[fault] += 1
        self.count["duplicate" if shown else "blank"] += copies - 1
        if self.initials:
            self.count["illegal"] += self.initials[-1] + initial not in ("su", "ua", "au")
        self.count["illegal"] += copies - 1
        self.initials.append(initial)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        self.rows.append((role, text, copies))
        self.characters += len(text)

    def full(self) -> bool:
        return len(self.rows) >= PIECE_TURNS or self.characters >= PIECE_CHARACTERS

    def row(self, number: int, whole: bool) -> dict:
        pattern = "".join(self.pattern)
        row = {
            "conv": self.conv, "whole": whole, "part": self.part, "piece": number, **self.count,
            "first_turn": self.turns[0] if self.turns else None, "last_turn": self.turns[-1] if self.turns else None,
            "turns_seen": len(self.turns), "first_initial": self.initials[0] if self.initials else None,
            "last_initial": self.initials[-1] if self.initials else None,
            "cost": None, "audit": None, "repaired": None, "summary": None, "held": None,
        }
        if whole:
            row["cost"], row["audit"] = ended(summarize(pattern, [START]))
            turns = ((role, text) for role, text, copies in self.rows for _ in range(copies))
            row["repaired"] = edited(turns, row["audit"])[0]
        else:
            row["summary"] = [
                {"entry": entry, "exit": leave, "cost": cost, "audit": audit}
                for (entry, leave), (cost, audit) in summarize(pattern).items()
            ]
            row["held"] = [{"role": role, "text": text, "copies": copies} for role, text, copies in self.rows]
        return row


def _pieces(schema: pa.Schema):
    """Rows sorted by conversation to pieces; the first and the last of a task may be parts only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        at: _Piece | None = None
        number, only, inner, made, characters = 0, True, False, [], 0
        for batch in batches:
            for conv, turn, role, text, copies, again in zip(*[column.to_pylist() for column in batch.columns]):
                new = at is None or conv != at.conv
                if at is not None and (new or at.full()):
                    characters += at.characters
                    made.append(at.row(number, whole=new and only and inner))
                    number, only, inner = number + 1, new, inner or new
                if new or at.full():
                    at = _Piece(conv, part)
                if copies:
                    at.add(turn, role, text, copies, again)
                if len(made) >= 2_000 or characters > 16 * PIECE_CHARACTERS:
                    yield pa.RecordBatch.from_pylist(made, schema=schema)
                    made, characters = [], 0
        if at is not None:
            made.append(at.row(number, whole=False))
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return run


def _composed(schema: pa.Schema):
    """Pieces sorted by conversation to one row each, with the audit's part for every piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["conv"] != row["conv"]:
                    yield pa.RecordBatch.from_pylist([_conversation(held)], schema=schema)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([_conversation(held)], schema=schema)

    return run


def _conversation(pieces: list[dict]) -> dict:
    """One row of a conversation from the summaries of all its pieces."""
    full = [piece for piece in pieces if piece["first_initial"] is not None]
    count = {name: sum(piece[name] for piece in pieces) for name in COUNTS}
    count["illegal"] += sum(
        before["last_initial"] + after["first_initial"] not in ("su", "ua", "au") for before, after in zip(full, full[1:])
    )
    dated = [piece for piece in full if piece["first_turn"] is not None]
    seen = sum(piece["turns_seen"] for piece in dated)
    seen -= sum(before["last_turn"] == after["first_turn"] for before, after in zip(dated, dated[1:]))
    cost, audit, slices = 0, "", []
    if full:
        ends = [{(s["entry"], s["exit"]): (s["cost"], s["audit"]) for s in piece["summary"]} for piece in full]
        cost, audit = ended(joined(ends))
        turns = [sum(edit != "I" for edit in piece["summary"][0]["audit"]) for piece in full]
        moves, opened = 0, sum(edit != "D" for edit in audit) % 2  # an odd number of turns begins with the system's
        for piece, cut in zip(full, cut_audit(audit, turns)):
            turn_next = "assistant" if moves and (moves - opened) % 2 else "user"
            slices.append({"part": piece["part"], "piece": piece["piece"], "cut": cut, "turn_next": turn_next})
            moves += sum(edit != "D" for edit in cut)
    return {
        "conv": pieces[0]["conv"], **count, "first_turn": dated[0]["first_turn"] if dated else None,
        "last_turn": dated[-1]["last_turn"] if dated else None, "turns_seen": seen, "cost": cost, "audit": audit,
        "slices": slices,
    }


def _applied(schema: pa.Schema):
    """Pieces with their part of the audit to repaired turns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                turns = ((t["role"], t["text"]) for t in row["held"] for _ in range(t["copies"]))
                made = edited(turns, row["cut"] or "", row["turn_next"] or "user")[0]
                named = {"conv": row["conv"], "whole": False, "part": row["part"], "piece": row["piece"], "repaired": made}
                yield pa.RecordBatch.from_pylist([named], schema=schema)

    return run


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The audit of each conversation, and its repaired turns.

    ``rows`` has ``conv, turn, role, text, copies`` (``damage`` makes it); a row without copies
    only keeps its conversation in the result. Turns go by ``turn`` (nulls first), then by role
    and text. The audits have ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit``.
    The repaired turns come as ``conv, whole, part, piece, repaired``: ``whole`` is a conversation
    in one row, others are rows in the order of ``part, piece``.

    Equal rows are counted before anything moves. Rows are cut by ranges of (conversation, turn,
    role, text), so a hot conversation is many tasks, each of which holds one piece; the pieces
    are put together through their costs and audits, at most 13 audits a piece, and the audit
    of a conversation is one string in its row. Null ids are one conversation. An empty
    role has no initial and is never kept as it is. Empty tables give empty results.
    """
    named = rows.select("conv", "turn", "role", "text", F.col("copies").cast("long").alias("copies"))
    counted = named.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    counted = stored(counted, "turns")
    key = F.sha2(F.concat(F.sha2("role", 256), "text"), 256)
    again = (
        counted.filter("copies > 0").groupBy("conv", key.alias("key"))
        .agg(F.min(F.struct(F.col("turn").isNotNull().alias("dated"), "turn")).alias("since"), F.count("*").alias("seen"))
        .filter("seen > 1").withColumnRenamed("conv", "of")
    )
    told = counted.join(again, F.col("conv").eqNullSafe(F.col("of")) & (key == F.col("key")), "left")
    later = F.col("seen").isNotNull() & ~F.col("turn").eqNullSafe(F.col("since.turn"))
    order = [F.col(name).asc_nulls_first() for name in ("conv", "turn", "role", "text")]
    sorted_rows = (
        told.select("conv", "turn", "role", "text", "copies", later.alias("again"))
        .repartitionByRange(*order).sortWithinPartitions(*order)
    )
    id_field = counted.schema["conv"]
    piece_schema = _with_id(id_field, PIECE)
    pieces = stored(sorted_rows.mapInArrow(_pieces(_arrow(piece_schema)), piece_schema), "pieces")

    parts = pieces.filter("NOT whole").select(
        "conv", "part", "piece", *COUNTS, "first_turn", "last_turn", "turns_seen", "first_initial", "last_initial",
        "summary",
    )
    one_schema = _with_id(
        id_field,
        f"{', '.join(f'{name} long' for name in COUNTS)}, first_turn long, last_turn long, turns_seen long, cost long, "
        "audit string, slices array<struct<part int, piece int, cut string, turn_next string>>",
    )
    composed = stored(
        parts.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "piece")
        .mapInArrow(_composed(_arrow(one_schema)), one_schema), "conversations",
    )
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns_seen"), F.lit(0)).alias("gaps")
    columns = ["conv", gaps, *COUNTS, "cost", "audit"]
    audits = pieces.filter("whole").select(*columns).unionByName(composed.select(*columns))

    slices = composed.select(F.explode("slices").alias("slice")).select("slice.*")
    repaired_schema = _with_id(id_field, f"whole boolean, part int, piece int, repaired {TURNS}")
    edited_parts = (
        pieces.filter("NOT whole").select("conv", "part", "piece", "held").join(slices, ["part", "piece"], "left")
        .select("conv", "part", "piece", "held", "cut", "turn_next")
        .mapInArrow(_applied(_arrow(repaired_schema)), repaired_schema)
    )
    repaired = pieces.filter("whole").select(*repaired_schema.names).unionByName(edited_parts)
    return audits, repaired


def _with_id(field: StructField, columns: str) -> StructType:
    return StructType([StructField("conv", field.dataType), *StructType.fromDDL(columns).fields])


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def lines(repaired: str) -> Column:
    """``role:text`` of each turn, joined by newlines."""
    return F.array_join(F.transform(repaired, lambda turn: F.concat(turn["role"], F.lit(":"), turn["text"])), "\n")


def repaired_digest(repaired: DataFrame) -> DataFrame:
    """``conv, repaired_sha256``: SHA-256 of each conversation's lines.

    One SHA-256 is a sequential pass by definition: the pieces of a conversation in several
    rows go through one task in order, which holds one batch of them.
    """

    digest_schema = StructType([StructField("conv", repaired.schema["conv"].dataType), StructField("repaired_sha256", StringType())])
    schema = _arrow(digest_schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, begun, open_line = None, None, False, False
        done: list[tuple] = []
        for batch in batches:
            for conv, count, text in zip(*[column.to_pylist() for column in batch.columns]):
                if not begun or conv != at:
                    if begun:
                        done.append((at, digest.hexdigest()))
                    at, digest, begun, open_line = conv, hashlib.sha256(), True, False
                if count:
                    digest.update((b"\n" if open_line else b"") + text.encode())
                    open_line = True
            if done:
                yield _table(done)
                done = []
        if begun:
            yield _table([(at, digest.hexdigest())])

    def _table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, type=field.type) for column, field in zip(zip(*found), schema)], schema=schema)

    parts = (
        repaired.filter("NOT whole").repartition("conv")
        .sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "piece")
        .select("conv", F.size("repaired").alias("count"), lines("repaired").alias("text"))
        .mapInArrow(run, digest_schema)
    )
    whole = repaired.filter("whole").select("conv", F.sha2(lines("repaired"), 256).alias("repaired_sha256"))
    return whole.unionByName(parts)
