"""Repair of conversations against a shortest path over all edits."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest

from sessionscope.llm import conversation_repair as cr
from sessionscope.llm.queries import QUERIES
from tests.llm.conftest import SF_DIR

SPACE = " \t\n\x0b\x0c\r"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def slow_damage(rows):
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 0:
            yield conv, None
            continue
        text = "" if draw == 1 else text.translate(str.maketrans("", "", ".!?")) if draw == 2 else text
        for _ in range(2 if draw == 3 else 1):
            yield conv, (turn, "user" if draw == 4 else role, text)


def slow_repair(turns):
    """Dijkstra over (row, state) with (cost, audit) as the distance: every edit, no alignment."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    seen, faults = set(), []
    for _, role, text in turns:
        rest = text.rstrip(SPACE)
        faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, row, state, made = heapq.heappop(heap)
        if row == len(turns) and state in (0, 3):
            break
        if (row, state) in done:
            continue
        done.add((row, state))
        for initial, role in (("u", "user"), ("a", "assistant")):
            if initial in NEXT[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", row, NEXT[state][initial], made + ((role, ""),)))
        if row < len(turns):
            _, role, text = turns[row]
            heapq.heappush(heap, (cost + 4, audit + "D", row + 1, state, made))
            if faults[row] not in ("blank", "duplicate"):
                more = 3 * (faults[row] == "truncated")
                if role[:1] in NEXT[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", row + 1, NEXT[state][role[:1]], made + ((role, text),)))
                for initial, new in (("u", "user"), ("a", "assistant")):
                    if initial in NEXT[state]:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", row + 1, NEXT[state][initial], made + ((new, text),)))
    initials = [role[:1] for _, role, _ in turns]
    dated = [turn for turn, _, _ in turns if turn is not None]
    return (
        max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0,
        *[faults.count(name) for name in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(f"{role}:{text}" for role, text in made).encode()).hexdigest(),
    )


def expected(rows):
    groups = defaultdict(list)
    for conv, turn in slow_damage(rows):
        groups[conv].extend([turn] if turn else [])
    return sorted(((conv, *slow_repair(turns)) for conv, turns in groups.items()), key=str)


def found(spark, rows, schema="conv_id long, turn long, role string, text string"):
    audits, repaired = cr.repair_conversations(cr.damage(spark.createDataFrame(rows, schema).repartition(3)))
    digest = {row.conv: row.repaired_sha256 for row in cr.repaired_digest(repaired).collect()}
    return sorted(((*row, digest[row.conv]) for row in audits.collect()), key=str)


def drawn(seed, convs, longest):
    draw = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "usher", "", None]
    texts = ["Yes.", "No!", "cut", "", " \t", None, "a. b", "Why?", "ü.", ".", "x" * 300]
    rows = []
    for conv in [None, *range(convs)]:
        for _ in range(draw.randint(1, longest)):
            rows.append((conv, draw.choice([None, *range(longest)]), draw.choice(roles), draw.choice(texts)))
    return rows + rows[:5]


@pytest.mark.parametrize("seed", range(4))
def test_patterns_against_shortest_paths(seed):
    draw = random.Random(seed)
    kinds = {"s": ("system", "."), "u": ("user", "."), "a": ("assistant", "."), "o": ("tool", "."),
             "S": ("system", ""), "U": ("user", ""), "A": ("assistant", ""), "x": None}
    for _ in range(150):
        pattern = "".join(draw.choice("ssuuuaaaoSUAx") for _ in range(draw.randint(0, 11)))
        turns = [(n, kinds[k][0], f"t{n}{kinds[k][1]}") if kinds[k] else (n, "user", "") for n, k in enumerate(pattern)]
        assert cr.ended(cr.summarize(pattern)) == slow_repair(turns)[5:7], pattern


@pytest.mark.parametrize("chunk", [1, 2, 5])
def test_chunks_change_nothing(monkeypatch, chunk):
    draw = random.Random(chunk)
    patterns = ["".join(draw.choice("suuaaoSUAx") for _ in range(draw.randint(1, 24))) for _ in range(120)]
    whole = [cr.ended(cr.summarize(pattern)) for pattern in patterns]
    monkeypatch.setattr(cr, "CHUNK", chunk)
    assert whole == [cr.ended(cr.summarize(pattern)) for pattern in patterns]


@pytest.mark.parametrize("piece", [1_024, 3])
def test_dirty_conversations(spark, monkeypatch, piece):
    monkeypatch.setattr(cr, "PIECE_TURNS", piece)
    rows = drawn(piece, 60, 12)
    assert found(spark, rows) == expected(rows)


def test_one_long_conversation_and_text(spark):
    rows = [(1, n // 2, ["user", "assistant", "system"][n % 7 % 3], f"t{n % 90}{'.!?,'[n % 4]}") for n in range(700)]
    rows += [(2, 0, "user", "word " * 100_000 + "."), (2, 1, "assistant", None)]
    assert found(spark, rows) == expected(rows)


def test_equal_rows_are_counted(spark):
    rows = [(None, None, "user", "same.")] * 500 + [(5, 1, "assistant", "same")] * 3
    assert found(spark, rows) == expected(rows)


def test_empty_table_and_clashing_columns(spark):
    schema = "conv string, copies string, conv_id string, turn int, role string, text string, part string, audit string"
    assert found(spark, [], schema) == []
    rows = [("x", "y", "c1", 1, "user", "Hi.", "p", "a"), ("x", "y", "c1", 2, "assistant", "Ho.", None, None)]
    assert found(spark, rows, schema) == expected([row[2:6] for row in rows])


def test_query(spark):
    rows = [tuple(row) for row in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, QUERIES["op11_conversation_repair"](spark, SF_DIR).select(*columns).collect()), key=str) == expected(rows)
