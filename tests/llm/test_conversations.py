"""Conversation repair against a plain recursion over all cheapest edits."""

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest

from fundlake.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, cost long, key string"
STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        part = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if part == 0:
            continue
        text = "" if part == 1 else "".join(c for c in text if c not in ".!?") if part == 2 else text
        out += [(conv, turn, "user" if part == 4 else role, text)] * (2 if part == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit, lines) by a recursion that tries every edit; the least audit of the cheapest."""
    @functools.cache
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        for initial, after in STEPS[state].items():
            if initial in NAMES and inserts < 3:
                cost, audit, lines = best(i, after, inserts + 1)
                found.append((cost + 5, "I" + audit, (NAMES[initial] + ":", *lines)))
        if i < len(rows):
            role, text = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            found.append((cost + 2, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                for initial, after in STEPS[state].items():
                    cost, audit, lines = best(i + 1, after, 0)
                    if role[:1] == initial:
                        found.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
                    if initial in NAMES:
                        found.append((cost + more + 1, "R" + audit, (f"{NAMES[initial]}:{text}", *lines)))
        return min(found, key=lambda f: f[:2]) if found else (10 ** 9, "", ())

    return best(0, 0, 0)


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = [r[1:] for r in damage([r for r in rows if r[0] == conv])]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in mine:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for _, role, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = cheapest([r[1:] for r in mine], faults)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


def some_rows(seed, conversations_=60):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(conversations_), None]:
        roles = ["system"] * rng.randrange(3) + ["user", "assistant"] * 6
        for turn in range(rng.randrange(1, 13)):
            role = rng.choice([roles[turn], roles[turn], "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "no", "What?", " ", "", None, "a b!", f"text {rng.randrange(99)}."])
            rows.append((conv, rng.choice([turn, turn, turn, 3 * turn, None]), role, text))
    return rows


@pytest.mark.parametrize("limit", [4096, 3, 1])
def test_repair_equals_recursion(spark, limit):
    rows = some_rows(11)
    rows += rows[:40]  # repeated rows
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"line {t}.") for t in range(90)]
    got = sorted(map(tuple, conversations.repair(table(spark, rows), limit).collect()), key=repr)
    want = brute(rows)
    assert got == want
    # deleting a row is cheaper than an insert, so no cheapest audit has one
    assert {letter for r in want for letter in r[7]} == set("DKR")


def test_conversation_without_rows_left_and_empty_table(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = conversations.repair(table(spark, [(conv, 0, "user", "Hi.")])).collect()
    assert list(map(tuple, got)) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.repair(table(spark, [])).count() == 0


def test_long_texts_and_texts_equal_in_their_first_characters(spark):
    long = "x" * 300_000
    rows = [(5, 0, "user", long + "."), (5, 0, "user", long + "!"), (5, 1, "assistant", long), (5, None, "system", long + "?"), (5, 2, "user", "a" * 70 + ".")]
    (got,) = conversations.repair(table(spark, rows)).collect()
    assert got.duplicate + got.blank <= 2 and got.cost > 0
    again = conversations.repair(table(spark, rows[::-1]), 1).collect()
    assert [got] == again


def test_ranks_order_the_audits():
    rng = np.random.default_rng(4)
    initials, faults = rng.integers(0, 4, 40), rng.integers(0, 4, 40)
    paths = conversations.Paths(initials, faults, np.array([0, 15, 15, 40]), np.tile(conversations.END, (3, 1)), np.ones(3, bool))
    nodes = np.arange(paths.cost.size)
    audits, rank = paths.least(nodes)
    assert [audits[i] for i in np.lexsort((nodes, rank))] == sorted(audits)
    assert len(set(zip(rank.tolist(), audits, strict=True))) == len(set(audits))
