"""Conversation repair against a plain search over all suffixes, row by row and through Spark."""
import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from stallwise.llm import repair

FULL = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, live int, cost string"


def cheapest(rows):
    """(cost, audit, repaired lines) of rows (role, text, must_go, truncated); state is the last role's letter."""
    @lru_cache(None)
    def search(i, state, inserted):
        found = []
        to = "assistant" if state == "u" else "user"
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, must_go, cut = rows[i]
            c, a, t = search(i + 1, state, 0)
            found.append((c + 4, "D" + a, t))
            if not must_go:
                first = role[:1]
                if first == "s" and state == "" or first in ("u", "a") and first == to[0]:
                    c, a, t = search(i + 1, first, 0)
                    found.append((c + 3 * cut, "K" + a, (f"{role}:{text}", *t)))
                c, a, t = search(i + 1, to[0], 0)
                found.append((c + 3 + 3 * cut, "R" + a, (f"{to}:{text}", *t)))
        if inserted < 3:
            c, a, t = search(i, to[0], inserted + 1)
            found.append((c + 3, "I" + a, (f"{to}:", *t)))
        return min(found, default=(10 ** 9, "", ()))
    return search(0, "", 0)


def text_of(value):
    return " " if value is None else str(value)


def brute(rows):
    """conv_id -> columns, from (conv_id, turn, role, text)."""
    after = {}
    for conv, turn, role, text in rows:
        out = after.setdefault(conv, [])
        role, text = text_of(role), text_of(text)
        hit = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(turn is not None, turn or 0, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    got = {}
    for conv, out in after.items():
        out.sort()
        turns = [t for known, t, _, _ in out if known]
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, _, role, text in out:
            full = FULL.findall(text)
            fault = 0 if not full else 1 if (role, text) in seen else 2 if full[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marked.append((role, text, fault in (0, 1), fault == 2))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
        cost, audit, lines = cheapest(tuple(marked))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        got[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return got


@pytest.mark.parametrize("roles", ["sua", "ua", "uuua", "uaU"])
def test_edits_equal_the_plain_search(roles):
    r = random.Random(roles)
    for _ in range(700):
        rows = tuple((r.choice(roles), str(i), r.random() < 0.25, r.random() < 0.3) for i in range(r.randrange(14)))
        out, lines = [], []

        def emit(letters, role, row):
            out.append(letters)
            if role:
                lines.append(f"{role}:{row[1] if row else ''}")
        one = repair.Repair(emit, every=r.choice([1, 3, 32]))
        for role, text, must_go, cut in rows:
            one.add(role[:1], must_go, cut, (role, text))
        assert (one.end(), "".join(out), tuple(lines)) == cheapest(rows)


def test_memory_follows_the_undecided_rows_only():
    most, letters = 0, []
    one = repair.Repair(lambda x, *_: letters.append(x))
    r = random.Random(3)
    for i in range(60_000):
        one.add(r.choice("uaaus"), r.random() < 0.1, r.random() < 0.2, ("x", "y"))
        most = max(most, one.undecided())
    assert most < 200
    for _ in range(60_000):  # rows that must go leave both survivors undecided; they extend one node
        one.add("u", True, False, None)
    size, node = 0, one.at[2]
    while node is not one.root:
        size, node = size + 1, node.up
    assert size < 100
    one.end()
    assert sum(map(len, letters)) >= 120_000


def conversations(seed, n=60):
    r = random.Random(seed)
    texts = ["Hello.", "Yes!", "no end", "", " \t", "Really?", "Hello. ", "tail ", "x.\n", "ü" * 3000 + ".", None]
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(9)):
            rows.append((conv, None if r.random() < 0.05 else turn + r.choice([0, 0, 0, 1, 7]),
                         r.choice(["user", "assistant"] * 4 + ["system", "tool", "User", "", None]), r.choice(texts)))
    return rows + [(None, t, "user", "Hi.") for t in (1, 2, None)] + [(None, 2, "user", "Hi.")] * 3


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_brute_force(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], SCHEMA)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair(repair.damaged(df)).collect()}
    assert got == brute(rows)


def test_a_conversation_that_holds_most_rows(spark):
    r = random.Random(9)
    rows = [(5, i, r.choice(["user", "assistant", "assistant"]), r.choice(["Yes.", "No.", f"Word {i}.", f"cut {i}"])) for i in range(400)]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], SCHEMA).repartition(7)
    assert {x.conv_id: tuple(x[c] for c in COLUMNS) for x in repair.repair(repair.damaged(df)).collect()} == brute(rows)


def test_nothing_left_and_nothing_given(spark):
    drop = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, drop, "user", "Hi.", 1, "c")], SCHEMA)
    assert [tuple(r) for r in repair.repair(repair.damaged(df)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert not repair.repair(repair.damaged(df.limit(0))).collect()


def test_the_registered_query(spark):
    from stallwise.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_conversation_repair"](spark, sf).collect()}
    assert got == brute(rows) and len(got) == len({r[0] for r in rows})
