"""Conversation structure repair by a survivor-coalescence Viterbi.

The cheapest edits turn a conversation's rows into roles ``(s?(ua)+)?``. The search goes over the rows once with
four states: nothing yet, after the system row, after a user row, after an assistant row. Each state keeps one
survivor, the cheapest edits that end there, as a leaf of a tree of back pointers. A leaf that no state keeps is
released, and with it every node whose count of references falls to 0. As soon as all survivors hang below one
child of the root, that edit is final: it is emitted and the child becomes the root. So the tree, and the texts
of rows that may still be kept, span only the undecided rows. Survivors of equal cost are compared by their
edits from the common ancestor on, whole. A survivor that an edit sequence from another state always beats is
dropped, else deleting everything would never end as an alternative. Runs of rows that must go extend one node.

Repeats are found by Spark: the first turn of each (conversation, role, SHA-256 of the text) that has several,
aggregated partially and joined back, which adaptive execution splits where one of them is hot.

How it scales. Rows are dealt by conversation and sorted there once; a task streams them in Arrow batches and holds
one batch, the undecided rows and the audit of the current conversation, never its rows. One conversation is
one stream because its hash is: SHA-256 of the whole repaired text takes it in order. Its result row holds an audit
of one letter a row.

Edge cases. A null text or role counts as one space, a null conv_id or turn as one space in the key of the damage.
Rows without conv_id are one conversation. Rows that share a turn go by role, then text; of equal ones all but the
first are duplicates. Roles are known by their first letter, case included. Very long texts are held one batch at a
time. Empty tables give no rows; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WORD, kept, register, table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
_REROLE, _DELETE, _INSERT, _TRUNCATED = 3, 4, 3, 3
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_BEFORE_USER = (_START, _SYSTEM, _ASSISTANT)
_WHITE = " \t\n\x0b\x0c\r"


class _Node:
    """An edit, repeated ``run`` times, after its parent's; ``refs`` counts children and states that keep it."""
    __slots__ = ("up", "letter", "run", "refs", "depth")

    def __init__(self, up, letter):
        self.up, self.letter, self.run, self.refs = up, letter, 1, 0
        self.depth = 0
        if up is not None:
            up.refs += 1
            self.depth = up.depth + 1


def _less(a: _Node, x: str, b: _Node, y: str) -> bool:
    """Whether the edits of ``a`` and then ``x`` come before those of ``b`` and then ``y`` in ASCII."""
    left, right = [x], [y]
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.letter * a.run)
            a = a.up
        else:
            right.append(b.letter * b.run)
            b = b.up
    return "".join(reversed(left)) < "".join(reversed(right))


class Repair:
    """The cheapest edits of one conversation, row by row; ``emit(letter, role, row)`` gets each as it is decided."""

    def __init__(self, emit: Callable, every: int = 32):
        self.emit, self.every, self.rows = emit, every, 0
        self.root = _Node(None, "")
        self.at: list = [None] * 4
        self.cost: list = [0] * 4
        self.waiting, self.out, self.state = {}, 0, _START
        self._hold(_START, self.root, 0)
        self._insert()

    def _hold(self, state, node, cost):
        node.refs += 1
        self.at[state], self.cost[state] = node, cost

    def _release(self, node):
        node.refs -= 1
        while node.refs == 0 and node is not self.root:
            node = node.up
            node.refs -= 1

    def _offer(self, state, source, extra):
        """An inserted row after ``source`` leads to ``state`` if that is cheaper, or comes first at equal cost."""
        node = self.at[source]
        if node is None:
            return
        cost, now = self.cost[source] + extra, self.at[state]
        if now is None or cost < self.cost[state] or cost == self.cost[state] and _less(node, INSERT, now, ""):
            new = _Node(node, INSERT)
            if now is not None:
                self._release(now)
            self._hold(state, new, cost)

    def _insert(self):
        for source in _BEFORE_USER:
            self._offer(_USER, source, _INSERT)
        self._offer(_ASSISTANT, _USER, _INSERT)

    def _drop(self, state):
        if self.at[state] is not None:
            self._release(self.at[state])
            self.at[state] = None

    def add(self, initial: str, must_go: bool, truncated: bool, row) -> None:
        """The next row: its role's first letter, its faults, and what ``emit`` shall get for it."""
        at, cost = self.at, self.cost
        best = [None] * 4

        def offer(state, source, letter, extra):
            if at[source] is None:
                return
            c, now = cost[source] + extra, best[state]
            if now is None or c < now[0] or c == now[0] and _less(at[source], letter, at[now[1]], now[2]):
                best[state] = (c, source, letter)
        for state in range(4):
            offer(state, state, DELETE, _DELETE)
        if not must_go:
            self.waiting[self.rows] = row
            more = _TRUNCATED if truncated else 0
            if initial == "s":
                offer(_SYSTEM, _START, KEEP, more)
            for source in _BEFORE_USER:
                offer(_USER, source, *((KEEP, more) if initial == "u" else (REROLE, _REROLE + more)))
            offer(_ASSISTANT, _USER, *((KEEP, more) if initial == "a" else (REROLE, _REROLE + more)))
        used = [0] * 4
        for b in best:
            if b:
                used[b[1]] += 1
        old = list(at)
        for state, b in enumerate(best):
            if b is None:
                at[state] = None
                continue
            node = old[b[1]]
            alone = b[1] == state and used[state] == 1 and node.refs == 1 and node is not self.root
            if alone and b[2] == DELETE == node.letter:
                node.run += 1
                node.depth += 1
                old[state] = None
                self.at[state], self.cost[state] = node, b[0]
            else:
                best[state] = (b[0], _Node(node, b[2]))
                self._hold(state, best[state][1], b[0])
        for node in old:
            if node is not None:
                self._release(node)
        self._insert()
        # what the assistant state reaches, too, at less: deleting a system row is the dearest of its detours
        if at[_START] is not None and at[_ASSISTANT] is not None and cost[_START] > cost[_ASSISTANT] + _DELETE:
            self._drop(_START)
        if at[_SYSTEM] is not None and at[_ASSISTANT] is not None and cost[_SYSTEM] > cost[_ASSISTANT]:
            self._drop(_SYSTEM)
        self.rows += 1
        if self.rows % self.every == 0:
            self._settle(next(n for n in at if n is not None))

    def _settle(self, node) -> None:
        """Emit what all survivors share."""
        path = []
        while node is not self.root:
            path.append(node)
            node = node.up
        while path and self.root.refs == 1:
            self.root = path.pop()
            self.root.up = None
            self._decide(self.root.letter, self.root.run)

    def _decide(self, letter, run):
        if letter == DELETE:
            for k in range(self.out, self.out + run):
                self.waiting.pop(k, None)
            self.out += run
            self.emit(DELETE * run, None, None)
            return
        row = None
        if letter != INSERT:
            row = self.waiting.pop(self.out)
            self.out += 1
        if letter == KEEP and self.state == _START and row[0][:1] == "s":
            self.state = _SYSTEM
        else:
            self.state = _ASSISTANT if self.state == _USER else _USER
        role = row[0] if letter == KEEP else ("user" if self.state == _USER else "assistant")
        self.emit(letter, role, row)

    def undecided(self) -> int:
        return len(self.waiting)

    def end(self) -> int:
        """Emit the rest; the cost of all edits."""
        start, last = self.at[_START], self.at[_ASSISTANT]
        state = _ASSISTANT
        if start is not None and (last is None or self.cost[_START] < self.cost[_ASSISTANT] or
                                  self.cost[_START] == self.cost[_ASSISTANT] and _less(start, "", last, "")):
            state = _START
        for other in range(4):
            if other != state:
                self._drop(other)
        node, cost = self.at[state], self.cost[state]
        path = []
        while node is not self.root:
            path.append(node)
            node = node.up
        for n in reversed(path):
            self._decide(n.letter, n.run)
        return cost


class _Conversation:
    """Counts, audit and hash of one conversation's rows in order."""

    def __init__(self, conv):
        self.conv, self.blank, self.duplicate, self.truncated, self.illegal = conv, 0, 0, 0, 0
        self.low = self.high = self.last = None
        self.turns, self.audit, self.hash, self.empty = 0, [], hashlib.sha256(), True
        self.repair = Repair(self._emit)

    def _emit(self, letters, role, row):
        self.audit.append(letters)
        if role is not None:
            text = f"{role}:{row[1] if row else ''}"
            self.hash.update((text if self.empty else "\n" + text).encode())
            self.empty = False

    def add(self, turn, role, text, blank, seen, truncated):
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn
        if self.last is not None:
            self.illegal += self.last[1][:1] + role[:1] not in ("su", "ua", "au")
        duplicate = not blank and (seen or self.last == (turn, role, text))
        truncated = truncated and not blank and not duplicate
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.last = (turn, role, text)
        self.repair.add(role[:1], blank or duplicate, truncated, (role, text))

    def result(self):
        cost = self.repair.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.hash.hexdigest())


def damaged(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and live: every row, changed by the checksum of its key; dropped rows are not live."""
    space = F.lit(" ")
    known = lambda c: F.coalesce(F.col(c).cast("string"), space)
    rows = messages.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"),
                           (F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20).alias("hit"))
    text = (F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("hit") != 0).alias("live"), F.explode(copies).alias("copy")).drop("copy")


def _faults(rows: DataFrame) -> DataFrame:
    """The rows with blank, truncated (by their own text) and seen (same role and text in an earlier turn)."""
    last = F.right(F.rtrim("text", F.lit(_WHITE)), F.lit(1))
    rows = rows.withColumn("blank", ~F.col("text").rlike(WORD)).withColumn("truncated", ~last.isin(".", "!", "?"))
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    digest = F.unhex(F.sha2("text", 256))
    open_ = rows.where("live and not blank").groupBy("conv_id", "role", digest.alias("digest")).agg(
        F.min(order).alias("first"), F.max(order).alias("last")).where("first < last")
    again = kept(open_.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "digest", "first"), "repeats")
    found = rows.withColumn("d", F.when(F.col("live") & ~F.col("blank"), digest)).withColumn("order", order)
    joined = found.join(again, found["conv_id"].eqNullSafe(again["c"]) & (found["role"] == again["r"]) & (found["d"] == again["digest"]), "left")
    return joined.select("conv_id", "turn", "live", "role", "text", "blank", F.coalesce(F.col("first") < F.col("order"), F.lit(False)).alias("seen"), "truncated")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id of rows (conv_id, turn, role, text, live): faults counted, cheapest edits, hash of the result."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
              "audit string, repaired_sha256 string")
    columns = schema.replace(",", "").split()[::2]

    def run(batches):
        now, done = None, []

        def flush():
            types = [kinds, *[pa.int64()] * 6, pa.string(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*done), types)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, columns)
        for b in batches:
            kinds = b.column(0).type
            for conv, turn, live, role, text, blank, seen, truncated in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(conv)
                if live:
                    now.add(turn, role, text, blank, seen, truncated)
            if done:
                yield flush()
        if now is not None:
            done.append(now.result())
        if done:
            yield flush()
    order = [F.asc_nulls_first("turn"), "role", "text"]
    return _faults(rows).repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(run, schema)


@register("op11_conversation_repair")
def op11_conversation_repair(spark, sf_dir):
    return repair(damaged(table(spark, sf_dir, "conversations")))
