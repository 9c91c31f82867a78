"""Conversation structure repair by a persistent audit DP.

The edits Keep, Rerole, Delete and Insert turn a conversation's rows into roles whose
initials read ``(s?(ua)+)?`` at the least cost. Four states (nothing yet, after the
system turn, after a user, after an assistant) run over the rows as a stream. Each holds
its cheapest edits so far as a linked node: nodes share their prefixes, carry ancestors
at powers of two and a rolling hash of the edits up to them. Of equally cheap edits the
smaller in ASCII order stays; it is found at the longest common prefix, by a binary
search over hashes of ancestors, and the prefix is verified by walking until the two
paths are one node, so that a collision of hashes only costs time.

Two equally cheap ways to the same state after the same rows never are each other's
prefix (only an Insert takes no row, and it costs), so what follows cannot turn their
order around. Whenever the paths of all states that may still win share a prefix, it is
decided: it is given out and forgotten. What a task holds of a conversation is the
undecided rest and the audit string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
SPACES = " \t\n\x0b\x0c\r"
_MODULUS, _FACTOR = (1 << 61) - 1, 0x1F3D5B79A2C4E68
_DECIDE_EVERY = 64
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
# The state that each initial leads to, and the turn that Rerole and Insert make.
_KEPT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER,
         (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}
_MADE = {_START: (_USER, "user"), _SYSTEM: (_USER, "user"), _ASSISTANT: (_USER, "user"),
         _USER: (_ASSISTANT, "assistant")}


class Node:
    """One edit, after those of its ancestors. ``up[k]`` is the 2^k-th ancestor."""

    __slots__ = ("edit", "role", "row", "depth", "hash", "up")

    def __init__(self, parent: Node | None, edit: str = "", role: str | None = None, row: int = -1):
        self.edit, self.role, self.row = edit, role, row
        if parent is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * _FACTOR + ord(edit)) % _MODULUS
        up = [parent]
        while len(up[-1].up) >= len(up):
            up.append(up[-1].up[len(up) - 1])
        self.up = tuple(up)

    def ancestor(self, depth: int) -> Node:
        at = self
        while at.depth > depth:
            at = at.up[min(len(at.up), (at.depth - depth).bit_length()) - 1]
        return at

    def path(self, root: Node) -> list[Node]:
        """The edits after ``root``, an ancestor, in order."""
        out, at = [], self
        while at is not root:
            out.append(at)
            at = at.up[0]
        return out[::-1]


def common(a: Node, b: Node) -> Node:
    """The last node that both paths go through."""
    depth = min(a.depth, b.depth)
    a, b = a.ancestor(depth), b.ancestor(depth)
    while a is not b:
        for k in reversed(range(len(a.up))):
            if a.up[k] is not b.up[k]:
                a, b = a.up[k], b.up[k]
                break
        else:
            return a.up[0]
    return a


def precedes(a: Node, b: Node) -> bool:
    """Whether the edits up to ``a`` come before those up to ``b`` in ASCII order; both
    grow from one root."""
    depth = min(a.depth, b.depth)
    x, y = a.ancestor(depth), b.ancestor(depth)
    if x.hash != y.hash:
        while x.up[0].hash != y.up[0].hash:
            k = max(k for k in range(len(x.up)) if x.up[k].hash != y.up[k].hash)
            x, y = x.up[k], y.up[k]
    # Here x and y are the first difference (or no difference) if no hash collided.
    first = (x, y) if x.edit != y.edit else None
    while x is not y:
        if x.edit != y.edit:
            first = (x, y)
        if not x.depth:
            break
        x, y = x.up[0], y.up[0]
    if first is None:
        return a.depth < b.depth
    return first[0].edit < first[1].edit


class Repair:
    """One conversation's rows, fed in order."""

    def __init__(self):
        self.root = Node(None)
        self.states: dict[int, tuple[int, Node]] = self._inserted({_START: (0, self.root)})
        self.rows: dict[int, tuple] = {}
        self.n = 0

    @staticmethod
    def _best(ways: list[tuple]) -> tuple[int, Node]:
        """The cheapest of ``(cost, parent, edit, role, row)``, ties to the first in order."""
        least = min(w[0] for w in ways)
        cost, *made = next(w for w in ways if w[0] == least)
        node = made[0] if made[1] is None else Node(*made)
        tied = [w for w in ways if w[0] == least]
        for _, parent, *edit in tied[1:]:
            other = parent if edit[0] is None else Node(parent, *edit)
            if precedes(other, node):
                node = other
        return cost, node

    def _inserted(self, states: dict) -> dict:
        """The states with what Inserts reach from them."""
        states = dict(states)
        for target, role, sources in ((_USER, "user", (_START, _SYSTEM, _ASSISTANT)),
                                      (_ASSISTANT, "assistant", (_USER,))):
            ways = [(states[target][0], states[target][1], None, None, -1)] if target in states else []
            ways += [(states[s][0] + COST[INSERT], states[s][1], INSERT, role, -1)
                     for s in sources if s in states]
            if ways:
                states[target] = self._best(ways)
        return states

    def feed(self, row: tuple, role: str, fault: str | None) -> None:
        """The next row: ``fault`` is blank, duplicate, truncated or None."""
        ways: dict[int, list] = {}
        more = TRUNCATED_COST if fault == "truncated" else 0
        for state, (cost, node) in self.states.items():
            ways.setdefault(state, []).append((cost + COST[DELETE], node, DELETE, None, self.n))
            if fault in ("blank", "duplicate"):
                continue
            kept = _KEPT.get((state, role[:1]))
            if kept is not None:
                ways.setdefault(kept, []).append((cost + more, node, KEEP, None, self.n))
            target, made = _MADE[state]
            if target != kept:
                ways.setdefault(target, []).append((cost + COST[REROLE] + more, node, REROLE, made, self.n))
        self.rows[self.n] = row
        self.n += 1
        states = self._inserted({s: self._best(w) for s, w in ways.items()})
        # From "after an assistant" all goes on as from the first two states, but that a
        # system turn must be deleted; and it may end.
        done = states[_ASSISTANT][0]
        if _START in states and states[_START][0] > done + COST[DELETE]:
            del states[_START]
        if _SYSTEM in states and states[_SYSTEM][0] > done:
            del states[_SYSTEM]
        self.states = states

    def decided(self) -> list[tuple[str, str | None, tuple | None]]:
        """``(edit, role made, row)`` of the edits that all paths share, once each."""
        nodes = [node for _, node in self.states.values()]
        last = nodes[0]
        for node in nodes[1:]:
            last = common(last, node)
        out = self._given(last.path(self.root))
        self.root, copies = Node(None), {}
        copies[last] = self.root
        for state, (cost, node) in self.states.items():  # what is left, without what was given
            for x in node.path(last):
                if x not in copies:
                    copies[x] = Node(copies[x.up[0]], x.edit, x.role, x.row)
            self.states[state] = (cost, copies[node])
        return out

    def finish(self) -> tuple[int, list[tuple[str, str | None, tuple | None]]]:
        """The cost of the cheapest edits and those not given out before."""
        ways = [(*self.states[s], None, None, -1) for s in (_START, _ASSISTANT) if s in self.states]
        cost, node = self._best(ways)
        return cost, self._given(node.path(self.root))

    def _given(self, path: list[Node]) -> list[tuple]:
        return [(x.edit, x.role, self.rows.pop(x.row) if x.row >= 0 else None) for x in path]


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` of conversations damaged by the crc32 of
    ``conv_id:turn`` modulo 20: 0 drops the row (``present`` is false; the row stays to name
    its conversation), 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes its
    role ``user``. A null role or text is one space; so is a null id or turn in the crc."""
    said = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")),
                       F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(said) % 20).alias("h"))
    h = F.col("h")
    return rows.select(
        "conv_id", "turn", F.when(h == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(h == 1, F.lit("")).when(h == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), (h != 0).alias("present"),
        F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        .alias("copy")).drop("copy")


def _fault(text: Column, again: Column) -> Column:
    said = F.rtrim(text, F.lit(SPACES))
    return (F.when(said == "", F.lit("blank")).when(again, F.lit("duplicate"))
            .when(~F.right(said, F.lit(1)).isin(".", "!", "?"), F.lit("truncated")))


_SUMMARY = ("struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,"
            "cost:bigint,audit:string,repaired_sha256:string>")


class _Report:
    """The repair of one conversation and what is counted on the way."""

    def __init__(self, conv_id):
        self.conv_id, self.repair, self.place = conv_id, Repair(), 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.before, self.distinct = 0, None, 0
        self.low = self.high = None
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0

    def feed(self, turn, role: str, text: str, fault: str | None) -> list[dict]:
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        self.repair.feed((turn, role, text, fault), role, fault)
        return self._edits(self.repair.decided()) if self.repair.n % _DECIDE_EVERY == 0 else []

    def _edits(self, edits: list[tuple]) -> list[dict]:
        out = []
        for edit, made, row in edits:
            turn, role, text, fault = row or (None, made, "", None)
            role = made or role
            self.audit.append(edit)
            if edit != DELETE:
                self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
                self.lines += 1
            out.append({"conv_id": self.conv_id, "place": self.place, "edit": edit, "turn": turn,
                        "role": role, "text": text, "fault": fault})
            self.place += 1
        return out

    def finish(self) -> list[dict]:
        cost, edits = self.repair.finish()
        out = self._edits(edits)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        summary = {"gaps": gaps, **self.faults, "illegal": self.illegal, "cost": cost,
                   "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}
        return [*out, {"conv_id": self.conv_id, "summary": summary}]


def repair(turns: DataFrame, present: str | None = None) -> DataFrame:
    """The cheapest edits of each conversation, and a report of it.

    One row per edit: ``conv_id``, ``place`` (from 0), ``edit`` (``K``, ``R``, ``D``, ``I``),
    ``turn``, ``role``, ``text`` (of the repaired turn; of the deleted row for ``D``) and
    ``fault``; and one row per conversation with a null ``place`` whose ``summary`` holds
    ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and
    ``repaired_sha256`` (the repaired ``role:text``, newline-joined). ``repaired`` and
    ``summaries`` split them.

    Rows are taken by turn (nulls first), those of one turn by role, then text. Null roles
    and texts are one space. Where ``present`` names a boolean column, rows without it only
    name their conversation, and one of which no row is left has zeros, an empty audit and
    the hash of nothing. Rows with a null id are one conversation. Only the four columns
    and ``present`` are read; an empty table gives no rows.

    A conversation is one task's stream, sorted with spilling (a hash over all its turns
    cannot be split). Repeats are numbered in the same shuffle, not held."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"),
                        (F.col(present) if present else F.lit(True)).alias("present"))
    same = Window.partitionBy("conv_id", "role", "text", "present").orderBy("turn")
    rows = rows.repartition("conv_id").withColumn("_nth", F.row_number().over(same))
    ordered = rows.withColumn("fault", _fault(F.col("text"), F.col("_nth") > 1)).sortWithinPartitions(
        "conv_id", "turn", "role", "text", "_nth").select("conv_id", "turn", "role", "text", "present", "fault")
    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    schema = (f"conv_id {kinds['conv_id']}, place bigint, edit string, turn {kinds['turn']}, "
              f"role string, text string, fault string, summary {_SUMMARY}")
    summary = pa.struct([(f.split(":")[0], pa.string() if f.endswith("string") else pa.int64())
                         for f in _SUMMARY[7:-1].split(",")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, out, size, types = None, [], 0, None

        def batch():
            made = pa.Table.from_pylist(out, schema=types).combine_chunks().to_batches()
            out.clear()
            return made

        for rows in batches:
            types = pa.schema([("conv_id", rows.schema.field("conv_id").type), ("place", pa.int64()),
                               ("edit", pa.string()), ("turn", rows.schema.field("turn").type),
                               ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()),
                               ("summary", summary)])
            for conv_id, turn, role, text, there, fault in zip(
                    *(c.to_pylist() for c in rows.columns), strict=True):
                if report is None or report.conv_id != conv_id:
                    if report is not None:
                        out.extend(report.finish())
                    report = _Report(conv_id)
                if there:
                    size += len(text)
                    out.extend(report.feed(turn, role, text, fault))
                if len(out) >= 2048 or size > 1 << 22 and out:
                    yield from batch()
                    size = 0
        if report is not None:
            out.extend(report.finish())
            yield from batch()

    return ordered.mapInArrow(run, schema)


def repaired(edits: DataFrame) -> DataFrame:
    """The turns of the repaired conversations, in the order of ``place``."""
    return edits.where("place is not null and edit <> 'D'").select("conv_id", "place", "turn", "role", "text")


def summaries(edits: DataFrame) -> DataFrame:
    """One row per conversation."""
    return edits.where("place is null").select("conv_id", "summary.*")
