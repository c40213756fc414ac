"""Repair of the turn structure of conversations by a Viterbi search with survivor coalescence.

A repaired conversation's role initials read ``(s?(ua)+)?``. Each row is kept,
given another role, or deleted, and empty turns may be put in anywhere; the
cheapest edits are wanted, of equal ones those whose initials (D, I, K, R) are
least as a string. The search has four states: nothing yet, after the system
turn, after a user's, after an assistant's.

The survivors of the states are leaves of a tree of edits. A node without
children and survivors is taken out, and its parents after it; as soon as the
root has one child and is no survivor itself, its edits are certain and leave.
So only rows about which the survivors disagree are held. Two paths are
compared as whole strings without walking them: paths up to the same row have
the same number of row edits, so none is the beginning of another, and their
order never changes once they differ.

Spark deals conversations by id, once; repeated texts are marked by a window
within that partitioning, and a second sort gives each task its conversations
in order, which it reads as a stream. A conversation is one sequence and its
digest runs over it in order, so one task reads it, holding no more than the
rows in dispute.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from strataform.llm.line_dedup import BLANKS

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The role that may follow each state: at the start "", then the initial of the last turn.
FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
ALLOWED_PAIRS = ("su", "ua", "au")
OUT_ROWS = 4096


def _gap(state: str) -> list[tuple[str, int, str]]:
    """States that insertions reach: (state, cost, edits); coming back to a state never pays."""
    found = [(state, 0, "")]
    while FOLLOWS[found[-1][0]] not in [s for s, _, _ in found]:
        state, cost, edits = found[-1]
        found.append((FOLLOWS[state], cost + INSERT, edits + "I"))
    return found


def _moves(initial: str, fault: str | None) -> list[tuple[str, list[tuple[str, int, str]]]]:
    """For each state after a row, the best (state before, cost, edits) of every state before it."""
    best: dict[tuple[str, str], tuple[int, str]] = {}
    stay = TRUNCATED if fault == "truncated" else 0
    for before in FOLLOWS:
        for state, cost, edits in _gap(before):
            ends = [(state, DELETE, "D")]
            if fault not in ("blank", "duplicate"):
                ends.append((FOLLOWS[state], REROLE + stay, "R"))
                if initial == FOLLOWS[state] or (initial == "s" and state == ""):
                    ends.append((initial, stay, "K"))
            for after, more, edit in ends:
                key, found = (after, before), (cost + more, edits + edit)
                best[key] = min(found, best.get(key, found))
    return [(after, [(b, *best[a, b]) for a, b in best if a == after]) for after in FOLLOWS]


MOVES = {(i, f): _moves(i, f) for i in ("s", "u", "a", "") for f in (None, "blank", "duplicate", "truncated")}


class Node:
    """Edits up to and with one row: its insertions, then what happens to the row."""

    __slots__ = ("parent", "children", "survivors", "before", "edits", "row")

    def __init__(self, parent: Node | None, before: str, edits: str, row: tuple | None):
        self.parent, self.before, self.edits, self.row = parent, before, edits, row
        self.children, self.survivors = [], 0
        if parent is not None:
            parent.children.append(self)


class Repair:
    """The search over one conversation; rows go in, certain edits come out."""

    def __init__(self):
        self.root = Node(None, "", "", None)
        self.root.survivors = 1
        #: state: (cost, rank of its path among the survivors, node)
        self.alive = {"": (0, 0, self.root)}
        self.held = 0

    def push(self, row: tuple, initial: str, fault: str | None) -> Iterator[tuple[str, str | None, tuple | None]]:
        """Add a row; yields (edit, new role, row) of every edit that is certain now."""
        alive, chosen = self.alive, []
        for after, sources in MOVES[initial if initial in ("s", "u", "a") else "", fault]:
            least = None
            for before, more, edits in sources:
                if before in alive:
                    cost, rank, node = alive[before]
                    offer = (cost + more, rank, edits, before)
                    if least is None or offer < least:
                        least = offer
            if least:
                chosen.append((after, least))
        # paths in string order; the rank is all that later comparisons need
        chosen.sort(key=lambda c: c[1][1:3])
        new = {}
        for rank, (after, (cost, _, edits, before)) in enumerate(chosen):
            new[after] = (cost, rank, Node(alive[before][2], before, edits, row))
            new[after][2].survivors = 1
        self.held += len(new)
        old, self.alive = alive, new
        for _, _, node in old.values():
            self._leave(node)
        self._drop_beaten()
        return self._certain()

    def _drop_beaten(self) -> None:
        """Survivors that can't win: another does all that they can, at less cost or as a lesser string."""
        a, u = self.alive.get("a"), self.alive.get("u")
        if a and u and (a[0] + INSERT, a[1]) < u[:2]:
            self._drop("u")
        elif a and u and (u[0] + INSERT, u[1]) < a[:2]:
            self._drop("a")
        a = self.alive.get("a")
        if a and "s" in self.alive and a[:2] < self.alive["s"][:2]:
            self._drop("s")
        # a kept system turn is the one thing that only the start can do; deleting it instead costs DELETE
        if a and "" in self.alive and a[0] + DELETE < self.alive[""][0]:
            self._drop("")

    def _drop(self, state: str) -> None:
        self._leave(self.alive.pop(state)[2])

    def _leave(self, node: Node) -> None:
        node.survivors -= 1
        while not node.children and not node.survivors and node.parent is not None:
            node.parent.children.remove(node)
            self.held -= 1
            node = node.parent

    def _certain(self) -> Iterator[tuple[str, str | None, tuple | None]]:
        while len(self.root.children) == 1 and not self.root.survivors:
            self.root = self.root.children[0]
            self.root.parent = None
            self.held -= 1
            yield from self._edits(self.root.before, self.root.edits, self.root.row)

    def _edits(self, state: str, edits: str, row: tuple | None) -> Iterator[tuple[str, str | None, tuple | None]]:
        for edit in edits:
            if edit == "D":
                yield "D", None, row
            elif edit == "K":
                yield "K", row[1], row
            else:
                state = FOLLOWS[state]
                yield edit, ROLES[state], row if edit == "R" else None

    def finish(self) -> Iterator[tuple[str, str | None, tuple | None]]:
        """The edits that were in dispute, and those at the end."""
        ends = [(cost + more, rank, edits, state) for state, (cost, rank, _) in self.alive.items() for after, more, edits in _gap(state) if after in ("", "a")]
        _, _, edits, state = min(ends)
        for other in [s for s in self.alive if s != state]:
            self._drop(other)
        self.alive[state][2].survivors = 0
        yield from self._certain()
        yield from self._edits(state, edits, None)


EDITS = "conv_id long, seq long, edit string, turn long, was_role string, role string, text string, fault string"
EDITS_ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split(" ") for c in EDITS.split(", "))])
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPORT_ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split(" ") for c in REPORT.split(", "))])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == OUT_ROWS:
            yield pa.record_batch([list(c) for c in zip(*held)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([list(c) for c in zip(*held)], schema=schema)


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def edited() -> Iterator[tuple]:
        for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
            search, seq = Repair(), 0
            for _, turn, role, text, fault in rows:
                for edit in search.push((turn, role, text, fault), role[:1], fault):
                    yield _edit_row(conv_id, seq, *edit)
                    seq += 1
            for edit in search.finish():
                yield _edit_row(conv_id, seq, *edit)
                seq += 1

    return _batches(edited(), EDITS_ARROW)


def _edit_row(conv_id, seq: int, edit: str, role: str | None, row: tuple | None) -> tuple:
    if row is None:
        return conv_id, seq, edit, None, None, role, "", None
    return conv_id, seq, edit, row[0], row[1], role, row[2], row[3]


def fault_of(seen: Column, text: Column) -> Column:
    """The first fault of a row: blank, duplicate (its role and text were seen before, this is number ``seen``), truncated, or null."""
    bare = F.rtrim(text, F.lit(BLANKS))
    return (
        F.when(F.length(bare) == 0, "blank")
        .when(seen > 1, "duplicate")
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    )


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Every edit of every conversation, in order: conv_id, seq (from 0), edit (K, R, D or I), turn, was_role, role, text, fault.

    ``turns`` has conv_id, turn, role and text; other columns are left out. Rows
    are taken by turn, nulls first, then by role and text. ``was_role`` is null
    for insertions, ``role`` for deletions; the rows with a role, in order, are
    the repaired conversation.

    Null role or text: one space. A role that doesn't begin with s, u or a (an
    empty one too) can't be kept. Repeated rows are duplicates. Rows with a null
    conv_id make one conversation. An empty table gives an empty table. The rows
    of a task come in order and each conversation in one task.
    """
    own = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    marked = own.withColumn("seen", seen).withColumn("fault", fault_of(F.col("seen"), F.col("text")))
    in_order = marked.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "seen")
    return in_order.select("conv_id", "turn", "role", "text", "fault").mapInArrow(_search, EDITS)


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def reports() -> Iterator[tuple]:
        for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
            faults, audit, sha = Counter(), [], hashlib.sha256()
            first = last = None
            distinct = cost = illegal = kept = 0
            initial = None
            for _, _, edit, turn, was_role, role, text, fault in rows:
                audit.append(edit)
                cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                if was_role is not None:
                    faults[fault] += 1
                    illegal += initial is not None and initial + was_role[:1] not in ALLOWED_PAIRS
                    initial = was_role[:1]
                    if turn is not None:
                        distinct += turn != last
                        first, last = turn if first is None else first, turn
                if role is not None:
                    sha.update(f"{chr(10) if kept else ''}{role}:{text}".encode())
                    kept += 1
            gaps = 0 if first is None else last - first + 1 - distinct
            yield conv_id, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, "".join(audit), sha.hexdigest()

    return _batches(reports(), REPORT_ARROW)


def repair_report(turns: DataFrame) -> DataFrame:
    """A row for each conversation: gaps in its turns, faults, illegal neighbours, cost, audit and digest of the repair.

    Read from the edits as they come, in the task that found them. Odd rows: see
    ``repair_conversations``.
    """
    return repair_conversations(turns).mapInArrow(_digest, REPORT)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults put in by the checksum of conv_id and turn; nulls are one space."""

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    role = F.when(kind == 4, "user").otherwise(filled("role"))
    copies = F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def damage_report(turns: DataFrame) -> DataFrame:
    """``repair_report`` of the damaged conversations, with a row for every conv_id of ``turns``.

    A conversation of which no row is left has zeros, an empty audit and the
    digest of nothing.
    """
    everyone = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repair_report(damaged(turns)).withColumnRenamed("conv_id", "__found")
    joined = everyone.join(found, everyone["conv_id"].eqNullSafe(found["__found"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
