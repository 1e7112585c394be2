"""Repair of damaged conversations: cost DP, then path ranking by prefix doubling.

A conversation's turns pass an automaton of the roles allowed, ``(s?(ua)+)?``: NOTHING yet, a SYSTEM turn, a USER turn,
an ASSISTANT turn. A node is (turns read, state); its arcs are the edits, each with a cost and an initial: Delete,
Insert, Keep, Rerole. The DP goes from the last turn back and gives each node its cost to the end. The arcs that lie
on cheapest ways remain, and the way whose initials (its audit) are least is found by doubling: nodes are ranked by the
first 2**k letters of their least audit, and the rank by twice as many is the rank of the pair (own rank, rank of the
node that 2**k letters lead to). Pointers double along. Ranks of start nodes tell equal audits, which are
read off once each, all their letters at once, by the pointers whose powers of two make up a letter's place.

Conversations are dealt by id, sorted, and solved many at a time. One of more than SEGMENT turns does not meet in one
task before its text is hashed: its turns, without texts, are dealt by range into segments. A segment is told to the
others as the costs from each state to each state (4 x 4); with the costs behind it, it solves itself for every state
it may be entered in; the states are chained over segments, and the audit of the way taken goes to the texts, which
one task reads in order, one batch at a time, as a hash over the whole conversation requires.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalvault.session import cut_lineage

SEGMENT = 16384
"""Turns that are solved in one piece."""
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INSERTED = np.array([USER, USER, ASSISTANT, USER])
"""The state after a user or assistant turn that is allowed in a state; there is one for each."""
NEVER = 1 << 40
KEPT = np.full((4, 4), -1)
"""State after keeping a turn of role initial 0 (other), 1 (s), 2 (u), 3 (a); -1 where that is not allowed."""
KEPT[1, NOTHING], KEPT[2, [NOTHING, SYSTEM, ASSISTANT]], KEPT[3, USER] = SYSTEM, USER, ASSISTANT
LETTERS = "\0DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
END = np.array([0, NEVER, NEVER, 0])
"""A conversation may end empty or after an assistant turn."""

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
WHITE = "\x20\t\n\x0b\x0c\r"


class Segments:
    """Turns of many segments, one after another: ``initial`` and ``fault`` of each turn, ``bounds`` of the segments,
    ``last`` where the conversation ends with the segment."""

    def __init__(self, initial: np.ndarray, fault: np.ndarray, bounds: np.ndarray, last: np.ndarray | None = None) -> None:
        self.initial, self.fault, self.bounds = initial, fault, bounds
        self.sizes = np.diff(bounds)
        self.last = np.ones(len(self.sizes), bool) if last is None else last
        # what each turn costs: to delete, to keep by state, to rerole
        self.extra = (fault == TRUNCATED).astype(np.int64)
        self.fixed = (fault == BLANK) | (fault == DUPLICATE)
        self.kept = np.where(self.fixed[:, None], -1, KEPT[initial])

    def back(self, row: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Costs before reading the turns ``row``, from those after them; without inserts."""
        out = COST[DELETE] + after
        kept = self.kept[row].reshape(len(row), *([1] * (after.ndim - 2)), 4)
        kept = np.broadcast_to(kept, after.shape)
        keep = np.where(kept < 0, NEVER, np.take_along_axis(after, np.maximum(kept, 0), -1))
        extra = self.extra[row].reshape(len(row), *([1] * (after.ndim - 1)))
        rerole = np.where(self.fixed[row].reshape(extra.shape), NEVER, COST[REROLE] + after[..., INSERTED])
        return np.minimum(out, extra + np.minimum(keep, rerole))

    def costs(self, end: np.ndarray, held: bool = True) -> np.ndarray:
        """Costs to the end of each node of each segment, where ``end`` (segments, ..., 4) follows behind it; the nodes of
        a segment are its turns and one more. Without ``held`` only the first node's."""
        nodes = np.full((len(self.initial) + len(self.sizes), *end.shape[1:]), NEVER, np.int64) if held else None
        after = np.where(self.last.reshape(-1, *([1] * (end.ndim - 1))), insert_before(end), end)
        order = np.argsort(-self.sizes, kind="stable")
        sizes, starts = self.sizes[order], self.bounds[:-1][order]
        after = after[order]
        if held:
            nodes[starts + sizes + order] = after
        for k in range(1, int(sizes.max(initial=0)) + 1):
            live = int(np.searchsorted(-sizes, -k, "right"))
            row = starts[:live] + sizes[:live] - k
            after[:live] = insert_before(self.back(row, after[:live]))
            if held:
                nodes[row + order[:live]] = after[:live]
        if held:
            return nodes
        out = np.empty_like(after)
        out[order] = after
        return out


def insert_before(cost: np.ndarray) -> np.ndarray:
    """The least costs when turns may be inserted first; two inserts in a row suffice, since a third returns."""
    once = np.minimum(cost, COST[INSERT] + cost[..., INSERTED])
    return np.minimum(once, COST[INSERT] + once[..., INSERTED])


def least_arcs(part: Segments, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node, state by state: the least letter of its cheapest arcs (0: the end) and the node that it leads to.

    Arcs of one node bear different letters, so the first letter tells them apart; what follows is ranked by doubling.
    """
    count = len(cost)
    letter, target = np.zeros((count, 4), np.int64), np.arange(4 * count).reshape(count, 4)
    segment = np.repeat(np.arange(len(part.sizes)), part.sizes)
    node = np.arange(len(part.initial)) + segment  # of each turn, before it is read
    closing = np.ones(count, bool)
    closing[node] = False
    extra = part.extra[:, None]
    after, here, base = cost[node + 1], cost[node], (node + 1)[:, None] * 4
    may_insert = np.ones(count, bool)
    may_insert[np.flatnonzero(closing)[~part.last]] = False
    rerole = np.where(part.fixed[:, None], NEVER, COST[REROLE] + extra + after[:, INSERTED])
    keep = np.where(part.kept < 0, NEVER, extra + np.take_along_axis(after, np.maximum(part.kept, 0), 1))

    def put(where: np.ndarray, rows: np.ndarray, name: int, to: np.ndarray) -> None:
        at, state = np.nonzero(where)
        letter[rows[at], state], target[rows[at], state] = name, to[at, state]

    # from the greatest letter to the least, so that the least stays
    put(rerole == here, node, REROLE, base + INSERTED[None, :])
    put(keep == here, node, KEEP, base + part.kept)
    put((COST[INSERT] + cost[:, INSERTED] == cost) & may_insert[:, None], np.arange(count), INSERT, np.arange(count)[:, None] * 4 + INSERTED[None, :])
    put(COST[DELETE] + after == here, node, DELETE, base + np.arange(4)[None, :])
    return letter.ravel(), target.ravel()


def rank_paths(letter: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ranks of the nodes by their whole audits, the audits' lengths, and pointers over 1, 2, 4, ... letters."""
    rank, steps, pointers = letter, (letter > 0).astype(np.int64), [target]
    while True:
        far = pointers[-1]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[far], return_inverse=True)[1]
        steps = steps + steps[far]
        if (letter[far] == 0).all():
            return rank, steps, pointers
        pointers.append(far[far])


def read_paths(starts: np.ndarray, letter: np.ndarray, rank: np.ndarray, steps: np.ndarray, pointers: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The least audit from each of ``starts`` and the node where it ends; equal audits are read once."""
    first, same = np.unique(rank[starts], return_index=True, return_inverse=True)[1:]
    some = starts[first]
    length = steps[some]
    bounds = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(int(bounds[-1])) - np.repeat(bounds[:-1], length)
    node = np.repeat(some, length)
    for k, pointer in enumerate(pointers):
        ahead = (place >> k & 1).astype(bool)
        node[ahead] = pointer[node[ahead]]
    codes = np.frombuffer(LETTERS.encode(), np.uint8)[letter[node]].tobytes().decode()
    texts = [codes[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    end = starts.copy()
    for k, pointer in enumerate(pointers):
        ahead = (steps[starts] >> k & 1).astype(bool)
        end[ahead] = pointer[end[ahead]]
    return [texts[i] for i in same.tolist()], end


def solve(part: Segments, end: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Cost, audit and last state of each segment that is entered in the states ``enter`` (segments, n)."""
    cost = part.costs(end)
    letter, target = least_arcs(part, cost)
    found = rank_paths(letter, target)
    starts = ((part.bounds[:-1] + np.arange(len(part.sizes)))[:, None] * 4 + enter).ravel()
    audits, last = read_paths(starts, letter, *found)
    return cost.ravel()[starts], audits, last % 4


class Repaired:
    """Takes a conversation's audit and turns bit by bit and hashes what becomes of them."""

    def __init__(self) -> None:
        self.state, self.hash, self.empty = NOTHING, hashlib.sha256(), True

    def line(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def follow(self, audit: str, turns: Iterator[tuple[str, str, int]]) -> None:
        for edit in audit:
            if edit == "I":
                self.state = INSERTED[self.state]
                self.line("user" if self.state == USER else "assistant", "")
                continue
            role, text, initial = next(turns)
            if edit == "K":
                self.state = KEPT[initial, self.state]
                self.line(role, text)
            elif edit == "R":
                self.state = INSERTED[self.state]
                self.line("user" if self.state == USER else "assistant", text)


# columns of the turns --------------------------------------------------------------------------------------------

_INITIAL = {"s": 1, "u": 2, "a": 3}
_RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
_KINDS = [pa.int64()] * 7 + [pa.string()] * 2
_NAMES = [f.split()[0] for f in _RESULT.split(", ")]


def spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy): turns after damage by crc32(conv_id:turn) % 20; copy is -1 for a dropped one.

    0 drops a turn, 1 empties its text, 2 takes its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes the user its speaker.
    Nulls count as one space; a dropped turn stays as a row without text, so that its conversation is still known.
    """
    harm = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(harm <= 1, "").when(harm == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(harm == 0, " ").when(harm == 4, "user").otherwise(spaced("role"))
    copies = F.when(harm == 0, F.array(F.lit(-1))).when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"),
                                F.explode(copies).alias("copy"))


def features(turns: DataFrame) -> DataFrame:
    """``turns`` with the role's ``initial`` (0 other, 1 s, 2 u, 3 a) and its ``fault`` (0 none, 1 blank, 3 truncated)."""
    bare = F.rtrim("text", F.lit(WHITE))
    initial = F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2).when(F.col("role").startswith("a"), 3).otherwise(0)
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    return turns.select("*", initial.alias("initial"), fault.alias("fault"))


def _order(*more: str) -> list[Column]:
    """Turns in order, nulls first; equal turn numbers by role and digests of the text, since no more is said of them."""
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("t1").asc(), F.col("t2").asc(), *[F.col(c) for c in more]]


def _digests(turns: DataFrame) -> DataFrame:
    return turns.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit("salt"), "text"))


def _rows(results: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*results) if results else [[]] * 9, _KINDS)], _NAMES)


def _illegal(initial: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Of turns next to each other, those whose roles are not su, ua or au; ``inner``: both of one conversation."""
    a, b = initial[:-1], initial[1:]
    fine = ((a == 1) & (b == 2)) | ((a == 2) & (b == 3)) | ((a == 3) & (b == 2))
    return ~fine & inner


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in order, whole ones of each batch at once."""
    held: list[pa.RecordBatch] = []

    def work(table: pa.Table) -> pa.RecordBatch:
        conv, turn, role, text = (table.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))
        copy, initial, fault = (table.column(c).to_numpy().astype(np.int64) for c in ("copy", "initial", "fault"))
        new = np.flatnonzero([True] + [a != b for a, b in zip(conv, conv[1:])])
        there = copy >= 0
        rows = np.flatnonzero(there)
        bounds = np.searchsorted(rows, np.append(new, len(conv)))
        fault = fault[rows]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            seen = set()
            for i in range(a, b):
                key = (role[rows[i]], text[rows[i]])
                if key in seen and fault[i] != BLANK:
                    fault[i] = DUPLICATE
                seen.add(key)
        part = Segments(initial[rows], fault, bounds)
        cost, audits, _ = solve(part, np.tile(END, (len(new), 1)), np.zeros((len(new), 1), np.int64))
        owner = np.repeat(np.arange(len(new)), part.sizes)
        wrong = np.bincount(owner[1:][_illegal(part.initial, owner[1:] == owner[:-1])], minlength=len(new))
        faults = [np.bincount(owner[fault == f], minlength=len(new)) for f in (BLANK, DUPLICATE, TRUNCATED)]
        out = []
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            known = {turn[r] for r in rows[a:b].tolist()} - {None}
            gaps = max(known) - min(known) + 1 - len(known) if known else 0
            done = Repaired()
            done.follow(audits[i], iter([(role[r], text[r], int(k)) for r, k in zip(rows[a:b].tolist(), part.initial[a:b])]))
            out.append((conv[new[i]], gaps, *[int(f[i]) for f in faults], int(wrong[i]), int(cost[i]), audits[i], done.hash.hexdigest()))
        return _rows(out)

    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id")
        last, cut = conv[batch.num_rows - 1].as_py(), batch.num_rows - 1
        while cut and conv[cut - 1].as_py() == last:
            cut -= 1
        if held and (cut or held[-1].column("conv_id")[0].as_py() != last):
            yield work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        elif cut:
            yield work(pa.Table.from_batches([batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield work(pa.Table.from_batches(held))


def repair(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per conv_id of ``conversations`` (conv_id, turn, role, text), which are damaged first: gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256.

    Nulls in role and text are one space; rows without conv_id are one conversation; turns without a number come
    first. Turns of equal number are ordered by role and by digests of their texts; repeated rows are duplicates. A role
    that begins with none of s, u and a cannot be kept. A conversation without turns after damage has zeros, an empty
    audit and the hash of the empty string. Texts of any length are read whole. An empty table gives no rows; further
    columns are not read. A conversation of more than ``segment`` turns is solved in segments, with the same result.
    """
    turns = damaged(conversations)
    counts = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.count(F.lit(1)).alias("n"))
    long = cut_lineage(counts.where(F.col("n") > segment // 2).select(F.col("conv_id").alias("long_id")))
    if not long.limit(1).count():
        return _repair_short(turns)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return _repair_short(turns.join(long, same, "left_anti")).union(_repair_long(turns.join(long, same, "left_semi"), segment))


def _repair_short(turns: DataFrame) -> DataFrame:
    ordered = _digests(features(turns)).repartition("conv_id").sortWithinPartitions(*_order("copy"))
    return ordered.select("conv_id", "turn", "role", "text", "copy", "initial", "fault").mapInArrow(_repair_whole, _RESULT)


# conversations in segments -----------------------------------------------------------------------------------------

def _numbered(segment: int) -> Callable:
    """Adds the task's number, the place in it and the segment's number to turns in order; a segment begins where the
    conversation changes, where it is full, and with the task."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, place, piece, size, before = TaskContext.get().partitionId(), 0, -1, 0, object()
        for batch in batches:
            pieces = []
            for conv in batch.column("conv_id").to_pylist():
                if conv != before or size == segment:
                    piece, size, before = piece + 1, 0, conv
                size += 1
                pieces.append(piece)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, task)), pa.array(np.arange(place, place + n)), pa.array(pieces, pa.int64())],
                                             [*batch.schema.names, "task", "place", "piece"])
            place += n

    return number


def _segments_of(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole segments, from rows sorted by (task, piece, place)."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        total += batch.num_rows
        if total >= rows:
            table = pa.Table.from_batches(held)
            task, piece = table.column("task").to_numpy(), table.column("piece").to_numpy()
            cut = int(np.flatnonzero((task != task[-1]) | (piece != piece[-1])).max(initial=-1)) + 1
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            total = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table) -> tuple[np.ndarray, Segments]:
    task, piece = table.column("task").to_numpy(), table.column("piece").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (piece[1:] != piece[:-1])]))
    last = table.column("last").to_numpy(zero_copy_only=False).astype(bool)[first] if "last" in table.column_names else np.zeros(len(first), bool)
    return first, Segments(table.column("initial").to_numpy().astype(np.int64), table.column("fault").to_numpy().astype(np.int64),
                           np.append(first, table.num_rows), last)


def _ids(table: pa.Table, first: np.ndarray) -> list[pa.Array]:
    return [table.column(c).take(pa.array(first)).combine_chunks() for c in ("conv_id", "task", "piece")]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment the costs from each state before it to each state behind it, and its inner illegal neighbours."""
    for table in _segments_of(batches):
        first, part = _starts(table)
        there = np.where(np.eye(4, dtype=bool), 0, NEVER)
        cost = part.costs(np.tile(there, (len(first), 1, 1)), held=False)  # [segment, to, from]
        owner = np.repeat(np.arange(len(first)), part.sizes)
        wrong = np.bincount(owner[1:][_illegal(part.initial, owner[1:] == owner[:-1])], minlength=len(first))
        yield pa.RecordBatch.from_arrays(
            [*_ids(table, first), pa.array([m.T.ravel().tolist() for m in cost], pa.list_(pa.int64())), pa.array(wrong),
             pa.array(part.initial[part.bounds[:-1]]), pa.array(part.initial[part.bounds[1:] - 1])],
            ["conv_id", "task", "piece", "costs", "illegal", "head", "tail"])


def _behind(group: pa.Table) -> pa.Table:
    """The costs behind each segment of one conversation, from its last segment back."""
    group = group.sort_by([("task", "ascending"), ("piece", "ascending")])
    n = group.num_rows
    costs = group.column("costs").combine_chunks().flatten().to_numpy().reshape(n, 4, 4)
    out = np.empty((n, 4), np.int64)
    behind = END
    for i in range(n - 1, -1, -1):
        out[i] = behind
        behind = np.minimum((costs[i] + (insert_before(behind) if i == n - 1 else behind)[None, :]).min(1), NEVER)
    head, tail = group.column("head").to_numpy(), group.column("tail").to_numpy()
    wrong = group.column("illegal").to_numpy().copy()
    for i in range(1, n):
        wrong[i] += int(_illegal(np.array([tail[i - 1], head[i]]), np.ones(1, bool))[0])
    return pa.table([group.column("conv_id"), group.column("task"), group.column("piece"), pa.array(out.tolist(), pa.list_(pa.int64())),
                     pa.array(np.arange(n) == n - 1), pa.array(wrong)], ["conv_id", "task", "piece", "behind", "last", "illegal"])


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment and state before it: cost to the conversation's end, audit inside the segment, state behind it."""
    for table in _segments_of(batches):
        first, part = _starts(table)
        end = np.array(table.column("behind").take(pa.array(first)).to_pylist(), np.int64).reshape(len(first), 4)
        cost, audits, last = solve(part, end, np.tile(np.arange(4), (len(first), 1)))
        ids = [pa.array(np.repeat(np.asarray(c.to_numpy(zero_copy_only=False)), 4)) for c in _ids(table, first)[1:]]
        conv = _ids(table, first)[0].take(pa.array(np.repeat(np.arange(len(first)), 4)))
        yield pa.RecordBatch.from_arrays([conv, *ids, pa.array(np.tile(np.arange(4), len(first))), pa.array(last), pa.array(cost), pa.array(audits, pa.string())],
                                         ["conv_id", "task", "piece", "enter", "leave", "cost", "audit"])


def _taken(group: pa.Table) -> pa.Table:
    """The state in which the least way enters each segment of one conversation."""
    group = group.sort_by([("task", "ascending"), ("piece", "ascending"), ("enter", "ascending")])
    leave = group.column("leave").to_numpy().reshape(-1, 4)
    enter, state = np.empty(len(leave), np.int64), NOTHING
    for i, to in enumerate(leave):
        enter[i], state = state, to[state]
    rows = pa.array(np.arange(len(leave)) * 4 + enter)
    return pa.table([group.column(c).take(rows) for c in ("conv_id", "task", "piece", "enter")], ["conv_id", "task", "piece", "enter"])


def _hash_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, hash) of conversations in order: an audit's row comes before the turns of its segment."""
    done, before, audit, results = None, object(), "", []
    for batch in batches:
        rows = batch.to_pylist()
        at = 0
        while at < len(rows):
            row = rows[at]
            if done is None or row["conv_id"] != before:
                if done is not None:
                    done.follow(audit, iter(()))
                    results.append((before, done.hash.hexdigest()))
                done, before, audit = Repaired(), row["conv_id"], ""
            if row["audit"] is not None:
                done.follow(audit, iter(()))  # inserts behind the last turn of the segment before
                audit, at = row["audit"], at + 1
                continue
            used = 0
            while audit[used] == "I":
                used += 1
            done.follow(audit[:used + 1], iter([(row["role"], row["text"], row["initial"])]))
            audit, at = audit[used + 1:], at + 1
    if done is not None:
        done.follow(audit, iter(()))
        results.append((before, done.hash.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in results], pa.int64()), pa.array([h for _, h in results], pa.string())], ["conv_id", "repaired_sha256"])


def _repair_long(turns: DataFrame, segment: int) -> DataFrame:
    key = ["conv_id", "task", "piece"]
    there = _digests(features(turns)).withColumn("uid", F.monotonically_increasing_id())
    # turns in order over all tasks: one conversation spreads over as many as its share of the rows
    ordered = there.where("copy >= 0").repartitionByRange(*_order("uid")).sortWithinPartitions(*_order("uid"))
    kinds = "conv_id long, turn long, role string, text string, initial int, fault int, t1 long, t2 long, task long, place long, piece long"
    placed = cut_lineage(ordered.select("conv_id", "turn", "role", "text", "initial", "fault", "t1", "t2").mapInArrow(_numbered(segment), kinds))
    lean = placed.drop("text", "turn")
    again = lean.groupBy("conv_id", "role", "t1", "t2").agg(F.min(F.struct("task", "place")).alias("first"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1").select(*[F.col(c).alias(f"{c}_") for c in ("conv_id", "role", "t1", "t2")], "first")
    seen = F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("role") == F.col("role_")) & (F.col("t1") == F.col("t1_")) & (F.col("t2") == F.col("t2_"))
    fault = F.when((F.col("fault") != BLANK) & (F.struct("task", "place") != F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    marked = cut_lineage(lean.join(again, seen, "left").select(*key, "place", "initial", F.coalesce(fault, "fault").cast("int").alias("fault")))
    in_order = marked.repartition("task", "piece").sortWithinPartitions("task", "piece", "place")
    matrices = cut_lineage(in_order.mapInArrow(_matrices, "conv_id long, task long, piece long, costs array<long>, illegal long, head long, tail long"))
    behind = cut_lineage(matrices.groupBy("conv_id").applyInArrow(_behind, "conv_id long, task long, piece long, behind array<long>, last boolean, illegal long"))
    told = marked.join(behind.select("task", "piece", "behind", "last"), ["task", "piece"])
    told = told.repartition("task", "piece").sortWithinPartitions("task", "piece", "place")
    ways = cut_lineage(told.mapInArrow(_ways, "conv_id long, task long, piece long, enter long, leave long, cost long, audit string"))
    taken = ways.select(*key, "enter", "leave").groupBy("conv_id").applyInArrow(_taken, "conv_id long, task long, piece long, enter long")
    way = cut_lineage(ways.drop("conv_id").join(taken, ["task", "piece", "enter"]).select(*key, "cost", "audit"))
    texts = placed.select(*key, "place", "role", "text", "initial", F.lit(None).cast("string").alias("audit"))
    heads = way.select(*key, F.lit(-1).cast("long").alias("place"), *[F.lit(None).cast(t).alias(n) for n, t in (("role", "string"), ("text", "string"), ("initial", "int"))], "audit")
    hashes = texts.union(heads).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "task", "piece", "place") \
        .mapInArrow(_hash_long, "conv_id long, repaired_sha256 string")
    audits = way.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("task", "piece", "audit"))), lambda s: s.audit), "").alias("audit"),
                                        F.min_by("cost", F.struct("task", "piece")).alias("cost"))
    gaps = placed.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    faults = marked.groupBy("conv_id").agg(*[F.count_if(F.col("fault") == f).alias(n) for n, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))])
    wrong = behind.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    out = turns.select(F.col("conv_id").alias("id")).distinct()
    for more in (gaps, faults, wrong, audits, hashes):
        out = out.join(more, F.col("id").eqNullSafe(more["conv_id"]), "left").drop("conv_id")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
