"""Conversation repair: the cheapest edits of a conversation's turns, by bidirectional Dijkstra.

The edit lattice of n turns has a node for each (turns read, what the repaired turns say so far: nothing,
a system turn, a user turn, an assistant turn).  Edges read a turn and Keep it (0), give it the role that
is due (Rerole, 3) or Delete it (4), or Insert an empty turn of the role that is due (3).  Blank turns and
duplicates have to be deleted; a truncated turn that stays costs 3 more.  The repaired roles read
(system? (user assistant)+)?, by their first letters.

A forward heap starts at the first node, a reverse heap at the last ones; the side with the smaller key
goes on until both keys together exceed the best crossing, so that every crossing of that cost is settled
on both sides.  Of the crossings the least concatenated audit (first letters of the edits) is taken.  The
least prefix of a node is enough for that: of two cheapest ways to a node none can begin with the other,
as between them lies a cycle and cycles cost.  Prefixes and suffixes are links to the neighbouring node,
so memory is in proportion to the lattice.

Turns go by turn (null first), then role and text.  Each turn's first fault counts: blank (nothing but
white space), duplicate (role and text seen earlier), truncated (the last character that is no white
space is not one of .!?).  A null role or text is one space; a turn with an empty role cannot be kept.
Repeated rows are turns of their own, and so duplicates.  Rows with a null conv_id form one conversation.
A conversation without turns has zero counts and no edits; an empty table gives no rows.  Other columns
are not read.  A conversation is one training text and has to fit into a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn of the role that is due, and the states in which a conversation may end.
DUE = (USER, USER, ASSISTANT, USER)
ENDS = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


def kept_as(state: int, initial: str) -> int | None:
    """The state after a kept turn with that initial, if it may stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    return DUE[state] if initial == " sua"[DUE[state]] else None


class Lattice:
    """Edges of the lattice of one conversation; a node is (turns read, state)."""

    def __init__(self, initials: list[str], faults: list[int]):
        self.initials, self.faults, self.n = initials, faults, len(initials)

    def reading(self, i: int, state: int) -> Iterator[tuple[tuple[int, int], int, str]]:
        """(node, cost, letter) of the edges that read turn i in a state."""
        yield (i + 1, state), DELETE, "D"
        if self.faults[i] not in (BLANK, DUPLICATE):
            more = CUT_OFF if self.faults[i] == TRUNCATED else 0
            if (after := kept_as(state, self.initials[i])) is not None:
                yield (i + 1, after), KEEP + more, "K"
            yield (i + 1, DUE[state]), REROLE + more, "R"

    def forward(self, node: tuple[int, int]) -> Iterator[tuple[tuple[int, int], int, str]]:
        i, state = node
        yield (i, DUE[state]), INSERT, "I"
        if i < self.n:
            yield from self.reading(i, state)

    def reverse(self, node: tuple[int, int]) -> Iterator[tuple[tuple[int, int], int, str]]:
        """(node, cost, letter) of the edges that lead here."""
        i, state = node
        for before in range(4):
            if DUE[before] == state:
                yield (i, before), INSERT, "I"
            if i:
                for to, cost, letter in self.reading(i - 1, before):
                    if to == node:
                        yield (i - 1, before), cost, letter


class Side:
    """One heap with the distance, the link and the number of letters of each node it has met."""

    def __init__(self, starts: list[tuple[int, int]], sign: int):
        self.sign, self.done = sign, set()
        self.cost = {node: 0 for node in starts}
        self.link: dict[tuple[int, int], tuple[tuple[int, int], str] | None] = {node: None for node in starts}
        self.letters = {node: 0 for node in starts}
        self.heap = [(0, sign * node[0], node) for node in sorted(starts)]

    def key(self) -> float:
        while self.heap and (self.heap[0][2] in self.done or self.heap[0][0] > self.cost[self.heap[0][2]]):
            heappop(self.heap)
        return self.heap[0][0] if self.heap else inf

    def settle(self) -> tuple[int, int]:
        """Take the nearest node; of equally near ones the one that an edge of no cost cannot lead back to."""
        node = heappop(self.heap)[2]
        self.done.add(node)
        return node

    def relax(self, via: tuple[int, int], node: tuple[int, int], cost: int, letter: str) -> None:
        total, known = self.cost[via] + cost, self.cost.get(node, inf)
        if node in self.done or total > known or total == known and not self.less((via, letter), self.link[node]):
            return
        self.cost[node], self.link[node], self.letters[node] = total, (via, letter), self.letters[via] + 1
        if total < known:
            heappush(self.heap, (total, self.sign * node[0], node))

    def less(self, new, old) -> bool:
        """Whether the audit through one link is less than through another."""
        if old is None:
            return False
        (a, x), (b, y) = new, old
        if self.sign > 0:  # prefixes: the first letters after their last common node decide
            while a != b:
                if self.letters[a] >= self.letters[b]:
                    a, x = self.link[a]
                else:
                    b, y = self.link[b]
        return x < y

    def audit(self, node: tuple[int, int]) -> str:
        out = []
        while self.link[node] is not None:
            node, letter = self.link[node]
            out.append(letter)
        return "".join(out[::-1] if self.sign > 0 else out)


def cheapest_edits(initials: list[str], faults: list[int]) -> tuple[int, str]:
    """(cost, audit): the cheapest edits and, of equally cheap ones, the least audit."""
    lattice = Lattice(initials, faults)
    ends = [(lattice.n, state) for state in ENDS]
    ahead, back = Side([(0, START)], 1), Side(ends, -1)
    best = 0 if lattice.n == 0 else inf
    while (a := ahead.key()) + (b := back.key()) <= best and inf not in (a, b):
        side, other, edges = (ahead, back, lattice.forward) if a <= b else (back, ahead, lattice.reverse)
        node = side.settle()
        for to, cost, letter in edges(node):
            side.relax(node, to, cost, letter)
            if to in other.cost:
                best = min(best, side.cost[to] + other.cost[to])
    audits = [ahead.audit(e) for e in ends if e in ahead.done and ahead.cost[e] == best]
    for node in ahead.done:
        for to, cost, letter in lattice.forward(node):
            if to not in ahead.done and to in back.done and ahead.cost[node] + cost + back.cost[to] == best:
                audits.append(ahead.audit(node) + letter + back.audit(to))
    return best, min(audits)


def applied(audit: str, initials: list[str]) -> tuple[list[int], list[str | None]]:
    """For each repaired turn: the place of the turn it comes from (-1: inserted) and its new role, if any."""
    places, roles, i, state = [], [], 0, START
    for letter in audit:
        if letter in "IR":
            state = DUE[state]
            roles.append("user" if state == USER else "assistant")
            places.append(i if letter == "R" else -1)
        elif letter == "K":
            state = kept_as(state, initials[i])
            roles.append(None)
            places.append(i)
        i += letter != "I"
    return places, roles


def judged(initials: list[str], kinds: list[int], digests: list[bytes]) -> list[int]:
    """The first fault of each turn."""
    seen, out = set(), []
    for kind, digest in zip(kinds, digests):
        out.append(BLANK if kind == BLANK else DUPLICATE if digest in seen else kind)
        seen.add(digest)
    return out


EDITED = "n_blank long, n_duplicate long, n_truncated long, illegal long, cost long, audit string, places array<int>, roles array<string>"


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[] for _ in range(8)]
        for marks in batch.column("marks").to_pylist():
            initials = [m["initial"] for m in marks]
            faults = judged(initials, [m["kind"] for m in marks], [m["digest"] for m in marks])
            cost, audit = cheapest_edits(initials, faults)
            places, roles = applied(audit, initials)
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            for column, value in zip(out, (*[faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)], illegal, cost, audit, places, roles)):
                column.append(value)
        kinds = [*[pa.int64()] * 5, pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("said"), batch.column("gaps"), *[pa.array(c, k) for c, k in zip(out, kinds)]],
            names=["conv_id", "said", "gaps", *[part.split()[0] for part in EDITED.split(", ")]],
        )


def repair(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None
) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired: a row for each conversation.

    `repaired` holds (role, text) of the repaired turns.  Rows for which `present` is not true are no
    turns, but their conversations appear.
    """
    said = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text")
    )
    rows = turns.select(F.col(conv_id).alias("conv_id"), (said if present is None else F.when(present, said)).alias("said"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    ink = lambda t: F.rtrim(t["text"], F.lit(WHITE))
    marks = F.transform("said", lambda t: F.struct(
        F.substring(t["role"], 1, 1).alias("initial"),
        F.when(ink(t) == "", BLANK).when(F.substring(ink(t), -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED).alias("kind"),
        F.unhex(F.md5(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]))).alias("digest"),
    ))
    numbers = F.filter(F.transform("said", lambda t: t["turn"]), lambda n: n.isNotNull())
    shaped = grouped.select("conv_id", "said", numbers.alias("numbers"), marks.alias("marks")).select(
        "conv_id", "said",
        F.coalesce(F.array_max("numbers") - F.array_min("numbers") + 1 - F.size(F.array_distinct("numbers")), F.lit(0)).cast("long").alias("gaps"),
        "marks",
    )
    kind = shaped.schema
    done = shaped.mapInArrow(edited, f"conv_id {kind['conv_id'].dataType.simpleString()}, said {kind['said'].dataType.simpleString()}, gaps long, {EDITED}")
    own = lambda place: F.get(F.col("said"), place)
    repaired = F.transform(F.arrays_zip("places", "roles"), lambda z: F.struct(
        F.coalesce(z["roles"], own(z["places"])["role"]).alias("role"),
        F.when(z["places"] < 0, F.lit("")).otherwise(own(F.greatest(z["places"], F.lit(0)))["text"]).alias("text"),
    ))
    return done.select(
        "conv_id", "gaps", F.col("n_blank").alias("blank"), F.col("n_duplicate").alias("duplicate"), F.col("n_truncated").alias("truncated"),
        "illegal", "cost", "audit", repaired.alias("repaired"),
    )
