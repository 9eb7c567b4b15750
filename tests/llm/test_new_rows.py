"""Line de-duplication, conversation repair and the prefix trie: against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from tabwright.llm import conversation_repair as C, line_dedup as L, prefix_trie as T

WHITE = " \t\n\x0b\x0c\r"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def lines_left(rows, shortest, least):
    """Counter of (doc_id, lines, dropped, text left) by the definition."""
    keys = [[lowered(line.strip(WHITE)) for line in (t or "").split("\n")] for _, t in rows]
    holders = defaultdict(list)
    for (i, _), own in zip(rows, keys):
        for k in set(own):
            holders[k].append(-(2**63) if i is None else i)
    out = Counter()
    for (i, t), own in zip(rows, keys):
        kept = [
            line for line, k in zip((t or "").split("\n"), own)
            if len(k) < shortest or len(holders[k]) < least or max(holders[k]) == (-(2**63) if i is None else i)
        ]
        out[i, len(own), len(own) - len(kept), "\n".join(kept)] += 1
    return out


def line_rows(seed, n):
    pick = random.Random(seed)
    pool = [f"line number {i} that repeats here" for i in range(6)] + ["short", "", "Ünï 日本 line that is long enough", "\t A Line With Capitals In It \r", "a line with capitals in it"]
    return [(pick.choice([None, *range(n)]) if k % 5 == 0 else k, None if k % 17 == 0 else "\n".join(pick.choice(pool) for _ in range(pick.randint(0, 9)))) for k in range(n)]


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_lines(spark, batches):
    rows = line_rows(batches, 80) + [(1000, "x" * 100_000 + "\n" + "\n".join(["one long line in one long text"] * 3000)), (1001, "one long line in one long text"), (1002, "one long line in one long text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter(tuple(r) for r in L.dedup_lines(docs, batches=batches).select("doc_id", "n_lines", "n_dropped", "text").collect())
    assert got == lines_left(rows, L.SHORTEST, L.LEAST)


def test_lines_of_odd_rows(odd, none):
    got = Counter(tuple(r) for r in L.dedup_lines(odd).collect())
    assert got == lines_left([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], L.SHORTEST, L.LEAST)
    assert L.dedup_lines(none).count() == 0


def test_batches_in_any_order_and_nothing_left_behind(spark):
    rows = [(i, t) for i, (_, t) in enumerate(line_rows(9, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = L.LineRuns(spark, buckets=3)
    for part in (2, 0, 3, 1, 4):
        runs.add(L.batch_keys(docs.where(F.col("doc_id") % 5 == part)))
    assert len(runs.runs()) == 2  # five batches: one run of four and one of one
    repeated = runs.repeated()
    assert len(runs.paths) == 1
    runs.close()
    assert not spark.catalog.listTables("default") and not runs.paths
    got = Counter(tuple(r) for r in L.drop_lines(docs, repeated, repeated.limit(2)).select("doc_id", "n_lines", "n_dropped", "text").collect())
    assert got == lines_left(rows, L.SHORTEST, L.LEAST)


def best_edits(initials, faults):
    """(cost, audit) over all edits by recursion on the rest."""
    due = ("u", "u", "a", "u")

    @cache
    def rest(i, state, inserted):
        ways = [(0, "")] if i == len(initials) and state in (0, 3) else []
        put = 2 if due[state] == "u" else 3
        if inserted < 2:
            c, a = rest(i, put, inserted + 1)
            ways.append((c + 3, "I" + a))
        if i < len(initials):
            more = 3 if faults[i] == 3 else 0
            c, a = rest(i + 1, state, 0)
            ways.append((c + 4, "D" + a))
            if faults[i] not in (1, 2):
                c, a = rest(i + 1, put, 0)
                ways.append((c + 3 + more, "R" + a))
                if initials[i] == due[state] or initials[i] == "s" and state == 0:
                    c, a = rest(i + 1, 1 if initials[i] == "s" else put, 0)
                    ways.append((c + more, "K" + a))
        return min(ways, default=(10**9, ""))

    return rest(0, 0, 0)


def test_cheapest_edits_by_chance():
    pick = random.Random(5)
    for _ in range(3000):
        n = pick.randint(0, 12)
        initials = [pick.choice("suauauat" if pick.random() < 0.8 else ["", " "]) for _ in range(n)]
        faults = [pick.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        assert C.cheapest_edits(initials, faults) == best_edits(tuple(initials), tuple(faults)), (initials, faults)


def test_long_conversations_are_linear():
    assert C.cheapest_edits(["u", "a"] * 20_000, [0] * 40_000) == (0, "K" * 40_000)
    cost, audit = C.cheapest_edits(["u"] * 3_000, [3] * 3_000)
    assert cost == 3_000 * 4 and audit == "D" * 3_000


TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "assistant", "cut of"), (1, 2, "assistant", "cut of"), (1, 5, "user", " \t\n"),
    (2, None, None, None), (2, 3, "user", None), (2, 3, "user", "Yes!"), (3, 7, "assistant", "Fine?"), (None, 1, "user", "a."), (None, 0, "tool", "b."),
    (4, 0, "", "No role."), (4, 1, "user", "x" * 300_000 + "."), (5, 0, "user", "gone"), (6, None, "user", "日本。"),
]


def test_repaired_conversations(spark):
    turns = spark.createDataFrame([(*t, "x", "y") for t in TURNS], "conv_id long, turn long, role string, text string, said string, marks string")
    got = {r.conv_id: r for r in C.repair(turns, present=F.col("text").isNull() | (F.col("text") != "gone")).collect()}
    assert set(got) == {t[0] for t in TURNS}
    for conv in got:
        own = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x in TURNS if c == conv and x != "gone"))
        faults, seen = [], set()
        for _, _, role, text in own:
            ink = text.rstrip(WHITE)
            faults.append(1 if not ink else 2 if (role, text) in seen else 3 if ink[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = tuple(role[:1] for _, _, role, _ in own)
        cost, audit = best_edits(initials, tuple(faults))
        r, numbers = got[conv], {t for known, t, _, _ in own if known}
        assert (r.cost, r.audit, r.blank, r.duplicate, r.truncated) == (cost, audit, *[faults.count(k) for k in (1, 2, 3)])
        assert r.gaps == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0)
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        want, i, previous = [], 0, None
        for letter in audit:
            if letter in "IR":
                want.append(("assistant" if previous == "u" else "user", "" if letter == "I" else own[i][3]))
            elif letter == "K":
                want.append(own[i][2:])
            previous = want[-1][0][0] if want else None
            i += letter != "I"
        assert [tuple(t) for t in r.repaired] == want
    assert (got[5].cost, got[5].audit, got[5].repaired, got[5].gaps) == (0, "", [], 0)
    assert C.repair(turns.where("1 = 0")).count() == 0


def nodes_of(convs):
    """The trie of {conv_id: [(role, text), ...]} by the definition."""
    members = defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    words = lambda p: len([w for w in "".join(" " if x in WHITE else x for x in p[-1][1]).split(" ") if w]) if p else 0
    out = Counter()
    for p, own in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(p))
        out[
            min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(kids), sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under) for q in under),
            sum((len(members[q]) - 1) * words(q) for q in under), hashlib.sha256(ends.encode()).hexdigest(),
        ] += 1
    return out


@pytest.mark.parametrize("shards", [1, 2, 5, 40])
def test_trie(spark, shards):
    pick = random.Random(shards)
    says = [("user", "hello there you"), ("assistant", "yes"), ("user", ""), (None, None), ("system", "a\tb  c d")]
    convs = {c: [pick.choice(says) for _ in range(pick.randint(0, 5))] if c % 3 else [says[0], says[1]] for c in range(-5, 150)}
    convs[150] = [says[0]] * 300
    convs[151] = [says[0]] * 300
    rows = [(c, t if t else None, *said, "x") for c, path in convs.items() for t, said in enumerate(path)]
    turns = spark.createDataFrame(rows + [(None, 0, "user", "of no one", "x")], "conv_id long, turn long, role string, text string, path string")
    given = {c: [(r or "", x or "") for r, x in p] for c, p in convs.items() if p}
    got = Counter(tuple(r) for r in T.trie(T.sequences(turns), shards).collect())
    assert got == nodes_of(given)
    assert T.trie(T.sequences(turns.where("1 = 0")), shards).count() == 0


def test_ids_of_a_crowded_node_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE_IDS", 7)
    monkeypatch.setattr(T, "ROWS_OUT", 3)
    turns = spark.createDataFrame([(c, t, "user", "same") for c in range(100) for t in range(2 + (c == 50))], "conv_id long, turn long, role string, text string")
    for shards in (1, 6):
        got = {(r.depth): r for r in T.trie(T.sequences(turns), shards).collect()}
        ids = ",".join(str(c) for c in range(100) if c != 50)
        assert got[2].ends_sha256 == hashlib.sha256(ids.encode()).hexdigest() and got[2].n_convs == 100 and got[3].conv_id == 50 and got[0].n_leaves == 1
