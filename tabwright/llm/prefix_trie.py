"""The trie of conversation prefixes, by a skeleton of splitter paths and local sorted shards.

A conversation is a path of turn digests (128 bits of role and text); a node is a distinct prefix.

1. Paths are sorted into range partitions (shards), equal paths by conv_id, so the members of a node are
   neighbours.  The split is written once, because it depends on a sample.
2. A node lies in two shards or more exactly if it is a common prefix of the last path of one shard and
   the first of the next.  The trie of these splitter prefixes is the skeleton: at most one path for each
   shard.  Every task gets it.
3. Each shard walks its sorted paths with a stack of open nodes and finishes all nodes off the skeleton.
   Children wait for their parent's smallest member, so a task holds the open path and the children of
   its nodes.  For a skeleton node a shard emits partial sums, and the ids that end there in pieces.
4. Partial sums of skeleton nodes are reduced by an aggregate and added up along the skeleton; pieces of
   ids, sorted by shard, run through one hash for each node without being held.

Turns go by turn (null first), then role and text; a null role or text is empty; repeated rows are turns
of their own.  Rows with a null conv_id belong to no conversation.  A conversation without turns ends at
the root.  Without conversations there is no node.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabwright.functions.sizing import DRIVER_ROWS, pinned, slotted

MARK = 16
WORD = r"[^\x20\x09-\x0D]+"
PIECE_IDS = 50_000
ROWS_OUT = 20_000


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, steps: digest and number of words of each turn, in order."""
    role_of, text_of = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), role_of.alias("role"), text_of.alias("text"),
            F.unhex(F.md5(F.concat(F.length(role_of).cast("string"), F.lit(":"), role_of, text_of))).alias("mark"),
            F.regexp_count(text_of, F.lit(WORD)).alias("words"),
        ).alias("said"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    return sorted_turns.select("conv_id", F.transform("said", lambda t: F.struct(t["mark"].alias("mark"), t["words"].alias("words"))).alias("steps"))


def common(a: bytes, b: bytes) -> int:
    """How many digests two paths share at their start."""
    low, high = 0, min(len(a), len(b)) // MARK
    if a[: high * MARK] == b[: high * MARK]:
        return high
    while high - low > 1:  # a[:low] agrees, a[:high] does not
        middle = (low + high) // 2
        low, high = (middle, high) if a[: middle * MARK] == b[: middle * MARK] else (low, middle)
    return low


class Skeleton:
    """The trie of the splitter prefixes; node 0 is the root."""

    def __init__(self, prefixes: list[bytes]):
        self.children: list[dict[bytes, int]] = [{}] if prefixes else []
        self.parent, self.depth = [-1] * len(self.children), [0] * len(self.children)
        for prefix in prefixes:
            node = 0
            for i in range(0, len(prefix), MARK):
                mark = prefix[i : i + MARK]
                if mark not in self.children[node]:
                    self.children[node][mark] = len(self.parent)
                    self.children.append({})
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                node = self.children[node][mark]

    def __len__(self) -> int:
        return len(self.parent)

    def child(self, node: int, mark: bytes) -> int:
        """The skeleton node below a skeleton node, or -1."""
        return self.children[node].get(mark, -1) if node >= 0 else -1


def splitters(shards: DataFrame, slot: str) -> Skeleton:
    """The skeleton of sorted shards: at most one path for each shard reaches the driver."""
    edges = shards.groupBy(slot).agg(F.min("path").alias("first"), F.max("path").alias("last")).orderBy(slot).collect()
    return Skeleton([bytes(b["first"])[: common(bytes(a["last"]), bytes(b["first"])) * MARK] for a, b in zip(edges, edges[1:])])


class Node:
    """An open node of a shard."""

    __slots__ = ("depth", "words", "skeleton", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends", "waiting")

    def __init__(self, depth: int, words: int, skeleton: int):
        self.depth, self.words, self.skeleton = depth, words, skeleton
        self.conv_id, self.n_convs, self.n_children, self.n_leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[int] = []
        self.waiting: list[tuple] = []


def ids_text(ids: list[int]) -> str:
    return ",".join(map(str, ids))


NOTHING = hashlib.sha256(b"").hexdigest()
FOUND = (
    "conv_id long, depth long, parent_conv_id long, parent int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "skeleton int, shard int, piece long, ids string"
)


class Shard:
    """Walks sorted paths; `out` collects rows of FOUND."""

    def __init__(self, number: int, skeleton: Skeleton):
        self.number, self.skeleton, self.out = number, skeleton, []
        self.open = [Node(0, 0, 0 if len(skeleton) else -1)]
        self.path, self.hash, self.pieces = b"", None, 0

    def add(self, conv_id: int, path: bytes, words: list[int]) -> None:
        shared = common(self.path, path)
        if len(self.open) - 1 > shared or len(path) != len(self.path):
            self.end_ids()
        while len(self.open) - 1 > shared:
            self.close()
        for depth in range(shared, len(path) // MARK):
            mark = path[depth * MARK : (depth + 1) * MARK]
            self.open.append(Node(depth + 1, words[depth], self.skeleton.child(self.open[-1].skeleton, mark)))
        node = self.open[-1]
        node.n_convs += 1
        node.conv_id = conv_id if node.conv_id is None else min(node.conv_id, conv_id)
        node.ends.append(conv_id)
        if len(node.ends) >= PIECE_IDS:
            self.flush_ids(node)
        self.path = path

    def flush_ids(self, node: Node) -> None:
        """Hash the ids that end at a node so far, or emit them as a piece when other shards may have more."""
        if not node.ends:
            return
        text = ids_text(node.ends)
        node.ends = []
        if node.skeleton >= 0:
            self.out.append((*[None] * 9, node.skeleton, self.number, self.pieces, text))
            self.pieces += 1
        else:
            if self.hash is None:
                self.hash = hashlib.sha256()
            else:
                text = "," + text
            self.hash.update(text.encode())

    def end_ids(self) -> None:
        """No more ids end at the last node: keep its hash instead."""
        node = self.open[-1]
        self.flush_ids(node)
        if self.hash is not None:
            node.ends = self.hash.hexdigest()
            self.hash = None

    def close(self) -> None:
        node = self.open.pop()
        above = self.open[-1] if self.open else None
        if above is not None:
            above.n_convs += node.n_convs
            above.conv_id = node.conv_id if above.conv_id is None else min(above.conv_id, node.conv_id)
        if node.skeleton >= 0:
            self.out.append((
                node.conv_id, node.depth, None, None, node.n_convs, node.n_children, node.n_leaves, node.saved, None, node.skeleton, self.number, None, str(node.words)
            ))
            return
        leaves, saved = node.n_leaves or 1, node.saved + (node.n_convs - 1) * node.words
        own = (node.n_convs, node.n_children, leaves, saved, node.ends or NOTHING, None, None, None, None)
        for child in node.waiting:
            self.out.append((*child[:2], node.conv_id, None, *child[2:]))
        if above is None:
            self.out.append((node.conv_id, node.depth, None, None, *own))
            return
        above.n_children += 1
        above.n_leaves += leaves
        above.saved += saved
        if above.skeleton >= 0:
            self.out.append((node.conv_id, node.depth, None, above.skeleton, *own))
        else:
            above.waiting.append((node.conv_id, node.depth, *own))

    def finish(self) -> None:
        self.end_ids()
        while self.open:
            self.close()


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [part.split() for part in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def walked(shards: DataFrame, slot: str, skeleton: Skeleton) -> DataFrame:
    """Rows of FOUND: nodes (skeleton is null), partial sums (conv_id and skeleton) and pieces of ids (skeleton only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            columns = [batch.column(c) for c in (slot, "conv_id", "path", "words")]
            for at in range(0, batch.num_rows, 1_000):
                for number, conv_id, path, words in zip(*[c.slice(at, 1_000).to_pylist() for c in columns]):
                    if shard is None or shard.number != number:
                        if shard is not None:
                            shard.finish()
                            yield as_batch(shard.out)
                        shard = Shard(number, skeleton)
                    shard.add(conv_id, path, words)
                    if len(shard.out) >= ROWS_OUT:
                        yield as_batch(shard.out)
                        shard.out = []
        if shard is not None:
            shard.finish()
            yield as_batch(shard.out)

    return shards.sortWithinPartitions(slot, "path", "conv_id").select(slot, "conv_id", "path", "words").mapInArrow(run, FOUND)


def hashed_ids(pieces: DataFrame) -> DataFrame:
    """skeleton, ends_sha256: pieces in order run through one hash for each skeleton node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, out = None, None, []
        for batch in batches:
            for node, ids in zip(batch.column("skeleton").to_pylist(), batch.column("ids").to_pylist()):
                if node != last:
                    if last is not None:
                        out.append((last, state.hexdigest()))
                    last, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if last is not None:
            out.append((last, state.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int32()), pa.array([h for _, h in out], pa.string())], names=["skeleton", "ends_sha256"])

    ordered = pieces.repartition("skeleton").sortWithinPartitions("skeleton", "shard", "piece")
    return ordered.select("skeleton", "ids").mapInArrow(run, "skeleton int, ends_sha256 string")


def added_up(partial: DataFrame, skeleton: Skeleton) -> list[tuple]:
    """Rows (skeleton, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens), one for each skeleton node."""
    sums = partial.groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max(F.col("ids").cast("long")).alias("words"),
    )
    rows = {r["skeleton"]: r.asDict() for r in sums.collect()}  # as many as the skeleton has nodes
    for node in range(len(skeleton) - 1, -1, -1):  # children have larger numbers than their parents
        row = rows[node]
        row["n_children"] += len(skeleton.children[node])
        row["n_leaves"] = row["n_leaves"] if row["n_children"] else 1
        row["saved_tokens"] += (row["n_convs"] - 1) * row["words"]
        if node:
            above = rows[skeleton.parent[node]]
            above["n_leaves"] += row["n_leaves"]
            above["saved_tokens"] += row["saved_tokens"]
    return [
        (k, r["conv_id"], skeleton.depth[k], rows[skeleton.parent[k]]["conv_id"] if k else None, *[r[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
        for k, r in sorted(rows.items())
    ]


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row for each distinct prefix; paths: conv_id long, steps array<struct<mark, words>>.

    conv_id is the smallest member's, ends_sha256 the hash of the ids of the conversations that end there.
    """
    spark = paths.sparkSession
    flat = paths.select(
        "conv_id", F.unhex(F.array_join(F.transform("steps", lambda s: F.hex(s["mark"])), "")).alias("path"),
        F.transform("steps", lambda s: s["words"]).alias("words"),
    )
    ranged = slotted(flat, ["path", "conv_id"], "shard", shards)
    skeleton = splitters(ranged, "shard")
    found = walked(ranged, "shard", skeleton)
    if not len(skeleton):
        return found.select(*NODE)
    found = pinned(found)
    sums = added_up(found.where("skeleton IS NOT NULL AND conv_id IS NOT NULL"), skeleton)
    schema = "skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    upper = spark.createDataFrame(sums, schema)
    small = F.broadcast if len(skeleton) <= DRIVER_ROWS else lambda df: df
    ends = hashed_ids(found.where("skeleton IS NOT NULL AND conv_id IS NULL"))
    top = upper.join(ends, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    parents = upper.select(F.col("skeleton").alias("parent"), F.col("conv_id").alias("upper_conv_id"))
    lower = found.where("skeleton IS NULL").join(small(parents), "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "upper_conv_id"))
    return lower.select(*NODE).unionByName(top.select(*NODE))
