"""Near-duplicate classes: one-permutation MinHash, densified, banded, with star-shaped candidate edges.

1. Each text becomes its set of hashed word shingles.  Equal sets are one node from here on, so copies
   never meet each other.
2. A node's signature takes one permutation: the hash range is cut into bins and each bin keeps its
   smallest hash; an empty bin borrows from a bin that a hash of (bin, attempt) picks, until that one is
   filled (optimal densification).  Bands of the signature are buckets.
3. A bucket of n nodes gives n - 1 candidate edges, all from one centre: the node whose buckets are the
   most crowded, which in a group of edited copies is the original.
4. Candidates are confirmed on the full sets.
5. A bucket is open while two of its components have nodes that were no centre: only such pairs have not
   been compared.  Open buckets get further centres, 4, then 16, 64 and so on, those of the smallest
   components first; only nodes of other components are compared with them.
6. When a round would compare several pairs for each node, as inside one large group, or links few of its
   pairs, as among texts on one template, the nodes of all open buckets are joined once by an exact
   prefix filter: with shingles in one order, the rare ones first, two sets that
   reach the threshold have their first common shingle within the first few of both, and no further from
   their starts than the threshold allows.  Pairs that meet so are confirmed; all others are excluded by
   that bound or by their sizes.  No bucket is capped and no pair of an open bucket is left out.
7. Components come from alternating stars.

Sets too small to reach the threshold with any different set need no bands.  Texts without words have an
empty set and are linked with nothing; fewer words than a shingle give one shingle, the whole sequence.
A null doc_id takes part and counts as larger than any other; a component without any has a null id.  Of
each component the row with its smallest doc_id stays, exactly one even among repeated rows.  Columns
other than doc_id and text are not read.  Rows are numbered in a stored table and found again by doc_id
and digest of the text, so no result depends on how two scans of the input are split.  What the rounds
write is deleted as soon as it has been read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.functions.sizing import lookup

from .components import components
from .scratch import Scratch, whole_row
from .words import WordHashes, grams, hashed, mixed, slices

SHINGLE = 5
BANDS, ROWS = 32, 6
PROBES = 256
BROADCAST_NODES = 1_000_000
GROWTH = 4
#: A round is worth another one while at least one of so many compared pairs is a link.
WORTH = 10
#: And while it compares at most so many pairs for each node: each pair reads both texts.
PAIRS_A_NODE = 4
LARGEST = 2**63 - 1
SLOTS = 1 << 18


class OnePermutation:
    """Band values of a sorted array of distinct 64-bit hashes."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.probes = np.stack([self.probe(i) for i in range(PROBES)])
        self.salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def probe(self, attempt: int) -> np.ndarray:
        """The bin that each empty bin asks at an attempt: the same for all texts."""
        at = np.arange(self.bins, dtype=np.uint64) + np.uint64(attempt) * np.uint64(1 << 20)
        return ((mixed(mixed(at)) >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        bins = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        out, filled = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        out[bins[first]] = hashes[first]
        filled[bins[first]] = True
        empty, attempt = np.flatnonzero(~filled), 0
        while len(empty):
            asked = (self.probes[attempt] if attempt < PROBES else self.probe(attempt))[empty]
            got = filled[asked]
            out[empty[got]] = out[asked[got]]
            empty, attempt = empty[~got], attempt + 1
        return out

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        values = self.signature(hashes).reshape(self.bands, self.rows)
        total = self.salt.copy()
        for i in range(self.rows):
            total = mixed(total + values[:, i])
        return total.view(np.int64)


def shingle_sets(texts: list[str | None], cache: WordHashes, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, starts = hashed(texts, cache)
    all_grams = grams(words, shingle)
    out = []
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if e - s >= shingle:
            out.append(np.unique(all_grams[s : e - shingle + 1]))
        else:
            out.append(grams(words[s:e], e - s) if e > s else np.zeros(0, np.uint64))
    return out


def marked(body: Column) -> Column:
    """Digest of a whole text; a null text is told from an empty one by neither, both have no words."""
    return F.unhex(F.md5(F.coalesce(body, F.lit(""))))


def signatures(docs: DataFrame, percent: int, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, row, mark, set_key, n_shingles, bands for every row; to be stored before `row` is used."""
    least = percent / (100 - percent) if percent < 100 else float("inf")
    source = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), marked(F.col("body")).alias("mark"), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sign = WordHashes(), OnePermutation(bands, rows)
        for b in slices(batches, "body"):
            sets = shingle_sets(b.column("body").to_pylist(), cache, shingle)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            marks = [sign(s) if len(s) >= least else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("doc_id", "row", "mark")], pa.array(keys, pa.binary()), pa.array(list(map(len, sets)), pa.int64()), pa.array(marks, pa.list_(pa.int64()))],
                names=["doc_id", "row", "mark", "set_key", "n_shingles", "bands"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, row long, mark binary, set_key binary, n_shingles long, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; texts: node, body."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b").join(
        texts.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a"
    ).select("a", "b", "body_a", "body_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last, centre = WordHashes(), None, None
        for batch in slices(batches, "body_b"):
            sets = shingle_sets(batch.column("body_b").to_pylist(), cache, shingle)
            a, keep = batch.column("a").to_pylist(), np.zeros(batch.num_rows, bool)
            for i, (node, found) in enumerate(zip(a, sets)):
                if node != last:
                    last, centre = node, shingle_sets([batch.column("body_a")[i].as_py()], cache, shingle)[0]
                common = len(np.intersect1d(centre, found, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(centre) + len(found) - common) and common > 0
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def first_in_bucket(seats: DataFrame, several: int, order: Column) -> DataFrame:
    """The first `several` nodes of each bucket; tasks send no more than that of any bucket."""
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(order, F.xxhash64("node", "bucket")))
    return seats.withColumn("place", place).where(F.col("place") <= several).drop("place")


def crowding(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles of the sets fall into each slot of the hash range; it only orders shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts = WordHashes(), np.zeros(SLOTS, np.int64)
        for b in slices(batches, "body"):
            for s in shingle_sets(b.column("body").to_pylist(), cache, shingle):
                np.add.at(counts, (s % np.uint64(SLOTS)).astype(np.int64), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["slot", "n"])

    table = texts.select("body").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[table["slot"].to_numpy()] = table["n"].to_numpy()
    return counts


def prefixes(texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """node, component, shingles, token, at, short: the first shingles of each set, the rare ones first.

    Any set of the threshold has a common shingle among them, and among the `short` ones of the smaller set.
    """
    counts = crowding(texts, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in slices(batches, "body"):
            sets = shingle_sets(b.column("body").to_pylist(), cache, shingle)
            sizes = np.array([len(s) for s in sets], np.int64)
            reach = sizes - -(-percent * sizes // 100) + 1  # common >= percent of the larger set
            close = sizes - -(-2 * percent * sizes // (100 + percent)) + 1  # and more than that of the smaller one
            first = [s[np.lexsort((s, counts[(s % np.uint64(SLOTS)).astype(np.int64)]))[:n]] for s, n in zip(sets, reach.tolist())]
            taken = np.array([len(s) for s in first], np.int64)
            at = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
            row = pa.array(np.repeat(np.arange(len(sets)), taken))
            yield pa.RecordBatch.from_arrays(
                [b.column("node").take(row), b.column("component").take(row), pa.array(np.repeat(sizes, taken)), pa.array(np.concatenate(first).view(np.int64)),
                 pa.array(at), pa.array(at < np.repeat(close, taken))],
                names=["node", "component", "shingles", "token", "at", "short"],
            )

    return texts.select("node", "component", "body").mapInArrow(run, "node long, component long, shingles long, token long, at long, short boolean")


def remaining_pairs(nodes: DataFrame, texts: DataFrame, percent: int, shingle: int, scratch: Scratch) -> DataFrame:
    """(b, a): all pairs of nodes of different components that may reach the threshold; nodes: node, component."""
    rows = scratch.keep("prefixes", prefixes(texts.join(nodes, "node"), percent, shingle))
    # Of each token the largest component meets only the others, never itself.
    crowd = rows.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token").agg(
        F.max_by("component", "n").alias("main"), F.count("*").alias("kinds")
    ).where("kinds > 1")
    rows = scratch.keep("prefixes", rows.join(crowd, "token").select(*rows.columns, (F.col("component") != F.col("main")).alias("apart")))
    large = rows.select("token", *[F.col(c).alias(f"l_{c}") for c in ("node", "component", "shingles", "at", "apart")])
    least = F.least(F.col("shingles") - F.col("at"), F.col("l_shingles") - F.col("l_at"))
    fit = (
        (F.col("component") != F.col("l_component")) & (F.struct("shingles", "node") < F.struct("l_shingles", "l_node"))
        & (100 * F.col("shingles") >= percent * F.col("l_shingles")) & ((100 + percent) * least >= percent * (F.col("shingles") + F.col("l_shingles")))
    )
    met = rows.where("short AND apart").join(large, "token").where(fit).unionByName(
        rows.where("short AND NOT apart").join(large.where("l_apart"), "token").where(fit)
    )
    return met.select(F.greatest("node", "l_node").alias("b"), F.least("node", "l_node").alias("a")).distinct()


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and body of the wanted nodes (node, mark), each once however many rows have that text."""
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)  # else the texts are shuffled, once
    found = docs.select(marked(F.col("body")).alias("mark"), "body").join(wanted, "mark")
    return found.groupBy("node").agg(F.first("body").alias("body"))


def near_groups(
    docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, row, mark, n_shingles, component_id, kept for every row of `docs`; linked: 100 * common >= percent * union.

    `row` numbers the rows and `mark` is the digest of the text.  The result is a stored table.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    scratch = Scratch(docs.sparkSession)
    keep = scratch.keep
    signed = keep("signed", signatures(docs, percent, shingle, bands, rows))
    nodes = keep("nodes", signed.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("row").alias("node"), F.min("mark").alias("mark"), F.first("n_shingles").alias("shingles"), F.min("doc_id").alias("first_doc"),
        F.first("bands").alias("bands"), F.min_by("row", F.coalesce(F.col("doc_id").cast("long"), F.lit(LARGEST))).alias("keep_row"), F.count("*").alias("copies"),
    ))
    seats = nodes.where("bands IS NOT NULL").select("node", "shingles", F.explode("bands").alias("bucket"))
    crowds = seats.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    seats = keep("seats", seats.join(crowds, "bucket"))
    weights = keep("weights", seats.groupBy("node").agg(F.sum("n").alias("weight")))
    texts = keep("texts", texts_of(docs, nodes.join(weights, "node", "left_semi").select("node", "mark")))
    seats = keep("seats", seats.drop("n").join(weights, "node").withColumn("component", F.col("node")))
    scratch.drop("weights")

    tried = links = groups = None

    def linked(found: DataFrame) -> None:
        nonlocal links, groups
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            groups = components(links, scratch=scratch)

    for turn in count():
        several = GROWTH**turn
        if turn == 0:
            centres = first_in_bucket(seats, several, F.desc("weight"))
        else:
            sizes = seats.select("node", "component").distinct().groupBy("component").agg(F.count("*").alias("size"), F.count("*").alias("weight_"))
            centres = first_in_bucket(lookup(seats, sizes, "component", weight="weight_"), several, F.asc("size"))
        centres = keep("centres", centres.select(
            "bucket", F.col("node").alias("centre"), F.col("shingles").alias("c_shingles"), F.col("component").alias("c_component")
        ))
        # No pair of sets whose sizes differ by more than the threshold can reach it.
        sizes_fit = 100 * F.least("shingles", "c_shingles") >= percent * F.greatest("shingles", "c_shingles")
        pairs = seats.join(centres, "bucket").where("component != c_component").where(sizes_fit).select(
            F.greatest("node", "centre").alias("b"), F.least("node", "centre").alias("a")
        ).distinct()
        pairs = keep(f"pairs-{turn}", pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        few = turn == 0 or pairs.count() <= PAIRS_A_NODE * seats.select("node").distinct().count()
        if few:
            tried = pairs if tried is None else tried.unionByName(pairs)
            found = keep(f"found-{turn}", confirmed(pairs, texts, percent, shingle))
            linked(found)
            if groups is not None:
                seats = seats.drop("component").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
            # Pairs with a centre have been compared; a bucket stays open for the others.
            rest = seats.join(centres.select("bucket", F.col("centre").alias("node")), ["bucket", "node"], "left_anti")
            open_buckets = rest.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
            seats = keep("seats", rest.join(open_buckets, "bucket"))
            if seats.isEmpty():
                break
        if not few or turn and WORTH * found.count() <= pairs.count():
            unmet = keep("unmet", seats.select("node", "component").distinct())
            left = remaining_pairs(unmet, texts, percent, shingle, scratch)
            left = keep("left", left if tried is None else left.join(tried, ["a", "b"], "left_anti"))
            linked(keep("found-left", confirmed(left, texts, percent, shingle)))
            break

    scratch.drop("texts", "seats", "centres", "unmet", "prefixes", "left", *[n for n in scratch.paths if n.startswith("pairs-")])
    placed = nodes.select("set_key", "node", "first_doc", "keep_row", "copies")
    if links is None:
        placed = placed.select("set_key", F.col("first_doc").alias("component_id"), "keep_row", "copies")
    else:
        placed = placed.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        heads = placed.groupBy("component").agg(
            F.min("first_doc").alias("component_id"), F.min_by("keep_row", F.coalesce(F.col("first_doc").cast("long"), F.lit(LARGEST))).alias("keep_row"),
            F.count("*").alias("nodes"),
        )
        placed = lookup(placed.drop("keep_row"), heads, "component", weight="nodes").select("set_key", "component_id", "keep_row", "copies")
    member = lookup(signed.select("doc_id", "row", "mark", "set_key", "n_shingles"), placed, "set_key", weight="copies")
    alone = F.col("n_shingles") == 0
    result = keep("result", member.select(
        "doc_id", "row", "mark", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
    ))
    scratch.drop(*[name for name in scratch.paths if name != "result"])
    return result


def drop_near_copies(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns."""
    known = ["rank", "mark"]
    rank = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(LARGEST))
    groups = near_groups(docs, percent, doc_id, text).select(rank("doc_id").alias("rank"), "mark", "kept")
    # Rows that agree in doc_id and text may be kept and dropped: of those as many stay as are kept, one or none.
    both = groups.groupBy(*known).agg(F.max(F.col("kept").cast("int")).alias("stays"), F.min(F.col("kept").cast("int")).alias("all_stay"))
    both = both.where("all_stay = 0")
    whole = docs.select(rank(doc_id).alias("rank"), marked(F.col(text)).alias("mark"), whole_row(docs).alias("doc"))
    rest = whole.join(both.select(*known), known, "left_anti")
    twins = both.where("stays = 1").select(*known)
    if not twins.isEmpty():
        rest = rest.unionByName(whole.join(twins, known, "left_semi").dropDuplicates(known))
    return rest.select("doc.*")
