"""Records of a CSV whose quoted cells hold line breaks, from files read in many splits.

Whether a line begins inside quotes depends on all lines before it, yet each line alone fixes a map from "inside
or not" before it to "inside or not" after it.  Such maps compose: a line either decides the state whatever came
before, keeps it, or swaps it.  So the state before a line is what the last deciding line left, swapped once for
each swapping line since.  Lines are folded inside their split as it is read, splits inside their file (one row for
a split), and only lines of records that hold a break are brought together by a shuffle.

A quote opens a cell only at the start of the cell; within one, two quotes are one and a single one closes it.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import col
from ..functions.sizing import pinned

# One closed quoted run: at the start of a cell, or right behind such a run, where two quotes meet.
CLOSED_RUN = r'(?:^|(?<=,)|\G)"[^"]*+"'
BREAK = "\n"
TASKS_PER_PARTITION = 4


def left_open(line: Column) -> Column:
    """Whether a line that begins outside quotes ends inside."""
    return F.regexp_replace(line, CLOSED_RUN, "").rlike('(?:^|,)"')


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, seq): lines with their file, the start of their split and their place in it."""
    where = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "block"))]
    return spark.read.option("lineSep", BREAK).text(path).select("value", *where, F.monotonically_increasing_id().alias("seq"))


def holds_breaks(lines: DataFrame) -> bool:
    """Whether any cell runs over a line; if none does, every line is a record."""
    return not lines.where(left_open(F.col("value"))).isEmpty()


def _state(df: DataFrame, keys: list[str], order: list[str], outside: str, inside: str) -> DataFrame:
    """Adds `from_outside` and `from_inside`: whether a row begins inside quotes if its group begins so or so."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    swap = F.col("__swap")
    df = df.withColumn("__swap", (col(outside) & ~col(inside)).cast("int"))
    df = df.withColumn("__swaps", F.coalesce(F.sum(swap).over(before), F.lit(0)))
    left = F.when(col(outside) == col(inside), (col(outside).cast("int") + F.col("__swaps")) % 2)
    df = df.withColumn("__left", left).withColumn("__last", F.last("__left", ignorenulls=True).over(before))
    at = lambda begin: ((F.coalesce("__last", F.lit(begin)) + F.col("__swaps")) % 2) == 1
    return df.withColumns({"from_outside": at(0), "from_inside": at(1)}).drop("__swap", "__swaps", "__left", "__last")


def begun_states(lines: DataFrame) -> DataFrame:
    """`lines` with opens, stays and, for a split begun outside and inside quotes, whether a line begins inside
    (`from_outside`, `from_inside`) and the last line that did not (`head_outside`, `head_inside`).

    The lines of a split come in order and stay in their task; what a batch leaves is carried into the next.
    Very many splits share tasks, which read them one after the other.
    """
    tasks = TASKS_PER_PARTITION * max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines.sparkSession.sparkContext.defaultParallelism)
    quoted = F.col("value").contains('"')
    mapped = lines.withColumns({
        "opens": quoted & left_open(F.col("value")),
        "stays": ~quoted | left_open(F.concat(F.lit('"'), F.col("value"))),
    })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state, head = None, [0, 1], [-1, -1]
        for whole in batches:
            files, starts = (pc.dictionary_encode(whole.column(c)).indices.to_numpy() for c in ("file", "block"))
            edges = [0, *(np.flatnonzero((np.diff(files) != 0) | (np.diff(starts) != 0)) + 1).tolist(), whole.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part = whole.slice(a, b - a)
                if split != (split := (part.column("file")[0].as_py(), part.column("block")[0].as_py())):
                    state, head = [0, 1], [-1, -1]
                opens, stays = (part.column(c).to_numpy(zero_copy_only=False) for c in ("opens", "stays"))
                seq = part.column("seq").to_numpy()
                swaps = np.cumsum(opens & ~stays) % 2
                last = np.maximum.accumulate(np.where(opens == stays, np.arange(b - a), -1))
                found = []
                for i in range(2):
                    after = np.where(last < 0, state[i] ^ swaps, opens[last] ^ swaps ^ swaps[last])
                    inside = np.concatenate([[state[i]], after[:-1]]).astype(bool)
                    heads = np.maximum(np.maximum.accumulate(np.where(inside, -1, seq)), head[i])
                    state[i], head[i] = int(after[-1]), int(heads[-1])
                    found.append((inside, heads))
                more = [pa.array(found[0][0]), pa.array(found[1][0]), *[pa.array(h, pa.int64(), mask=h < 0) for _, h in found]]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*whole.schema.names, "from_outside", "from_inside", "head_outside", "head_inside"])

    schema = "value string, file string, block long, seq long, opens boolean, stays boolean, from_outside boolean, from_inside boolean, head_outside long, head_inside long"
    return mapped.select("value", "file", "block", "seq", "opens", "stays").coalesce(tasks).mapInArrow(run, schema)


def csv_records(lines: DataFrame) -> DataFrame:
    """(file, place, record): whole records, `place` ordering them inside their file; blank ones are left out.

    A carriage return before a record's last break goes; one inside quotes stays.  A cell still open at the end
    of its file takes the rest of it.  The lines are written once, so that all steps see the same splits.
    """
    placed = begun_states(lines)
    head = lambda c: F.when(F.col(c).isNotNull(), F.struct("block", F.col(c).alias("seq"))).alias(c)
    placed = pinned(placed.select("value", "file", "block", "seq", "opens", "stays", "from_outside", "from_inside", head("head_outside"), head("head_inside")))

    final = lambda state: F.max_by(F.when(F.col(state), F.col("stays")).otherwise(F.col("opens")), "seq")
    splits = placed.groupBy("file", "block").agg(
        final("from_outside").alias("after_outside"), final("from_inside").alias("after_inside"),
        F.max_by("head_outside", "seq").alias("last_outside"), F.max_by("head_inside", "seq").alias("last_inside"),
    )
    states = _state(splits, ["file"], ["block"], "after_outside", "after_inside").withColumn("begun", F.col("from_outside"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.col("begun"), F.col("last_inside")).otherwise(F.col("last_outside"))
    states = states.withColumn("last", last).select(
        col("file").alias("f"), col("block").alias("b"), "begun", F.last("last", ignorenulls=True).over(earlier).alias("carried")
    )
    known = placed.join(F.broadcast(states), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))  # one row per split
    by = lambda inside, outside: F.when(F.col("begun"), F.col(inside)).otherwise(F.col(outside))
    known = known.select(
        "file", "value", "opens", F.struct("block", "seq").alias("at"), by("from_inside", "from_outside").alias("continues"),
        F.coalesce(by("head_inside", "head_outside"), F.col("carried")).alias("place"),
    )
    whole = ~F.col("continues") & ~F.col("opens")
    single = known.where(whole).select("file", "place", F.col("value").alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("at", "value")))
    joined = known.where(~whole).groupBy("file", "place").agg(F.array_join(F.transform(parts, lambda p: p["value"]), BREAK).alias("record"))
    records = single.unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    return records.where(F.trim("record") != "")


def header_names(header: str) -> list[str]:
    """Column names of a header record: empty ones by position, repeated ones with it, as the CSV reader names them."""
    cells = next(csv.reader([header.removeprefix("﻿")], strict=False))
    folded = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if folded.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def read_broken(lines: DataFrame, options: dict[str, str]) -> DataFrame:
    """The table of a headered CSV with line breaks in cells, all columns text; names are those of the first file."""
    records = pinned(csv_records(lines))  # read for the header, the types and the rows
    heads = F.broadcast(records.groupBy("file").agg(F.min("place").alias("first")))  # one row per file
    first = records.join(heads, "file").where(F.col("place") == F.col("first")).orderBy("file").select("record").first()
    names = header_names(first["record"])
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = records.join(heads, "file").where(F.col("place") != F.col("first"))
    parsed = rows.select(F.from_csv("record", schema, options).alias("cells"))
    return parsed.select(*[F.col(f"cells.c{i}").alias(n) for i, n in enumerate(names)])
