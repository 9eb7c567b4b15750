"""Mutual information of numbers and a class from nearest neighbours, without bins.

For a row, let r be the distance to its k-th nearest row of the same class.  With c rows of its class and m
rows of any class nearer than r, itself included, and N_y rows in its class of N,

    MI = psi(N) + mean(psi(c) - psi(N_y) - psi(m)),   psi the digamma function.

Without ties c is k.  Rows nearer than a distance of 0 are the ties themselves, so a column of few values gets
its plug-in estimate.  Distances are one-dimensional, so nobody compares pairs: rows are sorted once by class
and value for the distances, and once by value, with the ends of the intervals among them, for the counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col, kinds
from ..functions.sizing import numbered, slotted
from .importance import _codes_per_column, stable_clean
from .roles import Target

NEIGHBOURS = 3
BLOCK_ROWS = 50_000
INSIDE = 1e-12  # "nearer" by more than this share of |value| + r, so that rounding decides nothing


def digamma(m: Column) -> Column:
    """psi of a positive whole number: ten steps of the recurrence, then the asymptotic series."""
    x = m.cast("double") + 10.0
    square = x * x
    series = F.log(x) - 0.5 / x - (1 / 12 - (1 / 120 - 1 / (252 * square)) / square) / square
    return series - reduce(lambda a, b: a + b, [1.0 / (x - i) for i in range(1, 11)])


def class_points(clean: DataFrame, target: str) -> DataFrame:
    """(column_name, y, x, n): rows of a class that share a value; text by the position of its value.

    Booleans are numbers after cleaning; NaN is no point.
    """
    folded = kinds(clean)
    features = [c for c in clean.columns if c != target]
    tables = []
    for text in (False, True):
        names = [c for c in features if (folded[c] not in ("int", "float")) == text]
        if not names:
            continue
        cells = [x for c in names for x in (F.lit(c), col(c).cast("string" if text else "double"))]
        long = clean.select(col(target).cast("string").alias("y"), F.stack(F.lit(len(names)), *cells).alias("column_name", "value"))
        points = long.where(F.col("value").isNotNull()).groupBy("column_name", "y", "value").agg(F.count("*").alias("n"))
        if text:
            codes = _codes_per_column(points.select("column_name", "value").distinct())
            points = points.join(codes, ["column_name", "value"]).withColumn("value", F.col("code").cast("double"))
        else:
            points = points.where(~F.isnan("value")).withColumn("value", F.col("value") + 0.0)  # -0.0 is 0.0
        tables.append(points.select("column_name", "y", F.col("value").alias("x"), "n"))
    return reduce(DataFrame.unionByName, tables)


def neighbourhoods(points: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK_ROWS) -> DataFrame:
    """(column_name, at, n, class_rows, c, low, high) for each point of a class of two rows or more.

    Points sorted by class and value are cut into blocks of equal row count; a block gets the k points before
    and after it too, so the k-th neighbour of every point is inside its block, whatever the size of its class.
    """
    if block < k:
        raise ValueError(f"a block of {block} points cannot hold {k} neighbours")
    sizes = points.groupBy("column_name", "y").agg(F.sum("n").alias("class_rows"))
    placed = numbered(points, ["column_name", "y", "x"], "at")
    home, inside = F.floor(F.col("at") / block), F.col("at") % block
    copies = F.array_compact(F.array(
        home, F.when((inside < k) & (home > 0), home - 1), F.when(inside >= block - k, home + 1)
    ))
    rows = placed.withColumn("block", F.explode(copies)).withColumn("here", F.struct("column_name", "y", "x", "n"))
    order = Window.partitionBy("block").orderBy("at")
    around = F.array(*[f("here", j).over(order) for j in range(1, k + 1) for f in (F.lag, F.lead)])
    near = rows.withColumn("near", around).where(home == F.col("block"))
    same = F.filter("near", lambda s: (s["column_name"] == F.col("column_name")) & (s["y"] == F.col("y")))
    by_distance = F.sort_array(F.transform(same, lambda s: F.struct(F.abs(s["x"] - F.col("x")).alias("d"), s["n"].alias("n"), s["x"].alias("x"))))
    # The classes of a column are few and a broadcast of them is left to the optimiser, which knows their size.
    near = near.select("column_name", "y", "x", "n", "at", by_distance.alias("near")).join(sizes, ["column_name", "y"]).where("class_rows > 1")
    wanted = F.least(F.lit(k).cast("bigint"), F.col("class_rows") - 1)
    start = F.struct((F.col("n") - 1).alias("seen"), F.when(F.col("n") > wanted, 0.0).alias("r"))
    walked = F.aggregate("near", start, lambda a, s: F.struct(
        (a["seen"] + s["n"]).alias("seen"), F.when(a["r"].isNull() & (a["seen"] + s["n"] >= wanted), s["d"]).otherwise(a["r"]).alias("r")
    ))
    near = near.withColumn("r", walked["r"])
    slack = F.lit(INSIDE) * (F.abs("x") + F.col("r"))
    near = near.withColumn("low", F.least(F.col("x"), F.col("x") - F.col("r") + slack)).withColumn(
        "high", F.greatest(F.col("x"), F.col("x") + F.col("r") - slack)
    )
    inner = F.filter("near", lambda s: s["x"].between(F.col("low"), F.col("high")))
    c = F.aggregate(inner, F.col("n"), lambda a, s: a + s["n"])
    return near.select("column_name", "at", "x", "n", "class_rows", c.alias("c"), "low", "high")


def rows_inside(hoods: DataFrame) -> DataFrame:
    """Adds m: how many rows of the column, by n, lie in [low, high].

    Points and the two ends of every interval are put into one order; the sum of n up to an end is the sum
    inside its range plus that of all ranges before.
    """
    ends = F.array(
        F.struct(F.col("low").alias("v"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("add")),
        F.struct(F.col("x").alias("v"), F.lit(1).alias("kind"), F.col("n").alias("add")),
        F.struct(F.col("high").alias("v"), F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("add")),
    )
    events = hoods.select("column_name", "at", "n", "class_rows", "c", F.inline(ends))
    ranged = slotted(events, ["column_name", "v", "kind"])
    before = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__slot").agg(F.sum("add").alias("s")).select("__slot", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    upto = Window.partitionBy("__slot").orderBy("column_name", "v", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("sum", F.sum("add").over(upto)).where("kind <> 1").join(F.broadcast(starts), "__slot")  # one row per range
    return summed.groupBy("column_name", "at", "n", "class_rows", "c").agg(
        F.sum((F.col("kind") - 1) * (F.col("start") + F.col("sum"))).alias("m")
    )


def neighbour_mutual_info(df: DataFrame, target: Target, k: int = NEIGHBOURS, block: int = BLOCK_ROWS) -> DataFrame:
    """(column_name, mi) in nats between each feature and the class, by k nearest neighbours, at least 0.

    Rows whose class has no other row are left out; a column without any other row scores 0.  The score
    does not depend on `block`, which bounds the rows a task sorts.
    """
    points = class_points(stable_clean(df, target.name), target.name)
    counted = rows_inside(neighbourhoods(points, k, block))
    weight = F.col("n").cast("double")
    gain = digamma(F.col("c")) - digamma(F.col("class_rows")) - digamma(F.col("m"))
    score = digamma(F.sum("n")) + F.sum(weight * gain) / F.sum(weight)
    scores = counted.groupBy("column_name").agg(score.alias("mi"))
    every = points.select("column_name").distinct()  # one row per column
    return every.join(scores, "column_name", "left").select("column_name", F.greatest(F.coalesce("mi", F.lit(0.0)), F.lit(0.0)).alias("mi"))
