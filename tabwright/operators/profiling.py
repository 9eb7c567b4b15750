"""Column profiles: every statistic of every column in one aggregate."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.digests import distinct_rows, repeats, with_repeats
from ..functions.columns import col, count_where, kinds, numeric_columns, text_columns
from .frequencies import CELL, cell, cells, distinct_and_missing, short_cells, value_frequencies, value_text
from .quantiles import exact_quantiles


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    stats: Mapping[str, Callable[[str], Column]],
    fixed: Mapping[str, Callable[[str], object]] | None = None,
) -> DataFrame:
    """One aggregate for all columns and statistics, returned one row per column."""
    aggregates = [fn(c).alias(f"{i}:{name}") for i, c in enumerate(columns) for name, fn in stats.items()]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            *[F.col(f"`{i}:{name}`").alias(name) for name in stats],
            *[(v if isinstance(v := fn(c), Column) else F.lit(v)).alias(name) for name, fn in (fixed or {}).items()],
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def missing(c: str) -> Column:
    return count_where(col(c).isNull())


def profile_table(df: DataFrame) -> DataFrame:
    """(column_name, dtype, n_rows, non_null, missing_pct)."""
    folded = kinds(df)
    return per_column(
        df,
        df.columns,
        {
            "n_rows": lambda c: F.count(F.lit(1)),
            "non_null": lambda c: F.count(col(c)),
            "missing_pct": lambda c: missing(c) * 100.0 / F.count(F.lit(1)),
        },
        {"dtype": lambda c: folded[c]},
    )


def ingest_stats(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, missing_cells, column_types."""
    total = F.count(F.lit(1)) * 0
    for c in df.columns:
        total = total + missing(c)
    types = ",".join(f"{c}:{k}" for c, k in kinds(df).items())
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total.alias("missing_cells")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "missing_cells",
        F.lit(types).alias("column_types"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, missing) for columns that miss at least one value."""
    return per_column(df, df.columns, {"missing": missing}).where(F.col("missing") > 0)


def smallest_values(df: DataFrame, n: int) -> DataFrame:
    """(column_name, rn, l, d, s): the n smallest values of each column, numbered from 1.

    One aggregate for each of them: the least value above the last one.  Only n rows of values reach the driver.
    """
    fields = df.schema.fields
    plain = df.select(*[c.alias(f"{k}{i}") for i, f in enumerate(fields) for k, c in zip(CELL, cell(f))])
    found, last = [], {}
    for rn in range(1, n + 1):
        wanted = [x for x in plain.columns if rn == 1 or last[x] is not None]
        if not wanted:
            break
        above = {x: F.col(x) if rn == 1 else F.when(F.col(x) > F.lit(last[x]), F.col(x)) for x in wanted}
        row = plain.agg(*[F.min(c).alias(x) for x, c in above.items()]).first()
        last = {x: row[x] if x in wanted else None for x in plain.columns}
        values = [[last[f"{k}{i}"] for k in CELL] for i in range(len(fields))]
        found += [(f.name, rn, *v) for f, v in zip(fields, values) if v != [None] * len(CELL)]
    return df.sparkSession.createDataFrame(found, "column_name string, rn int, l bigint, d double, s string")


def column_statistics(df: DataFrame, samples: int = 3) -> DataFrame:
    """(column_name, dtype, n_unique, n_missing, missing_pct, samples).

    Samples are the smallest values, so the answer does not depend on row
    order.  Values are counted by `short_cells`, so long texts are not
    shuffled, and samples come from `smallest_values`, which shuffles nothing.
    """
    folded = kinds(df)
    shape = distinct_and_missing(short_cells(cells(df)).groupBy("column_name", *CELL).agg(F.count("*").alias("n")))
    first = smallest_values(df, samples)
    texts = F.array_sort(F.collect_list(F.struct("rn", value_text(df).alias("t"))))
    few = first.groupBy(F.col("column_name").alias("c")).agg(F.array_join(F.transform(texts, lambda x: x["t"]), "|").alias("samples"))
    types = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(folded[c]))])
    return shape.join(F.broadcast(few), F.col("column_name") == F.col("c"), "left").select(  # one row per column
        "column_name",
        types[F.col("column_name")].alias("dtype"),
        "n_unique",
        "n_missing",
        F.round(F.col("n_missing") * 100.0 / F.col("n_rows"), 1).alias("missing_pct"),
        F.coalesce("samples", F.lit("")).alias("samples"),
    )


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, count, mean, std, min, q25, median, q75, max) with exact quartiles."""
    columns = list(columns or numeric_columns(df))
    q = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    at = lambda k: (lambda c: F.lit(q[c][k]).cast("double"))
    return per_column(
        df,
        columns,
        {
            "count": lambda c: F.count(col(c)),
            "mean": lambda c: F.avg(col(c)),
            "std": lambda c: F.stddev_samp(col(c)),
            "min": lambda c: F.min(col(c)).cast("double"),
            "max": lambda c: F.max(col(c)).cast("double"),
        },
        {"q25": at(0), "median": at(1), "q75": at(2)},
    )


def quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, q25, median, q75), exact."""
    q = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    rows = [(c, *q[c]) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column_name string, q25 double, median double, q75 double")


def cardinality_categorical(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column_name, n_unique) of each text column."""
    names = text_columns(df)
    if approximate:
        return per_column(df, names, {"n_unique": lambda c: F.approx_count_distinct(col(c), 0.01)})
    return distinct_and_missing(value_frequencies(df, names)).select("column_name", "n_unique")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(n_rows, distinct_rows, duplicate_rows); NULLs count as equal."""
    known = repeats(df)
    unique = distinct_rows(df, known)
    return df.sparkSession.createDataFrame([(known.rows, unique, known.rows - unique)], "n_rows bigint, distinct_rows bigint, duplicate_rows bigint")


def duplicate_examples(df: DataFrame, n: int = 5) -> DataFrame:
    """The n most repeated rows with their number of copies."""
    cols = [col(c) for c in df.columns]
    return (
        with_repeats(df, repeats(df)).groupBy(*cols).agg(F.count("*").alias("copies")).where("copies > 1").orderBy(F.desc("copies"), *cols).limit(n)
    )


def edge_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first and the last n rows in `order`, with `part` (head or tail) and `position` counted from that end.

    Two bounded top-n aggregates; a table of fewer than 2n rows shows some rows in both.  Rows with equal keys
    follow the other columns, NULLs come first.
    """
    cells = [col(c) for c in dict.fromkeys([*order, *df.columns])]
    parts = []
    for part, keys in (("head", [c.asc_nulls_first() for c in cells]), ("tail", [c.desc_nulls_last() for c in cells])):
        top = df.orderBy(*keys).limit(n)
        position = F.row_number().over(Window.orderBy(*keys))  # over n rows
        parts.append(top.select(F.lit(part).alias("part"), position.alias("position"), *[col(c) for c in df.columns]))
    return parts[0].unionByName(parts[1])


def missing_patterns(df: DataFrame) -> DataFrame:
    """(pattern, n): which columns are missing together; '1' marks a missing cell."""
    bits = F.concat(*[F.when(col(c).isNull(), "1").otherwise("0") for c in df.columns])
    return df.groupBy(bits.alias("pattern")).agg(F.count("*").alias("n"))


def numeric_range_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, min, max, mean, std); std is 0 for a single value."""
    return per_column(
        df,
        list(columns or numeric_columns(df)),
        {
            "min": lambda c: F.min(col(c)).cast("double"),
            "max": lambda c: F.max(col(c)).cast("double"),
            "mean": lambda c: F.avg(col(c)),
            "std": lambda c: F.coalesce(F.stddev_samp(col(c)), F.lit(0.0)),
        },
    )


def coefficient_of_variation(df: DataFrame) -> DataFrame:
    """(column_name, score): std/|mean| (std if the mean is 0); distinct values for text.

    A missing value counts as one more distinct value of a text column.
    """
    numeric = numeric_columns(df)
    others = [c for c in df.columns if c not in numeric]
    scores = []
    if numeric:
        spread = lambda c: F.coalesce(
            F.stddev_samp(col(c)) / F.nullif(F.abs(F.avg(col(c))), F.lit(0.0)), F.stddev_samp(col(c))
        )
        scores.append(per_column(df, numeric, {"score": spread}))
    if others:
        shape = distinct_and_missing(value_frequencies(df, others))
        scores.append(
            shape.select("column_name", (F.col("n_unique") + (F.col("n_missing") > 0).cast("int")).cast("double").alias("score"))
        )
    result = scores[0]
    for s in scores[1:]:
        result = result.unionByName(s)
    return result


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, bin_start, bin_end, n, mean, std, min, max): equal-width counts.

    Empty bins are returned with n = 0; std is the population one.
    """
    x = col(column).cast("double")
    overlay = df.agg(
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")
    ).first()
    lo, hi = overlay["min"], overlay["max"]
    if lo is None:
        raise ValueError(f"{column} has no values")
    width = (hi - lo) or 1.0
    slot = F.least(F.floor((x - F.lit(lo)) / F.lit(width) * bins), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(F.broadcast(counts), "bin", "left").select(  # at most `bins` rows
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width) / bins).alias("bin_start"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width) / bins).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
        *[F.lit(overlay[k]).alias(k) for k in ("mean", "std", "min", "max")],
    )
