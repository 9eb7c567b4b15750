"""One long frequency table from which distinct counts, modes and options come.

A cell is (column, l, d, s): whole numbers, times and booleans in `l`, decimals
in `d`, text in `s`.  Counting cells is one shuffle for any number of columns;
equal cells collapse before it, so a value held by a third of all rows costs
one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import col, count_where, kind_of

CELL = ("l", "d", "s")
SHORT_TEXT = 40


def cell(field: T.StructField) -> tuple[Column, Column, Column]:
    """The value of a column in one of `CELL`, the others NULL."""
    c, kind = col(field.name), kind_of(field.dataType)
    none_l, none_d, none_s = (F.lit(None).cast(t) for t in ("bigint", "double", "string"))
    if kind in ("int", "bool"):
        return c.cast("bigint"), none_d, none_s
    if kind == "float":
        return none_l, c.cast("double"), none_s
    if isinstance(field.dataType, T.DateType):
        return F.unix_date(c).cast("bigint"), none_d, none_s
    if kind == "datetime":
        return F.unix_micros(c.cast("timestamp")), none_d, none_s
    return none_l, none_d, c.cast("string")


def cells(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell: `keep` columns, then (column_name, l, d, s)."""
    fields = {f.name: f for f in df.schema.fields}
    names = list(columns if columns is not None else fields)
    parts: list[Column] = []
    for name in names:
        parts += [F.lit(name), *cell(fields[name])]
    return df.select(
        *[col(k) for k in keep],
        F.stack(F.lit(len(names)), *parts).alias("column_name", *CELL),
    )


def short_cells(found: DataFrame, chars: int = SHORT_TEXT) -> DataFrame:
    """Cells with texts longer than `chars` replaced by their SHA-256: as many distinct ones, but of bounded size."""
    shown = F.when(F.length("s") > chars, F.concat(F.lit("#"), F.sha2(F.col("s"), 256))).otherwise(F.concat(F.lit("="), F.col("s")))
    return found.withColumn("s", shown)


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, l, d, s, n): how often each value, NULL included, occurs."""
    return cells(df, columns).groupBy("column_name", *CELL).agg(F.count("*").alias("n"))


def is_value() -> Column:
    """True for a frequency row that stands for a value rather than for NULL."""
    return F.col("l").isNotNull() | F.col("d").isNotNull() | F.col("s").isNotNull()


def value_text(df: DataFrame) -> Column:
    """The cell as text, formatted by the type of the column it came from."""
    shown = F.coalesce(F.col("s"), F.col("l").cast("string"), F.col("d").cast("string"))
    for f in df.schema.fields:
        here = F.col("column_name") == f.name
        kind = kind_of(f.dataType)
        if kind == "float":
            whole = F.col("d") == F.floor("d")
            text = F.when(whole, F.col("d").cast("bigint").cast("string")).otherwise(F.col("d").cast("string"))
        elif isinstance(f.dataType, T.DateType):
            text = F.date_from_unix_date(F.col("l").cast("int")).cast("string")
        elif kind == "datetime":
            text = F.date_format(F.timestamp_micros(F.col("l")), "yyyy-MM-dd HH:mm:ss")
        elif kind == "bool":
            text = F.when(F.col("l") == 1, F.lit("true")).when(F.col("l") == 0, F.lit("false"))
        else:
            continue
        shown = F.when(here, text).otherwise(shown)
    return shown


def distinct_and_missing(freq: DataFrame) -> DataFrame:
    """(column_name, n_unique, n_missing, n_rows) from a frequency table."""
    return freq.groupBy("column_name").agg(
        count_where(is_value()).alias("n_unique"),
        F.sum(F.when(is_value(), 0).otherwise(F.col("n"))).alias("n_missing"),
        F.sum("n").alias("n_rows"),
    )


def modes(freq: DataFrame) -> DataFrame:
    """(column_name, l, d, s, n): the most frequent value; ties take the smallest."""
    best = F.min(F.struct((-F.col("n")).alias("rank"), *CELL)).alias("best")
    return (
        freq.where(is_value())
        .groupBy("column_name")
        .agg(best)
        .select("column_name", *[F.col(f"best.{c}").alias(c) for c in CELL], (-F.col("best.rank")).alias("n"))
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, pct) of one column, NULL excluded, pct of the non-null rows."""
    total = df.agg(F.count(col(column))).first()[0]
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.select("value", "n", (F.col("n") * 100.0 / F.lit(total)).alias("pct"))


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """(n_classes, max_pct, min_pct, balance_ratio) of one column."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column)).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("n_classes"),
        (F.max("n") * 100.0 / F.sum("n")).alias("max_pct"),
        (F.min("n") * 100.0 / F.sum("n")).alias("min_pct"),
        (F.max("n") / F.min("n")).alias("balance_ratio"),
    )


def options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, option, n) for every distinct value as text."""
    freq = value_frequencies(df, columns).where(is_value())
    return freq.select("column_name", value_text(df.select(*[col(c) for c in columns])).alias("option"), "n")


def most_common_option(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_options, default_option, default_n); ties take the smallest."""
    return (
        options(df, columns)
        .groupBy("column_name")
        .agg(
            F.count("*").alias("n_options"),
            F.min(F.struct((-F.col("n")).alias("rank"), "option")).alias("best"),
        )
        .select(
            "column_name", "n_options",
            F.col("best.option").alias("default_option"), (-F.col("best.rank")).alias("default_n"),
        )
    )
