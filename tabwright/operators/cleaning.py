"""Imputation by role, then de-duplication, with an audit of what was done."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.digests import distinct, distinct_rows, repeats
from ..functions.columns import col, count_where, kinds, numeric_columns
from ..functions.sizing import slotted
from .frequencies import modes, value_frequencies
from .quantiles import exact_quantiles
from .roles import Target

NUMERIC_ROLES = ("numeric-continuous", "numeric-discrete")
TEXT_ROLES = ("categorical-nominal", "categorical-ordinal", "text")


def fallback_role(kind: str) -> str:
    return {"bool": "boolean", "int": "numeric-continuous", "float": "numeric-continuous", "datetime": "datetime"}.get(
        kind, "categorical-nominal"
    )


def target_role(target: Target) -> str:
    """The role that decides how missing target values are filled."""
    if target.ml_type in ("binary_01", "binary_numeric", "numeric_continuous"):
        return "numeric-continuous"
    if target.ml_type == "binary_boolean":
        return "boolean"
    return "categorical-ordinal" if target.ml_type == "multiclass_int_labels" else "categorical-nominal"


@dataclass(frozen=True)
class Fill:
    """How one column's missing cells are filled."""

    column: str
    role: str
    method: str          # median, mode, constant, neighbour
    value: object
    missing: int


def effective_roles(df: DataFrame, roles: Mapping[str, str], target: Target | None = None) -> dict[str, str]:
    folded = kinds(df)
    out = {}
    for c in df.columns:
        if target is not None and c == target.name and c not in roles:
            out[c] = target_role(target)
        else:
            out[c] = roles.get(c) or fallback_role(folded[c])
    return out


def fit_fills(df: DataFrame, roles: Mapping[str, str], target: Target | None = None) -> list[Fill]:
    """Missing counts in one aggregate, medians by exact selection, modes by one frequency pass."""
    folded, role = kinds(df), effective_roles(df, roles, target)
    row = df.agg(*[count_where(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    holes = {c: row[f"m{i}"] for i, c in enumerate(df.columns) if row[f"m{i}"]}
    numeric = set(numeric_columns(df))
    by_median = [
        c for c in holes
        if c in numeric and (role[c] in NUMERIC_ROLES or role[c] not in TEXT_ROLES + ("boolean", "datetime"))
    ]
    by_mode = [c for c in holes if role[c] in TEXT_ROLES + ("boolean",)]
    medians = exact_quantiles(df, by_median, (0.5,)) if by_median else {}
    top = {}
    if by_mode:
        slot = {"int": "l", "bool": "l", "datetime": "l", "float": "d", "str": "s", "other": "s"}
        for r in modes(value_frequencies(df, by_mode)).collect():  # one row per column
            v = r[slot[folded[r["column_name"]]]]
            top[r["column_name"]] = bool(v) if folded[r["column_name"]] == "bool" else v
    fills = []
    for c, n in holes.items():
        if c in medians:
            m = medians[c][0]
            fills.append(Fill(c, role[c], "median", 0.0 if m is None else m, n))
        elif c in top:
            fills.append(Fill(c, role[c], "mode", top[c], n))
        elif role[c] == "boolean":
            fills.append(Fill(c, role[c], "constant", False, n))
        elif role[c] == "datetime":
            fills.append(Fill(c, role[c], "neighbour", fv.MISSING_DATE, n))
        elif c in numeric:
            fills.append(Fill(c, role[c], "constant", 0.0, n))
        else:
            fills.append(Fill(c, role[c], "constant", fv.UNKNOWN_TEXT, n))
    return fills


def _filled(fill: Fill, kind: str) -> Column:
    c, v = col(fill.column), fill.value
    if fill.method == "median" and kind == "int" and float(v).is_integer():
        v = int(v)
    if fill.method == "median" and isinstance(v, float):
        return F.coalesce(c.cast("double"), F.lit(v))
    if kind == "datetime" and not isinstance(v, str):
        return F.coalesce(c, F.timestamp_micros(F.lit(v)))
    if kind == "bool":
        return F.coalesce(c, F.lit(bool(v)))
    return F.coalesce(c, F.lit(v))


def apply_fills(df: DataFrame, fills: Sequence[Fill], order: Sequence[str] = ()) -> DataFrame:
    """One projection for all fills, plus an ordered fill per datetime column."""
    folded = kinds(df)
    done = {f.column: _filled(f, folded[f.column]) for f in fills if f.method != "neighbour"}
    out = df.withColumns(done) if done else df
    for f in fills:
        if f.method == "neighbour":
            if not order:
                raise ValueError(f"filling {f.column} from its neighbours needs `order` columns")
            out = fill_from_neighbours(out, f.column, order)
    return out


def fill_from_neighbours(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Last value before each hole, else the next one after it, else 1900-01-01.

    `order` must be a unique key.  Rows are split into contiguous ranges; each
    range is filled on its own and takes what it lacks from its neighbours'
    edge values (two values per range).
    """
    ranged = slotted(df, [col(c) for c in order])
    at = F.struct(*[col(c) for c in order])
    known = col(column).isNotNull()
    edges = ranged.groupBy("__slot").agg(
        F.max_by(F.when(known, col(column)), F.when(known, at)).alias("last"),
        F.min_by(F.when(known, col(column)), F.when(known, at)).alias("first"),
    )
    before = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("__slot").rowsBetween(1, Window.unboundedFollowing)
    carried = edges.select(
        "__slot",
        F.last("last", ignorenulls=True).over(before).alias("__before"),
        F.coalesce("first", F.first("first", ignorenulls=True).over(after)).alias("__next"),
    )
    inside = Window.partitionBy("__slot").orderBy(*[col(c) for c in order])
    back = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placeholder = F.lit(fv.MISSING_DATE).cast(df.schema[column].dataType)
    # A row with nothing before it lies ahead of its range's first value, so that value is the next one.
    value = F.coalesce(
        F.last(col(column), ignorenulls=True).over(back), F.col("__before"), F.col("__next"), placeholder
    )
    filled = ranged.join(F.broadcast(carried), "__slot").withColumn(column, value)  # one row per range
    return filled.select(*[col(c) for c in df.columns])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows, NULLs equal; only rows whose digest repeats are shuffled."""
    return distinct(df)


def clean(
    df: DataFrame, roles: Mapping[str, str], target: Target | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """Impute every column, then remove duplicates: imputing can create them."""
    return drop_duplicates(apply_fills(df, fit_fills(df, roles, target), order))


def cleaning_audit(df: DataFrame, roles: Mapping[str, str], target: Target | None = None, order: Sequence[str] = ()) -> DataFrame:
    """(step, column_name, method, fill_value, n_affected) of the same clean-up."""
    fills = fit_fills(df, roles, target)
    filled = apply_fills(df, fills, order)
    known = repeats(filled)
    removed = known.rows - distinct_rows(filled, known)
    steps = [("impute", f.column, f.method, str(f.value), f.missing) for f in fills]
    schema = "step string, column_name string, method string, fill_value string, n_affected bigint"
    steps.append(("deduplicate", "", "distinct", "", removed))
    return df.sparkSession.createDataFrame(steps, schema)
