"""Reading and writing tables: CSV in, prepared data, predictions and reports out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import fixed_values as fv
from ..functions.columns import NUMBER_PATTERN, col, kinds, nan_to_null, preview_text
from .csv_records import holds_breaks, read_broken, text_lines

EVENT_SCHEMA = (
    "timestamp timestamp_ntz, severity string, stage string, run_id string, event string, event_data map<string, string>"
)


class EmptyTable(ValueError):
    """A table that must have rows has none."""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if not df.columns or df.isEmpty():
        raise EmptyTable(f"{what} has no rows")
    return df


def scan_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, parse_dates: bool = False,
    multi_line: bool = False, missing: Sequence[str] = fv.MISSING_TOKENS,
) -> DataFrame:
    """A headered CSV with inferred types; malformed or empty input is refused.

    A quote inside quotes is doubled and cells in `missing` are NULL before types are looked for.  Quoted cells
    may hold line breaks: a first pass looks for them, and files that have some are put together from their
    splits (`csv_records`), in many tasks and so in no fixed row order; `multi_line` reads each file in one task
    and in order instead.  Lines end in LF or CR LF.  Inference is one more pass over the
    data; pass `schema` to avoid it.  Dates stay text unless `parse_dates`.  A row that does not fit the header
    fails the job that reads it.
    """
    lines = text_lines(spark, path)
    options = {"mode": "FAILFAST", "escape": '"'}
    if not multi_line and holds_breaks(lines):
        text = read_broken(lines, options)
    else:
        text = spark.read.options(header=True, inferSchema=False, multiLine=multi_line, **options).csv(path)
    cells = text.select(*[F.when(~col(c).isin(*missing), col(c)).alias(c) for c in text.columns])
    require_rows(cells, path)
    if schema is None:
        kinds_found = _csv_types(cells, parse_dates)
    else:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        kinds_found = {f.name: f.dataType.simpleString() for f in wanted}
    return nan_to_null(cells.select(*[
        (col(c) if kinds_found[c] == "string" else F.trim(col(c)).cast(kinds_found[c])).alias(c) for c in text.columns if c in kinds_found
    ]))


def _csv_types(cells: DataFrame, parse_dates: bool) -> dict[str, str]:
    """The narrowest type that holds every cell of a column: one aggregate over the text."""
    def fits(c: str) -> dict[str, Column]:
        x = F.trim(col(c))
        tests = {
            "int": x.rlike(r"^[+-]?\d+$") & x.try_cast("int").isNotNull(), "bigint": x.rlike(r"^[+-]?\d+$") & x.try_cast("bigint").isNotNull(),
            "double": x.rlike(NUMBER_PATTERN), "boolean": F.lower(x).isin("true", "false"),
        }
        return tests | ({"timestamp": x.try_cast("timestamp").isNotNull()} if parse_dates else {})

    checks = [(c, kind, test) for c in cells.columns for kind, test in fits(c).items()]
    row = cells.agg(
        *[F.bool_and(F.when(col(c).isNotNull(), test)).alias(f"t{i}") for i, (c, _, test) in enumerate(checks)]
    ).first()  # one row
    found = dict.fromkeys(cells.columns, "string")
    for i, (c, kind, _) in reversed(list(enumerate(checks))):
        if row[f"t{i}"]:
            found[c] = kind
    return found


def scan_ml_ready(spark: SparkSession, path: str) -> DataFrame:
    """A prepared table; refused when it has no rows."""
    return nan_to_null(require_rows(spark.read.parquet(path), path))


def write_prepared(df: DataFrame, path: str, as_csv: bool = False) -> None:
    if as_csv:
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_predictions(df: DataFrame, path: str, run_id: str) -> None:
    """Append scored rows under their run; one folder per run prunes later reads."""
    stamped = df.withColumns({"run_id": F.lit(run_id), "scored_at": F.current_timestamp()})
    stamped.write.mode("append").partitionBy("run_id").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_params(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def row_preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first n rows in `order` as text: whole floats without fraction, NULL as 'nan'."""
    folded = kinds(df)
    top = df.orderBy(*[col(c) for c in order]).limit(n)
    return top.select(*[preview_text(col(c), folded[c]).alias(c) for c in df.columns])


def round_to_integers(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Numeric columns rounded half to even and cast to bigint, NULL kept."""
    folded = kinds(df)

    def one(c: str) -> Column:
        if c in skip or folded[c] not in ("int", "float"):
            return col(c)
        return F.bround(col(c), 0).cast("bigint").alias(c) if folded[c] == "float" else col(c).cast("bigint").alias(c)

    return df.select(*[one(c) for c in df.columns])


def event_log_scan(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines event log with a fixed schema (no inference pass)."""
    return spark.read.schema(EVENT_SCHEMA).json(path)
