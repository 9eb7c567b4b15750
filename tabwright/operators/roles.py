"""Column roles and target type, inferred from one aggregate and then overridden."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import col, has_word, kinds
from .frequencies import distinct_and_missing, value_frequencies

# A sketch of 2^12 registers errs by about 1.6 %; it only decides which columns need an exact count.
SKETCH_LOG_REGISTERS = 12
CLEARLY_MANY = 3 * fv.MAX_CATEGORY_LEVELS
CLEARLY_OFF_RATIO = 0.1


@dataclass(frozen=True)
class ColumnFacts:
    """What the rules need to know about one column."""

    name: str
    kind: str
    non_null: int
    n_unique: int
    unique_is_exact: bool
    low: float | None
    high: float | None
    whole: bool


def column_facts(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, ColumnFacts]:
    """Facts for all columns: ranges, then sketches, then exact counts where they matter.

    Ranges and whole-number tests are one code-generated aggregate.  Sketches
    (another, over fewer columns) say which columns have clearly more values
    than any threshold; those are not counted exactly, so wide keys are not
    shuffled.  Columns with few values, and text whose distinct share is near
    the free-text ratio, are counted exactly.
    """
    folded = kinds(df)
    names = list(columns or df.columns)
    exprs = []
    for i, c in enumerate(names):
        exprs.append(F.count(col(c)).alias(f"n{i}"))
        if folded[c] in ("int", "float"):
            x = col(c).cast("double")
            exprs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.bool_and(x == F.floor(x)).alias(f"w{i}")]
    row = df.agg(*exprs).first().asDict()
    # Dates, booleans and numbers with fractions are decided without a distinct count.
    open_ = [c for i, c in enumerate(names) if folded[c] in ("str", "int") or (folded[c] == "float" and row[f"w{i}"])]
    sketch = {}
    if open_:
        seen = df.agg(*[
            F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(col(c)), SKETCH_LOG_REGISTERS)).alias(f"u{i}")
            for i, c in enumerate(open_)
        ]).first()
        sketch = {c: seen[f"u{i}"] for i, c in enumerate(open_)}
    exact = []
    for i, c in enumerate(names):
        if c not in sketch:
            continue
        ratio = sketch[c] / row[f"n{i}"] if row[f"n{i}"] else 0.0
        near_ratio = folded[c] == "str" and abs(ratio - fv.TEXT_DISTINCT_RATIO) < CLEARLY_OFF_RATIO
        if sketch[c] <= CLEARLY_MANY or near_ratio:
            exact.append(c)
    counted = {}
    if exact:
        shape = distinct_and_missing(value_frequencies(df, exact)).collect()  # one row per column
        counted = {r["column_name"]: r["n_unique"] for r in shape}
    return {
        c: ColumnFacts(
            c, folded[c], row[f"n{i}"], counted.get(c, sketch.get(c, 0)), c in counted,
            row.get(f"lo{i}"), row.get(f"hi{i}"), bool(row.get(f"w{i}")),
        )
        for i, c in enumerate(names)
    }


def numeric_role(f: ColumnFacts) -> str:
    if f.non_null == 0 or not f.whole:
        return "numeric-continuous"
    few = f.n_unique <= fv.MAX_LABEL_LEVELS
    if few and not has_word(f.name, fv.NUMERIC_NAME_WORDS) and f.n_unique > 1:
        consecutive = f.high - f.low + 1 == f.n_unique
        return "numeric-discrete" if consecutive else "categorical-nominal"
    return "numeric-discrete"


def role_of(f: ColumnFacts) -> str:
    if f.kind == "bool":
        return "boolean"
    if f.kind in ("int", "float"):
        zero_one = f.n_unique == 2 and f.whole and (f.low, f.high) == (0.0, 1.0)
        return "boolean" if zero_one else numeric_role(f)
    if f.kind == "datetime":
        return "datetime"
    if f.kind != "str":
        return "text"
    if has_word(f.name, fv.IDENTIFIER_NAME_WORDS):
        return "text"
    if f.n_unique <= fv.MAX_CATEGORY_LEVELS:
        return "categorical-nominal"
    return "text" if f.n_unique / f.non_null > fv.TEXT_DISTINCT_RATIO else "categorical-nominal"


def suggest_roles(df: DataFrame, facts: Mapping[str, ColumnFacts] | None = None) -> dict[str, str]:
    return {c: role_of(f) for c, f in (facts or column_facts(df)).items()}


def role_table(df: DataFrame) -> DataFrame:
    """(column_name, dtype, role) for every column."""
    facts = column_facts(df)
    rows = [(c, f.kind, role_of(f)) for c, f in facts.items()]
    return df.sparkSession.createDataFrame(rows, "column_name string, dtype string, role string")


def with_roles(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Attach roles as column metadata, so that they travel with the DataFrame."""
    return df.select(*[
        col(c).alias(c, metadata={**df.schema[c].metadata, "role": roles[c]}) if c in roles else col(c)
        for c in df.columns
    ])


def roles_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["role"] for f in df.schema.fields if "role" in f.metadata}


def merge_roles(
    suggested: Mapping[str, str], confirmed: Mapping[str, str]
) -> list[tuple[str, str, str]]:
    """(column, role, source): confirmed roles win over suggestions."""
    unknown = [r for r in confirmed.values() if r not in fv.ROLES]
    absent = [c for c in confirmed if c not in suggested]
    if unknown or absent:
        raise ValueError(f"unknown roles {unknown}, unknown columns {absent}")
    return [
        (c, confirmed.get(c, r), "user_confirmed" if c in confirmed else "system_defaulted")
        for c, r in suggested.items()
    ]


def merged_role_table(spark: SparkSession, suggested: Mapping[str, str], confirmed: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame(merge_roles(suggested, confirmed), "column_name string, role string, source string")


def decision_summary(
    merged: Sequence[tuple[str, str, str]], key_features: Sequence[str]
) -> tuple[int, int, int, list[str]]:
    """total, user-modified, defaulted, and the key features among the modified."""
    changed = [c for c, _, source in merged if source == "user_confirmed"]
    return len(merged), len(changed), len(merged) - len(changed), [c for c in changed if c in set(key_features)]


# -- target ------------------------------------------------------------------


@dataclass(frozen=True)
class Target:
    name: str
    task: str
    ml_type: str

    def __post_init__(self):
        if self.task not in fv.TASKS or self.ml_type not in fv.TARGET_TYPES:
            raise ValueError(f"unsupported target: {self.task} / {self.ml_type}")


def suggest_target_name(columns: Sequence[str]) -> str:
    """The first column named like a target, else the last column."""
    return next((c for c in columns if has_word(c, fv.TARGET_NAME_WORDS)), columns[-1])


def target_of(f: ColumnFacts) -> Target:
    if f.kind == "bool":
        return Target(f.name, "classification", "binary_boolean")
    if f.kind in ("int", "float"):
        if f.kind == "float" or f.n_unique > fv.MAX_LABEL_LEVELS:
            return Target(f.name, "regression", "numeric_continuous")
        if f.n_unique != 2:
            return Target(f.name, "classification", "multiclass_int_labels")
        ends = (f.low, f.high) == (0.0, 1.0)
        return Target(f.name, "classification", "binary_01" if ends else "binary_numeric")
    if f.kind == "str":
        if f.n_unique == 2:
            return Target(f.name, "classification", "binary_text_labels")
        few = 2 < f.n_unique <= fv.MAX_CATEGORY_LEVELS
        return Target(f.name, "classification", "multiclass_text_labels" if few else "high_cardinality_text")
    return Target(f.name, "classification", "unknown_type")


def suggest_target(df: DataFrame, name: str | None = None) -> Target:
    name = name or suggest_target_name(df.columns)
    return target_of(column_facts(df, [name])[name])


def target_type_options(f: ColumnFacts, task: str) -> list[str]:
    """The target types that are legal for this column and task."""
    if task == "regression":
        return ["numeric_continuous"]
    if f.kind == "bool":
        return ["binary_boolean"]
    if f.kind in ("int", "float"):
        if f.n_unique != 2:
            return ["multiclass_int_labels"]
        return ["binary_01" if (f.low, f.high) == (0.0, 1.0) else "binary_numeric"]
    if f.n_unique == 2:
        return ["binary_text_labels"]
    many = f.n_unique > fv.MAX_CATEGORY_LEVELS
    return ["multiclass_text_labels"] + (["high_cardinality_text"] if many else [])


def target_suggestion_table(df: DataFrame) -> DataFrame:
    """Column statistics of every column beside the one suggested target."""
    from .profiling import column_statistics

    t = suggest_target(df)
    return column_statistics(df).select(
        "*",
        F.lit(t.name).alias("suggested_column"),
        F.lit(t.task).alias("suggested_task"),
        F.lit(t.ml_type).alias("suggested_ml_type"),
        F.lit(fv.SUGGESTION_CONFIDENCE).alias("confidence"),
    )


def feature_suggestion_table(df: DataFrame, target: Target, top_n: int = 7) -> DataFrame:
    """Statistics, suggested role and key-feature flag of every feature."""
    from .importance import key_features
    from .profiling import column_statistics

    keys = key_features(df, target, top_n)
    roles = [(c, r, c in keys) for c, r in suggest_roles(df).items() if c != target.name]
    side = df.sparkSession.createDataFrame(roles, "column_name string, role string, is_key_feature boolean")
    return column_statistics(df).join(F.broadcast(side), "column_name")  # one row per column
