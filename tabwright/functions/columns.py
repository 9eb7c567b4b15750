"""Row-local column expressions and type helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import fixed_values as fv

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by exact name; dots and spaces in the name are safe."""
    return F.col(quoted(name))


def kind_of(data_type: T.DataType) -> str:
    """Fold a Spark type to int / float / bool / datetime / str / other."""
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, _INTEGERS):
        return "int"
    if isinstance(data_type, _FLOATS + (T.DecimalType,)):
        return "float"
    if isinstance(data_type, _TIMES):
        return "datetime"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "str"
    return "other"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in kinds(df).items() if k in ("int", "float")]


def text_columns(df: DataFrame) -> list[str]:
    return [c for c, k in kinds(df).items() if k == "str"]


def count_where(condition: Column) -> Column:
    """Rows where `condition` holds; generates leaner code than `count_if`."""
    return F.count(F.when(condition, 1))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL are one thing here; done once, at ingest."""
    fixes = {
        f.name: F.when(~F.isnan(col(f.name)), col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, _FLOATS)
    }
    return df.withColumns(fixes) if fixes else df


def safe_number(c: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL."""
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def preview_text(c: Column, kind: str) -> Column:
    """A cell as preview text: whole floats lose their fraction, NULL is 'nan'."""
    if kind == "float":
        whole = (c == F.floor(c)) & (F.abs(c) < F.lit(9e15))
        shown = F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    else:
        shown = c.cast("string")
    return F.coalesce(shown, F.lit("nan"))


def display_name(c: Column) -> Column:
    """'two_word-name' -> 'Two Word Name'."""
    spaced = F.translate(c.cast("string"), "_-", "  ")
    return F.initcap(F.trim(F.regexp_replace(spaced, r"\s+", " ")))


def tokens(c: Column) -> Column:
    """Lower-cased word tokens of two characters or more (NULL text has none)."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


def word_in(c: Column, words: Iterable[str]) -> Column:
    return F.lower(c.cast("string")).isin(*words)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def softmax(scores: Column) -> Column:
    """Softmax of an array column, shifted by its maximum."""
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


def date_parts(c: Column, prefix: str) -> list[Column]:
    """Year, month, day and weekday (Monday = 0)."""
    return [
        F.year(c).alias(f"{prefix}_year"),
        F.month(c).alias(f"{prefix}_month"),
        F.dayofmonth(c).alias(f"{prefix}_day"),
        F.weekday(c).alias(f"{prefix}_dayofweek"),
    ]


def has_word(name: str, words: Iterable[str]) -> bool:
    lowered = name.lower()
    return any(w in lowered for w in words)


def feature_category(name: str) -> str:
    """Topic of a feature, by the first word list its name matches."""
    for category, words in fv.FEATURE_CATEGORY_WORDS.items():
        if has_word(name, words):
            return category
    return "general"
