"""Encoders: fit takes aggregates, transform is one SQL projection.

A fitted encoder is a list of column steps with bounded state.  `statement()`
renders it as the text of one SELECT, so that the same encoder runs on a
DataFrame, inside a `pyspark.ml` pipeline (SQLTransformer) and after reload.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from math import log

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import Interaction, SQLTransformer
from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import TOKEN_PATTERN, col, count_where, kinds, quoted, tokens
from ..functions.sizing import lookup, rows_if_bounded
from .dictionary import DictionaryLookup, one_hot_vectors, write_levels
from .frequencies import is_value, value_frequencies, value_text
from .heavy import heavy_values
from .importance import label_codes
from .roles import Target

#: A category with more values has its 0/1 features in one sparse vector column instead of a column each.
MAX_WIDE_LEVELS = 2_000
PARAM_SCHEMA = "position int, column_name string, kind string, state string"


@dataclass(frozen=True)
class Step:
    """One encoded column: its kind and the numbers or words it needs."""

    column: str
    kind: str
    state: Mapping[str, object] = field(default_factory=dict)


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class LevelsExceeded(ValueError):
    """A column has more values than a wide layout can carry."""


# -- single operators --------------------------------------------------------


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population std per column; a zero std counts as 1."""
    steps = _fit_scales(df, columns)
    return Encoder(steps).transform(df)


def _fit_scales(df: DataFrame, columns: Sequence[str]) -> list[Step]:
    if not columns:
        return []
    row = df.agg(
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(col(c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return [
        Step(c, "scale", {"mean": row[f"m{i}"] or 0.0, "scale": row[f"s{i}"] or 1.0}) for i, c in enumerate(columns)
    ]


def levels_of(df: DataFrame, columns: Sequence[str], limit: int = MAX_WIDE_LEVELS) -> dict[str, list[str]]:
    """Sorted distinct values of each column as text; refuses unbounded columns."""
    if not columns:
        return {}
    narrow = df.select(*[col(c) for c in columns])
    freq = value_frequencies(narrow).where(is_value()).select("column_name", value_text(narrow).alias("value"), *("l", "d"))
    rows = rows_if_bounded(freq, limit * len(columns))
    if rows is None:
        raise LevelsExceeded(f"more than {limit} values per column in {list(columns)}; use one_hot_rows or the text or label form")
    found: dict[str, list[tuple]] = {c: [] for c in columns}
    for r in rows:
        found[r["column_name"]].append((r["l"] if r["l"] is not None else r["d"] if r["d"] is not None else r["value"], r["value"]))
    for c, v in found.items():
        if len(v) > limit:
            raise LevelsExceeded(f"{c} has {len(v)} values")
    return {c: [text for _, text in sorted(v)] for c, v in found.items()}


def narrow_levels(df: DataFrame, columns: Sequence[str], limit: int = MAX_WIDE_LEVELS) -> dict[str, list[str]]:
    """`levels_of` the columns that have at most `limit` values; the others are left out."""
    if not columns:
        return {}
    freq = value_frequencies(df.select(*[col(c) for c in columns])).where(is_value())
    counts = {r["column_name"]: r["n"] for r in freq.groupBy("column_name").agg(F.count("*").alias("n")).collect()}  # one row a column
    few = [c for c in columns if counts.get(c, 0) <= limit]
    return levels_of(df, few, limit)


def hot_step(df: DataFrame, column: str, levels: Mapping[str, list[str]]) -> Step:
    """0/1 columns for a column with known levels, else one vector with the same features."""
    if column in levels:
        return Step(column, "one_hot", {"levels": levels[column]})
    return wide_step(df, column, "hot_vector")


def wide_step(df: DataFrame, column: str, kind: str) -> Step:
    path, size = write_levels(df, column, Encoder._shown(quoted(column), kinds(df)[column]))
    return Step(column, kind, {"path": path, "size": size})


def one_hot(df: DataFrame, columns: Sequence[str], wide_levels: int = MAX_WIDE_LEVELS) -> DataFrame:
    """One 0/1 column `{column}_{value}` per value; NULL gives all zeros.

    A column with more than `wide_levels` values holds the same numbers as one sparse vector, in the order
    of its sorted values (`one_hot_rows` gives them in long form).
    """
    levels = narrow_levels(df, columns, wide_levels)
    return Encoder([hot_step(df, c, levels) for c in columns]).transform(df)


def one_hot_rows(df: DataFrame, keys: Sequence[str], column: str, number: str | None = None) -> DataFrame:
    """One-hot in long form, for any number of values: (keys, position, value, hot), only the ones.

    `position` counts the sorted distinct values and `value` is their text; a NULL has no row.  With
    `number`, `hot` is that column in place of 1: the interaction of both.
    """
    codes = label_codes(df, column).select(F.col("value").alias(column), F.col("code").alias("position"), "n")
    narrow = df.where(col(column).isNotNull()).select(*dict.fromkeys([*keys, column, *([number] if number else [])]))
    hot = col(number) if number else F.lit(1)
    value = F.expr(Encoder._shown(quoted(column), kinds(df)[column]))
    return lookup(narrow, codes, column, weight="n").select(*[col(k) for k in keys], "position", value.alias("value"), hot.alias("hot"))


def ordinal_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Position among the sorted distinct values, NULL -> -1; any number of values."""
    codes = label_codes(df, column).select(F.col("value").alias(column), F.col("code").alias(name), "n")
    joined = lookup(df, codes, column, weight="n")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(-1)))


def datetime_parts(df: DataFrame, column: str) -> DataFrame:
    """Year, month, day and weekday columns in place of the source."""
    return Encoder([Step(column, "datetime")]).transform(df)


def text_boolean(df: DataFrame, column: str) -> Step:
    """Fit of yes/no words; two other values are taken in sorted order."""
    lowered = F.lower(col(column).cast("string"))
    known = lowered.isin(*fv.TRUE_WORDS, *fv.FALSE_WORDS)
    shown = F.when(~known, col(column).cast("string"))
    row = df.agg(F.min(shown).alias("first")).first()
    second = None
    if row["first"] is not None:
        second = df.agg(F.min(F.when(shown > F.lit(row["first"]), shown)).alias("second")).first()["second"]
    return Step(column, "text_boolean", {"zero": row["first"], "one": second})


def english_stop_words() -> list[str]:
    return list(fv.ENGLISH_STOP_WORDS)


def fit_tfidf(df: DataFrame, column: str, terms: int = fv.TFIDF_TERMS, stop_words: Sequence[str] | None = None) -> Step:
    """The most frequent terms (ties by term) and their smooth idf.

    Every token is emitted for its corpus count and every distinct token of a row
    for its row count.  Only terms that can be among the most frequent are counted
    one by one (`heavy_values`), so the shuffle does not grow with the vocabulary.
    """
    stop = list(stop_words) if stop_words is not None else english_stop_words()
    cut = df.select(tokens(col(column)).alias("t"))
    words = cut.select(F.posexplode(F.array("t", F.array_distinct("t"))).alias("distinct", "t")).select(
        "distinct", F.explode("t").alias("term")
    )
    counts = heavy_values(
        words.where(~F.col("term").isin(stop)), ["term"], terms, weight=1 - F.col("distinct").cast("bigint"),
        also={"d": count_where(F.col("distinct") == 1)},
    )
    top = sorted(counts.orderBy(F.desc("n"), "term").limit(terms).collect(), key=lambda r: r["term"])
    n = df.count()
    idf = [log((1 + n) / (1 + r["d"])) + 1 for r in top]
    return Step(column, "tfidf", {"terms": [r["term"] for r in top], "idf": idf})


def tfidf(df: DataFrame, column: str, **kw) -> DataFrame:
    """L2-normalised tf-idf columns `{column}_tfidf_{i}` in place of the text."""
    return Encoder([fit_tfidf(df, column, **kw)]).transform(df)


def tfidf_weights(df: DataFrame, column: str, keys: Sequence[str], **kw) -> DataFrame:
    """The same weights as rows (keys, term, weight), zero weights left out."""
    step = fit_tfidf(df, column, **kw)
    wide = Encoder([step]).transform(df)
    terms = step.state["terms"]
    parts = [F.struct(F.lit(w).alias("term"), col(f"{column}_tfidf_{i}").alias("weight")) for i, w in enumerate(terms)]
    return wide.select(*[col(k) for k in keys], F.inline(F.array(*parts))).where(F.col("weight") > 0)


def target_mean_encode(df: DataFrame, category: str, target: str, name: str) -> DataFrame:
    """Each category replaced by its mean target; heavy categories never shuffle."""
    means = (
        df.where(col(category).isNotNull())
        .groupBy(col(category).alias(category))
        .agg(F.avg(col(target)).alias(name), F.count("*").alias("n"))
    )
    return lookup(df, means, category, weight="n")


def interaction_features(df: DataFrame, number: str, category: str, prefix: str | None = None, wide_levels: int = MAX_WIDE_LEVELS) -> DataFrame:
    """`{number}_x_{value}` columns: the number where the category has that value, else 0 (long: `one_hot_rows`).

    More than `wide_levels` values give one sparse vector `{number}_x_{category}` with the same numbers.
    """
    levels = narrow_levels(df, [category], wide_levels).get(category)
    if levels is None:
        step, name = wide_step(df, category, "hot_vector"), f"{prefix or number}_x_{category}"
        hot = Encoder([Step("__category", step.kind, step.state)]).transform(df.withColumn("__category", col(category)).withColumn("__number", col(number).cast("double")))
        return Interaction(inputCols=["__number", "__category"], outputCol=name).transform(hot).drop("__category", "__number")
    new = {
        f"{prefix or number}_x_{v.replace(' ', '_')}": col(number) * F.coalesce((col(category) == v).cast("int"), F.lit(0))
        for v in levels
    }
    return df.withColumns(new)


def encoder_comparison(df: DataFrame, category: str, target: str) -> DataFrame:
    """|r| of target encoding against the best one-hot level, from one grouped table.

    Both correlations depend only on (count, sum) per category, so rows are
    never encoded.
    """
    known = df.where(col(category).isNotNull())
    y = col(target).cast("double")
    row = known.agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.stddev_pop(y).alias("s")).first()
    z = (y - F.lit(row["m"])) / F.lit(row["s"] or 1.0)
    groups = known.groupBy(col(category)).agg(F.count(y).alias("n"), F.avg(z).alias("g"))
    share = F.col("n") / F.lit(row["n"])
    level = F.abs(share * F.col("g")) / F.sqrt(share * (1 - share))
    best = groups.agg(
        F.sqrt(F.sum(share * F.col("g") * F.col("g"))).alias("target_encoding_r"), F.max(level).alias("best_one_hot_r")
    )
    return best.withColumn("ratio", F.col("target_encoding_r") / F.col("best_one_hot_r"))


# -- target ------------------------------------------------------------------


def fit_target(df: DataFrame, target: Target) -> Step:
    c, kind = target.name, kinds(df)[target.name]
    if target.ml_type == "numeric_continuous":
        return Step(c, "to_double")
    if kind == "bool":
        return Step(c, "to_int")
    if target.ml_type in ("binary_01", "binary_numeric"):
        row = df.agg(F.min(col(c)).alias("a"), F.max(col(c)).alias("b")).first()
        if (row["a"], row["b"]) in ((0, 1), (0.0, 1.0)):
            return Step(c, "to_int")
        return Step(c, "labels", {"levels": [_as_text(row["a"]), _as_text(row["b"])]})
    return Step(c, "labels", {"levels": levels_of(df, [c])[c]})


def _as_text(v) -> str:
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


# -- the fitted encoder ------------------------------------------------------


@dataclass
class Encoder:
    steps: list[Step]

    def statement(self, columns: Sequence[str], types: Mapping[str, str]) -> str:
        """One SELECT over __THIS__ with every step as plain expressions."""
        steps = {s.column: s for s in self.steps}
        inner, out = ["*"], []
        tail: list[str] = []
        for c in columns:
            s, q = steps.get(c), quoted(c)
            if s is None:
                out.append(q)
            elif s.kind == "drop":
                continue
            elif s.kind == "scale":
                out.append(f"(CAST({q} AS DOUBLE) - {s.state['mean']!r}D) / {s.state['scale']!r}D AS {q}")
            elif s.kind == "one_hot":
                text = self._shown(q, types[c])
                tail += [
                    f"CAST(coalesce({text} = {text_literal(v)}, false) AS INT) AS {quoted(f'{c}_{v}')}"
                    for v in s.state["levels"]
                ]
            elif s.kind in ("ordinal", "labels"):
                code = self._position(self._shown(q, types[c]), s.state["levels"])
                out.append(f"{f'coalesce({code}, -1)' if s.kind == 'ordinal' else code} AS {q}")
            elif s.kind == "code":
                code = quoted(f"__code_{c}")
                out.append(f"CASE WHEN {code} >= {s.state['size']} THEN -1 ELSE CAST({code} AS INT) END AS {q}")
            elif s.kind == "hot_vector":
                out.append(f"{quoted(f'__hot_{c}')} AS {q}")
            elif s.kind == "to_int":
                out.append(f"CAST({q} AS INT) AS {q}")
            elif s.kind == "to_double":
                out.append(f"CAST({q} AS DOUBLE) AS {q}")
            elif s.kind == "text_boolean":
                out.append(f"{self._word_flag(q, s)} AS {q}")
            elif s.kind == "datetime":
                t = q if types[c] == "datetime" else f"try_to_timestamp({q})"
                parts = (("year", "year"), ("month", "month"), ("day", "day"), ("weekday", "dayofweek"))
                tail += [f"{fn}({t}) AS {quoted(f'{c}_{name}')}" for fn, name in parts]
            elif s.kind == "tfidf":
                if s.state["terms"]:
                    inner.append(self._weights(q, s))
                    w = quoted(f"__w_{c}")
                    norm = f"sqrt(aggregate({w}, 0D, (a, x) -> a + x * x))"
                    inner.append(f"__NORM__{norm} AS {quoted(f'__n_{c}')}")
                    n = quoted(f"__n_{c}")
                    tail += [
                        f"CASE WHEN {n} > 0 THEN {w}[{i}] / {n} ELSE 0D END AS {quoted(f'{c}_tfidf_{i}')}"
                        for i in range(len(s.state["terms"]))
                    ]
            else:
                raise ValueError(f"unknown step {s.kind}")
        first = [x for x in inner if not x.startswith("__NORM__")]
        norms = [x.removeprefix("__NORM__") for x in inner if x.startswith("__NORM__")]
        source = f"(SELECT {', '.join(first)} FROM __THIS__)" if norms else "__THIS__"
        source = f"(SELECT *, {', '.join(norms)} FROM {source})" if norms else source
        return f"SELECT {', '.join(out + tail)} FROM {source}"

    @staticmethod
    def _shown(q: str, kind: str) -> str:
        if kind == "float":
            return f"CASE WHEN {q} = floor({q}) THEN CAST(CAST({q} AS BIGINT) AS STRING) ELSE CAST({q} AS STRING) END"
        return f"date_format({q}, 'yyyy-MM-dd HH:mm:ss')" if kind == "datetime" else f"CAST({q} AS STRING)"

    @staticmethod
    def _position(text: str, levels: Sequence[str]) -> str:
        """Position of a value among the levels, by halving: few comparisons for many levels."""
        pairs = sorted((v, i) for i, v in enumerate(levels))

        def pick(part) -> str:
            if len(part) <= 4:
                return "CASE " + " ".join(f"WHEN {text} = {text_literal(v)} THEN {i}" for v, i in part) + " END"
            half = len(part) // 2
            return f"CASE WHEN {text} < {text_literal(part[half][0])} THEN {pick(part[:half])} ELSE {pick(part[half:])} END"

        return pick(pairs) if pairs else "CAST(NULL AS INT)"

    @staticmethod
    def _word_flag(q: str, s: Step) -> str:
        text = f"CAST({q} AS STRING)"
        yes = ", ".join(map(text_literal, fv.TRUE_WORDS))
        no = ", ".join(map(text_literal, fv.FALSE_WORDS))
        pair = ""
        if s.state["one"] is not None:
            zero, one = text_literal(s.state["zero"]), text_literal(s.state["one"])
            pair = f" WHEN {text} = {zero} THEN 0 WHEN {text} = {one} THEN 1 WHEN {text} IS NOT NULL THEN NULL"
        return f"CASE WHEN lower({text}) IN ({yes}) THEN 1 WHEN lower({text}) IN ({no}) THEN 0{pair} ELSE 0 END"

    @staticmethod
    def _weights(q: str, s: Step) -> str:
        terms = ", ".join(map(text_literal, s.state["terms"]))
        idf = ", ".join(f"{v!r}D" for v in s.state["idf"])
        size = len(s.state["terms"])
        found = f"filter(regexp_extract_all(lower(coalesce({q}, '')), {text_literal(TOKEN_PATTERN)}, 0), t -> t IN ({terms}))"
        # Tokens are the first argument of aggregate(), so they are cut out of the text once per row.
        counts = (
            f"aggregate({found}, array_repeat(0D, {size}), (acc, t) -> "
            f"zip_with(acc, array({terms}), (x, w) -> CASE WHEN w = t THEN x + 1D ELSE x END))"
        )
        return f"zip_with({counts}, array({idf}), (n, i) -> n * i) AS {quoted(f'__w_{s.column}')}"

    def transform(self, df: DataFrame) -> DataFrame:
        return self.as_stage(df).transform(df)

    def as_stage(self, df: DataFrame) -> Transformer:
        """A pipeline stage with the same effect, saved and loaded with the model.

        Columns with very many values get their positions from stored tables ahead of the statement.
        """
        types = kinds(df)
        last = SQLTransformer(statement=self.statement(df.columns, types))
        wide = [s for s in self.steps if s.kind in ("code", "hot_vector") and s.column in df.columns]
        if not wide:
            return last
        code = lambda s: f"__code_{s.column}"
        found = DictionaryLookup(
            texts=[self._shown(quoted(s.column), types[s.column]) for s in wide], outputs=[code(s) for s in wide],
            paths=[s.state["path"] for s in wide], sizes=[s.state["size"] for s in wide],
        )
        hot = [s for s in wide if s.kind == "hot_vector"]
        if not hot:
            return PipelineModel([found, last])
        vectors = one_hot_vectors(df.sparkSession, [code(s) for s in hot], [f"__hot_{s.column}" for s in hot], [s.state["size"] for s in hot])
        return PipelineModel([found, vectors, last])

    # Persisting: one small table.

    def to_params(self, spark) -> DataFrame:
        rows = [(i, s.column, s.kind, json.dumps(dict(s.state))) for i, s in enumerate(self.steps)]
        return spark.createDataFrame(rows, PARAM_SCHEMA)

    @classmethod
    def from_params(cls, params: DataFrame) -> Encoder:
        rows = rows_if_bounded(params.orderBy("position"))
        return cls([Step(r["column_name"], r["kind"], json.loads(r["state"])) for r in rows])

    def column_mapping(self, df: DataFrame, target: str | None = None) -> list[tuple[str, str]]:
        """(original, encoded) name pairs."""
        after = self.transform(df.limit(0)).columns
        pairs = []
        for c in df.columns:
            if c == target:
                continue
            step = next((s for s in self.steps if s.column == c), None)
            if step is None or step.kind in ("scale", "ordinal", "code", "hot_vector", "to_int", "to_double", "text_boolean", "labels"):
                pairs.append((c, c))
            elif step.kind == "one_hot":
                pairs += [(c, f"{c}_{v}") for v in step.state["levels"]]
            else:
                pairs += [(c, a) for a in after if a.startswith(f"{c}_")]
        return pairs

    def describe(self) -> list[dict]:
        return [asdict(s) for s in self.steps]


def fit_encoder(
    df: DataFrame, roles: Mapping[str, str], target: Target | None = None, stop_words: Sequence[str] | None = None,
    terms: int = fv.TFIDF_TERMS, wide_levels: int = MAX_WIDE_LEVELS,
) -> Encoder:
    """Fit every column by its role; columns without a role are left as they are.

    A category with more than `wide_levels` values has the same features, one 0/1 number for each value in
    sorted order, as one sparse vector column: a table cannot have a column for each, a model takes both.
    Levels of such columns are a stored table that no one collects, so their number has no limit; the same
    holds for ordinal codes.
    """
    folded = kinds(df)
    features = {c: r for c, r in roles.items() if c in df.columns and (target is None or c != target.name)}
    of = lambda *wanted: [c for c in df.columns if features.get(c) in wanted]
    steps = {s.column: s for s in _fit_scales(df, of("numeric-continuous", "numeric-discrete"))}
    nominal, ordinal = of("categorical-nominal"), of("categorical-ordinal")
    levels = narrow_levels(df, nominal + ordinal, wide_levels)
    for c in nominal:
        steps[c] = hot_step(df, c, levels)
    for c in ordinal:
        steps[c] = Step(c, "ordinal", {"levels": levels[c]}) if c in levels else wide_step(df, c, "code")
    for c in of("boolean"):
        steps[c] = text_boolean(df, c) if folded[c] == "str" else Step(c, "to_int")
    for c in of("datetime"):
        steps[c] = Step(c, "datetime")
    for c in of("text"):
        steps[c] = fit_tfidf(df.select(col(c).cast("string").alias(c)), c, terms, stop_words)
    for c in of("identifier_ignore"):
        steps[c] = Step(c, "drop")
    if target is not None and target.name in df.columns:
        steps[target.name] = fit_target(df, target)
    return Encoder([steps[c] for c in df.columns if c in steps])
