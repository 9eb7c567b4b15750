"""Categories of any size inside a pipeline: levels are a stored table, never a list.

`DictionaryLookup` joins rows to the tables of (text, position, n): a small table is broadcast after its
rows were counted, a larger one is joined by shuffle with its heaviest values salted (`sizing.lookup`).
A position then becomes a sparse 0/1 vector with one place for each value, in sorted order; a NULL or
unseen value has no 1 anywhere.  Nothing is collected, whatever the number of values.  Saving a pipeline
copies the tables into it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import OneHotEncoderModel
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.sizing import lookup, new_path
from .importance import label_codes

LEVELS = "text string, position int, n long"


def write_levels(df: DataFrame, column: str, text: str) -> tuple[str, int]:
    """(path of the level table, number of levels); `text` is the SQL text that shows the column's value."""
    path = new_path(df.sparkSession, "levels")
    codes = label_codes(df, column).withColumnRenamed("value", column)
    codes.select(F.expr(text).alias("text"), F.col("code").alias("position"), "n").write.parquet(path)
    return path, df.sparkSession.read.schema(LEVELS).parquet(path).count()


class DictionaryLookup(Transformer, MLWritable, MLReadable):
    """Adds `outputs`: the position of each text among the levels at `paths`, the number of levels if there is none."""

    texts = Param(Params._dummy(), "texts", "SQL of the texts to look up", TypeConverters.toListString)
    outputs = Param(Params._dummy(), "outputs", "names of the position columns", TypeConverters.toListString)
    paths = Param(Params._dummy(), "paths", "folders of the level tables", TypeConverters.toListString)
    sizes = Param(Params._dummy(), "sizes", "numbers of levels", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, texts: Sequence[str] = (), outputs: Sequence[str] = (), paths: Sequence[str] = (), sizes: Sequence[int] = ()):
        super().__init__()
        self._set(texts=list(texts), outputs=list(outputs), paths=list(paths), sizes=list(sizes))

    def _transform(self, df: DataFrame) -> DataFrame:
        columns = df.columns
        for text, name, path, size in zip(*[self.getOrDefault(p) for p in ("texts", "outputs", "paths", "sizes")]):
            levels = df.sparkSession.read.schema(LEVELS).parquet(path).select(F.col("text").alias("__text"), F.col("position").alias(name), "n")
            df = lookup(df.withColumn("__text", F.expr(text)), levels, "__text", weight="n").drop("__text")
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(size)).cast("double"))
            columns = [*columns, name]
        return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in columns])

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        for i, levels in enumerate(self.instance.getOrDefault("paths")):
            spark.read.schema(LEVELS).parquet(levels).write.parquet(f"{path}/levels-{i}")
        super().saveImpl(path)


class _Reader(DefaultParamsReader):
    def load(self, path: str) -> DictionaryLookup:
        stage = super().load(path)
        return stage._set(paths=[f"{path}/levels-{i}" for i in range(len(stage.getOrDefault("paths")))])


def one_hot_vectors(spark: SparkSession, inputs: Sequence[str], outputs: Sequence[str], sizes: Sequence[int]) -> OneHotEncoderModel:
    """Sparse 0/1 vectors of positions; a position beyond the size gives zeros only."""
    gateway = spark.sparkContext._gateway
    held = gateway.new_array(gateway.jvm.int, len(sizes))
    for i, n in enumerate(sizes):
        held[i] = n
    made = spark._jvm.org.apache.spark.ml.feature.OneHotEncoderModel("dictionary_" + "_".join(map(str, sizes)), held)
    model = OneHotEncoderModel(made)
    return model.setInputCols(list(inputs)).setOutputCols(list(outputs)).setHandleInvalid("keep").setDropLast(True)
