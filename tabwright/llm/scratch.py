"""Named tables of one run in the shared folder, each deleted when its successor is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabwright.functions.sizing import new_path, remove_path


class Scratch:
    """Tables by name; `clear` deletes all that is left."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write `df` as Parquet and read it back; an older table of that name is deleted after that."""
        path = new_path(self.spark, name)
        df.write.parquet(path)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            remove_path(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                remove_path(self.spark, self.paths.pop(name))

    def clear(self) -> None:
        self.drop(*list(self.paths))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever they are called."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])
