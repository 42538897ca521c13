"""Intermediate tables in the shared folder that go once they are used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import materialize, new_path, remove


class Scratch:
    """Tables that one computation writes and reads again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read back."""
        path = new_path(self.spark, name)
        self.paths.append(path)
        return materialize(df, name, path)

    def drop(self) -> None:
        """Delete all tables: nothing that is still to be computed may read them."""
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []
