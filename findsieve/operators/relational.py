"""Small relational operators that many jobs share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of every key by ``order``; null keys make one group.

    Spark keeps only first rows of each task before the shuffle, so a common key costs little.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(by)).where("_nth = 1").drop("_nth")


def absent(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` whose key ``known`` does not have."""
    return df.join(known.select(*keys), keys, "left_anti")
