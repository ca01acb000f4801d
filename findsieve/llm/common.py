"""What the training-data operators share: reading tables, cutting lineage, small expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space; everything else is part of a word.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the cluster names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def named(column: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs a reread."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body`` over ``value`` computed once for each row (a lambda variable is never inlined)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text, in order; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def held_out_remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def with_base(sums: DataFrame, keys: list[str], width: int = 4096) -> DataFrame:
    """``keys``, grp and ``base``, the sum of ``n`` over the lower groups (grp long, from 0) of the same keys.

    Groups are added up by ``width``, so that no task orders more rows than that or their number by ``width``.
    """
    blocks = sums.withColumn("block", F.expr(f"grp div {width}"))
    above = blocks.groupBy(*keys, "block").agg(F.sum("n").alias("block_n"))
    before = lambda by, order, n: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = above.select(*keys, "block", before(keys, "block", "block_n").alias("block_base"))
    inside = blocks.select(*keys, "block", "grp", before([*keys, "block"], "grp", "n").alias("inside"))
    return inside.join(above, [*keys, "block"]).select(*keys, "grp", (F.col("block_base") + F.col("inside")).alias("base"))
