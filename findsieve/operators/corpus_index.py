"""What is kept beside a report corpus: which file holds which pieces of text, and summaries of files that add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findsieve.operators import reports
from findsieve.operators.matching import pieces

#: Length of indexed pieces; shorter texts are sought in all files.
PIECE = 3
#: Folders of the index; a search reads those of its pieces.
BUCKETS = 64
FILE = "_metadata.file_path"


def _bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")


def build_search_index(spark: SparkSession, corpus: str, index: str) -> None:
    """Posting lists (column, piece, file) of the searched columns of the Parquet files below ``corpus``."""
    rows = spark.read.parquet(corpus)
    columns = [c for c in reports.SEARCHED if c in rows.columns]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lower(F.col(c)).alias("text")) for c in columns])).alias("cell")
    # Values repeat from row to row, so each is cut up once a file.
    values = rows.select(F.col(FILE).alias("file"), cells).select("file", "cell.*").where("text IS NOT NULL").distinct()
    posted = values.select("column", F.explode(pieces(F.col("text"), PIECE)).alias("piece"), "file").distinct().withColumn("bucket", _bucket(F.col("piece")))
    posted.repartition("bucket").sortWithinPartitions("piece").write.mode("overwrite").partitionBy("bucket").parquet(index)


def files_with(spark: SparkSession, index: str, columns: list[str], text: str) -> DataFrame:
    """``file`` of those in which one of ``columns`` has all pieces of ``text``; a file that holds the text is among them."""
    asked = sorted({text[i : i + PIECE] for i in range(len(text) - PIECE + 1)})
    wanted = spark.createDataFrame([(p,) for p in asked], "piece string")
    buckets = [r["b"] for r in wanted.select(_bucket(F.col("piece")).alias("b")).distinct().collect()]
    posted = spark.read.schema("column STRING, piece STRING, file STRING, bucket INT").parquet(index)
    hits = posted.where(F.col("bucket").isin(buckets) & F.col("piece").isin(asked) & F.col("column").isin(columns))
    return hits.groupBy("column", "file").agg(F.countDistinct("piece").alias("n")).where(F.col("n") == len(asked)).select("file").distinct()


def search(spark: SparkSession, corpus: str, index: str, text: str) -> DataFrame:
    """``reports.search`` over the corpus, reading only files that can hold the text."""
    want, rows = text.strip().lower(), spark.read.parquet(corpus)
    if len(want) < PIECE:
        return reports.search(rows, text)
    columns = ["CVE"] if reports.names_cve(want) else [c for c in reports.SEARCHED if c in rows.columns]
    # Names of files, as many as the reader would list.
    files = [r["file"] for r in files_with(spark, index, columns, want).collect()]
    return reports.search(spark.read.schema(rows.schema).parquet(*files) if files else rows.limit(0), text)


def write_summaries(spark: SparkSession, corpus: str, target: str, facets: tuple[str, ...] = reports.FACETS) -> None:
    """A row for each file of ``corpus``: rows, mismatches and sketches of images and packages; and counts of each value of ``facets`` in it."""
    rows = spark.read.parquet(corpus).withColumn("file", F.col(FILE))
    facets = tuple(c for c in facets if c in rows.columns)
    cards = rows.groupBy("file").agg(F.count(F.lit(1)).alias("total"), F.count_if("SEVERITY_MISMATCH").alias("mismatches"), F.hll_sketch_agg("IMAGE").alias("images"), F.hll_sketch_agg("COMPONENT").alias("packages"))
    cards.write.mode("overwrite").parquet(f"{target}/cards")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in facets])).alias("cell")
    rows.select("file", cells).groupBy("file", "cell.facet", "cell.value").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{target}/facets")


def cards(spark: SparkSession, target: str, files: DataFrame | None = None) -> DataFrame:
    """``reports.cards`` from summaries, of all files or of ``files``: rows and mismatches exact, images and packages with a standard error of 1.6 per cent."""
    rows = spark.read.parquet(f"{target}/cards")
    rows = rows if files is None else rows.join(files, "file", "left_semi")
    distinct = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.agg(total("total"), distinct("images"), distinct("packages"), total("mismatches"))


def facet_counts(spark: SparkSession, target: str, files: DataFrame | None = None) -> DataFrame:
    """facet, value, n from summaries, exact, of all files or of ``files``."""
    rows = spark.read.parquet(f"{target}/facets")
    rows = rows if files is None else rows.join(files, "file", "left_semi")
    return rows.groupBy("facet", "value").agg(F.sum("n").alias("n"))
