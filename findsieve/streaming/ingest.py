"""Incremental landing: new files since the last run, each read once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from findsieve.sources import landing


def ingest_scans(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Flatten scan documents (JSON lines) that arrived below ``source`` into the findings table ``target``; then stop.

    The checkpoint remembers the files that were read, so a run after a failure neither skips nor repeats any.
    """
    docs = spark.readStream.schema(landing.SCAN).json(source)
    rows = landing.flatten_scans(docs, "id")
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_reports(spark: SparkSession, schema: str, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Add report CSVs that arrived below ``source`` to the corpus, cleaned, with ``source_file``.

    Every batch has a folder of its own below ``target``, which a batch that is run again writes anew.
    """

    def clean(batch: DataFrame, number: int) -> None:
        landing.clean_reports(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(source).withColumn("source_file", F.col("_metadata.file_path"))
    return rows.writeStream.foreachBatch(clean).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
