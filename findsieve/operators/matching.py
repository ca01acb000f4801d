"""Many patterns at once: which texts contain which patterns, by equality of pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The longest piece by which patterns are looked up.
LONGEST_PIECE = 32


def pieces(text: Column, length: int) -> Column:
    """The distinct substrings of ``length`` characters; the empty one for length 0."""
    if not length:
        return F.array(F.lit(""))
    some = F.transform(F.sequence(F.lit(1), F.length(text) - (length - 1)), lambda i: F.substring(text, i, F.lit(length)))
    return F.when(F.length(text) >= length, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text, pattern: every distinct ``text`` with each distinct ``pattern`` that it contains; nulls meet nothing.

    A pattern is looked up by its end, as long as a power of two allows; each text is read once and cut into pieces of these few
    lengths, which meet the patterns by equality, so a text costs the same however many patterns there are.
    """
    known = patterns.select("pattern").where("pattern IS NOT NULL").distinct()
    n = F.length("pattern")
    size = F.when(n == 0, F.lit(0))
    for k in range(LONGEST_PIECE.bit_length()):
        size = size.when((n < 2 ** (k + 1)) | (2**k == LONGEST_PIECE), F.lit(2**k))
    known = known.select("pattern", size.alias("size")).withColumn("piece", F.right("pattern", F.col("size")))
    sizes = [r["size"] for r in known.select("size").distinct().collect()]  # eight numbers at most
    cut = F.concat(*[pieces(F.col("text"), s) for s in sorted(sizes)]) if sizes else F.array().cast("array<string>")
    parts = texts.select("text").where("text IS NOT NULL").distinct().select("text", F.explode(cut).alias("piece"))
    return parts.join(known.select("pattern", "piece"), "piece").where(F.contains("text", F.col("pattern"))).select("text", "pattern")
