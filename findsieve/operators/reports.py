"""The consolidated report corpus: facets, search and totals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that are searched, numbers that are sought as a CVE's, words that channels begin with.
SEARCHED = ("CVE", "COMPONENT", "OCP_COMPONENT", "IMAGE")
CVE_NUMBER = r"(?:\d{4}-)?\d+"
CHANNEL_WORDS = ("stable", "fast", "candidate", "latest", "preview", "alpha", "beta", "release", "gitops", "pipelines", "tech-preview", "v")


#: Columns of a result, in order.
RESULT = ("COMPONENT", "VEX_PRODUCT", "VERSION", "CVE", "SEVERITY", "AUDIT_RESULT", "VEX_FIX_VER", "JUSTIFICATION", "RHACS_SEVERITY", "SEVERITY_MISMATCH")
FALSE_POSITIVE = "FALSE POSITIVE"
#: Columns that searches are narrowed by.
FACETS = ("release", "operator", "channel", "VERSION", "SEVERITY", "RHACS_SEVERITY", "AUDIT_RESULT", "image_base")


def result_columns(rows: DataFrame, false_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and the columns of a result; those that ``rows`` lacks are null text.  ``false_only`` keeps false positives alone."""
    out = rows.select(*keep, *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in RESULT])
    return out.where(F.contains("AUDIT_RESULT", F.lit(FALSE_POSITIVE))) if false_only else out


def verdict_counts(verdicts: DataFrame, of: str) -> DataFrame:
    """AUDIT_RESULT, n and the number of distinct values of ``of`` (images, components) that have it."""
    return verdicts.groupBy("AUDIT_RESULT").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(of).alias(f"{of.lower()}s"))


def bundle_summary(bundles: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Per bundle (``keys``): workload images, those with findings, positives, false positives, whether it has no images at all.

    ``bundles``: keys and IMAGE, null for a bundle without workload images; ``verdicts``: keys, IMAGE, AUDIT_RESULT.
    """
    whole = bundles.groupBy(*keys).agg(F.countDistinct("IMAGE").alias("images"))
    kind = F.col("AUDIT_RESULT")
    found = verdicts.groupBy(*keys).agg(F.countDistinct("IMAGE").alias("found"), F.count_if(kind == "POSITIVE").alias("vulnerable"), F.count_if(kind == FALSE_POSITIVE).alias("false_positive"))
    out = whole.join(found, keys, "left").na.fill(0, ["found", "vulnerable", "false_positive"])
    return out.withColumn("skipped", F.col("images") == 0)


def facets(path: Column, image: Column) -> dict[str, Column]:
    """release, operator, channel and bundle_version from a report's path, image_base without its digest.

    A report is ``ocp-{release}/{operator}-{channel}-{bundle_version}.csv``; channels and operators may hold dashes.  The version begins at the
    last dash before ``v`` and a digit, else at the last dash; the channel is known by its usual first word, else it is what follows the next dash.
    A ``channel=`` folder, as partitioned tables have, names the channel itself.
    """
    file = F.regexp_replace(F.try_url_decode(F.substring_index(path, "/", -1)), r"\.csv.*$", "")
    versioned = r"^(.+)-(v\d[^-]*(?:-.*)?)$"
    rest = F.when(file.rlike(versioned), F.regexp_extract(file, versioned, 1)).otherwise(F.regexp_replace(file, r"-[^-]*$", ""))
    usual = rf"^(.+?)-((?:{'|'.join(CHANNEL_WORDS)})(?:[-_.].*)?)$"
    simple = r"^(.*)-([^-]+)$"
    pattern = lambda i: F.when(rest.rlike(usual), F.regexp_extract(rest, usual, i)).otherwise(F.regexp_extract(rest, simple, i))
    of_reports = F.regexp_like(path, F.lit(r"ocp-\d+\.\d+/[^/]+\.csv$"))
    none = F.lit("")
    return {
        "release": F.regexp_extract(path, r"ocp-(\d+\.\d+)", 1),
        "operator": F.when(of_reports, pattern(1)).otherwise(none),
        "channel": F.when(F.contains(path, F.lit("channel=")), F.regexp_extract(path, r"channel=([^/]+)", 1)).when(of_reports, pattern(2)).otherwise(none),
        "bundle_version": F.when(of_reports, F.substring(file, F.length(rest) + 2, F.length(file))).otherwise(none),
        "image_base": F.regexp_replace(image, r"@sha256:.*$", ""),
    }


def names_cve(want: str) -> bool:
    """Whether lower-case text looks like a CVE or the number of one."""
    return want.startswith("cve-") or re.fullmatch(CVE_NUMBER, want) is not None


def search(reports: DataFrame, text: str) -> DataFrame:
    """Rows that contain ``text``; text that looks like a CVE, or the number of one, is sought among identifiers alone."""
    want = text.strip().lower()
    if not want:
        return reports
    cols = ["CVE"] if names_cve(want) else [c for c in SEARCHED if c in reports.columns]
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(want))
    return reports.where(hit)


def facet_filter(reports: DataFrame, chosen: dict[str, list[str]], mismatches_only: bool = False) -> DataFrame:
    """Rows that have one of the chosen values in every column that has any."""
    for column, values in chosen.items():
        if values:
            reports = reports.where(F.col(column).isin(values))
    return reports.where("SEVERITY_MISMATCH") if mismatches_only else reports


def cards(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("IMAGE").alias("images"), F.countDistinct("COMPONENT").alias("packages"), F.count_if("SEVERITY_MISMATCH").alias("mismatches")
    )


def facet_counts(reports: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n for every value of every column, in one aggregation over grouping sets."""
    sets = reports.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    n = len(columns)
    which = [(2**n - 1) - 2 ** (n - 1 - i) for i in range(n)]
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c, gid in zip(columns, which, strict=True):
        facet = F.when(F.col("gid") == gid, F.lit(c)).otherwise(facet)
        value = F.when(F.col("gid") == gid, F.col(c)).otherwise(value)
    return sets.select(facet.alias("facet"), value.alias("value"), "n")


#: Bytes of reports that make a file of the corpus, in which they take about a tenth.
FILE_BYTES = 1 << 30


#: Rows that make a file of the corpus where their bytes aren't known.
FILE_ROWS = 1_000_000


def write_corpus(reports: DataFrame, path: str, files: int) -> None:
    """One Parquet table of ``files`` files in ranges of CVE, so that row-group statistics prune searches; Bloom filters tell which hold a CVE or an image."""
    out = reports.repartitionByRange(files, "CVE").sortWithinPartitions("CVE").write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9")
    for column in ("CVE", "IMAGE"):
        out = out.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{column}", "true")
    out.parquet(path)
