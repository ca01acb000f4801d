"""Operator catalogs: channel heads, the operator index, workload images, names and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findsieve.functions.images import digest
from findsieve.operators.relational import keep_first

# Fixed value: vendor words before a product's own name.
VENDOR = r"(?i)^(red\s+hat\s+integration\s*[-–]\s*|red\s+hat\s+openshift\s+|red\s+hat\s+build\s+of\s+|red\s+hat\s+|redhat\s+)"


def channel_heads(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """package, channel, head: the greatest name that nothing replaces or skips, else the last entry's.

    ``entries``: package, channel, name, pos; ``edges``: package, channel, name (what an entry points to).
    """
    keys = ["package", "channel"]
    pointed = edges.where("name IS NOT NULL").select(*keys, "name").distinct().withColumn("pointed", F.lit(True))
    marked = entries.join(pointed, [*keys, "name"], "left")
    free = F.max(F.when(F.col("pointed").isNull(), F.col("name")))
    return marked.groupBy(*keys).agg(F.coalesce(free, F.max_by("name", "pos")).alias("head"))


def operator_index(heads: DataFrame, bundles: DataFrame, packages: DataFrame) -> DataFrame:
    """Channels with a resolvable head bundle: package, channel, is_default, bundle, image."""
    named = heads.join(bundles.select(F.col("name").alias("head"), "image"), "head")
    default = packages.select(F.col("name").alias("package"), "default_channel")
    out = named.join(default, "package", "left").withColumn("is_default", F.coalesce(F.col("channel") == F.col("default_channel"), F.lit(False)))
    return out.select("package", "channel", "is_default", F.col("head").alias("bundle"), "image")


def choose_operators(index: DataFrame, operators: str = "", versions: str = "") -> DataFrame:
    """The rows of ``index`` (package, and ocp_version if versions are given) that comma-separated lists name; an empty list takes all."""
    for column, listed in (("package", operators), ("ocp_version", versions)):
        names = [x.strip() for x in listed.split(",") if x.strip()]
        if names:
            index = index.where(F.col(column).isin(names))
    return index


def bundle_version(bundle: Column, package: Column) -> Column:
    """From the first ``.vN``, else without the package's name, else the whole."""
    at = F.regexp_extract(bundle, r"^.*?\.(v\d.*)$", 1)
    prefix = F.concat(package, F.lit("."))
    return F.when(at != "", at).when(F.startswith(bundle, prefix), F.substring(bundle, F.length(prefix) + 1, F.length(bundle))).otherwise(bundle)


def report_key(release: Column, package: Column, channel: Column, version: Column) -> Column:
    safe = lambda c: F.regexp_replace(c, r'[/\\:*?"<>|]', "_")
    return F.concat(F.lit("ocp-"), release, F.lit("/"), package, F.lit("-"), safe(channel), F.lit("-"), safe(version))


def workload_images(related: DataFrame, *keys: str) -> DataFrame:
    """``keys``, bundle, pos, role, image of related images: no bundle image, the first of each digest, all without digest.

    ``related``: bundle, bundle_image, pos, role, image, and ``keys``, which tell bundles of one name apart (a catalog's release).
    """
    sha, own = digest(F.col("image")), digest(F.col("bundle_image"))
    rows = related.withColumn("sha", sha).where(own.isNull() | sha.isNull() | (sha != own))
    first = keep_first(rows.where("sha IS NOT NULL"), [*keys, "bundle", "sha"], "pos")
    return first.unionByName(rows.where("sha IS NULL")).select(*keys, "bundle", "pos", "role", "image")


def snake(text: Column) -> Column:
    plain = F.lower(F.regexp_replace(text, r"\s*\(.*?\)", ""))
    return F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def name_candidates(text: Column) -> Column:
    """Sorted snake_case forms of a display name: whole, without the vendor, each without trailing versions."""
    full = F.trim(F.coalesce(text, F.lit("")))
    forms = F.array(snake(full), snake(F.trim(F.regexp_replace(full, VENDOR, ""))))
    short = F.transform(forms, lambda c: F.regexp_replace(F.regexp_replace(c, r"(_\d[\d.x]*)+$", ""), r"^_+|_+$", ""))
    return F.array_sort(F.array_distinct(F.filter(F.concat(forms, short), lambda c: c != "")))


def prefix_table(names: DataFrame) -> DataFrame:
    """ns_key and sorted distinct prefixes from (ns_key, package, display_name) of bundles of all catalogs."""
    all_of = F.array_distinct(F.concat(name_candidates(F.col("package")), name_candidates(F.col("display_name"))))
    return names.select("ns_key", F.explode(all_of).alias("prefix")).groupBy("ns_key").agg(F.array_sort(F.collect_set("prefix")).alias("prefixes"))
