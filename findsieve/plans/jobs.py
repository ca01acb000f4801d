"""The compositions a user calls: whole jobs over landed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findsieve.functions import severity
from findsieve.operators import catalogs, inventory, relational, reports, suppression
from findsieve.plans import adjudicate as A
from findsieve.sources import landing
from findsieve.sources.report_sink import write_named
from findsieve.sources.scratch import materialise


def advisory_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """docs, pids, products, relationships, nofix and vendor_wide of ``landing.read_advisories``, all by cve."""
    v, first = F.col("vulnerabilities"), F.get("vulnerabilities", 0)
    impact = lambda entry: F.get(F.filter(entry["threats"], lambda t: (t["category"] == "impact") & (F.coalesce(t["details"], F.lit("")) != "")), 0)["details"]
    base = F.flatten(F.transform(v, lambda x: F.coalesce(F.transform(x["scores"], lambda s: F.coalesce(s["cvss_v3"]["baseSeverity"], s["cvss_v2"]["baseSeverity"])), F.array().cast("array<string>"))))
    facts = docs.select(
        "cve", F.size(F.coalesce("vulnerabilities", F.array().cast(docs.schema["vulnerabilities"].dataType))).alias("n_vulns"),
        impact(first).alias("impact"), F.get(F.filter(F.transform(v, impact), lambda x, i: (i > 0) & x.isNotNull()), 0).alias("later_impact"), F.col("document.aggregate_severity.text").alias("aggregate_severity"),
        F.get(F.filter(base, lambda b: F.coalesce(b, F.lit("")) != ""), 0).alias("cvss_severity"),
    )
    stated = landing.status_rows(docs).withColumns({"flag_label": F.lit(None).cast("string"), "flag_idx": F.lit(0)})
    flags = landing.flag_rows(docs).withColumn("status", F.lit("flag"))
    return {
        "docs": facts,
        "pids": stated.unionByName(flags),
        "products": landing.product_rows(docs),
        "relationships": landing.relationship_rows(docs),
        "nofix": landing.no_fix_rows(docs),
        "vendor_wide": landing.vendor_wide_rows(docs),
    }


def known_images(findings: DataFrame, images: DataFrame | None) -> DataFrame:
    """Every image of ``findings`` with what ``images`` (as ``A.image_facts`` takes it) says of it; the first row of an image counts."""
    refs = findings.select(F.coalesce("IMAGE", F.lit("")).alias("IMAGE")).distinct()
    if images is None:
        return refs
    first = relational.keep_first(images, ["IMAGE"], "pos") if "pos" in images.columns else images.dropDuplicates(["IMAGE"])
    return refs.join(first.drop("pos"), "IMAGE", "left")


def adjudicate_findings(findings: DataFrame, advisories: DataFrame, prefix_map: DataFrame, src_map: DataFrame | None = None, images: DataFrame | None = None, **options) -> DataFrame:
    """Verdicts on ``findings`` (finding_id, IMAGE, ...) from advisory documents.

    ``images``: what scanners say of images, as ``landing.scanned_images`` or ``landing.matched_images`` give it; others are known by their references.
    """
    # Read once: a dozen branches of the plan read documents, which are many small files of JSON.
    t = advisory_tables(materialise(advisories.select("cve", "document", "product_tree", "vulnerabilities"), "advisories"))
    parsed = A.parse_pids(t["pids"], t["products"], t["relationships"], t["vendor_wide"])
    return A.adjudicate(findings, A.contexts(known_images(findings, images), prefix_map), t["docs"], parsed, t["nofix"], src_map, **options)


def adjudicate_release(manifest: DataFrame, findings: DataFrame, advisories: DataFrame, prefix_map: DataFrame, images: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Verdicts on the findings of a release's images in the order of its manifest, and how many there are of each kind in how many components.

    ``manifest``: release, component, image, digest and pos of ``landing.read_manifest``; ``images``: their labels and operating systems.  All images of
    a release are of the platform in its version, whatever their references or labels say.
    """
    listed = manifest.select(F.col("image").alias("IMAGE"), "release", F.col("component").alias("component"), "pos")
    listed = materialise(relational.keep_first(listed, ["IMAGE"], "pos"), "listed")  # its size is known then, so findings need no shuffle to meet a short list
    facts = listed if images is None else listed.join(images.drop("pos", "release", "component").dropDuplicates(["IMAGE"]), "IMAGE", "left")
    verdicts = adjudicate_findings(findings.join(listed.select("IMAGE"), "IMAGE", "left_semi"), advisories, prefix_map, images=facts, **options)
    rows = verdicts.join(listed.select("IMAGE", F.col("component").alias("OCP_COMPONENT"), "pos"), "IMAGE")
    return rows.orderBy("pos", A.sort_score(), "CVE", "COMPONENT", "VERSION"), reports.verdict_counts(rows, "OCP_COMPONENT")


def adjudicate_namespace(
    listed: DataFrame, findings: DataFrame, advisories: DataFrame, prefix_map: DataFrame, false_only: bool = False, images: DataFrame | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """Verdicts on a namespace's images in the order of their listing, and how many there are of each kind in how many images.

    ``listed``: id, name and pos of ``landing.listed_images``; the first of a name counts.  ``images``: their labels.
    """
    own = materialise(relational.keep_first(listed.where("name <> ''"), ["name"], "pos").select(F.col("name").alias("IMAGE"), "pos"), "listed")
    verdicts = adjudicate_findings(findings.join(own.select("IMAGE"), "IMAGE", "left_semi"), advisories, prefix_map, images=images, **options)
    rows = verdicts.join(own, "IMAGE")
    rows = rows.where(F.col("AUDIT_RESULT") == A.FP) if false_only else rows
    return rows.orderBy("pos", A.sort_score(), "CVE", "COMPONENT", "VERSION"), reports.verdict_counts(rows, "IMAGE")


def catalog_index(objects: DataFrame, operators: str = "") -> DataFrame:
    """ocp_version, package, channel, is_default, bundle, image: every channel's head bundle of ``landing.read_catalog``'s objects."""
    get = lambda path, kind="string": F.try_variant_get("object", path, kind)
    objects = objects.withColumn("ocp_version", landing.catalog_version(F.col("source_file")))
    packages = objects.where("schema = 'olm.package'").select("ocp_version", get("$.name").alias("name"), get("$.defaultChannel").alias("default_channel"))
    channels = objects.where("schema = 'olm.channel'").select(
        "ocp_version", get("$.package").alias("package"), get("$.name").alias("channel"), F.posexplode(get("$.entries", "array<struct<name:string,replaces:string,skips:array<string>>>")).alias("pos", "e")
    )
    bundles = objects.where("schema = 'olm.bundle'").select("ocp_version", get("$.name").alias("name"), get("$.image").alias("image"))
    # Releases don't mix: package names are made those of one release.
    of = lambda df, c: df.withColumn(c, F.concat("ocp_version", F.lit("/"), c))
    edges = channels.select("ocp_version", "package", "channel", F.explode(F.concat(F.array("e.replaces"), F.coalesce("e.skips", F.array().cast("array<string>")))).alias("name"))
    entries = of(of(channels.select("ocp_version", "package", "channel", F.col("e.name").alias("name"), "pos"), "package"), "name")
    heads = catalogs.channel_heads(entries, of(of(edges, "package"), "name"))
    out = catalogs.operator_index(heads, of(bundles, "name"), of(packages, "name"))
    rest = lambda c: F.regexp_replace(c, "^[^/]*/", "")
    out = out.withColumns({"ocp_version": F.split_part("package", F.lit("/"), F.lit(1)), "package": rest("package"), "bundle": rest("bundle")})
    return catalogs.choose_operators(out, operators).select("ocp_version", "package", "channel", "is_default", "bundle", "image")


BUNDLE = ["ocp_version", "package", "channel", "is_default", "bundle_version"]


def bundle_images(objects: DataFrame, operators: str = "") -> DataFrame:
    """BUNDLE, role and IMAGE of the workload images of every channel's head bundle; null images where a bundle has none.

    A bundle's images are those of its own release, as catalogs of several releases hold bundles of one name.
    """
    versioned = objects.withColumn("ocp_version", landing.catalog_version(F.col("source_file")))
    related = catalogs.workload_images(landing.related_images(versioned, "ocp_version").distinct(), "ocp_version")
    index = catalog_index(objects, operators).withColumn("bundle_version", catalogs.bundle_version(F.col("bundle"), F.col("package")))
    return index.drop("image").join(related, ["ocp_version", "bundle"], "left").select(*BUNDLE, "role", F.col("image").alias("IMAGE")).distinct()


def adjudicate_operators(
    objects: DataFrame, findings: DataFrame, advisories: DataFrame, prefix_map: DataFrame, operators: str = "", images: DataFrame | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """Verdicts on the workload images of every channel's head bundle, with BUNDLE and role, and a summary of each bundle.

    ``objects``: ``landing.read_catalog``; ``operators``: names by commas, all if empty; ``images``: labels of images.
    """
    lineage = materialise(bundle_images(objects, operators), "bundle-images")
    wanted = findings.join(lineage.select("IMAGE").distinct(), "IMAGE", "left_semi")
    rows = materialise(adjudicate_findings(wanted, advisories, prefix_map, images=images, **options).join(lineage.where("IMAGE IS NOT NULL"), "IMAGE"), "operator-verdicts")
    return rows, reports.bundle_summary(lineage, rows, BUNDLE)


def write_operator_reports(verdicts: DataFrame, path: str) -> None:
    """Reports of release, operator, channel and bundle version as files ``ocp-{release}/{operator}-{channel}-{version}.csv``.

    A report that is there is replaced, others stay; see ``write_named``.
    """
    key = catalogs.report_key(*[F.col(c) for c in ("ocp_version", "package", "channel", "bundle_version")])
    columns = [c for c in verdicts.columns if c not in BUNDLE]
    named = verdicts.select(F.concat(key, F.lit(".csv")).alias("file"), *columns)
    write_named(named, path, "file", A.sort_score(), "CVE", "COMPONENT", "VERSION", "IMAGE")


def write_results(results: DataFrame, path: str, form: str = "csv") -> None:
    """Results as CSV with a header or as JSON lines."""
    (results.write.option("header", True).csv if form == "csv" else results.write.json)(path)


def consolidate_reports(spark: SparkSession, source: str, target: str, file_bytes: int = reports.FILE_BYTES) -> DataFrame:
    """All reports below ``source`` as one Parquet corpus, of one file for each ``file_bytes`` of reports."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv*").load(source)
    size = listed.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    reports.write_corpus(landing.clean_reports(landing.read_reports(spark, source)), target, max(1, -(-size // file_bytes)))
    return spark.read.parquet(target)


def search_reports(corpus: DataFrame, text: str, chosen: dict[str, list[str]] | None = None, mismatches_only: bool = False, facets: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that are found and chosen, the cards of these, and the counts of ``facets`` among all that are found."""
    found = reports.search(corpus, text)
    rows = reports.facet_filter(found, chosen or {}, mismatches_only)
    return rows, reports.cards(rows), reports.facet_counts(found, list(facets) or [c for c in reports.FACETS if c in corpus.columns])


def build_prefix_map(objects: DataFrame, path: str) -> DataFrame:
    """The prefix map of all catalogs' bundles as one JSON object, keys and prefixes sorted; returned as rows (ns_key, prefixes).

    The file is one object by its format; it has an entry for each namespace of images.
    """
    table = catalogs.prefix_table(landing.named_bundles(objects))
    whole = F.map_from_entries(F.array_sort(F.collect_list(F.struct("ns_key", "prefixes"))))
    table.agg(F.to_json(whole).alias("value")).write.text(path)
    parsed = F.from_json("value", "map<string,array<string>>")
    return objects.sparkSession.read.text(path).select(F.explode(parsed).alias("ns_key", "prefixes"))


def plan_suppressions(report_rows: DataFrame, images: DataFrame, alerts: DataFrame, policies: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The plan, written as Parquet, and its totals; nothing is applied."""
    index, running = materialise(suppression.fp_index(report_rows), "fp-index"), materialise(suppression.deployed(images), "running")
    suppression.suppression_plan(index, running, alerts, policies).write.parquet(path)
    plan = report_rows.sparkSession.read.parquet(path)
    return plan, suppression.suppression_totals(plan, running, index)


def missed_findings(packages: DataFrame, affected: DataFrame, reported: DataFrame, docs: DataFrame | None = None, least: str = "Low") -> DataFrame:
    """The summary of gaps; with ``docs`` (cve and its severity parts) only of advisories of at least the severity ``least``."""
    if docs is not None:
        stated = severity.vex_severity(*[F.col(c) for c in ("impact", "aggregate_severity", "later_impact", "cvss_severity")], F.lit("Unknown"))
        affected = affected.join(docs.where(severity.severity_rank(stated) <= severity.RANK[least]).select("cve"), "cve", "left_semi")
    return inventory.gap_summary(packages, affected, reported)


def pending(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """Reports still to be made: neither there nor to be reused from another release."""
    rest = relational.absent(expected, existing, ["release", "report_key"])
    return relational.absent(rest, inventory.reuse_reports(expected, existing), ["release", "report_key"])
