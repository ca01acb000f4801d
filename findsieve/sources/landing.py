"""Landed files: scanner exports, manifests, catalogs, advisories, SBOMs and lists of deployed things.

Every reader has a fixed schema; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findsieve.functions import images, severity, versions
from findsieve.operators.relational import keep_first

FINDING = "COMPONENT STRING, VERSION STRING, CVE STRING, SEVERITY STRING, CVSS DOUBLE, LINK STRING, FIXED_VERSION STRING, ADVISORY STRING, ADVISORY_LINK STRING"
SCAN = (
    "id STRING, metadata STRUCT<v1: STRUCT<labels: MAP<STRING,STRING>>>, scan STRUCT<operatingSystem: STRING, scanTime: STRING, components: ARRAY<STRUCT<name: STRING, "
    "version: STRING, source: STRING, fixedBy: STRING, vulns: ARRAY<STRUCT<cve: STRING, severity: STRING, cvss: DOUBLE, link: STRING, fixedBy: STRING>>>>>"
)
MATCHES = (
    "matches ARRAY<STRUCT<vulnerability: STRUCT<id: STRING, severity: STRING, cvss: ARRAY<STRUCT<metrics: STRUCT<baseScore: DOUBLE>>>, fix: STRUCT<versions: ARRAY<STRING>>>, "
    "artifact: STRUCT<name: STRING, version: STRING, type: STRING, metadata: STRUCT<sourceRpm: STRING, source: STRING>>>>, "
    "source STRUCT<target: STRUCT<labels: MAP<STRING,STRING>>>, distro STRUCT<name: STRING, version: STRING>"
)
SPDX = (
    "packages ARRAY<STRUCT<SPDXID: STRING, name: STRING, versionInfo: STRING, primaryPackagePurpose: STRING, packageFileName: STRING>>, "
    "relationships ARRAY<STRUCT<spdxElementId: STRING, relatedSpdxElement: STRING, relationshipType: STRING>>"
)
SYFT = "artifacts ARRAY<STRUCT<name: STRING, version: STRING, type: STRING, purl: STRING>>"
STATUSES = ("known_not_affected", "known_affected", "fixed", "under_investigation")
VEX = (
    "document STRUCT<aggregate_severity: STRUCT<text: STRING>>, product_tree STRUCT<branches: VARIANT, relationships: ARRAY<STRUCT<full_product_name: STRUCT<product_id: STRING>, "
    "relates_to_product_reference: STRING>>>, vulnerabilities ARRAY<STRUCT<product_status: STRUCT<"
    + ", ".join(f"{s}: ARRAY<STRING>" for s in STATUSES)
    + ">, flags: ARRAY<STRUCT<label: STRING, product_ids: ARRAY<STRING>>>, remediations: ARRAY<STRUCT<category: STRING, product_ids: ARRAY<STRING>>>, "
    "threats: ARRAY<STRUCT<category: STRING, details: STRING>>, scores: ARRAY<STRUCT<cvss_v3: STRUCT<baseSeverity: STRING>, cvss_v2: STRUCT<baseSeverity: STRING>>>>>"
)
ARCHIVE = "file STRING, content STRING"
POLICY = "id STRING, name STRING, criteriaLocked BOOLEAN, exclusions ARRAY<STRUCT<name: STRING, image: STRUCT<name: STRING>>>"
# Package types that the matcher is asked for by package URL, the property that names an operator.
OTHER_TYPES = ("python", "go-module", "npm", "gem", "java-archive")
OPERATOR_METADATA = "olm.csv.metadata"
#: Levels of a product tree beyond which a document is taken to be broken, and reading it fails.
DEEPEST = 1000
SECURITY_PAGE = "https://access.redhat.com/security/cve/"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Scanner exports as CSV with a header; missing strings are empty."""
    rows = spark.read.schema(FINDING).option("header", True).csv(path)
    return rows.select(*[_text(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file or one a line, with the path they came from as ``source_file``."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("source_file", F.col("_metadata.file_path"))


def flatten_scans(scans: DataFrame, *keep: str) -> DataFrame:
    """Findings of scan documents: one row per component and vulnerability with an identifier."""
    rows = scans.select(*keep, F.posexplode("scan.components").alias("c_pos", "c")).select(*keep, "c_pos", "c", F.posexplode("c.vulns").alias("v_pos", "v"))
    fix = F.coalesce(F.nullif("v.fixedBy", F.lit("")), F.nullif("c.fixedBy", F.lit("")), F.lit(""))
    out = rows.select(
        *keep, "c_pos", "v_pos", _text(F.col("c.name")).alias("COMPONENT"), _text(F.col("c.version")).alias("VERSION"), F.upper(F.trim(_text(F.col("v.cve")))).alias("CVE"),
        _text(F.col("v.severity")).alias("SEVERITY"), F.coalesce("v.cvss", F.lit(0.0)).alias("CVSS"), _text(F.col("v.link")).alias("LINK"), fix.alias("FIXED_VERSION"),
    )
    return out.where("CVE <> ''")


def scanned_images(scans: DataFrame) -> DataFrame:
    """IMAGE, labels and os_info of scan documents, whose id is the image."""
    return scans.select(F.col("id").alias("IMAGE"), F.col("metadata.v1.labels").alias("labels"), F.col("scan.operatingSystem").alias("os_info"))


def matched_images(docs: DataFrame, image: str = "IMAGE") -> DataFrame:
    """IMAGE, labels, distro and os_info (its name) of matcher documents."""
    return docs.select(F.col(image).alias("IMAGE"), F.col("source.target.labels").alias("labels"), "distro", F.lower("distro.name").alias("os_info"))


def flatten_matches(docs: DataFrame, *keep: str) -> DataFrame:
    """Findings of matcher documents: CVE identifiers only, the first of each (document, CVE, component, version)."""
    rows = docs.select(*keep, F.posexplode("matches").alias("pos", "m"))
    best = F.coalesce(F.array_max(F.transform("m.vulnerability.cvss", lambda x: F.coalesce(x["metrics"]["baseScore"], F.lit(0.0)))), F.lit(0.0))
    cve = F.upper(F.trim(_text(F.col("m.vulnerability.id"))))
    out = rows.select(
        *keep, "pos", _text(F.col("m.artifact.name")).alias("COMPONENT"), _text(F.col("m.artifact.version")).alias("VERSION"), cve.alias("CVE"),
        severity.matcher_severity(F.col("m.vulnerability.severity")).alias("SEVERITY"), best.alias("CVSS"), F.concat(F.lit(SECURITY_PAGE), F.lower(cve)).alias("LINK"),
        F.coalesce(F.get("m.vulnerability.fix.versions", 0), F.lit("")).alias("FIXED_VERSION"),
    )
    return keep_first(out.where(F.startswith(F.col("CVE"), F.lit("CVE-"))), [*keep, "CVE", "COMPONENT", "VERSION"], "pos")


def matcher_sources(docs: DataFrame, *keep: str) -> DataFrame:
    """binary and source package names that a matcher's RPM artifacts state; the first artifact of a name counts."""
    rows = docs.select(*keep, F.posexplode("matches").alias("pos", "m")).where(F.lower("m.artifact.type") == "rpm")
    file = F.coalesce(F.nullif("m.artifact.metadata.sourceRpm", F.lit("")), "m.artifact.metadata.source", F.lit(""))
    first = keep_first(rows.select(*keep, "pos", F.col("m.artifact.name").alias("binary"), file.alias("file")).where("binary <> ''"), [*keep, "binary"], "pos")
    return first.where("file <> ''").select(*keep, "binary", versions.source_of_rpm(F.col("file")).alias("source")).where("source <> '' AND source <> binary")


def merge_matches(first: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """``first`` and those rows of ``more`` whose key it lacks."""
    return first.unionByName(more.join(first.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def spdx_packages(sboms: DataFrame, *keep: str) -> DataFrame:
    p = F.col("p")
    rows = sboms.select(*keep, F.explode("packages").alias("p")).where(_text(p["name"]) != "")
    return rows.select(*keep, p["name"].alias("NAME"), _text(p["versionInfo"]).alias("VERSION"), _text(p["primaryPackagePurpose"]).alias("PURPOSE"), _text(p["packageFileName"]).alias("FILE"))


def spdx_sources(sboms: DataFrame, key: str) -> DataFrame:
    """binary and source package names of GENERATED_FROM relationships with different, named ends; of a binary's relationships the last counts."""
    packages = sboms.select(key, F.explode("packages").alias("p")).select(key, F.col("p.SPDXID").alias("id"), F.col("p.name").alias("name"))
    rel = sboms.select(key, F.posexplode("relationships").alias("pos", "r")).where("r.relationshipType = 'GENERATED_FROM'")
    rel = rel.select(key, "pos", F.col("r.spdxElementId").alias("a"), F.col("r.relatedSpdxElement").alias("b"))
    out = rel.join(packages.withColumnsRenamed({"id": "a", "name": "binary"}), [key, "a"]).join(packages.withColumnsRenamed({"id": "b", "name": "source"}), [key, "b"])
    named = out.where("binary <> '' AND source <> '' AND binary <> source")
    return named.groupBy(key, "binary").agg(F.max_by("source", F.struct("pos", "source")).alias("source"))


def syft_packages(sboms: DataFrame, *keep: str) -> DataFrame:
    a = F.col("a")
    return sboms.select(*keep, F.explode("artifacts").alias("a")).select(*keep, a["name"].alias("NAME"), _text(a["version"]).alias("VERSION"), a["type"].alias("TYPE"), a["purl"].alias("PURL"))


def other_purls(packages: DataFrame) -> DataFrame:
    """The rows of ``syft_packages`` that a matcher is asked for by package URL: not of RPMs, of known types, with a URL."""
    return packages.where(F.col("TYPE").isin(*OTHER_TYPES) & (_text(F.col("PURL")) != ""))


# Advisories -------------------------------------------------------------------------------------------------


def _cve_of_file(name: Column) -> Column:
    return F.upper(F.regexp_extract(name, r"([Cc][Vv][Ee]-\d+-\d+)", 1))


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """CSAF documents with ``cve`` from the file name."""
    docs = read_documents(spark, path, VEX)
    return docs.withColumn("cve", _cve_of_file(F.col("source_file")))


def archived_texts(spark: SparkSession, path: str) -> DataFrame:
    """cve, source_file and content of archives below ``path``, JSON lines of a file's name, which has its CVE, and content.

    Of several of a CVE that with the greatest name, then content, counts.
    """
    lines = spark.read.schema(ARCHIVE).json(path).select(_cve_of_file(F.col("file")).alias("cve"), F.col("file").alias("source_file"), "content").where("cve <> '' AND content <> ''")
    return lines.groupBy("cve").agg(F.max(F.struct("source_file", "content")).alias("f")).select("cve", "f.*")


def read_archived_advisories(spark: SparkSession, path: str) -> DataFrame:
    """``read_advisories`` of archives: a few large files take the place of a small one, and its folder, for each advisory."""
    return archived_texts(spark, path).select(F.from_json("content", VEX).alias("doc"), "source_file", "cve").select("doc.*", "source_file", "cve")


def status_rows(docs: DataFrame, key: str = "cve") -> DataFrame:
    """cve, vuln_idx, status, pid_idx, pid of all product statuses."""
    vulns = docs.select(key, F.posexplode("vulnerabilities").alias("vuln_idx", "v"))
    stacked = vulns.select(key, "vuln_idx", F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(f"v.product_status.{s}").alias("pids")) for s in STATUSES])).alias("s"))
    return stacked.select(key, "vuln_idx", F.col("s.status").alias("status"), F.posexplode("s.pids").alias("pid_idx", "pid"))


def flag_rows(docs: DataFrame, key: str = "cve") -> DataFrame:
    """cve, vuln_idx, flag_idx, flag_label, pid_idx, pid of all flags."""
    vulns = docs.select(key, F.posexplode("vulnerabilities").alias("vuln_idx", "v")).select(key, "vuln_idx", F.posexplode("v.flags").alias("flag_idx", "f"))
    return vulns.select(key, "vuln_idx", "flag_idx", F.col("f.label").alias("flag_label"), F.posexplode("f.product_ids").alias("pid_idx", "pid"))


def no_fix_rows(docs: DataFrame, key: str = "cve") -> DataFrame:
    """cve, vuln_idx, pid of products for which no fix is planned."""
    vulns = docs.select(key, F.posexplode("vulnerabilities").alias("vuln_idx", "v")).select(key, "vuln_idx", F.explode("v.remediations").alias("r"))
    return vulns.where("r.category = 'no_fix_planned'").select(key, "vuln_idx", F.explode("r.product_ids").alias("pid"))


def relationship_rows(docs: DataFrame, key: str = "cve") -> DataFrame:
    """cve, pid, parent_pid and pos of relationships that have both; of a pid's relationships the last counts."""
    r = docs.select(key, F.posexplode("product_tree.relationships").alias("pos", "r"))
    rows = r.select(key, F.col("r.full_product_name.product_id").alias("pid"), F.col("r.relates_to_product_reference").alias("parent_pid"), "pos")
    return rows.where((_text(F.col("pid")) != "") & (_text(F.col("parent_pid")) != ""))


def _product(field: str) -> Column:
    return F.try_variant_get("b", f"$.product.{field}", "string")


def _branches(of: Column) -> Column:
    return F.posexplode(F.try_variant_get(of, "$", "array<variant>"))


def product_rows(docs: DataFrame, key: str = "cve") -> DataFrame:
    """cve, product_id, name of the product tree, however deep; of repeated ids the last in the document counts.

    One recursive query: a branch gives the branches below it, with the path of their places, which sorts as the document does.  LIMIT ALL lifts the
    engine's limit of a million rows, which is one on the branches of all documents together.
    """
    roots = docs.select(F.col(key).alias("cve"), F.col("product_tree.branches").alias("branches"))
    branch = "SELECT cve, concat(path, lpad(CAST(pos AS STRING), 9, '0'), '/') AS path, b"
    found = docs.sparkSession.sql(
        f"""WITH RECURSIVE tree(cve, path, b) MAX RECURSION LEVEL {DEEPEST} AS (
            {branch} FROM (SELECT cve, '' AS path, posexplode(try_variant_get(branches, '$', 'array<variant>')) AS (pos, b) FROM {{roots}})
            UNION ALL
            {branch} FROM (SELECT cve, path, posexplode(try_variant_get(b, '$.branches', 'array<variant>')) AS (pos, b) FROM tree))
        SELECT cve, product_id, max_by(name, path) AS name
        FROM (SELECT cve, path, try_variant_get(b, '$.product.product_id', 'string') AS product_id, coalesce(try_variant_get(b, '$.product.name', 'string'), '') AS name FROM (SELECT * FROM tree LIMIT ALL))
        WHERE product_id <> '' GROUP BY cve, product_id""",
        roots=roots,
    )
    return found.withColumnRenamed("cve", key)


def vendor_wide_rows(docs: DataFrame, key: str = "cve") -> DataFrame:
    """cve, product_id of first-level branches whose CPE names the vendor and no product."""
    rows = docs.select(key, _branches(F.col("product_tree.branches")).alias("pos", "b"))
    cpe = F.try_variant_get("b", "$.product.product_identification_helper.cpe", "string")
    named = rows.select(key, _product("product_id").alias("product_id"), vendor_only(cpe).alias("wide"))
    return named.where("wide AND product_id <> ''").select(key, "product_id").distinct()


def vendor_only(cpe: Column) -> Column:
    """Whether a CPE has a vendor token alone, and it is this vendor's."""
    parts = F.filter(F.split(_text(cpe), ":"), lambda x: ~x.isin("", "cpe", "/a", "/o", "/h"))
    return (F.size(parts) == 1) & F.lower(F.get(parts, 0)).isin("redhat", "red_hat")


# Catalogs, manifests, reports -------------------------------------------------------------------------------


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Objects of catalogs, which are files of concatenated pretty-printed JSON, with ``source_file`` and ``pos``.

    An object starts at a brace in the first column; what is inside strings never does, as line ends are escaped there.
    """
    text = spark.read.option("lineSep", "\n{").text(path).withColumns({"source_file": F.col("_metadata.file_path"), "pos": F.monotonically_increasing_id()})
    whole = F.when(F.startswith(F.ltrim("value"), F.lit("{")), F.col("value")).otherwise(F.concat(F.lit("{"), F.col("value")))
    obj = F.try_parse_json(whole)
    return text.select("source_file", "pos", obj.alias("object")).where("object IS NOT NULL").withColumn("schema", F.try_variant_get("object", "$.schema", "string"))


def catalog_version(path: Column) -> Column:
    return F.regexp_extract(path, r"catalog-(\d+\.\d+)", 1)


def catalog_versions(spark: SparkSession, path: str) -> DataFrame:
    """The versions that catalog files ``catalog-N.M.json`` below ``path`` are of, sorted as text; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    version = F.regexp_extract("path", r"/catalog-(\d+\.\d+)\.json(?:/|$)", 1)
    return files.select(version.alias("version")).where("version <> ''").distinct().orderBy("version")


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("object", path, kind)


def related_images(objects: DataFrame, *keep: str) -> DataFrame:
    """``keep``, bundle, bundle_image, pos, role, image: the related images of bundles in ``read_catalog``'s objects; no images give no rows."""
    bundles = objects.where("schema = 'olm.bundle'")
    listed = F.posexplode(_get("$.relatedImages", "array<struct<name:string,image:string>>")).alias("pos", "r")
    rows = bundles.select(*keep, _get("$.name").alias("bundle"), _get("$.image").alias("bundle_image"), listed)
    return rows.select(*keep, "bundle", "bundle_image", F.col("pos").cast("long").alias("pos"), _text(F.col("r.name")).alias("role"), _text(F.col("r.image")).alias("image"))


def named_bundles(objects: DataFrame) -> DataFrame:
    """ns_key, package, display_name of bundles: the namespace of their image, the name in the first metadata property that has one or not."""
    meta = F.get(F.filter(F.coalesce(_get("$.properties", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.try_variant_get(p, "$.type", "string") == OPERATOR_METADATA), 0)
    rows = objects.where("schema = 'olm.bundle'").select(_get("$.image").alias("image"), _get("$.package").alias("package"), F.try_variant_get(meta, "$.value.displayName", "string").alias("display_name"))
    path = images.image_path(F.col("image"))
    return rows.select(F.split_part(path, F.lit("/"), F.lit(1)).alias("ns_key"), "package", "display_name").where("ns_key <> ''")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """release, component, image, digest and pos of release manifests; the first line of a digest counts."""
    lines = spark.read.text(path, wholetext=True).withColumn("source_file", F.col("_metadata.file_path"))
    release = F.regexp_extract("value", r"(?m)^Name:\s*(\S+)", 1)
    rows = lines.select("source_file", release.alias("release"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    rows = rows.where(~F.ltrim("line").rlike(r"^(Name|Pull From):") & F.col("line").rlike(r"@sha256:"))
    parts = F.split(F.trim("line"), r"\s+")
    rows = rows.select("source_file", "release", "pos", F.get(parts, 0).alias("component"), F.get(parts, 1).alias("image")).where("image IS NOT NULL")
    rows = rows.withColumn("digest", F.regexp_extract("image", r"@sha256:([a-f0-9]+)", 1))
    return keep_first(rows, ["source_file", "digest"], "pos")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """All report CSVs below ``path`` as strings, with ``source_file``; unreadable files are skipped, see ``skipped_reports``."""
    return spark.read.option("header", True).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).csv(path).withColumn("source_file", F.col("_metadata.file_path"))


def skipped_reports(spark: SparkSession, path: str, reports: DataFrame) -> DataFrame:
    """``source_file`` of files that gave no row of ``reports``, as they are corrupt or hold a header alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv*").load(path).where("length > 0")
    return files.select(F.col("path").alias("source_file")).join(reports.select("source_file").distinct(), "source_file", "left_anti")


def clean_reports(reports: DataFrame, flags: tuple[str, ...] = ("SEVERITY_MISMATCH",)) -> DataFrame:
    """Column names and values without outer blanks; ``True``/``False`` of ``flags`` as booleans."""
    df = reports.toDF(*[c.strip() for c in reports.columns])
    cols = []
    for name, kind in df.dtypes:
        c = F.trim(F.col(f"`{name}`")) if kind == "string" else F.col(f"`{name}`")
        if name in flags and kind == "string":
            c = F.when(c == "True", F.lit(True)).when(c == "False", F.lit(False))
        cols.append(c.alias(name))
    return df.select(*cols)


def listed_images(images: DataFrame, *keep: str) -> DataFrame:
    """id, name and ``keep`` (a place in the list) of landed image lists, whose ``name`` (VARIANT) is a string or an object with fullName."""
    name = F.coalesce(F.try_variant_get("name", "$.fullName", "string"), F.when(F.schema_of_variant("name") == "STRING", F.try_variant_get("name", "$", "string")), F.lit(""))
    return images.select("id", name.alias("name"), *keep)
