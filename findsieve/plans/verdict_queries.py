"""Queries around the verdict: scope, evidence, severities, totals and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findsieve.functions import images, products, severity, versions
from findsieve.operators import relational, reports
from findsieve.plans import adjudicate as A
from findsieve.plans import jobs
from findsieve.plans.fixtures import LABELLED, RELEASE, fixture
from findsieve.plans.oracle import BY_LABELS, OF_RELEASE, duck
from findsieve.sources import landing
from findsieve.sources.scratch import shared_path

QUERIES: dict = {}


def query(name: str, oracle: str | None = None, more: str = "", **changes):
    def add(fn):
        QUERIES[name] = (fn, duck(oracle, more, **changes) if oracle else None)
        return fn

    return add


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    return A.contexts(fixture(spark, sf, "fx_img"), prefixes(spark, sf))


def parsed_pids(spark: SparkSession, sf: str) -> DataFrame:
    pids = fixture(spark, sf, "fx_pid").withColumns({"flag_label": F.when(F.col("status") == "flag", F.lit("vulnerable_code_not_present")), "flag_idx": F.lit(0)})
    return A.parse_pids(pids, fixture(spark, sf, "fx_product"), fixture(spark, sf, "fx_rel"), fixture(spark, sf, "fx_vendor"))


def nofix(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "fx_pid").where("status = 'known_affected' AND pid_idx % 3 = 0").select("cve", "vuln_idx", "pid")


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return A.adjudicate(fixture(spark, sf, "fx_given"), contexts(spark, sf), fixture(spark, sf, "fx_doc"), parsed_pids(spark, sf), nofix(spark, sf))


@query("verdict", "SELECT finding_id, IMAGE, COMPONENT, VEX_PRODUCT, JUSTIFICATION, VERSION, CVE, VEX_SEVERITY AS SEVERITY, RULE, AUDIT_RESULT, VEX_FIX_VER, RHACS_SEVERITY, SEVERITY_MISMATCH, under_investigation FROM res")
def verdict(spark, sf):
    return verdicts(spark, sf)


@query("verdict_counts", "SELECT RULE, AUDIT_RESULT, count(*) AS n FROM res GROUP BY ALL")
def verdict_counts(spark, sf):
    return verdicts(spark, sf).groupBy("RULE", "AUDIT_RESULT").agg(F.count(F.lit(1)).alias("n"))


# Verdicts of jobs, whose images are known by more than their references ----------------------------------------


def prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "fx_prefix").groupBy("ns_key").agg(F.collect_list("prefix").alias("prefixes"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """CSAF documents of the fixtures, written as archives and read back."""
    from findsieve.plans import landing_queries

    return landing.read_archived_advisories(spark, landing_queries.archived(landing_queries.documents(spark, sf)))


JOB_COLUMNS = ["finding_id", "RULE", "AUDIT_RESULT", "VEX_PRODUCT", "VEX_FIX_VER", "JUSTIFICATION"]
ORACLE_COLUMNS = ", ".join(JOB_COLUMNS)


@query("release_verdict", f"SELECT {ORACLE_COLUMNS}, part AS OCP_COMPONENT FROM res JOIN (SELECT img_k AS k, component AS part FROM fx_img) ON k = img_k", changed=RELEASE, contexts=OF_RELEASE)
def release_verdict(spark, sf):
    """The release job over a manifest of images whose references say nothing."""
    return release_rows(spark, sf)[0].select(*JOB_COLUMNS, "OCP_COMPONENT")


def release_rows(spark, sf):
    listed = fixture(spark, sf, "fx_img", RELEASE)
    manifest = listed.select("release", "component", F.col("IMAGE").alias("image"), images.digest(F.col("IMAGE")).alias("digest"), F.col("img_k").alias("pos"))
    return jobs.adjudicate_release(manifest, fixture(spark, sf, "fx_given", RELEASE), documents(spark, sf), prefixes(spark, sf), images=listed.select("IMAGE", "os_info"))


@query(
    "release_summary", "SELECT AUDIT_RESULT, count(*) AS n, count(DISTINCT part) AS ocp_components FROM res JOIN (SELECT img_k AS k, component AS part FROM fx_img) ON k = img_k GROUP BY AUDIT_RESULT",
    changed=RELEASE, contexts=OF_RELEASE,
)
def release_summary(spark, sf):
    return release_rows(spark, sf)[1]


@query("namespace_verdict", f"SELECT {ORACLE_COLUMNS}, IMAGE FROM res WHERE IMAGE IS NOT NULL", changed=LABELLED, contexts=BY_LABELS)
def namespace_verdict(spark, sf):
    """The namespace job over images that labels and a matcher's distro block tell about."""
    listed = fixture(spark, sf, "fx_img", LABELLED)
    labels = F.map_filter(F.create_map(F.lit("name"), "label_name", F.lit("cpe"), "label_cpe"), lambda _, v: v.isNotNull())
    seen = listed.select("IMAGE", labels.alias("labels"), F.struct(F.col("distro_name").alias("name"), F.col("distro_version").alias("version")).alias("distro"))
    rows, _ = jobs.adjudicate_namespace(listed.select(F.col("img_k").alias("id"), F.col("IMAGE").alias("name"), F.col("img_k").alias("pos")), fixture(spark, sf, "fx_given", LABELLED), documents(spark, sf), prefixes(spark, sf), images=seen)
    return rows.select(*JOB_COLUMNS, "IMAGE")


# Heads of channels, their related images of two releases, and what was found in them; reports are written, read back and counted.
OPERATORS = """
pt AS (SELECT package, channel, replaces AS name FROM fx_entry UNION SELECT package, channel, skip FROM fx_entry),
hd AS (SELECT e.package, e.channel, coalesce(max(e.name) FILTER (pt.name IS NULL), arg_max(e.name, e.pos)) AS head FROM fx_entry e
  LEFT JOIN pt ON pt.package = e.package AND pt.channel = e.channel AND pt.name = e.name GROUP BY ALL),
bi AS (SELECT v.ocp_version, hd.package, hd.channel, hd.channel = 'stable-1' AS is_default, regexp_replace(head, '^.*?\\.(v\\d.*)$', '\\1') AS bundle_version, i.IMAGE
  FROM hd JOIN fx_entry e ON e.name = head AND e.package = hd.package AND e.channel = hd.channel CROSS JOIN (VALUES ('4.20', 0), ('4.21', 1)) AS v(ocp_version, more)
  LEFT JOIN fx_img i ON i.img_k = (e.img_k + v.more) % (SELECT count(*) FROM fx_img) + 1)"""


def operator_catalog(spark, sf) -> DataFrame:
    """Catalogs of two releases with bundles of one name; a bundle's related images are itself and the next image, or the one after, if there is one."""
    e, listed = fixture(spark, sf, "fx_entry"), fixture(spark, sf, "fx_img")
    count = listed.agg(F.count(F.lit(1)).alias("images"))
    path = shared_path(spark, "operators")
    obj = lambda kind, *c: F.to_json(F.struct(F.lit(f"olm.{kind}").alias("schema"), *c), {"pretty": "true"}).alias("value")
    package = e.select("package").distinct().select(obj("package", F.col("package").alias("name"), F.lit("stable-1").alias("defaultChannel")))
    entries = e.groupBy("package", "channel").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "replaces", F.array("skip").alias("skips")))).alias("entries"))
    channel = entries.select(obj("channel", "package", F.col("channel").alias("name"), "entries"))
    for version, more in (("4.20", 0), ("4.21", 1)):
        work = listed.select(F.col("img_k").alias("work_k"), F.col("IMAGE").alias("work"))
        bundles = e.join(F.broadcast(count)).withColumn("work_k", (F.col("img_k") + more) % F.col("images") + 1).join(work, "work_k", "left")  # the count is one row
        own = F.struct(F.lit("bundle").alias("name"), F.concat(F.lit("registry.redhat.io/b@sha256:"), F.sha2(F.col("name"), 256)).alias("image"))
        related = F.when(F.col("work").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.lit("work").alias("name"), F.col("work").alias("image"))))
        bundle = bundles.select(obj("bundle", "name", "package", own["image"].alias("image"), related.alias("relatedImages")))
        package.unionByName(channel).unionByName(bundle).write.text(f"{path}/catalog-{version}.json")
    return landing.read_catalog(spark, f"{path}/*")


def operator_rows(spark, sf) -> tuple[DataFrame, DataFrame]:
    return jobs.adjudicate_operators(operator_catalog(spark, sf), fixture(spark, sf, "fx_given"), documents(spark, sf), prefixes(spark, sf))


@query("operator_verdict", "SELECT ocp_version, package, channel, is_default, bundle_version, finding_id, RULE, AUDIT_RESULT FROM bi JOIN res USING (IMAGE)", OPERATORS)
def operator_verdict(spark, sf):
    return operator_rows(spark, sf)[0].select(*jobs.BUNDLE, "finding_id", "RULE", "AUDIT_RESULT")


@query(
    "operator_summary",
    """SELECT ocp_version, package, channel, is_default, bundle_version, count(DISTINCT bi.IMAGE) AS images, count(DISTINCT res.IMAGE) AS found, count(*) FILTER (AUDIT_RESULT = 'POSITIVE') AS vulnerable,
  count(*) FILTER (AUDIT_RESULT = 'FALSE POSITIVE') AS false_positive, count(DISTINCT bi.IMAGE) = 0 AS skipped FROM bi LEFT JOIN res ON res.IMAGE = bi.IMAGE GROUP BY ALL""",
    OPERATORS,
)
def operator_summary(spark, sf):
    return operator_rows(spark, sf)[1]


@query(
    "operator_reports",
    """SELECT ocp_version AS release, package AS operator, channel, bundle_version, AUDIT_RESULT, count(*) AS n, count(*) FILTER (RULE = 'R0') AS unknown FROM bi JOIN res USING (IMAGE) GROUP BY ALL""",
    OPERATORS,
)
def operator_reports(spark, sf):
    """Reports written as named files in two runs, the second of which replaces those of one release; read back with the facets of their paths."""
    rows, _ = operator_rows(spark, sf)
    path = shared_path(spark, "operator-reports")
    jobs.write_operator_reports(rows.where("ocp_version = '4.20' OR RULE = 'R0'"), path)
    jobs.write_operator_reports(rows.where("ocp_version = '4.21'"), path)
    read = landing.clean_reports(landing.read_reports(spark, path))
    read = read.withColumns(reports.facets(F.col("source_file"), F.col("IMAGE")))
    return read.groupBy("release", "operator", "channel", "bundle_version", "AUDIT_RESULT").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("RULE") == "R0").alias("unknown"))


# Contexts and column expressions ----------------------------------------------------------------------------


@query("image_parse", "SELECT IMAGE, split_part(IMAGE, '/', 1) AS host, image_ns, image_name FROM ctx")
def image_parse(spark, sf):
    df = images.with_image_parts(fixture(spark, sf, "fx_img"))
    return df.select("IMAGE", F.split_part("IMAGE", F.lit("/"), F.lit(1)).alias("host"), "image_ns", "image_name")


@query("image_classify", "SELECT IMAGE, rhel_ver, ocp_ver, workload_type, display_name FROM ctx")
def image_classify(spark, sf):
    return images.with_image_parts(fixture(spark, sf, "fx_img")).select("IMAGE", "rhel_ver", "ocp_ver", "workload_type", "display_name")


@query(
    "image_context",
    """SELECT IMAGE, CASE WHEN lang <> '' THEN lang ELSE rhel_ver END AS rhel_ver, CASE WHEN workload_type = 'ocp' THEN nullif(ver, '') END AS ocp_ver, workload_type,
  CASE WHEN ver <> '' THEN trim(split_part(dn, '(', 1)) || ' ' || ver ELSE dn END AS display_name
FROM (SELECT *, CASE WHEN workload_type = 'ocp' THEN 'OpenShift 4.x' ELSE display_name END AS dn, CASE img_k % 4 WHEN 0 THEN '' ELSE '4.' || (10 + img_k % 12) END AS ver, CASE WHEN img_k % 3 = 0 THEN CAST(8 + img_k % 2 AS VARCHAR) ELSE '' END AS lang FROM ctx)""",
)
def image_context(spark, sf):
    k = F.col("img_k")
    version = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("4."), (10 + k % 12).cast("string")))
    lang = F.when(k % 3 == 0, F.concat(F.lit("el"), (8 + k % 2).cast("string"))).otherwise(F.lit(""))
    cpe = F.concat(F.lit("cpe:/a:redhat:openshift:"), version, F.lit("::"), lang)
    labels = F.create_map(F.lit("cpe"), cpe, F.lit("name"), images.image_path(F.col("IMAGE")))
    df = fixture(spark, sf, "fx_img").withColumn("labels", labels)
    return images.with_label_context(df).select("IMAGE", "rhel_ver", "ocp_ver", "workload_type", "display_name")


@query(
    "release_context",
    """SELECT IMAGE, 'ocp' AS workload_type, '4.' || (12 + img_k % 9) AS ocp_ver, CASE WHEN img_k % 3 = 0 THEN CAST(8 + img_k % 3 AS VARCHAR) WHEN img_k % 3 = 1 THEN '10' ELSE rhel_ver END AS rhel_ver,
  'OpenShift 4.' || (12 + img_k % 9) || '.' || (img_k % 7) AS display_name FROM ctx""",
)
def release_context(spark, sf):
    k = F.col("img_k")
    df = images.with_image_parts(fixture(spark, sf, "fx_img")).withColumns({
        "release": F.concat(F.lit("4."), (12 + k % 9).cast("string"), F.lit("."), (k % 7).cast("string")),
        "os_info": F.when(k % 3 == 0, F.concat(F.lit("rhel:"), (8 + k % 3).cast("string"), F.lit(".2"))),
        "component": F.when(k % 3 == 1, F.lit("rhel-coreos-10")).otherwise(F.lit("cli")),
    })
    return images.with_release_context(df, "release", "component", "os_info").select("IMAGE", "workload_type", "ocp_ver", "rhel_ver", "display_name")


@query("digest_extract", "SELECT IMAGE, img_sha AS digest FROM ctx")
def digest_extract(spark, sf):
    return fixture(spark, sf, "fx_img").select("IMAGE", images.digest(F.col("IMAGE")).alias("digest"))


@query("rhel_stream", "SELECT VERSION, row_rhel AS major, minor, modver AS is_module FROM fi GROUP BY ALL")
def rhel_stream(spark, sf):
    v = F.col("VERSION")
    return fixture(spark, sf, "fx_finding").select("VERSION").distinct().select("VERSION", versions.rhel_major(v).alias("major"), versions.rhel_minor(v).alias("minor"), versions.is_module_version(v).alias("is_module"))


@query("pid_parse", "SELECT cve, pid_idx, pid, parent, pkg_name, fix_ver, is_module FROM pd")
def pid_parse(spark, sf):
    return parsed_pids(spark, sf).select("cve", "pid_idx", "pid", "parent", "pkg_name", "fix_ver", "is_module")


@query("rpm_compare", """SELECT a.v AS installed, b.v AS fix, CASE WHEN ea <> eb THEN ea > eb ELSE ka >= kb END AS at_least
FROM (SELECT v, coalesce(TRY_CAST(split_part(v, ':', 1) AS BIGINT), 0) AS ea, rkey(CASE WHEN contains(v, ':') AND TRY_CAST(split_part(v, ':', 1) AS BIGINT) IS NOT NULL THEN regexp_replace(v, '^[^:]*:', '') ELSE v END) AS ka
  FROM (SELECT VERSION AS v FROM fi UNION SELECT 'x' || VERSION FROM fi WHERE contains(VERSION, ':')) GROUP BY v) a
JOIN (SELECT fix_ver AS v, 0 AS eb, rkey(fix_ver) AS kb FROM pd WHERE fix_ver IS NOT NULL GROUP BY ALL) b ON regexp_extract(a.v, 'el(\\d+)', 1) = regexp_extract(b.v, 'el(\\d+)', 1) AND regexp_extract(a.v, 'el(\\d+)', 1) <> ''""")
def rpm_compare(spark, sf):
    el = lambda c: F.nullif(F.regexp_extract(c, r"el(\d+)", 1), F.lit(""))
    order = lambda c: versions.rpm_order(F.col(c)).alias(f"{c}_order")
    seen = fixture(spark, sf, "fx_finding").select(F.col("VERSION").alias("installed")).distinct()
    # Texts before the colon that are no numbers, too.
    seen = seen.unionByName(seen.where(F.contains("installed", F.lit(":"))).select(F.concat(F.lit("x"), "installed").alias("installed")))
    a = seen.select("installed", el("installed").alias("el"), order("installed"))
    b = parsed_pids(spark, sf).where("fix_ver IS NOT NULL").select(F.col("fix_ver").alias("fix")).distinct().select("fix", el("fix").alias("el"), order("fix"))
    return a.join(b, "el").select("installed", "fix", (F.col("installed_order") >= F.col("fix_order")).alias("at_least"))


@query("severity_norm", "SELECT SEVERITY AS code, CASE WHEN SEVERITY = '' THEN 'Unknown' WHEN SEVERITY LIKE 'CRIT%' THEN 'Critical' WHEN SEVERITY LIKE 'IMP%' THEN 'Important' WHEN SEVERITY LIKE 'MOD%' THEN 'Moderate' ELSE 'Low' END AS severity, count(*) AS n FROM fi GROUP BY ALL")
def severity_norm(spark, sf):
    s = severity.scanner_severity(F.col("SEVERITY"))
    return fixture(spark, sf, "fx_finding").groupBy(F.col("SEVERITY").alias("code"), s.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("vex_severity", "SELECT cve, coalesce(impact, nullif(aggregate_severity, 'None'), later_impact, CASE cvss_severity WHEN 'HIGH' THEN 'Important' END, 'Unknown') AS severity FROM fx_doc")
def vex_severity(spark, sf):
    return fixture(spark, sf, "fx_doc").select("cve", severity.vex_severity(F.col("impact"), F.col("aggregate_severity"), F.col("later_impact"), F.col("cvss_severity"), F.lit("Unknown")).alias("severity"))


@query("severity_mismatch", "SELECT RHACS_SEVERITY, VEX_SEVERITY AS SEVERITY, SEVERITY_MISMATCH, count(*) AS n FROM res GROUP BY ALL")
def severity_mismatch(spark, sf):
    return verdicts(spark, sf).groupBy("RHACS_SEVERITY", "SEVERITY", "SEVERITY_MISMATCH").agg(F.count(F.lit(1)).alias("n"))


@query("src_rpm_name", "SELECT DISTINCT COMPONENT || '-' || regexp_replace(VERSION, '^[^:]*:', '') || '.src.rpm' AS file, COMPONENT AS source FROM fi WHERE row_rhel IS NOT NULL")
def src_rpm_name(spark, sf):
    df = fixture(spark, sf, "fx_finding").where(versions.rhel_major(F.col("VERSION")).isNotNull())
    df = df.select(F.concat("COMPONENT", F.lit("-"), versions.without_epoch(F.col("VERSION")), F.lit(".src.rpm")).alias("file")).distinct()
    return df.withColumn("source", versions.source_of_rpm(F.col("file")))


@query("advisory_url", "SELECT DISTINCT CVE, 'https://security.access.redhat.com/data/csaf/v2/vex/' || split_part(CVE, '-', 2) || '/' || lower(CVE) || '.json' AS url, 'https://access.redhat.com/security/cve/' || lower(CVE) AS link FROM fi")
def advisory_url(spark, sf):
    cve = F.col("CVE")
    url = F.concat(F.lit("https://security.access.redhat.com/data/csaf/v2/vex/"), F.split_part(cve, F.lit("-"), F.lit(2)), F.lit("/"), F.lower(cve), F.lit(".json"))
    return fixture(spark, sf, "fx_finding").select("CVE").distinct().select("CVE", url.alias("url"), F.concat(F.lit("https://access.redhat.com/security/cve/"), F.lower(cve)).alias("link"))


@query("fix_stream", "SELECT fix_ver, regexp_extract(fix_ver, '(el\\d+_\\d+)', 1) AS stream, count(*) AS n FROM pd WHERE fix_ver IS NOT NULL GROUP BY ALL")
def fix_stream(spark, sf):
    df = parsed_pids(spark, sf).where("fix_ver IS NOT NULL")
    return df.groupBy("fix_ver", versions.fix_stream(F.col("fix_ver")).alias("stream")).agg(F.count(F.lit(1)).alias("n"))


# Scope and guards -------------------------------------------------------------------------------------------


def scoped(spark, sf):
    ctx = contexts(spark, sf)
    asked = fixture(spark, sf, "fx_finding").select(F.col("CVE").alias("cve"), "IMAGE").join(ctx.select("IMAGE", "ctx_id", "display_name"), "IMAGE")
    return A.scoped_pids(asked, ctx, parsed_pids(spark, sf)).join(asked.select("cve", "ctx_id", "display_name").distinct(), ["cve", "ctx_id"])


ASKED = "(SELECT DISTINCT CVE AS cve, display_name AS dn FROM fi)"


@query("pid_scope", f"SELECT cve, dn AS display_name, pid_idx, pid, status, in_scope FROM sc JOIN {ASKED} USING (cve, dn)")
def pid_scope(spark, sf):
    return scoped(spark, sf).select("cve", "display_name", "pid_idx", "pid", "status", "in_scope")


@query("pid_same_rhel", """SELECT rr AS rhel_ver, pid_idx, pid, contains(lower(pid), 'enterprise_linux_' || rr) OR regexp_matches(pid, '\\.el' || rr || '([_.\\-a-z]|$)') OR regexp_matches(pid, '^[a-zA-Z]+-' || rr || '[.\\-]')
  OR regexp_matches(pid, '^' || rr || '[A-Za-z]') AS same_rhel FROM (SELECT DISTINCT cve, row_rhel AS rr FROM fi WHERE row_rhel IS NOT NULL) JOIN pd USING (cve)""")
def pid_same_rhel(spark, sf):
    majors = fixture(spark, sf, "fx_finding").select(F.col("CVE").alias("cve"), versions.rhel_major(F.col("VERSION")).alias("rhel_ver")).where("rhel_ver IS NOT NULL").distinct()
    return majors.join(parsed_pids(spark, sf), "cve").select("rhel_ver", "pid_idx", "pid", F.array_contains("any_majors", F.col("rhel_ver")).alias("same_rhel"))


@query("module_guard", "SELECT finding_id, pid_idx, NOT is_module OR modver AS counts FROM fi JOIN pd ON pd.cve = fi.CVE AND pkg_name = COMPONENT")
def module_guard(spark, sf):
    pids = parsed_pids(spark, sf).select(F.col("cve").alias("pid_cve"), "pkg_name", "pid_idx", "is_module")
    rows = fixture(spark, sf, "fx_finding").join(pids, (F.col("CVE") == F.col("pid_cve")) & (F.col("COMPONENT") == F.col("pkg_name")))
    return rows.select("finding_id", "pid_idx", products.module_guard(F.col("is_module"), versions.is_module_version(F.col("VERSION"))).alias("counts"))


@query("digest_guard", """SELECT a.IMAGE, b.IMAGE AS stated, a.img_sha = b.img_sha AS counts FROM ctx a JOIN ctx b ON a.nat_k = b.nat_k AND a.image_ns = b.image_ns""")
def digest_guard(spark, sf):
    ctx = contexts(spark, sf).join(fixture(spark, sf, "fx_img").select("IMAGE", "nat_k"), "IMAGE")
    a = ctx.select("nat_k", "image_ns", "IMAGE", "img_sha")
    b = ctx.select("nat_k", "image_ns", F.concat(F.lit("stream:"), F.col("IMAGE")).alias("pid"), F.col("IMAGE").alias("stated"))
    sha = images.digest(F.col("pid"))
    return a.join(b, ["nat_k", "image_ns"]).select("IMAGE", "stated", (sha.isNull() | (sha == F.col("img_sha"))).alias("counts"))


@query("catchall_pids", "SELECT cve, pid_idx, pid FROM pd WHERE pid IN ('red_hat_products', 'vendor_all')")
def catchall_pids(spark, sf):
    return parsed_pids(spark, sf).where("vendor_wide").select("cve", "pid_idx", "pid")


@query("cpe_vendor_only", """SELECT cve, pid_idx, len(list_filter(string_split(cpe, ':'), lambda t: t NOT IN ('', 'cpe', '/a'))) = 1 AND NOT contains(cpe, 'other') AS vendor_only
FROM (SELECT *, CASE pid_idx % 3 WHEN 0 THEN 'cpe:/a:redhat' WHEN 1 THEN 'cpe:/a:other' ELSE 'cpe:/a:redhat:' || parent || '::el9' END AS cpe FROM pd)""")
def cpe_vendor_only(spark, sf):
    k = F.col("pid_idx") % 3
    cpe = F.when(k == 0, F.lit("cpe:/a:redhat")).when(k == 1, F.lit("cpe:/a:other")).otherwise(F.concat(F.lit("cpe:/a:redhat:"), "parent", F.lit("::el9")))
    return parsed_pids(spark, sf).select("cve", "pid_idx", landing.vendor_only(cpe).alias("vendor_only"))


@query("ocp_version_scope", """SELECT IMAGE, product_id, coalesce(ocp_ver IS NULL OR list_slice(string_split(ocp_ver, '.'), 1, len(n)) = n, true) AS covers FROM ctx, (SELECT DISTINCT product_id, string_split(list_last(string_split(name, ' ')), '.') AS n FROM fx_product WHERE contains(name, 'OpenShift')) WHERE workload_type = 'ocp'""")
def ocp_version_scope(spark, sf):
    names = fixture(spark, sf, "fx_product").where(F.contains("name", F.lit("OpenShift"))).select("product_id", "name").distinct().withColumn("workload_type", F.lit("ocp"))
    ctx = contexts(spark, sf).where("workload_type = 'ocp'").select("IMAGE", "ocp_ver", "workload_type")
    return ctx.join(names, "workload_type").select("IMAGE", "product_id", products.ocp_version_covers(F.col("name"), F.col("ocp_ver")).alias("covers"))


@query("ns_prefix_join", "SELECT IMAGE, list_sort(list(prefix)) AS prefixes FROM ctx JOIN px USING (img_k) GROUP BY IMAGE")
def ns_prefix_join(spark, sf):
    return contexts(spark, sf).where("workload_type = 'operator'").select("IMAGE", F.array_sort("prefixes").alias("prefixes"))


# Evidence ---------------------------------------------------------------------------------------------------


@query("vex_left_join", "SELECT finding_id, d.cve IS NOT NULL AS has_doc, n_vulns FROM fi LEFT JOIN fx_doc d ON d.cve = fi.CVE")
def vex_left_join(spark, sf):
    docs = fixture(spark, sf, "fx_doc").select(F.col("cve").alias("CVE"), "n_vulns", F.lit(True).alias("known"))
    return fixture(spark, sf, "fx_finding").join(docs, "CVE", "left").select("finding_id", F.coalesce("known", F.lit(False)).alias("has_doc"), "n_vulns")


@query("pid_label", "SELECT cve, pid_idx, pid, label FROM pd")
def pid_label(spark, sf):
    return parsed_pids(spark, sf).select("cve", "pid_idx", "pid", "label")


@query("name_match", "SELECT finding_id, pid_idx, status FROM fi JOIN pd ON pd.cve = fi.CVE AND pkg_name IN (COMPONENT, 'pkg' || (CAST(substr(COMPONENT, 4) AS INT) + 1))")
def name_match(spark, sf):
    source = F.concat(F.lit("pkg"), (F.substring("COMPONENT", 4, 9).cast("int") + 1).cast("string"))
    names = fixture(spark, sf, "fx_finding").select("finding_id", F.col("CVE").alias("cve"), F.explode(F.array("COMPONENT", source)).alias("pkg_name"))
    return names.join(parsed_pids(spark, sf), ["cve", "pkg_name"]).select("finding_id", "pid_idx", "status")


@query("vex_label_sets", "SELECT cve, coalesce(la, []) AS affected, coalesce(lf, []) AS fixed, coalesce(ln, []) AS not_affected, coalesce(li, []) AS investigating FROM lb")
def vex_label_sets(spark, sf):
    e = A.document_evidence(parsed_pids(spark, sf))
    return e.select("cve", *[F.col(f"lbl_{x}").alias(x) for x in ("affected", "fixed", "not_affected")], F.col("lbl_investigating").alias("investigating"))


@query("top_labels", "SELECT cve, array_to_string(list_slice(coalesce(la, []), 1, 3), ', ') AS affected, array_to_string(list_slice(coalesce(lf, []), 1, 3), ', ') AS fixed FROM lb")
def top_labels(spark, sf):
    e = A.document_evidence(parsed_pids(spark, sf))
    return e.select("cve", *[F.array_join(F.slice(f"lbl_{x}", 1, 3), ", ").alias(x) for x in ("affected", "fixed")])


@query("not_affected_union", "SELECT DISTINCT cve, pid FROM pd WHERE status IN ('known_not_affected', 'flag')")
def not_affected_union(spark, sf):
    p = parsed_pids(spark, sf)
    stated = p.where("status = 'known_not_affected'").select("cve", "pid")
    return stated.union(p.where((F.col("status") == "flag") & F.col("flag_label").isin(*products.NOT_AFFECTED_FLAGS)).select("cve", "pid")).distinct()


@query("catchall_intersect", "SELECT DISTINCT cve, pid FROM pd WHERE pid IN ('red_hat_products', 'vendor_all') AND clears")
def catchall_intersect(spark, sf):
    return catchall_pids(spark, sf).select("cve", "pid").intersect(not_affected_union(spark, sf))


@query("fix_compare", """SELECT finding_id, pid_idx, coalesce(rkey(regexp_replace(VERSION, '^[^:]*:', '')) >= rkey(fix_ver) OR coalesce(TRY_CAST(split_part(VERSION, ':', 1) AS INT) > 0, false), false) AS met
FROM fi JOIN pd ON pd.cve = fi.CVE AND pkg_name = COMPONENT WHERE status = 'fixed' AND coalesce(nullif(regexp_extract(fix_ver, '\\.el\\d+_(\\d+)', 1), ''), nullif(regexp_extract(fix_ver, '[.+]el\\d+\\.(\\d+)\\.', 1), '')) = minor""")
def fix_compare(spark, sf):
    fixes = parsed_pids(spark, sf).where("status = 'fixed'").select(F.col("cve").alias("CVE"), F.col("pkg_name").alias("COMPONENT"), F.col("fix_minor").alias("minor"), versions.rpm_order(F.col("fix_ver")).alias("fix_order"), "pid_idx")
    rows = fixture(spark, sf, "fx_finding").withColumns({"minor": versions.rhel_minor(F.col("VERSION")), "version_order": versions.rpm_order(F.col("VERSION"))})
    return rows.join(fixes, ["CVE", "COMPONENT", "minor"]).select("finding_id", "pid_idx", (F.col("version_order") >= F.col("fix_order")).alias("met"))


@query("vex_product", "SELECT finding_id, VEX_PRODUCT AS product FROM res")
def vex_product(spark, sf):
    return verdicts(spark, sf).select("finding_id", F.col("VEX_PRODUCT").alias("product"))


@query("result_projection", "SELECT finding_id, NULL AS VEX_FIX_VER, COMPONENT, CVE, VERSION, NULL AS VEX_PRODUCT, NULL AS JUSTIFICATION, SEVERITY, RHACS_SEVERITY, SEVERITY_MISMATCH, AUDIT_RESULT FROM fx_report WHERE AUDIT_RESULT = 'FALSE POSITIVE'")
def result_projection(spark, sf):
    rows = fixture(spark, sf, "fx_report").drop("JUSTIFICATION")
    return reports.result_columns(rows, false_only=True, keep=("finding_id",))


# Results ----------------------------------------------------------------------------------------------------


@query("false_only", "SELECT finding_id, RULE FROM res WHERE AUDIT_RESULT = 'FALSE POSITIVE'")
def false_only(spark, sf):
    return verdicts(spark, sf).where(F.col("AUDIT_RESULT") == A.FP).select("finding_id", "RULE")


@query("verdict_by_component", "SELECT COMPONENT, AUDIT_RESULT, count(*) AS n, count(DISTINCT IMAGE) AS images, count(DISTINCT CVE) AS cves FROM res GROUP BY ALL")
def verdict_by_component(spark, sf):
    return verdicts(spark, sf).groupBy("COMPONENT", "AUDIT_RESULT").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("IMAGE").alias("images"), F.countDistinct("CVE").alias("cves"))


@query("missing_advisories", "SELECT DISTINCT CVE FROM fi WHERE CVE NOT IN (SELECT cve FROM fx_doc)")
def missing_advisories(spark, sf):
    have = fixture(spark, sf, "fx_doc").select(F.col("cve").alias("CVE"))
    return fixture(spark, sf, "fx_finding").select("CVE").distinct().join(have, "CVE", "left_anti")


@query("image_totals", "SELECT IMAGE, count(*) AS findings, count(DISTINCT COMPONENT) AS components FROM fi GROUP BY IMAGE")
def image_totals(spark, sf):
    return fixture(spark, sf, "fx_finding").groupBy("IMAGE").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("COMPONENT").alias("components"))


@query("component_severity", "SELECT COMPONENT, count(*) AS cves, arg_min(scanner, CASE scanner WHEN 'Critical' THEN 0 WHEN 'Important' THEN 1 WHEN 'Moderate' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END) AS top_severity FROM vd1 GROUP BY COMPONENT")
def component_severity(spark, sf):
    s = severity.scanner_severity(F.col("SEVERITY"))
    return fixture(spark, sf, "fx_given").withColumn("s", s).groupBy("COMPONENT").agg(F.count(F.lit(1)).alias("cves"), F.min_by("s", severity.severity_rank(F.col("s"))).alias("top_severity"))


@query("mismatch_count", "SELECT count(*) FILTER (SEVERITY_MISMATCH) AS mismatches, count(*) AS n FROM res")
def mismatch_count(spark, sf):
    return verdicts(spark, sf).agg(F.count_if("SEVERITY_MISMATCH").alias("mismatches"), F.count(F.lit(1)).alias("n"))


@query("result_sort", """SELECT finding_id, (CASE WHEN AUDIT_RESULT = 'FALSE POSITIVE' THEN 0 WHEN under_investigation THEN 4 WHEN RULE = 'R0' THEN 3 ELSE 2 END) * 10000
  + CASE VEX_SEVERITY WHEN 'Critical' THEN 0 WHEN 'Important' THEN 1 WHEN 'Moderate' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END * 100 AS score FROM res""")
def result_sort(spark, sf):
    rows = verdicts(spark, sf).withColumn("score", A.sort_score())
    return rows.orderBy("score", "CVE", "COMPONENT", "VERSION", "IMAGE", "finding_id").select("finding_id", "score")


@query("severity_matrix", "SELECT VEX_SEVERITY AS SEVERITY, " + ", ".join(f"count(*) FILTER (RHACS_SEVERITY = '{s}') AS {s}" for s in severity.RANK) + " FROM res GROUP BY VEX_SEVERITY")
def severity_matrix(spark, sf):
    pivot = verdicts(spark, sf).groupBy("SEVERITY").pivot("RHACS_SEVERITY", list(severity.RANK)).agg(F.count(F.lit(1)))
    return pivot.na.fill(0)


@query("min_severity", "SELECT finding_id FROM res WHERE VEX_SEVERITY IN ('Critical', 'Important')")
def min_severity(spark, sf):
    return verdicts(spark, sf).where(severity.severity_rank(F.col("SEVERITY")) <= severity.RANK["Important"]).select("finding_id")


@query("dedupe_finding", "SELECT CVE, COMPONENT, VERSION, min(finding_id) AS finding_id FROM fi GROUP BY ALL")
def dedupe_finding(spark, sf):
    return relational.keep_first(fixture(spark, sf, "fx_finding"), ["CVE", "COMPONENT", "VERSION"], "finding_id").select("CVE", "COMPONENT", "VERSION", "finding_id")
