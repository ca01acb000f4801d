"""Domain tables derived from the star tables by SQL that Spark and DuckDB both read.

``SQL`` holds the views in order of need; ``H`` stands for the engine's SHA-256, ``//`` for its whole division.  Advisories and
manifests are of bounded size, so that larger tables give more of them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

STAR = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    "fx_img": """
SELECT s_suppkey AS img_k, s_nationkey AS nat_k,
 'registry.redhat.io/' || CASE s_suppkey % 6 WHEN 0 THEN 'ubi9/ubi'
   WHEN 1 THEN 'openshift4/ose-cli-rhel9:v4.' || (18 + s_suppkey % 4)
   WHEN 2 THEN 'rhacm2/multicluster-operators-rhel9'
   WHEN 3 THEN 'compliance/openshift-compliance-rhel8-operator'
   WHEN 4 THEN 'ubi8/ubi-minimal' ELSE 'odf4/mcg-rhel9-operator' END
 || '@sha256:' || H('img' || s_suppkey) AS IMAGE
FROM supplier""",
    "fx_finding": """
SELECT l_orderkey * 8 + l_linenumber AS finding_id, i.img_k, i.IMAGE, 'pkg' || (l_partkey % 30) AS COMPONENT,
 CASE l_partkey % 6 WHEN 0 THEN 'v1.' || l_linenumber || '.0'
  WHEN 1 THEN '1.' || (CAST(l_quantity AS INT) % 5) || '.0-' || l_linenumber || '.el8'
  WHEN 2 THEN '1.' || (CAST(l_quantity AS INT) % 5) || '.0-' || l_linenumber || '.el9_4'
  WHEN 3 THEN '1.' || (CAST(l_quantity AS INT) % 5) || '.0-' || l_linenumber || '.el9_2'
  WHEN 4 THEN '2.4.' || (CAST(l_quantity AS INT) % 5) || '-' || l_linenumber || '.module+el9.4.0+123+ab12'
  ELSE '1:3.0.' || (CAST(l_quantity AS INT) % 5) || '-' || l_linenumber || '.el9' END AS VERSION,
 'CVE-2024-' || (1000 + l_orderkey % 60 + 60 * (l_partkey // 2000)) AS CVE,
 CASE l_linenumber % 5 WHEN 0 THEN 'CRITICAL_VULNERABILITY_SEVERITY' WHEN 1 THEN 'IMPORTANT_VULNERABILITY_SEVERITY'
  WHEN 2 THEN 'MODERATE_VULNERABILITY_SEVERITY' WHEN 3 THEN 'LOW_VULNERABILITY_SEVERITY' ELSE '' END AS SEVERITY,
 CAST(CAST(l_quantity AS INT) % 10 AS DOUBLE) AS CVSS
FROM lineitem JOIN fx_img i ON l_suppkey = i.img_k""",
    "fx_given": """
SELECT finding_id, CASE WHEN finding_id % 83 <> 0 THEN IMAGE END AS IMAGE, CASE WHEN finding_id % 79 <> 0 THEN COMPONENT END AS COMPONENT,
 CASE WHEN finding_id % 89 <> 0 THEN VERSION END AS VERSION, CASE WHEN finding_id % 97 <> 0 THEN CVE END AS CVE, CASE WHEN finding_id % 101 <> 0 THEN SEVERITY END AS SEVERITY
FROM fx_finding""",
    "fx_pid": """
SELECT 'CVE-2024-' || (1000 + p_partkey % 55 + 60 * (p_partkey // 2000)) AS cve, CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS vuln_idx,
 CASE WHEN p_partkey % 55 IN (48, 50) THEN 'known_not_affected'
      WHEN p_partkey % 55 = 49 THEN 'flag'
      WHEN p_partkey % 55 % 11 = 3 THEN 'under_investigation'
      WHEN p_size % 4 = 0 THEN 'known_not_affected' WHEN p_size % 4 = 1 THEN 'known_affected'
      WHEN p_size % 4 = 2 THEN 'fixed' ELSE 'flag' END AS status,
 CAST(p_partkey AS BIGINT) AS pid_idx,
 CASE p_partkey % 55 WHEN 50 THEN 'red_hat_products' WHEN 48 THEN 'vendor_all' ELSE
 CASE p_partkey % 7 WHEN 0 THEN 'AppStream-9.4.0.Z.MAIN' WHEN 1 THEN 'red_hat_enterprise_linux_9'
  WHEN 2 THEN 'red_hat_enterprise_linux_8' WHEN 3 THEN '9Base-RHOSE-4.20'
  WHEN 4 THEN 'advanced_cluster_management_2' WHEN 5 THEN 'compliance_operator_1' ELSE 'JBCS-9.4' END
 || ':pkg' || (p_partkey * 13 % 30)
 || CASE WHEN p_size % 4 = 2 THEN '-0:1.' || (p_size % 5) || '.0-' || (p_size % 9)
      || CASE p_size % 3 WHEN 0 THEN '.el9_4' WHEN 1 THEN '.el9_2' ELSE '.el8' END || '.x86_64' ELSE '' END
 || CASE WHEN p_partkey % 10 = 0 THEN '::mod:1' ELSE '' END END AS pid
FROM part""",
    "fx_product": """
SELECT cve, product_id, CASE WHEN product_id = 'JBCS-9.4' AND right(cve, 1) IN ('1', '3', '5', '7', '9') THEN 'Core Services for Red Hat Enterprise Linux 9' ELSE name END AS name
FROM (SELECT DISTINCT cve FROM fx_pid) c CROSS JOIN (SELECT * FROM (VALUES ('AppStream-9.4.0.Z.MAIN','Red Hat Enterprise Linux AppStream (v. 9)'),
 ('red_hat_enterprise_linux_9','Red Hat Enterprise Linux 9'),('red_hat_enterprise_linux_8','Red Hat Enterprise Linux 8'),
 ('9Base-RHOSE-4.20','Red Hat OpenShift Container Platform 4.20'),
 ('advanced_cluster_management_2','Red Hat Advanced Cluster Management 2'),
 ('compliance_operator_1','Compliance Operator 1'),('JBCS-9.4','JBoss Core Services 9'),('deep_suite','Suite of Platforms 3')) AS t(product_id, name)) n
UNION ALL SELECT DISTINCT cve, pid, 'Red Hat Enterprise Linux 9 for core services' FROM fx_pid WHERE pid LIKE 'JBCS-9.4:pkg1%'""",
    "fx_vendor": """
SELECT DISTINCT cve, pid AS product_id FROM fx_pid WHERE pid = 'vendor_all'""",
    "fx_rel": """
SELECT cve, pid, CASE pid_idx % 3 WHEN 0 THEN 'deep_suite' ELSE 'unnamed_suite' END AS parent_pid, pid_idx AS pos FROM fx_pid WHERE pid_idx % 4 < 2""",
    "fx_doc": """
SELECT cve, num, CASE WHEN entries THEN 2 ELSE 0 END AS n_vulns,
 CASE num % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'Important' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'None' END AS aggregate_severity,
 CASE WHEN entries AND num % 3 = 0 THEN 'Low' END AS impact, CASE WHEN entries AND num % 4 = 0 THEN 'Moderate' END AS later_impact, CASE WHEN entries AND num % 2 = 0 THEN 'HIGH' END AS cvss_severity
FROM (SELECT cve, num, (num - 1000) % 60 < 55 AS entries FROM (SELECT DISTINCT 'CVE-2024-' || (1000 + l_orderkey % 58 + 60 * (l_partkey // 2000)) AS cve, 1000 + l_orderkey % 58 + 60 * (l_partkey // 2000) AS num FROM lineitem) d) e""",
    "fx_prefix": """
SELECT * FROM (VALUES ('rhacm2', 'advanced_cluster_management'), ('compliance', 'compliance_operator'), ('odf4', 'odf_operator')) AS t(ns_key, prefix)""",
    "fx_sbom": """
SELECT DISTINCT f.IMAGE AS image, f.COMPONENT AS name,
 CASE WHEN f.COMPONENT IN ('pkg3','pkg8') THEN f.VERSION || '.stale'
      WHEN f.VERSION LIKE '1:%' THEN substr(f.VERSION, 3) WHEN f.COMPONENT IN ('pkg2', 'pkg6') THEN '0:' || f.VERSION ELSE f.VERSION END AS version
FROM fx_finding f WHERE f.COMPONENT <> 'pkg9'""",
    "fx_report": """
SELECT finding_id, img_k, IMAGE, COMPONENT, VERSION, CVE, '4.' || (12 + img_k % 9) AS release, 'stable-' || (img_k % 3) AS channel, 'op' || (img_k % 7) AS operator,
 CASE SEVERITY WHEN 'CRITICAL_VULNERABILITY_SEVERITY' THEN 'Critical' WHEN 'IMPORTANT_VULNERABILITY_SEVERITY' THEN 'Important' ELSE 'Moderate' END AS SEVERITY,
 CASE WHEN finding_id % 5 = 0 THEN 'Low' ELSE 'Important' END AS RHACS_SEVERITY,
 CASE WHEN finding_id % 5 = 0 THEN 'True' ELSE 'False' END AS SEVERITY_MISMATCH,
 CASE WHEN finding_id % 4 = 0 THEN 'FALSE POSITIVE' ELSE 'POSITIVE' END AS AUDIT_RESULT,
 'reason ' || (finding_id % 11) AS JUSTIFICATION
FROM fx_finding""",
    "fx_entry": """
SELECT 'op' || s_nationkey AS package, 'stable-' || (s_suppkey % 3) AS channel, 'op' || s_nationkey || '.v1.' || s_suppkey || '.0' AS name, CAST(s_suppkey AS BIGINT) AS pos,
 CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE 'op' || s_nationkey || '.v1.' || (s_suppkey - 3) || '.0' END AS replaces,
 CASE WHEN s_suppkey % 5 = 0 THEN 'op' || s_nationkey || '.v1.' || (s_suppkey + 75) || '.0' ELSE 'none' END AS skip, img_k, IMAGE
FROM supplier JOIN fx_img ON img_k = s_suppkey""",
    "fx_related": """
SELECT e.name AS bundle, e.IMAGE AS bundle_image, CAST(r.k AS BIGINT) AS pos, 'role' || r.k AS role,
 CASE r.k WHEN 0 THEN e.IMAGE WHEN 1 THEN 'registry.redhat.io/x/a' || (e.img_k % 5) || '@sha256:' || H('a' || (e.img_k % 5))
  WHEN 2 THEN 'registry.redhat.io/x/copy@sha256:' || H('a' || (e.img_k % 5)) ELSE 'registry.redhat.io/x/tagged:v' || e.img_k END AS image
FROM fx_entry e CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3)) AS v(k)) r""",
    "fx_deployed": """
SELECT 'id' || img_k AS id, IMAGE AS name, img_k FROM fx_img WHERE img_k % 4 <> 0""",
    "fx_alert": """
SELECT CAST(o_orderkey AS BIGINT) AS alert_k, 'alert' || o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'RESOLVED' WHEN 'O' THEN 'ACTIVE' END AS state,
 'policy' || (o_orderkey % 6) AS policy_id, i.IMAGE AS image
FROM orders JOIN fx_img i ON i.img_k = o_orderkey % 97 + 1""",
}


#: Views of images that change with where they come from: of a platform release, of a namespace whose images have labels.
RELEASE = {
    "fx_img": """
SELECT s_suppkey AS img_k, s_nationkey AS nat_k, 'quay.io/openshift-release-dev/ocp-v4.0-art-dev@sha256:' || H('img' || s_suppkey) AS IMAGE,
 '4.' || (18 + s_suppkey % 4) || '.' || (s_suppkey % 3) AS release, CASE s_suppkey % 3 WHEN 1 THEN 'rhel-coreos-10' ELSE 'part' || s_suppkey END AS component,
 CASE s_suppkey % 3 WHEN 0 THEN 'rhel:9.4' END AS os_info
FROM supplier""",
}
LABELLED = {
    "fx_img": """
SELECT s_suppkey AS img_k, s_nationkey AS nat_k, 'mirror.local/' || CASE s_suppkey % 6 WHEN 3 THEN 'compliance/tool' WHEN 4 THEN 'compliance/other' WHEN 5 THEN 'odf4/mcg-rhel9-operator' ELSE 'x/y' END
  || '@sha256:' || H('img' || s_suppkey) AS IMAGE,
 CASE s_suppkey % 6 WHEN 0 THEN 'ubi9/ubi' WHEN 1 THEN 'openshift4/ose-cli-rhel8' WHEN 2 THEN 'rhacm2/multicluster-operators-rhel9' END AS label_name,
 CASE s_suppkey % 6 WHEN 1 THEN 'cpe:/a:redhat:openshift:4.20::el9' WHEN 2 THEN 'cpe:/a:redhat:acm:2.9::el8' WHEN 5 THEN 'cpe:/a:redhat:odf:4.15::el9' END AS label_cpe,
 CASE s_suppkey % 6 WHEN 3 THEN 'Red Hat Enterprise Linux' WHEN 5 THEN 'rhel' END AS distro_name, CASE s_suppkey % 6 WHEN 3 THEN '9.4' WHEN 5 THEN '8.8' END AS distro_version
FROM supplier""",
}


def _needs(name: str, views: dict[str, str]) -> list[str]:
    """The views and tables that a view reads, in order, itself last."""
    out: list[str] = []
    for other in [*views, *STAR]:
        if other != name and re.search(rf"\b(FROM|JOIN) {other}\b", views.get(name, "")):
            out += [x for x in _needs(other, views) if x not in out]
    return [*out, name]


_read: dict[tuple[str, str], DataFrame] = {}


def star_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A star table; its schema is read once in a session."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}.parquet")
    if key not in _read:
        _read[key] = spark.read.parquet(key[1])
    return _read[key]


def fixture(spark: SparkSession, sf_dir: str, name: str, changed: dict[str, str] | None = None) -> DataFrame:
    """A domain table as a DataFrame over the tables in ``sf_dir``; ``changed`` views take the place of those of SQL."""
    views = SQL | (changed or {})
    made: dict[str, DataFrame] = {}
    for view in _needs(name, views):
        if view in views:
            text = re.sub(r"\bH\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)", views[view]).replace("//", "div")
            used = {x: made[x] for x in made if re.search(rf"\b(FROM|JOIN) {x}\b", text)}
            for x in used:
                text = re.sub(rf"\b(FROM|JOIN) {x}\b", rf"\1 {{{x}}}", text)
            made[view] = spark.sql(text, **used)
        else:
            made[view] = star_table(spark, sf_dir, view)
    return made[name]


def duck_views(changed: dict[str, str] | None = None) -> str:
    """The same views as the beginning of a DuckDB WITH clause."""
    return ",\n".join(f"{k} AS ({re.sub(r'\bH\(', 'sha256(', v)})" for k, v in (SQL | (changed or {})).items())
