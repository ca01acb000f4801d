"""DuckDB views shared by the oracles: the fixtures, then contexts, parsed product ids, scope and verdicts."""

from __future__ import annotations

from findsieve.plans.fixtures import duck_views

VIEWS = r"""
im0 AS (SELECT *, lower(regexp_replace(regexp_replace(IMAGE, '^[^/]+/', ''), '[@:][^/]*$', '')) AS path FROM fx_img),
im1 AS (SELECT *, split_part(path, '/', 1) AS image_ns, CASE WHEN contains(path, '/') THEN regexp_replace(path, '^[^/]*/', '') ELSE '' END AS image_name FROM im0),
im2 AS (SELECT *, coalesce(nullif(regexp_extract(image_name, 'rhel(\d+)', 1), ''), nullif(regexp_extract(image_ns, 'rhel(\d+)', 1), ''),
    nullif(regexp_extract(image_ns, '^ubi(\d+)$', 1), ''), '8') AS rhel_ver, nullif(regexp_extract(IMAGE, 'v(4\.\d+)', 1), '') AS ocp_ver,
  regexp_extract(IMAGE, '@sha256:([a-f0-9]+)', 1) AS img_sha,
  CASE WHEN regexp_matches(image_ns, '^ubi\d+') OR image_name = '' OR image_ns IN ('ubi', 'rhel') THEN 'ubi'
       WHEN image_ns IN ('openshift4', 'ocp4') OR contains(image_name, 'ose-') THEN 'ocp' ELSE 'operator' END AS workload_type FROM im1),
ctx AS (CONTEXTS),
px AS (SELECT img_k, prefix FROM ctx JOIN fx_prefix ON contains(image_ns, ns_key) OR contains(image_name, ns_key) WHERE workload_type = 'operator'
  UNION SELECT img_k, host || '/' || image_ns || '/' FROM ctx WHERE workload_type = 'operator'
  UNION SELECT img_k, image_ns || '/' FROM ctx WHERE workload_type = 'operator'),
pd0 AS (SELECT *, split_part(pid, '::', 1) AS bare, split_part(pid, ':', 1) AS parent, contains(pid, '::') AS is_module FROM fx_pid),
pd1 AS (SELECT *, CASE WHEN contains(bare, ':') THEN regexp_replace(bare, '^[^:]*:', '') END AS comp FROM pd0),
rl AS (SELECT r.cve, pid, coalesce(name, parent_pid) AS rel_name FROM (SELECT cve, pid, arg_max(parent_pid, pos) AS parent_pid FROM fx_rel GROUP BY cve, pid) r
  LEFT JOIN fx_product n ON n.cve = r.cve AND n.product_id = parent_pid),
pd AS (SELECT pd1.*, coalesce(rel_name, n.name, parent) AS label, coalesce(nullif(n.name, ''), o.name) AS product_name, coalesce(starts_with(n.name, 'Red Hat Enterprise Linux'), false) OR coalesce(starts_with(o.name, 'Red Hat Enterprise Linux'), false) AS rhel_base,
  CASE WHEN regexp_matches(comp, '-\d+:') THEN regexp_extract(comp, '^(.*?)-\d+:', 1) ELSE regexp_replace(comp, '\.(aarch64|x86_64|ppc64le|s390x|i686|noarch|src)$', '') END AS pkg_name,
  CASE WHEN regexp_matches(comp, '-\d+:') THEN regexp_replace(regexp_replace(comp, '^.*?-\d+:', ''), '\.(aarch64|x86_64|ppc64le|s390x|i686|noarch|src)$', '') END AS fix_ver,
  status IN ('known_not_affected', 'flag') AS clears, rel_name FROM pd1 LEFT JOIN fx_product n ON n.product_id = parent AND n.cve = pd1.cve LEFT JOIN fx_product o ON o.product_id = pd1.pid AND o.cve = pd1.cve LEFT JOIN rl ON rl.cve = pd1.cve AND rl.pid = pd1.pid),
kinds AS (SELECT DISTINCT rhel_ver AS rv, workload_type AS wt, ocp_ver AS ov, display_name AS dn, image_ns AS ns FROM ctx),
kp AS (SELECT DISTINCT display_name AS dn, prefix FROM ctx JOIN px USING (img_k)),
sc AS (SELECT k.*, pd.*, (rhel_base AND (contains(lower(pid), 'enterprise_linux_' || rv) OR regexp_matches(pid, '\.el' || rv || '([_.\-a-z]|$)') OR regexp_matches(pid, '^[a-zA-Z]+-' || rv || '[.\-]')))
   OR (wt = 'ocp' AND coalesce(contains(lower(product_name), 'openshift container platform'), false)
       AND (ov IS NULL OR list_slice(string_split(ov, '.'), 1, len(string_split(list_last(string_split(product_name, ' ')), '.'))) = string_split(list_last(string_split(product_name, ' ')), '.')))
   OR (wt = 'operator' AND EXISTS (SELECT 1 FROM kp WHERE kp.dn = k.dn AND contains(lower(pid), lower(prefix)))) AS in_scope
  FROM kinds k CROSS JOIN pd),
fi AS (SELECT f.*, c.rhel_ver, c.workload_type, c.display_name, c.image_ns, nullif(regexp_extract(VERSION, '[.+]el(\d+)', 1), '') AS row_rhel,
  coalesce(nullif(regexp_extract(VERSION, '\.el\d+_(\d+)', 1), ''), nullif(regexp_extract(VERSION, '[.+]el\d+\.(\d+)\.', 1), '')) AS minor,
  contains(VERSION, '.module+') OR contains(VERSION, '+module+') AS modver FROM fx_finding f JOIN ctx c USING (img_k)),
gi AS (SELECT g.finding_id, img_k, g.IMAGE, g.COMPONENT, g.VERSION, g.CVE, g.SEVERITY, coalesce(c.rhel_ver, '8') AS rhel_ver, coalesce(c.workload_type, 'ubi') AS workload_type,
  coalesce(c.display_name, 'UBI8') AS display_name, c.image_ns, nullif(regexp_extract(VERSION, '[.+]el(\d+)', 1), '') AS row_rhel,
  coalesce(nullif(regexp_extract(VERSION, '\.el\d+_(\d+)', 1), ''), nullif(regexp_extract(VERSION, '[.+]el\d+\.(\d+)\.', 1), '')) AS minor,
  coalesce(contains(VERSION, '.module+') OR contains(VERSION, '+module+'), false) AS modver FROM fx_given g LEFT JOIN ctx c USING (IMAGE)),
qs AS (SELECT DISTINCT CVE, COMPONENT, VERSION, display_name, rhel_ver, workload_type, row_rhel, minor, modver FROM gi),
ev AS (SELECT q.CVE, q.COMPONENT, q.VERSION, q.display_name,
  bool_or(in_scope AND clears) AS cleared,
  arg_min(fix_ver, pid_idx) FILTER (in_scope AND status = 'fixed' AND fix_ver IS NOT NULL) AS fix_first,
  arg_min(fix_ver, pid_idx) FILTER (in_scope AND status = 'fixed' AND fix_ver IS NOT NULL AND same) AS fix_same,
  arg_min(fix_ver, pid_idx) FILTER (in_scope AND status = 'fixed' AND fix_ver IS NOT NULL AND met) AS fix_met,
  arg_min(fix_ver, pid_idx) FILTER (in_scope AND status = 'fixed' AND fix_ver IS NOT NULL AND same AND met) AS fix_same_met,
  arg_min(pid_idx % 3 = 0, pid_idx) FILTER (in_scope AND status = 'known_affected') AS no_fix,
  list_sort(list(DISTINCT label) FILTER (NOT in_scope AND near AND status IN ('known_affected', 'fixed'))) AS near_affected,
  list_sort(list(DISTINCT label) FILTER (NOT in_scope AND near AND status = 'known_not_affected')) AS near_safe
  FROM (SELECT q.*, s.in_scope, s.clears, s.status, s.fix_ver, s.pid_idx, s.label,
      coalesce(coalesce(nullif(regexp_extract(fix_ver, '\.el\d+_(\d+)', 1), ''), nullif(regexp_extract(fix_ver, '[.+]el\d+\.(\d+)\.', 1), '')) = minor, false) AS same,
      coalesce(CASE WHEN contains(VERSION, ':') THEN CAST(split_part(VERSION, ':', 1) AS INT) > 0 OR rkey(regexp_replace(VERSION, '^[^:]*:', '')) >= rkey(fix_ver)
        ELSE rkey(VERSION) >= rkey(fix_ver) END, false) AS met,
      contains(lower(pid), 'enterprise_linux_' || row_rhel) OR regexp_matches(pid, '\.el' || row_rhel || '([_.\-a-z]|$)') OR regexp_matches(pid, '^[a-zA-Z]+-' || row_rhel || '[.\-]')
        OR regexp_matches(pid, '^' || row_rhel || '[A-Za-z]') AS near
    FROM qs q JOIN sc s ON s.cve = q.CVE AND s.dn = q.display_name AND s.pkg_name = q.COMPONENT WHERE row_rhel IS NOT NULL AND vuln_idx = 0 AND (NOT is_module OR modver)) q
  GROUP BY ALL),
lb AS (SELECT cve, list_sort(list(DISTINCT label) FILTER (status = 'known_affected')) AS la, list_sort(list(DISTINCT label) FILTER (status = 'fixed')) AS lf,
  list_sort(list(DISTINCT label) FILTER (clears)) AS ln, list_sort(list(DISTINCT label) FILTER (status = 'under_investigation')) AS li,
  bool_or(pid IN ('red_hat_products', 'vendor_all') AND clears) AS catchall FROM pd GROUP BY cve),
wk AS (SELECT cve, dn, arg_min(label, struct_pack(v := vuln_idx, p := pid_idx)) FILTER (in_scope AND status = 'flag') AS flag_at,
  arg_min(struct_pack(status := status, label := label), struct_pack(v := vuln_idx, r := CASE status WHEN 'known_not_affected' THEN 0 WHEN 'known_affected' THEN 1 WHEN 'fixed' THEN 2 ELSE 3 END, p := pid_idx))
    FILTER (in_scope AND status <> 'flag') AS stated_at, bool_or(in_scope AND status <> 'under_investigation') AS any_scope,
  bool_or(in_scope AND vuln_idx = 0 AND status = 'under_investigation' AND NOT is_module) AS inv_plain, bool_or(in_scope AND vuln_idx = 0 AND status = 'under_investigation' AND is_module) AS inv_module
  FROM sc GROUP BY cve, dn),
pl AS (SELECT q.CVE, q.COMPONENT, q.display_name, list_sort(list(DISTINCT s.rel_name)) AS related FROM (SELECT DISTINCT CVE, COMPONENT, display_name FROM qs) q
  JOIN sc s ON s.cve = q.CVE AND s.dn = q.display_name AND s.pkg_name = q.COMPONENT WHERE in_scope AND status <> 'under_investigation' AND rel_name IS NOT NULL GROUP BY ALL),
ofx AS (SELECT cve, dn, rr, list_sort(list(DISTINCT label)) AS outside FROM sc, (SELECT DISTINCT row_rhel AS rr FROM qs WHERE row_rhel IS NOT NULL)
  WHERE status = 'fixed' AND vuln_idx = 0 AND NOT in_scope AND (contains(lower(pid), 'enterprise_linux_' || rr) OR regexp_matches(pid, '\.el' || rr || '([_.\-a-z]|$)')
    OR regexp_matches(pid, '^[a-zA-Z]+-' || rr || '[.\-]') OR regexp_matches(pid, '^' || rr || '[A-Za-z]')) GROUP BY ALL),
vd0 AS (SELECT fi.*, d.cve IS NOT NULL AS has_doc, d.n_vulns, d.aggregate_severity, d.impact, d.later_impact, d.cvss_severity, lb.*, wk.flag_at, wk.stated_at.status AS stated, wk.stated_at.label AS stated_label,
   wk.any_scope, related, wk.inv_plain, wk.inv_module, outside,
   cleared, fix_first, fix_same, fix_met, fix_same_met, no_fix, near_affected, near_safe,
   CASE WHEN minor IS NOT NULL THEN fix_same_met ELSE fix_met END AS met_fix
  FROM gi fi LEFT JOIN fx_doc d ON d.cve = fi.CVE LEFT JOIN lb ON lb.cve = fi.CVE LEFT JOIN wk ON wk.cve = fi.CVE AND wk.dn = fi.display_name
  LEFT JOIN ofx ON ofx.cve = fi.CVE AND ofx.dn = fi.display_name AND rr = row_rhel
  LEFT JOIN ev ON ev.CVE = fi.CVE AND ev.COMPONENT = fi.COMPONENT AND ev.VERSION = fi.VERSION AND ev.display_name = fi.display_name
  LEFT JOIN pl ON pl.CVE = fi.CVE AND pl.COMPONENT = fi.COMPONENT AND pl.display_name = fi.display_name),
vd1 AS (SELECT *, CASE WHEN NOT has_doc THEN 'R0' WHEN catchall THEN 'R1'
  WHEN row_rhel IS NULL AND la IS NULL AND lf IS NULL AND ln IS NULL AND li IS NULL THEN 'R2'
  WHEN row_rhel IS NULL AND workload_type <> 'ubi' AND flag_at IS NOT NULL THEN 'R3'
  WHEN row_rhel IS NULL AND workload_type <> 'ubi' AND stated IS NOT NULL THEN 'R4'
  WHEN row_rhel IS NULL AND li IS NOT NULL THEN 'R5' WHEN row_rhel IS NULL AND ln IS NOT NULL AND la IS NULL AND lf IS NULL THEN 'R6' WHEN row_rhel IS NULL THEN 'R7'
  WHEN n_vulns = 0 THEN 'R8' WHEN cleared THEN 'R9' WHEN fix_first IS NOT NULL AND minor IS NOT NULL AND fix_same IS NULL THEN 'R10a'
  WHEN fix_first IS NOT NULL AND met_fix IS NOT NULL THEN 'R10b' WHEN fix_first IS NOT NULL THEN 'R10c'
  WHEN no_fix THEN 'R11a' WHEN no_fix IS NOT NULL AND outside IS NOT NULL THEN 'R11b' WHEN no_fix IS NOT NULL THEN 'R11c'
  WHEN inv_plain OR (inv_module AND modver) THEN 'R12' WHEN near_safe IS NOT NULL AND near_affected IS NULL THEN 'R13' WHEN near_affected IS NOT NULL THEN 'R14' ELSE 'R15' END AS RULE,
  CASE SEVERITY WHEN 'CRITICAL_VULNERABILITY_SEVERITY' THEN 'Critical' WHEN 'IMPORTANT_VULNERABILITY_SEVERITY' THEN 'Important' WHEN 'MODERATE_VULNERABILITY_SEVERITY' THEN 'Moderate'
    WHEN 'LOW_VULNERABILITY_SEVERITY' THEN 'Low' ELSE 'Unknown' END AS scanner,
  coalesce(impact, nullif(aggregate_severity, 'None'), later_impact, CASE cvss_severity WHEN 'HIGH' THEN 'Important' END) AS stated_severity FROM vd0),
vd AS (SELECT finding_id, CASE WHEN len(related) > 0 THEN array_to_string(related, ', ') WHEN any_scope THEN display_name ELSE '' END AS VEX_PRODUCT,
  CASE RULE WHEN 'R0' THEN 'no advisory for this CVE' WHEN 'R1' THEN 'the vendor clears all its products' WHEN 'R2' THEN 'the advisory names no product'
   WHEN 'R3' THEN display_name || ': cleared by flag vulnerable code not present for ' || flag_at WHEN 'R4' THEN display_name || ': ' || replace(stated, '_', ' ') || ' for ' || stated_label
   WHEN 'R5' THEN 'investigated for ' || array_to_string(li[1:3], ', ') WHEN 'R6' THEN 'not affected: ' || array_to_string(ln[1:3], ', ')
   WHEN 'R7' THEN 'affected: ' || coalesce(array_to_string(la[1:3], ', '), '') || '; fixed: ' || coalesce(array_to_string(lf[1:3], ', '), '') || '; not affected: ' || coalesce(array_to_string(ln[1:3], ', '), '')
   WHEN 'R8' THEN 'the advisory has no entry' WHEN 'R9' THEN coalesce(COMPONENT, '') || ' is not affected in ' || display_name
   WHEN 'R10a' THEN display_name || ': stream el' || rhel_ver || '_' || minor || ' has no fix yet; installed ' || VERSION || ', fixed elsewhere in ' || fix_first
   WHEN 'R10b' THEN display_name || ': installed ' || VERSION || ' has the fix of ' || met_fix
   WHEN 'R10c' THEN display_name || ': installed ' || VERSION || ' is older than the fix ' || CASE WHEN minor IS NOT NULL THEN fix_same ELSE fix_first END
   WHEN 'R11a' THEN display_name || ': affected, no fix planned' WHEN 'R11b' THEN display_name || ': affected, fixed only in ' || array_to_string(outside, ', ')
   WHEN 'R11c' THEN display_name || ': affected, no fix yet' WHEN 'R12' THEN display_name || ': under investigation'
   WHEN 'R13' THEN coalesce(COMPONENT, '') || ' is not affected in ' || array_to_string(near_safe, ', ') WHEN 'R14' THEN coalesce(COMPONENT, '') || ' is affected in ' || array_to_string(near_affected, ', ')
   ELSE coalesce(COMPONENT, '') || ' is not tracked in this advisory' END AS JUSTIFICATION, img_k, IMAGE, COMPONENT, VERSION, CVE, RULE, scanner AS RHACS_SEVERITY, display_name, workload_type, image_ns,
  CASE WHEN has_doc THEN coalesce(stated_severity, scanner) ELSE 'UNKNOWN' END AS VEX_SEVERITY,
  CASE WHEN RULE IN ('R1', 'R2', 'R3', 'R6', 'R9', 'R10b', 'R13', 'R15') OR (RULE = 'R4' AND stated IN ('known_not_affected', 'fixed')) THEN 'FALSE POSITIVE' ELSE 'POSITIVE' END AS AUDIT_RESULT,
  CASE RULE WHEN 'R10a' THEN fix_first WHEN 'R10b' THEN met_fix WHEN 'R10c' THEN CASE WHEN minor IS NOT NULL THEN fix_same ELSE fix_first END ELSE 'N/A' END AS VEX_FIX_VER,
  RULE IN ('R5', 'R12') OR (RULE = 'R4' AND stated = 'under_investigation') AS under_investigation FROM vd1),
res AS (SELECT *, VEX_SEVERITY <> RHACS_SEVERITY AND RHACS_SEVERITY <> 'Unknown' AS SEVERITY_MISMATCH FROM vd)
"""

#: Contexts of images: by their references alone, of a platform release, by labels and distro blocks.
BY_REFERENCE = """SELECT *, split_part(IMAGE, '/', 1) AS host, CASE workload_type WHEN 'ubi' THEN 'UBI' || rhel_ver WHEN 'ocp' THEN 'OpenShift ' || coalesce(ocp_ver, '4.x')
    ELSE image_ns || '/' || image_name || ' (RHEL ' || rhel_ver || ')' END AS display_name FROM im2"""
OF_RELEASE = """SELECT * EXCLUDE (rhel_ver, ocp_ver, workload_type), split_part(IMAGE, '/', 1) AS host, CASE img_k % 3 WHEN 0 THEN '9' WHEN 1 THEN '10' ELSE rhel_ver END AS rhel_ver,
  '4.' || (18 + img_k % 4) AS ocp_ver, 'ocp' AS workload_type, 'OpenShift ' || release AS display_name FROM im2"""
BY_LABELS = """SELECT i.* EXCLUDE (rhel_ver, ocp_ver, workload_type, image_ns, image_name), c.* EXCLUDE (k) FROM im2 i JOIN (VALUES
  (0, 'registry.redhat.io', 'ubi9', 'ubi', '9', NULL, 'ubi', 'UBI9'), (1, 'registry.redhat.io', 'openshift4', 'ose-cli-rhel8', '9', '4.20', 'ocp', 'OpenShift 4.x 4.20'),
  (2, 'registry.redhat.io', 'rhacm2', 'multicluster-operators-rhel9', '8', NULL, 'operator', 'rhacm2/multicluster-operators-rhel9 2.9'),
  (3, 'mirror.local', 'compliance', 'tool', '9', NULL, 'operator', 'compliance/tool (RHEL 8)'), (4, 'mirror.local', 'compliance', 'other', '8', NULL, 'operator', 'compliance/other (RHEL 8)'),
  (5, 'mirror.local', 'odf4', 'mcg-rhel9-operator', '9', NULL, 'operator', 'odf4/mcg-rhel9-operator 4.15')) AS c(k, host, image_ns, image_name, rhel_ver, ocp_ver, workload_type, display_name) ON img_k % 6 = c.k"""

#: The order of a version without its epoch, as a list expression.
KEY = (
    "list_append(list_transform(regexp_extract_all({0}, '([0-9]+|[A-Za-z]+|~|\\^)', 1), lambda t: CASE WHEN t = '~' THEN '0' WHEN t = '^' THEN '2' "
    "WHEN regexp_matches(t, '^[A-Za-z]') THEN '3' || t ELSE '4' || lpad(CAST(length(ltrim(t, '0')) AS VARCHAR), 4, '0') || ltrim(t, '0') END), '1')"
)


def _keys(sql: str) -> str:
    """Replace each ``rkey(x)`` by the key expression; x may hold brackets."""
    while (at := sql.find("rkey(")) >= 0:
        depth, end = 1, at + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[:at] + KEY.format(sql[at + 5 : end - 1]) + sql[end:]
    return sql


def duck(sql: str, more: str = "", changed: dict[str, str] | None = None, contexts: str = BY_REFERENCE) -> str:
    """An oracle: the shared views, ``more`` views (each ending with a comma-less body), then the query; ``changed`` fixtures and ``contexts`` take the place of the usual ones."""
    return _keys("WITH " + duck_views(changed) + "," + VIEWS.replace("CONTEXTS", contexts) + ("," + more if more else "") + "\n" + sql)
