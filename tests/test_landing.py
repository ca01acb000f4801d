"""Hand-written landing files: deep product trees, catalogs with braces in strings, lists of mixed names, rules by hand."""

import json

from pyspark.sql import functions as F

from findsieve.plans import jobs
from findsieve.plans.adjudicate import contexts
from findsieve.sources import landing
from findsieve.streaming.ingest import ingest_reports, ingest_scans


def advisory(path, cve, status=None, flags=(), nofix=(), tree=(), impact=None, vulns=True):
    vuln = {"product_status": status or {}, "flags": [{"label": "component_not_present", "product_ids": list(flags)}] if flags else [], "remediations": [{"category": "no_fix_planned", "product_ids": list(nofix)}]}
    if impact:
        vuln["threats"] = [{"category": "impact", "details": impact}]
    doc = {"document": {}, "product_tree": {"branches": list(tree)}, "vulnerabilities": [vuln] if vulns else []}
    (path / f"{cve.lower()}.json").write_text(json.dumps(doc, indent=1))


def leaf(pid, name):
    return {"name": "x", "product": {"product_id": pid, "name": name}}


TREE = [{"name": "v", "branches": [{"name": "f", "branches": [leaf("red_hat_enterprise_linux_9", "Red Hat Enterprise Linux 9"), leaf("A-9.4", "Red Hat Enterprise Linux AppStream 9"), {"name": "deep", "branches": [leaf("J-9.4", "JBoss 9"), leaf("ocp", "Red Hat OpenShift Container Platform 4.20")]}]}]}]


def test_rules_by_hand(spark, tmp_path):
    sha, other = "a" * 64, "b" * 64
    ubi, ocp, op = f"registry.redhat.io/ubi9/ubi@sha256:{sha}", f"registry.redhat.io/openshift4/ose-x-rhel9:v4.20@sha256:{sha}", f"registry.redhat.io/team/thing-rhel9@sha256:{sha}"
    cases = [  # CVE, advisory, image, component, version, rule, result
        ("CVE-2024-0001", None, ubi, "a", "1-1.el9", "R0", "POSITIVE"),
        ("CVE-2024-0002", {"status": {"known_not_affected": ["red_hat_products"]}}, ubi, "a", "1-1.el9", "R1", "FALSE POSITIVE"),
        ("CVE-2024-0003", {}, ubi, "a", "v1", "R2", "FALSE POSITIVE"),
        ("CVE-2024-0004", {"flags": [f"x:team/thing-rhel9@sha256:{sha}"], "status": {"known_affected": ["team/:y"]}}, op, "a", "v1", "R3", "FALSE POSITIVE"),
        ("CVE-2024-0005", {"flags": [f"x:team/thing-rhel9@sha256:{other}"], "status": {"known_affected": ["team/:y"]}}, op, "a", "v1", "R4", "POSITIVE"),
        ("CVE-2024-0006", {"status": {"under_investigation": ["J-9.4:z"]}}, ubi, "a", "v1", "R5", "POSITIVE"),
        ("CVE-2024-0007", {"status": {"known_not_affected": ["J-9.4:z"]}}, ubi, "a", "v1", "R6", "FALSE POSITIVE"),
        ("CVE-2024-0008", {"status": {"known_affected": ["J-9.4:z"]}}, ubi, "a", "v1", "R7", "POSITIVE"),
        ("CVE-2024-0009", {"vulns": False}, ubi, "a", "1-1.el9", "R8", "POSITIVE"),
        ("CVE-2024-0010", {"status": {"known_not_affected": ["red_hat_enterprise_linux_9:a"]}}, ubi, "a", "1-1.el9", "R9", "FALSE POSITIVE"),
        ("CVE-2024-0011", {"status": {"fixed": ["A-9.4:a-0:2-1.el9_2.x86_64"]}}, ubi, "a", "1-1.el9_4", "R10a", "POSITIVE"),
        ("CVE-2024-0012", {"status": {"fixed": ["A-9.4:a-0:2-1.el9_4.x86_64"]}}, ubi, "a", "2-2.el9_4", "R10b", "FALSE POSITIVE"),
        ("CVE-2024-0013", {"status": {"fixed": ["A-9.4:a-0:2-1.el9_4.x86_64"]}}, ubi, "a", "1-2.el9_4", "R10c", "POSITIVE"),
        ("CVE-2024-0014", {"status": {"known_affected": ["red_hat_enterprise_linux_9:a"]}, "nofix": ["red_hat_enterprise_linux_9:a"]}, ubi, "a", "1-1.el9", "R11a", "POSITIVE"),
        ("CVE-2024-0015", {"status": {"known_affected": ["red_hat_enterprise_linux_9:a"], "fixed": ["J-9.4:q-0:1-1.el9.x86_64"]}}, ubi, "a", "1-1.el9", "R11b", "POSITIVE"),
        ("CVE-2024-0016", {"status": {"known_affected": ["red_hat_enterprise_linux_9:a"]}}, ubi, "a", "1-1.el9", "R11c", "POSITIVE"),
        ("CVE-2024-0017", {"status": {"under_investigation": ["red_hat_enterprise_linux_9:zz"]}}, ubi, "a", "1-1.el9", "R12", "POSITIVE"),
        ("CVE-2024-0018", {"status": {"known_not_affected": ["J-9.4:a"]}}, ubi, "a", "1-1.el9", "R13", "FALSE POSITIVE"),
        ("CVE-2024-0019", {"status": {"known_affected": ["J-9.4:a"]}}, ubi, "a", "1-1.el9", "R14", "POSITIVE"),
        ("CVE-2024-0020", {"status": {"known_affected": ["red_hat_enterprise_linux_9:b"]}}, ubi, "a", "1-1.el9", "R15", "FALSE POSITIVE"),
        ("CVE-2024-0021", {"status": {"known_affected": ["ocp:a"]}}, ocp, "a", "1-1.el9", "R11c", "POSITIVE"),
        ("CVE-2024-0022", {"status": {"known_not_affected": ["red_hat_enterprise_linux_9:a::mod:1"]}}, ubi, "a", "1-1.el9", "R15", "FALSE POSITIVE"),
        ("CVE-2024-0023", {"status": {"known_not_affected": ["red_hat_enterprise_linux_9:src-a"]}}, ubi, "a", "1-1.el9", "R9", "FALSE POSITIVE"),
    ]
    for cve, spec, *_ in cases:
        if spec is not None:
            advisory(tmp_path, cve, tree=TREE, impact="Low", **spec)
    findings = spark.createDataFrame([(i, c[2], c[3], c[4], c[0], "LOW") for i, c in enumerate(cases)], "finding_id long, IMAGE string, COMPONENT string, VERSION string, CVE string, SEVERITY string")
    prefixes = spark.createDataFrame([("nothing", ["none"])], "ns_key string, prefixes array<string>")
    src = spark.createDataFrame([(ubi, "a", "src-a")], "image string, binary string, source string")
    out = jobs.adjudicate_findings(findings, landing.read_advisories(spark, str(tmp_path)), prefixes, src)
    got = {r["CVE"]: (r["RULE"], r["AUDIT_RESULT"]) for r in out.collect()}
    assert got == {c[0]: (c[5], c[6]) for c in cases}
    assert {r["SEVERITY"] for r in out.where("RULE <> 'R0' AND RULE <> 'R8'").select("SEVERITY").collect()} == {"Low"}


def test_deep_product_tree_and_last_name(spark, tmp_path):
    deep = leaf("p", "deepest")
    for i in range(6):
        deep = {"name": f"n{i}", "branches": [leaf("q", f"q{i}"), deep]}
    advisory(tmp_path, "CVE-2024-1000", tree=[deep])
    rows = {r["product_id"]: r["name"] for r in landing.product_rows(landing.read_advisories(spark, str(tmp_path))).collect()}
    assert rows["p"] == "deepest" and "q" in rows


def test_catalog_with_braces_in_strings(spark, tmp_path):
    text = "\n".join(json.dumps(x, indent=1) for x in ({"schema": "olm.package", "name": "a", "d": "{\n{ }"}, {"schema": "olm.bundle", "name": "a.v1", "d": "}{"}, {"schema": "olm.channel", "name": "c", "entries": [{"name": "a.v1"}]}))
    (tmp_path / "catalog-4.20.json").write_text(text)
    rows = landing.read_catalog(spark, str(tmp_path)).collect()
    assert sorted(r["schema"] for r in rows) == ["olm.bundle", "olm.channel", "olm.package"]
    assert landing.read_catalog(spark, str(tmp_path)).select(landing.catalog_version(F.col("source_file"))).first()[0] == "4.20"


def test_image_names_as_text_or_object(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": "1", "name": "a/b"}\n{"id": "2", "name": {"fullName": "c/d"}}\n{"id": "3"}\n')
    got = landing.listed_images(spark.read.schema("id STRING, name VARIANT").json(str(tmp_path)))
    assert {r["id"]: r["name"] for r in got.collect()} == {"1": "a/b", "2": "c/d", "3": ""}


def test_contexts_collapse(spark):
    refs = spark.createDataFrame([(f"registry.redhat.io/ubi9/ubi@sha256:{c * 64}",) for c in "ab"], "IMAGE string")
    prefixes = spark.createDataFrame([], "ns_key string, prefixes array<string>")
    ids = contexts(refs, prefixes).where("IMAGE <> ''").select("ctx_id").distinct().count()
    assert ids == 1


def test_streaming_reads_each_file_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    doc = {"id": "i", "scan": {"components": [{"name": "c", "version": "1", "fixedBy": "2", "vulns": [{"cve": " cve-1 ", "severity": "LOW"}, {"cve": ""}]}]}}
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps(doc))
        ingest_scans(spark, src, out, mark).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert [(r["CVE"], r["FIXED_VERSION"]) for r in rows] == [("CVE-1", "2")] * 2


def test_findings_with_nulls_keep_their_rows(spark, tmp_path):
    """One row for each finding, whichever of its columns is null."""
    advisory(tmp_path, "CVE-2024-0001", tree=TREE, status={"known_not_affected": ["red_hat_enterprise_linux_9:a"]})
    image = f"registry.redhat.io/ubi9/ubi@sha256:{'a' * 64}"
    full = (image, "a", "1-1.el9", "CVE-2024-0001", "LOW")
    rows = [(i, *(None if k == i else x for k, x in enumerate(full))) for i in range(6)] + [(9, None, None, None, None, None), (10, "other/image", *full[1:])]
    findings = spark.createDataFrame(rows, "finding_id long, IMAGE string, COMPONENT string, VERSION string, CVE string, SEVERITY string")
    prefixes = spark.createDataFrame([], "ns_key string, prefixes array<string>")
    out = {r["finding_id"]: r for r in jobs.adjudicate_findings(findings, landing.read_advisories(spark, str(tmp_path)), prefixes).collect()}
    assert {k: (out[k]["IMAGE"], out[k]["COMPONENT"], out[k]["VERSION"], out[k]["CVE"]) for k in out} == {r[0]: r[1:5] for r in rows}
    assert {k: out[k]["RULE"] for k in out} == {0: "R13", 1: "R15", 2: "R6", 3: "R0", 4: "R9", 5: "R9", 9: "R0", 10: "R13"}


def test_names_are_of_the_advisory(spark, tmp_path):
    """A product that one advisory names is unknown to the others; only names that begin so are of the operating system."""
    mine = [{"name": "v", "branches": [leaf("X-9.4", "Red Hat Enterprise Linux 9")]}]
    theirs = [{"name": "v", "branches": [leaf("X-9.4", "Suite for Red Hat Enterprise Linux 9")]}]
    for n, tree in enumerate((mine, theirs, [])):
        advisory(tmp_path, f"CVE-2024-000{n}", tree=tree, status={"known_not_affected": ["X-9.4:a"]})
    t = jobs.advisory_tables(landing.read_advisories(spark, str(tmp_path)))
    from findsieve.plans.adjudicate import parse_pids

    rows = parse_pids(t["pids"], t["products"], t["relationships"], t["vendor_wide"]).collect()
    assert {r["cve"][-1]: (r["rhel_base"], r["label"]) for r in rows} == {"0": (True, "Red Hat Enterprise Linux 9"), "1": (False, "Suite for Red Hat Enterprise Linux 9"), "2": (False, "X-9.4")}


def test_severities_of_later_entries_and_vendor_wide_ids(spark, tmp_path):
    entry = lambda impact: {"product_status": {"known_not_affected": ["everything"]}, "threats": [{"category": "impact", "details": impact}] if impact else []}
    top = {"name": "x", "product": {"product_id": "everything", "name": "All", "product_identification_helper": {"cpe": "cpe:/a:redhat"}}}
    for n, (impacts, cpe) in enumerate(((["", "low"], True), (["", ""], False))):
        doc = {"document": {}, "product_tree": {"branches": [top if cpe else leaf("everything", "All")]}, "vulnerabilities": [entry(i) for i in impacts]}
        (tmp_path / f"cve-2024-000{n}.json").write_text(json.dumps(doc))
    findings = spark.createDataFrame([(n, "registry.redhat.io/ubi9/ubi", "a", "v1", f"CVE-2024-000{n}", "CRITICAL") for n in range(2)], "finding_id long, IMAGE string, COMPONENT string, VERSION string, CVE string, SEVERITY string")
    out = jobs.adjudicate_findings(findings, landing.read_advisories(spark, str(tmp_path)), spark.createDataFrame([], "ns_key string, prefixes array<string>")).collect()
    assert {(r["CVE"], r["RULE"], r["SEVERITY"]) for r in out} == {("CVE-2024-0000", "R1", "Low"), ("CVE-2024-0001", "R6", "Critical")}


def test_tree_without_limit(spark, tmp_path):
    deep = leaf("p", "deepest")
    for _ in range(30):
        deep = {"name": "n", "branches": [deep]}
    advisory(tmp_path, "CVE-2024-1000", tree=[deep, leaf("q", "first"), {"name": "n", "branches": [leaf("q", "last")]}])
    advisory(tmp_path, "CVE-2024-1001")
    rows = landing.product_rows(landing.read_advisories(spark, str(tmp_path))).collect()
    assert {(r["cve"], r["product_id"], r["name"]) for r in rows} == {("CVE-2024-1000", "p", "deepest"), ("CVE-2024-1000", "q", "last")}


def test_trees_of_many_documents_have_no_limit_of_rows(spark, tmp_path):
    for n in range(8):
        advisory(tmp_path, f"CVE-2024-200{n}", tree=[{"name": "v", "branches": [leaf("p", f"p{n}"), leaf("q", f"q{n}")]}])
    known = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        rows = landing.product_rows(landing.read_advisories(spark, str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", known)
    assert {(r["cve"], r["product_id"], r["name"]) for r in rows} == {(f"CVE-2024-200{n}", x, f"{x}{n}") for n in range(8) for x in "pq"}


def test_advisories_of_archives_are_those_of_files(spark, tmp_path):
    files, archives = tmp_path / "files", tmp_path / "archives"
    files.mkdir()
    archives.mkdir()
    for n in range(3):
        advisory(files, f"CVE-2024-300{n}", {"fixed": [f"p{n}"]}, tree=TREE, impact="Low")
    lines = [json.dumps({"file": f"2024/{f.name}", "content": f.read_text()}) for f in sorted(files.iterdir())]
    old = json.dumps({"file": "2023/cve-2024-3000.json", "content": "{}"})
    (archives / "a.json").write_text("\n".join([*lines[:2], json.dumps({"file": "changes.csv", "content": "x"})]))
    (archives / "b.json").write_text("\n".join([old, lines[2]]))
    got, want = (read(spark, str(path)) for read, path in ((landing.read_archived_advisories, archives), (landing.read_advisories, files)))
    assert got.count() == 3 and got.dtypes == want.dtypes
    for table in (landing.status_rows, landing.product_rows):
        assert sorted(table(got).collect()) == sorted(table(want).collect())
    texts = lambda docs: {r["cve"]: r["v"] for r in docs.selectExpr("cve", "to_json(vulnerabilities) AS v").collect()}
    assert texts(got) == texts(want)


def test_jobs_queries_read_archives(spark):
    from findsieve.plans.verdict_queries import documents
    from tests.conftest import SF

    docs = documents(spark, SF)
    assert len(docs.inputFiles()) < docs.count()


def test_prefixes_keep_their_order(spark):
    from findsieve.functions.images import with_image_parts, with_prefixes

    refs = with_image_parts(spark.createDataFrame([("registry.redhat.io/team-x/thing-rhel9:v1",), ("registry.redhat.io/ubi9/ubi",)], "IMAGE string"))
    table = spark.createDataFrame([("thing", ["b", "a"]), ("am", ["z", "b"]), ("none", ["n"]), ("", ["y"])], "ns_key string, prefixes array<string>")
    got = {r["image_ns"]: r["prefixes"] for r in with_prefixes(refs, table).collect()}
    assert got == {"team-x": ["registry.redhat.io/team-x/", "team-x/", "y", "z", "b", "a"], "ubi9": []}


def test_streamed_reports(spark, tmp_path):
    (tmp_path / "in" / "ocp-4.20").mkdir(parents=True)
    for n in range(2):
        (tmp_path / "in" / "ocp-4.20" / f"{n}.csv").write_text(f"CVE,COMPONENT,SEVERITY_MISMATCH\nCVE-{n}, x ,True\n")
        ingest_reports(spark, "CVE STRING, COMPONENT STRING, SEVERITY_MISMATCH STRING", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["CVE"], r["COMPONENT"], r["SEVERITY_MISMATCH"]) for r in rows) == [("CVE-0", "x", True), ("CVE-1", "x", True)]


def test_landed_documents_are_compressed_and_read_back(spark):
    from findsieve.plans.landing_queries import landed, read_lines

    path = landed(spark.range(1000).selectExpr("concat('registry.redhat.io/team/image', id % 3) AS id"), "documents")
    assert all(x.endswith(".json.gz") for x in spark.read.text(path).inputFiles())
    assert read_lines(spark, path, "id STRING").count() == 1000
