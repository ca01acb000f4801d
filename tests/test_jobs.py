"""The jobs a user calls, on hand-written files."""

import json

import pytest
from pyspark.sql import functions as F

from findsieve.operators import reports
from findsieve.plans import jobs
from findsieve.sources import landing
from tests.test_landing import advisory, leaf

FINDING = "finding_id long, IMAGE string, COMPONENT string, VERSION string, CVE string, SEVERITY string"
TREE = [{"name": "v", "branches": [leaf("red_hat_enterprise_linux_9", "Red Hat Enterprise Linux 9")]}]


def image(name, digit):
    return f"registry.redhat.io/team/{name}-rhel9@sha256:{digit * 64}"


@pytest.fixture
def advisories(spark, tmp_path):
    folder = tmp_path / "vex"
    folder.mkdir()
    advisory(folder, "CVE-2024-0001", tree=TREE, status={"known_not_affected": ["red_hat_enterprise_linux_9:a"]})
    advisory(folder, "CVE-2024-0002", tree=TREE, status={"known_affected": ["red_hat_enterprise_linux_9:a"]})
    return landing.read_advisories(spark, str(folder))


@pytest.fixture
def prefixes(spark):
    return spark.createDataFrame([], "ns_key string, prefixes array<string>")


def findings_of(spark, *images):
    return spark.createDataFrame([(10 * n + k, i, "a", "1-1.el9", f"CVE-2024-000{k}", "LOW") for n, i in enumerate(images) for k in (1, 2)], FINDING)


def test_release_in_manifest_order(spark, advisories, prefixes, tmp_path):
    a, b, c = (image(x, x) for x in "abc")
    (tmp_path / "m.txt").write_text(f"Name:      4.20.1\nPull From: quay.io/x@sha256:00\n  zeta {b}\n  alpha {a}\n  again {b}\n")
    rows, counts = jobs.adjudicate_release(landing.read_manifest(spark, str(tmp_path / "m.txt")), findings_of(spark, a, b, c), advisories, prefixes)
    rows = rows.collect()
    assert {tuple(r) for r in counts.collect()} == {("FALSE POSITIVE", 2, 2), ("POSITIVE", 2, 2)}
    assert [(r["OCP_COMPONENT"], r["AUDIT_RESULT"]) for r in rows] == [("zeta", "FALSE POSITIVE"), ("zeta", "POSITIVE"), ("alpha", "FALSE POSITIVE"), ("alpha", "POSITIVE")]


def test_images_of_a_release_are_of_the_platform(spark, prefixes, tmp_path):
    """Their references say nothing; the release says the version, the operating system or the component's name the RHEL."""
    folder = tmp_path / "vex"
    folder.mkdir()
    tree = [{"name": "v", "branches": [leaf("9Base-RHOSE-4.20", "Red Hat OpenShift Container Platform 4.20"), leaf("red_hat_enterprise_linux_10", "Red Hat Enterprise Linux 10"), leaf("x_enterprise_linux_9:own", "Red Hat Enterprise Linux 9 own")]}]
    advisory(folder, "CVE-2024-0001", tree=tree, status={"known_affected": ["9Base-RHOSE-4.20:a"]})
    advisory(folder, "CVE-2024-0002", tree=tree, status={"known_not_affected": ["red_hat_enterprise_linux_10:a"], "known_affected": ["x_enterprise_linux_9:own"]})
    ref = lambda d: f"quay.io/openshift-release-dev/ocp-v4.0-art-dev@sha256:{d * 64}"
    (tmp_path / "m.txt").write_text(f"Name:      4.20.1\n  plain {ref('1')}\n  rhel-coreos-10 {ref('2')}\n  told {ref('3')}\n")
    scan = {"id": ref("3"), "metadata": {"v1": {"labels": {"cpe": "cpe:/a:redhat:openshift:4.19::el9", "name": "openshift/thing-rhel8"}}}, "scan": {"operatingSystem": "rhel:10.0"}}
    (tmp_path / "scan.json").write_text(json.dumps(scan, indent=1))
    told = landing.scanned_images(landing.read_documents(spark, str(tmp_path / "scan.json"), landing.SCAN))
    rows, _ = jobs.adjudicate_release(landing.read_manifest(spark, str(tmp_path / "m.txt")), findings_of(spark, ref("1"), ref("2"), ref("3")), landing.read_advisories(spark, str(folder)), prefixes, images=told)
    got = {(r["OCP_COMPONENT"], r["CVE"][-1]): (r["RULE"], r["JUSTIFICATION"]) for r in rows.collect()}
    assert {got[c, "1"] for c in ("plain", "rhel-coreos-10", "told")} == {("R11c", "OpenShift 4.20.1: affected, no fix yet")}
    assert got["rhel-coreos-10", "2"][0] == got["told", "2"][0] == "R9" and got["plain", "2"][0] == "R15"


def test_a_product_is_known_by_its_own_name(spark, prefixes, tmp_path):
    folder = tmp_path / "vex"
    folder.mkdir()
    tree = [{"name": "v", "branches": [leaf("x_enterprise_linux_9:a", "Red Hat Enterprise Linux 9 a")]}]
    advisory(folder, "CVE-2024-0001", tree=tree, status={"known_affected": ["x_enterprise_linux_9:a"]})
    row = spark.createDataFrame([(1, "registry.redhat.io/ubi9/ubi", "a", "1-1.el9", "CVE-2024-0001", "LOW")], FINDING)
    assert [r["RULE"] for r in jobs.adjudicate_findings(row, landing.read_advisories(spark, str(folder)), prefixes).collect()] == ["R11c"]


def test_labels_of_a_namespace_tell_what_its_images_are(spark, prefixes, tmp_path):
    folder = tmp_path / "vex"
    folder.mkdir()
    tree = [{"name": "v", "branches": [leaf("red_hat_enterprise_linux_9", "Red Hat Enterprise Linux 9")]}]
    advisory(folder, "CVE-2024-0001", tree=tree, status={"known_not_affected": ["red_hat_enterprise_linux_9:a"]})
    refs = [f"mirror.local/x/y@sha256:{d * 64}" for d in "123"]
    seen = [({"name": "ubi9/ubi"}, None), (None, {"name": "Red Hat Enterprise Linux", "version": "9.4"}), ({"name": "team/thing", "cpe": "cpe:/a:redhat:thing:1::el8"}, {"name": "rhel", "version": "9"})]
    lines = [json.dumps({"IMAGE": r, "source": {"target": {"labels": x}}, "distro": d}) for r, (x, d) in zip(refs, seen, strict=True)]
    (tmp_path / "matches.json").write_text("\n".join(lines))
    matched = landing.matched_images(spark.read.schema("IMAGE STRING, " + landing.MATCHES).json(str(tmp_path / "matches.json")))
    listed = spark.createDataFrame([(str(i), r, i) for i, r in enumerate(refs)], "id string, name string, pos long")
    only = findings_of(spark, *refs).where("CVE = 'CVE-2024-0001'")
    rows, _ = jobs.adjudicate_namespace(listed, only, landing.read_advisories(spark, str(folder)), prefixes, images=matched)
    assert [r["RULE"] for r in rows.collect()] == ["R9", "R9", "R13"]
    bare, _ = jobs.adjudicate_namespace(listed, only, landing.read_advisories(spark, str(folder)), prefixes)
    assert [r["RULE"] for r in bare.collect()] == ["R13"] * 3


def test_namespace_in_listing_order(spark, advisories, prefixes):
    a, b, c = (image(x, x) for x in "abc")
    listed = spark.createDataFrame([("1", b, 0), ("2", a, 1), ("3", b, 2), ("4", "", 3)], "id string, name string, pos long")
    rows, counts = jobs.adjudicate_namespace(listed, findings_of(spark, a, b, c), advisories, prefixes)
    assert [(r["IMAGE"], r["RULE"]) for r in rows.collect()] == [(b, "R9"), (b, "R11c"), (a, "R9"), (a, "R11c")]
    assert {tuple(r) for r in counts.collect()} == {("FALSE POSITIVE", 2, 2), ("POSITIVE", 2, 2)}
    only, _ = jobs.adjudicate_namespace(listed, findings_of(spark, a, b, c), advisories, prefixes, false_only=True)
    assert {r["RULE"] for r in only.collect()} == {"R9"}


def catalogs(tmp_path):
    work, bundle, old = image("work", "1"), image("bundle", "2"), image("old", "3")
    meta = [{"type": "olm.package", "value": {"packageName": "op-one"}}, {"type": "olm.csv.metadata", "value": {"displayName": "Red Hat Thing 2.x"}}, {"type": "olm.csv.metadata", "value": {"displayName": "Other"}}]
    objects = [
        {"schema": "olm.package", "name": "op-one", "defaultChannel": "stable"},
        {"schema": "olm.channel", "package": "op-one", "name": "stable", "entries": [{"name": "op-one.v1.0"}, {"name": "op-one.v1.1", "replaces": "op-one.v1.0"}]},
        {"schema": "olm.channel", "package": "op-one", "name": "a/b", "entries": [{"name": "op-one.v1.1"}]},
        {"schema": "olm.bundle", "name": "op-one.v1.1", "package": "op-one", "image": bundle, "properties": meta, "relatedImages": [{"name": "b", "image": bundle}, {"name": "w", "image": work}, {"name": "copy", "image": work}]},
        {"schema": "olm.bundle", "name": "op-one.v1.0", "package": "op-one", "image": old, "relatedImages": [{"name": "o", "image": old}]},
        {"schema": "olm.package", "name": "op-two", "defaultChannel": "x"},
    ]
    for version in ("4.20", "4.9"):
        (tmp_path / f"catalog-{version}.json").write_text("\n".join(json.dumps(x, indent=1) for x in objects))
    (tmp_path / "catalog-4.8.txt").write_text("")
    return work


def test_operators_from_catalogs_to_reports(spark, advisories, prefixes, tmp_path):
    folder = tmp_path / "cat"
    folder.mkdir()
    work = catalogs(folder)
    assert [r["version"] for r in landing.catalog_versions(spark, str(folder)).collect()] == ["4.20", "4.9"]
    objects = landing.read_catalog(spark, f"{folder}/*.json")
    rows, summary = jobs.adjudicate_operators(objects, findings_of(spark, work, image("bundle", "2"), image("old", "3")), advisories, prefixes)
    kinds = {(r["ocp_version"], r["channel"], r["images"], r["found"], r["vulnerable"], r["false_positive"], r["skipped"]) for r in summary.collect()}
    assert kinds == {(v, c, 1, 1, 1, 1, False) for v in ("4.20", "4.9") for c in ("stable", "a/b")}
    got = {(r["ocp_version"], r["channel"], r["is_default"], r["bundle_version"], r["role"], r["IMAGE"], r["RULE"]) for r in rows.collect()}
    assert got == {(v, c, c == "stable", "v1.1", "w", work, rule) for v in ("4.20", "4.9") for c in ("stable", "a/b") for rule in ("R9", "R11c")}
    assert jobs.adjudicate_operators(objects, findings_of(spark, work), advisories, prefixes, operators="op-two")[0].count() == 0
    out = tmp_path / "reports"
    jobs.write_operator_reports(rows, f"file://{out}")
    assert sorted(str(p.relative_to(out)) for p in out.glob("*/*.csv")) == [f"ocp-{v}/op-one-{c}-v1.1.csv" for v in ("4.20", "4.9") for c in ("a_b", "stable")]
    assert not [p for p in out.rglob("*") if p.name.startswith("_")]
    # Another run replaces its reports and leaves the others.
    jobs.write_operator_reports(rows.where("ocp_version = '4.9' AND RULE = 'R9'").withColumn("ocp_version", F.lit("4.21")), f"file://{out}")
    assert len(list(out.glob("ocp-4.20/*.csv"))) == len(list(out.glob("ocp-4.21/*.csv"))) == 2
    jobs.write_operator_reports(rows, f"file://{out}")
    lines = (out / "ocp-4.20" / "op-one-stable-v1.1.csv").read_text().splitlines()
    assert len(lines) == 3 and "R9" in lines[1] and lines[0].startswith('"IMAGE"')
    for x in (out / "ocp-4.21").iterdir():
        x.unlink()
    read = landing.read_reports(spark, f"file://{out}")
    seen = read.withColumns(reports.facets(F.col("source_file"), F.col("IMAGE"))).select("release", "operator", "channel", "bundle_version").distinct().collect()
    assert {tuple(r) for r in seen} == {(v, "op-one", c, "v1.1") for v in ("4.20", "4.9") for c in ("a_b", "stable")}
    assert read.count() == 8 and landing.skipped_reports(spark, f"file://{out}", read).count() == 0


def test_prefix_map_is_one_sorted_object(spark, tmp_path):
    (tmp_path / "cat").mkdir()
    catalogs(tmp_path / "cat")
    rows = jobs.build_prefix_map(landing.read_catalog(spark, f"{tmp_path}/cat/*.json"), f"file://{tmp_path}/map")
    text = "".join(p.read_text() for p in (tmp_path / "map").glob("part-*"))
    assert list(json.loads(text)) == ["team"] and {"op_one", "red_hat_thing_2_x", "thing_2_x"} == set(json.loads(text)["team"])
    assert {r["ns_key"]: r["prefixes"] for r in rows.collect()} == json.loads(text)
    assert json.loads(text)["team"] == sorted(json.loads(text)["team"])


def test_reports_are_consolidated_and_searched(spark, tmp_path):
    folder = tmp_path / "r" / "ocp-4.20"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("CVE, COMPONENT,IMAGE,SEVERITY_MISMATCH\nCVE-1, x ,i1,True\nCVE-2,y,i2,False\n")
    (folder / "empty.csv").write_text("CVE, COMPONENT,IMAGE,SEVERITY_MISMATCH\n")
    read = landing.read_reports(spark, f"{tmp_path}/r")
    assert [r["source_file"].rsplit("/", 1)[1] for r in landing.skipped_reports(spark, f"{tmp_path}/r", read).collect()] == ["empty.csv"]
    corpus = jobs.consolidate_reports(spark, f"{tmp_path}/r", f"file://{tmp_path}/corpus", file_bytes=40)
    assert corpus.count() == 2 and len(list((tmp_path / "corpus").glob("*.parquet"))) == 2  # of the four that were asked for two are empty
    rows, cards, counts = jobs.search_reports(corpus, "cve-1", {"COMPONENT": ["x"]}, mismatches_only=True, facets=("COMPONENT", "IMAGE"))
    assert [r["COMPONENT"] for r in rows.collect()] == ["x"] and [tuple(r) for r in cards.collect()] == [(1, 1, 1, 1)]
    assert {tuple(r) for r in counts.collect()} == {("COMPONENT", "x", 1), ("IMAGE", "i1", 1)}
    assert jobs.search_reports(corpus, "2")[0].count() == 1  # a number is a CVE's
    jobs.write_results(corpus.select("CVE"), f"file://{tmp_path}/out", form="json")
    jobs.write_results(corpus.select("CVE"), f"file://{tmp_path}/out-csv")
    assert spark.read.json(f"file://{tmp_path}/out").count() == spark.read.option("header", True).csv(f"file://{tmp_path}/out-csv").count() == 2


def test_suppressions_gaps_and_pending_reports(spark, tmp_path):
    a, b = image("a", "a"), image("b", "b")
    report = spark.createDataFrame([("FALSE POSITIVE", a, "CVE-1", "why", "f", 1), ("POSITIVE", b, "CVE-1", "no", "f", 2)], "AUDIT_RESULT string, IMAGE string, CVE string, JUSTIFICATION string, source_file string, pos long")
    images = spark.createDataFrame([("1", a), ("2", b)], "id string, name string")
    alerts = spark.createDataFrame([("x", "ACTIVE", "p", a), ("y", "RESOLVED", "p", a), ("z", "ACTIVE", "p", b)], "id string, state string, policy_id string, image string")
    policies = spark.createDataFrame([("p", False, [])], "id string, criteria_locked boolean, exclusions array<string>")
    plan, totals = jobs.plan_suppressions(report, images, alerts, policies, f"file://{tmp_path}/plan")
    assert [(r["image"], r["alert_id"], r["action"]) for r in plan.collect()] == [(a, "x", "add")]
    assert [tuple(r) for r in totals.collect()] == [(1, 1, 1, 0)]

    packages = spark.createDataFrame([(x, "n", v) for x, v in (("i", "1-1.el9_4"), ("j", "1-1.el9_4"), ("k", "3-1.el9_4"), ("l", None))], "image string, name string, version string")
    affected = spark.createDataFrame([("C1", "n", "known_affected", None), ("C2", "n", "fixed", "2-1.el9_4"), ("C3", "n", "fixed", "2-1.el9_2")], "cve string, name string, status string, fix_ver string")
    reported = spark.createDataFrame([("i", "C1", "n")], "image string, cve string, name string")
    gaps = {tuple(r) for r in jobs.missed_findings(packages, affected, reported).collect()}
    assert gaps == {("C1", "n", "known_affected", 2), ("C2", "n", "needs_fix", 2)}

    docs = spark.createDataFrame([("C1", "Low", None, None, None), ("C2", None, "Important", None, None)], "cve string, impact string, aggregate_severity string, later_impact string, cvss_severity string")
    assert {r["cve"] for r in jobs.missed_findings(packages, affected, reported, docs, "Moderate").collect()} == {"C2"}

    keys = "release string, report_key string"
    expected, existing = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "c")], keys), spark.createDataFrame([("r1", "a"), ("r2", "b")], keys)
    assert [tuple(r) for r in jobs.pending(expected, existing).collect()] == [("r2", "c")]


def test_every_alert_on_a_cleared_image_is_resolved(spark):
    """A locked policy, an open one, none and an unknown one; a second alert of a policy adds nothing again."""
    from findsieve.operators import suppression

    a = image("a", "a")
    report = spark.createDataFrame(
        [("FALSE POSITIVE", f" {a} ", " cve-1 ", "why", "f", 1), ("FALSE POSITIVE", a, " ", "blank", "f", 2), ("FALSE POSITIVE", a.replace("registry.redhat.io", "evil.io"), "CVE-2", "no", "f", 3), ("FALSE POSITIVE", a, "CVE-1", "later", "g", 1)],
        "AUDIT_RESULT string, IMAGE string, CVE string, JUSTIFICATION string, source_file string, pos long",
    )
    index = suppression.fp_index(report)
    assert [(r["sha256"], r["cve"], r["justification"]) for r in index.collect()] == [("a" * 64, "CVE-1", "why")]
    running = suppression.deployed(spark.createDataFrame([("2", "registry.redhat.io/a@sha256:" + "a" * 64, 1), ("1", a, 0)], "id string, name string, pos long"))
    assert [r["id"] for r in running.collect()] == ["1"]
    alerts = spark.createDataFrame([("w", None, "open", a), ("x", "ACTIVE", "locked", a), ("y", "ACTIVE", None, a), ("z", "ACTIVE", "open", a), ("u", "ACTIVE", "gone", a)], "id string, state string, policy_id string, image string")
    policies = spark.createDataFrame([("open", False, []), ("locked", True, [])], "id string, criteria_locked boolean, exclusions array<string>")
    plan = suppression.suppression_plan(index, running, alerts, policies)
    assert {(r["alert_id"], r["action"]) for r in plan.collect()} == {("w", "add"), ("x", "locked"), ("y", "none"), ("z", "added"), ("u", "unknown")}
    assert [tuple(r) for r in suppression.suppression_totals(plan, running, index).collect()] == [(1, 1, 5, 0)]


def test_results_have_all_columns(spark):
    from findsieve.operators import reports

    out = reports.result_columns(spark.createDataFrame([("c", "FALSE POSITIVE")], "COMPONENT string, AUDIT_RESULT string"), false_only=True)
    assert tuple(out.columns) == reports.RESULT and out.where(F.col("VEX_PRODUCT").isNull()).count() == 1


def test_searches_read_files_that_can_hold_the_text(spark, tmp_path):
    from findsieve.operators import corpus_index

    rows = [(f"CVE-2024-{1000 + i}", f"lib{'abcdefgh'[i // 100]}{i % 100}", f"quay.io/x/i{i % 40}@sha256:{i}", i % 3 == 0, "High" if i % 2 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "CVE string, COMPONENT string, IMAGE string, SEVERITY_MISMATCH boolean, SEVERITY string")
    corpus, index, sums = (f"file://{tmp_path}/{x}" for x in ("corpus", "index", "sums"))
    reports.write_corpus(df, corpus, 8)
    corpus_index.build_search_index(spark, corpus, index)
    for text in ("cve-2024-1123", "2024-17", "799", " LIBC5", "libc", "i39@", "zzz", "no such thing", "x", ""):
        got, want = corpus_index.search(spark, corpus, index, text), reports.search(df, text)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str), text
    hits = lambda text, columns: corpus_index.files_with(spark, index, columns, text).count()
    assert hits("cve-2024-1123", ["CVE"]) <= 2 and hits("libc5", ["COMPONENT"]) <= 3 and hits("zzz", ["CVE", "COMPONENT", "IMAGE"]) == 0
    corpus_index.write_summaries(spark, corpus, sums, ("SEVERITY", "SEVERITY_MISMATCH", "absent"))
    total, images, packages, mismatches = corpus_index.cards(spark, sums).first()
    assert (total, mismatches) == (800, 267) and abs(images - 800) <= 40 and abs(packages - 800) <= 40
    assert {tuple(r) for r in corpus_index.facet_counts(spark, sums).collect()} == {("SEVERITY", "High", 400), ("SEVERITY", None, 400), ("SEVERITY_MISMATCH", "true", 267), ("SEVERITY_MISMATCH", "false", 533)}
    some = corpus_index.files_with(spark, index, ["CVE"], "cve-2024-1000")
    part = corpus_index.cards(spark, sums, some).first()
    assert 0 < part["total"] < 800


def test_gaps_meet_once_for_images_and_advisories_alike(spark):
    import random

    from findsieve.operators import inventory

    random.seed(7)
    streams = ["", ".el9_4", ".el8_6"]
    pick = lambda: f"{random.randrange(1, 6)}-1{random.choice(streams)}"
    packages = [(random.choice(["i", "j", "k", "l", None]), random.choice("ab"), pick()) for _ in range(40)] + [("i", "a", None), ("m", "c", "1-1")]
    affected = [(f"C{random.randrange(9)}", random.choice("ab"), "fixed", pick()) for _ in range(25)] + [(f"C{k}", random.choice("ab"), s, None) for k in range(9) for s in ("known_affected", "needs_fix")[: 1 + k % 2]]
    reported = [(random.choice("ijkl"), f"C{random.randrange(9)}", random.choice("ab")) for _ in range(15)]
    stream = lambda v: v.partition(".")[2]
    newest = {}
    for c, n, _, f in affected:
        if f:
            newest[c, n, stream(f)] = max(newest.get((c, n, stream(f)), 0), int(f[0]))
    want = {(i, c, n, v, s) for i, n, v in packages if v for c, m, s, f in affected if m == n and f is None}
    want |= {(i, c, n, v, "needs_fix") for i, n, v in packages if v for (c, m, st), top in newest.items() if m == n and st == stream(v) and int(v[0]) < top}
    want = {x for x in want if (x[0], x[1], x[2]) not in reported}
    frames = [spark.createDataFrame(packages, "image string, name string, version string"), spark.createDataFrame(affected, "cve string, name string, status string, fix_ver string"), spark.createDataFrame(reported, "image string, cve string, name string")]
    got = [tuple(r) for r in inventory.detect_gaps(*frames).select("image", "cve", "name", "version", "status").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    keys = {(i, c, n, s) for i, c, n, _, s in want}
    assert {tuple(r) for r in inventory.gap_counts(*frames).collect()} == {(*k, sum((i, c, n, s) == k for i, c, n, _, s in want)) for k in keys}
    found = {k[1:] for k in keys}
    assert {tuple(r) for r in inventory.gap_summary(*frames).collect()} == {(*k, len({i for i, *rest in keys if tuple(rest) == k and i})) for k in found}

    alike = spark.range(200).selectExpr("concat('i', id) AS image", "'n' AS name", "'1-1.el9_4' AS version")
    fixes = spark.range(50).selectExpr("concat('C', id) AS cve", "'n' AS name", "'fixed' AS status", "'2-1.el9_4' AS fix_ver")
    assert inventory.needing_fix(inventory.held_versions(alike), inventory.advised(fixes)[1]).count() == 1
    assert inventory.gap_counts(alike, fixes, frames[2]).count() == 10_000


def test_a_gap_looks_up_what_is_told_once_for_an_image(spark, monkeypatch):
    import random

    from findsieve.operators import inventory

    random.seed(8)
    pick = lambda: f"{random.randrange(1, 9)}-1{random.choice(['', '.el9_4', '.el8_6'])}"
    packages = spark.createDataFrame([(f"i{random.randrange(12)}", random.choice("ab"), pick()) for _ in range(90)], "image string, name string, version string")
    affected = spark.createDataFrame([(f"C{k % 20}", random.choice("ab"), "fixed", pick() if k % 7 else None) for k in range(60)], "cve string, name string, status string, fix_ver string")
    reported = spark.createDataFrame([(f"i{random.randrange(12)}", f"C{random.randrange(20)}", random.choice("ab")) for _ in range(60)], "image string, cve string, name string")

    def counted():
        rows = inventory.detect_gaps(packages, affected, reported).groupBy("image", "cve", "name", "status").count().collect()
        return sorted(map(tuple, rows)), sorted(map(tuple, inventory.gap_counts(packages, affected, reported).collect()))

    whole, counts = counted()
    assert counts == whole and len({n for *_, n in counts}) > 2
    # Several blocks of fixes due, shares of a kind and lists of reported advisories change nothing.
    for name, value in (("BLOCK", 2), ("SHARE", 1), ("TOLD", 3)):
        monkeypatch.setattr(inventory, name, value)
    assert counted() == (whole, whole)
    gaps = inventory.gap_counts(packages, affected, reported)
    plan = gaps._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" in plan and "lambda" not in plan.split("Join")[0]
    assert gaps.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_policys_exclusions_are_not_carried_with_its_alerts(spark):
    from findsieve.operators import suppression

    a, b = image("a", "a"), image("b", "b")
    index = spark.createDataFrame([("a" * 64, "C"), ("b" * 64, "C")], "sha256 string, cve string")
    running = spark.createDataFrame([("a" * 64, a, "1"), ("b" * 64, b, "2")], "sha256 string, name string, id string")
    alerts = spark.createDataFrame([("x", None, "p", a), ("y", None, "p", a), ("z", None, "p", b), ("u", None, "q", b), ("w", None, " ", b)], "id string, state string, policy_id string, image string")
    policies = spark.createDataFrame([("p", None, [f"findsieve: {'b' * 16}"]), ("r", False, None)], "id string, criteria_locked boolean, exclusions array<string>")
    plan = suppression.suppression_plan(index, running, alerts, policies)
    assert {(r["alert_id"], r["action"]) for r in plan.collect()} == {("x", "add"), ("y", "added"), ("z", "skipped"), ("u", "unknown"), ("w", "none")}
    assert "array_contains" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_references_find_images_without_meeting_all_of_a_name(spark):
    import itertools

    from findsieve.operators import inventory

    names = ["r/x/n" + t + d for t, d in itertools.product(["", ":v1", ":v12", ":latest"], ["", "@sha256:ab12", "@sha256:ab"])] + ["r/x/m:v3", None]
    images = [(f"id{i}", n, i % 5) for i, n in enumerate(names * 2)]
    refs = ["r/x/n", "q/x/n", "q/x/n:v1", "r/x/n:v9", "q/x/n:v9@sha256:cc", "q/x/n@sha256:ab", "q/x/n:latest", "q/x/m", "q/x/m:v3", "q/x/none", None]

    def parts(c):
        import re

        sha, tag = re.search(r"@(sha256:[a-f0-9]+)", c), re.search(r"(:[^/@:]+)(?:@.*)?$", c)
        return re.sub(r"[@:][^/]*$", "", re.sub(r"^[^/]+/", "", c)), sha.group(1) if sha else "", tag.group(1) if tag else ""

    want = {}
    for ref in filter(None, refs):
        bare, sha, tag = parts(ref)
        for id_, name, pos in images:
            if name and parts(name)[0] == bare:
                rank = 0 if sha and sha in name else 1 if name == ref else 2 if tag and tag in name else 3 if not sha and not tag and name.endswith(":latest") else 4 if not tag or sha else None
                if rank is not None:
                    want[ref] = min(want.get(ref, (9, 0, "")), (rank, pos, id_))
    frames = spark.createDataFrame([(r,) for r in refs], "ref string"), spark.createDataFrame(images, "id string, name string, pos int")
    assert {(r["ref"], r["id"], r["rank"]) for r in inventory.resolve_images(*frames).collect()} == {(k, v[2], v[0]) for k, v in want.items()}
    same = spark.range(400).selectExpr("concat('id', id) AS id", "concat('r/x/n@sha256:', sha2(string(id), 256)) AS name", "int(id) AS pos")
    out = inventory.resolve_images(same.select(F.col("name").alias("ref")), same)
    assert out.where("rank = 0 AND ref LIKE 'r/x/n@%'").count() == 400


def test_corpus_has_more_files_for_more_rows(spark, monkeypatch):
    from findsieve.operators import reports
    from findsieve.plans.landing_queries import indexed_corpus
    from tests.conftest import SF

    monkeypatch.setattr(reports, "FILE_ROWS", 500)
    corpus, _, _ = indexed_corpus(spark, SF)
    assert len(spark.read.parquet(corpus).inputFiles()) > 8


def test_advisories_are_parsed_once(spark, advisories, prefixes, monkeypatch):
    """All branches of the plan read what was parsed, not the documents again."""
    read, parse = [], jobs.A.parse_pids
    monkeypatch.setattr(jobs.A, "parse_pids", lambda *tables: read.extend(tables) or parse(*tables))
    rows = jobs.adjudicate_findings(findings_of(spark, image("x", "a")), advisories, prefixes)
    assert {r["CVE"]: r["RULE"] for r in rows.collect()} == {"CVE-2024-0001": "R9", "CVE-2024-0002": "R11c"}
    assert read and all(f.endswith(".parquet") for table in read for f in table.inputFiles())
