"""The advisory store and incremental verdicts, on hand-written advisories."""

import json
import os
import re

from findsieve.plans import adjudicate as A
from findsieve.plans import jobs
from findsieve.sources import landing
from findsieve.sources.advisory_store import AdvisoryStore
from findsieve.streaming import verdicts as updates
from tests.test_jobs import TREE, image
from tests.test_landing import advisory

PID = "red_hat_enterprise_linux_9:a"


def test_only_changed_advisories_are_parsed(spark, tmp_path):
    folder = tmp_path / "vex"
    folder.mkdir()
    for k in (1, 2, 3):
        advisory(folder, f"CVE-2024-000{k}", tree=TREE, status={"known_affected": [PID]})
    store = AdvisoryStore(spark, f"file://{tmp_path}/store")
    assert store.last() == 0 and store.sync(f"file://{folder}") == 3 and store.last() == 1
    assert store.sync(f"file://{folder}") == 0 and store.last() == 1  # nothing is read
    advisory(folder, "CVE-2024-0002", tree=TREE, status={"known_not_affected": [PID]})
    os.utime(folder / "cve-2024-0003.json", (1, 1))  # another time, the same content
    (folder / "cve-2024-0001.json").unlink()
    advisory(folder, "CVE-2024-0004", tree=TREE, vulns=False)
    assert store.sync(f"file://{folder}") == 2 and store.last() == 2
    assert {r["cve"] for r in spark.read.parquet(f"file://{tmp_path}/store/docs/segment=2").collect()} == {"CVE-2024-0002", "CVE-2024-0004"}

    def whole(s, **of):
        docs, parsed, nofix = s.tables(**of)
        return {r["cve"] for r in docs.collect()}, {(r["cve"], r["status"]) for r in parsed.collect()}, nofix.count()

    now = ({"CVE-2024-0002", "CVE-2024-0003", "CVE-2024-0004"}, {("CVE-2024-0002", "known_not_affected"), ("CVE-2024-0003", "known_affected")}, 0)
    assert whole(store) == now
    assert whole(store, as_of=1)[0] == {f"CVE-2024-000{k}" for k in (1, 2, 3)}
    assert whole(store, only=spark.createDataFrame([("CVE-2024-0003",)], "cve string"))[1] == {("CVE-2024-0003", "known_affected")}
    assert store.sync(f"file://{folder}") == 0
    store.compact()
    assert whole(store) == now and store.sync(f"file://{folder}") == 0


def test_a_failed_sync_leaves_the_store_as_it_was(spark, tmp_path):
    folder = tmp_path / "vex"
    folder.mkdir()
    advisory(folder, "CVE-2024-0001", tree=TREE, status={"known_affected": [PID]})
    store = AdvisoryStore(spark, f"file://{tmp_path}/store")
    store.sync(f"file://{folder}")
    for name in ("docs", "parsed", "nofix"):  # what a sync leaves that stops before the log
        spark.read.parquet(f"{store.path}/{name}/segment=1").write.parquet(f"{store.path}/{name}/segment=2")
    assert store.last() == 1 and store.tables()[0].count() == 1
    advisory(folder, "CVE-2024-0002", tree=TREE, status={"known_affected": [PID]})
    assert store.sync(f"file://{folder}") == 1 and store.last() == 2 and store.tables()[1].count() == 2


def test_a_delta_judges_what_it_touches(spark, tmp_path):
    folder, landing_zone = tmp_path / "vex", tmp_path / "in"
    folder.mkdir()
    landing_zone.mkdir()
    base, prefixes = f"file://{tmp_path}", spark.createDataFrame([], "ns_key string, prefixes array<string>")
    store = AdvisoryStore(spark, f"{base}/store")

    def findings(name, cves, first):
        rows = [{"finding_id": first + i, "IMAGE": image("x", "a"), "COMPONENT": "a", "VERSION": "1-1.el9", "CVE": c, "SEVERITY": "LOW"} for i, c in enumerate(cves)]
        (landing_zone / name).write_text("\n".join(map(json.dumps, rows)) + "\n")

    def run():
        store.sync(f"file://{folder}")
        updates.land_findings(spark, f"{base}/in", f"{base}/findings", f"{base}/c1").awaitTermination()
        updates.judge_new(spark, f"{base}/findings", store, prefixes, f"{base}/out", f"{base}/c2").awaitTermination()
        updates.judge_changed(spark, f"{base}/findings", store, prefixes, f"{base}/out", f"{base}/c3").awaitTermination()
        return {r["finding_id"]: r["RULE"] for r in updates.verdicts(spark, f"{base}/out").collect()}

    cves = [f"CVE-2024-{k:04}" for k in range(1, 9)]
    for c in cves[:6]:
        advisory(folder, c, tree=TREE, status={"known_affected": [PID]})
    findings("a.json", [*cves, None, f" {cves[0].lower()} "], 0)
    assert run() == {**dict.fromkeys(range(6), "R11c"), 6: "R0", 7: "R0", 8: "R0", 9: "R11c"}
    runs = {p.name for p in (tmp_path / "out").iterdir()}
    assert run() and {p.name for p in (tmp_path / "out").iterdir()} == runs  # nothing new, nothing judged
    advisory(folder, cves[0], tree=TREE, status={"known_not_affected": [PID]})
    advisory(folder, cves[6], tree=TREE, status={"known_not_affected": [PID]})
    (folder / f"{cves[1].lower()}.json").unlink()
    findings("b.json", [cves[2]], 100)
    got = run()
    assert got == {0: "R9", 1: "R0", **dict.fromkeys(range(2, 6), "R11c"), 6: "R9", 7: "R0", 8: "R0", 9: "R9", 100: "R11c"}
    # The change judged its own findings alone, and read the folders of their advisories alone.
    again = [r["finding_id"]["finding_id"] for p in sorted((tmp_path / "out").glob("run=changed-*"))[-1:] for r in spark.read.parquet(f"file://{p}").collect()]
    assert sorted(again) == [0, 1, 6, 9]
    part = updates.touched(updates.landed(spark, f"{base}/findings"), spark.createDataFrame([(cves[0],)], "cve string"))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert part.count() == 2 and re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    # A whole run says the same.
    whole = jobs.adjudicate_findings(updates.landed(spark, f"{base}/findings"), landing.read_advisories(spark, str(folder)), prefixes)
    assert {r["finding_id"]: r["RULE"] for r in whole.select("finding_id", "RULE").collect()} == got


def archive(folder, source):
    """The files of ``source`` as an archive in ``folder``."""
    folder.mkdir(exist_ok=True)
    (folder / "all.json").write_text("".join(json.dumps({"file": p.name, "content": p.read_text()}) + "\n" for p in sorted(source.iterdir())))
    return f"file://{folder}"


def test_only_changed_advisories_of_archives_are_parsed(spark, tmp_path):
    folder = tmp_path / "vex"
    folder.mkdir()
    for k in (1, 2, 3):
        advisory(folder, f"CVE-2024-000{k}", tree=TREE, status={"known_affected": [PID]})
    store = AdvisoryStore(spark, f"file://{tmp_path}/store")
    assert store.sync_archives(archive(tmp_path / "a", folder)) == 3
    assert store.sync_archives(archive(tmp_path / "b", folder)) == 0 and store.last() == 1  # another archive, the same contents
    advisory(folder, "CVE-2024-0002", tree=TREE, status={"known_not_affected": [PID]})
    (folder / "cve-2024-0001.json").unlink()
    advisory(folder, "CVE-2024-0004", tree=TREE, vulns=False)
    assert store.sync_archives(archive(tmp_path / "b", folder)) == 2 and store.last() == 2
    docs, parsed, _ = store.tables()
    assert {r["cve"] for r in docs.collect()} == {"CVE-2024-0002", "CVE-2024-0003", "CVE-2024-0004"}
    assert {(r["cve"], r["status"]) for r in parsed.collect()} == {("CVE-2024-0002", "known_not_affected"), ("CVE-2024-0003", "known_affected")}


def test_findings_are_judged_once_as_of_the_same_advisories(spark, tmp_path):
    folder, landing_zone = tmp_path / "vex", tmp_path / "in"
    folder.mkdir()
    landing_zone.mkdir()
    base, prefixes = f"file://{tmp_path}", spark.createDataFrame([], "ns_key string, prefixes array<string>")
    store = AdvisoryStore(spark, f"{base}/store")

    def run(name, rows):
        store.sync_archives(archive(tmp_path / "archives", folder))
        rows = [{"finding_id": i, "IMAGE": image("x", "a"), "COMPONENT": "a", "VERSION": "1-1.el9", "CVE": c, "SEVERITY": s} for i, c, s in rows]
        (landing_zone / name).write_text("\n".join(map(json.dumps, rows)) + "\n")
        updates.land_findings(spark, f"{base}/in", f"{base}/findings", f"{base}/c1").awaitTermination()
        updates.judge_new(spark, f"{base}/findings", store, prefixes, f"{base}/out", f"{base}/c2").awaitTermination()
        updates.judge_changed(spark, f"{base}/findings", store, prefixes, f"{base}/out", f"{base}/c3").awaitTermination()
        return sorted((r["finding_id"], r["RULE"], r["RHACS_SEVERITY"]) for r in updates.verdicts(spark, f"{base}/out").collect())

    one, two = "CVE-2024-0001", "CVE-2024-0002"
    for c in (one, two):
        advisory(folder, c, tree=TREE, status={"known_affected": [PID]})
    # Equal findings, and an id that repeats.
    rows = [(0, one, "LOW_VULNERABILITY_SEVERITY")] * 2 + [(0, one, "CRITICAL_VULNERABILITY_SEVERITY"), (1, two, ""), (2, None, "")]
    assert run("a.json", rows) == [(0, "R11c", "Critical"), (0, "R11c", "Low"), (0, "R11c", "Low"), (1, "R11c", "Unknown"), (2, "R0", "Unknown")]
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["run=new-0"]  # all advisories are new, and all findings are judged as of them
    advisory(folder, one, tree=TREE, status={"known_not_affected": [PID]})
    assert run("b.json", [(3, one, ""), (4, two, "")]) == [(0, "R9", "Critical"), (0, "R9", "Low"), (0, "R9", "Low"), (1, "R11c", "Unknown"), (2, "R0", "Unknown"), (3, "R9", "Unknown"), (4, "R11c", "Unknown")]
    judged = {p.name: spark.read.parquet(f"file://{p}").select("finding_id.*") for p in (tmp_path / "out").iterdir()}
    assert {k: sorted(r["finding_id"] for r in v.collect()) for k, v in judged.items()} == {"run=new-0": [0, 0, 0, 1, 2], "run=new-1": [3, 4], "run=changed-1": [0, 0, 0]}
    assert judged["run=new-0"].columns == ["finding_id", "batch"]  # a verdict holds its finding's texts once


def test_parts_of_images_are_told_once_for_each_image(spark, tmp_path):
    rows = spark.createDataFrame([(image("x", "a"),), (image("x", "a"),), (None,)], "IMAGE string")
    rows.write.parquet(f"file://{tmp_path}/given")
    ctx = A.contexts(spark.read.parquet(f"file://{tmp_path}/given"), spark.createDataFrame([("x", ["p"])], "ns_key string, prefixes array<string>"))
    assert ctx.count() == 2 and not [f for f in ctx.inputFiles() if f"{tmp_path}/given" in f]
