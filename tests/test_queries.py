"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from findsieve.plans import registry
from tests.conftest import SF, canonical

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(got, df.columns) == canonical(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_one_verdict_for_each_finding(spark):
    from findsieve.plans.fixtures import fixture
    from findsieve.plans.verdict_queries import verdicts

    rows = verdicts(spark, SF).groupBy("AUDIT_RESULT").count().collect()
    assert sum(r["count"] for r in rows) == fixture(spark, SF, "fx_finding").count()
    assert {r["AUDIT_RESULT"] for r in rows} == {"FALSE POSITIVE", "POSITIVE"}


def test_no_python_in_the_verdict_plan(spark):
    from findsieve.plans.verdict_queries import verdicts

    plan = verdicts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def _joins(plan):
    below = plan.children()
    found = [plan] if plan.nodeName() == "Join" else []
    return found + [j for i in range(below.size()) for j in _joins(below.apply(i))]


def test_findings_meet_answers_with_their_own_columns_alone(spark):
    """A finding is shuffled once: not with its texts twice, nor with an image that the result doesn't name; answers are not sent whole to every task."""
    from findsieve.plans.verdict_queries import verdicts

    def carried(*columns):
        plan = verdicts(spark, SF).select(*columns)._jdf.queryExecution().optimizedPlan()
        last = next(j for j in _joins(plan) if "of_module_version" in j.right().output().mkString(","))
        assert "merge" in last.hint().toString()
        return [x.split("#")[0] for x in last.left().output().mkString(",").split(",")]

    question = ["COMPONENT", "CVE", "VERSION", "ctx_id", "module_version", "own_sha", "row_rhel"]
    assert sorted(carried("RULE")) == question
    everything = ["finding_id", "IMAGE", "COMPONENT", "VERSION", "CVE", "SEVERITY", "JUSTIFICATION"]
    assert sorted(carried(*everything)) == sorted({*question, *everything[:-1], "display_name"})


def test_an_image_that_an_advisory_names_asks_for_itself(spark):
    from findsieve.plans import adjudicate as A

    ref = lambda d: f"registry.redhat.io/team/thing-rhel9@sha256:{d * 64}"
    named = f"x:team/thing-rhel9@sha256:{'a' * 64}"
    pids = spark.createDataFrame(
        [("C1", 0, "flag", "component_not_present", 0, 0, named), ("C1", 0, "known_affected", None, 0, 0, "team/:y"), ("C2", 0, "known_affected", None, 0, 0, "team/:y")],
        "cve string, vuln_idx int, status string, flag_label string, flag_idx int, pid_idx int, pid string",
    )
    nothing = spark.createDataFrame([], "cve string, product_id string, name string, vuln_idx int, pid string, ns_key string, prefixes array<string>")
    docs = spark.createDataFrame([(c, 1, None, None, None, None) for c in ("C1", "C2")], "cve string, n_vulns int, impact string, later_impact string, aggregate_severity string, cvss_severity string")
    rows = [(i, ref(d), "a", "v1", c, "LOW") for i, (c, d) in enumerate([("C1", "a"), ("C1", "b"), ("C2", "a"), ("C2", "b")])]
    rows = spark.createDataFrame([*rows, (4, None, "a", "v1", " c1 ", None)], "finding_id long, IMAGE string, COMPONENT string, VERSION string, CVE string, SEVERITY string")
    out = A.adjudicate(rows, A.contexts(rows.select("IMAGE"), nothing), docs, A.parse_pids(pids, nothing), nothing).collect()
    assert {r["finding_id"]: (r["RULE"], r["IMAGE"], r["CVE"]) for r in out} == {
        0: ("R3", ref("a"), "C1"), 1: ("R4", ref("b"), "C1"), 2: ("R4", ref("a"), "C2"), 3: ("R4", ref("b"), "C2"), 4: ("R7", None, "C1"),
    }


def test_image_resolve_asks_for_every_image(spark):
    """Also for those with a tag, which are found by it."""
    from findsieve.plans.fixtures import fixture

    tagged = {r["IMAGE"].split("@")[0] for r in fixture(spark, SF, "fx_img").where("contains(IMAGE, ':v')").collect()}
    found = {r["ref"]: r["rank"] for r in registry.queries()["image_resolve"](spark, SF).collect()}
    assert tagged and {found.get(r) for r in tagged} == {2}
