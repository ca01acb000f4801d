"""Column expressions on vectors written by hand."""

from functools import cmp_to_key

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findsieve.functions import images, products, versions
from findsieve.operators import catalogs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], [*values]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("a", "b", "at_least"),
    [
        ("1.10-1", "1.9-1", True), ("1.0-1", "1.0-1", True), ("1.0~rc1-1", "1.0-1", False), ("1.0^a", "1.0", True), ("1:0.1", "9.9", True),
        ("3.9.18-3.el9_4.10", "3.9.18-3.el9_4.11", False), ("007", "7", True), ("2.4a", "2.4.1", False), ("x:1", "1", False), ("abc:2-1", "1-1", False), ("abc:2-1", "abc:1-1", True), ("-1:9", "0:1", False), ("10:1", "9:1", True),
    ],
)
def test_rpm_order(spark, a, b, at_least):
    assert one(spark, versions.rpm_at_least(F.col("a"), F.col("b")), a=a, b=b) is at_least


def compare(a, b):
    """Tokens one by one, as rpm does."""
    import re

    ta, tb = (re.findall(r"[0-9]+|[A-Za-z]+|~|\^", x) for x in (a, b))
    for i in range(max(len(ta), len(tb)) + 1):
        x, y = (t[i] if i < len(t) else "" for t in (ta, tb))
        if not x and not y:
            return 0
        kind = lambda t: 0 if t == "~" else 1 if not t else 2 if t == "^" else 3 if t.isalpha() else 4
        if kind(x) != kind(y):
            return -1 if kind(x) < kind(y) else 1
        kx, ky = ((int(x), int(y)) if x.isdigit() else (x, y))
        if kx != ky:
            return -1 if kx < ky else 1
    return 0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123~^ab.-", min_size=0, max_size=9), min_size=2, max_size=12))
def test_rpm_key_sorts_like_the_comparison(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "v string").orderBy(versions.rpm_order(F.col("v"))).collect()
    got = [r["v"] for r in rows]
    for x, y in zip(got, got[1:], strict=False):
        assert compare(x, y) <= 0
    assert sorted(got, key=cmp_to_key(compare)) is not None


@pytest.mark.parametrize(("version", "major", "minor"), [("3.9.18-3.el9_4.10", "9", "4"), ("2.4.37-64.module+el8.10.0+21332", "8", "10"), ("3.6.8-59.el8", "8", None), ("v1.2.3", None, None)])
def test_streams(spark, version, major, minor):
    assert one(spark, F.struct(versions.rhel_major(F.col("v")), versions.rhel_minor(F.col("v"))), v=version) == (major, minor)


@pytest.mark.parametrize(("file", "name"), [("openssl-1.1.1k-7.el8_6.src.rpm", "openssl"), ("python-urllib3-1.24.2-5.el8.src.rpm", "python-urllib3"), ("plain", "plain")])
def test_source_name(spark, file, name):
    assert one(spark, versions.source_of_rpm(F.col("f")), f=file) == name


@pytest.mark.parametrize(
    ("ref", "want"),
    [
        ("registry.redhat.io/compliance/openshift-compliance-rhel8-operator@sha256:ab", ("compliance", "openshift-compliance-rhel8-operator", "8", "operator")),
        ("registry.redhat.io/openshift4/ose-cli:v4.14", ("openshift4", "ose-cli", "8", "ocp")),
        ("registry.redhat.io/ubi8/ubi:latest", ("ubi8", "ubi", "8", "ubi")),
        ("ubi8/ubi", ("ubi", "", "8", "ubi")),
    ],
)
def test_image_refs(spark, ref, want):
    df = images.with_image_parts(spark.createDataFrame([(ref,)], "IMAGE string"))
    assert tuple(df.select("image_ns", "image_name", "rhel_ver", "workload_type").first()) == want


@pytest.mark.parametrize(
    ("pid", "want"),
    [
        ("red_hat_enterprise_linux_8:libarchive", ("red_hat_enterprise_linux_8", "libarchive", None, False)),
        ("AppStream-8.x:platform-python-0:3.6.8-48.el8_7.1.aarch64", ("AppStream-8.x", "platform-python", "3.6.8-48.el8_7.1", False)),
        ("A-8.6:mysql-0:8.0.1-1.el8.x86_64::mysql:8.0", ("A-8.6", "mysql", "8.0.1-1.el8", True)),
        ("red_hat_products", ("red_hat_products", None, None, False)),
    ],
)
def test_product_ids(spark, pid, want):
    cols = products.pid_columns(F.col("p"))
    got = one(spark, F.struct(*[cols[c].alias(c) for c in ("parent", "pkg_name", "fix_ver", "is_module")]), p=pid)
    assert tuple(got) == want


@pytest.mark.parametrize(("name", "ocp", "covers"), [("OCP 4", "4.21", True), ("OCP 4.21", "4.21", True), ("OCP 4.18", "4.21", False)])
def test_ocp_versions(spark, name, ocp, covers):
    assert one(spark, products.ocp_version_covers(F.col("n"), F.col("o")), n=name, o=ocp) is covers


@pytest.mark.parametrize(
    ("text", "want"),
    [("Red Hat OpenShift Pipelines", ["pipelines", "red_hat_openshift_pipelines"]), ("Web Terminal (Technical Preview)", ["web_terminal"]), ("AMQ Streams 2", ["amq_streams", "amq_streams_2"]), ("", [])],
)
def test_name_candidates(spark, text, want):
    assert one(spark, catalogs.name_candidates(F.col("t")), t=text) == want


@pytest.mark.parametrize(("bundle", "want"), [("op.v1.2.3", "v1.2.3"), ("op.1.2", "1.2"), ("other", "other")])
def test_bundle_version(spark, bundle, want):
    assert one(spark, catalogs.bundle_version(F.col("b"), F.lit("op")), b=bundle) == want


def test_contained_is_every_text_with_every_pattern_in_it(spark):
    import random

    from findsieve.operators.matching import contained

    random.seed(2)
    word = lambda n: "".join(random.choice("ab_") for _ in range(n))
    texts = [word(random.randrange(0, 60)) for _ in range(40)] + ["", None, "x" * 200]
    patterns = [word(random.randrange(0, 6)) for _ in range(25)] + [t[3:40] for t in texts[:8] if t] + ["", None, "x" * 70, "x" * 32, "x" * 33]
    got = contained(spark.createDataFrame([(t,) for t in texts * 2], "text string"), spark.createDataFrame([(p,) for p in patterns * 2], "pattern string")).collect()
    want = {(t, p) for t in texts if t is not None for p in patterns if p is not None and p in t}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    none = spark.createDataFrame([], "pattern string")
    assert contained(spark.createDataFrame([("a",)], "text string"), none).count() == 0


def test_later_is_every_version_with_every_newer_fix(spark):
    import random

    from findsieve.operators.inventory import later

    random.seed(4)
    row = lambda n: (random.choice("ab"), random.choice(["", "el9"]), n, random.randrange(30))
    versions = [row(f"v{i}") for i in range(120)] + [("c", "", "lonely", 1)]
    fixes = [row(f"c{i}") for i in range(90)]
    got = later(spark.createDataFrame(versions, "name string, stream string, version string, order int"), spark.createDataFrame(fixes, "name string, stream string, cve string, order int"), ["name", "stream"]).collect()
    want = sorted((v[0], v[1], v[2], f[2]) for v in versions for f in fixes if v[:2] == f[:2] and v[3] < f[3])
    assert sorted(tuple(r) for r in got) == want


def test_versions_in_ranges_are_pruned_by_their_bytes(spark, tmp_path):
    rows = spark.range(4000).select(F.concat(F.lit("1."), "id", F.lit("-1.el9")).alias("v")).withColumn("order", versions.rpm_order(F.col("v")))
    rows.repartitionByRange(8, "order").write.parquet(f"{tmp_path}/v")
    asked = spark.read.parquet(f"{tmp_path}/v").where(F.col("order") >= F.lit(rows.where("v = '1.3900-1.el9'").first()["order"]))
    assert asked.count() == 100
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(order" in plan
    spans = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/v").groupBy(F.input_file_name()).agg(F.min("order").alias("a"), F.max("order").alias("b")).select("a", "b").orderBy("a").collect()]
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
