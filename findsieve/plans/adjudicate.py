"""The verdict on every finding: joins, conditional aggregates and one CASE ladder.

A product and a workload have scope keys, and the product concerns the workload if they share one.  So scope is a join by
(advisory, key), or a look into two short arrays; there is no row for an advisory, a workload and a product.  Findings are
reduced to the distinct questions that they ask, at which all evidence meets and is put into an answer: the rule and its words, or the fixes
that a version is held against.  A finding is shuffled once, with its own columns alone, to meet the answer.  Products are read once
by (advisory, package name), for the names that are asked about, and once by (advisory, key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findsieve.functions import images, products, severity, versions
from findsieve.operators.matching import contained
from findsieve.operators.relational import keep_first
from findsieve.sources.scratch import materialise

STATUS_ORDER = {"known_not_affected": 0, "known_affected": 1, "fixed": 2, "under_investigation": 3}
FP, POSITIVE = "FALSE POSITIVE", "POSITIVE"
#: What decides which products concern an image, with its prefixes.
SCOPE = ["rhel_ver", "workload_type", "ocp_ver"]
#: What decides the rules before a package's; ``own_sha`` is the image's digest where a product id of the advisory holds it, else empty.
SETTING = ["cve", "ctx_id", "row_rhel", "own_sha"]
#: What decides a finding's evidence, but for its exact version.
QUESTION = [*SETTING, "COMPONENT", "source", "module_version"]
FP_RULES = ("R1", "R2", "R3", "R6", "R9", "R10b", "R13", "R15")
#: Rules whose sentence names the image between two parts.
SAY_WHO = ("R3", "R4", "R9", "R11a", "R11b", "R11c", "R12")


def image_facts(images_seen: DataFrame) -> DataFrame:
    """One row per IMAGE: its parts, from its labels, distro block, operating system and release where there are columns for them.

    Optional columns: ``labels`` (map) of the image, ``distro`` (name, version) of a matcher, ``os_info`` of a scanner, ``release`` and ``component`` of a
    platform manifest, ``pos``, of whose rows of an image the first counts.  Labels say what the image is, the distro which RHEL if they don't, and a
    release overrules all: its images are of the platform, whatever they are called.
    """
    have = set(images_seen.columns)
    rows = images_seen.withColumn("IMAGE", F.coalesce("IMAGE", F.lit("")))
    rows = keep_first(rows, ["IMAGE"], "pos") if "pos" in have else rows.dropDuplicates(["IMAGE"])
    rows = images.with_label_context(rows) if "labels" in have else images.with_image_parts(rows)
    if "distro" in have:
        rows = images.with_distro(rows, F.col("labels")["cpe"] if "labels" in have else F.lit(None).cast("string"))
    if "release" in have:
        for c in ("component", "os_info"):
            rows = rows if c in have else rows.withColumn(c, F.lit(None).cast("string"))
        rows = images.with_release_context(rows, "release", "component", "os_info")
    named = F.col("context_ref") if "labels" in have else F.col("IMAGE")
    return rows.select("IMAGE", named.alias("context_ref"), "image_ns", "image_name", *SCOPE, "display_name")


def contexts(images_seen: DataFrame, prefix_map: DataFrame) -> DataFrame:
    """``image_facts`` with digest, prefixes, scope keys and ``ctx_id``, equal for images that the same products concern.

    There is a row for the empty reference, which stands for findings without an image and counts as a base image.
    """
    nothing = images_seen.sparkSession.range(1).select(F.lit("").alias("IMAGE"))
    # Written, as several branches read it, and conditions on an image's parts would else be worked out for every row that names the image.
    facts = materialise(image_facts(images_seen).where("IMAGE <> ''").unionByName(image_facts(nothing)), "image-facts")
    seen = images.with_prefixes(facts, prefix_map, "context_ref")
    key = F.unhex(F.md5(F.to_json(F.struct(*SCOPE, "prefixes")).cast("binary")))
    keys = products.workload_keys(*[F.col(c) for c in (*SCOPE, "prefixes")])
    return seen.withColumns({"img_sha": images.digest(F.col("IMAGE")), "ctx_id": key, "keys": keys})


def parse_pids(pids: DataFrame, product_names: DataFrame, relationships: DataFrame | None = None, vendor_wide: DataFrame | None = None) -> DataFrame:
    """``pids`` (cve, vuln_idx, status, flag_label, flag_idx, pid_idx, pid) with their parts, label and base-repository mark.

    ``product_names``: cve, product_id, name, one row each; ``relationships``: cve, pid, parent_pid, pos, of which the last of a
    pid counts; ``vendor_wide``: cve, product_id of entries for all of the vendor's products.  Everything is of the
    advisory itself.  A label is the related parent product's name or id, else the parent's name, else the raw parent.  A product is of the
    operating system if its parent's name or its own says so; it is a platform by the parent's name, or its own if that is missing.
    """
    df = pids
    for name, col in products.pid_columns(F.col("pid")).items():
        df = df.withColumn(name, col)
    # Ids that are parents or products themselves meet the names in one join.
    names = product_names.select("cve", "product_id", "name")
    df = df.join(names.toDF("cve", "parent", "product_name"), ["cve", "parent"], "left").join(names.toDF("cve", "pid", "own_name"), ["cve", "pid"], "left")
    if relationships is not None:
        related = relationships.groupBy("cve", "pid").agg(F.max_by("parent_pid", "pos").alias("rel_parent"))
        related = related.join(names.toDF("cve", "rel_parent", "rel_name"), ["cve", "rel_parent"], "left")
        df = df.join(related.select("cve", "pid", F.coalesce("rel_name", "rel_parent").alias("rel_name")), ["cve", "pid"], "left")
    else:
        df = df.withColumn("rel_name", F.lit(None).cast("string"))
    wide = F.col("pid") == products.CATCH_ALL
    if vendor_wide is not None:
        df = df.join(vendor_wide.select("cve", F.col("product_id").alias("pid"), F.lit(True).alias("wide")).distinct(), ["cve", "pid"], "left")
        wide = wide | F.coalesce("wide", F.lit(False))
    of_rhel = lambda c: F.coalesce(F.startswith(F.col(c), F.lit(products.RHEL)), F.lit(False))
    base = of_rhel("product_name") | of_rhel("own_name")
    label = F.coalesce("rel_name", "product_name", "parent")
    clears = (F.col("status") == "known_not_affected") | ((F.col("status") == "flag") & F.col("flag_label").isin(*products.NOT_AFFECTED_FLAGS))
    none = F.array().cast("array<string>")
    platform = products.platform_version(F.coalesce(F.nullif("product_name", F.lit("")), "own_name"))
    return df.withColumns({
        "vendor_wide": wide, "rhel_base": base, "label": label, "clears": F.coalesce(clears, F.lit(False)), "base_majors": F.when(base, products.rhel_majors(F.col("pid"))).otherwise(none),
        "platform": platform, "any_majors": products.middleware_majors(F.col("pid")), "fix_minor": versions.rhel_minor(F.col("fix_ver")),
    }).drop("wide", "own_name")


def with_scope_keys(parsed: DataFrame, ctx: DataFrame) -> DataFrame:
    """``parsed`` with ``scope_keys``; ids are searched for the prefixes of all workloads at once."""
    prefixes = ctx.where("workload_type = 'operator'").select(F.explode(F.transform("prefixes", F.lower)).alias("pattern"))
    found = contained(parsed.select(F.lower("pid").alias("text")), prefixes).groupBy("text").agg(F.array_sort(F.collect_set("pattern")).alias("found"))
    joined = parsed.withColumn("text", F.lower("pid")).join(found, "text", "left")
    return joined.withColumn("scope_keys", products.product_keys(F.col("base_majors"), F.col("platform"), F.col("found"))).drop("text", "found", "base_majors", "platform")


def scoped_pids(asked: DataFrame, ctx: DataFrame, parsed: DataFrame) -> DataFrame:
    """Product ids of every distinct (cve, ctx_id) of ``asked``, with ``in_scope``; for reports, the verdict needs no such rows."""
    pairs = asked.select("cve", "ctx_id").distinct().join(ctx.select("ctx_id", "keys").dropDuplicates(["ctx_id"]), "ctx_id")
    return pairs.join(with_scope_keys(parsed, ctx), "cve").withColumn("in_scope", F.arrays_overlap("scope_keys", "keys")).drop("keys", "scope_keys")


def _any(cond: Column) -> Column:
    return F.coalesce(F.bool_or(cond), F.lit(False))


def _first(value: Column, order: Column, cond: Column) -> Column:
    return F.min_by(F.when(cond, value), F.when(cond, order))


def _labels(cond: Column) -> Column:
    return F.array_sort(F.collect_set(F.when(cond, F.col("label"))))


def document_evidence(parsed: DataFrame) -> DataFrame:
    """Per advisory: the four label sets and whether a vendor-wide entry clears everything."""
    status = F.col("status")
    return parsed.groupBy("cve").agg(
        _any(F.col("vendor_wide") & F.col("clears")).alias("catchall_clear"),
        _labels(status == "known_affected").alias("lbl_affected"),
        _labels(status == "fixed").alias("lbl_fixed"),
        _labels(F.col("clears")).alias("lbl_not_affected"),
        _labels(status == "under_investigation").alias("lbl_investigating"),
    )


STATED = ("known_affected", "fixed", "known_not_affected")
WORKLOAD_FACTS = ("flag_first", "stated_first", "any_scope", "inv_plain", "inv_module")


def key_evidence(parsed: DataFrame) -> DataFrame:
    """Per (cve, scope key, digest of the product id or null), over the products that have the key: WORKLOAD_FACTS.

    These are the first clearing flag and the first status, whether any entry states something, and whether the first entry is under
    investigation, apart for module streams.  All are minima or disjunctions, so a workload's are those of its keys put together.
    """
    status = F.col("status")
    rank = F.coalesce(*[F.when(status == k, F.lit(v)) for k, v in STATUS_ORDER.items()])
    open_ = (status == "under_investigation") & (F.col("vuln_idx") == 0)
    rows = parsed.withColumn("key", F.explode("scope_keys"))
    return rows.groupBy("cve", "key", "pid_sha").agg(
        F.min(F.when((status == "flag") & F.col("clears"), F.struct("vuln_idx", "flag_idx", "pid_idx", "label", "flag_label"))).alias("flag_first"),
        F.min(F.when(status != "flag", F.struct("vuln_idx", rank.alias("rank"), "pid_idx", "status", "label"))).alias("stated_first"),
        _any(status.isin(*STATED) | F.col("clears")).alias("any_scope"), _any(open_ & ~F.col("is_module")).alias("inv_plain"), _any(open_ & F.col("is_module")).alias("inv_module"),
    )


def named_images(parsed: DataFrame) -> DataFrame:
    """The distinct (cve, img_sha) of product ids that name an image."""
    return parsed.where("pid_sha IS NOT NULL").select("cve", F.col("pid_sha").alias("img_sha")).distinct()


def workload_evidence(pairs: DataFrame, by_key: DataFrame) -> DataFrame:
    """Per (cve, ctx_id) of ``pairs`` (with ``keys``): WORKLOAD_FACTS; the first two of product ids that name no image."""
    rows = pairs.select("cve", "ctx_id", F.explode("keys").alias("key")).join(by_key, ["cve", "key"])
    plain = F.col("pid_sha").isNull()
    return rows.groupBy("cve", "ctx_id").agg(
        *[F.min(F.when(plain, F.col(c))).alias(c) for c in WORKLOAD_FACTS[:2]], *[_any(F.col(c)).alias(c) for c in WORKLOAD_FACTS[2:]]
    )


def image_evidence(seen: DataFrame, by_key: DataFrame) -> DataFrame:
    """Per (cve, ctx_id, own_sha) of ``seen`` (with ``keys``): the first flag and status of product ids that name this very image."""
    named = by_key.where("pid_sha IS NOT NULL").select("cve", F.col("pid_sha").alias("own_sha"), "key", *WORKLOAD_FACTS[:2])
    rows = seen.join(named, ["cve", "own_sha"]).where(F.array_contains("keys", F.col("key")))
    return rows.groupBy("cve", "ctx_id", "own_sha").agg(F.min("flag_first").alias("flag_own"), F.min("stated_first").alias("stated_own"))


def outside_fixes(parsed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per (cve, ctx_id, row_rhel) of ``pairs`` (with ``keys``): labels of fixes on the same RHEL outside the scope.

    An advisory's fixes are reduced to the distinct (RHEL, label, scope keys) first, which are few whatever the number of packages.
    """
    fixes = parsed.where("status = 'fixed' AND vuln_idx = 0").select("cve", F.explode("any_majors").alias("row_rhel"), "label", F.array_sort("scope_keys").alias("scope_keys")).distinct()
    rows = pairs.join(fixes, ["cve", "row_rhel"]).where(~F.arrays_overlap("scope_keys", "keys"))
    return rows.groupBy("cve", "ctx_id", "row_rhel").agg(F.array_sort(F.collect_set("label")).alias("outside_fixes"))


def package_evidence(questions: DataFrame, kinds_of: DataFrame, parsed: DataFrame, nofix: DataFrame, keep_fix_epoch: bool = False) -> DataFrame:
    """Per question (QUESTION columns; ``kinds_of`` has the ``keys`` of a ctx_id): evidence from product ids of its package names.

    ``fixes`` are the fixed versions in scope, in document order; everything else about a version is settled by its
    RHEL version and whether it belongs to a module, so findings of many versions share a question.  Only products of names that
    are asked about are read on, and those that differ by architecture or place alone are one.  ``product_labels`` are
    names of related products, of all entries, that state something in scope.
    """
    names = questions.withColumn("pkg_name", F.explode(F.array_distinct(F.array("COMPONENT", "source"))))
    barred = nofix.where("vuln_idx = 0").select("cve", "pid").distinct().withColumn("no_fix", F.lit(True))
    wanted = names.select("cve", "pkg_name").distinct()
    fix_text = F.concat(F.regexp_extract("pid", r"-(\d+):", 1), F.lit(":"), F.col("fix_ver")) if keep_fix_epoch else F.col("fix_ver")
    first = (F.col("vuln_idx") == 0).alias("first_entry")
    rows = parsed.where("pkg_name IS NOT NULL").join(wanted, ["cve", "pkg_name"]).select("cve", "pkg_name", first, "status", "clears", "is_module", "label", "rel_name", "fix_ver", fix_text.alias("fix_text"), "fix_minor", "any_majors", "scope_keys", "pid", "pid_idx")
    rows = rows.join(barred, ["cve", "pid"], "left").withColumn("no_fix", F.coalesce("no_fix", F.lit(False)))
    kinds = rows.groupBy("cve", "pkg_name", "first_entry", "status", "clears", "is_module", "label", "rel_name", "fix_ver", "fix_text", "fix_minor", "any_majors", "scope_keys", "no_fix").agg(F.min("pid_idx").alias("pid_idx"))
    kinds = kinds.withColumn("order", versions.rpm_order(F.col("fix_text")))
    status, at = F.col("status"), F.col("pid_idx")
    own = F.arrays_overlap("scope_keys", "keys")
    guard = F.col("first_entry") & products.module_guard(F.col("is_module"), F.col("module_version"))
    inside, near = guard & own, guard & ~own & F.array_contains("any_majors", F.col("row_rhel"))
    fix = F.struct("pid_idx", "fix_ver", F.col("fix_minor").alias("minor"), versions.rhel_major(F.col("fix_ver")).alias("major"), "order")
    fixed = F.array_sort(F.collect_set(F.when(inside & (status == "fixed") & F.col("fix_ver").isNotNull(), fix)))
    # Of a version's places the first counts.
    fixed = F.array_distinct(F.transform(fixed, lambda f: f.dropFields("pid_idx")))
    rows = names.join(kinds, ["cve", "pkg_name"]).join(kinds_of.select("ctx_id", "keys"), "ctx_id")
    return rows.groupBy(*QUESTION).agg(
        _any(inside & F.col("clears")).alias("cleared"),
        fixed.alias("fixes"),
        _first(F.col("no_fix"), at, inside & (status == "known_affected")).alias("affected_no_fix"),
        _labels(near & status.isin("known_affected", "fixed")).alias("near_affected"),
        _labels(near & (status == "known_not_affected")).alias("near_safe"),
        F.array_sort(F.collect_set(F.when(own & (status.isin(*STATED) | F.col("clears")), F.col("rel_name")))).alias("product_labels"),
    )


def version_facts(version: Column) -> dict[str, Column]:
    """row_rhel (empty for other packages) and module_version."""
    return {"row_rhel": F.coalesce(versions.rhel_major(version), F.lit("")), "module_version": versions.is_module_version(version)}


def with_fixes(rows: DataFrame, match_major: bool = False) -> DataFrame:
    """fix_first, fix_same, fix_met and fix_same_met of a finding: the first fix, also of its stream, also not newer than what is installed."""
    same = lambda f: F.coalesce(f["minor"] == F.col("minor"), F.lit(False)) & ((f["major"] == F.col("row_rhel")) if match_major else F.lit(True))
    met = lambda f: F.coalesce(F.col("version_order") >= f["order"], F.lit(False))
    first = lambda c: F.get(c, 0)["fix_ver"]
    compared = F.col("fixes").isNotNull()
    rows = rows.withColumns({"minor": F.when(compared, versions.rhel_minor(F.col("VERSION"))), "version_order": F.when(compared, versions.rpm_order(F.col("VERSION")))})
    rows = rows.withColumn("same_fixes", F.filter("fixes", same))
    return rows.withColumns({"fix_first": first(F.col("fixes")), "fix_same": first(F.col("same_fixes")), "fix_met": first(F.filter("fixes", met)), "fix_same_met": first(F.filter("same_fixes", met))})


def _has(c: str) -> Column:
    return F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0


def _ladder(steps: list[tuple[str, Column]]) -> Column:
    """The first rule that fits, in order; null if none does."""
    out = F.when(F.coalesce(steps[0][1], F.lit(False)), F.lit(steps[0][0]))
    for rule, cond in steps[1:]:
        out = out.when(F.coalesce(cond, F.lit(False)), F.lit(rule))
    return out


def _said(rule: str, say: dict[str, Column | str]) -> Column:
    """The words of the rule in column ``rule``; null for others."""
    out = F.lit(None).cast("string")
    for name, text in say.items():
        out = F.when(F.col(rule) == name, F.lit(text) if isinstance(text, str) else text).otherwise(out)
    return out


def _joined(c: Column | str) -> Column:
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")


def advisory_answers(docs: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per advisory: what it says by itself, whatever is asked.

    ``doc_rule`` and ``doc_text`` are those of packages that are no RPMs, if their workload has no statement (R2 goes before even that).
    """
    own = ("impact", "aggregate_severity", "later_impact", "cvss_severity")
    known = docs.select("cve", "n_vulns", severity.stated_severity(*[F.col(c) for c in own]).alias("stated_severity"), F.lit(True).alias("has_doc"))
    rows = known.join(document_evidence(parsed), "cve", "left")
    affected, fixed, clear, open_ = (_has(f"lbl_{x}") for x in ("affected", "fixed", "not_affected", "investigating"))
    top = lambda c: _joined(F.slice(c, 1, 3))
    rule = _ladder([("R2", ~(affected | fixed | clear | open_)), ("R5", open_), ("R6", clear & ~affected & ~fixed), ("R7", F.lit(True))])
    say = {
        "R2": "the advisory names no product",
        "R5": F.concat(F.lit("investigated for "), top("lbl_investigating")),
        "R6": F.concat(F.lit("not affected: "), top("lbl_not_affected")),
        "R7": F.concat(F.lit("affected: "), top("lbl_affected"), F.lit("; fixed: "), top("lbl_fixed"), F.lit("; not affected: "), top("lbl_not_affected")),
    }
    rows = rows.withColumn("doc_rule", rule)
    return rows.select("cve", "n_vulns", "stated_severity", "has_doc", "catchall_clear", "doc_rule", _said("doc_rule", say).alias("doc_text"))


def setting_answers(settings: DataFrame, kinds_of: DataFrame, docs: DataFrame, parsed: DataFrame, by_key: DataFrame) -> DataFrame:
    """Per setting: the first rule of R0 to R8 that fits, or null, with its words, and what later rules need of advisory and workload."""
    rows = settings.join(kinds_of.select("ctx_id", "keys", "workload_type", "rhel_ver"), "ctx_id", "left").withColumns({
        "keys": F.coalesce("keys", F.array().cast("array<string>")), "workload_type": F.coalesce("workload_type", F.lit("ubi")), "rhel_ver": F.coalesce("rhel_ver", F.lit("8")),
    })
    of = lambda *keys: rows.groupBy(*keys).agg(F.first("keys").alias("keys"))
    rows = (
        rows.drop("keys").join(advisory_answers(docs, parsed), "cve", "left").join(workload_evidence(of("cve", "ctx_id"), by_key), ["cve", "ctx_id"], "left")
        .join(outside_fixes(parsed, of("cve", "ctx_id", "row_rhel").where("row_rhel <> ''")), ["cve", "ctx_id", "row_rhel"], "left")
        .join(image_evidence(of("cve", "ctx_id", "own_sha").where("own_sha <> ''"), by_key), ["cve", "ctx_id", "own_sha"], "left")
    )
    rows = rows.withColumns({"flag_first": F.least("flag_first", "flag_own"), "stated_first": F.least("stated_first", "stated_own"), "has_doc": F.coalesce("has_doc", F.lit(False))})
    other, stated = F.col("row_rhel") == "", (F.col("row_rhel") == "") & (F.col("workload_type") != "ubi")
    steps = [("R0", ~F.col("has_doc")), ("R1", F.col("catchall_clear")), ("R2", other & (F.col("doc_rule") == "R2")), ("R3", stated & F.col("flag_first").isNotNull()), ("R4", stated & F.col("stated_first").isNotNull())]
    steps += [(r, other & (F.col("doc_rule") == r)) for r in ("R5", "R6", "R7")] + [("R8", F.col("n_vulns") == 0)]
    before = {
        "R0": "no advisory for this CVE", "R1": "the vendor clears all its products", "R3": "", "R4": "", "R8": "the advisory has no entry",
        **{r: F.col("doc_text") for r in ("R2", "R5", "R6", "R7")},
    }
    after = {
        "R3": F.concat(F.lit(": cleared by flag "), F.translate(F.col("flag_first.flag_label"), "_", " "), F.lit(" for "), F.col("flag_first.label")),
        "R4": F.concat(F.lit(": "), F.translate(F.col("stated_first.status"), "_", " "), F.lit(" for "), F.col("stated_first.label")),
    }
    said = F.when(F.col("rule") == "R4", F.col("stated_first.status"))
    return rows.withColumn("rule", _ladder(steps)).select(
        *SETTING, "rule", _said("rule", before).alias("before"), _said("rule", after).alias("after"), said.alias("r4_status"), "rhel_ver", "any_scope", "inv_plain", "inv_module", "outside_fixes",
        F.when(F.col("has_doc"), F.col("stated_severity")).otherwise(F.lit("UNKNOWN")).alias("stated_severity"),
    )


def answers(questions: DataFrame, settings: DataFrame, packages: DataFrame) -> DataFrame:
    """Per question: ``answer``, a rule, with its words ``before`` and ``after`` the image's name, or R10 and the ``fixes`` that decide.

    ``stated_severity`` is null where the scanner's counts, ``product`` where the image's name does.
    """
    rows = questions.join(settings, SETTING).join(packages, QUESTION, "left").withColumnRenamed("rule", "set_rule")
    open_ = F.col("inv_plain") | (F.col("inv_module") & F.col("module_version"))
    late = [
        ("R9", F.col("cleared")),
        ("R10", F.size(F.coalesce("fixes", F.array().cast(packages.schema["fixes"].dataType))) > 0),
        ("R11a", F.col("affected_no_fix")),
        ("R11b", F.col("affected_no_fix").isNotNull() & _has("outside_fixes")),
        ("R11c", F.col("affected_no_fix").isNotNull()),
        ("R12", open_),
        ("R13", _has("near_safe") & ~_has("near_affected")),
        ("R14", _has("near_affected")),
        ("R15", F.lit(True)),
    ]
    rows = rows.withColumn("rule", F.coalesce("set_rule", _ladder(late)))
    comp = F.col("COMPONENT")
    before = {
        "R9": F.concat(comp, F.lit(" is not affected in ")), "R11a": "", "R11b": "", "R11c": "", "R12": "",
        "R13": F.concat(comp, F.lit(" is not affected in "), _joined("near_safe")), "R14": F.concat(comp, F.lit(" is affected in "), _joined("near_affected")),
        "R15": F.concat(comp, F.lit(" is not tracked in this advisory")),
    }
    after = {
        "R9": "", "R11a": ": affected, no fix planned", "R11b": F.concat(F.lit(": affected, fixed only in "), _joined("outside_fixes")), "R11c": ": affected, no fix yet",
        "R12": ": under investigation",
    }
    words = lambda c, say: F.when(F.col("set_rule").isNotNull(), F.col(c)).otherwise(_said("rule", say)).alias(c)
    product = F.when(_has("product_labels"), _joined("product_labels")).when(~F.coalesce("any_scope", F.lit(False)), F.lit(""))
    return rows.select(
        *QUESTION, F.col("rule").alias("answer"), words("before", before), words("after", after), F.when(F.col("rule") == "R10", F.col("fixes")).alias("fixes"), "rhel_ver", "r4_status", "stated_severity", product.alias("product"),
    )


def given_rows(findings: DataFrame, known: DataFrame, named: DataFrame, src_map: DataFrame | None) -> DataFrame:
    """``findings`` with what decides their question; ``known``: ``image_key``, ctx_id, img_sha and display_name of images.

    Texts stay null where they are, as the result has them; a CVE is upper-case without outer blanks.  An image is looked up by 128 bits of its
    reference, which keeps the table small.
    """
    rows = findings.select("finding_id", "SEVERITY", "IMAGE", "COMPONENT", "VERSION", F.upper(F.trim("CVE")).alias("CVE"))
    if src_map is not None:
        sources = src_map.select(F.col("image").alias("of_image"), F.col("binary").alias("of_component"), "source").dropDuplicates(["of_image", "of_component"])
        of = (F.coalesce(rows["IMAGE"], F.lit("")) == sources["of_image"]) & (F.coalesce(rows["COMPONENT"], F.lit("")) == sources["of_component"])
        rows = rows.join(sources, of, "left").drop("of_image", "of_component")
    rows = rows.join(known, image_key(rows["IMAGE"]) == known["image_key"], "left").drop("image_key")
    named = named.select(F.col("cve").alias("of_cve"), F.col("img_sha").alias("own_sha"))
    rows = rows.join(named, (F.coalesce(rows["CVE"], F.lit("")) == named["of_cve"]) & (rows["img_sha"] == named["own_sha"]), "left").drop("of_cve", "img_sha")
    return rows.withColumns({
        "ctx_id": F.coalesce("ctx_id", F.lit("").cast("binary")), "display_name": F.coalesce("display_name", F.lit("")), "own_sha": F.coalesce("own_sha", F.lit("")),
        **version_facts(F.coalesce("VERSION", F.lit(""))),
    })


def image_key(ref: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(ref, F.lit("")).cast("binary")))


def asked_by(rows: DataFrame) -> dict[str, Column]:
    """The QUESTION of a row of ``given_rows``."""
    comp = F.coalesce("COMPONENT", F.lit(""))
    own = {"cve": F.coalesce("CVE", F.lit("")), "COMPONENT": comp, "source": F.coalesce("source", comp) if "source" in rows.columns else comp}
    return {c: own.get(c, F.col(c)) for c in QUESTION}


def adjudicate(findings: DataFrame, ctx: DataFrame, docs: DataFrame, parsed: DataFrame, nofix: DataFrame, src_map: DataFrame | None = None, keep_fix_epoch: bool = False, match_major: bool = False) -> DataFrame:
    """``findings`` (finding_id, IMAGE, COMPONENT, VERSION, CVE, SEVERITY, ...) with verdict, rule, fix, reason and severities.

    ``docs``: cve, n_vulns and the severity parts (impact of the first entry, later_impact, aggregate_severity, cvss_severity);
    ``parsed``: ``parse_pids``; ``nofix``: cve, vuln_idx, pid; ``src_map``: image, binary, source, one row for a binary.

    Every finding gets one row.  One without CVE or advisory is R0, one without version is no RPM, one without component
    names no package, one whose image is null or not in ``ctx`` counts as in a base image (an image not in ``ctx`` meets no product).
    ``keep_fix_epoch`` compares fixes with their epoch; ``match_major`` asks that a fix's stream be of the same RHEL major version too.
    """
    named = materialise(named_images(parsed), "named-images")
    # A row for each image, and one for each ctx_id, which says all but how its image is called.
    ctx = ctx.select("IMAGE", "ctx_id", "img_sha", "display_name", "keys", "prefixes", "workload_type", "rhel_ver")
    ctx = ctx.join(named.select("img_sha", F.lit(True).alias("is_named")).distinct(), "img_sha", "left")
    known = materialise(ctx.withColumns({"image_key": image_key(F.col("IMAGE")), "img_sha": F.when(F.col("is_named"), F.col("img_sha"))}).drop("IMAGE", "is_named"), "contexts")
    kinds_of = materialise(known.select("ctx_id", "keys", "prefixes", "workload_type", "rhel_ver").dropDuplicates(["ctx_id"]), "context-kinds")
    rows = given_rows(findings, known.select("image_key", "ctx_id", "img_sha", "display_name"), named, src_map)
    asked = asked_by(rows)
    questions = materialise(rows.select(*[c.alias(name) for name, c in asked.items()]).distinct(), "questions")
    # Products of advisories that are asked about, read by several branches.
    parsed = materialise(with_scope_keys(parsed.join(questions.select("cve").distinct(), "cve", "left_semi"), kinds_of), "products")
    by_key = materialise(key_evidence(parsed), "key-evidence")
    settings = setting_answers(questions.select(*SETTING).distinct(), kinds_of, docs, parsed, by_key)
    answered = materialise(answers(questions, settings, package_evidence(questions, kinds_of, parsed, nofix, keep_fix_epoch)), "answers")
    # A finding is shuffled with its own columns; what can be told from them is told afterwards.
    answered = answered.select(*[F.col(c).alias(f"of_{c}") for c in QUESTION], *[c for c in answered.columns if c not in QUESTION])
    meets = [c == F.col(f"of_{name}") for name, c in asked.items() if name != "source" or src_map is not None]
    # Small files of many rows would be taken for a table to send whole to every task.
    out = with_fixes(rows.join(answered.hint("merge"), meets), match_major)

    in_stream = F.col("minor").isNotNull()
    met = F.when(in_stream, F.col("fix_same_met")).otherwise(F.col("fix_met"))
    due = F.when(in_stream, F.col("fix_same")).otherwise(F.col("fix_first"))
    compared = F.when(in_stream & F.col("fix_same").isNull(), F.lit("R10a")).when(met.isNotNull(), F.lit("R10b")).otherwise(F.lit("R10c"))
    out = out.withColumn("RULE", F.when(F.col("answer") == "R10", compared).otherwise(F.col("answer")))
    rule, who, text = F.col("RULE"), F.col("display_name"), lambda c: F.coalesce(c, F.lit(""))
    stream = F.concat(F.lit(": stream el"), F.col("rhel_ver"), F.lit("_"), F.col("minor"), F.lit(" has no fix yet; installed "))
    has, older = F.lit(": installed "), F.lit(" is older than the fix ")
    reason = (
        F.when(rule == "R10a", F.concat(who, stream, text(F.col("VERSION")), F.lit(", fixed elsewhere in "), F.col("fix_first")))
        .when(rule == "R10b", F.concat(who, has, text(F.col("VERSION")), F.lit(" has the fix of "), text(met)))
        .when(rule == "R10c", F.concat(who, has, text(F.col("VERSION")), older, text(due)))
        .when(rule.isin(*SAY_WHO), F.concat("before", who, "after"))
        .otherwise(F.col("before"))
    )
    scanned = severity.scanner_severity(F.col("SEVERITY"))
    stated = lambda *values: (rule == "R4") & F.col("r4_status").isin(*values)
    out = out.withColumns({
        "AUDIT_RESULT": F.when(rule.isin(*FP_RULES) | F.coalesce(stated("known_not_affected", "fixed"), F.lit(False)), F.lit(FP)).otherwise(F.lit(POSITIVE)),
        "VEX_FIX_VER": F.when(rule == "R10a", F.col("fix_first")).when(rule == "R10b", met).when(rule == "R10c", due).otherwise(F.lit("N/A")),
        "JUSTIFICATION": reason, "RHACS_SEVERITY": scanned, "VEX_PRODUCT": F.coalesce("product", "display_name"),
        "under_investigation": rule.isin("R5", "R12") | F.coalesce(stated("under_investigation"), F.lit(False)),
    })
    out = out.withColumn("SEVERITY", F.coalesce("stated_severity", "RHACS_SEVERITY"))
    mismatch = (F.col("SEVERITY") != F.col("RHACS_SEVERITY")) & (F.col("RHACS_SEVERITY") != "Unknown")
    return out.withColumn("SEVERITY_MISMATCH", mismatch).select(
        "finding_id", "IMAGE", "COMPONENT", "VEX_PRODUCT", "VERSION", "CVE", "SEVERITY", "RULE", "AUDIT_RESULT", "VEX_FIX_VER", "JUSTIFICATION", "RHACS_SEVERITY", "SEVERITY_MISMATCH", "under_investigation",
    )


def sort_score() -> Column:
    """False positives first, then positives, missing advisories, investigations; by severity within."""
    priority = F.when(F.col("AUDIT_RESULT") == FP, F.lit(0)).when(F.col("under_investigation"), F.lit(4)).when(F.col("RULE") == "R0", F.lit(3)).otherwise(F.lit(2))
    return (priority * 10000 + severity.severity_rank(F.col("SEVERITY")) * 100).cast("int")
