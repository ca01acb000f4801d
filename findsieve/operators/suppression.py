"""Plans to suppress false positives of running images: nothing is applied here."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findsieve.functions.images import digest
from findsieve.operators.relational import keep_first

# What reports mark, where images may come from, how exclusions are named.
MARK = "FALSE POSITIVE"
REGISTRIES = ("registry.redhat.io/", "registry.access.redhat.com/", "quay.io/")
EXCLUSION = "findsieve"


def _allowed(name: Column) -> Column:
    return functools.reduce(lambda x, y: x | y, [F.startswith(name, F.lit(r)) for r in REGISTRIES])


def fp_index(reports: DataFrame) -> DataFrame:
    """sha256, cve, justification of false positives of images from allowed registries; of several reasons the first in the corpus counts.

    Identifiers are upper-case without outer blanks; rows without one, or without a whole digest, are left out.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = reports.where(F.contains("AUDIT_RESULT", F.lit(MARK))).select("source_file", "pos", F.upper(text("CVE")).alias("cve"), text("IMAGE").alias("image"), text("JUSTIFICATION").alias("justification"))
    rows = rows.withColumn("sha256", F.regexp_extract("image", r"@sha256:([0-9a-f]{64})", 1)).where(_allowed(F.col("image")) & (F.col("cve") != "") & (F.col("sha256") != ""))
    return rows.groupBy("sha256", "cve").agg(F.min_by("justification", F.struct("source_file", "pos")).alias("justification"))


def deployed(images: DataFrame) -> DataFrame:
    """sha256, name, id of running images from allowed registries; the first listed (``pos``) of a digest counts, without ``pos`` the least name."""
    rows = images.where(_allowed(F.col("name"))).withColumn("sha256", digest(F.col("name"))).where("sha256 IS NOT NULL")
    order = ["pos", "name", "id"] if "pos" in images.columns else ["name", "id"]
    return keep_first(rows, ["sha256"], *order).select("sha256", "name", "id")


def active_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where((F.coalesce("state", F.lit("ACTIVE")) == "ACTIVE") & (F.coalesce("id", F.lit("")) != ""))


def suppression_plan(index: DataFrame, running: DataFrame, alerts: DataFrame, policies: DataFrame) -> DataFrame:
    """One row for each active alert on a cleared image: sha256, image, alert_id, policy_id, exclusion_name, action.

    Every such alert is to be resolved.  ``action`` is what its policy needs: ``add`` the exclusion, which stands at the policy's least alert of the
    image alone (the others are ``added``), or nothing as it is ``locked`` or ``skipped`` (the exclusion is there), or as the alert has no policy
    (``none``) or one that is not listed (``unknown``).  ``policies``: id, criteria_locked, exclusions (names).
    """
    cleared = running.join(index.select("sha256").distinct(), "sha256").select("sha256", F.col("name").alias("image"))
    policy = F.nullif(F.trim("policy_id"), F.lit(""))
    hit = active_alerts(alerts).join(cleared, "image").select("sha256", "image", F.col("id").alias("alert_id"), policy.alias("policy_id")).distinct()
    name = F.concat(F.lit(f"{EXCLUSION}: "), F.substring("sha256", 1, 16)).alias("exclusion_name")
    known = policies.select(F.col("id").alias("policy_id"), F.coalesce("criteria_locked", F.lit(False)).alias("criteria_locked"))
    there = policies.select(F.col("id").alias("policy_id"), F.explode("exclusions").alias("exclusion_name")).distinct().withColumn("is_there", F.lit(True))
    # The least alert of an image and policy, by map-side minima, is the one that adds the exclusion.  What a policy says is asked once for an image,
    # not for each alert, and its exclusions, as many as there are images, are rows that meet theirs.
    pairs = hit.where("policy_id IS NOT NULL").groupBy("sha256", "policy_id").agg(F.min("alert_id").alias("first_alert")).select("*", name)
    pairs = pairs.join(known, "policy_id", "left").join(there, ["policy_id", "exclusion_name"], "left").drop("exclusion_name")
    rows = hit.select("*", name).join(pairs, ["sha256", "policy_id"], "left")
    action = (
        F.when(F.col("policy_id").isNull(), F.lit("none")).when(F.col("criteria_locked").isNull(), F.lit("unknown")).when(F.col("criteria_locked"), F.lit("locked"))
        .when(F.col("is_there"), F.lit("skipped")).when(F.col("alert_id") == F.col("first_alert"), F.lit("add")).otherwise(F.lit("added"))
    )
    return rows.select("sha256", "image", "alert_id", "policy_id", F.when(F.col("policy_id").isNotNull(), F.col("exclusion_name")).alias("exclusion_name"), action.alias("action"))


def suppression_totals(plan: DataFrame, running: DataFrame, index: DataFrame) -> DataFrame:
    """One row: running images with false positives, exclusions to add, alerts to resolve, matched images without any alert (clean already)."""
    matched = running.join(index.select("sha256").distinct(), "sha256", "left_semi").select("sha256").distinct()
    hit = plan.select("sha256").distinct().withColumn("alerted", F.lit(1))
    images = matched.join(hit, "sha256", "left").agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("alerted").isNull()).alias("clean"))
    done = plan.agg(F.count_if(F.col("action") == "add").alias("added"), F.countDistinct("alert_id").alias("resolved"))
    return images.join(F.broadcast(done)).select("matched", "added", "resolved", "clean")  # both sides are one row
