"""Severities of scanners and vendors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scanners' codes, the vendor's words and their order.
SCANNER = {
    "CRITICAL_VULNERABILITY_SEVERITY": "Critical",
    "HIGH_VULNERABILITY_SEVERITY": "Important",
    "IMPORTANT_VULNERABILITY_SEVERITY": "Important",
    "MODERATE_VULNERABILITY_SEVERITY": "Moderate",
    "MEDIUM_VULNERABILITY_SEVERITY": "Moderate",
    "LOW_VULNERABILITY_SEVERITY": "Low",
    "CRITICAL": "Critical",
    "HIGH": "Important",
    "IMPORTANT": "Important",
    "MEDIUM": "Moderate",
    "MODERATE": "Moderate",
    "LOW": "Low",
}
MATCHER = {"critical": "Critical", "high": "Important", "medium": "Moderate", "low": "Low", "negligible": "Low", "unknown": "Unknown", "": "Unknown"}
RANK = {"Critical": 0, "Important": 1, "Moderate": 2, "Low": 3, "Unknown": 4}


def _lookup(key: Column, values: dict, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def scanner_severity(code: Column) -> Column:
    return _lookup(F.upper(F.trim(F.coalesce(code, F.lit("")))), SCANNER, "Unknown")


def matcher_severity(code: Column) -> Column:
    return _lookup(F.lower(F.coalesce(code, F.lit("unknown"))), MATCHER, "Unknown")


def severity_rank(severity: Column) -> Column:
    return _lookup(F.initcap(F.split_part(F.coalesce(severity, F.lit("Unknown")), F.lit(" "), F.lit(1))), RANK, 4)


def stated_severity(first_impact: Column, aggregate: Column, later_impact: Column, cvss: Column) -> Column:
    """First entry's impact, else the aggregate, else a later impact, else CVSS, else null.

    An impact of ``None`` skips CVSS; an aggregate of ``None`` counts as missing.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    stated = F.when(F.lower(F.trim(aggregate)) != "none", blank(aggregate))
    threat = F.coalesce(blank(first_impact), stated, blank(later_impact))
    by_cvss = F.when(F.upper(cvss) == "HIGH", F.lit("Important")).when(F.upper(cvss) == "MEDIUM", F.lit("Moderate")).otherwise(F.initcap(blank(cvss)))
    return F.when(F.coalesce(F.lower(threat) != "none", F.lit(True)), F.coalesce(F.initcap(threat), by_cvss))


def vex_severity(first_impact: Column, aggregate: Column, later_impact: Column, cvss: Column, scanner: Column) -> Column:
    """``stated_severity``, else the scanner's."""
    return F.coalesce(stated_severity(first_impact, aggregate, later_impact, cvss), scanner, F.lit("Unknown"))
