"""Vendor product ids: their parts, and whether they concern a workload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .images import digest

# Architectures, and flag labels that clear a product.
ARCH = r"\.(aarch64|x86_64|ppc64le|s390x|i686|noarch|src)$"
NOT_AFFECTED_FLAGS = (
    "vulnerable_code_not_present",
    "vulnerable_code_not_in_execute_path",
    "component_not_present",
    "vulnerable_code_cannot_be_controlled_by_adversary",
    "inline_mitigations_already_exist",
)
CATCH_ALL = "red_hat_products"
RHEL = "Red Hat Enterprise Linux"
PLATFORM = "openshift container platform"


def pid_columns(pid: Column) -> dict[str, Column]:
    """parent, pkg_name, fix_ver, is_module and pid_sha of a product id."""
    bare = F.split_part(pid, F.lit("::"), F.lit(1))
    component = F.when(F.contains(bare, F.lit(":")), F.regexp_replace(bare, r"^[^:]*:", ""))
    versioned = component.rlike(r"-\d+:")
    name = F.when(versioned, F.regexp_extract(component, r"^(.*?)-\d+:", 1)).otherwise(F.regexp_replace(component, ARCH, ""))
    fix = F.when(versioned, F.regexp_replace(F.regexp_replace(component, r"^.*?-\d+:", ""), ARCH, ""))
    return {
        "parent": F.split_part(pid, F.lit(":"), F.lit(1)),
        "pkg_name": name,
        "fix_ver": fix,
        "is_module": F.contains(pid, F.lit("::")),
        "pid_sha": digest(pid),
    }


def rhel_majors(pid: Column) -> Column:
    """The major versions of the operating system that a product id names, read once for each id."""
    at = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_distinct(F.concat(at(F.lower(pid), r"enterprise_linux_(\d+)"), at(pid, r"\.el(\d+)(?:[_.\-a-z]|$)"), at(pid, r"^[a-zA-Z]+-(\d+)[.\-]")))


def middleware_majors(pid: Column) -> Column:
    """The versions of ``rhel_majors`` and that of middleware ids, which begin with it."""
    return F.array_distinct(F.concat(rhel_majors(pid), F.regexp_extract_all(pid, F.lit(r"^(\d+)[A-Za-z]"), F.lit(1))))


def platform_version(product_name: Column) -> Column:
    """The last word of a platform product's name, which is its version; null for other products."""
    return F.when(F.contains(F.lower(product_name), F.lit(PLATFORM)), F.substring_index(F.trim(product_name), " ", -1))


# Scope keys: a product concerns a workload if they share a key.  ``r9`` is an operating system, ``o4.20`` a platform of that version, ``o*``
# one of unknown version, ``p`` and a prefix the products that have it in their id.


def workload_keys(rhel_ver: Column, workload_type: Column, ocp_ver: Column, prefixes: Column) -> Column:
    """A workload's scope keys; a platform has one for its version and each that its parts begin with."""
    parts = F.split(ocp_ver, r"\.")
    versions = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("o"), F.array_join(F.slice(parts, F.lit(1), i), ".")))
    none = F.array().cast("array<string>")
    other = F.when(workload_type == "ocp", F.when(ocp_ver.isNull(), F.array(F.lit("o*"))).otherwise(versions)).when(workload_type == "operator", F.transform(prefixes, prefix_key))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("r"), rhel_ver)), F.coalesce(other, none)))


def ocp_version_covers(product_name: Column, ocp_ver: Column) -> Column:
    """The version at the end of a platform product's name is a prefix, part by part, of ``ocp_ver``; unknown versions match."""
    keys = workload_keys(F.lit(""), F.lit("ocp"), ocp_ver, F.array().cast("array<string>"))
    return F.arrays_overlap(keys, F.array(F.concat(F.lit("o"), F.substring_index(F.trim(product_name), " ", -1)), F.lit("o*")))


def prefix_key(prefix: Column) -> Column:
    return F.concat(F.lit("p"), F.lower(prefix))


def product_keys(base_majors: Column, platform: Column, found: Column) -> Column:
    """A product's scope keys: ``base_majors`` of a repository of the operating system itself, ``platform_version``, prefixes found in its id."""
    none = F.array().cast("array<string>")
    return F.concat(
        F.transform(base_majors, lambda m: F.concat(F.lit("r"), m)), F.coalesce(F.when(platform.isNotNull(), F.array(F.concat(F.lit("o"), platform), F.lit("o*"))), none),
        F.transform(F.coalesce(found, none), prefix_key),
    )


def module_guard(is_module: Column, module_version: Column) -> Column:
    return ~is_module | module_version
