"""RPM versions as sortable column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([0-9]+|[A-Za-z]+|~|\^)"


def rpm_epoch(version: Column) -> Column:
    """The number before the first colon; 0 without one or if it is no number."""
    return F.coalesce(F.regexp_extract(version, r"^([^:]*):", 1).try_cast("long"), F.when(version.isNotNull(), F.lit(0)).cast("long"))


def without_epoch(version: Column) -> Column:
    return F.regexp_replace(version, r"^[^:]*:", "")


def rpm_order(version: Column) -> Column:
    """Bytes that sort as rpm sorts versions, to compute once for a version and compare, range-partition or prune by often; null for null.

    First the epoch, then marked tokens up to an end mark: a tilde sorts before the end, a caret after it, letters after that, numbers
    last, by length, then digits.  A text before the colon that is no number belongs to the version.
    """

    def token(t: Column) -> Column:
        digits = F.ltrim(t, F.lit("0"))
        number = F.concat(F.lit("\x05"), F.lpad(F.length(digits).cast("string"), 9, "0"), digits)
        return F.when(t == "~", F.lit("\x01")).when(t == "^", F.lit("\x03")).when(t.rlike("^[A-Za-z]"), F.concat(F.lit("\x04"), t)).otherwise(number)

    numbered = F.regexp_extract(version, r"^([^:]*):", 1).try_cast("long").isNotNull()
    rest = F.when(numbered, without_epoch(version)).otherwise(version)
    # Negative epochs sort before others, too.
    epoch = F.lpad((rpm_epoch(version).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(epoch, F.array_join(F.transform(F.regexp_extract_all(rest, F.lit(TOKEN), 1), token), ""), F.lit("\x02")).cast("binary")


def rpm_at_least(installed: Column, fix: Column) -> Column:
    """Whether ``installed`` is not older than ``fix``."""
    return rpm_order(installed) >= rpm_order(fix)


def rhel_major(version: Column) -> Column:
    """The N of ``.elN`` or ``+elN``; null for versions of other packages."""
    return F.nullif(F.regexp_extract(version, r"[.+]el(\d+)", 1), F.lit(""))


def rhel_minor(version: Column) -> Column:
    """The minor stream: M of ``.elN_M``, else of ``elN.M.`` in a module release; null without one."""
    plain = F.nullif(F.regexp_extract(version, r"\.el\d+_(\d+)", 1), F.lit(""))
    return F.coalesce(plain, F.nullif(F.regexp_extract(version, r"[.+]el\d+\.(\d+)\.", 1), F.lit("")))


def is_module_version(version: Column) -> Column:
    return F.contains(version, F.lit(".module+")) | F.contains(version, F.lit("+module+"))


def source_of_rpm(file: Column) -> Column:
    """The package name of a ``*.src.rpm`` file."""
    return F.regexp_extract(F.regexp_replace(file, r"\.src\.rpm$", ""), r"^(.*?)(-\d.*)?$", 1)


def fix_stream(version: Column) -> Column:
    """The product stream of a version: ``rhaosX.Y.elN``, else ``elN_M``; empty without one."""
    shared = F.regexp_extract(version, r"(rhaos\d+\.\d+\.el\d+)", 1)
    return F.when(shared != "", shared).otherwise(F.regexp_extract(version, r"(el\d+_\d+)", 1))
