"""Image references, labels and what they say about the workload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findsieve.operators.matching import contained


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def digest(ref: Column) -> Column:
    """The hex digits after ``@sha256:``; null without any."""
    return _found(ref, r"(?i)@sha256:([a-f0-9]+)")


def image_path(ref: Column) -> Column:
    """The reference without its first segment, tag and digest, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(ref, r"^[^/]+/", ""), r"[@:][^/]*$", ""))


# Fixed values below: namespaces and words by which the vendor's images are told apart.


def with_image_parts(df: DataFrame, ref: str = "IMAGE") -> DataFrame:
    """Adds image_ns, image_name, rhel_ver, ocp_ver, workload_type and display_name."""
    path = image_path(F.col(ref))
    df = df.withColumn("image_ns", F.split_part(path, F.lit("/"), F.lit(1)))
    df = df.withColumn("image_name", F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"^[^/]*/", "")).otherwise(F.lit("")))
    ns, name = F.col("image_ns"), F.col("image_name")
    df = df.withColumn("rhel_ver", F.coalesce(_found(name, r"rhel(\d+)"), _found(ns, r"rhel(\d+)"), _found(ns, r"^ubi(\d+)$"), F.lit("8")))
    df = df.withColumn("ocp_ver", _found(F.col(ref), r"v(4\.\d+)"))
    return with_workload(df)


def with_workload(df: DataFrame) -> DataFrame:
    ns, name = F.col("image_ns"), F.col("image_name")
    ubi = ns.rlike(r"^ubi\d+") | (name == "") | ns.isin("ubi", "rhel")
    ocp = ns.isin("openshift4", "ocp4") | F.contains(name, F.lit("ose-"))
    df = df.withColumn("workload_type", F.when(ubi, F.lit("ubi")).when(ocp, F.lit("ocp")).otherwise(F.lit("operator")))
    shown = (
        F.when(F.col("workload_type") == "ubi", F.concat(F.lit("UBI"), F.col("rhel_ver")))
        .when(F.col("workload_type") == "ocp", F.concat(F.lit("OpenShift "), F.coalesce("ocp_ver", F.lit("4.x"))))
        .otherwise(F.concat(ns, F.lit("/"), name, F.lit(" (RHEL "), F.col("rhel_ver"), F.lit(")")))
    )
    return df.withColumn("display_name", shown)


def with_label_context(df: DataFrame, ref: str = "IMAGE", labels: str = "labels") -> DataFrame:
    """``with_image_parts`` of the name label where it has a path, then versions from the cpe label."""
    name, cpe = F.col(labels)["name"], F.coalesce(F.col(labels)["cpe"], F.lit(""))
    own = F.when(F.contains(name, F.lit("/")), F.concat(F.lit("registry.redhat.io/"), name)).otherwise(F.col(ref))
    df = with_image_parts(df.withColumn("context_ref", own), "context_ref")
    parts = F.split(F.trim(F.regexp_replace(cpe, r"^cpe:[/\d.]*:*", ""), F.lit(":")), ":")
    version = F.coalesce(F.get(parts, 3), F.lit(""))
    lang = F.lower(F.coalesce(F.get(parts, 5), F.lit("")))
    df = df.withColumn("rhel_ver", F.coalesce(_found(lang, r"el(\d+)"), "rhel_ver"))
    base = F.trim(F.split_part("display_name", F.lit("("), F.lit(1)))
    df = df.withColumn("display_name", F.when(version != "", F.concat(base, F.lit(" "), version)).otherwise(F.col("display_name")))
    return df.withColumn("ocp_ver", F.when((F.col("workload_type") == "ocp") & (version != ""), version).otherwise(F.col("ocp_ver")))


def with_release_context(df: DataFrame, release: str, component: str, os_info: str) -> DataFrame:
    """Images of a platform release: type ocp, the release's minor version, RHEL from the OS, else from the component's name."""
    df = df.withColumns({"workload_type": F.lit("ocp"), "ocp_ver": F.substring_index(F.col(release), ".", 2)})
    os_rhel = _found(F.coalesce(F.col(os_info), F.lit("")), r"(?:rhel|coreos):(\d+)")
    named = F.when(os_rhel.isNull(), _found(F.col(component), r"(?:rhel-[^-]+-|rhel-)(\d+)$"))
    df = df.withColumn("rhel_ver", F.coalesce(os_rhel, named, "rhel_ver"))
    return df.withColumn("display_name", F.concat(F.lit("OpenShift "), F.col(release)))


def with_distro(df: DataFrame, cpe: Column, distro: str = "distro") -> DataFrame:
    """RHEL major version from a matcher's distro block, where no cpe label says otherwise."""
    ours = F.lower(F.coalesce(F.col(distro)["name"], F.lit(""))).rlike("red hat|rhel|ubi|enterprise linux") & (F.coalesce(cpe, F.lit("")) == "")
    return df.withColumn("rhel_ver", F.coalesce(F.when(ours, _found(F.col(distro)["version"], r"^(\d+)")), "rhel_ver"))


def with_prefixes(images: DataFrame, prefix_map: DataFrame, ref: str = "IMAGE") -> DataFrame:
    """Adds ``prefixes``, by which products of an operator image are known: its own first, then those of the map in its order of keys.

    ``prefix_map``: (ns_key, prefixes); a key counts if the namespace or the image name contains it.  Distinct namespaces and
    names meet all keys at once, so the map may be of any size.
    """
    ids = images.where("workload_type = 'operator'").select("image_ns", "image_name").distinct()
    named = ids.select("image_ns", "image_name", F.explode(F.array_distinct(F.array("image_ns", "image_name"))).alias("text"))
    found = contained(named.select("text"), prefix_map.select(F.col("ns_key").alias("pattern"))).withColumnRenamed("pattern", "ns_key")
    hits = named.join(found, "text").select("image_ns", "image_name", "ns_key").distinct().join(prefix_map, "ns_key")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ns_key", "prefixes"))), lambda x: x["prefixes"])
    listed = hits.groupBy("image_ns", "image_name").agg(F.array_distinct(F.flatten(in_order)).alias("mapped"))
    host = F.split_part(F.col(ref), F.lit("/"), F.lit(1))
    own = F.array(F.concat(host, F.lit("/"), F.col("image_ns"), F.lit("/")), F.concat(F.col("image_ns"), F.lit("/")))
    none = F.array().cast("array<string>")
    all_of = F.array_distinct(F.concat(own, F.coalesce("mapped", none)))
    return images.join(listed, ["image_ns", "image_name"], "left").withColumn("prefixes", F.when(F.col("workload_type") == "operator", all_of).otherwise(none)).drop("mapped")
