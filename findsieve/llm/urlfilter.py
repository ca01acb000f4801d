"""URL rules and link-graph propagation (native: DataFrame functions only).

Rules decide the urls they fit.  The rest is decided by host: trust flows along links from hosts whose pages
the allow rules took, distrust flows against links from hosts whose pages the block rules took (a page that
links to a blocked host is suspect), both as personalised PageRank over distinct host edges, iterated until it stands.
A host's margin is that of its own pages (share blocked less share allowed) plus that of what links brought it
(distrust less trust over both), which does not depend on how many hosts share what they get.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path, table

#: (verdict, host, path prefix): fits the host and all its subdomains.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
#: Rounds of the oracle, by which a tolerance of a millionth is reached.
ROUNDS = 100
#: Iteration ends when no host's trust or distrust changes by more than this share of itself; looked at every so many rounds.
TOLERANCE, LOOK_EVERY = 1e-6, 4
#: A host is blocked if its margin is more than this; either part of the margin is from -1 to 1.
THRESHOLD = 0.5
#: An absolute or protocol-relative link; relative links stay on their host and so make no host edge.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s<>]+)"""
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, ASCII_UPPER, ASCII_LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_name(host: str, path: str) -> str:
    return host + path


def rule_match(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null.  Length is that of host and path together."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(rule_name(h, p)).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) host pairs of absolute links in ``html``, without self links.

    The pairs of one task are made distinct before the shuffle, so a hub that a third of all pages link to
    costs a row for each linking host.
    """
    links = pages.select(url_host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return links.select("src", url_host(target).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").distinct()


def _settled(before: DataFrame, after: DataFrame) -> bool:
    """Whether no score changed by more than TOLERANCE of itself; scores never fall, and none goes."""
    old = before.withColumnRenamed("score", "old")
    change = (F.col("score") - F.coalesce(F.col("old"), F.lit(0.0))) / F.col("score")
    most = after.where("score > 0").join(old, ["host", "kind"], "left").agg(F.max(change)).first()[0]
    return most is None or most <= TOLERANCE


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust of personalised PageRank, after ``rounds`` or, if None, when it has converged.

    ``seeds``: host, trust, distrust (teleport weights).  Trust leaves a host in equal parts along its links; distrust
    leaves it in equal parts against the links that reach it.  Hosts without seeds or edges do not appear.
    """
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("deg"))
    forward = edges.join(out, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("t").alias("kind"), (1.0 / F.col("deg")).alias("w"))
    backward = edges.join(into, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit("d").alias("kind"), (1.0 / F.col("deg")).alias("w"))
    # Written once in buckets by host, so that rounds shuffle the scores alone; the session's catalog must take tables.
    spark = edges.sparkSession
    n, name, keys = int(spark.conf.get("spark.sql.shuffle.partitions")), f"link_steps_{uuid.uuid4().hex}", ("host", "kind")
    both = forward.unionByName(backward).withColumnRenamed("a", "host").repartition(n, *keys)
    both.write.bucketBy(n, *keys).sortBy(*keys).option("path", new_path(spark, "steps")).saveAsTable(name)
    steps = spark.table(name)
    try:
        start = cut(
            seeds.select("host", F.lit("t").alias("kind"), F.col("trust").alias("seed"))
            .unionByName(seeds.select("host", F.lit("d").alias("kind"), F.col("distrust").alias("seed")))
            .where("seed > 0"),
            "seeds",
        )
        state = start.withColumnRenamed("seed", "score")
        done = 0
        while done != rounds:
            last = state
            moved = state.join(steps, ["host", "kind"]).select(F.col("b").alias("host"), "kind", (F.col("score") * F.col("w") * damping).alias("part"))
            state = moved.unionByName(start.withColumnRenamed("seed", "part")).groupBy("host", "kind").agg(F.sum("part").alias("score"))
            done += 1
            if done % LOOK_EVERY == 0 or (rounds is None and done == 1):
                state = cut(state, "rank")
                if rounds is None and _settled(last, state):
                    break
        state = cut(state, "ranks")
    finally:
        spark.sql(f"DROP TABLE {name}")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    return state.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust"))


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    A null url, or one without ``://``, has empty host and path, fits no rule and is allowed.  Null html has no links.
    A host's seed weights are the shares of its pages that rules allow and block.  Repeated rows each get a row; an empty
    table gives none.  Other columns are ignored.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("m", rule_match(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.when(F.col("m.verdict") == v, 1.0).otherwise(0.0))
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = cut(seeds, "hosts")
    ranked = propagate(seeds, cut(host_edges(pages), "links"))
    own = seeds.select(F.col("host").alias("scored_host"), F.col("trust").alias("own_trust"), F.col("distrust").alias("own_distrust"))
    scores = own.join(ranked.withColumnRenamed("host", "scored_host"), "scored_host")
    trust, distrust = (F.greatest(F.col(k) - F.col(f"own_{k}"), F.lit(0.0)) for k in ("trust", "distrust"))
    by_links = F.when(trust + distrust > 0, (distrust - trust) / (trust + distrust)).otherwise(0.0)
    scores = scores.select("scored_host", (F.col("own_distrust") - F.col("own_trust") + by_links).alias("margin"))
    by_host = F.when(F.col("margin") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(scores, F.col("host") == F.col("scored_host"), "left").select(
        "page_id", "host", "path", F.col("m.rule").alias("rule"),
        F.coalesce(F.col("m.verdict"), by_host).alias("verdict"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    fits = [
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{v} {h}{p}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    ]
    rounds = [
        f"""r{i} AS MATERIALIZED (SELECT host, kind, sum(part) AS score FROM (
  SELECT steps.b AS host, steps.kind, score * w * {DAMPING} AS part FROM r{i - 1} JOIN steps ON r{i - 1}.host = steps.a AND r{i - 1}.kind = steps.kind
  UNION ALL SELECT host, kind, seed FROM start) GROUP BY host, kind)"""
        for i in range(1, ROUNDS + 1)
    ]
    host = "translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH u AS (SELECT page_id, html, {host.format("coalesce(url, '')")} AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT *, CASE {" ".join(fits)} END AS m FROM u),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?\\s*((?:https?:)?//[^"''\\s<>]+)', 1)) AS link FROM u),
e AS (SELECT DISTINCT src, dst FROM (SELECT src, {host.format("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM l)
  WHERE src <> '' AND dst <> '' AND src <> dst),
steps AS (SELECT src AS a, dst AS b, 't' AS kind, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e
  UNION ALL SELECT dst, src, 'd', 1.0::DOUBLE / count(*) OVER (PARTITION BY dst) FROM e),
s AS (SELECT host, avg(CASE WHEN m LIKE 'allow%' THEN 1.0 ELSE 0.0 END) AS t, avg(CASE WHEN m LIKE 'block%' THEN 1.0 ELSE 0.0 END) AS d
  FROM j WHERE host <> '' GROUP BY host),
start AS (SELECT host, 't' AS kind, t::DOUBLE AS seed FROM s WHERE t > 0 UNION ALL SELECT host, 'd', d FROM s WHERE d > 0),
r0 AS (SELECT host, kind, seed AS score FROM start),
{", ".join(rounds)},
z AS (SELECT host, greatest(coalesce(sum(score) FILTER (kind = 't'), 0) - any_value(t), 0) AS lt, greatest(coalesce(sum(score) FILTER (kind = 'd'), 0) - any_value(d), 0) AS ld,
  any_value(d) - any_value(t) AS own FROM s JOIN r{ROUNDS} USING (host) GROUP BY host),
h AS (SELECT host, own + CASE WHEN lt + ld > 0 THEN (ld - lt) / (lt + ld) ELSE 0 END > {THRESHOLD} AS bad FROM z)
SELECT page_id, j.host, path, split_part(m, ' ', 2) AS rule,
  CASE WHEN m IS NOT NULL THEN split_part(m, ' ', 1) WHEN h.bad THEN 'block' ELSE 'allow' END AS verdict
FROM j LEFT JOIN h ON j.host = h.host
"""


ORACLE = _oracle()
