"""Quality rules with host verdicts (native: DataFrame functions only).

Every document is held against a few rules.  A rule's failures are counted by host, the host's rate is
shrunk towards the rate of all hosts with an empirical beta prior, and a host one of whose shrunk rates
passes one half is rejected with all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, cut, let, table, words

WINDOW = 8
RULES = ("base", "symbols", "dup_lines", "word_length")
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1000.0
HOST_THRESHOLD = 0.5


def _repeat_words(w: Column) -> Column:
    """Words that lie in a window of eight words which the text holds at least twice."""

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        step = lambda k: F.when(k == n, F.lit(WINDOW)).otherwise(
            F.least(F.lit(WINDOW), F.element_at(starts, k + 1) - F.element_at(starts, k))
        )
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, k: acc + step(k))

    def repeated_starts(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        hit = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda k: ((k > 0) & same(F.greatest(k - 1, F.lit(0)), k)) | same(k, k + 1),
        )
        return F.array_sort(F.transform(hit, lambda k: F.get(s, k)["i"]))

    def of_windows(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        many = let(ordered, lambda s: let(repeated_starts(s), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(many)

    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(windows, of_windows))


def text_features(text: Column) -> Column:
    """A struct of the counts that the rules use.  Null text counts as empty."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    of_words = let(
        words(full),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    return F.struct(
        of_words.alias("w"),
        of_lines.alias("l"),
        F.length(F.regexp_replace(full, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(full) - F.length(F.translate(full, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )


def rule_failures() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "base": (n < 20) | (100 * F.col("n_repeat_words") > 30 * n),
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }


def host_verdicts(scored: DataFrame, host: str = "host") -> DataFrame:
    """One row per host: documents, shrunk failure rate of every rule, ``host_rejected``.

    The prior of a rule is the beta distribution whose mean and variance are those of the hosts' raw
    rates; its strength is held within [WEAKEST, STRONGEST] documents.
    """
    hosts = scored.groupBy(host).agg(
        F.count(F.lit(1)).alias("host_docs"),
        *[F.sum(F.col(f"fails_{r}").cast("long")).alias(f"k_{r}") for r in RULES],
    )
    rate = lambda r: F.col(f"k_{r}") / F.col("host_docs")
    prior = hosts.agg(
        *[F.avg(rate(r)).alias(f"m_{r}") for r in RULES],
        *[F.var_pop(rate(r)).alias(f"v_{r}") for r in RULES],
    ).withColumn("one", F.lit(1))
    both = hosts.withColumn("one", F.lit(1)).join(F.broadcast(prior), "one")  # the prior is one row
    shrunk = []
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        strength = F.when(v > 0, F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), m * (1 - m) / v - 1))).otherwise(F.lit(STRONGEST))
        shrunk.append(((F.col(f"k_{r}") + m * strength) / (F.col("host_docs") + strength)).alias(f"rate_{r}"))
    rejected = F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > HOST_THRESHOLD
    return both.select(host, "host_docs", *shrunk).withColumn("host_rejected", rejected)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per input row with its counts, failures and ``kept``.

    Null and empty texts have no words and fail the base rule.  Rows without a host share one host (null).
    Repeated rows are judged and counted each for itself.  Other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    f = F.col("f")
    counted = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), text_features(F.col(text)).alias("f")
    ).select(
        "doc_id", "host",
        f["w"]["n_words"].alias("n_words"), f["word_chars"].alias("word_chars"), f["n_symbols"].alias("n_symbols"),
        f["l"]["n_lines"].alias("n_lines"), f["l"]["n_dup_lines"].alias("n_dup_lines"), f["w"]["n_repeat_words"].alias("n_repeat_words"),
    )
    # The counts are needed twice, for the hosts and for the documents; the texts are read once.
    scored = cut(counted.select("*", *[c.alias(f"fails_{r}") for r, c in rule_failures().items()]), "quality")
    hosts = host_verdicts(scored).withColumnRenamed("host", "judged_host")
    return scored.join(hosts, scored["host"].eqNullSafe(hosts["judged_host"]), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("fails_base").alias("base_failed"), "host_rejected",
        (~F.col("fails_base") & ~F.col("host_rejected")).alias("kept"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS l FROM d),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
p AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o
        || ' ' || lead(word, 5) OVER o || ' ' || lead(word, 6) OVER o || ' ' || lead(word, 7) OVER o AS win FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM p WHERE win IS NOT NULL),
r AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS k FROM g WHERE c > 1) GROUP BY rid),
f AS (SELECT w.rid, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(len(l) AS BIGINT) AS n_lines,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON w.rid = r.rid),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS f0, 10 * n_symbols > n_words AS f1,
        10 * n_dup_lines > 3 * n_lines AS f2, word_chars < 2 * n_words OR word_chars > 15 * n_words AS f3 FROM f),
k AS (SELECT host, rule, count(*) AS n, CAST(sum(CAST(bad AS INT)) AS DOUBLE) AS k FROM (
        SELECT host, 0 AS rule, f0 AS bad FROM s UNION ALL SELECT host, 1, f1 FROM s
        UNION ALL SELECT host, 2, f2 FROM s UNION ALL SELECT host, 3, f3 FROM s) GROUP BY host, rule),
q AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM k GROUP BY rule),
z AS (SELECT *, CASE WHEN v > 0 THEN greatest(1.0, least(1000.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS b FROM q),
h AS (SELECT k.host, max((k.k + z.m * z.b) / (k.n + z.b)) > 0.5 AS host_rejected FROM k JOIN z ON k.rule = z.rule GROUP BY k.host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 AS base_failed, host_rejected,
       NOT f0 AND NOT host_rejected AS kept
FROM s LEFT JOIN h ON s.host IS NOT DISTINCT FROM h.host
"""
