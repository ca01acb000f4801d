"""Mixing sources to target weights by hierarchical budgeting (native: DataFrame functions only).

A tree domain > language > source holds the tokens of the corpus.  A token budget flows down it by weight; a child that
cannot use its share (its documents repeated ``max_epochs`` times) passes the rest to its siblings, and only what no
sibling can use has already been kept from the parent, so that the parent's siblings get it.  A leaf then takes whole
epochs and, of its last epoch, a prefix of its documents in an order that the seed and the epoch set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, with_base

LEVELS = ("domain", "lang", "source")
#: Target weights; whatever is not named weighs 1.
WEIGHTS = {
    "domain": {"brief": 1.0, "article": 4.0, "long": 3.0},
    "lang": {"en": 2.0},
    "source": {},
}
BUDGET_SHARE = 1.0
MAX_EPOCHS = 4
SEED = 17
#: A leaf's last epoch is dealt into groups of about so many documents by hash; only sums of groups are added up by leaf.
GROUP_DOCS = 256
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def domain_of(tokens: Column) -> Column:
    """The form of a document: brief, article or long."""
    return F.when(tokens < 100, F.lit("brief")).when(tokens < 1000, F.lit("article")).otherwise(F.lit("long"))


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    given = weights.get(level, {})
    if not given:
        return F.lit(1.0)
    pairs = F.create_map(*[F.lit(x) for kv in given.items() for x in (kv[0], float(kv[1]))])
    return F.coalesce(F.try_element_at(pairs, F.col(level)), F.lit(1.0))


def share_out(children: DataFrame, parents: list[str], level: str) -> DataFrame:
    """Divide ``budget`` among the children of each parent: adds ``share``, at most ``capacity``, in proportion to ``weight``.

    Children fill up in order of capacity per weight, and those of equal ratio together, so only the distinct ratios of a
    parent are added up in order.  Capacities are whole epochs of whole tokens, so T tokens have at most the root of 2 T
    distinct ratios for each weight, however many children there are.  At each ratio the level that the rest of the budget
    would reach, were all lower ones full, says whether its children are full too; the first that is not sets the level.
    """
    children = cut(children.withColumn("ratio", F.col("capacity") / F.col("weight")), "children")
    ratios = children.groupBy(*parents, "ratio").agg(F.sum("capacity").alias("capacity"), F.sum("weight").alias("weight"), F.first("budget").alias("budget"))
    by = Window.partitionBy(*parents).orderBy("ratio")
    below, onward = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    reach = (F.col("budget") - F.coalesce(F.sum("capacity").over(below), F.lit(0.0))) / F.sum("weight").over(onward)
    stop = F.when(F.col("ratio") > F.col("reach"), F.col("ratio"))
    levels = ratios.withColumn("reach", reach).groupBy(*parents).agg(F.min(stop).alias("stop"), F.min_by("reach", stop).alias("level"))
    full = F.col("stop").isNull() | (F.col("ratio") < F.col("stop"))
    shared = children.join(levels, parents).withColumn("share", F.when(full, F.col("capacity")).otherwise(F.col("level") * F.col("weight")))
    return shared.drop("ratio", "stop", "level")


def budgets(leaves: DataFrame, weights=WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens, docs) with ``quota``, the tokens that the leaf gives."""
    caps = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast("double"))
    parents: list[str] = ["one"]
    total = leaves.agg((F.sum("tokens") * float(budget_share)).alias("share")).withColumn("one", F.lit(1))
    for level in LEVELS:
        nodes = caps.withColumn("one", F.lit(1)).groupBy(*parents, level).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.join(total.withColumnRenamed("share", "budget"), parents).withColumn("weight", _weight(level, weights))
        total = share_out(nodes, parents, level).select(*parents, level, "share")
        parents = [*parents, level]
    return leaves.join(total.drop("one"), list(LEVELS)).withColumn("quota", F.floor(F.col("share") + 1e-6).cast("long")).drop("share")


def mix(rows: DataFrame, weights=WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``rows`` (doc_id, domain, lang, source, tokens, others) once for each epoch that takes them, with ``epoch`` and ``taken``.

    ``taken`` is the tokens that count; it is less than ``tokens`` for the one document of a leaf at which the budget ends.
    Rows without tokens are never taken.  Repeated rows are taken each for itself; rows of one id and size in any order.
    An empty table gives no rows.  A row's other columns may have any names but those used here.
    """
    rows = rows.where("tokens > 0")
    leaves = cut(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "leaves")
    plan = cut(
        budgets(leaves, weights, budget_share, max_epochs).select(
            *LEVELS, F.expr("quota div tokens").alias("whole"), F.expr("quota % tokens").alias("rest"),
            F.ceil(F.col("docs") / GROUP_DOCS).alias("groups"),
        ),
        "budgets",
    )
    planned = rows.join(plan, list(LEVELS))
    whole = planned.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1))).withColumn("taken", F.col("tokens"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    last = planned.where("rest > 0").withColumn("order", order)
    place = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / float(2**32)
    last = last.withColumn("grp", F.floor(place * F.col("groups")).cast("long"))
    sums = last.groupBy(*LEVELS, "grp").agg(F.sum("tokens").alias("n"))
    bases = with_base(sums, list(LEVELS))
    inside = Window.partitionBy(*LEVELS, "grp").orderBy("order", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    part = last.join(bases, [*LEVELS, "grp"]).where("base < rest").withColumn("start", start).where("start < rest")
    part = part.withColumn("epoch", F.col("whole").cast("int")).withColumn("taken", F.least(F.col("tokens"), F.col("rest") - F.col("start")))
    keep = [*rows.columns, "epoch", "taken"]
    return whole.select(*keep).unionByName(part.select(*keep))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source, tokens of documents.  Null lang and source count as empty strings."""
    tokens = token_count(F.col("text"))
    return docs.select(
        "doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"), tokens.alias("tokens")
    ).withColumn("domain", domain_of(F.col("tokens")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(leaf_rows(table(spark, sf_dir, "documents")), "leaf-rows")
    return mix(rows).select("doc_id", "epoch", "domain", "lang", "source", "tokens", "taken")


def _oracle() -> str:
    def weight(level: str) -> str:
        cases = "".join(f" WHEN {level} = '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS[level].items())
        return f"CASE{cases} ELSE 1.0::DOUBLE END" if cases else "1.0::DOUBLE"

    steps, parents, budget = [], ["one"], f"SELECT 1 AS one, sum(tokens) * {BUDGET_SHARE}::DOUBLE AS share FROM leaves"
    steps.append(f"b0 AS ({budget})")
    for i, level in enumerate(LEVELS, 1):
        keys = ", ".join(parents)
        over = f"PARTITION BY {keys} ORDER BY capacity / weight, {level}"
        steps.append(f"""
n{i} AS (SELECT *, {weight(level)} AS weight FROM (SELECT {keys}, {level}, sum(tokens * {MAX_EPOCHS})::DOUBLE AS capacity FROM leaves GROUP BY ALL) JOIN
  (SELECT {keys}, share AS budget FROM b{i - 1}) USING ({keys})),
x{i} AS (SELECT *, (budget - coalesce(sum(capacity) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach FROM n{i}),
y{i} AS (SELECT *, first_value(CASE WHEN capacity / weight > reach THEN reach END IGNORE NULLS)
  OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lvl FROM x{i}),
b{i} AS (SELECT {keys}, {level}, CASE WHEN capacity / weight <= reach THEN capacity ELSE lvl * weight END AS share FROM y{i})""")
        parents.append(level)
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents),
d AS (SELECT *, CASE WHEN tokens < 100 THEN 'brief' WHEN tokens < 1000 THEN 'article' ELSE 'long' END AS domain FROM t WHERE tokens > 0),
leaves AS (SELECT 1 AS one, domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
{",".join(steps)},
q AS (SELECT domain, lang, source, CAST(floor(share + 1e-6) AS BIGINT) // tokens AS whole, CAST(floor(share + 1e-6) AS BIGINT) % tokens AS rest
  FROM leaves JOIN b3 USING (domain, lang, source)),
p AS (SELECT d.*, whole, rest, md5('{SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM d JOIN q USING (domain, lang, source)),
l AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY o, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM p WHERE rest > 0)
SELECT doc_id, CAST(unnest(range(0, whole)) AS INT) AS epoch, domain, lang, source, tokens, tokens AS taken FROM p
UNION ALL
SELECT doc_id, CAST(whole AS INT), domain, lang, source, tokens, CAST(least(tokens, rest - start) AS BIGINT) FROM l WHERE start < rest
"""


ORACLE = _oracle()
