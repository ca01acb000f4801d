"""The pipeline's stages against brute force on the smallest documents."""

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from findsieve.llm import mixing, packing, pii, toxicity
from findsieve.llm.common import table
from tests.conftest import SF
from tests.llm.test_operators import brute_join, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        kept[name] = (docs, spark.read.parquet(path))
        docs = kept[name][1]
        if name != "packing":
            assert docs.columns == COLUMNS

    before, after = kept["toxicity"]
    model = toxicity.train(before, table(spark, SF, "labels"))
    good = {r["doc_id"] for r in toxicity.score(before, model).where("score < 0.5").collect()}
    assert rows_of(after) == Counter({r: n for r, n in rows_of(before).items() if r[0] in good})
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    lost = [r[0] for r in rows_of(before) - rows_of(after)]
    assert sum(labels.get(d) == 0 for d in lost) <= 1

    before, after = kept["ngram_join"]
    plain = list(rows_of(before).elements())
    classes = brute_join([(r[0], r[1]) for r in plain])
    want = {c for (_, c, _), r in zip(classes, plain, strict=True) if words(r[1])}
    assert Counter(r[0] for r in rows_of(after).elements() if words(r[1])) == Counter(want)

    before, after = kept["pii"]
    want = Counter()
    for r, n in rows_of(before).items():
        text = pii.redact(r[1], pii.find_spans(r[1]))
        want[(r[0], text, r[2], r[3], len(text) if text != r[1] else r[4])] += n
    assert rows_of(after) == want

    before, after = kept["mixing"]
    leaves = defaultdict(list)
    for r in rows_of(before).elements():
        n = len(words(r[1]))
        if n:
            domain = "brief" if n < 100 else "article" if n < 1000 else "long"
            leaves[domain, r[2] or "", r[3] or ""].append((n, r))
    table_of = spark.createDataFrame([(*k, sum(n for n, _ in v), len(v)) for k, v in leaves.items()], "domain string, lang string, source string, tokens long, docs long")
    want = Counter()
    for q in mixing.budgets(table_of).collect():
        rows = leaves[q["domain"], q["lang"], q["source"]]
        whole, rest = divmod(q["quota"], q["tokens"])
        for n, r in rows:
            want[r] += whole
        at = 0
        for n, r in sorted(rows, key=lambda x: (hashlib.md5(f"{mixing.SEED}:{whole}:{x[1][0]}".encode()).hexdigest(), x[0])):
            if at < rest:
                want[r] += 1
            at += n
    assert rows_of(after) == +want

    before, after = kept["packing"]
    ids = packing.word_ids(packing.VOCABULARY)
    tokens = sum(len(packing.encode_text(r[1] or "", ids)) // 4 + 1 for r in rows_of(before).elements())
    total, bins = after.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert total == tokens and bins <= -(-tokens // packing.CAPACITY) + 1
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n <> end OR n > 2048").count() == 0


def test_the_guard_is_in_the_entry_alone():
    for name in ("corpus_pipeline.py",):
        assert not re.search(r"except\s+(ImportError|ModuleNotFoundError)", open(name).read())
