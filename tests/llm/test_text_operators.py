"""Quality classifier, periodic runs and fill-in-middle: brute force, exact round trips, held-out accuracy, odd inputs."""

import hashlib
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findsieve.llm import fim, nbsvm, runs
from findsieve.llm.common import table
from tests.conftest import SF

ODD = [(1, None), (2, ""), (3, "a"), (4, "\n"), (5, "x y\nz"), (5, "x y\nz"), (None, "q " * 40), (7, "é ü ß\n" * 9), (8, "a<P>b\nc"), (9, "w" * 300_000), (10, "one\n" * 50_000)]


def odd(spark, rows=ODD):
    """Documents of odd texts, with further columns, one of them called like a result's."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"score": F.lit("s"), "a.b": F.lit(1), "n": F.lit("n"), "start": F.lit(0)})


# Periodic runs ----------------------------------------------------------------------------------------------


def brute_runs(x, least=6, exponent=4):
    found = {}
    for p in range(1, len(x) // exponent + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((s, e, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


@st.composite
def word_lists(draw):
    x = draw(st.lists(st.integers(0, draw(st.sampled_from([0, 1, 2, 5, 40]))), max_size=160))
    for _ in range(draw(st.integers(0, 3))):
        if len(x) > 8:
            a, p = draw(st.integers(0, len(x) - 1)), draw(st.integers(1, len(x) // 4))
            for i in range(a, draw(st.integers(a, len(x)))):
                x[i] = x[a + (i - a) % p]
    return x


@settings(max_examples=200, deadline=None)
@given(st.lists(word_lists(), max_size=4))
def test_runs_are_those_of_brute_force(documents):
    got = runs.find_runs([np.array(d, np.int64) for d in documents])
    assert [[tuple(r) for r in a.tolist()] for a in got] == [brute_runs(d) for d in documents]


@settings(max_examples=60, deadline=None)
@given(word_lists(), st.lists(st.integers(1, 40), min_size=1))
def test_words_may_be_appended_in_any_pieces(x, steps):
    catcher, at, k = runs.SquareCatcher(max(1, len(x) // 4)), 0, 0
    while at < len(x):
        catcher.append(np.array(x[at : at + steps[k % len(steps)]], np.int64))
        at, k = at + steps[k % len(steps)], k + 1
    assert [tuple(r) for r in catcher.runs().tolist()] == brute_runs(x)


def test_appending_a_word_reports_new_squares():
    catcher = runs.SquareCatcher(8)
    told = [catcher.append(np.array([w])) for w in [1, 2, 3, 4, 1, 2, 3, 4, 1, 9, 9]]
    assert told == [[]] * 7 + [[(0, 8, 4)], [(0, 9, 4)], [], [(9, 11, 1)]]


def reference_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    drop = {i for s, e, p in found for i in range(s + p, e)}
    best = min(found, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, sha("".join(f"{s},{e - s},{p}\n" for s, e, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_run_query_against_brute_force(spark):
    got = sorted(tuple(r) for r in runs.op12_periodic_runs(spark, SF).collect())
    want = sorted(reference_row(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect())
    assert got == want and sum(r[1] > 0 for r in got) > 5


def test_runs_of_odd_documents(spark):
    got = {(r["doc_id"], r["text"]): r["runs"] for r in runs.collapse_runs(odd(spark)).collect()}
    assert got[None, "q"] == [(0, 40, 1)] and got[10, "one"] == [(0, 50_000, 1)] and got[1, ""] == got[2, ""] == []
    assert got[7, "é ü ß"] == [(0, 18, 2)] and (9, "w" * 300_000) in got
    assert runs.collapse_runs(odd(spark)).count() == len(ODD) and runs.collapse_runs(odd(spark, ODD[:0])).count() == 0
    long = ["a b c d e f g h".split()[i % 8] for i in range(3 * runs.GROUP_WORDS)]
    assert [tuple(r) for r in runs.find_runs([np.array([ord(w) for w in long])])[0].tolist()] == [(0, len(long), 8)]


# Fill-in-middle ---------------------------------------------------------------------------------------------


def reference_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < 50:
        return (doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


key = lambda rows: sorted(rows, key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.text("a\né<PSM> 中😀", max_size=30)), min_size=1, max_size=8), st.sampled_from([3, 7, 1 << 20]))
def test_moved_bytes_are_those_of_plain_strings(rows, window):
    data = [t.encode() for _, t in rows]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(fim, "WINDOW", window)
        t = fim.Transformed(np.frombuffer(b"".join(data), np.uint8), offsets, [i for i, _ in rows])
        back, at = fim.restore(t.out, t.offsets, t.form)
    assert [bytes(t.document(i)).decode() for i in range(len(rows))] == [reference_fim(*r)[5] for r in rows]
    assert [bytes(back[at[i] : at[i + 1]]) for i in range(len(rows))] == data


def test_fim_of_odd_documents_and_back(spark):
    out = fim.transform(odd(spark))
    assert key(tuple(r) for r in out.collect()) == key(reference_fim(*r) for r in ODD)
    assert key(tuple(r) for r in fim.restore_texts(out).collect()) == key((i, t or "") for i, t in ODD)
    assert fim.transform(odd(spark, ODD[:0])).count() == 0


def test_long_texts_are_groups_by_themselves(spark, monkeypatch):
    rows = [(i, ("l%d é\n" % i) * (500 if i % 3 == 0 else 5)) for i in range(40)]
    monkeypatch.setattr(fim, "GROUP_BYTES", 512)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t.encode() for _, t in rows]})
    names, types = [*fim._FACTS, "output"], [*fim._FACT_TYPES, pa.string()]
    got = [tuple(r.values()) for b in fim._each(fim._texts, names, types)(iter([batch])) for r in b.to_pylist()]
    assert got == [reference_fim(*r) for r in rows]


# Quality classifier -----------------------------------------------------------------------------------------


def test_scores_of_the_held_out_fold(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    rows = nbsvm.op11_quality_classifier(spark, sf).where("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.98 * len(good) * len(bad)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda known: sorted((r["doc_id"], r["score"]) for r in nbsvm.quality(docs.repartition(3), known).collect())
    assert scores(labels) == scores(turned)


def plain_ngrams(text):
    words = text.split()
    forms = [nbsvm.shape(w) + ("=" if i and words[i - 1] == w else "") for i, w in enumerate(words)]
    grams = {("w", w) for w in words} | {("ww", *p) for p in zip(words, words[1:])}  # noqa: B905
    return grams | {("s" * k, *p) for k in (1, 2, 3) for p in zip(*[forms[i:] for i in range(k)])}  # noqa: B905


def test_ngrams_are_those_of_plain_tuples():
    texts = ["", "Aa Aa Aa b1 b1!! &&& x", "one", "The the THE 12 1234 x_y", "é ü é ü"]
    row, gram = nbsvm.ngrams([t.encode() for t in texts], nbsvm._Hashes())
    got = [len(set(gram[row == i].tolist())) for i in range(len(texts))]
    assert got == [len(plain_ngrams(t)) for t in texts]
    # Equal n-grams have equal hashes wherever they are.
    row, gram = nbsvm.ngrams([b"x a b", b"y a b"], nbsvm._Hashes())
    assert len(set(gram[row == 0].tolist()) & set(gram[row == 1].tolist())) == len(plain_ngrams("x a b") & plain_ngrams("y a b"))


def test_dual_coordinate_descent_reaches_the_least_loss():
    random = np.random.default_rng(3)
    scale = random.normal(size=12)
    rows = [np.flatnonzero(random.random(12) < 0.4) for _ in range(120)]
    y = np.array([1 if scale[r].sum() + random.normal() > 0 else -1 for r in rows])
    cost = np.where(y > 0, 0.5, 2.0)
    w = nbsvm.fit_hinge(rows, y, scale, cost, passes=2000, tolerance=1e-7)
    x = np.zeros((120, 13))
    for i, r in enumerate(rows):
        x[i, r] = scale[r]
        x[i, 12] = 1
        x[i] /= np.sqrt((x[i] ** 2).sum())
    loss = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    assert all(loss(w) <= loss(w + random.normal(size=13) * s) + 1e-9 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(200))


def test_quality_of_odd_documents(spark):
    labels = spark.createDataFrame([(3, 1), (5, 0), (7, 1), (None, 1), (9, None)], "doc_id long, quality int")
    got = nbsvm.quality(odd(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1 and not [r for r in got if r["doc_id"] is None and r["held_out"]]
    none = nbsvm.quality(odd(spark), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and nbsvm.quality(odd(spark, ODD[:0]), labels).count() == 0


# Packing ----------------------------------------------------------------------------------------------------


def test_equal_rows_are_ranked_in_many_groups(spark):
    """A hundred thousand rows without an id or text: none of the groups holds more than a few times the others."""
    from findsieve.llm import packing

    pieces = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(7).alias("ids_crc32"), F.lit(1).alias("length"), F.col("id").alias("row"))
    ranked = packing.rank_in_length(pieces, pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")))
    assert [tuple(r) for r in ranked.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).collect()] == [(0, 99_999, 100_000)]
    groups = -(-100_000 // packing.RANK_GROUP)
    sizes = pieces.groupBy(F.pmod(F.xxhash64("row"), F.lit(groups))).count()
    assert sizes.agg(F.max("count")).first()[0] < 2 * packing.RANK_GROUP
