"""Quality of texts by naive Bayes support vectors.

A text is the set of its n-grams: words and pairs of words, and runs of one to three word shapes (letters by case, digits
and signs, repeats of one kind once; a word equal to the one before is marked).  Each n-gram's indicator is scaled by the log of its
ratio of class counts; on the scaled indicators a linear model with hinge loss is fitted by dual coordinate descent, and drawn toward
naive Bayes.  A logistic curve through the margins of rows that were kept apart makes probabilities of margins.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held_out_remainder, table
from .toxicity import fit_logistic

#: The model is fitted on at most so many labelled rows, those with the least hash of their id; every fourth calibrates it.
SAMPLE_ROWS = 20_000
CALIBRATE_EVERY = 4
#: N-grams of the model: those of the sample whose classes differ most, by G2.
FEATURES = 8192
LEAST_DOCS, SMOOTHING = 3, 1.0
#: Bound of the dual variables, passes over the rows, share of the fitted weights against those of naive Bayes.
COST, PASSES, OWN_SHARE = 1.0, 20, 0.75
THRESHOLD = 0.3
#: Texts of together so many bytes are looked at at once; a longer one by itself.
GROUP_BYTES = 1 << 22
CACHED_WORDS = 200_000

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_KINDS = [np.uint64(x) for x in (0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_R = np.uint64(32)
_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]+"), re.compile(r"\d+")


def shape(word: str) -> str:
    """A word with runs of upper-case, other letters, digits and equal signs made one character each."""
    plain = _DIGIT.sub("9", _UPPER.sub("A", _LOWER.sub("a", word)))
    return "".join(k for k, _ in groupby(plain))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _R)) * _K[0]
    return h ^ (h >> _R)


class _Hashes(dict):
    """Hashes of a word (bytes) and of its shape."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(shape(word.decode("utf-8", "replace")), 1)
        if len(word) <= 64:
            self[word] = found
        return found


def ngrams(texts: list[bytes], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the n-grams of some texts, repeats included."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    pairs = [hashes[w] for ws in words for w in ws]
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    both = np.array(pairs, np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes)
    word, form = both[:, 0], both[:, 1].copy()
    one = row[1:] == row[:-1]
    form[1:] += (one & (word[1:] == word[:-1])).astype(np.uint64)  # marks a repeated word
    two = one[1:] & one[:-1]
    rows = [row, row[1:][one], row, row[1:][one], row[2:][two]]
    grams = [word, (word[:-1] * _K[1] + word[1:])[one], form, (form[:-1] * _K[1] + form[1:])[one], ((form[:-2] * _K[1] + form[1:-1]) * _K[2] + form[2:])[two]]
    return np.concatenate(rows), np.concatenate([_mix(g ^ k) for g, k in zip(grams, _KINDS, strict=True)])


def _groups(column):
    """(first row, texts as bytes) of at most ``GROUP_BYTES`` together, or one longer text; nulls are empty."""
    first, held, texts = 0, 0, []
    for i, cell in enumerate(column):
        text = cell.as_py() or b""
        if texts and held + len(text) > GROUP_BYTES:
            yield first, texts
            first, held, texts = i, 0, []
        texts.append(text)
        held += len(text)
    if texts:
        yield first, texts


def _count(batches):
    """Documents of each class with an n-gram, added up for a batch; ``gram`` is the hash as a signed number."""
    hashes = _Hashes()
    for batch in batches:
        labels = np.array(batch.column(0).to_pylist(), np.int64)
        for first, texts in _groups(batch.column(1)):
            row, gram = ngrams(texts, hashes)
            order = np.lexsort((row, gram))
            row, gram = row[order], gram[order]
            new = np.ones(len(row), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
            row, gram = row[new], gram[new]
            label = labels[first + row]
            seen, at = np.unique(gram, return_inverse=True)
            n1 = np.bincount(at, label, len(seen)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(np.bincount(at, minlength=len(seen)) - n1), pa.array(n1)], ["gram", "n0", "n1"])


class _Index:
    """Places of hashes among those of the model; most others are turned away by a table of their last bits."""

    def __init__(self, grams: np.ndarray):
        self.order = np.argsort(grams)
        self.sorted = grams[self.order]
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[grams & np.uint64((1 << 18) - 1)] = True

    def find(self, row: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the n-grams that are in the model, each pair once."""
        if not len(self.sorted):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keep = self.maybe[gram & np.uint64((1 << 18) - 1)]
        row, gram = row[keep], gram[keep]
        at = np.minimum(np.searchsorted(self.sorted, gram), len(self.sorted) - 1)
        keep = self.sorted[at] == gram
        both = np.unique(row[keep] * len(self.sorted) + self.order[at[keep]])
        return both // len(self.sorted), both % len(self.sorted)


def _indicators(grams: list[int]):
    """label, calibrates and the indicators of the model's n-grams as bits."""
    index = _Index(np.array(grams, np.int64).view(np.uint64))

    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            for first, texts in _groups(batch.column(2)):
                row, at = index.find(*ngrams(texts, hashes))
                bits = np.zeros((len(texts), len(grams)), bool)
                bits[row, at] = True
                packed = np.packbits(bits, axis=1)
                arrays = [batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array([r.tobytes() for r in packed], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["label", "calibrates", "bits"])

    return run


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, passes: int = PASSES, seed: int = 0, tolerance: float = 0.01) -> np.ndarray:
    """Weights of scaled indicators and, last, of the constant, that minimise |w|^2 / 2 + the sum of ``cost`` times the hinge losses.

    ``rows``: the indicators of each row, scaled to length one with the constant; ``y``: -1 or 1.  Dual coordinate descent: one dual variable a row, between 0
    and its cost, is set to its best given the others, rows in a new random order each pass, until no projected gradient is large.
    """
    w = np.zeros(len(scale) + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([1 / np.sqrt(1 + (scale[r] ** 2).sum()) for r in rows])
    random = np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in random.permutation(len(rows)):
            r = rows[i]
            x = scale[r] * norm[i]
            gradient = y[i] * (w[r] @ x + w[-1] * norm[i]) - 1
            projected = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == cost[i] else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - gradient, 0.0), cost[i])  # a row of length one has a second derivative of one
                step = (new - alpha[i]) * y[i]
                w[r] += step * x
                w[-1] += step * norm[i]
                alpha[i] = new
        if worst < tolerance:
            break
    return w


class Model:
    """N-grams (signed hashes), their log-count ratios, weights of the scaled indicators (last: the constant), slope and intercept of the logistic curve."""

    def __init__(self, grams: list[int], ratios: np.ndarray, weights: np.ndarray, curve: tuple[float, float]):
        self.grams, self.ratios, self.weights, self.curve = grams, ratios, weights, curve

    def margins(self, n: int, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Margins of n rows from their (row, place) pairs."""
        squares = np.bincount(row, self.ratios[at] ** 2, n)
        return (np.bincount(row, (self.ratios * self.weights[:-1])[at], n) + self.weights[-1]) / np.sqrt(1 + squares)

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * margins + self.curve[1], -30, 30)))


def sample_of(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """label, calibrates and text (binary) of at most ``sample_rows`` labelled ids outside the held-out fold, one row each.

    Rows with null label or id are left out; of repeated labels the largest counts, of documents of one id the least text.
    """
    known = labels.where("quality is not null and doc_id is not null").where(held_out_remainder(F.col("doc_id")) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality").cast("long")).alias("label"))
    chosen = cut(known.orderBy(F.xxhash64("id"), "id").limit(sample_rows), "quality-sample")
    # ``chosen`` has at most ``sample_rows`` rows of two numbers.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))
    calibrates = F.pmod(F.xxhash64("id"), F.lit(CALIBRATE_EVERY)) == 0
    return cut(rows.select("label", calibrates.alias("calibrates"), F.col("text").cast("binary").alias("text")), "quality-rows")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Model:
    """Fit on a bounded sample of labelled rows.  Without rows of both classes every score is the share of good rows (one half if there are none)."""
    rows = sample_of(docs, labels, sample_rows)
    fit = rows.where("not calibrates")
    size = {r["label"]: r["n"] for r in fit.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    share = (n1 + 0.5) / (n0 + n1 + 1)
    constant = Model([], np.zeros(0), np.zeros(1), (0.0, float(np.log(share / (1 - share)))))
    if not n0 or not n1:
        return constant
    counts = fit.select("label", "text").mapInArrow(_count, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"))
    a, b = F.col("a"), F.col("b")
    part = lambda k, of, total: F.when(k > 0, k * F.log(k * float(n0 + n1) / (total * float(of)))).otherwise(0.0)
    both = a + b
    g2 = part(a, n0, both) + part(b, n1, both) + part(n0 - a, n0, n0 + n1 - both) + part(n1 - b, n1, n0 + n1 - both)
    best = counts.where(both >= LEAST_DOCS).select("gram", "a", "b", F.round(g2, 6).alias("g2")).orderBy(F.desc("g2"), "gram").limit(features).collect()
    # At most ``features`` numbers, and below as many bits for each of ``sample_rows`` rows.
    grams = [r["gram"] for r in best]
    p, q = np.array([r["b"] for r in best], float) + SMOOTHING, np.array([r["a"] for r in best], float) + SMOOTHING
    ratios = np.log((p / p.sum()) / (q / q.sum())) if grams else np.zeros(0)
    seen = rows.select("label", "calibrates", "text").mapInArrow(_indicators(grams), "label long, calibrates boolean, bits binary").toArrow()
    y = np.where(seen.column("label").to_numpy() == 1, 1, -1)
    apart = seen.column("calibrates").to_numpy(zero_copy_only=False)
    on = [np.flatnonzero(np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(grams))) if grams else np.zeros(0, np.int64) for x in seen.column("bits")]
    fitted = np.flatnonzero(~apart)
    order = sorted(fitted.tolist(), key=lambda i: (on[i].tobytes(), y[i]))  # whatever order the rows came in
    cost = np.where(y[order] == 1, COST * (n0 + n1) / (2 * n1), COST * (n0 + n1) / (2 * n0))
    w = fit_hinge([on[i] for i in order], y[order], ratios, cost)
    # Naive Bayes has a weight of one for each scaled indicator; the model's mean weight takes its place.
    mean = np.abs(w[:-1]).mean() if grams else 0.0
    w[:-1] = OWN_SHARE * w[:-1] + (1 - OWN_SHARE) * mean
    model = Model(grams, ratios, w, (1.0, 0.0))
    held = np.flatnonzero(apart)
    if len(set(y[held].tolist())) < 2:
        held = np.arange(len(y))
    at = np.repeat(np.arange(len(held)), [len(on[i]) for i in held])
    margins = model.margins(len(held), at, np.concatenate([on[i] for i in held]) if len(at) else np.zeros(0, np.int64))
    slope, intercept = fit_logistic(margins[:, None], (y[held] == 1).astype(float))
    return Model(grams, ratios, w, (float(slope), float(intercept)))


def _score(model: Model):
    def run(batches):
        index, hashes = _Index(np.array(model.grams, np.int64).view(np.uint64)), _Hashes()
        for batch in batches:
            for first, texts in _groups(batch.column(1)):
                scores = model.scores(model.margins(len(texts), *index.find(*ngrams(texts, hashes))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(scores)], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: good likelier), predicted.

    Null and empty texts have no n-grams and get the score of such.  A null doc_id is not held out.  Repeated rows each get a row
    with equal scores; an empty table gives none.  Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    scored = rows.mapInArrow(_score(train(docs, labels)), "doc_id long, score double")
    held = F.coalesce(held_out_remainder(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
