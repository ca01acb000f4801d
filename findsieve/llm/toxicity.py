"""Toxicity of texts after noisy-channel deobfuscation.

Words that look disguised (digits or signs among letters or alone, letters doubled or spaced out) span a lattice of what each
character may stand for.  Viterbi decoding under a character trigram model finds the likeliest plain word.  Words and their
beginnings whose share of toxic documents is far above that of the others are evidence; a logistic model turns
a document's evidence into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held_out_remainder, named, table

#: The classifier is fitted on at most so many labelled rows, those with the least hash of their id; part of them calibrate it.
SAMPLE_ROWS = 20_000
CALIBRATE_EVERY = 4
PREFIXES = (4, 5, 6)
LEAST_TOXIC_DOCS, LEAST_WEIGHT, LEAST_G2 = 3, 2.0, 15.0
CACHED_WORDS = 150_000

# What signs may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
FILLERS = frozenset(".-_*'’·")
#: log10 costs of the channel.
COST_LEET, COST_FILLER, COST_REPEAT = -0.3, -0.2, -0.2
UNSEEN = -4.0
EDGE = "\x02"

_OPEN, _CLOSE, _FILL = r"[(\[{\"'«„“]{0,3}", r"[.,;:!?)\]}\"'»“”…*]{0,3}", r"[.\-_*'’·]"
#: A character that may be a letter; what may lie between those of one spaced word; three or more of them.
_SYMBOL = r"(?:[^\W_]|[@$!|+(€])"
_BETWEEN = rf"(?:{_FILL}{{1,2}}|{_CLOSE}\s+(?:{_FILL}{{1,3}}\s+)?{_OPEN})"
_SPACED = re.compile(rf"(?<!\S){_OPEN}{_SYMBOL}(?:{_BETWEEN}{_SYMBOL}){{2,}}{_CLOSE}(?!\S)")
_PARTS = re.compile(rf"{_BETWEEN}|^{_OPEN}")
_LETTER, _DOUBLED = re.compile(r"[^\W\d_]"), re.compile(r"([^\W\d_])\1")
_SIGN, _HARD, _HARD_OR_DIGIT, _BAR = re.compile(r"[\d@$!|+(€.\-_*'’·]"), re.compile(r"[@$!|+(€]"), re.compile(r"[\d@$!|+(€]"), re.compile(r"[@!|]")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"[$€+\-(]?\d[\d.,:/\-]*[%€$+)]?")
_STRIP = ".,;:!?\"()[]{}«»„“”…|"


def suspect(word: str) -> bool:
    """Doubled letters, signs among letters, words of signs.  Plain numbers and fillers alone are none.  One pass for each pattern."""
    if _DOUBLED.search(word) or (_SIGN.search(word) and _LETTER.search(word)):
        return True
    hard, digit = _HARD.search(word), _DIGIT.search(word)
    return bool(hard and _HARD_OR_DIGIT.search(word, hard.end())) or bool(digit and _BAR.search(word, digit.end()))


#: Letters whose trigrams are counted.
LETTERS = 128


def in_alphabet(char: str) -> bool:
    """Whether a character is of a script of few letters: below the ideographs, or Japanese kana."""
    return char < "\u2e80" or "\u3040" <= char <= "\u30ff"


class CharModel:
    """Character trigrams with backing off to single characters; log10 probabilities.

    Keys of one character add to the counts of that character alone.
    """

    def __init__(self, counts: dict[str, int]):
        self.tri = counts
        self.ctx: Counter = Counter()
        self.one: Counter = Counter()
        for t, n in counts.items():
            if len(t) == 3:
                self.ctx[t[:2]] += n
            self.one[t[-1]] += n
        self.total = sum(self.one.values()) or 1
        self.memo: dict[str, float] = {}

    def step(self, context: str, char: str) -> float:
        key = context + char
        found = self.memo.get(key)
        if found is None:
            base = (self.one.get(char, 0) + 0.01) / (self.total + 1)
            n = self.ctx.get(context, 0)
            found = self.memo[key] = max(UNSEEN, math.log10((self.tri.get(key, 0) + 2 * base) / (n + 2)))
        return found


def _choice(ch: str, repeated: bool) -> list[tuple[str, float]]:
    if ch.isalpha():
        return [(ch, 0.0), ("", COST_REPEAT)] if repeated else [(ch, 0.0)]
    return [*((x, COST_LEET) for x in LEET.get(ch, "")), *([("", COST_FILLER)] if ch in FILLERS else []), (ch, 0.0)]


_chosen: dict[tuple[str, bool], list[tuple[str, float]]] = {}


def choices(word: str) -> list[list[tuple[str, float]]]:
    """The lattice of a word: for each character what it may stand for (nothing, too) and the channel's cost."""
    out, before = [], ""
    for ch in word:
        key = (ch, ch == before)
        here = _chosen.get(key)
        if here is None:
            if len(_chosen) > 10_000:
                _chosen.clear()
            here = _chosen[key] = _choice(*key)
        out.append(here)
        before = ch
    return out


def viterbi(word: str, model: CharModel) -> str:
    """The likeliest plain word; states are the last two characters, what was read is kept as chains.

    What all paths share, up to the first character with a choice and after the last one, once they have met again, is left as it is.
    """
    lattice = choices(word)
    open_ = [i for i, here in enumerate(lattice) if len(here) > 1]
    if not open_:
        return word
    first, last, memo = open_[0], open_[-1], model.memo
    states: dict[str, tuple[float, tuple | None]] = {(EDGE * 2 + word[:first])[-2:]: (0.0, None)}
    at = first
    while at < len(word) and (at <= last or len(states) > 1):
        new: dict[str, tuple[float, tuple | None]] = {}
        for context, (score, chain) in states.items():
            for char, cost in lattice[at]:
                if char:
                    step = memo.get(context + char)
                    s = score + cost + (model.step(context, char) if step is None else step)
                    to = context[1] + char
                    if to not in new or s > new[to][0]:
                        new[to] = (s, (chain, char))
                else:
                    s = score + cost
                    if context not in new or s > new[context][0]:
                        new[context] = (s, chain)
        states = new
        at += 1
    chain = max(states.items(), key=lambda kv: kv[1][0] + model.step(kv[0], EDGE))[1][1] if len(states) > 1 else next(iter(states.values()))[1]
    read = []
    while chain:
        chain, char = chain
        read.append(char)
    return word[:first] + "".join(reversed(read)) + word[at:]


def word_score(word: str, model: CharModel) -> float:
    context, total = EDGE * 2, 0.0
    for ch in word + EDGE:
        total += model.step(context, ch)
        context = (context + ch)[-2:]
    return total


def restore_word(word: str, model: CharModel) -> str:
    """A lower-case word without the signs around it, decoded if it looks disguised."""
    bare = word.strip(_STRIP)
    if not suspect(word) or _NUMBER.fullmatch(word):
        return bare
    inner = word.strip(".,;:?\"()[]{}«»„“”…").rstrip("!")  # an exclamation mark ends a word, but may begin or fill one
    return viterbi(inner, model) if inner else bare


def join_run(symbols: list[str], model: CharModel) -> str:
    """The likeliest words of a run of single characters; words may end after any of them.

    States are the last two characters, as in ``viterbi``; what was read is kept as chains of (before, character, whether a word ends).
    """
    states: dict[str, tuple[float, tuple | None]] = {EDGE * 2: (0.0, None)}
    for n, symbol in enumerate(symbols):
        new: dict[str, tuple[float, tuple | None]] = {}
        here = choices(symbol)[0] + ([("", COST_REPEAT)] if n and symbols[n - 1] == symbol and symbol.isalpha() else [])
        for context, (score, chain) in states.items():
            for char, cost in here:
                if not char and context == EDGE * 2:
                    continue
                s = score + cost + (model.step(context, char) if char else 0.0)
                to = (context + char)[-2:]
                for to, s, end in ((to, s, False), (EDGE * 2, s + model.step(to, EDGE), True)):
                    if to not in new or s > new[to][0]:
                        new[to] = (s, (chain, char, end))
        states = new
    chain = states[EDGE * 2][1]
    read = []
    while chain:
        chain, char, end = chain
        read.append((char, end))
    words, start, text = [], 0, ""
    for i, (char, end) in enumerate(reversed(read)):
        text += char
        if end:
            # A character by itself, or figures, stay as written.
            apart = i == start or not any(c.isalpha() or c in "@$!|+(€" for c in symbols[start : i + 1])
            words += symbols[start : i + 1] if apart else [text]
            start, text = i + 1, ""
    return " ".join(words)


def join_spaced(text: str, model: CharModel) -> str:
    """Runs of single characters become the words that the model finds likeliest; runs without a letter stay."""

    def choose(m: re.Match) -> str:
        run = re.sub(rf"{_CLOSE}$", "", _PARTS.sub(" ", m.group()))
        symbols = run.split()
        return join_run(symbols, model) if any(c.isalpha() for c in run) else m.group()

    return _SPACED.sub(choose, text)


def restore_text(text: str | None, model: CharModel) -> str:
    """The lower-case text with disguised words decoded, words parted by single spaces."""
    return " ".join(restore_word(w, model) for w in join_spaced((text or "").lower(), model).split())


def features_of(word: str) -> list[str]:
    """A word and its beginnings, which are marked so."""
    return [word, *[f"^{word[:n]}" for n in PREFIXES if len(word) >= n]] if word else []


def _count_trigrams(batches):
    """Trigrams of letters of alphabets; for other trigrams, whose number has no such bound, their last character."""
    for batch in batches:
        seen: Counter = Counter()
        for text in batch.column(0):
            seen.update((text.as_py() or "").lower().split())
        bare: Counter = Counter()
        for word, n in seen.items():
            bare[word.strip(_STRIP)] += n
        counts: Counter = Counter()
        for word, n in bare.items():
            if word.isalpha():
                padded = EDGE * 2 + word + EDGE
                if all(map(in_alphabet, word)):
                    for i in range(len(padded) - 2):
                        counts[padded[i : i + 3]] += n
                else:
                    for i in range(len(padded) - 2):
                        t = padded[i : i + 3]
                        counts[t if all(map(in_alphabet, t)) else t[2]] += n
        yield pa.RecordBatch.from_pydict({"t": list(counts), "n": pa.array(counts.values(), pa.int64())}, schema=pa.schema([("t", pa.string()), ("n", pa.int64())]))


def _count_features(sent):
    """``sent``: a broadcast of trigram counts and feature weights, as below."""

    def run(batches):
        model = CharModel(sent.value[0])
        forms = _Forms(model)
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = {x for w in set(join_spaced((text.as_py() or "").lower(), model).split()) for x in forms[w]}
                counts[label].update({f for w in words for f in features_of(w)})
            names = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_pydict(
                {"f": names, "n0": [counts[0][x] for x in names], "n1": [counts[1][x] for x in names]},
                schema=pa.schema([("f", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())]),
            )

    return run


def forms_of(word: str, model: CharModel) -> tuple[str, ...]:
    """What gives evidence of a word as written: restored and, as dropping a doubled letter may make another word of it, plain."""
    restored, bare = restore_word(word, model), word.strip(_STRIP)
    return (restored, bare) if bare != restored and bare.isalpha() else (restored,)


class _Forms(dict):
    """``forms_of`` words, kept."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = forms_of(word, self.model)
        if len(word) <= 64:
            self[word] = found
        return found


class _Weights(dict):
    """The evidence of a word as written: the largest weight among the features of the restored word."""

    def __init__(self, weights: dict[str, float], model: CharModel):
        super().__init__()
        self.weights, self.model = weights, model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found, weights = 0.0, self.weights
        for form in forms_of(word, self.model):
            for f in features_of(form):
                w = weights.get(f)
                if w is not None and w > found:
                    found = w
        if len(word) <= 64:
            self[word] = found
        return found


#: What ``evidence`` gives.
EVIDENCE = ("x1", "x2", "x3", "x4")
EVIDENCE_SCHEMA = "key long, " + ", ".join(f"{x} double" for x in EVIDENCE)


def evidence(text: str, weights: _Weights) -> tuple[float, float, float, float]:
    """Over distinct words: the largest weight, log of their sum, log of its share of the words, log of their number."""
    text = text.lower()
    if _SPACED.search(text):
        text = join_spaced(text, weights.model)
    words = set(text.split())
    hits = [x for x in map(weights.__getitem__, words) if x]
    total = sum(hits)
    return max(hits, default=0.0), math.log1p(total), math.log1p(100 * total / max(1, len(words))), math.log1p(len(words))


def _gather_evidence(sent):
    def run(batches):
        trigrams, weights = sent.value
        cache = _Weights(weights, CharModel(trigrams))
        for batch in batches:
            rows = [evidence(t.as_py() or "", cache) for t in batch.column(1)]
            x = np.array(rows, np.float64).reshape(len(rows), len(EVIDENCE))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(len(EVIDENCE)))], ["key", *EVIDENCE])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Weights and, last, intercept by Newton's method with a small ridge."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """What training gives: trigram counts, feature weights, logistic weights."""

    def __init__(self, trigrams: dict[str, int], weights: dict[str, float], logistic: list[float]):
        self.trigrams, self.weights, self.logistic = trigrams, weights, logistic

    def broadcast(self, spark: SparkSession):
        """Trigram counts and weights, sent to every executor once.

        ``LETTERS`` bounds the counts; the weights are of words of the sample of at most ``SAMPLE_ROWS`` rows.
        """
        return spark.sparkContext.broadcast((self.trigrams, self.weights))


def count_trigrams(docs: DataFrame) -> dict[str, int]:
    """What ``CharModel`` takes, of the texts of all documents.

    Trigrams of the ``LETTERS`` commonest letters (of equally common ones the lower) are counted as such, one with another letter as its
    last character; so there are at most the cube of ``LETTERS`` + 1 of them, and one number for each other character.
    """
    last = F.substring("t", -1, 1)
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_trigrams, "t string, n long")
    counted = cut(counted.groupBy("t").agg(F.sum("n").alias("n")), "trigrams")
    common = counted.where((F.length("t") == 3) & (last != EDGE)).groupBy(last.alias("c")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(LETTERS)
    letters = EDGE + "".join(r["c"] for r in common.collect())
    name = F.when((F.length("t") == 3) & (F.translate("t", letters, "") != ""), last).otherwise(F.col("t"))
    return {r["t"]: r["n"] for r in counted.groupBy(name.alias("t")).agg(F.sum("n").alias("n")).collect()}


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows outside the held-out fold.

    Rows with null label or id are left out; of repeated labels the largest counts.  Without rows of both classes every
    score is the share of toxic rows (one half if there are none).
    """
    known = labels.where("toxic is not null and doc_id is not null").where(held_out_remainder(F.col("doc_id")) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    chosen = cut(known.orderBy(F.xxhash64("id"), "id").limit(sample_rows), "toxicity-sample")
    # ``chosen`` has at most ``sample_rows`` rows of two numbers.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # an id's repeated rows are one
    rows = cut(rows.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(CALIBRATE_EVERY))), "toxicity-rows")
    trigrams = count_trigrams(docs)
    sent = Model(trigrams, {}, []).broadcast(docs.sparkSession)
    size = {r["label"]: r["n"] for r in rows.where("fold > 0").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    counted = rows.where("fold > 0").select("label", "text").mapInArrow(_count_features(sent), "f string, n0 long, n1 long")
    sums = counted.groupBy("f").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b")).where(F.col("b") >= LEAST_TOXIC_DOCS)
    weight = F.log((F.col("b") + 0.5) / (n1 + 1)) - F.log((F.col("a") + 0.5) / (n0 + 1))
    share = (F.col("a") + F.col("b")) / float(max(1, n0 + n1))
    g2 = 2 * (F.col("b") * F.log(F.col("b") / (share * max(1, n1))) + F.when(F.col("a") > 0, F.col("a") * F.log(F.col("a") / (share * max(1, n0)))).otherwise(0.0))
    best = sums.select("f", weight.alias("w"), g2.alias("g2")).where((F.col("w") >= LEAST_WEIGHT) & (F.col("g2") >= LEAST_G2))
    weights = {r["f"]: r["w"] for r in best.collect()}  # words of the sample
    sent = Model(trigrams, weights, []).broadcast(docs.sparkSession)
    seen = rows.where("fold = 0").select(F.col("label").cast("long").alias("label"), "text").mapInArrow(_gather_evidence(sent), EVIDENCE_SCHEMA)
    got = np.array([tuple(r) for r in seen.collect()], np.float64).reshape(-1, 1 + len(EVIDENCE))  # at most ``sample_rows`` rows
    y = got[:, 0]
    if len(set(y.tolist())) < 2:
        share_toxic = (n1 + 0.5) / (n0 + n1 + 1) if n0 + n1 else 0.5
        return Model(trigrams, weights, [0.0] * len(EVIDENCE) + [math.log(share_toxic / (1 - share_toxic))])
    return Model(trigrams, weights, fit_logistic(got[:, 1:], y).tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``score`` for the rest: doc_id, text are read; returns doc_id and score, one row per input row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    x = rows.mapInArrow(_gather_evidence(model.broadcast(docs.sparkSession)), EVIDENCE_SCHEMA)
    *w, b = model.logistic
    z = sum((F.col(x) * float(v) for x, v in zip(EVIDENCE, w, strict=True)), F.lit(float(b)))
    return x.select(F.col("key").alias("doc_id"), (1 / (1 + F.exp(-z))).alias("score"))


def _reject(sent, logistic: list[float], keep: int):
    *w, b = logistic
    w = np.array(w)

    def run(batches):
        trigrams, weights = sent.value
        cache = _Weights(weights, CharModel(trigrams))
        for batch in batches:
            x = np.array([evidence(t.as_py() or "", cache) for t in batch.column(keep)], np.float64).reshape(batch.num_rows, len(EVIDENCE))
            yield batch.filter(pa.array(1 / (1 + np.exp(-(x @ w + b))) < 0.5))

    return run


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is below one half, with all their columns, whatever their names."""
    names = docs.columns
    given = {c: f"c{i}" for i, c in enumerate(names) if c != "text"}  # Spark's Arrow functions don't take every name
    plain = docs.select(*[named(c).alias(k) for c, k in given.items()], F.col("text").cast("string").alias("text"))
    out = plain.mapInArrow(_reject(model.broadcast(docs.sparkSession), model.logistic, len(names) - 1), plain.schema)
    return out.select(*[F.col(given.get(c, "text")).alias(c) for c in names])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts have no evidence and get the score of such.  A null doc_id is not held out.  Repeated rows each get
    a row; an empty table gives none.  Other columns are ignored.
    """
    scored = score(docs, train(docs, labels))
    held = F.coalesce(held_out_remainder(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
