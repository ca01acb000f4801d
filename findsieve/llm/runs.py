"""Periodic runs of words by online dyadic square catching.

Words are appended.  Whenever a block of 2^k words is complete, a catcher for it is set up: a square of period p, with
2 * 2^k <= p < 4 * 2^k, has in its first half at least one whole block, and that block again p words later.  So the suffix of 2^k
words that ends at each appended word is compared with the catchers of the blocks that lie that far back (two of each size), and where it
equals one, the words around both are compared until they differ.  A stretch in which words p apart are identical for p words
and more is made of squares; stretches still open at the last word go on with the next ones, and squares of one period that
meet are one run.  Suffixes are compared by hashes, what they find word by word, so hashes decide nothing.
"""

from __future__ import annotations

import hashlib
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Runs have so many words, and so many times their period.
LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Documents of together so many words are caught at once; a longer one is appended in pieces of so many.
GROUP_WORDS = 1 << 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)


class Words:
    """Numbers of words, as they are appended."""

    def __init__(self):
        self.size, self.room = 0, np.empty(1024, np.int64)

    def append(self, more: np.ndarray) -> None:
        while self.size + len(more) > len(self.room):
            self.room = np.concatenate([self.room, np.empty_like(self.room)])
        self.room[self.size : self.size + len(more)] = more
        self.size += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.size]


class _Level:
    """Catchers of the blocks of ``m`` words: hashes of the windows of m words from ``first`` on, as far back as a catcher looks."""

    def __init__(self, m: int):
        self.m, self.first, self.windows = m, 0, np.empty(0, np.uint64)

    def append(self, more: np.ndarray) -> int:
        """Add windows; the start of the first new one."""
        new = self.first + len(self.windows)
        # Blocks four sizes back from the first new window are still asked for, and by the next larger size five.
        drop = max(0, (new - 6 * self.m) // self.m * self.m - self.first)
        self.windows, self.first = np.concatenate([self.windows[drop:], more]), self.first + drop
        return new

    def matches(self, new: int, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block start, period) where a window from ``new`` on equals a block two or three before its own; blocks marked in ``covered`` are not asked."""
        m, stop = self.m, self.first + len(self.windows)
        low = max(new // m - 3, self.first // m)  # the least block that is asked
        blocks = np.arange(low, stop // m)
        if not len(blocks):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        blocks = blocks[~covered[blocks]]
        found = []
        for ahead in (2, 3):
            b = blocks[(blocks + ahead + 1) * m > new]
            b = b[(b + ahead) * m < stop]
            if not len(b):
                continue
            last = len(self.windows) - 1
            for part in np.array_split(b, len(b) * m // (1 << 18) + 1):  # bounds the table of comparisons
                at = (part[:, None] + ahead) * m + np.arange(m)[None, :]
                same = (self.windows[np.minimum(at - self.first, last)] == self.windows[part * m - self.first][:, None]) & (at >= new) & (at < stop)
                which, shift = np.nonzero(same)
                found.append((part[which] * m, shift + ahead * m))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


class SquareCatcher:
    """Squares of words with periods up to ``max_period``, as words are appended."""

    def __init__(self, max_period: int):
        self.words = Words()
        self.max_period = max_period
        self.levels = [_Level(1)]
        while 4 * self.levels[-1].m <= max_period:
            self.levels.append(_Level(2 * self.levels[-1].m))
        self.open: dict[int, int] = {}  # period: start of the stretch that reaches the last word
        self.stretches: dict[tuple[int, int], int] = {}  # (start, period): end, of stretches that hold a square
        self.short: list[np.ndarray] = []  # the same for periods below four, in arrays of start, end, period
        self.long = [np.empty((0, 3), np.int64)]  # all of them that may cover a block and its copy

    def append(self, more: np.ndarray) -> list[tuple[int, int, int]]:
        """Take words (their numbers); (start, end, period) of stretches of squares that are new or have grown."""
        old = self.words.size
        self.words.append(np.asarray(more, np.int64))
        x, size = self.words.all, self.words.size
        new: list[tuple[int, int, int]] = []
        for p in (1, 2, 3):
            if p <= self.max_period:
                self._next_to(x, p, old, new)
        # Stretches that reached the last word go on.
        for p, start in [(p, s) for p, s in self.open.items() if p > 3]:
            end = self._forward(x, old, p)
            if end < size:
                del self.open[p]
            if end - start >= 2 * p and end > old:
                self.stretches[start, p] = end
                self._may_cover(start, end, p)
                new.append((start, end, p))
        windows = x[old:].astype(np.uint64)
        for k, level in enumerate(self.levels):
            m = level.m
            if k:
                below = self.levels[k - 1]
                first = max(0, level.first + len(level.windows))
                last = below.first + len(below.windows) - m // 2
                if last <= first:
                    windows = np.empty(0, np.uint64)
                else:
                    a = below.windows[first - below.first : last - below.first]
                    b = below.windows[first - below.first + m // 2 : last - below.first + m // 2]
                    windows = (a ^ (a >> _SHIFT)) * _A + (b ^ (b >> _SHIFT)) * _B
            begin = level.append(windows)
            if k and len(windows):
                self._catch(x, level, begin, new)
        return new

    def _may_cover(self, start: int, end: int, p: int) -> None:
        if end - start >= 3 * p:
            self.long.append(np.array([[start, end, p]], np.int64))

    def _next_to(self, x: np.ndarray, p: int, old: int, new: list) -> None:
        """Periods below four: all words are compared with the one, two or three before."""
        at = max(0, old - p)
        if len(x) <= p:
            return
        same = x[at:-p] == x[at + p :]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        starts, ends = edge[::2] + at, edge[1::2] + at + p
        was_open = self.open.pop(p, None)
        if len(starts) and was_open is not None and starts[0] == at:
            starts[0] = was_open
        if len(ends) and ends[-1] == len(x):
            self.open[p] = int(starts[-1])
        held = np.flatnonzero(ends - starts >= 2 * p)
        if len(held):
            self.short.append(np.stack([starts[held], ends[held], np.full(len(held), p)], 1))
            new += [(int(s), int(e), p) for s, e in zip(starts[held], ends[held], strict=True)]
            self.long.append(self.short[-1][self.short[-1][:, 1] - self.short[-1][:, 0] >= 6])

    def _reach(self, m: int, size: int) -> np.ndarray:
        """For each block of m words, how far from its start on all words are known to be of one period up to m.

        A block and its copy in such a stretch are some such periods apart, and what they would find is that stretch.
        """
        if len(self.long) > 1:
            self.long = [np.concatenate(self.long)]
        reach = np.zeros(size // m + 1, np.int64)
        a = self.long[0]
        a = a[(a[:, 2] <= m) & (a[:, 1] - a[:, 0] >= 3 * m)]
        at = -(-a[:, 0] // m)
        np.maximum.at(reach, at[at < len(reach)], a[at < len(reach), 1])
        return np.maximum.accumulate(reach)

    def _catch(self, x: np.ndarray, level: _Level, begin: int, new: list) -> None:
        size = len(x)
        reach = self._reach(level.m, size)
        b, p = level.matches(begin, reach >= np.minimum((np.arange(len(reach)) + 5) * level.m, size))
        keep = (p <= self.max_period) & (b + p + level.m > reach[b // level.m])
        b, p = b[keep], p[keep]
        if not len(b):
            return
        keep = (x[b] == x[b + p]) & (x[b + level.m - 1] == x[b + p + level.m - 1])  # most hashes that meet by chance end here
        b, p = b[keep], p[keep]
        # Up to 16 words to either side at once; few go on.
        left, right = b.copy(), b + level.m
        for _ in range(16):
            go = (left > 0) & (x[np.maximum(left - 1, 0)] == x[np.maximum(left - 1, 0) + p])
            if not go.any():
                break
            left -= go
        for _ in range(16):
            go = (right + p < size) & (x[right] == x[np.minimum(right + p, size - 1)])
            if not go.any():
                break
            right += go
        # What ended on both sides within those words, before it was a square, is done.
        far = (b - left >= 16) | (right - b - level.m >= 16) | (right - left >= p) | (right + p >= size)
        last: dict[int, tuple[int, int]] = {}
        for at, period in sorted(zip(b[far].tolist(), p[far].tolist(), strict=True)):
            if period in last and last[period][0] <= at and at + period + level.m <= last[period][1]:
                continue
            if self.open.get(period, at + 1) <= at:
                continue
            if not np.array_equal(x[at : at + level.m], x[at + period : at + period + level.m]):
                continue
            start, end = self._backward(x, at, period), self._forward(x, at + level.m + period, period)
            last[period] = (start, end)
            if end == size:
                self.open[period] = start
            if end - start >= 2 * period and self.stretches.get((start, period)) != end:
                self.stretches[start, period] = end
                self._may_cover(start, end, period)
                new.append((start, end, period))

    @staticmethod
    def _forward(x: np.ndarray, at: int, p: int) -> int:
        """The first place from ``at`` on whose word differs from that p before it."""
        step, size = 64, len(x)
        while at < size:
            to = min(size, at + step)
            differs = x[at:to] != x[at - p : to - p]
            if differs.any():
                return at + int(differs.argmax())
            at, step = to, min(2 * step, 1 << 16)
        return size

    @staticmethod
    def _backward(x: np.ndarray, at: int, p: int) -> int:
        """The least place from which on, up to ``at``, words equal those p after them."""
        step = 64
        while at > 0:
            to = max(0, at - step)
            differs = x[to:at] != x[to + p : at + p]
            if differs.any():
                return at - int(differs[::-1].argmax())
            at, step = to, min(2 * step, 1 << 16)
        return 0

    def runs(self, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
        """start, end and smallest period of all runs so far, by start, then period.

        A stretch of four periods and more whose smallest period is another is a stretch of that period too, with the same ends.
        """
        found = [*self.short, np.array([(s, e, p) for (s, p), e in self.stretches.items()], np.int64).reshape(-1, 3)]
        a = np.concatenate(found)
        a = a[(a[:, 1] - a[:, 0]) >= np.maximum(least_words, least_exponent * a[:, 2])]
        # A stretch that grew is there with each of its ends; the last counts.
        a = a[np.lexsort((-a[:, 1], a[:, 0], a[:, 2]))]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:, 2] != a[:-1, 2]) | (a[1:, 0] != a[:-1, 0])
        a = a[first]
        a = a[np.lexsort((a[:, 2], a[:, 1], a[:, 0]))]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:, 0] != a[:-1, 0]) | (a[1:, 1] != a[:-1, 1])
        a = a[first]
        return a[np.lexsort((a[:, 2], a[:, 0]))]


def find_runs(documents: list[np.ndarray], least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> list[np.ndarray]:
    """start, end and period of the runs of each document of numbered words (from 0)."""
    sizes = np.array([len(d) for d in documents], np.int64)
    if not len(sizes):
        return []
    catcher = SquareCatcher(int(sizes.max()) // least_exponent)
    # A mark of its own ends each document, so that no square spans two.
    whole = np.concatenate([y for i, d in enumerate(documents) for y in (d, [-1 - i])]).astype(np.int64)
    for at in range(0, len(whole), GROUP_WORDS):
        catcher.append(whole[at : at + GROUP_WORDS])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    a = catcher.runs(least_words, least_exponent)
    bounds = np.searchsorted(a[:, 0], starts)
    return [a[bounds[i] : bounds[i + 1]] - [starts[i], starts[i], 0] for i in range(len(documents))]


def with_planted_runs(words: list, doc_id: int) -> list:
    """The words of a document; of every tenth, by the hash of its id, the words from some place on repeat with a period."""
    h, n = crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    head = words[a : a + p]
    return words[:a] + (head * -(-(n - a) // p))[: n - a]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def longest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """start, length and period of the run with the greatest length / period; ties go to the smallest start, then period."""
    best = None
    for start, end, period in runs.tolist():
        length = end - start
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


class _Document:
    """A document's words (bytes) and their runs."""

    def __init__(self, words: list[bytes], runs: np.ndarray):
        self.words, self.runs = words, runs

    def collapsed(self) -> bytes:
        return b" ".join(compress(self.words, kept(len(self.words), self.runs).tolist()) if len(self.runs) else self.words)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def scan(documents: list[list[bytes]]) -> list[_Document]:
    """Documents with their runs; those of like length are caught together, as the longest sets the sizes of blocks."""
    order = sorted(range(len(documents)), key=lambda i: len(documents[i]))
    out: list[_Document | None] = [None] * len(documents)
    none = np.empty((0, 3), np.int64)
    group: list[int] = []
    held = 0

    def catch() -> None:
        number = _Numbers()
        numbered = [np.fromiter(map(number.__getitem__, documents[i]), np.int64, len(documents[i])) for i in group]
        for i, runs in zip(group, find_runs(numbered), strict=True):
            out[i] = _Document(documents[i], runs)

    for i in order:
        n = len(documents[i])
        if n < LEAST_WORDS:
            out[i] = _Document(documents[i], none)
            continue
        if group and (held + n > GROUP_WORDS or n > 4 * len(documents[group[0]])):
            catch()
            group, held = [], 0
        group.append(i)
        held += n
    if group:
        catch()
    return out


def _batches(batch, max_bytes: int = 1 << 23):
    """Ranges of rows of a batch of at most ``max_bytes`` of text; a longer text is a range by itself."""
    first, held = 0, 0
    for i, cell in enumerate(batch.column(1)):
        size = cell.as_buffer().size if cell.is_valid else 0
        if held and held + size > max_bytes:
            yield first, i
            first, held = i, 0
        held += size
    if first < batch.num_rows:
        yield first, batch.num_rows


def _texts_of(batch, planted: bool):
    for first, last in _batches(batch):
        ids = batch.column(0).slice(first, last - first).to_pylist()
        words = [(cell.as_py() or b"").split() for cell in batch.column(1).slice(first, last - first)]  # splits bytes at ASCII white space alone
        if planted:
            words = [with_planted_runs(w, i) if i is not None else w for w, i in zip(words, ids, strict=True)]
        yield ids, scan(words)


def _collapse(batches):
    for batch in batches:
        for ids, found in _texts_of(batch, False):
            runs = [[{"start": s, "length": e - s, "period": p} for s, e, p in d.runs.tolist()] for d in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, _RUNS), pa.array([str(d.collapsed(), "utf-8") for d in found], pa.string())], ["doc_id", "runs", "text"])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def collapse_runs(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, ``runs`` (start, length, period; in words from 0, by start, then period) and the ``text`` without repeats.

    Words are what ASCII white space parts, joined by single spaces in ``text``.  Null and empty texts have no runs and give
    an empty text.  Repeated rows each get a row; an empty table gives none.  Other columns are ignored.
    """
    return _rows(docs).mapInArrow(_collapse, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")


_DIGEST = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]


def _digest(batches):
    for batch in batches:
        for ids, found in _texts_of(batch, True):
            rows = []
            for i, d in zip(ids, found, strict=True):
                best = longest(d.runs)
                listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in d.runs.tolist())
                rows.append((i, len(d.runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(d.collapsed()).hexdigest()))
            cols = zip(*rows, strict=True)
            types = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [*_DIGEST, "runs_sha256", "collapsed_sha256"])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents, planted ones included; a null doc_id has none planted."""
    return _rows(table(spark, sf_dir, "documents")).mapInArrow(_digest, ", ".join(f"{c} long" for c in _DIGEST) + ", runs_sha256 string, collapsed_sha256 string")
