"""Language-model scoring: one corpus-wide bigram model in Elias-Fano tries, asked by the documents.

1. A task reads documents into parts of bounded size; a part lists its distinct words.
2. Ranges of word hashes add up the counts of all parts and tell each part the corpus' number and count of its words.
3. A part asks for its distinct word pairs, named by those numbers, with its own training counts.  Ranges of contexts add up
   the counts and build the model's trie: contexts, pointers and successors are monotone Elias-Fano sequences, successors
   are numbered relative to their context's base, and discounted probabilities are codes of 8 bits whose values are one
   codebook of the corpus.  Every question of every part is answered from the trie by a context-relative successor search.
4. A part adds up the probabilities of its documents' tokens.

Parts and ranges exchange rows of packed, gap-coded numbers; a pair of part and range without a question has no row, so rows
are at most the questions.  A context of more than ``PIECE`` occurrences is spread over ranges by its successors.
"""

from __future__ import annotations

import math
import mmap
import os
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out_remainder, table

HELD_OUT = 1
#: Weight of the unigram prior in a bigram probability, as a number of observations.
PRIOR = 4.0
#: Text of a part, and text whose word pairs one range adds up, in bytes.
PART_BYTES, RANGE_BYTES = 16 << 20, 6 << 20
#: Word ranges are fewer, as a part has fewer distinct words than pairs.
WORD_RANGE_BYTES = 24 << 20
#: Ranges are dealt to tasks by hash; of several small ones a task's share varies less than of one.
RANGES_PER_TASK = 4
#: Occurrences of a context for each range that its successors are spread over.
PIECE = 1 << 20
CODES = 256
#: Words never hold a space, so these are none.
END_WORD, START_WORD = b" end", b" start"
#: Case folding of A-Z only, for bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# Packed numbers -------------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 below 2**64: their number, the bytes of the largest, then compressed planes of bytes."""
    v = values.astype("<u8")
    width = max(1, -(-int(v.max()).bit_length() // 8)) if len(v) else 1
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(v).to_bytes(8, "little") + bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=n * width), np.uint8) if n else np.empty(0, np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.reshape(width, n).T
    return out.view("<u8").ravel()


def gaps(ordered: np.ndarray) -> np.ndarray:
    """The first of ascending numbers, then their differences."""
    out = ordered.astype(np.uint64)
    out[1:] -= ordered[:-1].astype(np.uint64)
    return out


def pack_pairs(context: np.ndarray, word: np.ndarray) -> bytes:
    """Pairs in order: gaps of contexts and, within a context, of words."""
    step = gaps(word)
    new = np.r_[True, context[1:] != context[:-1]]
    step[new] = word[new]
    head = pack(gaps(context))
    return len(head).to_bytes(8, "little") + head + pack(step)


def unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = 8 + int.from_bytes(data[:8], "little")
    jump, step = unpack(data[8:at]), unpack(data[at:])
    if not len(step):
        return jump.astype(np.int64), step.astype(np.int64)
    new = jump > 0
    new[0] = True
    total = np.cumsum(step)
    first = np.flatnonzero(new)
    before = total[first] - step[first]
    return np.cumsum(jump).astype(np.int64), (total - np.repeat(before, np.diff(np.r_[first, len(step)]))).astype(np.int64)


# Elias-Fano sequences -------------------------------------------------------------------------------------

_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_SELECT = np.zeros((256, 8), np.uint64)
for _b in range(256):
    for _k, _p in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT[_b, _k] = _p


def select_in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the set bit number ``k`` (from 0) of each 64-bit word, which has more than ``k``."""
    u = np.uint64
    s = x - (x >> u(1) & u(0x5555555555555555))
    s = (s & u(0x3333333333333333)) + (s >> u(2) & u(0x3333333333333333))
    s = s + (s >> u(4)) & u(0x0F0F0F0F0F0F0F0F)
    upto = s * _BYTES  # set bits up to each byte
    k = k.astype(np.uint64)
    place = np.bitwise_count((k * _BYTES | _TOPS) - upto & _TOPS).astype(np.uint64) * u(8)
    before = (upto << u(8)) >> place & u(255)
    return (place + _SELECT[x >> place & u(255), k - before]).astype(np.int64)


class EliasFano:
    """An ascending sequence: low bits packed, high bits in unary with a count of ones for every 256 bits."""

    BLOCK = 4

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        """``values``: ascending, from 0 to ``universe`` - 1."""
        n = len(values)
        low = max(0, (universe // n).bit_length() - 1) if n else 0
        v = values.astype(np.int64)
        high = (v >> low) + np.arange(n)
        size = (int(high[-1]) + 2 if n else 1) + 64
        bits = np.zeros(-(-size // 256) * 256, np.uint8)
        bits[high] = 1
        lower = np.zeros(-(-n * low // 64) + 2, np.uint64)
        packed = lower.view(np.uint8)
        for a in range(0, n if low else 0, 1 << 16):  # whole bytes for every 65,536 numbers
            part = np.packbits((v[a : a + (1 << 16), None] >> np.arange(low) & 1).astype(np.uint8), bitorder="little")
            packed[a * low // 8 : a * low // 8 + len(part)] = part
        return {"upper": np.packbits(bits, bitorder="little").view("<u8"), "lower": lower, "shape": np.array([n, low], np.int64)}

    def __init__(self, upper: np.ndarray, lower: np.ndarray, shape: np.ndarray):
        self.n, self.low = (int(x) for x in shape)
        self.upper, self.lower = upper, lower
        ones = np.bitwise_count(upper).reshape(-1, self.BLOCK).sum(axis=1, dtype=np.int64)
        self.ones = np.r_[0, np.cumsum(ones)]
        self.zeros = 64 * self.BLOCK * np.arange(len(self.ones), dtype=np.int64) - self.ones

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        ranks = self.ones if one else self.zeros
        block = np.searchsorted(ranks, k, "right") - 1
        left, at = k - ranks[block], block * self.BLOCK
        word = lambda: self.upper[at] if one else ~self.upper[at]
        for _ in range(self.BLOCK - 1):
            c = np.bitwise_count(word()).astype(np.int64)
            on = left >= c
            left = np.where(on, left - c, left)
            at = at + on
        return 64 * at + select_in_word(word(), left)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.int64)
        bit = i * self.low
        at, shift = bit >> 6, (bit & 63).astype(np.uint64)
        both = self.lower[at] >> shift | self.lower[at + 1] << np.uint64(1) << (np.uint64(63) - shift)
        return (both & np.uint64((1 << self.low) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        return (self._select(i, True) - i) << self.low | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value that is not below ``x``; n if there is none."""
        high = x >> self.low
        inside = high < int(self.zeros[-1])
        h = np.where(inside, high, 0)
        # Values with this high part lie between the zeros before and after it.
        at = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - (h - 1), 0)
        end, target = self._select(h, False) - h, x & ((1 << self.low) - 1)
        open_ = np.flatnonzero(inside & (at < end))
        while len(open_):
            middle = (at[open_] + end[open_]) >> 1
            below = self._low(middle) < target[open_]
            at[open_[below]] = middle[below] + 1
            end[open_[~below]] = middle[~below]
            open_ = open_[at[open_] < end[open_]]
        return np.where(inside, np.minimum(at, self.n), self.n)


def codebook(total: int, prior: float = PRIOR) -> np.ndarray:
    """The values of codes 1 to 255 (code 0: unseen): evenly spaced from the least log10 share that ``total`` tokens allow up to 0.

    They depend on a sum over the corpus alone, so all ranges have the same, and no value is off by more than half a step.
    """
    return np.r_[-np.inf, np.linspace(-math.log10(total + prior + 1), 0.0, CODES - 1)]


def quantise(logs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The codes of the nearest ``values``."""
    return np.clip(np.rint((logs - values[1]) / (values[2] - values[1])), 0, CODES - 2).astype(np.uint8) + np.uint8(1)


class Trie:
    """Contexts and, for each, the words that follow it with their codes, in one memory map.

    ``levels`` gives the arrays of a model range, ``mapped`` puts them in anonymous shared memory: no file is left behind.
    """

    PARTS = ("context", "ptr", "base", "word")

    @staticmethod
    def levels(context: np.ndarray, word: np.ndarray, code: np.ndarray) -> dict[str, np.ndarray]:
        """``context``, ``word``: distinct pairs in order."""
        n = len(context)
        new = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if n else np.empty(0, np.int64)
        pointers = np.r_[new, n]
        base = np.r_[0, np.cumsum(word[pointers[1:] - 1] + 1)] if n else np.zeros(1, np.int64)
        owner = np.repeat(np.arange(len(new)), np.diff(pointers))
        pieces = {
            "context": EliasFano.encode(context[new], int(context[-1]) + 1 if n else 1),
            "ptr": EliasFano.encode(pointers, n + 1),
            "base": EliasFano.encode(base, int(base[-1]) + 1),
            "word": EliasFano.encode(base[owner] + word, int(base[-1]) + 1),
        }
        return {f"{k}.{x}": v for k, piece in pieces.items() for x, v in piece.items()} | {"code": code}

    def __init__(self, levels: dict[str, np.ndarray]):
        places, size = {}, 0
        for k, v in levels.items():
            size += -size % 8
            places[k] = (size, v.dtype, len(v))
            size += v.nbytes
        handle = os.memfd_create("trie")
        try:
            os.ftruncate(handle, max(8, size))
            for k, v in levels.items():
                os.pwrite(handle, v.tobytes(), places[k][0])
            self.map = mmap.mmap(handle, max(8, size), prot=mmap.PROT_READ)
        finally:
            os.close(handle)
        got = {k: np.frombuffer(self.map, dtype, n, at) for k, (at, dtype, n) in places.items()}
        self.context, self.ptr, self.base, self.word = (EliasFano(*(got[f"{k}.{x}"] for x in ("upper", "lower", "shape"))) for k in self.PARTS)
        self.code = got["code"]

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The codes of pairs; 0 for those that the trie has not."""
        out = np.zeros(len(context), np.uint8)
        at = self.context.successor(context)
        known = np.flatnonzero(at < self.context.n)
        known = known[self.context.get(at[known]) == context[known]]
        c = at[known]
        base = self.base.get(c)
        target = base + word[known]
        inside = target < self.base.get(c + 1)  # else beyond the context's last successor
        known, c, target = known[inside], c[inside], target[inside]
        at = self.word.successor(target)
        same = (at >= self.ptr.get(c)) & (at < self.ptr.get(c + 1)) & (self.word.get(np.minimum(at, self.word.n - 1)) == target)
        out[known[same]] = self.code[at[same]]
        return out


# Parts ----------------------------------------------------------------------------------------------------


def distinct(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values below ``bound`` and the place of each value among them; by one plain sort where 63 bits suffice."""
    bits = max(1, (len(values) - 1).bit_length())
    if not len(values) or (bound - 1).bit_length() + bits > 63:
        return np.unique(values, return_inverse=True)
    packed = np.sort(values << bits | np.arange(len(values)))
    ordered = packed >> bits
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    at = np.empty(len(values), np.int64)
    at[packed & ((1 << bits) - 1)] = np.cumsum(new) - 1
    return ordered[new], at


READ = pa.schema([("part", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary())])
READ_DDL = "part long, doc_id array<long>, train array<boolean>, sizes binary, tokens binary, words binary"


class Reader:
    """Collects documents of a part; words are numbered as they come."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.number[START_WORD], self.number[END_WORD]
        self.docs, self.doc_id, self.train, self.bytes = [], [], [], 0

    def add(self, doc_id: int | None, train: bool, text: bytes) -> None:
        words = text.translate(LOWER).split()
        codes = np.empty(len(words) + 1, np.uint32)
        codes[:-1] = np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words))
        codes[-1] = 1
        self.docs.append(codes)
        self.doc_id.append(doc_id)
        self.train.append(train)
        self.bytes += len(text) + 1

    def row(self, part: int) -> pa.RecordBatch:
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, self.number), np.uint64, len(self.number))
        cells = [part, self.doc_id, self.train, pack(np.array([len(x) for x in self.docs])), pack(np.concatenate(self.docs)), words.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(cells, READ, strict=True)], schema=READ)


def _read(part_bytes: int):
    def run(batches):
        split, n, part = TaskContext.get().partitionId(), 0, Reader()
        for batch in batches:
            for doc_id, train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                part.add(doc_id, train, text.as_py())
                if part.bytes >= part_bytes:
                    yield part.row(split << 32 | n)
                    n, part = n + 1, Reader()
        if part.docs:
            yield part.row(split << 32 | n)

    return run


class Part:
    """A part as ``Reader`` left it.  Words 0 and 1 are the start, which is no token, and the end."""

    def __init__(self, row: pa.Table):
        cell = {k: row.column(k)[0].as_py() for k in ("part", "doc_id", "train", "sizes", "tokens", "words")}
        self.part, self.doc_id, self.train = cell["part"], cell["doc_id"], np.array(cell["train"], bool)
        self.sizes, self.tokens = unpack(cell["sizes"]).astype(np.int64), unpack(cell["tokens"]).astype(np.int64)
        self.words = np.frombuffer(cell["words"], np.uint64)
        self.learn = np.repeat(self.train, self.sizes)

    def word_counts(self) -> np.ndarray:
        """Occurrences of each word in training documents; documents begin with the start."""
        out = np.bincount(self.tokens[self.learn], minlength=len(self.words))
        out[0] = int(self.train.sum())
        return out

    def pairs(self, ids: np.ndarray, counts: np.ndarray, n_ranges: int) -> dict[str, np.ndarray]:
        """The distinct pairs by range, context and word, given the corpus' numbers and counts of the part's words.

        ``context``, ``word``: corpus numbers; ``total``: the context's count; ``at``: each token's pair; ``ends``: where ranges end.
        """
        by_id = np.argsort(ids)
        rank = np.empty_like(by_id)
        rank[by_id] = np.arange(len(by_id))
        word = rank[self.tokens]
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[np.cumsum(self.sizes) - self.sizes] = rank[0]
        n = len(ids)
        pairs, at = distinct(context * n + word, n * n)
        context, word = by_id[pairs // n], by_id[pairs % n]
        total, c, w = counts[context], ids[context], ids[word]
        owner = range_of_pair(c, w, total, n_ranges)
        order = np.argsort(owner.astype(np.uint16) if n_ranges < 1 << 16 else owner, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return {"context": c[order], "word": w[order], "total": total[order], "at": place[at], "range": owner[order], "local": np.stack([context[order], word[order]])}


def range_of_pair(context: np.ndarray, word: np.ndarray, total: np.ndarray, n_ranges: int) -> np.ndarray:
    """A context's pairs share a range; those of a context seen over PIECE times are spread by their words."""
    u = np.uint64
    with np.errstate(over="ignore"):
        piece = (word % (1 + total // PIECE)).astype(np.uint64)
        x = (context.astype(np.uint64) + u(1)) * u(0x9E3779B97F4A7C15) + piece * u(0xD6E8FEB86659FD93)
        x ^= x >> u(32)
        x *= u(0xD6E8FEB86659FD93)
        return ((x >> u(32)) * u(n_ranges) >> u(32)).astype(np.int64)


def _slices(owner: np.ndarray) -> list[tuple[int, int, int]]:
    """(owner, from, to) of the runs of equal owners."""
    at = np.r_[0, np.flatnonzero(owner[1:] != owner[:-1]) + 1, len(owner)].tolist()
    return [(int(owner[a]), a, b) for a, b in zip(at[:-1], at[1:], strict=True) if b > a]


def _word_ranges(part: Part, n_ranges: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    order = np.argsort(part.words)
    owner = ((part.words[order] >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
    return order, _slices(owner)


ASK_WORDS = pa.schema([("part", pa.int64()), ("range", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])
ASK_WORDS_DDL = "part long, range int, words binary, counts binary"
TOLD_WORDS_DDL = "part long, range int, ids binary, counts binary, n_words long, n_distinct long"


def _ask_words(n_ranges: int):
    def run(row: pa.Table) -> pa.Table:
        p = Part(row)
        order, slices = _word_ranges(p, n_ranges)
        words, counts = p.words[order], p.word_counts()[order]
        rows = [(p.part, r, pack(gaps(words[a:b])), pack(counts[a:b])) for r, a, b in slices]
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ASK_WORDS, strict=True)], schema=ASK_WORDS)

    return run


def _tell_words(n_ranges: int):
    def run(asked: pa.Table) -> pa.Table:
        """Number the words of a range and add up their counts; one of the rows has the range's totals too."""
        r = asked.column("range")[0].as_py()
        words = [np.cumsum(unpack(x)) for x in asked.column("words").to_pylist()]
        known, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack(x) for x in asked.column("counts").to_pylist()]), len(known)).astype(np.int64)
        ends = np.cumsum([len(x) for x in words])
        places = [at[e - len(x) : e] for x, e in zip(words, ends, strict=True)]
        real = (known != np.uint64(xxhash.xxh3_64_intdigest(START_WORD))) & (total > 0)
        first = np.arange(len(words)) == 0
        return pa.table({
            "part": asked.column("part"), "range": asked.column("range"), "ids": pa.array([pack(gaps(p)) for p in places], pa.binary()), "counts": pa.array([pack(total[p]) for p in places], pa.binary()),
            "n_words": first * total[real].sum(), "n_distinct": first * real.sum(),
        })

    return run


def _totals(told: pa.Table) -> pa.Table:
    return pa.table({k: pa.array([sum(told.column(k).to_pylist())], pa.int64()) for k in ("n_words", "n_distinct")})


def _told_words(part: Part, told: list[dict], n_ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of a part's words, from the ranges' answers: a range numbers every ``n_ranges``-th."""
    order, slices = _word_ranges(part, n_ranges)
    ids, counts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    for (r, a, b), row in zip(slices, sorted(told, key=lambda x: x["range"]), strict=True):
        ids[order[a:b]] = np.cumsum(unpack(row["ids"])).astype(np.int64) * n_ranges + r
        counts[order[a:b]] = unpack(row["counts"])
    return ids, counts


ASK_PAIRS = pa.schema([("part", pa.int64()), ("range", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary()), ("totals", pa.binary()), ("ids", pa.binary()), ("word_counts", pa.binary())])
ASK_PAIRS_DDL = "part long, range int, pairs binary, counts binary, totals binary, ids binary, word_counts binary"
TOLD_PAIRS_DDL = "part long, range int, codes binary, ids binary, word_counts binary, n_words long, n_distinct long"


def _ask_pairs(n_word_ranges: int, n_ranges: int):
    """Questions of a part; the first row also carries what the words' ranges told, for ``_score``."""

    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        p = Part(row)
        ids, counts = _told_words(p, told.to_pylist(), n_word_ranges)
        q = p.pairs(ids, counts, n_ranges)
        own = np.bincount(q["at"][p.learn], minlength=len(q["context"]))
        rows = [(p.part, r, pack_pairs(q["context"][a:b], q["word"][a:b]), pack(own[a:b]), pack(q["total"][a:b]), None, None) for r, a, b in _slices(q["range"])]
        rows[0] = (*rows[0][:5], pack(ids), pack(counts))
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ASK_PAIRS, strict=True)], schema=ASK_PAIRS)

    return run


def build_levels(context: np.ndarray, word: np.ndarray, counts: np.ndarray, totals: np.ndarray, values: np.ndarray, prior: float) -> dict[str, np.ndarray]:
    """The trie levels of pairs, which may repeat, with training counts and the contexts' counts."""
    seen = counts > 0
    context, word, counts, totals = context[seen], word[seen], counts[seen], totals[seen]
    contexts, c = np.unique(context, return_inverse=True)
    bound = int(word.max()) + 1 if len(word) else 1
    pairs, first, at = np.unique(c * bound + word, return_index=True, return_inverse=True)
    total = np.bincount(at, counts, len(pairs))
    logs = np.log10(total / (totals[first] + prior))
    return Trie.levels(contexts[pairs // bound], pairs % bound, quantise(logs, values))


def _tell_pairs(prior: float):
    def run(asked: pa.Table) -> pa.Table:
        """Build the trie of a range from the counts of all parts and answer all questions from it."""
        pairs = [unpack_pairs(x) for x in asked.column("pairs").to_pylist()]
        flat = lambda name: np.concatenate([unpack(x) for x in asked.column(name).to_pylist()]).astype(np.int64)
        values = codebook(asked.column("n_words")[0].as_py(), prior)
        trie = Trie(build_levels(np.concatenate([c for c, _ in pairs]), np.concatenate([w for _, w in pairs]), flat("counts"), flat("totals"), values, prior))
        codes = [pack(np.concatenate([trie.lookup(c[a : a + (1 << 17)], w[a : a + (1 << 17)]) for a in range(0, len(c), 1 << 17)])) for c, w in pairs]
        keep = ("part", "range", "ids", "word_counts", "n_words", "n_distinct")
        return asked.select(keep).add_column(2, "codes", pa.array(codes, pa.binary()))

    return run


SCORE_DDL = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORE = pa.schema([(x.split()[0], pa.int64() if "long" in x else pa.float64()) for x in SCORE_DDL.split(", ")])


def _score(n_ranges: int, prior: float):
    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        if not row.num_rows:
            return SCORE.empty_table()
        p, told = Part(row), told.sort_by("range").to_pylist()
        ids, counts = next((unpack(x["ids"]).astype(np.int64), unpack(x["word_counts"]).astype(np.int64)) for x in told if x["ids"] is not None)
        q = p.pairs(ids, counts, n_ranges)
        codes = np.concatenate([unpack(x["codes"]) for x in told]).astype(np.int64)
        total, n_distinct = told[0]["n_words"], told[0]["n_distinct"]
        known = counts.copy()
        known[0] = 0  # the start is no token
        uni = (known + 0.5) / (total + 0.5 * (n_distinct + 1))
        c, w = q["local"]
        share = 10.0 ** codebook(total, prior)
        of_pair = np.log10(share[codes] + prior / (counts[c] + prior) * uni[w])
        doc = np.repeat(np.arange(len(p.sizes)), p.sizes)
        add = lambda x: np.bincount(doc, x, len(p.sizes))
        columns = [
            p.doc_id, p.sizes, add(known[p.tokens] > 0).astype(np.int64), np.full(len(p.sizes), total, np.int64),
            add(np.log10(uni)[p.tokens]), add(of_pair[q["at"]]),
        ]
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(columns, SCORE, strict=True)], schema=SCORE)

    return run


def lm_scores(docs: DataFrame, held_out_remainder_is: int | None = HELD_OUT, prior: float = PRIOR, part_bytes: int = PART_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Words of lower-cased text (A-Z) and one end make a document's tokens; null and empty texts have the end alone.  Rows whose
    crc32 of the id modulo 5 is ``held_out_remainder_is`` teach nothing (None: all rows teach); rows without an id teach.
    A pair's probability is its discounted share of its context, n / (n_context + prior), from the trie, plus what is left,
    prior / (n_context + prior), times the unigram model (add one half); unseen pairs have that alone.  Repeated rows
    are counted and scored each; texts of the same words get equal scores.  An empty table gives no rows.  Other columns
    are ignored.  ``docs`` must give the same rows in the same splits when read again, as tables do; write other results first.
    """
    train = F.coalesce(held_out_remainder(F.col("doc_id")) != held_out_remainder_is, F.lit(True)) if held_out_remainder_is is not None else F.lit(True)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_words, n_pairs = max(1, -(-size // (range_bytes * WORD_RANGE_BYTES // RANGE_BYTES))), max(1, -(-size // range_bytes))
    n_parts = 2 * max(1, -(-size // part_bytes))
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), text.alias("text")).mapInArrow(_read(part_bytes), READ_DDL)
    # Tasks grow in number with the text, so that each has a few parts or ranges.
    parts = parts.repartition(n_parts, "part")
    told = parts.groupBy("part").applyInArrow(_ask_words(n_words), ASK_WORDS_DDL).repartition(-(-n_words // RANGES_PER_TASK), "range").groupBy("range").applyInArrow(_tell_words(n_words), TOLD_WORDS_DDL)
    told = told.repartition(n_parts, "part")
    totals = told.groupBy("part").applyInArrow(_totals, "n_words long, n_distinct long").agg(F.sum("n_words").alias("n_words"), F.sum("n_distinct").alias("n_distinct"))
    asked = parts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_ask_pairs(n_words, n_pairs), ASK_PAIRS_DDL)
    asked = asked.withColumn("one", F.lit(1)).join(F.broadcast(totals.withColumn("one", F.lit(1))), "one").drop("one")  # one row
    answers = asked.repartition(-(-n_pairs // RANGES_PER_TASK), "range").groupBy("range").applyInArrow(_tell_pairs(prior), TOLD_PAIRS_DDL)
    return parts.groupBy("part").cogroup(answers.repartition(n_parts, "part").groupBy("part")).applyInArrow(_score(n_pairs, prior), SCORE_DDL)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores(table(spark, sf_dir, "documents"))
    held = F.coalesce(held_out_remainder(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
