"""Best-fit packing of token sequences by minimum bin slack.

Texts become pieces of at most ``capacity`` tokens.  Only the histogram of piece lengths (at most ``capacity`` numbers)
reaches the driver.  There every bin is filled by a subset-sum dynamic programme over the lengths still to be had,
kept in the bits of an integer; the fullest combination is taken out as often as the counts allow.  The pieces then find
their place by their rank among the pieces of their length, which two small windows give without moving all pieces of
one length to one task.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, with_base

CAPACITY = 2048
SEPARATOR = 0
VOCABULARY = "byte_bpe_50k.json"
#: Words of at most so many characters whose token ids a worker keeps; a full cache takes some 40 MB.
CACHED_WORDS, CACHED_LENGTH = 150_000, 24
#: Ranks are counted in groups of about so many pieces of one length.
RANK_GROUP = 512
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _WordIds(dict):
    """Token ids, as little-endian bytes, of a space and the word that follows it; ``added``: those of added tokens."""

    def __init__(self, encode_ids, added: dict[str, int]):
        super().__init__()
        self.encode_ids = encode_ids
        self.added = {k: np.array([i], "<u4").tobytes() for k, i in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def encode(self, text: str) -> bytes:
        return np.array(self.encode_ids(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self.encode(" " + word)
        if len(word) <= CACHED_LENGTH:
            self[word] = found
        return found


_caches: dict[str, _WordIds] = {}


def byte_values() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def word_ids(vocabulary: str) -> _WordIds:
    """The cache of this worker process; ``vocabulary`` is a file name of the public tokenizers or a path.

    The file is read by ``tokenizers``.  Its tokens are in the order of their merges, so ``tiktoken`` gives the same ids
    from the same vocabulary and is several times faster for single words; the tests hold the two against each other.
    Strings of added tokens are left to ``encode_document``.  Added tokens must be plain: taken as they stand, wherever.
    """
    if vocabulary not in _caches:
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary))
        values = byte_values()
        ranks = {bytes(values[c] for c in token): i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in values for c in token)}
        added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"added tokens of {vocabulary} take in or need what stands around them")
        ranks = {k: v for k, v in ranks.items() if k.decode("utf-8", "replace") not in added}
        encoding = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _caches[vocabulary] = _WordIds(encoding.encode_ordinary, added)
    return _caches[vocabulary]


#: A space before other white space, where the text must not be cut.
_WIDE_SPACE = re.compile(r" \s")


def encode_text(text: str, ids: _WordIds) -> bytes:
    """Token ids of ``text``, a stretch without added tokens, as little-endian 32-bit integers.

    The tokenizer never joins characters across a space that a non-space follows, so texts are cut there and each part
    is looked up with its space.  A part that starts with other white space stays with the one before it.
    """
    parts = text.split(" ")
    first = parts[0]
    if _WIDE_SPACE.search(text):
        merged = []
        for p in parts[1:]:
            if p and not p[0].isspace():
                merged.append(p)
            elif merged:
                merged[-1] += " " + p
            else:
                first += " " + p
        parts = [first, *merged]
    return (ids.encode(first) if first else b"") + b"".join(map(ids.__getitem__, parts[1:]))


def encode_document(text: str, ids: _WordIds) -> bytes:
    """Token ids of ``text`` as the tokenizer gives them: added tokens in it are single ids, the stretches between are encoded alone."""
    if not ids.split or not ids.split.search(text):
        return encode_text(text, ids)
    return b"".join(ids.added[x] if x in ids.added else encode_text(x, ids) for x in ids.split.split(text) if x)


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: all are full but the first."""
    rest = n % capacity or capacity
    return [rest] + [capacity] * ((n - rest) // capacity)


def _cut_pieces(vocabulary: str, capacity: int, separator: int, with_ids: bool):
    end = np.array([separator], "<u4").tobytes()

    def run(batches):
        ids = word_ids(vocabulary)
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encode_document(text.as_py() or "", ids) + end
                at = 0
                for piece, length in enumerate(piece_lengths(len(data) // 4, capacity)):
                    part = data[4 * at : 4 * (at + length)]
                    rows.append((doc_id, piece, at, length, zlib.crc32(part), part) if with_ids else (doc_id, piece, at, length, zlib.crc32(part)))
                    at += length
                held += len(data)
                if held > 1 << 25:
                    yield _batch(rows, with_ids)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, with_ids)

    return run


def _batch(rows: list, with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    arrays = [pa.array(c, t) for c, t in zip(cols[:5], types, strict=True)]
    if with_ids:
        data = b"".join(cols[5])
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in cols[5]])]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(data, "<u4").astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)


def cut_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document."""
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cut_pieces(vocabulary, capacity, separator, with_ids), schema)


def fullest_bin(counts: dict[int, int], order: list[int], capacity: int) -> dict[int, int]:
    """The fullest feasible combination that holds the longest length left: {length: how many}.

    ``order``: the lengths left, longest first.  Bit s of ``reach`` is set if a subset of the lengths seen so far sums
    to s; a length that may be used k times is added in powers of two.  The walk back over the stages finds the subset.
    """
    first = order[0]
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, stages = 1, []
    at = bisect_right([-x for x in order], -(room + 1)) if room else len(order)
    for length in order[at:] if room else []:
        most = min(counts[length] - (length == first), room // length)
        step = 1
        while most > 0:
            take = min(step, most)
            new = (reach | reach << (length * take)) & mask
            if new != reach:
                stages.append((length, take, reach))
                reach = new
            most -= take
            step *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used = {first: 1}
    for length, take, before in reversed(stages):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: how many in one bin}) for every kind of bin, so that all pieces have a place.

    A kind is used until one of its lengths has too few pieces left, which leaves less than half of them; so there are
    at most about log2(2 * capacity / length) kinds a length, some 7000 for 2048 tokens, however many the pieces.
    """
    counts = {k: v for k, v in histogram.items() if v > 0}
    order = sorted(counts, reverse=True)
    bins = []
    while order:
        used = fullest_bin(counts, order, capacity)
        times = min(counts[k] // v for k, v in used.items())
        bins.append((times, used))
        for k, v in used.items():
            counts[k] -= times * v
            if not counts[k]:
                del counts[k]
        order = [k for k in order if k in counts]
    return bins


def place_ranges(bins: list[tuple[int, dict[int, int]]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length: (first rank, first sequence, how many in a bin, offset of the first), by rank."""
    ranges, taken, sequence = {}, {}, 0
    for times, used in bins:
        offset = 0
        for length in sorted(used, reverse=True):
            k = used[length]
            rank = taken.get(length, 0)
            ranges.setdefault(length, []).append((rank, sequence, k, offset))
            taken[length] = rank + times * k
            offset += k * length
        sequence += times
    return ranges


def _place(ranges: dict[int, list[tuple[int, int, int, int]]], names: list[str]):
    tables = {k: np.array(v, np.int64) for k, v in ranges.items()}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(names.index(x)).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                t = tables[int(value)]
                row = t[np.searchsorted(t[:, 0], rank[at], "right") - 1]
                inside = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + inside // row[:, 2]
                offset[at] = row[:, 3] + inside % row[:, 2] * value
            keep = [i for i, n in enumerate(names) if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], [*(names[i] for i in keep), "sequence_id", "offset"]
            )

    return run


def rank_in_length(pieces: DataFrame, histogram: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``, from 0 without gaps among the pieces of a length.

    ``histogram``: length and n, at most as many rows as there are lengths.  The pieces of one length are numbered in groups (by
    hash of ``row``, a number of their own, so that equal rows spread too), and a group starts where the one before it ends; the
    more pieces, the more groups.
    """
    groups = F.broadcast(histogram.select("length", F.ceil(F.col("n") / RANK_GROUP).alias("groups")))
    grouped = pieces.join(groups, "length").withColumn("grp", F.pmod(F.xxhash64("row"), F.col("groups")))
    starts = with_base(grouped.groupBy("length", "grp").agg(F.count(F.lit(1)).alias("n")), ["length"])
    inside = Window.partitionBy("length", "grp").orderBy("row")
    numbered = grouped.withColumn("r", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["length", "grp"]).withColumn("rank", F.col("base") + F.col("r")).drop("grp", "groups", "base", "r")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``; see ``cut_pieces``.

    A null or empty text is the separator alone.  Repeated rows are packed each for itself.  Other columns are ignored;
    an empty table gives no rows.  ``with_ids`` adds the token ids of each piece.
    """
    pieces = cut(cut_pieces(docs, vocabulary, capacity, separator, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    # At most ``capacity`` rows reach the driver.
    sizes = cut(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in sizes.where(F.col("length") < capacity).collect()}
    bins = pack_histogram(histogram, capacity)
    ranked = rank_in_length(pieces.where(F.col("length") < capacity), sizes)
    extra = [x for x in ("ids",) if with_ids]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *extra, "rank"]
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    placed = ranked.select(*names[:-1], F.col("rank").cast("long").alias("rank")).mapInArrow(_place(place_ranges(bins), names), schema)
    # Full pieces are sequences by themselves, with numbers after those of the bins.
    number = F.monotonically_increasing_id() + sum(times for times, _ in bins)
    full = pieces.where(F.col("length") == capacity).select(*names[:-1], number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, from the result of ``pack(..., with_ids=True)``; at most ``capacity`` ids a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
