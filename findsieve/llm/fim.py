"""Fill-in-the-middle texts by displacement scatter.

The bytes of many documents lie one after the other.  Scanning their line ends gives the two cuts of every document; a difference
array holds, at the byte where a prefix, middle or suffix begins, by how much the shift of its bytes differs from that of
the bytes before.  Its cumulative sum is every byte's place in the output, where one scatter puts them all; reading the
same places back (a gather) restores the texts.  Sums run over windows of bounded size, so a text may be of any length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Marks of prefix, suffix and middle, the salt of the draws, share of texts that are transformed, of these in the order spm.
PRE, SUF, MID = b"<P>", b"<S>", b"<M>"
SALT, TRANSFORMED, SPM = "7:", 100, 50
#: Bytes of text that are moved together; a longer text is moved by itself.
GROUP_BYTES = 1 << 22
#: Bytes whose places are worked out at a time.
WINDOW = 1 << 20


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """h1 to h4: the first four groups of eight digits of the salted id's SHA-256."""
    digits = hashlib.sha256(f"{SALT}{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digits[4 * i : 4 * i + 4], "big") for i in range(4))


def _places(starts: np.ndarray, places: np.ndarray, size: int):
    """(from, to, place of every byte between them) for segments that begin at ``starts`` (ascending, gapless) and go to ``places``."""
    shift = places - starts
    change = np.diff(shift, prepend=0)
    at, carried = 0, 0
    while at < size:
        to = min(size, at + WINDOW)
        first, last = np.searchsorted(starts, [at, to])
        moved = np.zeros(to - at, np.int64)
        np.add.at(moved, starts[first:last] - at, change[first:last])
        np.cumsum(moved, out=moved)
        moved += carried
        carried = moved[-1]
        moved += np.arange(at, to)
        yield at, to, moved
        at = to


def scatter(source: np.ndarray, starts: np.ndarray, places: np.ndarray, out: np.ndarray) -> None:
    """Put the bytes of ``source`` at their places in ``out``."""
    for at, to, moved in _places(starts, places, len(source)):
        out[moved] = source[at:to]


def gather(out: np.ndarray, starts: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The bytes that ``scatter`` put there, in their first order."""
    source = np.empty(size, np.uint8)
    for at, to, moved in _places(starts, places, size):
        source[at:to] = out[moved]
    return source


def _marked(data: np.ndarray) -> np.ndarray:
    """Where one of the three marks begins."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    maybe = np.flatnonzero(data[:-2] == PRE[0])
    maybe = maybe[data[maybe + 2] == PRE[2]]
    return maybe[np.isin(data[maybe + 1], (PRE[1], SUF[1], MID[1]))]


class Transformed:
    """Outputs of some texts: ``out`` with ``offsets`` of the documents, ``form`` (0 plain, 1 psm, 2 spm), ``n``, ``prefix_chars`` and ``middle_chars``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: list[int | None]):
        docs, size = len(ids), np.diff(offsets)
        # Cuts: a line ends after each line feed and at the end of a text that has none there.
        ends = np.flatnonzero(data == 10) + 1
        before = np.searchsorted(ends, offsets, side="right")  # line ends up to a document's start; one at its start is of the text before
        open_ = (size > 0) & (data[np.maximum(offsets[1:], 1) - 1] != 10) if len(data) else np.zeros(docs, bool)
        self.n = np.diff(before) + open_
        h = np.array([draws(x) for x in ids], np.int64).reshape(docs, 4)
        a, b = h[:, 0] % (self.n + 1), h[:, 1] % (self.n + 1)
        cut = lambda k: np.where(k == 0, offsets[:-1], np.where(k == self.n, offsets[1:], ends[np.minimum(before[:-1] + k - 1, max(len(ends) - 1, 0))] if len(ends) else offsets[1:]))
        self.cut1, self.cut2 = cut(np.minimum(a, b)), cut(np.maximum(a, b))
        whole = size == 0
        marks = _marked(data)
        owner = np.searchsorted(offsets, marks, side="right") - 1
        whole[owner[marks + 3 <= offsets[owner + 1]]] = True
        whole |= h[:, 2] % 100 >= TRANSFORMED
        self.form = np.where(whole, 0, np.where(h[:, 3] % 100 < SPM, 2, 1))
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.prefix_chars, self.middle_chars = chars[self.cut1] - chars[offsets[:-1]], chars[self.cut2] - chars[self.cut1]
        self._move(data, offsets)

    def _move(self, data: np.ndarray, offsets: np.ndarray) -> None:
        start, end, spm, plain = offsets[:-1], offsets[1:], self.form == 2, self.form == 0
        prefix, middle, suffix = self.cut1 - start, self.cut2 - self.cut1, end - self.cut2
        self.offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) + np.where(plain, 0, 9))])
        base = self.offsets[:-1]
        first = base + np.where(plain, 0, np.where(spm, 6 + suffix, 3))  # where the prefix goes
        second = np.where(plain, base + prefix, np.where(spm, base + 9 + suffix + prefix, base + 9 + prefix + suffix))
        third = np.where(plain, base + prefix + middle, np.where(spm, base + 3, base + 6 + prefix))
        starts = np.stack([start, self.cut1, self.cut2], 1).ravel()
        places = np.stack([first, second, third], 1).ravel()
        some = np.stack([prefix, middle, suffix], 1).ravel() > 0
        self.out = np.empty(int(self.offsets[-1]), np.uint8)
        scatter(data, starts[some], places[some], self.out)
        for mark, at in ((PRE, first - 3), (SUF, third - 3), (MID, second - 3)):
            for i, x in enumerate(mark):
                self.out[at[~plain] + i] = x

    def document(self, i: int) -> memoryview:
        return memoryview(self.out)[self.offsets[i] : self.offsets[i + 1]]


def restore(out: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts (bytes and offsets) from outputs and forms alone: the marks in an output tell its parts' places."""
    plain, spm = form == 0, form == 2
    marks = _marked(out)
    owner = np.searchsorted(offsets, marks, side="right") - 1
    mine = (marks + 3 <= offsets[owner + 1]) & ~plain[owner]
    marks, owner = marks[mine], owner[mine]
    at = {}
    for mark in (PRE, SUF, MID):
        places = np.zeros(len(form), np.int64)
        these = out[marks + 1] == mark[1]
        places[owner[these]] = marks[these]
        at[mark] = places
    begin, end = offsets[:-1], offsets[1:]
    first = np.where(plain, begin, at[PRE] + 3)
    second = np.where(plain, end, at[MID] + 3)
    third = np.where(plain, end, at[SUF] + 3)
    lengths = np.stack([
        np.where(plain, end, np.where(spm, at[MID], at[SUF])) - first, end - second, np.where(plain, end, np.where(spm, at[PRE], at[MID])) - third,
    ], 1)
    size = lengths.sum(1)
    text_offsets = np.concatenate([[0], np.cumsum(size)])
    starts = (text_offsets[:-1, None] + np.concatenate([np.zeros((len(form), 1), np.int64), np.cumsum(lengths, 1)[:, :2]], 1)).ravel()
    some = lengths.ravel() > 0
    return gather(out, starts[some], np.stack([first, second, third], 1).ravel()[some], int(text_offsets[-1])), text_offsets


FORMS = ("plain", "psm", "spm")


def groups(column) -> list[tuple[int, int]]:
    """Ranges of rows whose texts together have at most ``GROUP_BYTES`` bytes; a longer text is a range by itself."""
    out, first, held = [], 0, 0
    for i, cell in enumerate(column):
        size = cell.as_buffer().size if cell.is_valid else 0
        if held and held + size > GROUP_BYTES:
            out.append((first, i))
            first, held = i, 0
        held += size
    return [*out, (first, len(column))] if len(column) else out


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes and offsets; nulls are empty."""
    column = column.fill_null(b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int32 if pa.types.is_binary(column.type) else np.int64, len(column) + 1, column.offset * (4 if pa.types.is_binary(column.type) else 8)).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _each(emit, names: list[str], types: list[pa.DataType]):
    def run(batches):
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            for first, last in groups(column):
                data, offsets = bytes_of(column.slice(first, last - first))
                arrays = emit(Transformed(data, offsets, ids[first:last]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *(pa.array(x, t) for x, t in zip(arrays, types, strict=True))], ["doc_id", *names])

    return run


def _facts(t: Transformed) -> list:
    hidden = t.form == 0
    return [t.n, [FORMS[f] for f in t.form], np.ma.masked_array(t.prefix_chars, hidden).tolist(), np.ma.masked_array(t.middle_chars, hidden).tolist()]


def _texts(t: Transformed) -> list:
    return [*_facts(t), [str(t.document(i), "utf-8") for i in range(len(t.form))]]


def _digests(t: Transformed) -> list:
    back, offsets = restore(t.out, t.offsets, t.form)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return [*_facts(t), [sha(t.document(i)) for i in range(len(t.form))], [sha(memoryview(back)[offsets[i] : offsets[i + 1]]) for i in range(len(t.form))]]


_FACTS, _FACT_TYPES = ["n", "form", "prefix_chars", "middle_chars"], [pa.int64(), pa.string(), pa.int64(), pa.int64()]
_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def transform(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n lines, form (plain, psm or spm), prefix_chars, middle_chars and ``output``.

    Null texts count as empty, and empty texts stay plain, as do texts that hold a mark; plain rows have null counts of characters.
    A null doc_id draws as one of the text ``null``.  Repeated rows each get a row; an empty table gives none.  Other columns are ignored.
    """
    return _rows(docs).mapInArrow(_each(_texts, [*_FACTS, "output"], [*_FACT_TYPES, pa.string()]), f"{_DDL}, output string")


def _restored(batches):
    for batch in batches:
        for first, last in groups(batch.column(2)):
            data, offsets = bytes_of(batch.column(2).slice(first, last - first))
            form = np.array([FORMS.index(f) for f in batch.column(1).slice(first, last - first).to_pylist()], np.int64)
            back, at = restore(data, offsets, form)
            texts = [str(memoryview(back)[at[i] : at[i + 1]], "utf-8") for i in range(len(form))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(texts, pa.string())], ["doc_id", "text"])


def restore_texts(transformed: DataFrame) -> DataFrame:
    """doc_id and text of rows as ``transform`` gives them, from ``form`` and ``output`` alone."""
    return transformed.select("doc_id", "form", F.col("output").cast("binary").alias("output")).mapInArrow(_restored, "doc_id long, text string")


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _each(_digests, [*_FACTS, "output_sha256", "restored_sha256"], [*_FACT_TYPES, pa.string(), pa.string()])
    return _rows(table(spark, sf_dir, "documents")).mapInArrow(run, f"{_DDL}, output_sha256 string, restored_sha256 string")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
