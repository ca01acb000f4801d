"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Every pattern takes time in proportion to the text, also on long runs of digits.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, table

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS

# Patterns, starting scores and context words.
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SCORE = {"email": 0.7, "ip": 0.6, "card": 0.4, "phone": 0.5, "iban": 0.4, "ssn": 0.4}
CHECKED = ("card", "iban")
CONTEXT = {
    "email": ("mail", "contact"),
    "ip": ("ip", "server", "host", "login"),
    "card": ("card", "visa", "mastercard", "payment"),
    "phone": ("phone", "call", "tel", "fax", "mobile"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social security", "taxpayer"),
}
#: Words that speak for a number of another kind.
AGAINST = ("serial", "part no", "part number", "order", "invoice", "sku", "version", "ticket")
CONTEXT_CHARS, CONTEXT_BONUS, CHECK_BONUS = 40, 0.2, 0.3
_CONTEXT = {kind: re.compile(rf"\b(?:{'|'.join(words)})") for kind, words in CONTEXT.items()}
_AGAINST = re.compile(rf"\b(?:{'|'.join(AGAINST)})\b")
#: Added spans below this score are dropped; base spans always stay.
LEAST_SCORE = 0.55


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an account number without spaces."""
    moved = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    end = 0
    for m in EMAIL_DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def _ips(text: str):
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def _cards(text: str):
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def _ibans(text: str):
    for m in IBAN.finditer(text):
        if mod97(m.group().replace(" ", "")):
            yield m.span()


def _ssns(text: str):
    for m in SSN.finditer(text):
        if m.group()[:3] not in ("000", "666") and m.group()[0] != "9":
            yield m.span()


_FIND = dict(zip(KINDS, (_emails, _ips, _cards, _phones, _ibans, _ssns), strict=True))
_DIGIT = re.compile(r"[0-9]")


def score_span(text: str, kind: str, start: int, end: int) -> float:
    """The kind's starting score, more for a checksum that fits and for its own words nearby, less for words against it."""
    near = (text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()
    score = SCORE[kind] + CHECK_BONUS * (kind in CHECKED) + CONTEXT_BONUS * (_CONTEXT[kind].search(near) is not None)
    return round(min(1.0, score - CONTEXT_BONUS * (_AGAINST.search(near) is not None)), 2)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; code points, end exclusive.  Null counts as empty."""
    if not text:
        return []
    found = []
    digits = _DIGIT.search(text) is not None  # all kinds but emails have some
    for kind in KINDS:
        if "@" not in text if kind == "email" else not digits:
            continue
        for start, end in _FIND[kind](text):
            score = score_span(text, kind, start, end)
            if kind in BASE_KINDS or score >= LEAST_SCORE:
                found.append((kind, start, end, score))
    return found


def redact(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """``text`` with every span replaced by its kind in square brackets; of overlapping spans the first names all."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _find(keep: int, with_text: bool):
    """Arrow batches whose last column is the text: the first ``keep`` columns pass through."""

    def run(batches):
        for batch in batches:
            spans, texts = [], []
            for cell in batch.column(keep):
                text = cell.as_py()
                found = find_spans(text)
                spans.append([{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in found])
                if with_text:
                    texts.append(redact(text, found))
            arrays = [*batch.columns[:keep], pa.array(spans, SPAN_TYPE), *([pa.array(texts, pa.string())] if with_text else [])]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:keep], "spans", *(["text"] if with_text else [])])

    return run


SPANS_DDL = "array<struct<kind:string,start:int,end:int,score:double>>"


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end, score) of every row.

    Null and empty texts have none; repeated rows each get a row; an empty table gives none.  Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_find(1, False), f"doc_id long, spans {SPANS_DDL}")


def redact_documents(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, personal data in ``text`` replaced by its kind and ``n_chars``, if there, counted anew.

    Every row stays, null texts too.  Columns may have any names.
    """
    others = [c for c in docs.columns if c != "text"]
    given = {c: f"c{i}" for i, c in enumerate(others)} | {"text": "text"}  # Spark's Arrow functions don't take every name
    plain = docs.select(*[named(c).alias(k) for c, k in given.items() if c != "text"], F.col("text").cast("string").alias("text"))
    found = T.StructField("spans", T._parse_datatype_string(SPANS_DDL))
    out = plain.mapInArrow(_find(len(others), True), T.StructType([*plain.schema.fields[:-1], found, plain.schema["text"]]))
    if "n_chars" in others:
        n = given["n_chars"]
        out = out.withColumn(n, F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return out.select(*[F.col(given[c]).alias(c) for c in docs.columns])


def _digest(batches):
    for batch in batches:
        rows = []
        for found in batch.column(1).to_pylist():
            spans = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in found]
            base = ",".join(x for k, x in spans if k in BASE_KINDS)
            scores = ",".join(f"{s['score']:.2f}" for s in found)
            rows.append((*(sum(k == b for k, _ in spans) for b in BASE_KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in spans), scores))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        types = [pa.int64()] * 4 + [pa.string()] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
            ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "scores"],
        )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    return found.mapInArrow(_digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")
