"""Nearest neighbours by a block matrix join with int8 tiles and exact recomputation.

Vectors are quantised once.  Queries and candidates are dealt into blocks of int8 codes; a task takes one block of each, multiplies the
codes exactly, and bounds the error of every product by the norms of what rounding left over.  Pairs whose upper bound
reaches the k-th best lower bound survive, first in their block, then over all blocks.  Survivors fetch the vectors, are recomputed in
double precision, and the best of each query are taken by bounded heaps in each batch before they meet in the ranking.
Vectors of different lengths have no product: each length is searched by itself.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

K = 20
EVERY = 20
QUERY_BLOCK, CANDIDATE_BLOCK = 16384, 32768
TILE_QUERIES, TILE_CANDIDATES = 256, 8192
#: Components whose products of codes a float32 adds up without rounding: 127 * 127 * 1024 is below 2**24.
EXACT = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part.

    Left out are rows without an id, null, zero or empty vectors, and vectors with null or non-finite components.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of what the codes stand for, norms of what they leave over (rounded up)."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(np.float64).tiny)
    inner = x / scale[:, None]  # in units of the scale, as squares of the vector may be too small for a float
    codes = np.rint(inner).astype(np.int8)
    up, rounded = 1 + 1e-9, 2e-14 * np.sqrt(x.shape[1])
    return codes, scale, scale * np.linalg.norm(codes.astype(np.float64), axis=1) * up, scale * (np.linalg.norm(inner - codes, axis=1) * up + rounded)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two matrices of int8 codes, exact at any width."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT):
        out += a[:, d : d + EXACT].astype(np.float32) @ b[:, d : d + EXACT].astype(np.float32).T
    return out


def survivors(q_id: np.ndarray, q: tuple, c_id: np.ndarray, c: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the candidate, lower bound, upper bound) of the pairs that may be among a query's k nearest.

    ``q`` and ``c`` are what ``quantise`` gives.  A query's own id is no candidate.
    """
    (q8, qs, qn, qr), (c8, cs, cn, cr) = q, c
    rounding = 1e-12 + q8.shape[1] * 2.0**-51  # of the bounds and of the exact scores they are held against
    out = []
    for a in range(0, len(q8), TILE_QUERIES):
        m = slice(a, a + TILE_QUERIES)
        ids = q_id[m]
        floor = np.full(len(ids), -np.inf)  # the k-th best lower bound so far
        best = np.full((len(ids), k), -np.inf)
        kept = []
        for b in range(0, len(c8), TILE_CANDIDATES):
            t = slice(b, b + TILE_CANDIDATES)
            about = products(q8[m], c8[t]) * qs[m, None] * cs[None, t]
            whole = qn[m, None] + qr[m, None]
            slack = qn[m, None] * cr[None, t] + qr[m, None] * (cn + cr)[None, t] + rounding * whole * (cn + cr)[None, t]
            own = ids[:, None] == c_id[None, t]
            low = np.where(own, -np.inf, about - slack)
            best = np.partition(np.concatenate([best, low], axis=1), -k, axis=1)[:, -k:]
            floor = best[:, 0]
            r, i = np.nonzero((about + slack >= floor[:, None]) & ~own)
            kept.append((r, i + b, low[r, i], (about + slack)[r, i]))
        r, i, low, high = (np.concatenate(x) for x in zip(*kept, strict=True))
        last = high >= floor[r]
        out.append((r[last] + a, i[last], low[last], high[last]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


CODES_DDL = "vec_id long, row long, code binary, scale double, norm double, rest double, width int"


def _widths(batch: pa.RecordBatch, column: str):
    """The rows of each length of the lists in ``column``."""
    sizes = pc.list_value_length(batch.column(column))
    for d in pc.unique(sizes).to_pylist():
        yield batch.filter(pc.equal(sizes, d))


def _matrix(part: pa.RecordBatch, column: str) -> np.ndarray:
    return part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _encode(batches):
    for batch in batches:
        for part in _widths(batch, "embedding"):
            x = _matrix(part, "embedding")
            codes, *rest = quantise(x)
            columns = [part.column("vec_id"), part.column("row"), pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, rest), pa.array(np.full(len(x), x.shape[1], np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in CODES_DDL.split(", ")])


def _block(part: pa.Table) -> tuple:
    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.int8).reshape(part.num_rows, -1)
    return codes, *(part.column(x).to_numpy() for x in ("scale", "norm", "rest"))


FOUND_DDL = "query_id long, row long, low double, high double"


def _search(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return pa.table({x.split()[0]: pa.array([], pa.int64() if "long" in x else pa.float64()) for x in FOUND_DDL.split(", ")})
        q_id = queries.column("vec_id").to_numpy()
        a, b, low, high = survivors(q_id, _block(queries), candidates.column("vec_id").to_numpy(), _block(candidates), k)
        return pa.table({"query_id": q_id[a], "row": candidates.column("row").to_numpy()[b], "low": low, "high": high})

    return run


SCORED = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
SCORED_DDL = "query_id long, vec_id long, score double"


def _best(k: int):
    """Columns query_id, asked, vec_id, embedding: exact scores; a heap keeps the k best of each query in a batch."""

    def run(batches):
        for batch in batches:
            for part in _widths(batch, "embedding"):
                scores = np.add.reduce(_matrix(part, "asked") * _matrix(part, "embedding"), axis=1)
                heaps: dict[int, list[tuple[float, int]]] = {}
                for q, score, i in zip(part.column("query_id").to_pylist(), scores.tolist(), part.column("vec_id").to_pylist(), strict=True):
                    heap = heaps.setdefault(q, [])
                    if len(heap) < k:
                        heapq.heappush(heap, (score, -i))
                    elif (score, -i) > heap[0]:
                        heapq.heapreplace(heap, (score, -i))
                rows = [(q, -i, score) for q, heap in heaps.items() for score, i in heap]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), SCORED, strict=True)], schema=SCORED)

    return run


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows by inner product of every row whose id ``every`` divides.

    A query's own id is no candidate.  Ties go to the smaller id; repeated candidate rows each count, of rows that repeat
    a query's id the one with the least vector asks.  Candidates have the query's length; if they are fewer than ``k``, all
    are returned.  Null, zero and broken vectors take no part; an empty table gives no rows.  Other columns are ignored.
    """
    # The rows are numbered by writing them.
    rows = cut(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by("row", F.struct("embedding", "row")).alias("row"))
    coded = rows.select("vec_id", "row", "embedding").mapInArrow(_encode, CODES_DDL)
    # Of equal vectors only k + 1 ids, and k rows of an id, can be among the k nearest of anything, so copies are no burden.
    same = [F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")]
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*same, "vec_id").orderBy("row"))).where(F.col("nth") <= k)
    first = first.withColumn("nth", F.dense_rank().over(Window.partitionBy(*same).orderBy("vec_id"))).where(F.col("nth") <= k + 1).select("row")
    coded = cut(coded.join(first.withColumn("candidate", F.lit(True)), "row", "left").join(queries.select("row", F.lit(True).alias("query")), "row", "left").where("candidate OR query"), "codes")
    n_q = -(-coded.where("query").count() // QUERY_BLOCK) or 1
    n_c = -(-coded.where("candidate").count() // CANDIDATE_BLOCK) or 1
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    columns = ("width", "vec_id", "row", "code", "scale", "norm", "rest")
    asked = coded.where("query").select(part(n_q).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c"), *columns)
    held = coded.where("candidate").select(F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"), part(n_c).alias("c"), *columns)
    found = cut(asked.groupBy("width", "q", "c").cogroup(held.groupBy("width", "q", "c")).applyInArrow(_search(k), FOUND_DDL), "survivors")
    # The k-th best lower bound over all blocks.
    by = Window.partitionBy("query_id").orderBy(F.desc("low"), "row")
    floor = found.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= k).groupBy("query_id").agg(F.min("low").alias("floor"), F.count(F.lit(1)).alias("n"))
    last = found.join(floor, "query_id").where(F.when(F.col("n") < k, F.lit(True)).otherwise(F.col("high") >= F.col("floor")))
    pairs = last.select("query_id", "row").join(rows.select("row", "vec_id", "embedding"), "row")
    asking = queries.select(F.col("vec_id").alias("query_id"), "row").join(rows.select("row", F.col("embedding").alias("asked")), "row").select("query_id", "asked")
    scored = pairs.join(asking, "query_id").select("query_id", "asked", "vec_id", "embedding").mapInArrow(_best(k), SCORED_DDL)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_block_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
