"""N-gram Jaccard self join by a MinHash LSH forest with exact verification.

1. Equal texts are one node.  Its signature is a path in each of ``TREES`` tries: the minima in order, as two numbers that sort as
   the path does, so a prefix is a shift.
2. Matched prefixes are shortened in rounds, the longest first.  The nodes under one prefix are a branch.  In a branch short
   sketches are compared, and of the pairs that can reach the threshold a spanning forest is kept, which joins components.
   A branch whose nodes are in one component has nothing left to find and goes no further; a node stops as soon as that holds in all
   its tries.  Any other node is shortened, however crowded its branches, to the length at which a pair right at the threshold
   is found with the target recall.  So the components are those of the shortest prefixes, and close copies meet before these get crowded.
3. Within a component all pairs are verified on their full shingle sets.  Only counts and forest edges leave the task.

Large buckets and components are dealt by hash into blocks, and a task takes two blocks; so no task holds a whole group
and no row stands for a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, named, table
from .components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 50
TARGET_RECALL = 0.9995
#: Minima by which prefixes exceed the shortest, by round.  Those beyond the shortest take 16 bits each of a path's second number.
EXCESS = (4, 2, 0)
SKETCH = 128
#: Sketches of 128 minima stray by 0.035 from a similarity of 0.8; this is over five times that below it.
SKETCH_SLACK = 0.2
SKETCH_BLOCK, TEXT_BLOCK = 1024, 256
HASH_SEED = 7
WORD = r"[^\x20\x09-\x0D]"


def prefix_length(trees: int = TREES, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """The longest prefix by which ``trees`` tries find a pair at the threshold with the target recall; none need be shorter."""
    depth = 1
    while 1 - (1 - threshold ** (depth + 1)) ** trees >= target:
        depth += 1
    return depth


def node_of(text: Column) -> list[Column]:
    """What names the node of a text, 128 bits of its hash, as ``h1`` and ``h2``; null for a text without words."""
    plain = F.when(text.rlike(WORD), text)
    return [F.when(plain.isNotNull(), F.xxhash64(plain)).alias("h1"), F.when(plain.isNotNull(), F.xxhash64(F.lit(HASH_SEED), plain)).alias("h2")]


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = _WordHash()
_rng = np.random.default_rng(HASH_SEED)
_MIX = [np.uint64(x | 1) for x in _rng.integers(0, 2**63, 16, dtype=np.uint64).tolist()]


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; a shorter text is one shingle, an empty one has none."""
    words = text.split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    with np.errstate(over="ignore"):
        s = h[: n - size + 1] * _MIX[0]
        for i in range(1, size):
            s ^= s >> np.uint64(29)
            s += h[i : n - size + 1 + i] * _MIX[i % 16]
        s *= np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(32)
    return np.unique(s)


class Signer:
    """MinHash signatures of shingle sets: ``trees`` groups of ``depth`` minima of one permutation.

    The range of hashes is cut into as many bins as minima are wanted, and a bin's minimum is that of the shingles in it.
    An empty bin takes the minimum of a linear hash of its own over the whole set.  Either way two sets agree in a bin with the
    probability of their similarity.
    """

    def __init__(self, trees: int, depth: int):
        self.trees, self.depth, k = trees, depth, trees * depth
        rng = np.random.default_rng(HASH_SEED + 1)
        self.bounds = np.array([(i << 64) // k for i in range(k)], np.uint64)
        self.a = (rng.integers(0, 2**32, k, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.b = rng.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32)

    def minima(self, shingle_set: np.ndarray) -> np.ndarray:
        at = np.searchsorted(shingle_set, self.bounds)
        full = np.diff(np.r_[at, len(shingle_set)]) > 0
        low = shingle_set.astype(np.uint32)
        out = np.empty(len(self.a), np.uint32)
        out[full] = low[at[full]]
        empty = np.flatnonzero(~full)
        step = max(1, 32768 // len(low))
        for i in range(0, len(empty), step):
            e = empty[i : i + step]
            held = low[None] * self.a[e, None]
            held += self.b[e, None]
            out[e] = np.minimum.reduce(held, axis=1)
        return out

    def paths(self, minima: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The trees' paths: signed 64-bit names of the shortest prefixes, different for different trees, and what follows."""
        m = minima.reshape(self.trees, self.depth)
        shortest = self.depth - max(EXCESS)
        data, step = m[:, :shortest].tobytes(), 4 * shortest
        roots = [xxhash.xxh3_64_intdigest(data[t * step : t * step + step], seed=t) - 2**63 for t in range(self.trees)]
        tails = np.zeros(self.trees, np.uint64)
        for k in range(shortest, self.depth):
            tails = tails << np.uint64(16) | m[:, k].astype(np.uint16)
        return roots, tails.view(np.int64)


def branch(excess: int) -> Column:
    """The name of the branch of a path (``root``, ``tail``) that a prefix of ``excess`` minima beyond the shortest leads to."""
    return F.xxhash64("root", F.shiftright("tail", 16 * (max(EXCESS) - excess))) if excess else F.col("root")


def _sign(trees: int, depth: int, size: int):
    """Columns h1, h2, text: signatures; rows whose node the task has signed are left out."""

    def run(batches):
        signer, done = Signer(trees, depth), set()
        for batch in batches:
            first, roots, tails, sketches = [], [], [], []
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for i, name in enumerate(names):
                if name not in done:
                    done.add(name)
                    minima = signer.minima(shingles(batch.column(2)[i].as_py(), size))
                    first.append(i)
                    root, tail = signer.paths(minima)
                    roots.append(root)
                    tails.append(tail)
                    sketches.append(minima[:SKETCH].astype(np.uint8).tobytes())
            h1, h2 = (batch.column(k).take(pa.array(first, pa.int32())) for k in (0, 1))
            paths = (pa.array(x, pa.list_(pa.int64())) for x in (roots, tails))
            yield pa.RecordBatch.from_arrays([h1, h2, *paths, pa.array(sketches, pa.binary())], ["h1", "h2", "roots", "tails", "sketch"])

    return run


def dealt(rows: DataFrame, group: str, size: str, node: str, block: int) -> DataFrame:
    """``rows`` for tasks on two blocks of a group: adds i <= j, the blocks, and ``mine``, the row's own.

    A group of at most ``block`` rows is one block; a larger one of b blocks costs b copies of each of its rows.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    out = rows.withColumn("nb", blocks).withColumn("mine", F.pmod(F.hash(node), F.col("nb")))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    out = out.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other", "nb")
    return out.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", node)


def _groups(batches, keys: int):
    """Tables of the consecutive rows that agree in their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        starts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        bounds = [0, *starts.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and a == 0 and any(held[-1].column(k)[0].as_py() != part.column(k)[0].as_py() for k in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Edges (root, other) of stars over the components of a symmetric boolean matrix; the root comes first in order."""
    n, seen, edges = len(hit), np.zeros(len(hit), bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            new = np.flatnonzero(hit[front].any(axis=0) & ~seen)
            seen[new] = True
            edges += [(root, int(x)) for x in new]
            front = new.tolist()
    return edges


def _paired(mine: np.ndarray, i: int, j: int) -> np.ndarray | None:
    """Which pairs belong to the task of blocks i and j; None: all."""
    return None if i == j else mine[:, None] != mine[None, :]


def _candidates(least: float):
    """Columns branch, i, j, mine, comp, sketch: the components joined by pairs in a branch whose sketches agree enough, as a forest."""

    def run(batches):
        a, b = [], []
        for group in _groups(batches, 3):
            n = group.num_rows
            if n < 2:
                continue
            comp = group.column("comp").to_numpy()
            if (comp == comp[0]).all():
                continue
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(n, SKETCH)
            hit = np.empty((n, n), bool)
            for r in range(0, n, 64):
                hit[r : r + 64] = (sketch[r : r + 64, None] == sketch[None]).sum(axis=2) >= least * SKETCH
            hit &= comp[:, None] != comp[None, :]
            pairs = _paired(group.column("mine").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py())
            if pairs is not None:
                hit &= pairs
            for x, y in _forest(hit):
                a.append(comp[x])
                b.append(comp[y])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": np.array(a), "b": np.array(b)})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of sorted distinct arrays, exact, by products of 0/1 blocks."""
    n = len(sets)
    out = np.diag([len(s) for s in sets]).astype(np.int64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[column]
    renumber = np.cumsum(shared) - 1
    owner, column = owner[keep], renumber[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((n, n), np.float64)
    for first in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, [first, first + 4096])
        m = np.zeros((n, 4096), np.float32)
        m[owner[lo:hi], column[lo:hi] - first] = 1
        total += m @ m.T  # counts up to 4096 are exact in float32
    np.fill_diagonal(total, 0)
    return out + np.rint(total).astype(np.int64)


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs whose Jaccard similarity reaches the threshold, without the diagonal."""
    both = intersections(sets)
    size = np.diag(both)
    hit = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(hit, False)
    return hit


def _pack_shingles(size: int):
    """Columns node, comp, n, copies, text: the text becomes its packed shingle set."""

    def run(batches):
        for batch in batches:
            sets = [shingles(x.as_py(), size).tobytes() for x in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], ["node", "comp", "n", "copies", "shingles"])

    return run


def _verify(threshold: float):
    """Columns comp, i, j, mine, node, copies, shingles: each node's links in this task and the root of its forest."""

    def run(batches):
        for group in _groups(batches, 3):
            n = group.num_rows
            if n < 2:
                continue
            node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
            hit = similar([np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()], threshold)
            pairs = _paired(group.column("mine").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py())
            if pairs is not None:
                hit &= pairs
            root = node.copy()
            for x, y in _forest(hit):
                root[y] = node[x]
            linked = hit.any(axis=1)
            yield pa.RecordBatch.from_pydict({"node": node[linked], "links": (hit @ copies)[linked].astype(np.int64), "root": root[linked]})

    return run


def _descend(paths: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """node, comp of the nodes of ``paths`` (node, root, tail) that a branch of any tried length joins to others."""
    labels = None
    for excess in EXCESS:
        at = paths.select("node", branch(excess).alias("branch"))
        at = at.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")) if labels is not None else at.withColumn("comp", F.col("node"))
        mixed = at.groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        # Most trees find the same few members; one branch of each set is enough.
        once = mixed.groupBy("n", "members").agg(F.min("branch").alias("branch")).select("branch", "n")
        members = cut(at.join(once, "branch"), "members")
        wanted = sketches.join(members.select("node").distinct(), "node", "left_semi")
        tasks = dealt(members.join(wanted, "node"), "branch", "n", "node", SKETCH_BLOCK).select("branch", "i", "j", "mine", "comp", "sketch")
        joined = connected_components(tasks.mapInArrow(_candidates(least), "a long, b long"))
        if labels is None:
            labels = joined
        else:  # components are named by their least nodes, so a new one's name may be an old one's or a single node's
            old = labels.join(joined.toDF("comp", "new"), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
            labels = cut(old.unionByName(joined.join(labels.select("node"), "node", "left_anti")), "labels")
    return labels


def similar_classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row per node: h1, h2, node, class_node, copies, links, first_id and class_id.

    ``class_node`` is the least node of the nodes joined by links of at least ``threshold``, ``copies`` the rows of the node,
    ``links`` the other rows it is similar to, ``class_id`` the least doc_id of the class (null if all are null).
    """
    depth = prefix_length(trees, threshold, target_recall)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *node_of(text), text.cast("binary").alias("text")).where("h1 is not null")
    counts = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
    signed = rows.select("h1", "h2", "text").mapInArrow(_sign(trees, depth + max(EXCESS), size), "h1 long, h2 long, roots array<long>, tails array<long>, sketch binary")
    signed = signed.groupBy("h1", "h2").agg(*(F.first(c).alias(c) for c in ("roots", "tails", "sketch")))  # copies have equal signatures
    # The numbers of nodes are settled by writing them.
    nodes = cut(counts.join(signed, ["h1", "h2"]).withColumn("node", F.monotonically_increasing_id()), "nodes")

    paths = nodes.select("node", F.explode(F.arrays_zip("roots", "tails")).alias("path")).select("node", F.col("path.roots").alias("root"), F.col("path.tails").alias("tail"))
    shared = paths.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    # Paths that no other shares down to the shortest prefix lead nowhere.
    found = _descend(cut(paths.join(shared, "root"), "paths"), nodes.select("node", "sketch"), threshold - SKETCH_SLACK)

    sizes = found.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    wanted = cut(found.join(sizes, "comp").join(nodes.select("node", "h1", "h2", "copies"), "node"), "wanted")
    texts = rows.select("h1", "h2", "text").join(wanted.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    whole = wanted.join(texts, ["h1", "h2"]).select("node", "comp", "n", "copies", "text").mapInArrow(_pack_shingles(size), "node long, comp long, n long, copies long, shingles binary")
    verify = dealt(whole, "comp", "n", "node", TEXT_BLOCK).select("comp", "i", "j", "mine", "node", "copies", "shingles")
    links = cut(verify.mapInArrow(_verify(threshold), "node long, links long, root long"), "links")
    classes = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))

    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = nodes.select("h1", "h2", "node", "copies", "first_id").join(counted, "node", "left").join(classes.withColumnRenamed("comp", "class_node"), "node", "left")
    joined = cut(joined.withColumns({"class_node": F.coalesce("class_node", "node"), "links": F.coalesce("links", F.lit(0)) + F.col("copies") - 1}), "classes")
    first = joined.groupBy("class_node").agg(F.min("first_id").alias("class_id"))
    return joined.join(first, "class_node")


def ngram_join(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links.

    Rows are similar if their sets of five-word shingles are (a text of one to four words is one shingle).  Texts
    without words, null ones too, are similar to nothing: their class is their own doc_id.  Repeated rows are copies
    of each other and each get a row.  Other columns are ignored; an empty table gives no rows.
    """
    classes = similar_classes(docs, **options).select("h1", "h2", "class_id", "links")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *node_of(F.col("text").cast("string")))
    return rows.join(classes, ["h1", "h2"], "left").select(
        "doc_id",
        F.when(F.col("h1").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of every class the one with the least doc_id (nulls last); texts without words all stay.

    Of rows with that doc_id and the same text one stays.  Columns may have any names.
    """
    classes = similar_classes(docs, **options)
    best = classes.groupBy("class_node").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "h1", "h2")).alias("best"))
    stay = best.select(F.col("best.h1").alias("keep_h1"), F.col("best.h2").alias("keep_h2"), F.col("best.first_id").alias("keep_id"))
    names = docs.columns
    rows = docs.select(F.struct(*[named(c) for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id"), *node_of(F.col("text").cast("string")))
    kept = rows.join(stay, (F.col("h1") == F.col("keep_h1")) & (F.col("h2") == F.col("keep_h2")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    one = kept.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2", "id").orderBy("id"))).where("nth = 1")
    out = one.select("row").unionByName(rows.where("h1 is null").select("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in names])


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
