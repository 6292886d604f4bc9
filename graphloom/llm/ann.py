"""Approximate nearest neighbours by a hash-prefix forest.

Rows are dealt into shards of bounded size. In a shard each tree is an array of the rows sorted by a long hash string of SYMBOLS symbols; a symbol is the
signed axis nearest to a row after a random rotation (cross-polytope hashing), so that near vectors share a symbol far more often than others. A query
descends to its longest-prefix match in every tree, and all trees then ascend together, one symbol at a time, while they hold fewer than the wanted
candidates. Two symbols from the root, prefixes beside the query's own are looked at too, in all trees in one order, nearest axes first, before the last
steps up. Candidates are scored by inner product in double precision on the original vectors.

How many candidates are gathered in a shard of n rows follows from the target recall: FIRST * n ** POWER, which is sublinear; larger shards score a smaller share.
Both numbers were fitted against brute force on vectors without clusters, the hardest kind. Every row is indexed, and hashed once: a shard's rows and the
queries arrive in one stream, rows first, so the forest is built once and the queries pass by it in batches. Rows are never copied;
queries go to each shard, whose best k are merged.

For inner products the hashes act on vectors lengthened to one norm (the reduction of largest inner product to least angle), taken
shard by shard; scores always come from the original vectors.

Defined results: vectors that are null, empty, all zero, or hold a null or a non-finite number take no part, as rows or queries; so do null
ids and vectors of another length than the most common one. Rows with the same id as the query are not its neighbours. Equal vectors tie and go by
the smaller id; a repeated (id, vector) pair can fill one rank only. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches

#: Trees, symbols of a hash string, axes of a rotation (a symbol is an axis and a sign).
TREES, SYMBOLS, AXES = 32, 4, 64
#: Candidates gathered from n rows, for a recall of 0.95.
FIRST, POWER = 1.5, 0.76
#: Nearest symbols of a query that are combined to prefixes of two symbols beside its own.
NEAR = 24
#: Rows of a shard, about. Large tables want more: a shard of a million rows scores a twentieth of them.
SHARD = 16_384

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_SIGNED = 2 * AXES


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, finite throughout, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def rotations(width: int, trees: int = TREES, seed: int = 1) -> np.ndarray:
    """Trees x SYMBOLS projections of vectors onto AXES axes; orthogonal ones where the width allows it."""
    rng = np.random.default_rng(seed)
    out = rng.standard_normal((trees, SYMBOLS, width, AXES))
    if width >= AXES:
        out = np.linalg.qr(out)[0]
    return out.astype(np.float32)


def lengthened(vectors: np.ndarray, most: float | None) -> np.ndarray:
    """Vectors with one more number that brings each to the same norm; for queries (most None) that number is 0."""
    norm = np.linalg.norm(vectors, axis=1)
    last = np.zeros(len(vectors)) if most is None else np.sqrt(np.maximum(most * most - norm * norm, 0))
    scale = np.where(norm > 0, norm, 1) if most is None else most
    return (np.column_stack([vectors, last]) / np.reshape(scale, (-1, 1))).astype(np.float32)


def signed(projected: np.ndarray) -> np.ndarray:
    """Nearness of each signed axis: for axis j, 2 j is its negative end and 2 j + 1 its positive one."""
    out = np.empty((*projected.shape[:-1], _SIGNED), dtype=np.float32)
    out[..., 0::2], out[..., 1::2] = -projected, projected
    return out


class Forest:
    """The rows of one shard: distinct vectors with their ids, and for each tree the vectors' numbers sorted by hash string."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, trees: int):
        # Equal vectors are one entry with its ids ascending; no more than k + 1 of them can be among a query's k best.
        order = np.lexsort((ids, *vectors.T[::-1]))
        vectors, ids = vectors[order], ids[order]
        new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(1)])
        self.x, first = vectors[new], np.flatnonzero(new)
        count = np.minimum(np.diff(np.append(first, len(ids))), k + 1)
        self.begin = np.concatenate([[0], np.cumsum(count)])
        self.ids = ids[np.repeat(first - self.begin[:-1], count) + np.arange(self.begin[-1])]
        self.light, n = self.x.astype(np.float32), len(self.x)
        self.rotations = rotations(self.x.shape[1] + 1, trees)
        long = lengthened(self.x, float(np.linalg.norm(self.x, axis=1).max()))
        self.strings, self.rows = np.empty((trees, n), dtype=np.int64), np.empty((trees, n), dtype=np.int32)
        self.pairs = np.empty((trees, _SIGNED * _SIGNED + 1), dtype=np.int32)
        for t in range(trees):
            code = np.zeros(n, dtype=np.int64)
            for s in range(SYMBOLS):
                code = code * _SIGNED + signed(long @ self.rotations[t, s]).argmax(1)
            self.rows[t] = np.argsort(code, kind="stable")
            self.strings[t] = code[self.rows[t]]
            # Where each prefix of two symbols begins.
            self.pairs[t] = np.searchsorted(self.strings[t], np.arange(_SIGNED * _SIGNED + 1) * _SIGNED ** (SYMBOLS - 2))

    def ranges(self, own: np.ndarray, near: np.ndarray, want: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tree, begin, end) of ranges of the sorted arrays, in the order in which they are to be taken.

        ``own``: the query's string in each tree; ``near``: trees x 2 x signed axes, the nearness of the first two symbols.
        """
        trees = np.arange(len(own))
        for length in range(SYMBOLS, 2, -1):
            width = _SIGNED ** (SYMBOLS - length)
            low = own // width * width
            each = [(np.searchsorted(self.strings[t], low[t]), np.searchsorted(self.strings[t], low[t] + width)) for t in trees]
            yield trees, np.array([a for a, _ in each]), np.array([b for _, b in each])
        top = np.argpartition(-near, NEAR, axis=2)[:, :, :NEAR]
        score = np.take_along_axis(near, top, 2)
        total = (score[:, 0, :, None] + score[:, 1, None, :]).reshape(len(own), -1)
        code = (top[:, 0, :, None] * _SIGNED + top[:, 1, None, :]).reshape(len(own), -1)
        a, b = np.take_along_axis(self.pairs[:, :-1], code, 1), np.take_along_axis(self.pairs[:, 1:], code, 1)
        tree, spot = np.nonzero(b > a)
        order = np.argsort(-total[tree, spot], kind="stable")
        tree, spot = tree[order], spot[order]
        size = np.cumsum(b[tree, spot] - a[tree, spot])
        at = 0
        while at < len(tree):
            # Rows found twice are counted twice here, so that the caller asks again until it has enough.
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + want)) + 1)
            yield tree[at:end], a[tree[at:end], spot[at:end]], b[tree[at:end], spot[at:end]]
            at = end
        low = own // _SIGNED ** (SYMBOLS - 1) * _SIGNED
        yield trees, self.pairs[trees, low], self.pairs[trees, low + _SIGNED]
        yield trees[:1], np.array([0]), np.array([len(self.x)])

    def candidates(self, own: np.ndarray, near: np.ndarray, want: int) -> np.ndarray:
        """Numbers of at least ``want`` distinct vectors, or of all."""
        mark, found = np.zeros(len(self.x), dtype=bool), 0
        for tree, a, b in self.ranges(own, near, max(want // 6, 1)):
            size = b - a
            if size.sum():
                spot = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                mark[self.rows[np.repeat(tree, size), spot]] = True
                found = int(mark.sum())
            if found >= want:
                break
        return np.flatnonzero(mark)

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, first: float, power: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query ids, found ids, scores, number of vectors scored): up to k rows for each query."""
        want = min(len(self.x), max(int(first * len(self.x) ** power), 8 * k))
        long = lengthened(queries, None)
        near = np.stack([np.stack([signed(long @ r) for r in tree]) for tree in self.rotations])  # trees x symbols x queries x signed axes
        symbols = near.argmax(3)
        own = np.zeros(symbols.shape[::2], dtype=np.int64)
        for s in range(SYMBOLS):
            own = own * _SIGNED + symbols[:, s]
        out: tuple = ([], [], [])
        scored = 0
        for j, q in enumerate(queries):
            at = self.candidates(own[:, j], near[:, :2, j], want)
            scored += len(at)
            # A light score picks somewhat more than k vectors, the exact one ranks them.
            rough, more = self.light[at] @ q.astype(np.float32), 3 * k + 20
            if len(at) > more:
                edge = np.partition(rough, len(rough) - more)[len(rough) - more]
                at = at[rough >= edge - 1e-5 * abs(edge)]
            exact = (self.x[at] * q).sum(axis=1)  # row by row, so that equal vectors tie
            count = self.begin[at + 1] - self.begin[at]
            found = self.ids[np.repeat(self.begin[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
            score = np.repeat(exact, count)
            other = found != ids[j]
            found, score = found[other], score[other]
            best = np.lexsort((found, -score))[:k]
            out[0].append(np.full(len(best), ids[j]))
            out[1].append(found[best])
            out[2].append(score[best])
        return (*(np.concatenate(c) for c in out), scored)


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("vector")
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _search(k: int, trees: int, first: float, power: float):
    """A stream of shards, each its rows (kind 0) and then the queries (kind 1) -> the best k of each shard for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, forest = None, None
        rows: list[pa.RecordBatch] = []
        for batch in batches:
            s, kind = batch.column("s").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(s) != 0) | (np.diff(kind) != 0)) + 1, [len(s)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if s[a] != shard:
                    shard, forest, rows = s[a], None, []
                if kind[a] == 0:
                    rows.append(part)
                    continue
                if forest is None and rows:
                    forest, rows = Forest(np.concatenate([r.column("vec_id").to_numpy() for r in rows]), np.concatenate([_flat(r) for r in rows]), k, trees), []
                if forest is not None:
                    found = forest.search(part.column("vec_id").to_numpy(), _flat(part), k, first, power)[:3]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, _FOUND)], schema=_FOUND)

    return run


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    first: float = FIRST,
    power: float = POWER,
    shard: int = SHARD,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k best found, nearest first, ties to the smaller id."""
    arrow_batches(vectors.sparkSession, 1000)
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows, asked = clean(vectors), clean(queries)
    widths = rows.groupBy(F.size("vector").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    w, n = (widths["w"], widths["n"]) if widths else (0, 0)
    rows, asked = (df.where(F.size("vector") == w).dropDuplicates() for df in (rows, asked))
    shards = max(1, -(-n // shard))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).alias("s"), F.lit(0).alias("kind"), "vec_id", "vector")
    sent = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("s"), F.lit(1).alias("kind"), "vec_id", "vector")
    streams = dealt.unionByName(sent).repartition(shards, "s").sortWithinPartitions("s", "kind")
    found = streams.mapInArrow(_search(k, trees, first, power), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
