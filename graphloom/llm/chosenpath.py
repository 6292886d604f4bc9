"""N-gram Jaccard join by chosen paths.

Texts are sets of 5-word shingles. In each run a text starts at the root and goes to a child for each of its shingles that the node's
hash chooses, 1 / threshold of them on average; so texts of the asked similarity share at least one child on average,
and unlike ones soon part. Nodes with few texts are compared by brute force; larger ones are split again, level by level, until they are small. With k levels
two similar texts meet with probability 0.63 (k = 1) to 0.37 (k = 3) a run, and runs are repeated until the target recall.

Before anything is split, near copies leave. Each text is compared once with one other: the first text of the largest node it is in. Where that one is COVERED alike, it
stands for the text in all nodes: whatever is similar to the text is near enough to it to be found by a lower bound (distances of sets obey the triangle inequality). What stands
for others is not stood for itself, so nothing is far from what stands for it. This is repeated while it removes a tenth of the texts in large nodes.

A large node is compared in pairs of blocks if that costs less than to split it: with n texts, of which a share f would stay together in a child (it follows from their mean similarity), that
is where n * (1 - f) is small. So crowds of texts that no split parts are compared at once, and others are split until no such node is left. Texts that went deeper
than PLANNED levels are given the further runs that so many levels ask for.

Brute force inside a node compares 128 minwise hashes of a byte each against a bound five standard deviations below the threshold and only
passes on which texts hang together. Texts that may be similar form groups; each group's texts are then compared exactly, once, so no
pair is counted twice and no pair leaves a task: a task gives each text's number of links and a spanning star. For that, each text is sent once, beside the
text of its group's first one, and only its difference from that goes on to the cells; of large groups, to a cell for each pair of blocks.

Equal texts are one node of the graph with a multiplicity, before anything is split, so copies are never compared. They are known by a 128-bit hash.

Defined results: a null text is empty; an empty text (no word) has no shingles and no links, and is a class of its own row. A text of 1 to 4
words has one shingle, all its words. Equal rows, also with equal or null ids, are linked to one another. A class is named by its least
id (null if it has none). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bitmaps import bitmap, holds
from .common import NONSPACE, arrow_batches, written
from .components import components
from .rolling import chunks, inside, mix, odd, windows, word_hashes

#: Words of a shingle, similarity of a link, recall to reach, levels that the first runs are meant for.
SHINGLE, THRESHOLD, RECALL, PLANNED = 5, 0.8, 0.999, 3
#: Minwise hashes of a sketch, and the similarity of sketches from which texts are compared exactly.
SKETCH, SKETCH_BOUND = 128, 0.62
#: Similarity of sketches from which a text is stood for by another one, and the bound for those that stand for others: what is 0.8 alike to a text is at most 0.1 less alike to what stands
#: for it, and at most 0.2 less to what stands for it in turn where both are stood for; that is still three standard deviations above.
COVERED, STAR_BOUND = 0.92, 0.48
#: Texts of a node from which it may be split; texts of a block, in nodes and in groups; rows that a task takes, about; copies of a group's first text, and parts of a node.
SPLIT, NODE_BLOCK, GROUP_BLOCK, TASK_ROWS, TASK_TEXTS, SALTS = 2048, 4096, 2048, 40_000, 4_000, 32
#: Paths of a text on a level, about.
PATHS = 20

_U = np.uint64


def runs_for(recall: float = RECALL, levels: int = PLANNED) -> int:
    """Runs that reach the recall for pairs at the threshold: a critical branching process survives each level."""
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, end to end; and how many each has."""
    words = [t.encode().split() for t in texts]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    hashes = word_hashes([w for ws in words for w in ws])
    own = np.repeat(np.arange(len(texts)), lengths)
    h, ok = windows(hashes, SHINGLE, 5), inside(lengths, SHINGLE)
    h, who = h[ok], own[: len(ok)][ok]
    short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    begin = np.cumsum(lengths) - lengths
    few = [int(windows(hashes[begin[k] : begin[k] + lengths[k]], int(lengths[k]), 5)[0]) for k in short.tolist()]
    h, who = np.concatenate([h, np.array(few, dtype=_U)]), np.concatenate([who, short])
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    return h[new], np.bincount(who[new], minlength=len(texts))


def sketches(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The lowest byte of each of SKETCH minwise hashes, a row for each text that has shingles."""
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(first), SKETCH), dtype=np.uint8)
    for k, a in enumerate(odd(77, SKETCH)):
        x = h * a
        x ^= x >> _U(29)
        out[:, k] = (mix(np.minimum.reduceat(x, first)) & _U(255)).astype(np.uint8)
    return out


def children(h: np.ndarray, sizes: np.ndarray, who: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, child) for all children of the nodes ``node`` that the texts ``who`` go to."""
    begin = np.cumsum(sizes) - sizes
    limit = np.minimum(2.0**64 / (THRESHOLD * np.maximum(sizes, 1)), 2.0**64 - 2049).astype(_U)
    n = sizes[who]
    at = np.repeat(begin[who] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    x = h[at] * np.repeat(node | _U(1), n)
    x ^= x >> _U(31)
    x *= _U(0xD6E8FEB86659FD93)
    spot = np.flatnonzero(x < np.repeat(limit[who], n))
    from_ = np.repeat(np.arange(len(who)), n)[spot]
    return who[from_], mix(node[from_] ^ mix(h[at[spot]]))


def roots(h: np.ndarray, sizes: np.ndarray, runs: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text, node) of the first level of the runs from ``first`` to before ``runs``: ``children`` of each run's root, to which all texts go."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    limit = np.minimum(2.0**64 / (THRESHOLD * np.maximum(sizes, 1)), 2.0**64 - 2049).astype(_U)[own]
    mixed = mix(h)
    found = []
    for seed in odd(4242, runs)[first:]:
        x = h * (seed | _U(1))
        x ^= x >> _U(31)
        x *= _U(0xD6E8FEB86659FD93)
        spot = np.flatnonzero(x < limit)
        found.append((own[spot], mix(seed ^ mixed[spot])))
    return tuple(np.concatenate(c) for c in zip(*found))


def _run_again(first: int, runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, stands, text) -> (id, stands, path): the first level of further runs."""
        for batch in batches:
            texts, ids, stands = batch.column("text").to_pylist(), batch.column("id").to_numpy(), batch.column("stands").to_numpy()
            for a, b in chunks(texts):
                who, path = roots(*shingles(texts[a:b]), runs, first)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][who]), pa.array(stands[a:b][who]), pa.array(path.view(np.int64))], names=["id", "stands", "path"])

    return run


_SIGNATURE = "node string, doc_id long, sketch binary, paths array<bigint>"


def _lists(who: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(who, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order].view(np.int64)))


def _sign(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                part = batch.slice(a, b - a)
                h, sizes = shingles(texts[a:b])
                has = sizes > 0
                rows = pa.array(has)
                sketch = pa.array([s.tobytes() for s in sketches(h, sizes)] if has.any() else [], pa.binary())
                cols = [part.column("node").filter(rows), part.column("doc_id").filter(rows), sketch, _lists(*roots(h, sizes, runs), b - a).filter(rows)]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "doc_id", "sketch", "paths"])

    return run


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, stands, text, paths) -> (id, stands, path): the children of the nodes at which a text is."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in chunks(texts):
            part = batch.slice(a, b - a)
            h, sizes = shingles(texts[a:b])
            lists = part.column("paths")
            count = np.diff(lists.offsets.to_numpy())
            node = lists.flatten().to_numpy().astype(np.int64).view(_U)
            who, path = children(h, sizes, np.repeat(np.arange(b - a), count), node)
            ids, stands = part.column("id").to_numpy(), part.column("stands").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(stands[who]), pa.array(path.view(np.int64))], names=["id", "stands", "path"])


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, rep, sketch, rep_sketch) -> (id, rep, alike): how many of the hashes are the other text's."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH) for c in ("sketch", "rep_sketch"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("rep"), pa.array((a == b).sum(1).astype(np.int32))], names=["id", "rep", "alike"])


_DENSITY = pa.schema([("path", pa.int64()), ("pairs", pa.float64()), ("alike", pa.float64())])


def _density(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Blocks of large nodes -> the number of their pairs and the sum of the pairs' similarity, by counting equal hashes."""
    path, cell = table["path"].to_numpy(), table["cell"].to_numpy()
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
    order, bounds = _segments(path, cell)
    rows = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n, held = float(b - a), sketch[order[a:b]]
        same = sum(float((np.bincount(held[:, k]).astype(np.float64) ** 2).sum()) for k in range(SKETCH)) / SKETCH
        rows.append((path[order[a]], n * (n - 1), same - n))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _DENSITY)] if rows else [pa.array([], f.type) for f in _DENSITY], schema=_DENSITY)


def stars(sketch: np.ndarray, apart: np.ndarray | None = None, wide: np.ndarray | None = None) -> np.ndarray:
    """For each row the first row of those it hangs together with, by sketches of at least SKETCH_BOUND alike.

    Each row that is reached is compared once with those not yet reached. ``apart`` has block numbers: rows of equal blocks are
    compared elsewhere. ``wide`` rows stand for others; for them the bound is STAR_BOUND.
    """
    n, least = len(sketch), math.ceil(SKETCH_BOUND * SKETCH)
    some = np.where(wide, math.ceil(STAR_BOUND * SKETCH), least) if wide is not None and wide.any() else None
    first = np.full(n, -1, dtype=np.int64)
    free = np.arange(n)
    while len(free):
        root, free = free[0], free[1:]
        first[root], queue = root, [root]
        while queue and len(free):
            row = queue.pop()
            same = (sketch[free] == sketch[row]).sum(1) >= (least if some is None else np.minimum(some[free], some[row]))
            if apart is not None:
                same &= apart[free] != apart[row]
            first[free[same]] = root
            queue += free[same].tolist()
            free = free[~same]
    return first


def _segments(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal keys together, and the bounds of the runs of equal keys in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.concatenate([[0], np.flatnonzero(new), [len(order)]])


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _brute_nodes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Many small nodes, or block pairs of large ones -> stars of texts that may be similar."""
    path, cell, block, mixed, text, wide = (table[c].to_numpy() for c in ("path", "cell", "block", "mixed", "id", "wide"))
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
    order, bounds = _segments(path, cell)
    sizes = np.diff(bounds)
    out_u, out_v = [], []
    # Nodes of two, all at once.
    two = order[bounds[:-1][sizes == 2][:, None] + np.arange(2)] if (sizes == 2).any() else np.empty((0, 2), dtype=np.int64)
    alike = (sketch[two[:, 0]] == sketch[two[:, 1]]).sum(1) >= np.where(wide[two].any(1), math.ceil(STAR_BOUND * SKETCH), math.ceil(SKETCH_BOUND * SKETCH))
    out_u.append(text[two[alike, 0]])
    out_v.append(text[two[alike, 1]])
    for k in np.flatnonzero(sizes > 2).tolist():
        rows = order[bounds[k] : bounds[k + 1]]
        first = stars(sketch[rows], block[rows] if mixed[rows[0]] else None, wide[rows])
        more = first != np.arange(len(rows))
        out_u.append(text[rows[more]])
        out_v.append(text[rows[first[more]]])
    return pa.table([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], schema=_EDGES).group_by(["u", "v"]).aggregate([]).cast(_EDGES)


def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts beside their group's first one -> how many shingles they have (n_set), how many of the first one's they lack (n_less), and the hashes by which they differ:
    those it has besides (odd numbers) and those it lacks (even numbers)."""
    for batch in batches:
        texts, firsts = batch.column("text").to_pylist(), batch.column("first").to_pylist()
        out: tuple = ([], [], [])
        for a, b in chunks(texts):
            own, sizes = shingles(texts[a:b])
            distinct: dict[str, int] = {}
            for x in firsts[a:b]:
                distinct.setdefault(x, len(distinct))
            base, base_sizes = shingles(list(distinct))
            at, base_at = np.cumsum(sizes) - sizes, np.cumsum(base_sizes) - base_sizes
            for k, x in enumerate(firsts[a:b]):
                mine, j = own[at[k] : at[k] + sizes[k]], distinct[x]
                theirs = base[base_at[j] : base_at[j] + base_sizes[j]]
                more, less = np.setdiff1d(mine, theirs, assume_unique=True), np.setdiff1d(theirs, mine, assume_unique=True)
                out[0].append(int(sizes[k]))
                out[1].append(len(less))
                out[2].append(np.concatenate([more | _U(1), less & ~_U(1)]).tobytes())
        cols = [batch.column(c) for c in ("component", "n", "id", "times")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["component", "n", "id", "times", "n_set", "n_less", "differs"])


def similar(h: np.ndarray, counts: np.ndarray, sizes: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Boolean matrix of the pairs of sets whose Jaccard similarity is at least THRESHOLD; false on the diagonal.

    ``h`` and ``counts``: the hashes by which each set differs from one that is the same for all, end to end; ``sizes``: of the sets; ``less``: of what they lack.
    Of that one set, two sets share what neither lacks; besides, they share what both have more.
    """
    n = len(sizes)
    values, code, count = np.unique(h, return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(n), counts)
    # Hashes by which only one set differs count for no pair.
    joint = np.zeros((n, n), dtype=np.float32)
    shared = np.full(len(values), -1, dtype=np.int64)
    some = count > 1
    shared[some] = np.arange(int(some.sum()))
    col = shared[code]
    keep = col >= 0
    own, col = own[keep], col[keep]
    order = np.argsort(col, kind="stable")
    own, col = own[order], col[order]
    width = max(256, (8 << 20) // max(n, 1))
    for a in range(0, int(some.sum()), width):
        x, y = np.searchsorted(col, [a, a + width])
        held = np.zeros((n, min(width, int(some.sum()) - a)), dtype=np.float32)
        held[own[x:y], col[x:y] - a] = 1
        joint += held @ held.T
    more = counts - less
    base = sizes[0] + less[0] - more[0] if n else 0
    out = np.empty((n, n), dtype=bool)
    for a in range(0, n, 256):  # by stripes, as whole matrices of numbers would take ten times the memory
        rows = slice(a, a + 256)
        common = base - less[rows, None] - less[None, :] + np.round(joint[rows]).astype(np.int64)
        # In whole numbers, so that exactly 0.8 counts: 5 * common >= 4 * both.
        out[rows] = common * 5 >= (sizes[rows, None] + sizes[None, :] - common) * 4
    np.fill_diagonal(out, False)
    return out


_FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("v", pa.int64())])


def _compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Whole groups, or block pairs of large ones -> for each text its number of linked rows and a text it is linked to."""
    group, cell, block, mixed, node, times, sets, less = (table[c].to_numpy() for c in ("component", "cell", "block", "mixed", "id", "times", "n_set", "n_less"))
    order, bounds = _segments(group, cell, node)
    differs = table["differs"]
    rows = order[bounds[:-1]]  # one row of each text, should equal rows have come
    _, bounds = _segments(group[rows], cell[rows])
    outs: tuple = ([], [], [])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        mine = rows[a:b]
        if len(mine) < 2:
            continue
        data = differs.take(pa.array(mine)).to_pylist()
        like = similar(np.frombuffer(b"".join(data), dtype=_U), np.array([len(x) // 8 for x in data]), sets[mine], less[mine])
        if mixed[mine[0]]:
            like &= block[mine][:, None] != block[mine][None, :]
        linked = like.any(1)
        # Spanning stars: from each text to the first of those it hangs together with.
        first, free = np.arange(len(mine)), linked.copy()
        for root in np.flatnonzero(linked).tolist():
            if free[root]:
                free[root], queue = False, [root]
                while queue:
                    near = np.flatnonzero(like[queue.pop()] & free)
                    free[near] = False
                    first[near] = root
                    queue += near.tolist()
        outs[0].append(node[mine[linked]])
        outs[1].append(like[linked].astype(np.int64) @ times[mine])
        outs[2].append(node[mine[first[linked]]])
    cols = [np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in outs]
    return pa.table([pa.array(c.astype(np.int64)) for c in cols], schema=_FOUND)


def _cells(members: DataFrame, count: str, key: str, item: str, size: int) -> DataFrame:
    """Adds block, cell and mixed (a cell of two blocks). Up to ``size`` items: one cell. More: blocks by hash, a cell for each pair of blocks and for each block."""
    blocks = F.ceil(F.col(count) / F.lit(size)).cast("int")
    block = F.when(blocks <= 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(item, F.lit(9)), blocks).cast("int"))
    cut = members.withColumn("blocks", blocks).withColumn("block", block)
    pair = lambda j: F.struct(
        (F.least("block", j).cast("long") * F.col("blocks") + F.greatest("block", j)).alias("cell"), (F.col("block") != j).alias("mixed")
    )
    cells = F.transform(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0))), pair)
    return cut.withColumn("x", F.explode(cells)).select("*", "x.cell", "x.mixed").drop("blocks", "x")


def node_of(text: str) -> F.Column:
    """The name of a text: null where it has no word."""
    full = F.coalesce(F.col(text), F.lit(""))
    return F.when(full.rlike(NONSPACE), F.md5(full))


def _nodes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (path, n, rep: the least member) of members (id, path): those of more than SPLIT members, which are few and are sent to all tasks, and the others of at least two."""
    nodes = members.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"))
    return F.broadcast(nodes.where(F.col("n") > SPLIT)), nodes.where((F.col("n") > 1) & (F.col("n") <= SPLIT))


def _sized(members: DataFrame) -> DataFrame:
    """Members (id, path) with the number of their node's (n) and the least of them (rep), of nodes of at least two. Members of large nodes are not shuffled, so that a node is not one task."""
    large, small = _nodes(members)
    looked = members.join(large, "path", "left")  # the same for both parts, so that they share one broadcast
    return looked.where("n is not null").unionByName(looked.where("n is null").select("id", "path").join(small, "path"))


def _covers(members: DataFrame, sketch: DataFrame, rows: int) -> tuple[DataFrame | None, list[DataFrame]]:
    """(id, rep) of texts that another one stands for, if any; and candidate edges of all that were compared."""
    covers, edges = None, []
    while True:
        now = members if covers is None else members.join(covers.select("id"), "id", "left_anti")
        # The largest node of each text, where it is large.
        best = now.join(_nodes(now)[0], "path").groupBy("id").agg(F.max(F.struct("n", (-F.col("rep")).alias("last"))).alias("x"))
        best = best.select("id", (-F.col("x.last")).alias("rep")).where("id <> rep")
        pairs = best.join(sketch, "id").join(sketch.select(F.col("id").alias("rep"), F.col("sketch").alias("rep_sketch")), "rep").select("id", "rep", "sketch", "rep_sketch")
        beside = written(pairs.mapInArrow(_beside, "id long, rep long, alike int"), "beside", rows)
        tried = beside.count()
        if not tried:
            return covers, edges
        edges.append(beside.where(F.col("alike") >= math.ceil(STAR_BOUND * SKETCH)).select(F.col("id").alias("u"), F.col("rep").alias("v")))
        near = beside.where(F.col("alike") >= math.ceil(COVERED * SKETCH)).select("id", "rep")
        if covers is not None:
            near = near.join(covers.select(F.col("rep").alias("id")).distinct(), "id", "left_anti")
        good = near.join(near.select(F.col("id").alias("rep")), "rep", "left_anti").select("id", "rep")
        covers = written(good if covers is None else good.unionByName(covers), "covers", rows)
        if (found := good.count()) * 10 < tried or not found:
            return covers, edges


def _candidates(texts: DataFrame, one: DataFrame, recall: float, rows: int) -> DataFrame:
    """Edges (u, v) between ids of texts that may be similar, from all levels. ``texts``: id, node, doc_id, sketch, paths; ``one``: node, doc_id, text; ``rows``: of a table of paths, about."""
    sketch = texts.select("id", "sketch")
    bins = max(SALTS, -(-rows // PATHS * 4 // TASK_ROWS))
    covers, edges = _covers(texts.select("id", F.explode("paths").alias("path")), sketch, rows)
    held = texts.select("id", "sketch", F.lit(False).alias("wide"), F.col("id").alias("stands"), "paths")
    if covers is not None:
        first = covers.select(F.col("rep").alias("id")).distinct()
        marks = covers.select("id", F.lit(False).alias("wide"), F.col("rep").alias("stands")).unionByName(first.select("id", F.lit(True).alias("wide"), F.col("id").alias("stands")))
        held = texts.join(marks, "id", "left").select("id", "sketch", F.coalesce("wide", F.lit(False)).alias("wide"), F.coalesce("stands", "id").alias("stands"), "paths")
        held = written(held, "held", rows)
    sketch = held.select("id", "sketch", "wide")

    def compared(members: DataFrame) -> DataFrame:
        """Brute force in nodes (id, path, n): small nodes share a task; each cell of a large one is dealt on its own."""
        cells = _cells(members, "n", "path", "id", NODE_BLOCK).join(sketch, "id")
        dealt = cells.withColumn("bin", F.pmod(F.xxhash64("path", "cell"), F.lit(bins))).select("bin", "path", "cell", "block", "mixed", "id", "sketch", "wide")
        return dealt.groupBy("bin").applyInArrow(_brute_nodes, "u long, v long")

    def dense(crowd: DataFrame) -> DataFrame:
        """(path, dense): whether a large node is compared as it is."""
        block = F.pmod(F.xxhash64("id", F.lit(9)), F.ceil(F.col("n") / NODE_BLOCK))
        cells = crowd.withColumn("cell", block).join(sketch, "id").withColumn("bin", F.pmod(F.xxhash64("path", "cell"), F.lit(bins)))
        found = cells.select("bin", "path", "cell", "sketch").groupBy("bin").applyInArrow(_density, "path long, pairs double, alike double")
        mean = found.groupBy("path").agg((F.sum("alike") / F.sum("pairs")).alias("mean"))
        stay = F.least(F.lit(1.0), 2 * F.col("mean") / (1 + F.col("mean")) / THRESHOLD)
        sizes = crowd.groupBy("path").agg(F.first("n").alias("n"))
        return sizes.join(mean, "path").select("path", (F.col("n") * (1 - stay) <= SPLIT).alias("dense"))

    split: DataFrame | None = None
    deep: list[DataFrame] = []

    def descended(members: DataFrame) -> int:
        """Compares what lies in small or dense nodes, and splits the others level by level; the levels that were needed. A member is a text at a path, and what stands for it there."""
        nonlocal split
        level = 1
        while True:
            nodes = written(_sized(members.select(F.col("stands").alias("id"), "path").distinct()).select("id", "path", "n"), "nodes", rows)
            edges.append(written(compared(nodes.where(F.col("n") <= SPLIT)), "found", rows))
            crowd = nodes.where(F.col("n") > SPLIT)
            if crowd.isEmpty():
                return level
            judged = written(dense(crowd), "dense", rows)
            edges.append(written(compared(crowd.join(judged.where("dense"), "path").drop("dense")), "found", rows))
            at = members.join(judged.where(~F.col("dense")).select("path"), "path").groupBy("id", "stands").agg(F.collect_list("path").alias("paths"))
            at = written(at, "split", rows)
            if at.isEmpty():
                return level
            if level == PLANNED:
                deep.append(at.select("id", "stands"))
            if split is None:
                # The texts that are still to be split, of which deeper levels only have a part.
                split = written(_fetched(one, texts.join(at.select("id"), "id").select("id", "node", F.col("doc_id").alias("rep"))).select("id", "text"), "texts", rows)
            members = written(split.join(at, "id").select("id", "stands", "text", "paths").mapInArrow(_descend, "id long, stands long, path long").distinct(), "level", rows)
            level += 1

    planned, levels = PLANNED, descended(held.select("id", "stands", F.explode("paths").alias("path")))
    while levels > planned:
        first, planned = runs_for(recall, planned), max(levels, 2 * planned)
        below = split.join(reduce(DataFrame.unionByName, deep).distinct(), "id").select("id", "stands", "text")
        again = written(below.mapInArrow(_run_again(first, runs_for(recall, planned)), "id long, stands long, path long").distinct(), "again", rows)
        levels = max(levels, descended(again))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def _among(asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(asked.value, dtype=np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(holds(bits, batch.column("__h").to_numpy().view(_U))))

    return run


def _fetched(one: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of ``named`` (id, node, rep and others) with their text, from one of the rows (node, doc_id, text) that have it: the key is the text's name and least id, so that its
    many copies don't meet in one task."""
    names = named.withColumnRenamed("node", "__node")
    # Most texts are not asked for, and are left out before the exchange by a bitmap of fixed size.
    asked = one.sparkSession.sparkContext.broadcast(bitmap(named, F.xxhash64("node")))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in one.schema.fields)
    one = one.withColumn("__h", F.xxhash64("node")).mapInArrow(_among(asked), f"{kind}, __h long").drop("__h")
    found = one.join(names, (F.col("node") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    return found.drop("__node").dropDuplicates(["id"])


def node_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """For each distinct text with a word: node, class_id (least id of its class), n_links (rows linked to a row with this text),
    and chosen, true for one node of each class, which has the least id."""
    spark = docs.sparkSession
    arrow_batches(spark)
    one = docs.select(node_of(text_col).alias("node"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("node is not null")
    signed = one.mapInArrow(_sign(runs_for(recall)), _SIGNATURE)
    distinct = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("times"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    texts = written(distinct.withColumn("id", F.monotonically_increasing_id()), "signatures")
    rows = texts.count() * PATHS
    groups = written(components(_candidates(texts, one, recall, rows), rows), "groups", rows).withColumnRenamed("node", "id")
    # Exact comparison inside groups, on one row of each text; a group's first text (its least id) is dealt with its members.
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    inside_ = groups.join(sizes, "component").join(texts.select("id", "node", F.col("doc_id").alias("rep"), "times"), "id")
    found_in = _fetched(one, inside_).select("component", "n", "id", "times", "text")
    found_in = written(found_in, "members", rows).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    copies = F.when(F.col("n") > GROUP_BLOCK, SALTS - 1).otherwise(0)  # only large groups are salted
    salt = F.when(F.col("n") > GROUP_BLOCK, F.col("salt")).otherwise(0)
    firsts = found_in.where("id = component").select("component", F.col("text").alias("first"), F.explode(F.sequence(F.lit(0), copies)).alias("salt"))
    beside = found_in.withColumn("salt", salt).join(firsts, ["component", "salt"]).select("component", "n", "id", "times", "text", "first")
    members = beside.mapInArrow(differences, "component long, n long, id long, times long, n_set long, n_less long, differs binary")
    parts = _cells(written(members, "differences", rows), "n", "component", "id", GROUP_BLOCK)
    task_bins = max(SALTS, -(-rows // PATHS // TASK_TEXTS))
    dealt = parts.withColumn("bin", F.pmod(F.xxhash64("component", "cell"), F.lit(task_bins)))
    found = written(dealt.select("bin", "component", "cell", "block", "mixed", "id", "times", "n_set", "n_less", "differs").groupBy("bin").applyInArrow(_compare, "node long, links long, v long"), "links", rows)
    classes_of = components(found.select(F.col("node").alias("u"), "v"), rows).withColumnRenamed("node", "id")
    links = found.groupBy(F.col("node").alias("id")).agg(F.sum("links").alias("links"))
    every = texts.select("id", "node", "doc_id", "times").join(links, "id", "left").join(classes_of, "id", "left")
    every = every.select("node", "doc_id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("root"))
    # The least id of a class, nulls last, and the least node with it.
    best = every.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best"))
    return every.join(best, "root").select("node", F.col("best.doc_id").alias("class_id"), "n_links", (F.col("best.node") == F.col("node")).alias("chosen"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """A row for each row: the id, class_id and n_links (other rows whose texts have a similarity of 0.8 or more)."""
    found = written(node_classes(docs, id_col, text_col, recall), "classes")
    rows = docs.select(F.col(id_col).alias("id"), node_of(text_col).alias("node"))
    none = rows.where("node is null").select("id", F.col("id").cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    out = rows.where("node is not null").join(found, "node").select("id", "class_id", "n_links").unionByName(none)
    return out.select(F.col("id").alias(id_col), "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """The table without all rows of each class but one with its least id; rows without a word stay."""
    found = written(node_classes(docs, id_col, text_col, recall).where("chosen").select("node", "class_id"), "chosen")
    rows = docs.select(F.struct(*docs.columns).alias("row"), node_of(text_col).alias("node"), F.col(id_col).cast("long").alias("id"))
    bare = rows.where("node is null").select("row")
    # By text and id, so that the copies of a text don't meet in one task.
    names = found.withColumnRenamed("node", "__node")
    kept = rows.join(names, (F.col("node") == F.col("__node")) & F.col("id").eqNullSafe(F.col("class_id"))).dropDuplicates(["node"]).select("row")
    return kept.unionByName(bare).select("row.*")
