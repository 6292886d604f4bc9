"""WARC records and a Merkle fixity audit of two replicas.

Records are hashed in their stored order. A node covers a run of neighbouring records (or nodes) and so a range of offsets; its digest is the hash of its
children's digests with their offsets in the node, in order. Where a node begins is decided by the record there (one record in FANOUT begins a node of the
first level, one in FANOUT^2 one of the second, ...), not by its number: a record that is lost or added changes the nodes above it and no
others, although all later records move. Two replicas' roots are compared first; then, level by level, only children of
nodes that differ are looked at, down to the records. What differs is paired by the records' keys.

Each level is written once, and is FANOUT times smaller than the one below; nodes that differ are written once a level. Numbering takes one range
exchange of keys and digests, never of payloads, and a row for each partition through the driver. Nodes hold FANOUT children on average; their length is geometric.

Defined results: null payloads and urls are empty. Records with equal keys are ordered by digest, null keys come first. Equal records (key and
digest) are one leaf with a number of times, however many there are; where replicas hold them a different number of times, that is one place. A record
that one replica lacks is one place, with nulls on the side without it. A key under which each replica has one record that the other lacks is one place
with both; if there are more, each record is a place. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Children of a node, on average: a power of two.
FANOUT = 64
#: Bytes of a file that are unpacked at a time, and of payloads in a batch of records, about.
PIECE, BATCH_BYTES = 1 << 20, 16 << 20


def record(url: Column, payload: Column) -> Column:
    """A WARC 1.0 resource record as text: header with length, payload, two line ends."""
    body, target = F.coalesce(payload, F.lit("")), F.coalesce(url, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), target,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def _height(n: int) -> int:
    """Levels above the records, up to a root that covers all."""
    height = 1
    while FANOUT**height < n:
        height += 1
    return height


def _begins(h: Column, level: int) -> Column:
    """Whether a record begins a node of the level: the lowest bits of its hash are 0."""
    return h.bitwiseAND(F.lit(FANOUT**level - 1)) == 0


def leaves(records: DataFrame, order: list[str], record_col: str = "record") -> DataFrame:
    """For each distinct record, by ``order`` and digest: number (of its first copy, from 0), the order columns, times, start and end (offsets of the
    first copy's begin and the last one's end), digest, and nodes: for each level the hash that names the node above it."""
    spark = records.sparkSession
    rows = records.select(*order, F.sha2(record_col, 256).alias("digest"), F.octet_length(record_col).cast("long").alias("length"))
    same = rows.groupBy(*order, "digest", "length").agg(F.count(F.lit(1)).alias("times")).withColumn("h", F.xxhash64(*order, "digest"))
    placed = same.repartitionByRange(*order, "digest").sortWithinPartitions(*order, "digest").withColumn("id", F.monotonically_increasing_id())
    # The partition and the place in it, kept in a table so that both are the same whenever they are read.
    placed = written(placed, "leaves").withColumn("p", F.shiftright("id", 33))
    height = _height(sum(r["n"] for r in placed.groupBy().agg(F.count(F.lit(1)).alias("n")).collect()))
    levels = range(1, height)
    last = [F.max_by(F.when(_begins(F.col("h"), k), F.col("h")), F.when(_begins(F.col("h"), k), F.col("id"))).alias(f"l{k}") for k in levels]
    parts = placed.groupBy("p").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("length")).alias("bytes"), *last).orderBy("p").collect()
    # What stands before each partition: records, bytes and the node of each level that is open there (0: the first).
    before, n, size, nodes = [], 0, 0, [0] * len(levels)
    for r in parts:
        before.append((r["p"], n, size, list(nodes)))
        n, size = n + r["n"], size + r["bytes"]
        nodes = [old if r[f"l{k}"] is None else r[f"l{k}"] for k, old in zip(levels, nodes)]
    table = spark.createDataFrame(before, "p long, n0 long, b0 long, nodes0 array<bigint>")
    up_to = Window.partitionBy("p").orderBy("id")
    earlier = up_to.rowsBetween(Window.unboundedPreceding, -1)
    sums = {"n1": F.sum("times").over(earlier), "b1": F.sum(F.col("times") * F.col("length")).over(earlier)}
    opened = {f"l{k}": F.last(F.when(_begins(F.col("h"), k), F.col("h")), ignorenulls=True).over(up_to.rowsBetween(Window.unboundedPreceding, 0)) for k in levels}
    walked = placed.withColumns({**sums, **opened}).join(F.broadcast(table), "p")
    start = F.col("b0") + F.coalesce("b1", F.lit(0))
    # The root is one node whatever begins it.
    nodes = F.array(*[F.coalesce(F.col(f"l{k}"), F.get("nodes0", k - 1)) for k in levels], F.lit(0).cast("long"))
    return walked.select((F.col("n0") + F.coalesce("n1", F.lit(0))).alias("number"), *order, "times", start.alias("start"), (start + F.col("times") * F.col("length")).alias("end"), "digest", nodes.alias("nodes"))


def parents(children: DataFrame) -> DataFrame:
    """The nodes above leaves or nodes: start, end, digest, node (its name), nodes (names of those above it)."""
    times = F.col("times") if "times" in children.columns else F.lit(1).cast("long")
    child = F.array_sort(F.collect_list(F.struct("start", "digest", times.alias("times"))))
    up = children.groupBy(F.col("nodes")[0].alias("node")).agg(F.min("start").alias("start"), F.max("end").alias("end"), child.alias("c"), F.first(F.slice("nodes", 2, 64)).alias("nodes"))
    text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", (x["start"] - F.col("start")).cast("string"), x["times"].cast("string"), x["digest"])), ",")
    return up.select("start", "end", F.sha2(text, 256).alias("digest"), "node", "nodes")


def tree(leaf_table: DataFrame) -> list[DataFrame]:
    """All levels, from the records to the root, each written once."""
    top = leaf_table.agg(F.max(F.size("nodes"))).first()[0] or 0
    return reduce(lambda levels, _: [*levels, written(parents(levels[-1]), "level")], range(top), [leaf_table])


def _only(x: DataFrame, y: DataFrame, names: list[str]) -> DataFrame:
    """Rows of x that y has no equal of."""
    return x.join(y.select(*[F.col(n).alias(f"__{n}") for n in names]), reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names)), "left_anti")


def _children(level: DataFrame, bad: DataFrame | None) -> DataFrame:
    return level if bad is None else level.join(bad.select(F.col("node").alias("__up")), F.col("nodes")[0] == F.col("__up"), "left_semi")


def audit(a: list[DataFrame], b: list[DataFrame], order: list[str]) -> DataFrame:
    """Places where the replicas differ: number, the order columns, start_a, end_a, digest_a, times_a, and the same of b; found by descending from the roots."""
    bad_a = bad_b = None
    # Where the trees differ in height, the higher one's upper nodes all hold a difference, and only its lower levels are compared.
    height = min(len(a), len(b))
    for k in range(height - 1, 0, -1):
        x, y = _children(a[k], bad_a), _children(b[k], bad_b)
        bad_a, bad_b = written(_only(x, y, ["node", "digest"]), "bad"), written(_only(y, x, ["node", "digest"]), "bad")
        if bad_a.isEmpty() and bad_b.isEmpty():
            break
    leaf = [*order, "digest", "times"]
    x, y = _children(a[0], bad_a), _children(b[0], bad_b)
    side = lambda t, other, s: _only(t, other, leaf).select(*order, F.struct("number", "start", "end", "digest", "times").alias(s))
    both = side(x, y, "a").unionByName(side(y, x, "b"), allowMissingColumns=True)
    both = both.withColumn("digest", F.coalesce("a.digest", "b.digest"))
    # Equal records that differ in their number of times are one place; then a key's single records on either side.
    one = both.groupBy(*order, "digest").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    keys = one.groupBy(*order).agg(F.count_if(F.col("b").isNull()).alias("na"), F.count_if(F.col("a").isNull()).alias("nb"))
    same = reduce(lambda p, q: p & q, (F.col(f"o.{c}").eqNullSafe(F.col(f"k.{c}")) for c in order))
    told = one.alias("o").join(keys.alias("k"), same).select("o.*", ((F.col("na") == 1) & (F.col("nb") == 1) & (F.col("a").isNull() | F.col("b").isNull())).alias("paired"))
    pair = told.where("paired").groupBy(*order).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    found = told.where("not paired").select(*order, "a", "b").unionByName(pair)
    shown = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("start", "end", "digest", "times")]
    return found.select(F.coalesce("a.number", "b.number").alias("number"), *order, *shown)


def audit_tables(a: DataFrame, b: DataFrame, order: list[str]) -> DataFrame:
    """``audit`` of two tables of records (columns of ``order``, the records' key, and ``record``)."""
    return audit(*(tree(written(leaves(t, order), "replica")) for t in (a, b)), order)


class _Source:
    """Bytes of a file, unpacked as they are asked for; gzip files may be of one member or of one a record."""

    def __init__(self, content: bytes):
        self.raw, self.gzip, self.data, self.at = io.BytesIO(content), content[:2] == b"\x1f\x8b", b"", 0
        self.unpack = zlib.decompressobj(31) if self.gzip else None

    def _more(self) -> bytes:
        if not self.gzip:
            return self.raw.read(PIECE)
        while True:
            packed = self.unpack.unconsumed_tail or self.unpack.unused_data or self.raw.read(PIECE)
            if self.unpack.eof:
                if not packed.strip(b"\0"):
                    return b""
                self.unpack = zlib.decompressobj(31)
            if not packed:
                return b""
            try:
                out = self.unpack.decompress(packed, PIECE)
            except zlib.error:
                return b""  # what follows is damaged; the caller reports the gap
            if out:
                return out

    def need(self, n: int) -> bool:
        """Holds at least n bytes if the file has them."""
        parts, have = [self.data], len(self.data)
        while have < n and (more := self._more()):
            parts.append(more)
            have += len(more)
        self.data = b"".join(parts) if len(parts) > 1 else self.data
        return have >= n

    def skip(self, n: int) -> None:
        self.at, self.data = self.at + n, self.data[n:]

    def find(self, sign: bytes, start: int) -> int:
        """Place of the next sign, reading on until there is one; -1 at the end of the file."""
        while (k := self.data.find(sign, start)) < 0:
            start = max(start, len(self.data) - len(sign) + 1)
            if not self.need(len(self.data) + 1):
                return -1
        return k


def parse(content: bytes) -> Iterator[tuple[int, int, str, str, bytes]]:
    """Records of a WARC file, plain or gzip: offset, length (both in the unpacked file), type, target, payload.

    Bytes that are no record up to the next ``WARC/`` at a line's begin come as a row of the type ``damaged``, so that nothing is lost silently; so does a record
    whose file ends early.
    """
    source = _Source(content)
    while source.need(1):
        end = source.find(b"\r\n\r\n", 0) if source.need(5) and source.data.startswith(b"WARC/") else -1
        if end >= 0 and b"\nWARC/" in source.data[:end]:
            end = -1  # the header breaks off, and another record begins
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in source.data[:end].split(b"\r\n")[1:])} if end >= 0 else {}
        size = head.get(b"content-length", b"")
        if size.isdigit() and source.need(end + 4 + int(size)):
            begin, stop = end + 4, end + 4 + int(size)
            source.need(stop + 4)
            length = stop + 4 if source.data[stop : stop + 4] == b"\r\n\r\n" else stop
            yield source.at, length, head.get(b"warc-type", b"").decode("utf-8", "replace"), head.get(b"warc-target-uri", b"").decode("utf-8", "replace"), source.data[begin:stop]
        else:
            after = source.find(b"\nWARC/", 0)
            length = len(source.data) if after < 0 else after + 1
            yield source.at, length, "damaged", "", source.data[:length]
        source.skip(length)


_RECORDS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("url", pa.string()), ("payload", pa.binary())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (plain or gzip), in Spark's reader: path, offset and length (in the unpacked file), type, url, payload.

    A file is one task, as it is stored; it is unpacked piece by piece and leaves in batches of about BATCH_BYTES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                for r in parse(content):
                    rows.append((name, *r))
                    held += len(r[4])
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, offset long, length long, type string, url string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RECORDS)], schema=_RECORDS)
