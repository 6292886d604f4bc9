"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of 7 words, which are indexed by hash. Every rolling window of 7 words
probes the index: a repeat of 13 words holds at least one whole block of the document it repeats, so no repeat is missed.
Hits are extended to all windows of 13 words around them, which are compared by a 96-bit hash; what they cover is the
maximal exact repeat.

Nothing is exchanged row by row. Documents are dealt into buckets of bounded size by the hash of their content; for each
bucket and each part of the hash space one row is exchanged that holds the bucket's distinct hashes, sorted and as
differences. A passage that a third of all documents share is thus one entry a bucket, not one a document. The parts
reply to the buckets, first with the anchors that occur elsewhere, then with the smallest document of each window. It is one
plan, so that the dealt texts are exchanged once and read three times.

Defined results: null and empty texts have no words, and an empty kept text. Documents with the same id are not smaller than one
another, so repeated rows keep their words unless a smaller id has them. A null id is neither smaller nor larger than any other:
its row is returned unchanged. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches
from .rolling import chunks, inside, windows, word_hashes

#: Words of a repeat, and of an anchor: any window of WINDOW words holds a whole aligned block of ANCHOR words.
WINDOW, ANCHOR = 13, 7
#: Bytes of text in a bucket, about, and words for which the hash space has one part.
BUCKET_BYTES, PART_WORDS = 10 << 20, 3 << 20
#: Bits of an anchor's hash that are exchanged; an accidental match only costs a comparison of 13-word windows.
ANCHOR_BITS = 44
#: Stands for a null id.
NO_ID = -(2**63)

_U = np.uint64
_HOT, _MIN = 0, 1


def packed(sorted_values: np.ndarray) -> bytes:
    """Ascending uint64 as differences of the least number of whole bytes; first byte: that number."""
    if not len(sorted_values):
        return b"\0"
    steps = np.diff(sorted_values, prepend=_U(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    if not width:
        return np.empty(0, dtype=_U)
    raw = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(raw), 8), dtype=np.uint8)
    full[:, :width] = raw
    return np.cumsum(full.view("<u8").ravel(), dtype=_U)


def _texts(table: pa.Table) -> tuple[list[bytes], list[int | None]]:
    return [(x or "").encode() for x in table["text"].to_pylist()], table["doc_id"].to_pylist()


def _word_chunks(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]], np.ndarray, np.ndarray]]:
    """By chunks of texts: number of the first, words of each, their numbers, hashes of all words."""
    for a, b in chunks(texts):
        words = [t.split() for t in texts[a:b]]
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=b - a)
        yield a, words, lengths, word_hashes([w for ws in words for w in ws])


def _anchors(hashes: np.ndarray) -> np.ndarray:
    return windows(hashes, ANCHOR, 7) >> _U(64 - ANCHOR_BITS)


def _parts_of(values: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each part of the hash space begins in ascending values, and the end."""
    edges = np.array([min((k << bits) // parts, (1 << bits) - 1) for k in range(1, parts)], dtype=_U)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


def _probe(parts: int):
    """Bucket of documents -> per part its distinct anchors; lowest bits: 1 block of a document, 2 found twice or more here."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        texts, _ = _texts(table)
        found, blocks = [], []
        for _, _, lengths, hashes in _word_chunks(texts):
            h, ok = _anchors(hashes), inside(lengths, ANCHOR)
            first = np.repeat(np.cumsum(lengths) - lengths, lengths)[: len(h)]
            large = np.repeat(lengths >= WINDOW, lengths)[: len(h)] & ok
            found.append(h[large])
            blocks.append(h[large & ((np.arange(len(h)) - first) % ANCHOR == 0)])
        if not found:
            return _message([])
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        is_block = np.zeros(len(values), dtype=bool)
        is_block[np.searchsorted(values, np.concatenate(blocks))] = True
        coded = (values << _U(2)) | ((counts > 1).astype(_U) << _U(1)) | is_block.astype(_U)
        at = _parts_of(values, ANCHOR_BITS, parts)
        bucket = key[0].as_py()
        return _message([(k, bucket, packed(coded[at[k] : at[k + 1]])) for k in range(parts) if at[k + 1] > at[k]])

    return run


_MESSAGE = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])
_REPLY = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("data", pa.binary())])


def _message(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _MESSAGE)], schema=_MESSAGE)


def _reply(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _REPLY)], schema=_REPLY)


def _shared_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A part of the hash space: tells each bucket which of its anchors are a block somewhere and occur twice or more."""
    part, buckets = key[0].as_py(), table["bucket"].to_pylist()
    coded = [unpacked(x) for x in table["data"].to_pylist()]
    sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    every = np.concatenate(coded)
    values, flags = every >> _U(2), every & _U(3)
    order = np.argsort(values, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(values[order]) > 0]))
    n = np.add.reduceat(1 + (flags[order] >> _U(1)).astype(np.int64), first)
    block = np.bitwise_or.reduceat(flags[order] & _U(1), first) > 0
    hot = np.empty(len(values), dtype=bool)
    hot[order] = np.repeat((n > 1) & block, np.diff(np.append(first, len(values))))
    out, at = [], 0
    for bucket, size in zip(buckets, sizes):
        mine = values[at : at + size][hot[at : at + size]]
        at += size
        if len(mine):
            out.append((bucket, _HOT, part, packed(mine)))
    return _reply(out)


def _candidates(hashes: np.ndarray, lengths: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows that hold a shared anchor, with their 64-bit hashes and 32-bit checks."""
    none = np.empty(0, dtype=np.int64), np.empty(0, dtype=_U), np.empty(0, dtype=np.uint32)
    if len(hashes) < WINDOW or not len(hot):
        return none
    a = _anchors(hashes)
    at = np.minimum(np.searchsorted(hot, a), len(hot) - 1)
    hits = np.concatenate([[0], np.cumsum((hot[at] == a) & inside(lengths, ANCHOR))])
    ok = inside(lengths, WINDOW)
    n, reach = len(ok), WINDOW - ANCHOR + 1
    starts = np.flatnonzero(ok & (hits[reach : n + reach] > hits[:n]))
    if not len(starts):
        return none
    return starts, windows(hashes, WINDOW, 13)[starts], (windows(hashes, WINDOW, 31)[starts] >> _U(32)).astype(np.uint32)


def _hot(replies: pa.Table) -> np.ndarray:
    got = [(p, unpacked(d)) for k, p, d in zip(replies["kind"].to_pylist(), replies["part"].to_pylist(), replies["data"].to_pylist()) if k == _HOT]
    return np.concatenate([v for _, v in sorted(got, key=lambda x: x[0])]) if got else np.empty(0, dtype=_U)


def _ids(ids: list[int | None]) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in ids], dtype=np.int64)


_WINDOWS = np.dtype([("h", "<u8"), ("c", "<u4"), ("doc", "<i8")])


def _narrow(values: np.ndarray) -> bytes:
    """int64 as their least value and differences from it of the least number of whole bytes."""
    low = int(values.min()) if len(values) else 0
    off = values.astype(np.int64).view(_U) - np.array(low, dtype=np.int64).view(_U)
    width = max(1, (int(off.max()).bit_length() + 7) // 8) if len(values) else 1
    cut = np.ascontiguousarray(off.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return low.to_bytes(8, "little", signed=True) + bytes([width]) + cut.tobytes()


def _widened(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8, offset=9).reshape(-1, data[8])
    full = np.zeros((len(raw), 8), dtype=np.uint8)
    full[:, : data[8]] = raw
    return full.view("<u8").ravel().view(np.int64) + int.from_bytes(data[:8], "little", signed=True)


def _joined(*parts: bytes) -> bytes:
    return b"".join(x for p in parts for x in (len(p).to_bytes(4, "little"), p))


def _split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _packed_windows(w: np.ndarray) -> bytes:
    return _joined(packed(w["h"]), w["c"].tobytes(), _narrow(w["doc"]))


def _unpacked_windows(data: bytes) -> np.ndarray:
    h, c, doc = _split(data)
    h = unpacked(h)
    out = np.empty(len(h), dtype=_WINDOWS)
    out["h"], out["c"], out["doc"] = h, np.frombuffer(c, dtype="<u4"), _widened(doc)
    return out


def _smallest(h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Distinct windows, ascending by hash, each with its smallest document."""
    out = np.empty(len(h), dtype=_WINDOWS)
    order = np.lexsort((doc, c, h))
    out["h"], out["c"], out["doc"] = h[order], c[order], doc[order]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out["h"][1:] != out["h"][:-1]) | (out["c"][1:] != out["c"][:-1])
    return out[keep]


def _extend(parts: int):
    """Bucket of documents and its shared anchors -> per part the distinct windows around them with their smallest document."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, replies: pa.Table) -> pa.Table:
        hot = _hot(replies)
        if not len(hot) or not len(docs):
            return _message([])
        texts, ids = _texts(docs)
        ids, found = _ids(ids), []
        for a, words, lengths, hashes in _word_chunks(texts):
            starts, h, c = _candidates(hashes, lengths, hot)
            doc = np.repeat(ids[a : a + len(words)], lengths)[starts]
            found.append(_smallest(h[doc != NO_ID], c[doc != NO_ID], doc[doc != NO_ID]))
        every = np.concatenate(found)
        every = _smallest(every["h"], every["c"], every["doc"])
        at, bucket = _parts_of(every["h"], 64, parts), key[0].as_py()
        return _message([(k, bucket, _packed_windows(every[at[k] : at[k + 1]])) for k in range(parts) if at[k + 1] > at[k]])

    return run


def _smallest_documents(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A part of the hash space: tells each bucket which of its windows are in a smaller document elsewhere, and in which."""
    part, out = key[0].as_py(), []
    each = [(b, _unpacked_windows(d)) for b, d in zip(table["bucket"].to_pylist(), table["data"].to_pylist())]
    every = np.concatenate([w for _, w in each])
    least = _smallest(every["h"], every["c"], every["doc"])
    for bucket, w in each:
        at = _find(least, w["h"], w["c"])
        smaller = least["doc"][at] < w["doc"]
        if smaller.any():
            # The bucket knows its windows; their places in what it sent and the documents are enough.
            out.append((bucket, _MIN, part, _joined(packed(np.flatnonzero(smaller).astype(_U)), _narrow(least["doc"][at[smaller]]))))
    return _reply(out)


def _find(table: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Place of each (h, c) in a table ascending by both, all of them being there; ties of h are rare and walked through."""
    at = np.searchsorted(table["h"], h)
    while True:
        at = np.minimum(at, len(table) - 1)
        off = (table["h"][at] == h) & (table["c"][at] != c) & (at + 1 < len(table))
        if not off.any():
            return at
        at = at + off


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.list_(pa.int64())))]
)


def _remove(parts: int):
    """Bucket of documents and its replies -> kept texts and removed ranges of words."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, replies: pa.Table) -> pa.Table:
        texts, ids = _texts(docs)
        known, hot = _ids(ids), _hot(replies)
        spots = {}  # of each chunk, by its first text: starts, hashes, checks, documents
        for a, words, lengths, hashes in _word_chunks(texts) if len(hot) else ():
            starts, h, c = _candidates(hashes, lengths, hot)
            doc = np.repeat(known[a : a + len(words)], lengths)[starts]
            spots[a] = [x[doc != NO_ID] for x in (starts, h, c, doc)]
        least = np.empty(0, dtype=_WINDOWS)
        if spots:
            least = np.concatenate([_smallest(h, c, d) for _, h, c, d in spots.values()])
            least = _smallest(least["h"], least["c"], least["doc"])
            begin = _parts_of(least["h"], 64, parts)
            for kind, part, data in zip(*(replies[c].to_pylist() for c in ("kind", "part", "data"))):
                if kind == _MIN:
                    place, doc = _split(data)
                    least["doc"][begin[part] + unpacked(place).astype(np.int64)] = _widened(doc)
        return _kept(texts, ids, spots, least)

    return run


def _kept(texts: list[bytes], ids: list[int | None], spots: dict[int, list[np.ndarray]], least: np.ndarray) -> pa.Table:
    out = ([], [], [], [])
    for a, b in chunks(texts):
        words = [t.split() for t in texts[a:b]]
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=b - a)
        gone = np.zeros(int(lengths.sum()) + 1, dtype=np.int64)
        if len(least) and a in spots and len(spots[a][0]):
            starts, h, c, doc = spots[a]
            hit = starts[least["doc"][_find(least, h, c)] < doc]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + WINDOW, -1)
        covered = np.cumsum(gone)[:-1] > 0
        at = 0
        for ws in words:
            mine = covered[at : at + len(ws)]
            at += len(ws)
            n = int(mine.sum())
            out[0].append(len(ws))
            out[1].append(n)
            out[2].append((b" ".join(w for w, x in zip(ws, mine) if not x) if n else b" ".join(ws)).decode())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))) if n else []
            out[3].append([[int(x), int(y)] for x, y in zip(edge[::2], edge[1::2])])
    return pa.table([pa.array(ids, pa.int64()), *(pa.array(c, f.type) for c, f in zip(out, list(_OUT)[1:]))], schema=_OUT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed (long), kept_text (kept words joined by a space) and removed (ranges of words).

    Removed is each word covered by a window of 13 words that also starts in a document with a smaller id.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total = (size["b"] or 0) + size["n"]
    buckets, parts = max(1, -(-total // BUCKET_BYTES)), max(1, -(-(total // 6) // PART_WORDS))
    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = one.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)))
    message, reply = "part long, bucket long, data binary", "bucket long, kind int, part long, data binary"
    hot = dealt.groupBy("bucket").applyInArrow(_probe(parts), message).groupBy("part").applyInArrow(_shared_anchors, reply)
    spread = dealt.groupBy("bucket").cogroup(hot.groupBy("bucket")).applyInArrow(_extend(parts), message)
    least = spread.groupBy("part").applyInArrow(_smallest_documents, reply)
    replies = hot.unionByName(least)
    schema = "doc_id long, n_words long, n_removed long, kept_text string, removed array<array<bigint>>"
    return dealt.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(_remove(parts), schema)
