"""Byte-level BPE by distinct words: each word of the corpus is encoded once, wherever it occurs.

Encoding. A task cuts texts into pre-tokens and deals them in blocks of about BLOCK characters: a block holds its documents' pre-tokens as positions in a
list of its own distinct words. The words of all blocks are shuffled by a hash of the word, so that equal words of all blocks meet in one task; each is
encoded once, and its ids go back to the blocks that asked (join by block). There the ids are put together by position. What crosses the network is each block's distinct
words, never a row for each pre-token, and each block's positions once, in compressed planes. A block's words with one hash travel in one row (fewer and larger rows than one a word,
and never more).

Decoding joins ids with the token-byte table, which has as many rows as the vocabulary, by gathering from it, and puts the bytes together in order.

No key is hot: a word has one row a block at most, so its rows are bounded by the blocks, and a block is bounded in characters (or is one document).

Defined results: a null text is empty and has no ids. Rows are encoded one by one: repeated rows give repeated results, null ids are carried. An empty table gives
an empty result. Other columns are not read. Ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

#: Characters of a block, about; pre-tokens of a document that are looked up at a time; words that are encoded at a time;
#: and encoded words that a task keeps before it begins anew.
BLOCK, PIECES, WORDS, KEPT = 12_000_000, 1 << 20, 20_000, 1_000_000

_loaded: dict[str, object] = {}


def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: token bytes to id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _encoder(path: str):
    """Encodes whole strings, each as a single pre-token."""
    if ("e", path) not in _loaded:
        import tiktoken

        _loaded["e", path] = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})
    return _loaded["e", path]


def _pattern(pattern: str):
    if ("p", pattern) not in _loaded:
        import regex

        _loaded["p", pattern] = regex.compile(pattern)
    return _loaded["p", pattern]


def _token_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens by id, end to end, and where each id's begin (and the end)."""
    if ("t", path) not in _loaded:
        table = ranks(path)
        size = max(table.values(), default=-1) + 1
        tokens = [b""] * size
        for token, k in table.items():
            tokens[k] = token
        starts = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int64)
        _loaded["t", path] = np.frombuffer(b"".join(tokens), dtype=np.uint8), starts
    return _loaded["t", path]


def planes(codes: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, the lowest first."""
    raw = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def from_planes(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, 4 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")


class _Block:
    """Documents whose pre-tokens are numbered by their own word list."""

    def __init__(self):
        self.code: dict[str, int] = {}
        self.docs: list = []
        self.sizes: list[int] = []
        self.codes: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc, text: str, pattern, pieces: int) -> None:
        code, n, before = self.code, len(self.codes), []
        found = pattern.finditer(text) if len(text) > pieces else None
        if found is None:
            lots = [pattern.findall(text)]
        else:  # a long text isn't held as one list of words
            lots = iter(lambda: [m.group() for _, m in zip(range(pieces // 8), found)], [])
        for words in lots:
            before += [w for w in set(words) if w not in code]
            for w in before:
                code[w] = len(code)
            before.clear()
            self.codes.append(np.fromiter(map(code.__getitem__, words), dtype=np.uint32, count=len(words)))
        self.docs.append(doc)
        self.sizes.append(sum(map(len, self.codes[n:])))
        self.chars += len(text)

    def row(self, block: int) -> pa.RecordBatch:
        """Frequent words get low numbers, which compress well."""
        codes, words = np.concatenate(self.codes) if self.codes else np.empty(0, np.uint32), list(self.code)
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        number = np.empty(len(words), dtype=np.uint32)
        number[order] = np.arange(len(words), dtype=np.uint32)
        sink = pa.BufferOutputStream()
        batch = pa.record_batch([pa.array([words[k] for k in order.tolist()], pa.large_string())], names=["word"])
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
        cols = [pa.array([block]), pa.array([self.docs], pa.list_(pa.int64())), pa.array([self.sizes], pa.list_(pa.int64()))]
        return pa.record_batch([*cols, pa.array([planes(number[codes])], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=_BLOCKS)


_BLOCKS = ["block", "docs", "sizes", "codes", "words"]


def _blocks(pattern: str, most: int, pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, now, cut = TaskContext.get().partitionId(), 0, _Block(), _pattern(pattern)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                now.add(doc, text.as_py() or "", cut, pieces)
                if now.chars >= most or len(now.docs) >= most // 100:
                    yield now.row(task << 32 | k)
                    k, now = k + 1, _Block()
        if now.docs:
            yield now.row(task << 32 | k)

    return run


def _words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks -> (part, block, codes, sizes, words): a block's words by the hash of the word, packed."""
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("words")):
                with pa.ipc.open_stream(data.as_buffer()) as stream:
                    words = [w.encode() for w in stream.read_all().column("word").to_pylist()]
                part = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % parts
                order = np.argsort(part, kind="stable")
                cuts = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)]
                for a in range(0, len(cuts) - 1, 64):
                    rows: tuple = ([], [], [], [], [])
                    for x, y in zip(cuts[a : a + 64], cuts[a + 1 : a + 65]):
                        own = [words[k] for k in order[x:y].tolist()]
                        sizes = np.fromiter(map(len, own), dtype=np.uint32, count=len(own))
                        if own:
                            for col, v in zip(rows, (int(part[order[x]]), block, planes(np.diff(order[x:y], prepend=0)), planes(sizes), pa.compress(b"".join(own), codec="zstd", asbytes=True))):
                                col.append(v)
                    n = pa.array([y - x for x, y in zip(cuts[a : a + 64], cuts[a + 1 : a + 65]) if y > x], pa.int64())
                    yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), n, *(pa.array(c, pa.binary()) for c in rows[2:])], names=_PACKED)

    return run


_PACKED = ["part", "block", "n", "codes", "sizes", "words"]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, block, n, codes, sizes, words) -> (block, n, codes, sizes, ids). All equal words are here; each is encoded once and kept."""
        encoder, kept = _encoder(path), {}
        for batch in batches:
            out_sizes, out_ids = [], []
            for row in batch.select(["n", "sizes", "words"]).to_pylist():
                ends = np.cumsum(from_planes(row["sizes"], row["n"]), dtype=np.int64).tolist()
                data = pa.decompress(row["words"], ends[-1], codec="zstd", asbytes=True)
                words = [data[x:y] for x, y in zip([0, *ends], ends)]
                new = [w for w in words if w not in kept]
                if len(kept) + len(new) > KEPT:
                    kept.clear()
                    new = words
                for a in range(0, len(new), WORDS):
                    lot = new[a : a + WORDS]
                    for w, ids in zip(lot, encoder.encode_ordinary_batch([w.decode() for w in lot], num_threads=1)):
                        kept[w] = np.array(ids, dtype="<u4").tobytes()
                found = [kept[w] for w in words]
                out_sizes.append(planes(np.fromiter(map(len, found), dtype=np.uint32, count=len(found)) // 4))
                out_ids.append(planes(np.frombuffer(b"".join(found), dtype="<u4")))
            yield pa.record_batch([batch.column("block"), batch.column("n"), batch.column("codes"), pa.array(out_sizes, pa.binary()), pa.array(out_ids, pa.binary())], names=["block", "n", "codes", "sizes", "ids"])

    return run


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def _assemble(key: tuple, found: pa.Table, blocks: pa.Table) -> pa.Table:
    """A block's positions with the ids of its words -> the ids of each document."""
    codes, sizes, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, "<u4")]
    for row in found.select(["n", "codes", "sizes", "ids"]).to_pylist():
        codes.append(np.cumsum(from_planes(row["codes"], row["n"]), dtype=np.int64))
        sizes.append(from_planes(row["sizes"], row["n"]).astype(np.int64))
        ids.append(from_planes(row["ids"], int(sizes[-1].sum())))
    code, listed, flat = np.concatenate(codes), np.concatenate(sizes), np.concatenate(ids)
    size, starts = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    size[code], starts[code] = listed, np.cumsum(listed) - listed
    out_docs, out_ids = [], []
    for row in blocks.select(["docs", "sizes", "codes"]).to_pylist():
        positions, at = from_planes(row["codes"], sum(row["sizes"])), 0
        for doc, n in zip(row["docs"], row["sizes"]):
            own, at = positions[at : at + n], at + n
            s = size[own]
            out_docs.append(doc)
            out_ids.append(flat[np.repeat(starts[own] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))].tobytes())
    return pa.table([pa.array(out_docs, pa.int64()), pa.array(out_ids, pa.binary())], schema=_IDS)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row: the text's ids as little-endian unsigned 32-bit integers, by the rank file ``path``; ``pattern`` cuts texts into pre-tokens.

    ``docs`` should be read from files or a written table: its blocks are numbered by partition, and a repeated task must meet the same rows.
    """
    arrow_batches(docs.sparkSession, 4000)
    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Both uses below read this one exchange.
    blocks = one.mapInArrow(_blocks(pattern, BLOCK, PIECES), "block long, docs array<long>, sizes array<long>, codes binary, words binary").repartition(n, "block")
    words = blocks.mapInArrow(_words(4 * n), "part long, block long, n long, codes binary, sizes binary, words binary")
    encoded = words.repartition(n, "part").mapInArrow(_encode(path), "block long, n long, codes binary, sizes binary, ids binary")
    return encoded.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_assemble, "doc_id long, ids binary")


def _decode(path: str, ids_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts = _token_table(path)
        for batch in batches:
            out = []
            for x in batch.column(ids_col):
                if (raw := x.as_py()) is None:
                    out.append(None)
                    continue
                parts = []
                for a in range(0, len(raw), 4 << 20):
                    ids = np.frombuffer(raw[a : a + (4 << 20)], dtype="<u4").astype(np.int64)
                    ids = ids[ids < len(starts) - 1]
                    size = starts[ids + 1] - starts[ids]
                    parts.append(data[np.repeat(starts[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes())
                out.append(b"".join(parts))
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the bytes of each row's ids (null for null); the token-byte table is bounded by the vocabulary. A column of that name is replaced."""
    arrow_batches(encoded.sparkSession, 4000)
    kept = encoded.drop("decoded")
    return kept.mapInArrow(_decode(path, ids_col), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", decoded binary")
