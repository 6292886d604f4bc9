"""Packing by power-of-two decomposition.

A document of n tokens (its ids and one end id) becomes n div 4096 pieces of 4096 and, for the rest, one piece for each set bit,
longest first. Every piece is a sequence of its own: no sequence crosses documents, and as each length is a power of two,
none is padded. Sequences of equal length form a bucket, from which batches are drawn.

Tokenisation goes by distinct words: the tokenizer splits at white space before anything else, so the ids of a text are
those of its chunks between spaces and newlines, one after another. A worker keeps the ids of the words it has seen.
No exchange is needed.

Defined results: a null text is an empty one (a single piece that holds the end id). Each row is packed, so repeated rows give
repeated pieces in sequences of their own. Null ids are carried. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

#: Tokens of the longest sequence, and the id that ends each document.
LONGEST, END = 4096, 2
#: Words whose ids a worker keeps, and words without the signs behind them that it keeps besides; a store is emptied when it is full.
KEPT_WORDS, KEPT_CORES = 700_000, 150_000
#: Bytes of text that are tokenised at a time.
SLICE = 5 << 20
#: Signs that can follow a word in a chunk and are cut off before words are looked up.
SIGNS = ".,;:!?#*$%&|()"
#: Texts that are not brought to lower case beforehand: with what may be a special token, or a mark that may be composed with a letter.
AS_THEY_ARE = "<\\||[\u0300-\u036f]"

_loaded: dict[str, tuple] = {}


def _ends_a_word(core: str) -> bool:
    """Whether the tokenizer sees a letter or digit last: its normaliser may leave a mark there, as for a capital I with a dot."""
    return unicodedata.normalize("NFC", core[-2:]).lower()[-1].isalnum()


class _Vocabulary:
    """Ids of words, as codes into one growing array."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # A task has one core; threads of the tokenizer's own would each keep memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size, dtype=bool)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[k] = token.endswith("</w>")
        self.empty()

    def empty(self) -> None:
        self.code: dict[str, int] = {}
        self.cores: dict[str, bytes] = {}
        self.ids = np.empty(1 << 20, dtype="<u4")
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.used = 0

    def _learn(self, cores: list[str]) -> None:
        """Ids of distinct strings. Those of letters only are one word to the tokenizer, with one id that ends a word, so many are
        tokenised as one text; the others one by one."""
        plain, other = [], []
        for c in cores:
            (plain if c.isalpha() else other).append(c)
        lots = [plain[k : k + 500] for k in range(0, len(plain), 500)]
        for lot, e in zip(lots, self.tokenizer.encode_batch([" ".join(x) for x in lots], add_special_tokens=False)):
            ids = e.ids
            cut = [0, *(np.flatnonzero(self.ends[np.array(ids, dtype=np.int64)]) + 1).tolist()]
            if len(cut) == len(lot) + 1:
                raw = np.array(ids, dtype="<u4").tobytes()
                self.cores.update(zip(lot, (raw[4 * x : 4 * y] for x, y in zip(cut, cut[1:]))))
            else:
                other += lot
        for c, e in zip(other, self.tokenizer.encode_batch(other, add_special_tokens=False)):
            self.cores[c] = np.array(e.ids, dtype="<u4").tobytes()

    def codes(self, words: list[str]) -> np.ndarray:
        """Codes of distinct words; those not met yet are tokenised."""
        if len(self.code) + len(words) > KEPT_WORDS and len(self.code):
            self.empty()
        new = [w for w in words if w not in self.code]
        if new:
            # ASCII signs after a letter or digit are a word of their own to the tokenizer (but for apostrophes).
            cut = [(core, w[len(core) :]) if (core := w.rstrip(SIGNS)) and (end := core[-1]).isalnum() and (end.isascii() or _ends_a_word(core)) else (w, "") for w in new]
            self._learn([c for c in {x for pair in cut for x in pair if x} if c not in self.cores])
            self.cores[""] = b""
            cores = self.cores
            found = [cores[a] + cores[b] if b else cores[a] for a, b in cut]
            k, sizes = len(self.code), np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
            total = int(sizes.sum())
            while k + len(new) + 1 > len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            self.ids[self.used : self.used + total] = np.frombuffer(b"".join(found), dtype="<u4")
            self.start[k + 1 : k + 1 + len(new)] = self.used + np.cumsum(sizes)
            self.used += total
            self.code.update(zip(new, range(k, k + len(new))))
            if len(cores) > KEPT_CORES:
                self.cores = {}
        return np.fromiter(map(self.code.__getitem__, words), dtype=np.int64, count=len(words))


def _vocabulary(path: str) -> _Vocabulary:
    if path not in _loaded:
        _loaded[path] = _Vocabulary(path)
    return _loaded[path]


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, each text's followed by END, and where each text's begin (and the end)."""
    vocabulary = _vocabulary(path)
    texts = pc.fill_null(texts, "")
    # Lower case is what the tokenizer's normaliser makes, after it has composed letters and marks; its special tokens are matched before that.
    texts = pc.if_else(pc.match_substring_regex(texts, AS_THEY_ARE), texts, pc.ascii_lower(texts))
    words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    flat = words.flatten()
    coded = flat.dictionary_encode()
    code = vocabulary.codes(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(flat) else np.empty(0, np.int64)
    size = vocabulary.start[code + 1] - vocabulary.start[code]
    per_text = np.concatenate([[0], np.cumsum(size)])[words.offsets.to_numpy() - words.offsets[0].as_py()]
    total = int(size.sum())
    at = np.repeat(vocabulary.start[code] - (np.cumsum(size) - size), size) + np.arange(total)
    n = len(texts)
    out = np.empty(total + n, dtype="<u4")
    own = np.repeat(np.arange(n), np.diff(per_text))
    out[np.arange(total) + own] = vocabulary.ids[at]
    starts = per_text + np.arange(n + 1)
    out[starts[1:] - 1] = END
    return out, starts


def pieces_of(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n tokens."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())]
)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE)))
        yield batch.slice(at, end - at)
        at = end


def _cut(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                ids, starts = token_ids(part.column("text"), path)
                rows: tuple = ([], [], [], [], [])
                for doc, a, b in zip(part.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
                    at = a
                    for length in pieces_of(b - a):
                        for col, v in zip(rows, (doc, at - a, length, ids[at : at + length].tobytes(), b - a)):
                            col.append(v)
                        at += length
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _OUT)], schema=_OUT)

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (binary, little-endian unsigned 32 bits), doc_tokens, sequence_id, offset
    and bucket (the binary logarithm of the length).

    Sequence ids are distinct numbers; with the partition in the upper bits they need no exchange and stay the same when a
    task is repeated.
    """
    arrow_batches(docs.sparkSession, 4000)
    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = one.mapInArrow(_cut(tokenizer_path), "doc_id long, start long, length long, ids binary, doc_tokens long")
    return cut.select(
        "*",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2(F.col("length").cast("double")).cast("int").alias("bucket"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes sequences with a folder for each length, so that a batch of equal sequences is one file's rows."""
    pieces.write.partitionBy("bucket").parquet(path)
