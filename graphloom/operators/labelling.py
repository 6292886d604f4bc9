"""Ground-truth labelling of generated texts: entities by dictionary, relations of the form "NAME, the ROLE of ORG".

Names are looked for in one scan of the texts, however many there are. Two bitmaps of a fixed size go to all tasks: the hashes of the names' first bytes, and those of whole names by length.
A task hashes the beginning at every place of a text; only where that is some name's, it hashes the longer stretches, one for each length that names have. What falls on a name's bit is passed on
as text and joined with the names, so that hits are exact and the dictionary is never sent anywhere whole. Short texts are searched end to end, many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bitmaps import bitmap, holds

#: Bytes of a name's beginning; binary logarithm of the bits of each bitmap; bytes of text that are searched at a time.
HEAD, BITS, PART = 4, 24, 4 << 20

_U = np.uint64
_BASE = _U(0x5851F42D4C957F2D)


def _mixed(h: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ _U(length)) * _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(29)
        return h * _U(0x94D049BB133111EB)


def _stretches(sums: np.ndarray, powers: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` bytes from each place, by polynomial prefix sums."""
    with np.errstate(over="ignore"):
        return _mixed(sums[at + length] - sums[at] * powers[length], length)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums h(k + 1) = h(k) * base + byte, for all k, and the powers of the base."""
    n = len(data)
    with np.errstate(over="ignore"):
        powers = np.full(n + 1, _BASE, dtype=_U)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        inverse = np.full(n + 1, _U(pow(int(_BASE), -1, 1 << 64)), dtype=_U)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum((data.astype(_U) + _U(1)) * inverse[1:], out=sums[1:])
        return sums * powers, powers


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name) -> (size, head, whole): bytes of a name, and the hashes of its beginning and of all of it; nothing for empty names."""
    for batch in batches:
        rows: tuple = ([], [], [])
        for name in batch.column("name").to_pylist():
            if data := (name or "").encode():
                sums, powers = _sums(np.frombuffer(data, dtype=np.uint8))
                zero = np.zeros(1, dtype=np.int64)
                for col, v in zip(rows, (len(data), *(int(_stretches(sums, powers, zero, k).view(np.int64)[0]) for k in (min(HEAD, len(data)), len(data))))):
                    col.append(v)
        yield pa.record_batch([pa.array(c, pa.int64()) for c in rows], names=["size", "head", "whole"])


def _places(data: bytes, begins: np.ndarray, ends: np.ndarray, lengths: list[int], heads: np.ndarray, wholes: np.ndarray) -> dict[tuple[int, bytes], int]:
    """Stretches of texts that stand end to end (``begins`` and ``ends`` in bytes) that may be names: by text and stretch the first place."""
    raw = np.frombuffer(data, dtype=np.uint8)
    found: dict[tuple[int, bytes], int] = {}
    for begin in range(0, len(raw), PART):
        # A part goes on beyond its end, so that a name that begins in it is whole.
        part = raw[begin : begin + PART + lengths[-1]]
        sums, powers = _sums(part)
        starts = min(PART, len(raw) - begin)
        near: dict[int, np.ndarray] = {}
        for length in lengths:
            head = min(HEAD, length)
            if head not in near:
                at = np.arange(max(0, min(starts, len(part) - head + 1)))
                near[head] = at[holds(heads, _stretches(sums, powers, at, head))]
            at = near[head][near[head] + length <= len(part)]
            at = at[holds(wholes, _stretches(sums, powers, at, length))] + begin if len(at) else at
            rows = np.searchsorted(begins, at, side="right") - 1
            whole = at + length <= ends[rows]
            for row, k in zip(rows[whole].tolist(), at[whole].tolist()):
                found.setdefault((row, data[k : k + length]), k)
    return found


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts that follow one another, of PART bytes together or one longer text, with the number of the first."""
    first, group, size = 0, [], 0
    for k, text in enumerate(texts):
        data = (text.as_py() or "").encode()
        if group and size + len(data) > PART:
            yield first, group
            first, group, size = k, [], 0
        group.append(data)
        size += len(data)
    if group:
        yield first, group


def _searched(columns: list[str], lengths: list[int], heads, wholes, reach: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, all_ = (np.frombuffer(x.value, dtype=np.uint8) for x in (heads, wholes))
        for batch in batches:
            rows, places, names, after = [], [], [], []
            for number, texts in _groups(batch.column("__text")):
                data = b"".join(texts)
                ends = np.cumsum([len(t) for t in texts])
                begins = np.concatenate([[0], ends[:-1]])
                found = _places(data, begins, ends, lengths, first, all_)
                # Characters before each byte.
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)]) if found else None
                for (row, name), at in found.items():
                    try:
                        names.append(name.decode())
                    except UnicodeDecodeError:  # cut inside a character: no name
                        continue
                    rows.append(number + row)
                    places.append(int(chars[at] - chars[begins[row]]) + 1)
                    if reach is not None:
                        text, end = texts[row], at - int(begins[row]) + len(name)
                        stop = text.find(b".", end + reach) + 1
                        after.append(text[end : stop or end + reach].decode("utf-8", "ignore"))
            kept = batch.select(columns).take(pa.array(rows, pa.int64()))
            more = [pa.array(after, pa.string())] if reach is not None else []
            yield pa.record_batch([*kept.columns, pa.array(names, pa.string()), pa.array(places, pa.int32()), *more], names=[*columns, "__name", "place", *["after"] * len(more)])

    return run


def occurrences(texts: DataFrame, text: str, names: DataFrame, name: str, reach: int | None = None) -> DataFrame:
    """The rows of ``texts`` but for the text, with each row of ``names`` whose name the text holds, and the first place of the name (``place``, from 1).

    With ``reach`` also what comes ``after`` the name: so many bytes at least, and on to the next full stop. Empty and null names are held by no text. Texts are read once; ``names`` are joined by the name, and should not have columns of ``texts``.
    """
    spark = texts.sparkSession
    hashed = names.select(F.col(name).alias("name")).distinct().mapInArrow(_hashed, "size long, head long, whole long")
    # The lengths that names have are few; of n bytes of names at most the root of 2n.
    lengths = sorted(r[0] for r in hashed.select("size").distinct().collect())
    kept = [c for c in texts.columns if c != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*kept).schema.fields), "__name string", "place int", *["after string"] * (reach is not None)])
    if not lengths:
        return spark.createDataFrame([], schema).join(names, F.col("__name") == F.col(name)).drop("__name")
    heads, wholes = (spark.sparkContext.broadcast(bitmap(hashed, c, BITS)) for c in ("head", "whole"))
    found = texts.withColumnRenamed(text, "__text").mapInArrow(_searched(kept, lengths, heads, wholes, reach), schema)
    return found.join(names, F.col("__name") == F.col(name)).drop("__name")


def entities(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary rows (name, type) that occur in a text (doc_id, text), at their first place; events are title-cased."""
    hits = occurrences(docs.select("doc_id", "text"), "text", dictionary.select("name", "type"), "name")
    begin = F.col("place") - 1
    canonical = F.when(F.col("type") == "EVENT", F.initcap("name")).otherwise(F.col("name"))
    return hits.select("doc_id", F.col("name").alias("text"), "type", begin.alias("start_char"), (begin + F.length("name")).alias("end_char"), canonical.alias("canonical_name"))


def relations(docs: DataFrame, dictionary: DataFrame, roles: list[str]) -> DataFrame:
    """WORKS_FOR and HAS_ROLE of people whose first mention is followed, within 20 characters, by "the ROLE of ORG"."""
    people = dictionary.where("type = 'PERSON'").select(F.col("name").alias("person"))
    orgs = dictionary.where("type = 'ORG'").select(F.col("name").alias("org"))
    # To the first stop after "the ROLE of", wherever in its reach that begins (four bytes a character at most).
    near = occurrences(docs.select("doc_id", "text"), "text", people, "person", 4 * (27 + max(map(len, roles))))
    role = F.regexp_extract("after", r"^.{0,19}?the (" + "|".join(roles) + r") of ([^.]*)\.", 1)
    whom = F.regexp_extract("after", r"^.{0,19}?the (?:" + "|".join(roles) + r") of ([^.]*)\.", 1)
    said = near.withColumn("role", role).where("role <> ''").select("doc_id", "person", "role", whom.alias("whom"))
    found = occurrences(said, "whom", orgs, "org")
    each = F.explode(F.array(F.lit("WORKS_FOR"), F.lit("HAS_ROLE")))
    return found.select("doc_id", F.col("person").alias("subject"), F.col("org").alias("object"), each.alias("relation"), "role")
