"""Sources and sinks: text, HTML, PDF and media files, JSON lines, Turtle, N-Triples, graph exports.

Decoders of binary formats are plug-ins: DataFrame functions from (path, content) to (path, text). All reading is by Spark's readers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_html

Decoder = Callable[[DataFrame], DataFrame]


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def read_text(spark: SparkSession, path: str, kind: str = "text") -> DataFrame:
    """One document a file: doc_id (the file's stem), type, content, file_path."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.input_file_name().alias("file_path"))
    return raw.select(stem(F.col("file_path")).alias("doc_id"), F.lit(kind).alias("type"), "content", "file_path")


def read_binary(spark: SparkSession, path: str, kind: str, decoders: list[Decoder] | None = None, pattern: str = "*") -> DataFrame:
    """Files whose text is that of the first decoder that gives any; without one the content is null. Also length and created_at."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    out = files.select(F.col("path"), F.lit(None).cast("string").alias("text"), "length", F.col("modificationTime").alias("created_at"))
    for decode in decoders or []:
        got = decode(files.select("path", "content")).select(F.col("path").alias("__p"), F.nullif(F.trim("text"), F.lit("")).alias("__t"))
        out = out.join(got, F.col("path") == F.col("__p"), "left").withColumn("text", F.coalesce("text", "__t")).drop("__p", "__t")
    return out.select(stem(F.col("path")).alias("doc_id"), F.lit(kind).alias("type"), F.col("text").alias("content"), F.col("path").alias("file_path"), "length", "created_at")


def key_frames(frames: Column, rate: Column) -> Column:
    """Numbers and seconds of about ten key frames among the first hundred of a video."""
    numbers = F.sequence(F.lit(0), F.greatest(F.least(frames, F.lit(100)) - 1, F.lit(0)), F.greatest(F.lit(1), F.floor(frames / 10).cast("int")))
    return F.when(frames > 0, F.transform(numbers, lambda i: F.struct(i.alias("frame_number"), (i / rate).alias("timestamp"))))


def parsed(raw: DataFrame) -> DataFrame:
    """Raw documents of any type to parsed ones (doc_id, type, content, source_type, created_at). HTML goes through its parser, all else is taken as text; missing
    columns are null, rows are never dropped."""
    has = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    kind, content = F.coalesce(has("type"), F.lit("text")), F.coalesce(has("content"), F.lit(""))
    text = F.when(kind == "html", clean_html(content)).otherwise(content)
    return raw.select(F.col("doc_id").cast("string").alias("doc_id"), kind.alias("type"), text.alias("content"), F.coalesce(has("source"), has("type")).alias("source_type"), has("created_at").cast("string").alias("created_at"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def ntriples(triples: DataFrame) -> DataFrame:
    """Lines of N-Triples, a column ``value``. Literals have their datatype (o_dtype, where there is such a column) unless it is string."""
    text = F.col("o")
    for sign, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(sign), F.lit(escaped))
    dtype = F.col("o_dtype") if "o_dtype" in triples.columns else F.lit(None).cast("string")
    typed = F.when(dtype.isNotNull() & ~dtype.endswith("#string"), F.concat(F.lit("^^<"), dtype, F.lit(">"))).otherwise(F.lit(""))
    o = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), text, F.lit('"'), typed))
    return triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples(triples).write.mode("overwrite").text(path)


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, o_kind, o_dtype) of Turtle files (prefixes, a, ; and , lists; blank nodes are skipped); a file is parsed where it is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame(parse_typed(text), columns=["s", "p", "o", "o_kind", "o_dtype"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "s string, p string, o string, o_kind string, o_dtype string").distinct()


def parse_turtle(text: str) -> list[tuple[str, str, str, str]]:
    """(s, p, o, kind of o)."""
    return [r[:4] for r in parse_typed(text)]


def parse_typed(text: str) -> list[tuple[str, str, str, str, str | None]]:
    """(s, p, o, kind of o, datatype of a literal that has one)."""
    tokens = re.findall(r'"(?:[^"\\]|\\.)*"(?:\^\^\S+|@\w+)?|<[^>]*>|\[|\]|#[^\n]*|@prefix|[^\s;,.\[\]"]+(?:\.[^\s;,.\[\]"]+)*|[;,.]', text)
    prefixes: dict[str, str] = {}
    out, depth, statement = [], 0, []

    def name(t: str) -> tuple[str, str, str | None]:
        if t.startswith("<"):
            return t[1:-1], "iri", None
        if t.startswith('"'):
            value, end = t[1:].rsplit('"', 1)
            return value, "literal", name(end[2:])[0] if end.startswith("^^") else None
        if t == "a":
            return "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "iri", None
        p, colon, local = t.partition(":")
        return (prefixes.get(p, p + ":") + local, "iri", None) if colon else (t, "literal", None)

    for t in tokens:
        if t.startswith("#"):
            continue
        depth += (t == "[") - (t == "]")
        if depth or t == "]":
            if t == "]":
                statement.append(None)
            continue
        if t != ".":
            statement.append(t)
            continue
        if statement[:1] == ["@prefix"]:
            prefixes[statement[1].rstrip(":")] = statement[2][1:-1]
        elif len(statement) > 2:
            s, p, k = name(statement[0])[0], None, 1
            while k < len(statement):
                x = statement[k]
                if x == ";":
                    p = None
                elif x != ",":
                    if p is None:
                        p = name(x)[0]
                    elif x is not None:
                        out.append((s, p, *name(x)))
                k += 1
        statement = []
    return out
