"""Chunks of at most about 500 characters that overlap by 50 and end at a sentence's end if one is near."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, REACH = 500, 50, 100


#: A window's text up to the next one: SIZE characters and, if one is within REACH, on to the end of the sentence; or what is left.
STRETCH = f"(?s).{{{SIZE}}}(?:[^.!?]{{0,{REACH - 1}}}[.!?])?|.{{1,{SIZE - 1}}}"


def chunk_texts(text: Column) -> Column:
    """The chunks of a text in order, without empty ones; a text of up to SIZE characters is one chunk as it is.

    One pass cuts the text into stretches; a chunk is its stretch with the last OVERLAP characters of the one before, which holds them all.
    """
    trimmed = lambda x: F.regexp_replace(x, r"^(?U)\s+|(?U)\s+$", "")
    before = lambda p, i: F.when(i > 0, F.right(F.get(p, i - 1), F.lit(OVERLAP))).otherwise("")
    joined = lambda p: F.transform(p, lambda x, i: trimmed(F.concat(before(p, i), x)))
    # A one-element array holds the stretches, so that they are cut once a text.
    many = F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(STRETCH), F.lit(0))), joined), 1)
    whole = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(F.length(text) <= SIZE, whole).otherwise(F.filter(many, lambda x: x != ""))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = None) -> DataFrame:
    """(chunk_id, doc_id, text, metadata(source_type, chunk_index, total_chunks))."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), (F.col(source_col) if source_col else F.lit(None).cast("string")).alias("s"), chunk_texts(F.coalesce(F.col(text_col), F.lit(""))).alias("c"))
    each = rows.select("doc_id", "s", F.size("c").alias("n"), F.posexplode("c").alias("i", "text"))
    meta = F.struct(F.col("s").alias("source_type"), F.col("i").alias("chunk_index"), F.col("n").alias("total_chunks"))
    return each.select(F.concat("doc_id", F.lit("_chunk_"), F.col("i").cast("string")).alias("chunk_id"), "doc_id", "text", meta.alias("metadata"))
