"""Entity mentions: a rule extractor, label mapping, and a plug-in point for models.

A mention is text, type, start_char, end_char, confidence, canonical_name, attributes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the rule extractor and the types of model labels (fixed values).
FIRST_NAMES = ("John", "Maria", "David", "Sarah", "Robert", "Lisa", "Michael", "Emily")
SURNAMES = ("Smith", "Garcia", "Chen", "Johnson", "Williams", "Brown", "Davis", "Wilson")
ORGANISATIONS = ("TechCorp", "Global Bank", "MediPharm", "EduFoundation")
LABELS = {"PERSON": "PERSON", "ORG": "ORG", "GPE": "PLACE", "LOC": "PLACE", "EVENT": "EVENT", "WORK_OF_ART": "CONCEPT"}


def mapped_type(label: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), label), F.lit("CONCEPT"))


def mention(text: Column, kind: Column, begin: Column, confidence: Column) -> Column:
    return F.struct(
        text.alias("text"), kind.alias("type"), begin.cast("int").alias("start_char"), (begin + F.length(text)).cast("int").alias("end_char"),
        confidence.alias("confidence"), text.alias("canonical_name"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("attributes"),
    )


def by_rules(text: Column) -> Column:
    """Single words from the name lists, with a surname that follows; offsets are those of the first place of the name."""
    words = F.array_remove(F.split(F.trim(text), r"(?U)\s+"), "")
    isin = lambda w, names: F.coalesce(w.isin(*names), F.lit(False))

    def one(w: Column, after: Column) -> Column:
        full = F.when(isin(after, SURNAMES), F.concat(w, F.lit(" "), after)).otherwise(w)
        return (
            F.when(isin(w, FIRST_NAMES), mention(full, F.lit("PERSON"), F.instr(text, full) - 1, F.lit(0.7)))
            .when(isin(w, ORGANISATIONS), mention(w, F.lit("ORG"), F.instr(text, w) - 1, F.lit(0.8)))
        )

    paired = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), one)
    return F.filter(paired, lambda m: m.isNotNull())


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, pos, text, type, ...) one row a mention, in order. ``model`` takes (id, text) and returns (id, label, text, start_char)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if model is not None:
        found = model(docs.select(id_col, text.alias("text")))
        made = mention(F.col("text"), mapped_type(F.col("label")), F.col("start_char"), F.lit(0.9))
        place = F.row_number().over(Window.partitionBy(id_col).orderBy("m.start_char", "m.end_char", "m.text")) - 1
        return found.select(id_col, made.alias("m")).select(id_col, place.alias("pos"), "m.*")
    return docs.select(id_col, F.posexplode(by_rules(text)).alias("pos", "m")).select(id_col, "pos", "m.*")
