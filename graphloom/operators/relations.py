"""Relations between mentions of a document: by patterns, nearness and shared sentences; deduplicated.

Mentions: doc_id, pos, text, type, start_char, end_char, role (or null). Documents: doc_id, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .document_relations import MENTION, NEAR, PATTERNS, related

LEAST = 0.3


def relation_type(a: Column, b: Column, role_a: Column | None = None, role_b: Column | None = None) -> Column:
    """The type that two mention types suggest; HAS_ROLE where one is a person and the other has a role."""
    pair = lambda x, y: ((a == x) & (b == y)) | ((a == y) & (b == x))
    place = pair("PERSON", "PLACE") | pair("ORG", "PLACE") | pair("EVENT", "PLACE")
    out = F.when(pair("PERSON", "ORG"), "WORKS_FOR").when(place, "LOCATED_IN").when(pair("PERSON", "EVENT"), "PARTICIPATED_IN")
    if role_a is not None and role_b is not None:
        out = out.when(((a == "PERSON") & role_b.isNotNull()) | ((b == "PERSON") & role_a.isNotNull()), "HAS_ROLE")
    return out.otherwise("RELATED_TO")


def _with_role(mentions: DataFrame) -> DataFrame:
    return mentions if "role" in mentions.columns else mentions.withColumn("role", F.lit(None).cast("string"))


def _kind() -> Column:
    return relation_type(F.col("type1"), F.col("type2"), F.col("role1"), F.col("role2"))


def _pairs(mentions: DataFrame) -> DataFrame:
    """Ordered pairs are joined on the document and the block of NEAR characters in which the second begins; callers add the condition."""
    mentions = _with_role(mentions)
    side = lambda s, block: mentions.select("doc_id", block.alias("block"), *(F.col(c).alias(f"{c}{s}") for c in ("pos", "text", "type", "role", "start_char", "end_char")))
    block = lambda c: F.floor(F.col(c) / NEAR)
    return side(1, F.explode(F.array(block("end_char"), block("end_char") + 1))).join(side(2, block("start_char")), ["doc_id", "block"]).drop("block")


def _related(pairs: DataFrame, kind: Column, confidence: Column, evidence: Column) -> DataFrame:
    swap = (kind == "WORKS_FOR") & (F.col("type1") == "ORG") & (F.col("type2") == "PERSON")
    pick = lambda c, x, y: F.when(swap, F.col(f"{c}{y}")).otherwise(F.col(f"{c}{x}"))
    return pairs.select(
        "doc_id", pick("text", 1, 2).alias("subject"), pick("text", 2, 1).alias("object"), kind.alias("relation"), confidence.alias("confidence"),
        evidence.alias("evidence"), pick("type", 1, 2).alias("subject_type"), pick("type", 2, 1).alias("object_type"), "pos1", "pos2",
    )


def by_nearness(mentions: DataFrame) -> DataFrame:
    """Pairs of which the second begins up to NEAR characters after the first ends: joined by the document and blocks of NEAR characters."""
    gap = F.col("start_char2") - F.col("end_char1")
    near = _pairs(mentions).where((gap > 0) & (gap < NEAR))
    return _related(near, _kind(), F.lit(0.6) - gap / F.lit(100.0), F.lit("proximity"))


def by_sentence(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Pairs of different mentions that occur in one sentence, the earlier first."""
    each = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[.!?]+")).alias("sentence", "s"))
    held = _with_role(mentions).join(each, "doc_id").where(F.col("s").contains(F.col("text")))
    side = lambda k: held.select("doc_id", "sentence", "s", *(F.col(c).alias(f"{c}{k}") for c in ("pos", "text", "type", "role")))
    both = side(1).join(side(2).drop("s"), ["doc_id", "sentence"]).where(F.col("pos1") < F.col("pos2"))
    return _related(both, _kind(), F.lit(0.5), F.trim("s"))


def _lists(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with their mentions as a list, for ``documents.related``."""
    each = _with_role(mentions).where("doc_id is not null").groupBy(F.col("doc_id").alias("__d")).agg(F.collect_list(F.struct(*MENTION)).alias("mentions"))
    return docs.select("doc_id", "text").join(each, F.col("doc_id") == F.col("__d")).drop("__d")


def by_sentence_once(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """``by_sentence`` with each pair of (text, type) once a document, at its first places and in its first sentence."""
    return related(_lists(docs, mentions), ("sentences",), False).drop("seq")


def by_patterns(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Matches of PATTERNS whose two groups are mentions of the expected types: an exact text first, then the first partial one."""
    return related(_lists(docs, mentions), ("patterns",), False).drop("seq")


def deduplicated(relations: DataFrame) -> DataFrame:
    """The most confident of equal (doc_id, subject, object, relation); the first source and place of equals."""
    best = Window.partitionBy("doc_id", "subject", "object", "relation").orderBy(F.desc("confidence"), "seq", "pos1", "pos2")
    return relations.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "seq", "pos1", "pos2")


def extract(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """All relations with a confidence above 0.3, each once a document, with a context of 100 characters."""
    return extracted(_lists(docs, mentions))


def extracted(lists: DataFrame) -> DataFrame:
    """``extract`` for documents that hold their mentions as a list (MENTION): nothing is shuffled, as a document's relations are its own."""
    found = related(lists).where(F.col("confidence") > LEAST).drop("seq", "pos1", "pos2")
    return found.withColumn("context_snippet", F.substring("evidence", 1, 100))
