"""Documents with extractions to a set of triples (s, p, o, o_kind, o_dtype), stored by predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pascal, percent_encoded
from .kg_views import DOCUMENT, ENTITY, KG, LABEL, TYPE

#: Classes of mention types and predicates of relation names (fixed values).
CLASSES = {"PERSON": "Person", "ORG": "Organization", "PLACE": "Place", "EVENT": "Event", "CONCEPT": "Concept"}
PREDICATES = {"WORKS_FOR": "worksFor", "LOCATED_IN": "locatedIn", "PARTICIPATED_IN": "participatedIn", "HAS_ROLE": "hasRole", "MENTIONS": "mentions"}
XSD = "http://www.w3.org/2001/XMLSchema#"
_SCHEMA = ("s", "p", "o", "o_kind", "o_dtype")


def doc_iri(doc_id: Column) -> Column:
    return F.concat(F.lit(DOCUMENT), percent_encoded(doc_id.cast("string")))


def entity_iri(kind: Column, name: Column) -> Column:
    """The same for the same type and name in any run, whatever the document."""
    return F.concat(F.lit(ENTITY), F.substring(F.sha2(F.concat_ws("|", kind, F.lower(name)), 256), 1, 32))


def _t(s: Column, p: str | Column, o: Column, kind: str = "literal", dtype: str = "string") -> Column:
    p = F.lit(p) if isinstance(p, str) else p
    values = (s, p, o.cast("string"), F.lit(kind), F.lit(XSD + dtype if kind == "literal" else None).cast("string"))
    return F.struct(*(v.alias(n) for n, v in zip(_SCHEMA, values)))


def _exploded(df: DataFrame, *triples: Column) -> DataFrame:
    return df.select(F.explode(F.array(*triples)).alias("t")).select("t.*").where("s is not null and p is not null and o is not null")


def document_triples(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, source_type, created_at."""
    s = doc_iri(F.col("doc_id"))
    return _exploded(
        docs, _t(s, TYPE, F.lit(KG + "Document"), "iri"), _t(s, LABEL, F.concat(F.lit("Document "), F.col("doc_id").cast("string"))), _t(s, KG + "hasText", F.col("text")),
        _t(s, KG + "sourceType", F.col("source_type")), _t(s, KG + "createdAt", F.col("created_at"), "literal", "dateTime"),
    )


def mention_triples(mentions: DataFrame) -> DataFrame:
    """mentions: doc_id, text, type, linked_name, and optionally role."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv]), F.col("type")), F.lit("Concept"))
    s, d = entity_iri(F.col("type"), F.col("linked_name")), doc_iri(F.col("doc_id"))
    alias = F.when(F.col("text") != F.col("linked_name"), F.col("text"))
    role = F.col("role") if "role" in mentions.columns else F.lit(None).cast("string")
    return _exploded(
        mentions, _t(s, TYPE, F.concat(F.lit(KG), kind), "iri"), _t(s, LABEL, F.col("linked_name")), _t(s, KG + "hasAlias", alias),
        _t(s, KG + "extractedFrom", d, "iri"), _t(d, KG + "mentions", s, "iri"), _t(s, KG + "hasRole", role),
    )


def domain_triples(entities: DataFrame) -> DataFrame:
    """entities: doc_id, type, id, fields map, confidence, source_text; a triple for each field."""
    name = F.coalesce(*[F.try_element_at("fields", F.lit(k)) for k in ("name", "title", "company", "institution", "description")], F.col("id"))
    s = F.concat(F.lit(ENTITY), percent_encoded(F.concat_ws("_", F.col("doc_id").cast("string"), "id")))
    d = doc_iri(F.col("doc_id"))
    base = _exploded(
        entities, _t(s, TYPE, F.concat(F.lit(KG), "type"), "iri"), _t(s, LABEL, name), _t(s, KG + "extractedFrom", d, "iri"), _t(d, KG + "mentions", s, "iri"),
        _t(s, KG + "hasConfidence", F.col("confidence"), "literal", "float"), _t(s, KG + "hasSourceText", F.col("source_text")),
    )
    each = entities.select(s.alias("e"), F.explode("fields").alias("k", "v"))
    return base.unionByName(_exploded(each, _t(F.col("e"), F.concat(F.lit(KG + "has"), pascal(F.col("k"))), F.col("v"))))


def chosen_entities(resolved: Column, extracted: Column, given: Column) -> Column:
    """The list of mentions that the graph is built from: the linked ones if there are any, else those that were extracted, or else given."""
    return F.when(F.size(resolved) > 0, resolved).otherwise(F.coalesce(extracted, given))


def relation_triples(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """relations: doc_id, subject, object, relation, confidence, evidence, by mention text. A direct triple, and a reified relation."""
    named = mentions.select("doc_id", "text", entity_iri(F.col("type"), F.col("linked_name")).alias("iri")).groupBy("doc_id", "text").agg(F.min("iri").alias("iri"))
    side = lambda n: named.select(F.col("doc_id").alias(f"d_{n}"), F.col("text").alias(f"t_{n}"), F.col("iri").alias(f"{n}_iri"))
    both = relations
    for n in ("subject", "object"):
        both = both.join(side(n), (F.col("doc_id") == F.col(f"d_{n}")) & (F.col(n) == F.col(f"t_{n}")))
    p = F.concat(F.lit(KG), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PREDICATES.items() for x in kv]), F.col("relation")), F.lit("relatedTo")))
    r = F.concat(F.lit(ENTITY + "relation/"), F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "subject_iri", "object_iri", "relation"), 256), 1, 32))
    a, b = F.col("subject_iri"), F.col("object_iri")
    role = F.col("relation") == "HAS_ROLE"
    return _exploded(
        both, _t(F.when(~role, a), p, b, "iri"), _t(F.when(role, a), p, F.col("object")), _t(r, TYPE, F.lit(KG + "Relation"), "iri"), _t(r, KG + "relationType", p, "iri"),
        _t(r, KG + "hasSubject", a, "iri"), _t(r, KG + "hasObject", b, "iri"), _t(r, KG + "hasRelation", a, "iri"), _t(r, KG + "relationWith", b, "iri"),
        _t(r, KG + "confidence", F.col("confidence"), "literal", "float"), _t(r, KG + "evidence", F.col("evidence")), _t(r, KG + "extractedFrom", doc_iri(F.col("doc_id")), "iri"),
    )


def graph(*parts: DataFrame) -> DataFrame:
    """The union of all parts as a set."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(list(_SCHEMA))


def stats(triples: DataFrame) -> DataFrame:
    """One row: triples, documents, entities and relations, in one pass."""
    of = lambda c: F.count(F.when((F.col("p") == TYPE) & (F.col("o") == KG + c), 1))
    typed = F.count(F.when(F.col("p") == TYPE, 1))
    return triples.agg(F.count(F.lit(1)).alias("triples"), of("Document").alias("documents"), of("Relation").alias("relations"), (typed - of("Document") - of("Relation")).alias("entities"))


def write(triples: DataFrame, path: str) -> None:
    triples.write.mode("overwrite").partitionBy("p").parquet(path)
