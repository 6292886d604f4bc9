"""The facade that a service would call: questions, SPARQL, pages of entities and relations, documents, index, analytics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import retrieval
from .operators.kg_views import DOCUMENT, KG
from .plans import graph_queries
from .plans.algebra import match
from .plans.sparql import sparql as parse

MOST = 1000


def sparql(graph, text: str) -> DataFrame:
    return parse(text).frame(graph)


def ask(graph, text: str) -> bool:
    return not sparql(graph, text).isEmpty()


def _name(kind: str) -> str:
    """A local name; anything else would change the query that it becomes part of."""
    if not re.fullmatch(r"\w+", kind):
        raise ValueError(f"not a name: {kind!r}")
    return kind


def entities(graph, kind: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """entity, label, type; ordered by label."""
    node = match(f"?entity a :{_name(kind)}", "?entity rdfs:label ?label").bind(type=f"'{KG}{kind}'") if kind else match("?entity a ?type", "?entity rdfs:label ?label").where(f"type LIKE '{KG}%'")
    return node.select("entity", "label", "type").top(["label"], min(limit, MOST), offset).frame(graph)


def relations(graph, kind: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    p = f":{_name(kind)}" if kind else "?predicate"
    node = match(f"?subject {p} ?object", "?subject rdfs:label ?subjectName", "?object rdfs:label ?objectName")
    node = node.bind(predicate=f"'{KG}{kind}'") if kind else node.where(f"predicate LIKE '{KG}%'")
    return node.select("subject", "subjectName", "predicate", "object", "objectName").top([], min(limit, MOST), offset).frame(graph)


def document(graph, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of one document."""
    iri = f"<{DOCUMENT}{doc_id}>"
    found = match(f"?subject :extractedFrom {iri}")
    links = match("?subject ?predicate ?object", "?subject rdfs:label ?subjectName", "?object rdfs:label ?objectName").where(f"predicate LIKE '{KG}%'")
    return match(f"?entity :extractedFrom {iri}", "?entity rdfs:label ?label", "?entity a ?type").frame(graph), match(found, links).frame(graph)


def analytics(graph, name: str) -> DataFrame:
    """A query of the catalogue by name."""
    return graph_queries.catalogue()[name].frame(graph)


def retrieve(graph, docs: DataFrame, question: str, top_k: int = 5, retriever: str = "hybrid") -> DataFrame:
    """Hits for a question. docs: doc_id, text. Retrievers: vector (bag of words), graph, hybrid, multimodal."""
    from pyspark.sql import Window

    found = retrieval.bow_search(docs, question, top_k).join(docs.select("doc_id", "text"), "doc_id")
    place = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) - 1
    text = found.select(F.col("text").alias("content"), "score", F.lit("text_chunk").alias("type"), F.lit("vector").alias("retriever"), place.alias("ord"))
    if retriever == "vector":
        return text
    hits = retrieval.graph_hits(graph, question, top_k)
    if retriever == "graph":
        return hits
    both = retrieval.hybrid([text, hits], 2 * top_k)
    return both.where(F.col("ord") < top_k) if retriever == "hybrid" else retrieval.diverse(retrieval.boosted(both, question), top_k)


def answer(graph, docs: DataFrame, question: str) -> DataFrame:
    """One row: question, answer, confidence; from facts about the question's entities, else from the most relevant texts."""
    names = retrieval.question_entities(question) or ["\x00"]
    facts = [(graph_queries.relation_facts(n).frame(graph), graph_queries.entity_facts(n).frame(graph)) for n in names]
    rel, ent = facts[0]
    for r, e in facts[1:]:
        rel, ent = rel.unionByName(r), ent.unionByName(e)
    return retrieval.answer(rel, ent, retrieval.local_search(docs, question), question)


def index(index, docs: DataFrame | None = None, embed=None, rebuild: bool = False) -> DataFrame:
    """Statistics of a chunk index; with documents (doc_id, text) after it was brought up to them, or made anew."""
    if docs is not None:
        index.refresh(docs, embed, rebuild=rebuild)
    return index.stats()
