"""The register of all queries outside the llm subpackage: name, Spark plan, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.kg_views import ENTITY, KG, TableGraph
from . import build_queries, graph_queries, media_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]


def _graph_query(node) -> Query:
    return lambda spark, sf_dir: node.frame(TableGraph(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {name: _graph_query(node) for name, node in graph_queries.catalogue().items()} | text_queries.queries() | build_queries.queries() | media_queries.queries()


#: Written by hand, with the join on the document first: the generated text invites a join on the inequality alone.
COOCCURRENCE = f"""
WITH e AS (
  SELECT DISTINCT concat('{ENTITY}concept/', l_partkey::VARCHAR) AS entity, l_orderkey AS doc FROM lineitem
  UNION ALL SELECT concat('{ENTITY}relation/', l_orderkey::VARCHAR, '-', l_linenumber::VARCHAR), l_orderkey FROM lineitem)
SELECT a.entity AS entity1, b.entity AS entity2, count(*) AS "coOccurrenceCount"
FROM e a JOIN e b ON a.doc = b.doc AND a.entity < b.entity JOIN orders ON o_orderkey = a.doc
GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 20
"""


#: By hand, from the tables: what is extracted from document 1 are its order's parts and lines.
DOC_ENTITIES = f"""
SELECT concat('{ENTITY}concept/', p_partkey::VARCHAR) AS entity, p_name AS label, '{KG}Concept' AS type FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 1)
"""
DOC_RELATIONS = f"""
SELECT DISTINCT concat('{ENTITY}concept/', p_partkey::VARCHAR) AS subject, p_name AS "subjectName", '{KG}suppliedBy' AS predicate, concat('{ENTITY}org/', s_suppkey::VARCHAR) AS object, s_name AS "objectName"
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 1)
"""


def oracle_sql() -> dict[str, str]:
    by_hand = {"kg_cooccurrence": COOCCURRENCE, "api_doc_entities": DOC_ENTITIES, "api_doc_relations": DOC_RELATIONS}
    return {name: node.query() for name, node in graph_queries.catalogue().items()} | by_hand | text_queries.oracle_sql() | build_queries.oracle_sql() | media_queries.oracle_sql()
