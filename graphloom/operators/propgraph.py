"""Property graph: nodes (id, labels, properties) and edges (src, dst, type, properties) with keyed upserts and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kg_views import KG, LABEL, TYPE


def from_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed subjects are nodes, literals their properties; triples between nodes are edges."""
    short = F.regexp_extract("p", "([^/#]+)$", 1)
    types = triples.where((F.col("p") == TYPE) & F.col("o").startswith(KG))
    labels = types.groupBy(F.col("s").alias("id")).agg(F.array_sort(F.collect_set(F.substring("o", len(KG) + 1, 200))).alias("labels"))
    values = triples.where("o_kind = 'literal'").groupBy(F.col("s").alias("v"), short.alias("k")).agg(F.min("o").alias("o"))
    props = values.groupBy("v").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "o")))).alias("properties"))
    nodes = labels.join(props, F.col("id") == F.col("v"), "left").select("id", "labels", F.coalesce("properties", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("properties"))
    ids = labels.select("id")
    links = triples.where((F.col("o_kind") == "iri") & (F.col("p") != TYPE)).select(F.col("s").alias("src"), F.col("o").alias("dst"), short.alias("type"))
    edges = links.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
    return nodes, edges.withColumn("properties", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def _last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows of a key merged: of each property the value of the latest row."""
    entries = df.select(*keys, seq, F.explode_outer("properties").alias("k", "v"))
    latest = entries.groupBy(*keys, "k").agg(F.max_by("v", seq).alias("v"))
    pairs = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))
    return latest.groupBy(*keys).agg(F.map_from_entries(F.array_sort(pairs)).alias("properties"))


def upsert_nodes(nodes: DataFrame, seq: str = "seq") -> DataFrame:
    return _last_wins(nodes, ["id", "labels"], seq)


def upsert_edges(edges: DataFrame, nodes: DataFrame, seq: str = "seq") -> DataFrame:
    """Edges whose ends both exist, one for each (src, dst, type)."""
    ids = nodes.select("id").distinct()
    both = edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
    return _last_wins(both, ["src", "dst", "type"], seq)


def label_counts(nodes: DataFrame) -> DataFrame:
    """Nodes by their list of labels, joined by a comma."""
    return nodes.groupBy(F.array_join("labels", ",").alias("labels")).agg(F.count(F.lit(1)).alias("n"))


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def link_counts(links: DataFrame) -> DataFrame:
    """``relation_counts`` of links that were counted before: (p, n), several rows a predicate."""
    return links.groupBy(F.regexp_extract("p", "([^/#]+)$", 1).alias("type")).agg(F.sum("n").cast("long").alias("n"))


def all_labels(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("labels").alias("label")).distinct()


def neighbourhood(nodes: DataFrame, edges: DataFrame, per_label: int = 10) -> DataFrame:
    """For at most ``per_label`` nodes of each label (a top-k report) their outgoing and incoming edges as lists."""
    ranked = nodes.select(F.explode("labels").alias("label"), "id", "properties").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where(F.col("r") <= per_label).drop("r")
    some = ranked.select("id").distinct()
    side = lambda a, b, name: edges.join(some, F.col(a) == F.col("id")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("type", F.col(b).alias("other")))).alias(name))
    return ranked.join(side("src", "dst", "outgoing"), "id", "left").join(side("dst", "src", "incoming"), "id", "left")


def ping(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(1).alias("ok"))


def node_count(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("n"))


def detach_delete(nodes: DataFrame, edges: DataFrame, condition: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Without the nodes that meet a condition (all of them without one) and without the edges at them."""
    gone = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    ids = nodes.where(gone).select("id").distinct()
    left = edges.join(ids, F.col("src") == F.col("id"), "left_anti").join(ids, F.col("dst") == F.col("id"), "left_anti")
    return nodes.where(~gone), left


def collected(nodes: DataFrame, edges: DataFrame, kind: str, condition: Column, prop: str = "name") -> DataFrame:
    """(id, names): for nodes that meet a condition, a property of those that point to them by edges of one type, as a sorted list."""
    wanted = nodes.where(condition).select("id")
    names = nodes.select(F.col("id").alias("src"), F.col("properties")[prop].alias("name"))
    rows = edges.where(F.col("type") == kind).join(wanted, F.col("dst") == F.col("id")).select("id", "src").join(names, "src")
    return rows.groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("names"))


def visualisation(nodes: DataFrame, edges: DataFrame, per_label: int = 10) -> DataFrame:
    """(label, id, json): ``neighbourhood`` as JSON, with empty lists where there are no edges."""
    none = F.array().cast("array<struct<type:string,other:string>>")
    row = F.struct("id", "properties", F.coalesce("outgoing", none).alias("outgoing"), F.coalesce("incoming", none).alias("incoming"))
    return neighbourhood(nodes, edges, per_label).select("label", "id", F.to_json(row).alias("json"))


def property_literal(properties: Column) -> Column:
    """A map of names to JSON values as a Cypher literal: strings in single quotes, the rest as JSON."""
    text = lambda v: F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")
    value = lambda v: F.when(v.startswith('"'), F.concat(F.lit("'"), F.replace(text(v), F.lit("'"), F.lit("\\'")), F.lit("'"))).otherwise(v)
    each = F.transform(F.map_entries(properties), lambda e: F.concat(e["key"], F.lit(": "), value(e["value"])))
    return F.concat(F.lit("{"), F.array_join(each, ", "), F.lit("}"))


def career_path(edges: DataFrame, start: DataFrame, kind: str, hops: int = 2) -> DataFrame:
    """Paths of ``hops`` edges of one type from given nodes (id): n0, n1, ..."""
    out, step = start.select(F.col("id").alias("n0")), edges.where(F.col("type") == kind).select("src", "dst")
    for k in range(hops):
        out = out.join(step.withColumnsRenamed({"src": f"n{k}", "dst": f"n{k + 1}"}), f"n{k}")
    return out
