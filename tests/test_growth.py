"""What a round's findings asked for: results that stay the same where less is read, shuffled or paired."""

from __future__ import annotations

import types

from graphloom.operators import classify, coref, labelling, propgraph, retrieval
from graphloom.operators.kg_views import SAME, StoredGraph, TableGraph
from graphloom.plans import graph_queries
from graphloom.plans.algebra import Hinted, match


def test_documents_without_mentions_have_no_clusters(spark):
    docs = spark.createDataFrame([(k, "Ann Lee" if k % 2 else "none") for k in range(20)], "doc_id long, text string")
    mentions = spark.createDataFrame([(k, 0, "Ann Lee", "PERSON") for k in range(40) if k % 2], "doc_id long, pos int, text string, type string")
    assert sorted(map(tuple, coref.clusters(mentions, docs).collect())) == [(k, "PERSON", 0, "Ann Lee", 0) for k in range(20) if k % 2]


def _parts(spark, tmp_path, rows):
    """The smallest tables with other parts."""
    import os

    source = "/root/testdata/sf0.001"
    for name in os.listdir(source):
        if name != "part.parquet":
            os.symlink(f"{source}/{name}", tmp_path / name)
    like = spark.read.parquet(f"{source}/part.parquet")
    spark.createDataFrame([(k, n, "b", "t", 1, 1.0) for k, n in rows], like.schema).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    return TableGraph(spark, str(tmp_path))


def test_same_as_triples_are_counted_and_begun_without_pairs(spark, tmp_path):
    # Keys of several lengths and below zero, a key with two names, both of them shared, rows twice, rows without a key or a name.
    rows = [(k, f"n{k % 3}") for k in (*range(-12, 30, 2), 95, 100, 101, 9, 9)] + [(4, "n0"), (10, "n2"), (4, "n2"), (10, "n0"), (None, "n1"), (7, None)]
    graph = _parts(spark, tmp_path, rows)
    pairs = [(str(a), str(b)) for a, n in rows for b, m in rows if None not in (a, b, n) and n == m and a < b]
    assert [(x.n, x.subjects) for x in graph.same_set().collect()] == [(len(set(pairs)), len({a for a, _ in pairs}))]
    later = sorted((a, b) for a, b in pairs if a < b)
    for limit in (1, 3, 100):
        some = sorted({a for a, _ in later})[:limit]
        key = lambda x: x.rsplit("/", 1)[1]
        assert sorted((key(x.s), key(x.o)) for x in graph.first_same(limit).collect()) == [p for p in later if p[0] in some]
    triples = graph.scan()
    assert not triples.where("p like '%sameAs'").isEmpty() and graph.scan(but=SAME).where("p like '%sameAs'").isEmpty()
    links = propgraph.link_counts(graph.links())
    assert sorted(links.collect()) == sorted(propgraph.relation_counts(propgraph.from_triples(triples)[1]).collect())


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_of_other_kinds_and_entities_are_not_read(spark):
    g = TableGraph(spark, "/root/testdata/sf0.001")
    every = graph_queries.catalogue()
    # Lines as relations and as extractions have no label; words name few entities.
    assert "entity/relation/" not in _plan(every["api_relations_all"].frame(g)) and "entity/relation/" not in _plan(every["kg_provenance"].frame(g)) and "participatedIn" not in _plan(every["demo_person_org"].frame(g))
    for name in ("rag_entity_facts", "rag_relation_facts", "rag_entity_subgraph", "api_doc_relations"):
        assert " IN" in _plan(every[name].frame(g)), name


def test_narrowed_patterns_give_the_rows_of_stored_triples(spark):
    g = TableGraph(spark, "/root/testdata/sf0.001")
    stored = StoredGraph(g.scan().persist())
    for node in (*(graph_queries.catalogue()[n] for n in ("api_relations_all", "kg_relations_conf", "demo_person_org", "kg_provenance")), graph_queries.entity_facts("bolt"), graph_queries.entity_facts("nothing"),
                 graph_queries.relation_facts("bolt"), graph_queries.entity_subgraph("1")):
        assert list(map(tuple, node.frame(g).collect())) == list(map(tuple, node.frame(stored).collect()))
    few = match("?e rdfs:label ?n")
    for most in (1, 1000):  # more keys than are looked up, and fewer
        assert match(Hinted(few, "e", few, most=most), "?e a :Place").frame(g).count() == 30
    stored.triples.unpersist()


def test_more_entities_than_are_looked_up_are_sent_to_their_edges(spark, monkeypatch):
    g = TableGraph(spark, "/root/testdata/sf0.001")
    asked = lambda: (retrieval.graph_hits(g, "Where are Supplier#00000000 and NATION_1 now", 5), graph_queries.entity_subgraph("customer#00000001").frame(g))
    few = [list(map(tuple, df.collect())) for df in asked()]
    monkeypatch.setattr(Hinted.__init__, "__defaults__", (0, 1, 100_000))
    for df, rows in zip(asked(), few):
        assert "strategy=broadcast" in df._jdf.queryExecution().optimizedPlan().toString() and list(map(tuple, df.collect())) == rows
    monkeypatch.setattr(Hinted.__init__, "__defaults__", (0, 1, 2))
    for df, rows in zip(asked(), few):
        assert list(map(tuple, df.collect())) == rows


def test_texts_of_a_batch_are_searched_and_clustered_together(spark, monkeypatch):
    """Python does a bounded number of array passes for many short texts, and names do not reach from one text into the next."""
    import numpy as np
    import pyarrow as pa

    texts = ["", "Ann Le", "e Ann Lee", None, "é Ann Lee. x", "Lee", "Ann"] * 300
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "__text"])
    passes, sums = [], labelling._sums
    monkeypatch.setattr(labelling, "_sums", lambda data: passes.append(len(data)) or sums(data))
    ones = types.SimpleNamespace(value=bytes(np.full(4096, 255, dtype=np.uint8)))  # every stretch may be a name
    found = pa.Table.from_batches(labelling._searched(["doc_id"], [7], ones, ones, 3)(iter([batch]))).to_pylist()
    assert len(passes) == 1
    hits = [(r["doc_id"] % 7, r["place"], r["after"]) for r in found if r["__name"] == "Ann Lee"]
    assert sorted(set(hits)) == [(2, 3, ""), (4, 3, ". x")] and len(hits) == 600
    docs = spark.createDataFrame([(k, "Ann Lee came.\nann lee left; LEE slept.") for k in range(50)], "doc_id long, text string")
    mentions = spark.createDataFrame([(k, p, t, "PERSON") for k in range(60) for p, t in enumerate(("Ann Lee", "LEE", "Bo"))], "doc_id long, pos int, text string, type string")
    clusters = coref.clusters(mentions, docs)
    assert "FlatMapCoGroups" not in _plan(clusters)  # no call of Python for each document
    assert sorted((r.doc_id, r.pos, r.seed) for r in clusters.collect()) == [x for k in range(50) for x in ((k, 0, 0), (k, 1, 0), (k, 2, 2))]


def test_words_of_texts_and_questions_are_multiplied_in_bounded_parts():
    import tracemalloc

    import pyarrow as pa

    asked = [(str(q), [f"w{q}", "x"]) for q in range(500)]
    batch = pa.record_batch([pa.array(range(30_000)), pa.array([[f"w{k % 500}", "x" if k % 500 == 7 else "y"] for k in range(30_000)])], names=["id", "words"])
    tracemalloc.start()
    rows = [(r["question"], r["id"]) for b in retrieval._best(asked, 2)(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and {("7", 29_507), ("499", 29_999)} <= set(rows)


def test_linked_types_and_degrees_are_counted_by_keys(spark, tmp_path):
    """Keys twice and missing, and a text that is an entity's IRI; rows of the triples are the measure."""
    import os

    source = "/root/testdata/sf0.001"
    for name in os.listdir(source):
        if name not in ("part.parquet", "supplier.parquet"):
            os.symlink(f"{source}/{name}", tmp_path / name)
    like = spark.read.parquet(f"{source}/part.parquet")
    rows = [(k, "n", "http://kg.example.org/entity/org/1" if k in (1, 3) else "b", "t", 1, 1.0) for k in (1, 1, 2, 3, None)]
    spark.createDataFrame(rows, like.schema).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    suppliers = spark.read.parquet(f"{source}/supplier.parquet")
    suppliers.unionByName(suppliers.where("s_suppkey < 3")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    g = TableGraph(spark, str(tmp_path))
    stored = StoredGraph(g.scan().persist())
    for name in ("kg_cross_type", "kg_degree_topk", "api_relations_all"):
        node = graph_queries.catalogue()[name]
        assert list(map(tuple, node.frame(g).collect())) == list(map(tuple, node.frame(stored).collect())), name
    # No text of an IRI is made before rows are counted or joined, and first edges are asked for by their subjects.
    cross = _plan(TableGraph(spark, source).cross_types("http://kg.example.org/ontology/"))
    assert "entity/relation/" not in cross
    assert "inline(" not in _plan(g.ends("http://kg.example.org/ontology/")) and "<= http" in _plan(graph_queries.catalogue()["api_relations_all"].frame(g))
    stored.triples.unpersist()


def test_patterns_are_tried_where_their_texts_stand(spark):
    """A text's lower case is made once a method, and each pattern's cues stand in all that it matches."""
    import re

    from pyspark.sql import functions as F

    texts = {
        "skills? |x": None, r"\b(?:skills?|q[1-4])\b": ["skill", "q1", "q2", "q3", "q4"], r"\babstract\b.*?\n": ["abstract"], r"\breferences\b|\bbibliography\b": ["references", "bibliography"],
        r"\b(?:a?b|c)\b": None, r"(?:a|b)?c": None, r"(?:a|b)|c": None, r"(a|b)c": None, r"\b(?:clause|section)\s+\d+": ["clause", "section"], r"[ab]c": None, "ab[1-3]?": ["ab"],
    }
    texts["skills? |x"] = ["skill", "x"]
    assert {p: classify._cues(p) for p in texts} == texts
    assert all(classify._cues(p) for d in classify.DOMAINS for p in d.patterns)
    rows = ["Skills, SKILL; technical skills q3 Q5 skillset", "Abstract of\nabstract.\n", "section 12 SECTION x clause\t7", "cafémethod méthod methods methodé", "", None, "bibliography references"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id int, text string")
    found = {r.doc_id: r.s for r in docs.select("doc_id", classify.by_rules(F.coalesce("text", F.lit("")))["all_scores"].alias("s")).collect()}
    for k, t in enumerate(rows):
        want = {d.name: sum(len(re.findall(p, (t or "").lower())) for p in d.patterns) for d in classify.DOMAINS}
        assert found[k] == {n: c for n, c in want.items() if c}
    both = docs.select(classify.by_rules(F.col("text")).alias("r"), classify.by_keywords(F.col("text")).alias("k"))
    assert _plan(both).count("lower(") == 2


def test_names_repeated_at_one_place_make_each_near_pair_once():
    import random

    import pyarrow as pa

    from graphloom.operators import document_relations as dr

    pick = random.Random(3)
    names = [("Ann Lee", "PERSON", None, 0, 7), ("Acme", "ORG", None, 12, 16), ("Acme", "ORG", "employer", 12, 16), ("Oslo", "PLACE", None, 20, 24), ("Ann Lee", "PERSON", None, 30, 37), ("Nobody", None, None, None, None), ("Acme", "PLACE", None, 40, 44)]
    mentions = [(pos, *pick.choice(names)) for pos in range(400)]
    pick.shuffle(mentions)
    every = list(dr._of_document("", mentions, ("nearness",)))
    assert len(every) > 10_000 and len(list(dr._of_document("", mentions, ("nearness",), True))) <= len(names) ** 2
    best = {}
    for row in sorted(every, key=lambda r: (-r[3], r[9], r[7], r[8])):
        best.setdefault(row[:3], row)
    lists = pa.array([[dict(zip(dr.MENTION, m)) for m in mentions]], pa.list_(pa.struct([("pos", pa.int32()), ("text", pa.string()), ("type", pa.string()), ("role", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32())])))
    batch = pa.record_batch([pa.array([1]), pa.array([""]), lists], names=["doc_id", "text", "mentions"])
    (got,) = dr._run(("nearness",), True)(iter([batch]))
    assert sorted(map(str, (tuple(r.values())[1:] for r in got.to_pylist()))) == sorted(map(str, best.values()))


def test_set_of_triples_is_counted_by_keys(spark, tmp_path):
    """Rows twice, subjects with several objects, keys below zero and missing, a table without rows: the SQL's counts, and no IRI of a subject is made."""
    import os

    import duckdb

    from graphloom.operators import kg_views
    from graphloom.plans import text_queries

    source = "/root/testdata/sf0.001"
    lines = "SELECT if(l_linenumber = 7, NULL, l_orderkey) AS l_orderkey, l_partkey - 50 AS l_partkey, if(l_suppkey = 3, NULL, l_suppkey) AS l_suppkey, * EXCEPT (l_orderkey, l_partkey, l_suppkey) FROM {t}"
    made = {
        "lineitem": f"{lines} UNION ALL SELECT * FROM {{t}} WHERE l_partkey < 20 UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, NULL, * EXCEPT (l_orderkey, l_partkey, l_suppkey, l_linenumber) FROM {{t}} WHERE l_partkey < 40",
        "orders": "SELECT * FROM {t} UNION ALL SELECT o_orderkey, o_custkey + 1, * EXCEPT (o_orderkey, o_custkey) FROM {t} WHERE o_orderkey < 90 UNION ALL SELECT NULL, o_custkey, o_orderstatus, o_totalprice, NULL, NULL FROM {t} WHERE o_orderkey < 30",
        "part": "SELECT * FROM {t} UNION ALL SELECT p_partkey, p_name, 'other', NULL, p_size, p_retailprice FROM {t} WHERE p_partkey < 9 UNION ALL SELECT NULL, p_name, * EXCEPT (p_partkey, p_name) FROM {t} WHERE p_partkey < 5",
        "supplier": "SELECT * FROM {t} WHERE s_suppkey IS NULL",
    }
    con = duckdb.connect()
    for name in (f[:-8] for f in os.listdir(source)):
        if name in made:
            like = spark.read.parquet(f"{source}/{name}.parquet")
            spark.sql(made[name], t=like).select(*like.columns).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        else:
            os.symlink(f"{source}/{name}.parquet", tmp_path / f"{name}.parquet")
        path = f"{tmp_path}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if name in made else path}')")
    got = text_queries.triples_build(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(text_queries.SQL["triples_build"]).fetchall())
    assert got.dtypes == [("p", "string"), ("o_kind", "string"), ("n", "bigint"), ("subjects", "bigint")]
    assert not any(x in _plan(got) for x in (kg_views.ENTITY, kg_views.DOCUMENT))
    # Counts of rules add up, as their subjects differ, and each subject is made of keys alone.
    for k, (_, s, p, _, kind) in enumerate(kg_views.RULES):
        assert kg_views._columns(s)
        assert not any((p, kind) == (r[2], r[4]) and kg_views._meet(kg_views._begins(s), kg_views._begins(r[1])) for r in kg_views.RULES[k + 1 :])
