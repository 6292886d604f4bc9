"""Versioned tables, the triple store and the chunk index: whole loads only, two writers, datatypes, and refreshes that touch what has changed."""

import pytest
from pyspark.sql import functions as F

from graphloom import api
from graphloom.operators import retrieval
from graphloom.operators.kg_views import KG
from graphloom.sources.chunk_index import ChunkIndex
from graphloom.sources.store import TripleStore
from graphloom.sources.versions import Conflict, VersionedTable

TRIPLES = "s string, p string, o string, o_kind string, o_dtype string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_version_is_whole_or_not_there(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path), "k int, v string, cell string", ("cell",))
    assert t.version() == 0 and t.read().count() == 0 and t.clean() == 0
    one = t.write(spark.createDataFrame([(1, "a", "x"), (2, "b", "007"), (3, "c", None)], "k int, v string, cell string"))
    assert t.read().count() == 0  # written, not committed
    assert t.commit(0, one) == 1 and rows(t.read()) == [(1, "a", "x"), (2, "b", "007"), (3, "c", None)]
    boom = F.udf(lambda k: 1 // (k - 2), "int")
    with pytest.raises(Exception):  # dies midway
        t.write(spark.range(1, 4).select(boom(F.col("id")).alias("k"), F.lit("z").alias("v"), F.lit("x").alias("cell")))
    assert t.version() == 1 and t.read().count() == 3
    two = t.write(spark.createDataFrame([(9, "z", "x")], "k int, v string, cell string"))
    assert t.commit(1, two, [["x"], [None]]) == 2
    assert rows(t.read()) == [(2, "b", "007"), (9, "z", "x")] and t.read(1).count() == 3 and rows(t.since(1)) == [(9, "z", "x")]
    with pytest.raises(Conflict):
        t.commit(1, two)
    assert t.clean() >= 0 and t.read().count() == 2
    assert t.write(spark.createDataFrame([], "k int, v string, cell string")) is None


def test_store_keeps_datatypes_and_sets(spark, tmp_path):
    s = TripleStore(spark, str(tmp_path))
    s.load('@prefix : <http://kg.example.org/ontology/> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n:a :age "7"^^xsd:integer ; :knows :b .\n', "g")
    assert {(r.o, r.o_dtype) for r in s.triples("g").collect()} == {("7", "http://www.w3.org/2001/XMLSchema#integer"), (KG + "b", None)}
    again = s.triples("g").select("s", "p", "o", "o_kind", "o_dtype")
    assert not s.load(again, "g") and s.table.version() == 1
    assert s.load(spark.createDataFrame([("x", "y", "z", "literal", None), ("x", "y", "z", "literal", None)], TRIPLES), "g", token="t1") and not s.load(again, "other", token="t1")
    assert s.triples().count() == 3 and s.triples(version=1).count() == 2
    assert s.delete(spark.createDataFrame([(KG + "a", KG + "age", "7", "literal")], "s string, p string, o string, o_kind string"), "g")
    assert not s.delete(spark.createDataFrame([("no", "no", "no", "iri")], "s string, p string, o string, o_kind string"), "g")
    assert {r.p for r in s.triples("g").collect()} == {KG + "knows", "y"}
    assert api.sparql(s.graph("g"), "SELECT ?x WHERE { ?x :knows ?y . }").count() == 1


def test_two_writers(spark, tmp_path, monkeypatch):
    """The slower one begins anew on what the faster one has written, and keeps the graph a set."""
    slow, fast = TripleStore(spark, str(tmp_path)), TripleStore(spark, str(tmp_path))
    slow.load(spark.createDataFrame([("a", "p", "1", "literal", None)], TRIPLES))
    commit, raced = slow.table.commit, []

    def late(*args, **kw):
        if not raced:
            raced.append(1)
            fast.load(spark.createDataFrame([("a", "p", "2", "literal", None), ("a", "p", "3", "literal", None)], TRIPLES))
        return commit(*args, **kw)

    monkeypatch.setattr(slow.table, "commit", late)
    slow.load(spark.createDataFrame([("a", "p", "2", "literal", None), ("a", "p", "4", "literal", None)], TRIPLES))
    assert sorted(r.o for r in slow.triples().collect()) == ["1", "2", "3", "4"] and slow.table.version() == 3
    assert slow.table.clean() == 0  # what the slower one wrote first is gone


def embed(chunks):
    return chunks.select("chunk_id", F.array(F.length("text").cast("float"), F.ascii("text").cast("float")).alias("embedding"))


def test_index_is_refreshed_where_texts_have_changed(spark, tmp_path):
    seen = []

    def counted(chunks):
        seen.append(chunks.count())
        return embed(chunks)

    docs = lambda *texts: spark.createDataFrame([(k, t, "s") for k, t in texts], "doc_id long, text string, source_type string")
    index = ChunkIndex(spark, str(tmp_path / "index"), buckets=4)
    first = docs(*((k, f"Text {k}. " * (k * 30)) for k in range(1, 9)), (20, None), (21, ""))
    assert index.refresh(first, counted) == {"changed": 10, "removed": 0}
    whole = rows(index.chunks())
    assert len(whole) == seen[-1] and {r.doc_id: r.chunk_count for r in index.stats().collect()}["20"] == 0
    files = sorted(str(p) for p in (tmp_path / "index").rglob("*"))
    assert index.refresh(first, counted) == {"changed": 0, "removed": 0} and len(seen) == 1
    assert sorted(str(p) for p in (tmp_path / "index").rglob("*")) == files  # nothing was written
    second = docs(*((k, f"Text {k}. " * (k * 30)) for k in range(2, 8)), (8, "new"), (9, "more"), (20, None))
    assert index.refresh(second, counted) == {"changed": 2, "removed": 2} and seen[-1] == 2
    ChunkIndex(spark, str(tmp_path / "other"), buckets=4).refresh(second, embed)
    assert rows(index.chunks()) == rows(ChunkIndex(spark, str(tmp_path / "other"), buckets=4).chunks())
    assert index.refresh(docs((9, "again")), counted, whole=False) == {"changed": 1, "removed": 0}
    assert index.chunks().where("doc_id = '9'").first().text == "again" and index.stats().count() == 9
    assert index.refresh(second, embed, rebuild=True)["changed"] == 9
    found = retrieval.vector_topk(index.chunks(), [3.0, 110.0], 1, "chunk_id")
    assert found.first().chunk_id == "8_chunk_0"


def test_index_follows_a_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    index = ChunkIndex(spark, str(tmp_path / "index"))
    read = lambda: spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    index.follow(read(), embed, str(tmp_path / "state")).awaitTermination()
    assert index.stats().count() == 2
    spark.createDataFrame([(2, "two"), (3, "three")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    before = index.table.version()
    index.follow(read(), embed, str(tmp_path / "state")).awaitTermination()
    assert index.stats().count() == 3 and index.table.version() == before + 1
