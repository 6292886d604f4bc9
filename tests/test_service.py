"""The facade, the triple store and ground-truth labelling."""

from pyspark.sql import functions as F

from graphloom import api
from graphloom.operators import domain, labelling
from graphloom.operators.kg_views import KG, TableGraph
from graphloom.sources.store import TripleStore, report

SF = "/root/testdata/sf0.001"


def test_facade(spark):
    g = TableGraph(spark, SF)
    assert api.entities(g, "Organization", 5, 2).count() == 5 and api.entities(g, limit=3).columns == ["entity", "label", "type"]
    assert api.relations(g, "locatedIn", 4).count() == 4
    ents, rels = api.document(g, "1")
    assert ents.count() > 0 and rels.count() >= 0
    assert api.analytics(g, "kg_count_by_type").count() == 8
    assert api.ask(g, "ASK { ?x a :Person . }") and not api.ask(g, "ASK { ?x a :Nothing . }")
    docs = spark.createDataFrame([(1, "EUROPE is large"), (2, "nothing")], "doc_id long, text string")
    for kind in ("vector", "graph", "hybrid", "multimodal"):
        assert api.retrieve(g, docs, "Where is EUROPE", 3, kind).columns == ["content", "score", "type", "retriever", "ord"]
    row = api.answer(g, docs, "Where is EUROPE").first()
    assert row.confidence == 0.6 and "EUROPE" in row.answer


def test_store(spark, tmp_path):
    s = TripleStore(spark, str(tmp_path))
    assert not s.exists() and s.triples().count() == 0
    s.load("@prefix : <http://kg.example.org/ontology/> .\n:a a :Person ; :knows :b .\n", "one")
    s.load("@prefix : <http://kg.example.org/ontology/> .\n:a a :Person .\n", "two")
    s.load("@prefix : <http://kg.example.org/ontology/> .\n:a a :Person .\n", "two")
    assert s.exists() and s.triples().count() == 3 and s.triples("two").count() == 1
    assert api.sparql(s.graph("one"), "SELECT ?x WHERE { ?x a :Person . }").count() == 1
    s.delete(spark.createDataFrame([(KG + "a", KG + "knows", KG + "b", "iri")], "s string, p string, o string, o_kind string"), "one")
    assert s.triples("one").count() == 1
    r = report(s.triples(), files=2).first()
    assert (r.triples, r.entities, r.files) == (2, 2, 2)


def test_model_extraction(spark):
    docs = spark.createDataFrame([(1, "x@y.org", "resume"), (2, "x@y.org", "resume"), (3, "z", "general"), (4, "z", "legal_document")], "doc_id long, text string, domain string")
    reply = '{"entities": [{"type": "Person", "id": "p", "fields": {"name": "Ann"}, "confidence": 0.5}, {"type": "Person", "id": "q", "fields": {"email": "e"}}, {"type": "Nobody", "fields": {"name": "x"}}],}'
    model = lambda df: df.select("doc_id", F.when(F.col("doc_id") == 1, reply).otherwise("no JSON").alias("reply"))
    got = {r.doc_id: r.entities for r in domain.extract_with_model(docs, model).collect()}
    assert [(e.type, e.fields) for e in got[1]] == [("Person", {"name": "Ann"})]
    assert got[2][0].fields == {"email": "x@y.org"} and got[3] == [] and got[4] == []


def test_labelling(spark):
    text = "John Smith, the CEO of TechCorp Inc, announced it. At the product launch Maria Garcia from Global Bank spoke."
    docs = spark.createDataFrame([(1, text + " ok."), (2, None)], "doc_id long, text string")
    names = spark.createDataFrame([("John Smith", "PERSON"), ("Maria Garcia", "PERSON"), ("TechCorp Inc", "ORG"), ("Global Bank", "ORG"), ("product launch", "EVENT")], "name string, type string")
    got = {r.text: (r.start_char, r.canonical_name) for r in labelling.entities(docs, names).collect()}
    assert len(got) == 5 and got["product launch"] == (text.find("product launch"), "Product Launch")
    assert {(r.subject, r.object, r.relation, r.role) for r in labelling.relations(docs, names, ["CEO", "CTO"]).collect()} == {("John Smith", "TechCorp Inc", "WORKS_FOR", "CEO"), ("John Smith", "TechCorp Inc", "HAS_ROLE", "CEO")}
