"""Fixtures with hand-derived results for mentions, linking, relations, coreference, domain rules, chunks and pages."""

import html as standard
import random
from html.entities import html5

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import chunk, classify, coref, domain, html, linking, ner, ontology, relations
from graphloom.plans import text_queries

TEXT = "John Smith, the CEO of TechCorp Inc, announced the new product launch in New York. The event featured Maria Garcia from Global Bank."


def test_rule_mentions(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.doc_id, r.text, r.type, r.start_char, r.end_char, r.confidence) for r in ner.extract(docs).orderBy("pos").collect()]
    assert got == [(1, "John", "PERSON", 0, 4, 0.7), (1, "TechCorp", "ORG", 23, 31, 0.8), (1, "Maria Garcia", "PERSON", 102, 114, 0.7)]


def test_linking(spark):
    rows = [("TechCorp", "ORG"), ("NY", "PLACE"), ("TechCorp", "PERSON"), ("John Smithson", "PERSON"), ("Globalization Partners", "ORG"), ("Berlin", "PLACE"), (None, "PLACE")]
    got = {(r.text, r.type): (r.linked_name, r.kb_confidence, r.match_type) for r in linking.link(spark.createDataFrame(rows, "text string, type string"), linking.seed_kb(spark)).collect()}
    assert got[("TechCorp", "ORG")] == ("TechCorp Inc", 0.95, "EXACT_MATCH")
    assert got[("NY", "PLACE")] == ("New York", 0.95, "EXACT_MATCH")
    assert got[("TechCorp", "PERSON")] == ("TechCorp", 0.0, "NO_MATCH")
    assert got[("John Smithson", "PERSON")] == ("John Smith", 0.7, "PARTIAL_MATCH")
    assert got[("Globalization Partners", "ORG")] == ("Global Bank", 0.7, "PARTIAL_MATCH")
    assert got[("Berlin", "PLACE")] == ("Berlin", 0.0, "NO_MATCH")
    assert len(got) == 7
    more = linking.add_to_kb(linking.seed_kb(spark), spark.createDataFrame([("Oslo", "PLACE", None, ["Kristiania"]), ("Tokyo", "PLACE", "p9", ["Edo"])], "canonical string, type string, id string, aliases array<string>"))
    assert more.count() == 13 and more.where("canonical = 'Tokyo'").first().id == "p9"


def test_alias_query(spark):
    d = "/root/testdata/sf0.001"
    got = {tuple(r) for r in text_queries.queries()["alias_resolve"](spark, d).collect()}
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{d}/part.parquet'")
    assert got == set(con.execute(text_queries.oracle_sql()["alias_resolve"]).fetchall()) and got


@pytest.mark.parametrize("gap, kept", [(29, True), (30, False), (49, False), (50, False)])
def test_nearness(spark, gap, kept):
    docs = spark.createDataFrame([(1, "A" + " " * gap + "B")], "doc_id long, text string")
    m = spark.createDataFrame([(1, 0, "A", "ORG", 0, 1), (1, 1, "B", "PERSON", 1 + gap, 2 + gap)], "doc_id long, pos int, text string, type string, start_char int, end_char int")
    near = relations.by_nearness(m).collect()
    assert len(near) == (gap < 50)
    strong = [r for r in near if r.confidence > relations.LEAST]
    assert bool(strong) == kept
    if kept:
        assert (strong[0].subject, strong[0].object, strong[0].relation, round(strong[0].confidence, 9)) == ("B", "A", "WORKS_FOR", 0.31)
    assert docs.count() == 1


def test_relations_join_patterns_and_sentences(spark):
    docs = spark.createDataFrame([(1, "Maria Garcia works for Global Bank. She left.")], "doc_id long, text string")
    m = spark.createDataFrame([(1, 0, "Maria Garcia", "PERSON", 0, 12), (1, 1, "Global Bank", "ORG", 23, 34)], "doc_id long, pos int, text string, type string, start_char int, end_char int")
    got = relations.extract(docs, m).collect()
    assert [(r.subject, r.object, r.relation, r.confidence) for r in got] == [("Maria Garcia", "Global Bank", "WORKS_FOR", 0.8)]


LONG = "Anna Berg of Acme Corp, in Paris. Anna Berg works for Acme Corp in the Paris Hall. Then Anna Berg, the Chief, met Bo Dahl from Acme Corp. In Paris Anna met staff Bo Dahl. Hall by Bo Dahl at Paris\nHall"


def brute_patterns(text, mentions):
    """(relation, whole match, pos of the first group's mention, pos of the second's)"""
    import re

    def fitting(want, kind):
        want = want.strip(" ").lower()
        fits = [(m[1].lower() != want, m[0]) for m in mentions if kind in ("ENTITY", m[2]) and (want in m[1].lower() or m[1].lower() in want)]
        return min(fits)[1] if fits else None

    out = []
    for relation, pattern, a, b in relations.PATTERNS:
        for m in re.finditer("(?i)" + pattern, text):
            x, y = fitting(m[1], a), fitting(m[2], b)
            if x is not None and y is not None and x != y:
                out.append((relation, m[0], *sorted((x, y))))
    return sorted(out)


def test_relations_of_long_texts_are_those_of_all_pairs(spark):
    docs = spark.createDataFrame([(1, LONG * 3), (2, None), (3, "No names in here"), (4, LONG)], "doc_id long, text string")
    rows, names = [], {}
    for i, text in ((1, LONG * 3), (4, LONG)):
        import re

        found = [(k, m[0], ("PERSON", "ORG", "PLACE")[len(m[0]) % 3], text.index(m[0])) for k, m in enumerate(re.finditer(r"[A-Z][a-z]*(?: [A-Z][a-z]*)*", text))]
        names[i] = found
        rows += [(i, *m, m[3] + len(m[1])) for m in found]
    m = spark.createDataFrame(rows, "doc_id long, pos int, text string, type string, start_char int, end_char int")
    near = [(r.doc_id, r.pos1, r.pos2) for r in relations.by_nearness(m).collect()]
    assert sorted(near) == sorted((x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and 0 < y[4] - x[5] < relations.NEAR) and near
    every = relations.by_sentence(docs, m)
    key = lambda df: sorted(map(str, ((r.doc_id, r.subject, r.object, r.relation, r.subject_type, r.object_type) for r in df.collect())))
    once = relations.by_sentence_once(docs, m)
    assert set(key(once)) == set(key(every)) and once.count() < every.count()
    best = lambda df: sorted((r.doc_id, r.subject, r.object, r.relation, r.pos1, r.pos2) for r in df.groupBy("doc_id", "subject", "object", "relation").agg(F.min(F.struct("pos1", "pos2")).alias("p")).select("*", "p.*").collect())
    assert best(once) == best(every)
    hits = relations.by_patterns(docs, m)
    for i, text in ((1, LONG * 3), (4, LONG)):
        got = sorted((r.relation, r.evidence, *sorted((r.pos1, r.pos2))) for r in hits.where(F.col("doc_id") == i).collect())
        assert got == brute_patterns(text, names[i]) and {"WORKS_FOR", "LOCATED_IN"} <= {r[0] for r in got}


def test_queries_over_whole_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    mentions = {(r.doc_id, r.pos): r.text for r in docs.select("doc_id", F.posexplode(T.phrases(F.col("text"))).alias("pos", "text")).collect()}
    chains = text_queries.queries()["doc_coref_greedy"](spark, d).select("doc_id", F.split("mentions", r"\|").alias("m")).collect()
    assert sorted((r.doc_id, t) for r in chains for t in r.m) == sorted((i, t) for (i, _), t in mentions.items())
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = text_queries.queries()["doc_rel_dedup"](spark, d).collect()
    assert len({(r.doc_id, r.subject, r.object, r.relation) for r in kept}) == len(kept) and all(r.subject in texts[r.doc_id] and r.object in texts[r.doc_id] for r in kept)
    assert {r.confidence for r in kept} >= {0.5, 0.8}  # sentences and patterns
    assert {"doc_rel_proximity", "doc_rel_sentence"} <= set(text_queries.queries())


def test_coreference(spark):
    text = "John Smith met Ann Lee. Smith said so.\nAcme Inc and Acme Corp."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    m = spark.createDataFrame([(1, 0, "John Smith", "PERSON"), (1, 1, "Ann Lee", "PERSON"), (1, 2, "Acme Inc", "ORG"), (1, 3, "Acme Corp", "ORG"), (1, 4, "Acme", "ORG")], "doc_id long, pos int, text string, type string")
    chains = coref.chains(coref.clusters(m, docs))
    got = {tuple(r.mentions): (r.canonical_entity, r.confidence) for r in chains.collect()}
    assert got == {("John Smith",): ("John Smith", 0.3), ("Ann Lee",): ("Ann Lee", 0.3), ("Acme Inc", "Acme Corp", "Acme"): ("Acme Corp", 0.9)}
    assert coref.same_as(chains).count() == 3
    assert {r.resolved_name for r in coref.resolved(m, chains).where("type = 'ORG'").collect()} == {"Acme Corp"}
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 9)], "n int").select(coref.confidence(F.col("n")).alias("c"))
    assert [r.c for r in sizes.collect()] == [0.3, 0.7999999999999999, 0.9, 0.95, 0.95]


def test_domain_rules(spark):
    rows = [(1, "a.b@c.io or +1 555 123 4567 knows python and JavaScript"), (2, "+1 555 123 4567 only"), (3, None)]
    got = {r.doc_id: r.entities for r in domain.extract(spark.createDataFrame(rows, "doc_id long, text string"), domain=F.lit("resume")).collect()}
    assert got[1][0].fields["email"] == "a.b@c.io" and got[1][0].fields["phone"] == "+1 555 123 4567" and got[1][0].confidence == 0.9
    assert [(e.id, e.source_text) for e in got[1][1:]] == [("skill_0", "Python"), ("skill_1", "Java"), ("skill_2", "JavaScript")]
    assert got[2] == [] and got[3] == []
    paper = domain.extract(spark.createDataFrame([(1, "doi 10.1000/xyz here")], "doc_id long, text string"), domain=F.lit("research_paper")).first()
    assert paper.entities[0].source_text == "10.1000/xyz" and paper.entities[0].confidence == 0.95
    fields = domain.schema_fields(spark)
    assert fields.count() == 102 and fields.select("domain", "entity_type").distinct().count() == 26
    rows = [("resume", "Person", {"name": "x"}), ("resume", "Person", {"email": "x"}), ("resume", "Nothing", {"name": "x"})]
    assert domain.validated(spark.createDataFrame(rows, "domain string, type string, fields map<string,string>")).count() == 1
    replies = ['```json\n{"a": 1}\n```', 'Sure: {"a": 1,}', "no", None]
    ok = spark.createDataFrame([(r,) for r in replies], "r string").select(domain.repaired_json(F.col("r")).isNotNull().alias("k"))
    assert [r.k for r in ok.collect()] == [True, True, False, False]


def test_classification(spark):
    rows = [(1, "Abstract\nmethodology and results, references", "x.txt"), (2, "nothing here", "my_cv.pdf"), (3, None, None), (4, "patient patient skills", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    rule = {r.doc_id: r for r in classify.classify(docs, "rule").collect()}
    assert rule[1].domain == "research_paper" and rule[1].confidence == 1.0
    assert (rule[3].domain, rule[3].confidence) == ("general", 0.5)
    assert rule[4].domain == "medical_document" and rule[4].confidence == 2 / 3
    mixed = {r.doc_id: r for r in classify.classify(docs, "hybrid", name=F.col("name")).collect()}
    assert mixed[2].filename_hint == "resume" and mixed[2].domain == "general"
    model = lambda df: df.select("doc_id", F.when(F.col("doc_id") == 1, "legal_document").otherwise("unknown").alias("domain"), F.lit(0.99).alias("confidence"))
    said = {r.doc_id: r for r in classify.classify(docs, "llm", model=model).collect()}
    assert (said[1].domain, said[1].confidence) == ("legal_document", 0.99) and said[2].domain == "general"


def spec_chunks(text):
    if len(text) <= 500:
        return [text] if text else []
    out, at = [], 0
    while at < len(text):
        end = at + 500
        if end < len(text):
            hit = next((k for k, c in enumerate(text[end : end + 100]) if c in ".!?"), None)
            end = end if hit is None else end + hit + 1
        out.append(text[max(0, at - (50 if at else 0)) : end].strip())
        at = end
    return [c for c in out if c]


def test_chunks(spark):
    texts = ["", None, "a" * 500, "b" * 501, "c" * 1000, "d" * 500 + ".x" + "d" * 200, "e" * 599 + "?" + "e" * 300, "f" * 600 + "!" + "f" * 300, "é. ü! " * 400, "  " * 600 + "z"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = chunk.chunks(docs).orderBy(F.col("doc_id").cast("long"), "metadata.chunk_index").collect()
    for k, t in enumerate(texts):
        mine = [r for r in rows if r.doc_id == str(k)]
        assert [r.text for r in mine] == spec_chunks(t or ""), k
        assert [r.metadata.chunk_index for r in mine] == list(range(len(mine))) and all(r.metadata.total_chunks == len(mine) for r in mine)


def test_pages(spark):
    page = """<HTML><head><TITLE>A <b>t</b> </TITLE><meta name="description" content="D"><meta content="no" name="keywords"><meta name="keywords" content="x, y">
    <script type="application/ld+json">{"a": 1}</script><script type="application/ld+json">{bad</script><script>var t="</p>";</script><style>p{}</style></head>
    <body><!-- c --><h1 class="z">One <i>two</i></h1><div itemscope>q</div>a&nbsp;b &amp;lt; c</body></HTML>"""
    r = html.parse(spark.createDataFrame([(1, "u", page), (2, None, None)], "page_id long, url string, html string")).orderBy("doc_id").collect()
    assert r[0].metadata.title == "A t" and r[0].metadata.description == "D" and r[0].metadata.keywords == ["x", "y"]
    assert r[0].structured_data.json_ld == ['{"a": 1}'] and r[0].structured_data.headers["h1"] == ["One two"] and len(r[0].structured_data.microdata) == 1
    assert "var t" not in r[0].content and "&lt; c" in r[0].content
    assert r[1].content == "" and r[1].metadata.keywords == []


def test_names(spark):
    one = spark.range(1).select(T.percent_encoded(F.lit("a b*c~é/")).alias("q"), T.pascal(F.lit("start_date of-X")).alias("p"), T.pascal(F.lit("")).alias("e")).first()
    assert (one.q, one.p, one.e) == ("a%20b%2Ac~%C3%A9%2F", "StartDateOfX", "Entity")


@pytest.mark.parametrize("values, want", [(["1", "2"], "integer"), (["1", "2.5"], "float"), (["true", "1"], "integer"), (['"x"', '"2024-01-31"'], "dateTime"), (['"2024-01-31"', "5"], "string"), (['"x"', "5", '"x"'], "integer"), (["5", '"2024-01-31"', '"2024-01-31"'], "dateTime"), (['"5"'], "string")])
def test_datatypes(spark, values, want):
    rows = spark.createDataFrame([(k, "some_field", v) for k, v in enumerate(values)] + [(9, "some_field", None)], "seq int, field string, value string")
    assert [tuple(r) for r in ontology.datatype_properties(rows).collect()] == [("hasSomeField", want)]


def test_ontology(spark):
    m = spark.createDataFrame([("PERSON", "pdf"), ("magic_thing", "pdf"), ("work_experience", "text"), (None, "text")], "type string, source_type string")
    assert [r["class"] for r in ontology.classes(m).collect()] == ["MagicThing"]
    assert {(r.source_type, r["class"]) for r in ontology.by_source(m.where("type is not null")).collect()} >= {("pdf", "Person"), ("combined", "WorkExperience")}
    up = {(r["class"], r.ancestor) for r in ontology.superclasses(spark).collect()}
    assert ("LegalDocument", "Entity") in up and ("LegalDocument", "Document") in up


def test_entities_are_those_of_the_standard(spark):
    """On strings of entities, halves of them and signs around them, against the standard library."""
    r = random.Random(7)
    names = list(html5)
    def piece():
        k = r.randint(0, 9)
        if k < 3:
            return "&" + (n := r.choice(names))[: r.choice([len(n), len(n), r.randint(1, len(n))])] + r.choice(["", ";", "x", " "])
        if k < 5:
            return f"&#{'0' * r.choice([0, 0, 1, 9])}{r.choice([r.randint(0, 300), r.randint(0, 0x120000), r.randint(0xD700, 0xE000), 10 ** 12])}" + r.choice(["", ";", "z"])
        if k < 7:
            return f"&#{r.choice('xX')}{'0' * r.choice([0, 0, 8])}{r.choice([r.randint(0, 300), r.randint(0, 0x120000), 0xFDD0, 0x1FFFF, 16 ** 9]):x}" + r.choice(["", ";", "g"])
        return r.choice(["&", "&&", "&#", "&#;", "&#x;", "&;", "& ", "&amp;", "&amp;lt;", "&lt;", "text", "é", "&nosuchname;", "&#39;", "&apos;"])
    texts = ["".join(piece() for _ in range(r.randint(0, 6))) for _ in range(10_000)] + ["&#0000000065;x", "&#x000000041;", "&#11;y", "", "&amp;&lt;&#39;", "&copy;&middot;&nbsp;"]
    got = spark.createDataFrame(enumerate(texts), "k int, t string").select("k", T.decoded(F.col("t")).alias("d")).collect()
    wrong = [(texts[x.k], x.d, standard.unescape(texts[x.k])) for x in got if x.d != standard.unescape(texts[x.k])]
    assert not wrong, wrong[:5]
