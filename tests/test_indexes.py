"""Look-ups by index against plain comparison of all pairs: partial links, names in texts, the first pairs of a join."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import coref, labelling, linking
from graphloom.operators.kg_views import KG, StoredGraph
from graphloom.plans.algebra import Join, Pairs, Union, match

WORDS = ["acme", "bell", "inc", "of", "the", "Corp", "x", "É", "new", "york", "", "north", "northern", "ab", "abc"]


def names(seed, n):
    r = random.Random(seed)
    out = {" ".join(r.choice(WORDS) for _ in range(r.randint(1, 4))) for _ in range(n)}
    return sorted(out | {"", " ", "a", "acme  acme", "ACME inc", "acmebell", "a b", "york new", "xyorkx", "the\tof"})


@pytest.mark.parametrize("seed", [1, 2])
def test_partial_links_are_those_of_all_pairs(spark, seed):
    kb = spark.createDataFrame([(x, ("A", "B")[k % 2], f"id{k}", [], (k * 7) % 41) for k, x in enumerate(names(seed, 60))] + [(None, "A", "n", [], 0), ("acme", None, "m", [], 0)], "canonical string, type string, id string, aliases array<string>, ord int")
    asked = spark.createDataFrame([(x, t) for x in names(seed + 10, 90) for t in ("A", "B", "C")] + [(None, "A"), ("acme", None)], "text string, type string").distinct()
    got = {(r.text, r.type): (r.ord, r.canonical, r.id) for r in linking.partial_matches(asked, kb).collect()}
    a, b = F.lower("text"), F.lower("canonical")
    near = asked.join(kb.withColumnRenamed("type", "kb_type"), (F.col("type") == F.col("kb_type")) & (a.contains(b) | b.contains(a) | linking.fuzzy(F.col("text"), F.col("canonical"))))
    want = {(r.text, r.type): tuple(r.x) for r in near.groupBy("text", "type").agg(F.min(F.struct("ord", "canonical", "id")).alias("x")).collect()}
    assert got == want and len(want) > 50


@pytest.mark.parametrize("apart", [None, "org"])
@pytest.mark.parametrize("seed", range(3))
def test_first_pairs_are_those_of_all_pairs(spark, apart, seed):
    """With one value of ``apart`` that most rows have, several rows a person, and people without a partner."""
    r = random.Random(seed)
    rows = [(f"p{r.randint(0, 60):03}", f"n{r.randint(0, 2)}", f"l{r.choice('aaab')}", r.choice(["o0"] * 8 + ["o1", "o2", "o3"])) for _ in range(150)]
    triples = [x for k, (p, n, l, o) in enumerate(rows) for x in ((f"r{k}", KG + "p", p, "iri"), (f"r{k}", KG + "n", n, "iri"), (f"r{k}", KG + "l", l, "iri"), (f"r{k}", KG + "o", o, "iri"))]
    graph = StoredGraph(spark.createDataFrame(triples, "s string, p string, o string, o_kind string"))
    side = match("?r :p ?person", "?r :n ?name", "?r :l ?place", "?r :o ?org").select("person", "name", "place", "org")
    node = Pairs(side, ["place"], "person", "person1 name1 org1 person2 name2 org2 place".split(), 7, apart)
    every = [(a[0], a[1], a[3], b[0], b[1], b[3], a[2]) for a, b in itertools.product(rows, rows) if a[2] == b[2] and a[0] < b[0] and (apart is None or a[3] != b[3])]
    assert [tuple(x) for x in node.frame(graph).collect()] == sorted(every)[:7]
    assert "BroadcastNestedLoop" not in node.frame(graph)._jdf.queryExecution().toString()


def test_variables_without_a_value_agree_with_any(spark):
    """As in the tests of the standard: what an optional part left unbound is bound by a later one, and a pattern joins it to all."""
    import duckdb

    rows = [("a", "name", "A"), ("b", "name", "B"), ("a", "nick", "x"), ("a", "mbox", "m1"), ("b", "mbox", "m2"), ("c", "nick", "y"), ("u", "owner", "a"), ("v", "owner", "b"), ("x", "seen", "u"), ("y", "seen", "v")]
    rows = [(s, KG + p, o, "literal") for s, p, o in rows]
    graph = StoredGraph(spark.createDataFrame(rows, "s string, p string, o string, o_kind string"))
    con = duckdb.connect()
    con.execute("CREATE TABLE triples (s VARCHAR, p VARCHAR, o VARCHAR, o_kind VARCHAR)")
    con.executemany("INSERT INTO triples VALUES (?, ?, ?, ?)", rows)
    base = match("?who :name ?name").optional("?who :nick ?nick")
    cases = [
        (base.optional("?who :mbox ?nick").select("who", "nick"), {("a", "x"), ("b", "m2")}),
        (Join(base, match("?thing :owner ?who", "?nick :seen ?thing")).select("who", "nick", "thing"), {("a", "x", "u"), ("b", "y", "v")}),
        (Join(match("?thing :owner ?who", "?nick :seen ?thing"), base).select("who", "nick", "thing"), {("a", "x", "u"), ("b", "y", "v")}),
        (Join(Union([match("?who :nick ?nick"), match("?who :name ?name")]), match("?who :mbox ?box")).select("who", "nick", "box"), {("a", "x", "m1"), ("a", None, "m1"), ("b", None, "m2")}),
    ]
    for node, want in cases:
        got = [tuple(r) for r in node.frame(graph).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert sorted(con.execute(node.sql()).fetchall(), key=str) == sorted(want, key=str)
    with pytest.raises(ValueError):
        Join(base.select("nick"), match("?nick :seen ?thing")).frame(graph)


def test_pairs_are_ordered_by_their_first_row():
    with pytest.raises(ValueError):
        Pairs(match("?person :l ?place").select("person", "place"), ["place"], "person", ["place", "person2", "person1"], 5).sql()


def test_names_in_texts_are_those_of_all_pairs(spark):
    r = random.Random(4)
    alphabet = ["a", "b", "é", "漢", " ", "𝄞"]
    dictionary = {"".join(r.choice(alphabet) for _ in range(r.randint(1, 9))) for _ in range(80)} | {"long name " * 30, "", "ab" * 40}
    texts = [(k, "".join(r.choice(alphabet) for _ in range(r.randint(0, 200)))) for k in range(60)] + [(100, None), (101, ""), (102, "x" * 100 + "long name " * 31 + "ab" * 45), (103, "é" * 5000 + "ab漢")]
    names = spark.createDataFrame([(x, "T") for x in sorted(dictionary)] + [(None, "T")], "name string, kind string")
    docs = spark.createDataFrame([(k, t, "kept") for k, t in texts], "doc_id long, text string, place_of string")
    got = sorted((x.doc_id, x.name, x.place, x.place_of) for x in labelling.occurrences(docs, "text", names, "name").collect())
    assert got == sorted((k, n, t.find(n) + 1, "kept") for k, t in texts for n in dictionary if t and n and n in t)
    assert labelling.occurrences(docs, "text", names.where("name = ''"), "name").count() == 0
    assert labelling.occurrences(docs.where("false"), "text", names, "name").count() == 0


def naive_seeds(kind, names, text):
    """Each free name in turn compared with all free ones behind it."""
    seed = [-1] * len(names)
    for i in range(len(names)):
        if seed[i] < 0:
            for j in range(i, len(names)):
                if seed[j] < 0 and (i == j or coref.alike(kind, names[i], names[j], text)):
                    seed[j] = i
    return seed


@pytest.mark.parametrize("kind", ["PERSON", "ORG", "PLACE", None])
def test_coreference_by_index_is_that_of_all_pairs(kind):
    r = random.Random(11)
    parts = ["Ann", "ann", "Lee", "Berg", "Inc", "Corp", "Acme", "Ac", "me", "İ", "ß", "x.", ""]
    for _ in range(300):
        names = list(dict.fromkeys(" ".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(12)))
        text = "".join(r.choice([*names, " and ", ". ", "\n", "! ", "zz "]) for _ in range(r.randint(0, 40)))
        assert coref.seeds(kind, names, text) == naive_seeds(kind, names, text)


def test_coreference_of_many_mentions():
    """A document with 100,000 mentions of 30,000 names."""
    import time

    import pandas as pd

    r = random.Random(3)
    names = [f"N{k % 9000} S{k % 7000}" for k in range(30_000)]
    order = [r.choice(names) for _ in range(100_000)]
    text = "\n".join(f"{n} left." for n in order)
    for kind in ("PERSON", "ORG"):
        began = time.time()
        found = coref.cluster(pd.DataFrame({"doc_id": 1, "type": kind, "pos": range(len(order)), "text": order, "content": text}))
        assert len(found) == 100_000 and (found["seed"] <= found["pos"]).all() and time.time() - began < 60


def test_questions_at_once_are_answered_as_one_by_one(spark, monkeypatch):
    from graphloom.operators import retrieval

    r = random.Random(9)
    say = lambda n: " ".join(r.choice(["Acme", "opened", "a", "branch", "in", "Rome", "the", "É", "x"]) for _ in range(n))
    docs = spark.createDataFrame([(k, say(r.randint(0, 12))) for k in range(80)] + [(100, None), (None, "Acme"), (101, "  Acme\tacme ")], "doc_id long, text string")
    asked = [(k, say(r.randint(1, 5))) for k in range(7)] + [(8, None), (9, " "), (10, "nowhere"), (None, "Acme")]
    for blocks in (1000, 3):
        monkeypatch.setattr(retrieval, "QUESTIONS", blocks)
        got = {(x.question, x["rank"]): (x.doc_id, round(x.score, 6)) for x in retrieval.bow_topk(docs, spark.createDataFrame(asked, "question long, text string"), 4).withColumnRenamed("id", "doc_id").collect()}
        want = {(str(q), n): (x.doc_id, round(x.score, 6)) for q, t in asked if q is not None and t for n, x in enumerate(retrieval.bow_search(docs.where("doc_id is not null"), t, 4).collect(), 1)}
        assert got == want
