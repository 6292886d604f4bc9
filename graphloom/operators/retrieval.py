"""Retrieval: vector top-k, bag-of-words cosine, graph hits, hybrid and diverse merging, local relevance, template answers.

A hit is content, score, type (text_chunk or graph_relation), retriever, ord (its place in its retriever's list).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.algebra import Hinted, match, quoted

#: Words that end a phrase of a question, and words that make a question one about relations (fixed values).
STOP = ("what", "who", "where", "when", "why", "how", "does", "is", "are", "the")
RELATIONAL = ("relationship", "connected", "works with", "related to")
HIT = ("content", "score", "type", "retriever", "ord")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for unequal lengths or a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def vector_topk(vectors: DataFrame, query: list[float], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to one query vector (a literal in the plan), ties to the smaller id: a scan with a bounded heap a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(id_col, cosine(F.col(vector_col), q).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def bag_of_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sparse vectors of unit length: (id, term, w), over one vocabulary for all texts."""
    terms = docs.select(F.col(id_col), F.explode(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"\s+")).alias("term")).where("term <> ''")
    counts = terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).cast("double").alias("n"))
    norm = counts.groupBy(F.col(id_col).alias("__i")).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, F.col(id_col).eqNullSafe(F.col("__i"))).select(id_col, "term", (F.col("n") / F.col("norm")).alias("w"))


def bow_search(docs: DataFrame, question: str, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k texts nearest to a question by cosine of word counts, ties to the larger id; only the question's terms leave the scan."""
    asked = [w for w in question.lower().split() if w]
    terms = {w: asked.count(w) for w in asked}
    size = sum(n * n for n in terms.values()) ** 0.5 or 1.0  # a blank question has no terms and no rows
    words = F.array_remove(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"\s+"), "")
    counted = docs.select(F.col(id_col), F.explode(words).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).cast("double").alias("n"))
    weight = F.create_map(*[F.lit(x) for kv in terms.items() for x in (kv[0], float(kv[1]))]) if terms else F.lit(None).cast("map<string, double>")
    w = F.coalesce(F.try_element_at(weight, F.col("term")), F.lit(0.0))
    scored = counted.groupBy(id_col).agg((F.sum(F.col("n") * w) / (F.sqrt(F.sum(F.col("n") * F.col("n"))) * F.lit(size))).alias("score"))
    return scored.where("score > 0").orderBy(F.desc(F.round("score", 9)), F.desc(id_col)).limit(k)


#: Questions that are answered in one scan of the texts; their vectors are what is sent to tasks.
QUESTIONS = 1000
#: Numbers of a dense part of texts by terms, or by questions.
CELLS = 1 << 22


def _best(questions: list[tuple], k: int):
    """Scores Arrow batches of (id, words) against a block of questions (id, words) by one matrix product, and passes on the best k of each question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = {w: c for c, w in enumerate(dict.fromkeys(w for _, ws in questions for w in ws))}
        asked = np.zeros((len(column), len(questions)))
        for q, (_, ws) in enumerate(questions):
            np.add.at(asked, ([column[w] for w in ws], q), 1.0)
        asked /= np.maximum(np.sqrt((asked**2).sum(0)), 1e-300)
        # A part's counts and scores are dense, so it has as many rows as keep both at CELLS numbers.
        step = max(1, CELLS // max(len(column), len(questions), 1))
        for part in (batch.slice(at, step) for batch in batches for at in range(0, batch.num_rows, step)):
            ids, lists = part.column("id"), part.column("words")
            n, coded = part.num_rows, lists.flatten().dictionary_encode()
            names, lengths = coded.dictionary.to_pylist(), np.diff(lists.offsets.to_numpy())
            key, count = np.unique(np.repeat(np.arange(n), lengths) * max(len(names), 1) + coded.indices.to_numpy(), return_counts=True)
            doc, term = key // max(len(names), 1), key % max(len(names), 1)
            norm = np.sqrt(np.bincount(doc, count.astype(float) ** 2, minlength=n))
            place = np.array([column.get(w, -1) for w in names], dtype=np.int64)[term] if names else np.empty(0, np.int64)
            held = np.zeros((n, len(column)))
            held[doc[place >= 0], place[place >= 0]] = count[place >= 0]
            score = held @ asked / np.maximum(norm, 1e-300)[:, None]
            rank, rows, whose = np.round(score, 9), [], []
            order = np.argsort(np.argsort(ids.to_pandas().to_numpy(), kind="stable"))
            for q in range(len(questions)):
                some = np.flatnonzero(score[:, q] > 0)
                best = some[np.lexsort((-order[some], -rank[some, q]))[:k]]
                rows.append(best)
                whose.append(np.full(len(best), q))
            at, q = np.concatenate(rows), np.concatenate(whose)
            yield pa.record_batch([pa.array([questions[x][0] for x in q.tolist()]).cast(pa.string()), ids.take(pa.array(at)), pa.array(score[at, q])], names=["question", "id", "score"])

    return run


def bow_topk(docs: DataFrame, questions: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text", question_col: str = "question", asked_col: str = "text") -> DataFrame:
    """``bow_search`` for a table of questions: (question as a string, id, score, rank from 1), the k nearest texts of each.

    Texts are scanned once for QUESTIONS questions; a task keeps k rows a question and batch, of which the best are ranked. Null and empty questions have no rows.
    """
    words = lambda c: F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), "")
    asked = questions.select(F.col(question_col).cast("string").alias("q"), words(F.col(asked_col)).alias("ws")).where("q is not null and size(ws) > 0")
    blocks = max(1, -(-asked.count() // QUESTIONS))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    kind, out = dict(texts.dtypes)["id"], None
    for b in range(blocks):
        block = [(r["q"], list(r["ws"])) for r in asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()]
        if block:
            found = texts.mapInArrow(_best(block, k), f"question string, id {kind}, score double")
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"question string, id {kind}, score double, rank int")
    best = Window.partitionBy("question").orderBy(F.desc(F.round("score", 9)), F.desc("id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def question_entities(question: str) -> list[str]:
    """Runs of capitalised words of a question, without punctuation, also inside; stop words in any case end a run."""
    out: list[str] = []
    run: list[str] = []
    for word in [*question.split(), ""]:
        bare = re.sub(r"[^\w\s]", "", word)
        if bare[:1].isupper() and bare.lower() not in STOP:
            run.append(bare)
        elif run:
            out.append(" ".join(run))
            run = []
    return out


def vector_hits(found: DataFrame, chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Hits of scored ids (id, score) with the text of chunks (chunk_id, text)."""
    place = F.row_number().over(Window.orderBy(F.desc("score"), id_col)) - 1
    return found.join(chunks.select(F.col("chunk_id").alias(id_col), "text"), id_col).select(F.col("text").alias("content"), "score", F.lit("text_chunk").alias("type"), F.lit("vector").alias("retriever"), place.alias("ord"))


def graph_hits(graph, question: str, k: int = 5, per_word: int = 10) -> DataFrame:
    """Edges around entities named by the question's capitalised words of more than two letters; at most ``per_word`` each, equal contents once."""
    words = list(dict.fromkeys(w for w in question.split() if w[:1].isupper() and len(w) > 2))
    if not words:
        return graph.spark.createDataFrame([], "content string, score double, type string, retriever string, ord int")
    wanted = graph.spark.createDataFrame([(k_, w) for k_, w in enumerate(words)], "w int, word string")
    # A handful of literal words: a test each, not a join. The entities that they name are few as a rule, and known before edges are read.
    found = match("?entity rdfs:label ?entityName").where(" OR ".join(f"contains(lower(entityName), {quoted(w.lower())})" for w in words))
    edges = match("?entity ?relation ?related").where("relation LIKE 'http://kg.example.org/ontology/%'")
    near = match(match(Hinted(found, "entity", found), edges), "?related rdfs:label ?relatedName").frame(graph)
    each = near.join(F.broadcast(wanted), F.lower("entityName").contains(F.lower("word")))
    first = Window.partitionBy("w").orderBy("entityName", "relation", "relatedName", "entity", "related")
    rows = each.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_word)
    content = F.concat_ws(" ", "entityName", F.regexp_extract("relation", "([^/#]+)$", 1), "relatedName")
    once = rows.groupBy(content.alias("content")).agg(F.min(F.struct("w", "r")).alias("at"))
    place = F.row_number().over(Window.orderBy("at", "content")) - 1
    return once.withColumn("ord", place).where(F.col("ord") < k).select("content", F.lit(0.8).alias("score"), F.lit("graph_relation").alias("type"), F.lit("graph").alias("retriever"), "ord")


def hybrid(hits: list[DataFrame], k: int = 10) -> DataFrame:
    """The best k of several lists; of those with the same first 100 characters the best stays; earlier lists win ties."""
    every = None
    for n, h in enumerate(hits):
        h = h.select(*HIT).withColumn("src", F.lit(n))
        every = h if every is None else every.unionByName(h)
    order = [F.desc("score"), F.asc("src"), F.asc("ord")]
    same = Window.partitionBy(F.substring("content", 1, 100)).orderBy(*order)
    best = every.withColumn("r", F.row_number().over(same)).where("r = 1").orderBy(*order).limit(k)
    return best.select("content", "score", "type", "retriever", (F.row_number().over(Window.orderBy(*order)) - 1).alias("ord"))


def boosted(hits: DataFrame, question: str) -> DataFrame:
    """Graph hits gain 0.2, up to 1, for a question about relations."""
    gain = 0.2 if any(w in question.lower() for w in RELATIONAL) else 0.0
    return hits.withColumn("score", F.when(F.col("type") == "graph_relation", F.least(F.lit(1.0), F.col("score") + F.lit(gain))).otherwise(F.col("score")))


def diverse(hits: DataFrame, k: int = 10) -> DataFrame:
    """Half of k from each type first, then others by score; not sorted again (ord tells the order)."""
    half = max(1, k // 2)
    by_type = Window.partitionBy("type").orderBy(F.desc("score"), "ord", "content")
    block = F.when(F.col("r") > half, 2).when(F.col("type") == "text_chunk", 0).otherwise(1)
    ranked = hits.withColumn("r", F.row_number().over(by_type)).withColumn("b", block)
    place = F.row_number().over(Window.orderBy("b", F.desc("score"), "ord", "content")) - 1
    return ranked.withColumn("ord", place).where(F.col("ord") < k).select(*HIT)


def relevance(text: Column, question: str, entities: list[str]) -> Column:
    """0.3 for each entity that a text holds and 0.1 for each shared word up to 0.5; at most 1."""
    low = F.lower(text)
    score = F.lit(0.0)
    for e in entities:
        score = score + F.when(low.contains(e.lower()), F.lit(0.3)).otherwise(F.lit(0.0))
    asked = F.array(*[F.lit(w) for w in sorted(set(question.lower().split()))])
    shared = F.size(F.array_intersect(F.array_distinct(F.split(low, r"\s+")), asked))
    return F.least(F.lit(1.0), score + F.least(F.lit(0.1) * shared, F.lit(0.5)))


def local_search(docs: DataFrame, question: str, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k most relevant texts with a relevance above 0.3."""
    score = relevance(F.coalesce(F.col(text_col), F.lit("")), question, question_entities(question))
    return docs.select(id_col, F.col(text_col).alias("content"), score.alias("score")).where(F.col("score") > 0.3).orderBy(F.desc("score"), id_col).limit(k)


def answer(relations: DataFrame, entities: DataFrame, contexts: DataFrame, question: str) -> DataFrame:
    """One row: question, answer, confidence. Up to five relations (0.8), else five entity facts (0.6), else three contexts (0.4)."""
    first = lambda df, n, c: df.orderBy(*df.columns).limit(n).agg(F.array_join(F.collect_list(c), "; ").alias("a"))
    local = F.element_at(F.split("relationType", "[/#]"), -1)
    r = first(relations, 5, F.concat_ws(" ", "subjectName", local, "objectName")).select(F.col("a").alias("r"))
    e = first(entities.where("property is not null and value is not null"), 5, F.concat_ws(" ", "label", F.element_at(F.split("property", "[/#]"), -1), "value")).select(F.col("a").alias("e"))
    c = first(contexts, 3, F.substring("content", 1, 200)).select(F.col("a").alias("c"))
    one = r.withColumn("k", F.lit(1)).join(e.withColumn("k", F.lit(1)), "k").join(c.withColumn("k", F.lit(1)), "k")
    has = lambda n: F.length(n) > 0
    text = F.when(has("r"), F.col("r")).when(has("e"), F.col("e")).when(has("c"), F.col("c")).otherwise("No relevant information was found.")
    sure = F.when(has("r"), 0.8).when(has("e"), 0.6).when(has("c"), 0.4).otherwise(0.0)
    return one.select(F.lit(question).alias("question"), text.alias("answer"), sure.alias("confidence"))


def index(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Writes chunks with their vectors: ``embed`` takes (chunk_id, text) and returns (chunk_id, embedding)."""
    chunks.join(embed(chunks.select("chunk_id", "text")), "chunk_id").write.mode("overwrite").parquet(path)


def index_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))


def index_metadata(docs: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_count) of all documents, also of those without a chunk."""
    n = chunks.groupBy(F.col("doc_id").alias("__d")).agg(F.count(F.lit(1)).alias("n"))
    ids = docs.select(F.col(id_col).cast("string").alias("doc_id"))
    return ids.join(n, F.col("doc_id") == F.col("__d"), "left").select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("chunk_count"))
