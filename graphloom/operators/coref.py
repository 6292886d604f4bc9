"""Coreference of a document's mentions: greedy clusters around a seed, chains, resolved mentions and same-as pairs.

Clustering compares with the seed only, in order, so it is a fold and not a set of components; it runs in Python for one
document after the other, type by type.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIXES = ("inc", "corp", "ltd", "co", "llc", "company")


def bare_company(name: str) -> str:
    name = name.lower()
    for s in SUFFIXES:
        name = name.replace(" " + s, "").replace("." + s, "")
    return name.strip()


def same_person_context(text: str, a: str, b: str) -> bool:
    """Names in one sentence are two people; otherwise both must stand on one line, in any case."""
    if any(a in s and b in s for s in re.split(r"[.!?]+", text)):
        return False
    x, y = re.escape(a), re.escape(b)
    return bool(re.search(f"{x}.*{y}", text, re.IGNORECASE) or re.search(f"{y}.*{x}", text, re.IGNORECASE))


def alike(kind: str, seed: str, other: str, text: str) -> bool:
    a, b = seed.lower(), other.lower()
    if a == b:
        return True
    if kind == "PERSON":
        wa, wb = set(a.split()), set(b.split())
        n = len(wa & wb)
        return n >= 1 and n >= min(len(wa), len(wb)) - 1 and same_person_context(text, seed, other)
    if a in b or b in a:
        return True
    return kind == "ORG" and bare_company(a) == bare_company(b)


class _Places:
    """Where the names of a document occur: their sentences as they are written, and for each line the first and the last place in any case."""

    def __init__(self, text: str, names: list[str]):
        import ahocorasick

        self.text, low = text, text.lower()
        self.folds = len(low) == len(text)
        self.sentences: dict[str, set[int]] = {n: set() for n in names}
        self.lines: dict[str, dict[int, list[int]]] = {n.lower(): {} for n in names}
        exact, any_case = ahocorasick.Automaton(), ahocorasick.Automaton()
        for n in names:
            if n:
                exact.add_word(n, n)
                any_case.add_word(n.lower(), n.lower())
        if len(exact):
            exact.make_automaton()
            any_case.make_automaton()
            for k, sentence in enumerate(re.split(r"[.!?]+", text)):
                for _, n in exact.iter(sentence):
                    self.sentences[n].add(k)
            for k, line in enumerate(low.split("\n")):
                for end, n in any_case.iter(line):
                    at = self.lines[n].setdefault(k, [end - len(n) + 1, 0])
                    at[1] = end - len(n) + 1

    def same_context(self, a: str, b: str) -> bool:
        """``same_person_context`` by look-up; names without letters, or that change their length in lower case, are searched."""
        if not (self.folds and a and b and len(a.lower()) == len(a) and len(b.lower()) == len(b)):
            return same_person_context(self.text, a, b)
        if not self.sentences[a].isdisjoint(self.sentences[b]):
            return False
        x, y = self.lines[a.lower()], self.lines[b.lower()]
        return any(x[k][0] + len(a) <= y[k][1] or y[k][0] + len(b) <= x[k][1] for k in x.keys() & y.keys())


def seeds(kind: str | None, names: list[str], text: str) -> list[int]:
    """For distinct names in the order of their first mentions the name (by number) that begins their cluster.

    A name that is free when its turn comes begins a cluster and takes the free ones that are ``alike`` it. Only those are compared that an index names: people by shared words,
    others by containment (an automaton finds the names in a name, a search through all names those around it) and by bare company names.
    """
    import ahocorasick

    low = [n.lower() for n in names]
    seed = [-1] * len(names)
    same: dict[str, list[int]] = {}
    for k, n in enumerate(low):
        same.setdefault(n, []).append(k)
    person, org = kind == "PERSON", kind == "ORG"
    words: dict[str, list[int]] = {}
    bare: dict[str, list[int]] = {}
    if person:
        places = _Places(text, names)
        for k, n in enumerate(low):
            for w in set(n.split()):
                words.setdefault(w, []).append(k)
    else:
        automaton = ahocorasick.Automaton()
        for n, ks in same.items():
            if n:
                automaton.add_word(n, ks)
        if len(automaton):
            automaton.make_automaton()
        joined, starts = "\x00".join(low), []
        for n in low:
            starts.append(starts[-1] + before + 1 if starts else 0)
            before = len(n)
        if org:
            for k, n in enumerate(names):
                bare.setdefault(bare_company(n), []).append(k)

    def near(i: int) -> set[int]:
        a, found = low[i], set(same[low[i]])
        if person:
            mine, counts = set(a.split()), Counter()
            for w in mine:
                words[w] = [j for j in words[w] if seed[j] < 0]  # those that are taken are not met again
                counts.update(words[w])
            for j, n in counts.items():
                if j not in found and n >= min(len(mine), len(set(low[j].split()))) - 1 and places.same_context(names[i], names[j]):
                    found.add(j)
            return found
        found.update(same.get("", ()))
        if len(automaton):
            for _, ks in automaton.iter(a):
                found.update(ks)
        if not a or "\x00" in a:
            found.update(j for j, n in enumerate(low) if a in n)
        else:
            at = joined.find(a)
            while at >= 0:
                j = bisect_right(starts, at) - 1
                found.add(j)
                at = joined.find(a, starts[j] + len(low[j]) + 1)
        if org:
            found.update(bare[bare_company(names[i])])
        return found

    for i in range(len(names)):
        if seed[i] < 0:
            for j in near(i):
                if j >= i and seed[j] < 0:
                    seed[j] = i
            seed[i] = i
    return seed


def clustered(kind: str | None, mentions: list[tuple[int, str | None]], text: str) -> list[tuple[int, str | None, int]]:
    """(pos, text, seed) of mentions (pos, text) of one type; ``seed``: the position of the first mention of the mention's cluster. Mentions of one text are always in one cluster, so distinct
    texts are compared. A mention without a text is alone."""
    mentions = sorted(mentions, key=lambda m: m[0])
    first: dict[str, int] = {}
    for pos, name in mentions:
        if name is not None:
            first.setdefault(name, pos)
    places = list(first.values())
    begun = {n: places[k] for n, k in zip(first, seeds(kind, list(first), text))}
    return [(pos, name, begun.get(name, pos)) for pos, name in mentions]


def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
    """``clustered`` for a frame (doc_id, type, pos, text, content) of one document and type."""
    rows = clustered(pdf["type"].iloc[0], list(zip(pdf["pos"], pdf["text"])), pdf["content"].iloc[0])
    return pd.DataFrame(rows, columns=["pos", "text", "seed"]).assign(doc_id=pdf["doc_id"].iloc[0], type=pdf["type"].iloc[0])[["doc_id", "type", "pos", "text", "seed"]]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("mentions")
        offsets, flat = lists.offsets.to_pylist(), lists.values
        each = list(zip(*(flat.field(c).to_pylist() for c in ("type", "pos", "text"))))
        rows, out = [], []
        for k, text in enumerate(batch.column("content")):
            by_type: dict[str | None, list[tuple]] = {}
            for kind, pos, name in each[offsets[k] : offsets[k + 1]]:
                by_type.setdefault(kind, []).append((pos, name))
            content = text.as_py()
            for kind, mentions in by_type.items():
                out += [(kind, *m) for m in clustered(kind, mentions, content)]
            rows += [k] * (len(out) - len(rows))
        columns = list(zip(*out)) if out else [()] * 4
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32())
        yield pa.record_batch([batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", "type", "pos", "text", "seed"])


def clusters(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, type, pos, text, seed)."""
    # Documents are rows with their text once and their mentions as a list, so that Python takes many at a time.
    content = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    one = F.struct(F.col("type").cast("string").alias("type"), F.col("pos").cast("int").alias("pos"), F.col("text").cast("string").alias("text"))
    rows = mentions.where("doc_id is not null").select("doc_id", one.alias("m"))
    both = rows.unionByName(content, allowMissingColumns=True).groupBy("doc_id").agg(F.first("content", True).alias("content"), F.collect_list("m").alias("mentions"))
    kind = dict(rows.dtypes)["doc_id"]
    return both.where("content is not null and size(mentions) > 0").mapInArrow(_documents, f"doc_id {kind}, type string, pos int, text string, seed int")


def confidence(n: Column) -> Column:
    return F.when(n == 1, 0.3).otherwise(F.least(F.lit(0.95), F.least(F.lit(0.9), F.lit(0.5) + F.lit(0.1) * n) + F.lit(0.1)))


def chains(found: DataFrame) -> DataFrame:
    """(doc_id, cluster_id, type, mentions, canonical_entity, confidence); canonical is the longest name, the first of equals."""
    longest = F.max_by("text", F.struct(F.length("text"), -F.col("pos")))
    rows = found.groupBy("doc_id", "type", "seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("mentions"), longest.alias("canonical_entity"))
    return rows.select("doc_id", F.concat(F.lit("cluster_"), F.lower("type"), F.lit("_"), F.col("seed").cast("string")).alias("cluster_id"), "type", "mentions", "canonical_entity", confidence(F.size("mentions")).alias("confidence"))


def same_as(chain_table: DataFrame) -> DataFrame:
    """Unordered pairs of a chain's mentions."""
    left = chain_table.select("doc_id", "cluster_id", "confidence", F.posexplode("mentions").alias("i", "entity1"), "mentions")
    pairs = left.select("*", F.posexplode("mentions").alias("j", "entity2")).where("i < j")
    return pairs.select("doc_id", "entity1", "entity2", "confidence", F.col("cluster_id").alias("evidence"), F.lit("SAME_AS").alias("type"))


def resolved(mentions: DataFrame, chain_table: DataFrame) -> DataFrame:
    """Mentions with the canonical name of their cluster (the last one that holds the text) or their own."""
    each = chain_table.select("doc_id", "cluster_id", F.col("canonical_entity").alias("c"), F.explode("mentions").alias("t"))
    last = each.groupBy("doc_id", "t").agg(F.max(F.struct("cluster_id", "c")).alias("m")).withColumnRenamed("doc_id", "d")
    out = mentions.join(last, (F.col("doc_id") == F.col("d")) & (F.col("text") == F.col("t")), "left")
    return out.select(*mentions.columns, F.col("text").alias("original_text"), F.coalesce("m.c", "text").alias("resolved_name"), F.col("m.cluster_id").alias("entity_cluster"))
