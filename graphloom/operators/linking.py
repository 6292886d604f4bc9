"""Linking of mentions to a knowledge base (canonical, type, id, aliases, ord), in stages: exact alias, then partial or fuzzy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seeds of the knowledge base (fixed values).
SEEDS = (
    ("John Smith", "PERSON", "person_1", ["John", "Mr. Smith"]),
    ("Maria Garcia", "PERSON", "person_2", ["Maria", "Ms. Garcia"]),
    ("David Chen", "PERSON", "person_3", ["David", "Mr. Chen"]),
    ("Sarah Johnson", "PERSON", "person_4", ["Sarah", "Dr. Johnson"]),
    ("TechCorp Inc", "ORG", "org_1", ["TechCorp", "TechCorp Incorporated"]),
    ("Global Bank", "ORG", "org_2", ["Global Bank Corp"]),
    ("MediPharm", "ORG", "org_3", ["MediPharm Ltd"]),
    ("EduFoundation", "ORG", "org_4", ["Education Foundation"]),
    ("New York", "PLACE", "place_1", ["NY", "New York City"]),
    ("San Francisco", "PLACE", "place_2", ["SF", "San Fran"]),
    ("London", "PLACE", "place_3", ["London UK"]),
    ("Tokyo", "PLACE", "place_4", ["Tokyo Japan"]),
)


def seed_kb(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, k) for k, r in enumerate(SEEDS)], "canonical string, type string, id string, aliases array<string>, ord int")


def alias_map(kb: DataFrame) -> DataFrame:
    """(alias in lower case, canonical, type, id); the last of equal aliases counts, canonical names after a row's own aliases."""
    each = kb.select("canonical", "type", "id", "ord", F.posexplode(F.concat("aliases", F.array("canonical"))).alias("k", "alias"))
    rows = each.groupBy(F.lower("alias").alias("alias")).agg(F.max(F.struct("ord", "k", "canonical", "type", "id")).alias("m"))
    return rows.select("alias", "m.canonical", "m.type", "m.id")


def fuzzy(a: Column, b: Column) -> Column:
    """As many shared words as the shorter name has, or the same first four characters of names longer than three."""
    wa, wb = (F.split(F.trim(F.lower(x)), r"\s+") for x in (a, b))
    shared = F.size(F.array_intersect(F.array_distinct(wa), wb)) >= F.least(F.size(wa), F.size(wb))
    long_ = (F.length(a) > 3) & (F.length(b) > 3)
    return shared | (long_ & (F.substring(F.lower(a), 1, 4) == F.substring(F.lower(b), 1, 4)))


#: Length of the longest grams, by which containment is looked up.
GRAM = 4


def _words(name: Column) -> Column:
    return F.split(F.trim(F.lower(name)), r"\s+")


def _grams(name: Column) -> Column:
    """Distinct substrings of up to GRAM characters, the empty one included."""
    starts = lambda k: F.sequence(F.lit(1), F.greatest(F.length(name) - F.lit(k - 1), F.lit(1)))
    of = lambda k: F.when(F.length(name) >= k, F.transform(starts(k), lambda i: F.substr(name, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), *(of(k) for k in range(1, GRAM + 1))))


def _long_grams(name: Column) -> Column:
    """The substrings of GRAM characters of a name, or the name itself if it is shorter: it is in a text only if all of them are."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(name) - F.lit(GRAM - 1), F.lit(1)))
    return F.when(F.length(name) <= GRAM, F.array(name)).otherwise(F.array_distinct(F.transform(starts, lambda i: F.substr(name, i, F.lit(GRAM)))))


def _pairs_of(words: Column) -> Column:
    """All pairs of distinct words, in order, as one string each."""
    w = F.array_sort(F.array_distinct(words))
    return F.flatten(F.transform(w, lambda x, i: F.transform(F.slice(w, i + 2, F.greatest(F.size(w) - i - 1, F.lit(0))), lambda y: F.concat(x, F.lit(" "), y))))


def partial_matches(names: DataFrame, kb: DataFrame) -> DataFrame:
    """(text, type, ord, canonical, id): for each name (text, type) the first row of the knowledge base, by ``ord``, of its type whose name holds it, is held by it or is ``fuzzy`` to it.

    Nothing is joined on the type alone. The rows of the knowledge base are looked up by first four characters, words, pairs of words and grams; each of these keys has one row, the first
    that has it, which answers for all names that the key describes wholly. Longer names look at the rows under their rarest pair of words or gram, and are compared there; rows that may be
    the shorter side stand under their own rarest word or gram.
    """
    low = F.lower("canonical")
    first = F.min(F.struct("ord", "canonical", "id")).alias("x")
    known = kb.where("canonical is not null and type is not null").select(F.col("type").alias("kind"), low.alias("low"), "ord", "canonical", "id")
    # Words are those of the name as it is written: lower case changes nothing in their number.
    known = known.groupBy("kind", "low").agg(first).select("kind", "low", "x.*").withColumn("words", _words(F.col("low"))).withColumn("grams", _grams(F.col("low")))
    asked = names.where("text is not null and type is not null").select("text", "type", F.lower("text").alias("name"), F.length("text").alias("size")).withColumn("own", _words(F.col("text")))
    keyed = lambda key: known.select("kind", F.explode(key).alias("key"), "ord", "canonical", "id").groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), first)
    at = lambda key: (F.col("type") == F.col("kind")) & (key == F.col("key"))
    found = []

    # The same first four characters of names of more than three.
    some = F.when(F.length("low") > 3, F.array(F.substring("low", 1, 4))).otherwise(F.array().cast("array<string>"))
    found.append(asked.where("size > 3").join(keyed(some), at(F.substring("name", 1, 4))).select("text", "type", "x"))

    # All words of the name are words of the row, if the name has no word twice.
    by_word, by_pair = keyed(F.array_distinct("words")), keyed(_pairs_of(F.col("words")))
    distinct = asked.where(F.size("own") == F.size(F.array_distinct("own")))
    found.append(distinct.where(F.size("own") == 1).join(by_word, at(F.get("own", F.lit(0)))).select("text", "type", "x"))
    found.append(distinct.where(F.size("own") == 2).join(by_pair, at(F.get(_pairs_of(F.col("own")), F.lit(0)))).select("text", "type", "x"))
    many = distinct.where(F.size("own") > 2).withColumn("pair", F.explode(_pairs_of(F.col("own")))).join(by_pair, at(F.col("pair")))
    rarest = many.groupBy("text", "type", "own").agg(F.min(F.struct("n", "key")).alias("r")).select("text", "type", "own", F.col("r.key").alias("rare"))
    listed = known.select("kind", "words", "ord", "canonical", "id", F.explode(_pairs_of(F.col("words"))).alias("key"))
    found.append(rarest.join(listed, at(F.col("rare"))).where(F.size(F.array_except("own", "words")) == 0).groupBy("text", "type").agg(first))

    # All words of the row are words of the name: the row stands under its rarest word.
    whole = known.where(F.size("words") == F.size(F.array_distinct("words"))).select("*", F.explode("words").alias("w"))
    counts = by_word.select(F.col("kind").alias("k2"), F.col("key").alias("w2"), "n")
    stands = whole.join(counts, (F.col("kind") == F.col("k2")) & (F.col("w") == F.col("w2"))).groupBy("kind", "low", "words", "ord", "canonical", "id").agg(F.min(F.struct("n", "w")).alias("r"))
    stands = stands.select("kind", "words", "ord", "canonical", "id", F.col("r.w").alias("key"))
    each = asked.select("text", "type", "own", F.explode(F.array_distinct("own")).alias("w"))
    found.append(each.join(stands, at(F.col("w"))).where(F.size(F.array_except("words", "own")) == 0).groupBy("text", "type").agg(first))

    # The row holds the name.
    by_gram = keyed(F.col("grams"))
    found.append(asked.where(F.length("name") <= GRAM).join(by_gram, at(F.col("name"))).select("text", "type", "x"))
    longer = asked.where(F.length("name") > GRAM).withColumn("g", F.explode(_long_grams(F.col("name")))).join(by_gram, at(F.col("g")))
    rare = longer.groupBy("text", "type", "name").agg(F.min(F.struct("n", "key")).alias("r")).select("text", "type", "name", F.col("r.key").alias("rare"))
    under = known.select("kind", "low", "ord", "canonical", "id", F.explode("grams").alias("key")).where(F.length("key") == GRAM)
    found.append(rare.join(under, at(F.col("rare"))).where(F.col("low").contains(F.col("name"))).groupBy("text", "type").agg(first))

    # The name holds the row: the row stands under its rarest gram.
    own = known.select("kind", "low", "ord", "canonical", "id", F.explode(_long_grams(F.col("low"))).alias("g"))
    counts = by_gram.select(F.col("kind").alias("k2"), F.col("key").alias("g2"), "n")
    stands = own.join(counts, (F.col("kind") == F.col("k2")) & (F.col("g") == F.col("g2"))).groupBy("kind", "low", "ord", "canonical", "id").agg(F.min(F.struct("n", "g")).alias("r"))
    stands = stands.select("kind", "low", "ord", "canonical", "id", F.col("r.g").alias("key"))
    each = asked.select("text", "type", "name", F.explode(_grams(F.col("name"))).alias("g"))
    found.append(each.join(stands, at(F.col("g"))).where(F.col("name").contains(F.col("low"))).groupBy("text", "type").agg(first))

    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("text", "type").agg(F.min("x").alias("x")).select("text", "type", "x.*")


def link(mentions: DataFrame, kb: DataFrame) -> DataFrame:
    """Distinct (text, type) are linked once and joined back: canonical_name, entity_id, kb_confidence, match_type, kb_linked."""
    names = mentions.select("text", "type").where("text is not null").distinct()
    aliases = alias_map(kb)
    exact = names.join(aliases.withColumnsRenamed({"type": "kb_type"}), (F.lower("text") == F.col("alias")) & (F.col("type") == F.col("kb_type")), "left")
    hit = exact.where("alias is not null").select("text", "type", "canonical", "id", F.lit(0.95).alias("c"), F.lit("EXACT_MATCH").alias("m"))
    rest = exact.where("alias is null").select("text", "type")
    part = partial_matches(rest, kb).select("text", "type", "canonical", "id", F.lit(0.7).alias("c"), F.lit("PARTIAL_MATCH").alias("m"))
    found = hit.unionByName(part).withColumnsRenamed({"text": "t", "type": "ty"})
    out = mentions.join(found, (F.col("text") == F.col("t")) & F.col("type").eqNullSafe(F.col("ty")), "left")
    return out.select(
        *mentions.columns,
        F.coalesce("canonical", "text").alias("linked_name"),
        F.coalesce("id", F.concat(F.lower("type"), F.lit("_"), F.substring(F.sha2(F.lower("text"), 256), 1, 16))).alias("entity_id"),
        F.coalesce("c", F.lit(0.0)).alias("kb_confidence"),
        F.coalesce("m", F.lit("NO_MATCH")).alias("match_type"),
        (F.coalesce("c", F.lit(0.0)) > 0.5).alias("kb_linked"),
    )


def resolved_aliases(mentions: DataFrame, kb: DataFrame) -> DataFrame:
    """Mentions under an alias that is not the canonical name: text, canonical, confidence 0.9."""
    joined = mentions.select("text").distinct().join(alias_map(kb), F.lower("text") == F.col("alias"))
    return joined.where("text <> canonical").select("text", "canonical", F.lit(0.9).alias("confidence"))


def add_to_kb(kb: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of (canonical, type, id or null, aliases); a missing id is the type and the next number. New rows are numbered by name: within partitions of a
    range exchange, after a count of those before."""
    n = kb.count()
    dealt = new.repartitionByRange("canonical").sortWithinPartitions("canonical").withColumn("__i", F.monotonically_increasing_id())
    part = F.shiftright("__i", 33)
    before, at = [], 0
    for r in dealt.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
        before.append((r["p"], at))
        at += r["n"]
    table = F.broadcast(kb.sparkSession.createDataFrame(before, "p long, before long"))
    rows = dealt.join(table, part == F.col("p")).withColumn("ord", (F.lit(n) + F.col("before") + F.col("__i").bitwiseAND((1 << 33) - 1)).cast("int"))
    rows = rows.withColumn("id", F.coalesce("id", F.concat(F.lower("type"), F.lit("_"), (F.col("ord") + 1).cast("string"))))
    best = Window.partitionBy("canonical").orderBy(F.desc("ord"))
    return kb.unionByName(rows.select(*kb.columns)).withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
