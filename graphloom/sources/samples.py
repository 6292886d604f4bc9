"""Documents made by rule: a minimal set, and any number of texts, e-mails, reports, cards, meetings and presentations with their ground truth.

A document is a function of its number, so a table of any size is made in parallel and is the same in every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that stand in the documents (fixed values).
PEOPLE = ("John Smith", "Maria Garcia", "David Chen", "Sarah Johnson")
ORGANISATIONS = ("TechCorp Inc", "Global Bank", "MediPharm", "EduFoundation")
PLACES = ("New York", "San Francisco", "London", "Tokyo")
ROLES = ("CEO", "CTO", "analyst")
#: Type and template of documents in turn; {p}, {o}, {l} and {r} are a person, an organisation, a place and a role (fixed values).
TEMPLATES = (
    ("text", "{p}, the {r} of {o}, announced a new office in {l}. The news was well received."),
    ("text", "{o} opened a branch in {l}. {p} works for {o} there."),
    ("email", "From: {p}. To: the team of {o}. We meet in {l} on Monday."),
    ("pdf", "Quarterly report of {o}. Revenue grew in {l}. Signed by {p}, {r}."),
    ("image", "{o} {l} receipt. Served by {p}."),
    ("audio", "Meeting in {l}: {p} of {o} opened the session."),
    ("video", "Presentation by {p}, {r} of {o}, in {l}."),
)


def minimal(spark: SparkSession) -> DataFrame:
    """The first document of each template."""
    return generated(spark, len(TEMPLATES))


def generated(spark: SparkSession, n: int) -> DataFrame:
    """n documents: doc_id, type, content, source, created_at, and entities (name, type) as they stand in the template."""
    k = F.col("id")
    pick = lambda names, step: F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(k / step) % len(names) + 1).cast("int"))
    row = F.element_at(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(x).alias("text")) for t, x in TEMPLATES]), (k % len(TEMPLATES) + 1).cast("int"))
    person, org, place, role = pick(PEOPLE, 1), pick(ORGANISATIONS, 3), pick(PLACES, 5), pick(ROLES, 2)
    text = row["text"]
    for sign, value in (("{p}", person), ("{o}", org), ("{l}", place), ("{r}", role)):
        text = F.replace(text, F.lit(sign), value)
    entities = F.array(*[F.struct(v.alias("name"), F.lit(t).alias("type")) for v, t in ((person, "PERSON"), (org, "ORG"), (place, "PLACE"))])
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 365).cast("int")), "yyyy-MM-dd")
    return spark.range(n).select(F.concat(row["type"], F.lit("_"), k.cast("string")).alias("doc_id"), row["type"].alias("type"), text.alias("content"), F.lit("generated").alias("source"), day.alias("created_at"), entities.alias("entities"))
