"""Ontology: classes and properties that the data has beyond the base, datatypes of properties, unions, subclass closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import pascal
from .kg_views import KG

#: Classes of the core ontology with their superclass (fixed values).
BASE_CLASSES = {
    "Person": "Entity", "Organization": "Entity", "Place": "Entity", "Event": "Entity", "Concept": "Entity", "Document": "Entity", "Media": "Entity", "Relation": "Entity",
    "Resume": "Document", "Skill": "Entity", "WorkExperience": "Entity", "Education": "Entity", "Certification": "Entity", "Project": "Entity",
    "ResearchPaper": "Document", "Author": "Person", "Methodology": "Entity", "Finding": "Entity", "Citation": "Entity", "ResearchTopic": "Concept",
    "BusinessReport": "Document", "Company": "Organization", "FinancialMetric": "Entity", "MarketSegment": "Entity", "Recommendation": "Entity",
    "TechnicalDocumentation": "Document", "API": "Entity", "Endpoint": "Entity", "Parameter": "Entity",
    "LegalDocument": "Document", "Party": "Entity", "Clause": "Entity", "Obligation": "Entity",
    "MedicalDocument": "Document", "Patient": "Person", "Diagnosis": "Entity", "Treatment": "Entity",
}
#: Object properties of the core ontology with domain and range (fixed values).
OBJECT_PROPERTIES = (
    ("mentions", "Document", "Entity"), ("occurredAt", "Event", "Instant"), ("hasRelation", "Entity", "Relation"), ("relationWith", "Relation", "Entity"), ("sameAs", "Entity", "Entity"), ("worksFor", "Person", "Organization"),
    ("locatedIn", "Entity", "Place"), ("participatedIn", "Person", "Event"), ("extractedFrom", "Entity", "Document"), ("hasSkill", "Person", "Skill"), ("workedAt", "Person", "WorkExperience"), ("studiedAt", "Person", "Education"),
    ("hasCertification", "Person", "Certification"), ("usedSkill", "WorkExperience", "Skill"), ("atCompany", "WorkExperience", "Organization"), ("authoredBy", "ResearchPaper", "Author"), ("cites", "ResearchPaper", "Citation"),
    ("usesMethodology", "ResearchPaper", "Methodology"), ("hasFinding", "ResearchPaper", "Finding"), ("studiesTopic", "ResearchPaper", "ResearchTopic"), ("affiliatedWith", "Author", "Organization"), ("hasMetric", "Company", "FinancialMetric"),
    ("operatesInSector", "Company", "MarketSegment"), ("competesWith", "Company", "Company"), ("hasEndpoint", "API", "Endpoint"), ("acceptsParameter", "Endpoint", "Parameter"), ("partyTo", "Party", "LegalDocument"),
    ("hasClause", "LegalDocument", "Clause"), ("hasObligation", "LegalDocument", "Obligation"), ("hasCondition", "Patient", "Diagnosis"), ("treatedWith", "Diagnosis", "Treatment"), ("prescribedTo", "Treatment", "Patient"),
)
#: Datatype properties of the core ontology with domain and range (fixed values).
DATATYPE_PROPERTIES = (
    ("hasText", "Document", "string"), ("createdAt", "Document", "dateTime"), ("sourceType", "Document", "string"), ("confidence", "Relation", "float"), ("hasAlias", "Entity", "string"), ("hasCategory", "Entity", "string"),
    ("hasRole", "Person", "string"), ("extractionMethod", "Entity", "string"),
)
#: Properties that are defined where there is no ontology file, all as object properties (fixed values).
EMBEDDED_CLASSES = ("Person", "Organization", "Place", "Event", "Concept", "Document")
EMBEDDED_PROPERTIES = ("WORKS_FOR", "LOCATED_IN", "PARTICIPATED_IN", "HAS_ROLE", "MENTIONS", "hasText", "sourceType", "createdAt", "hasAlias", "extractedFrom", "mentions")
#: Relation names that are base properties (fixed values).
BASE_PROPERTIES = (
    "WORKS_FOR", "LOCATED_IN", "PARTICIPATED_IN", "HAS_ROLE", "MENTIONS", "hasText", "sourceType", "createdAt", "hasAlias", "extractedFrom", "mentions", "HAS_SKILL", "WORKED_AT", "STUDIED_AT", "HAS_CERTIFICATION", "USED_SKILL",
    "AT_COMPANY", "AUTHORED_BY", "CITES", "USES_METHODOLOGY", "HAS_FINDING", "STUDIES_TOPIC", "AFFILIATED_WITH", "HAS_METRIC", "OPERATES_IN_SECTOR", "COMPETES_WITH", "HAS_ENDPOINT", "ACCEPTS_PARAMETER", "PARTY_TO", "HAS_CLAUSE",
    "HAS_OBLIGATION", "HAS_CONDITION", "TREATED_WITH", "PRESCRIBED_TO",
)
#: Names of mention types that are base classes (fixed values).
SYNONYMS = {"PERSON": "Person", "ORG": "Organization", "ORGANIZATION": "Organization", "PLACE": "Place", "EVENT": "Event", "CONCEPT": "Concept", "DOCUMENT": "Document"}


def class_name(kind: Column) -> Column:
    """A base class by synonym or by its name without underscores; otherwise the type in Pascal case."""
    known = SYNONYMS | {c.upper(): c for c in BASE_CLASSES}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(F.replace(kind, F.lit("_"), F.lit("")))), pascal(kind))


ISO = r"^\d{4}-?\d{2}-?\d{2}([T ]\d{2}:?\d{2}(:?\d{2}([.,]\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def xsd_type(value: Column) -> Column:
    """Datatype of a value given as JSON: of true, false and numbers by their form; a string is dateTime if it is an ISO date, else string, also where it holds a
    number."""
    text = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    date = text.rlike(ISO) & F.try_to_timestamp(F.concat(F.regexp_extract(text, r"^(\d{4})-?(\d{2})-?(\d{2})", 1), F.lit("-"), F.regexp_extract(text, r"^(\d{4})-?(\d{2})-?(\d{2})", 2), F.lit("-"), F.regexp_extract(text, r"^(\d{4})-?(\d{2})-?(\d{2})", 3))).isNotNull()
    return (
        F.when(value.isin("true", "false"), "boolean")
        .when(value.rlike(r"^-?\d+$"), "integer")
        .when(value.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "float")
        .when(value.startswith('"') & F.coalesce(date, F.lit(False)), "dateTime")
        .otherwise("string")
    )


TYPES = ("boolean", "integer", "float", "dateTime", "string")


def _merged(a: Column, b: Column) -> Column:
    """The datatype of two: equal ones stay, string yields, dates with others give string, boolean with integer integer, numbers float."""
    return (
        F.when(a.isNull() | (a == b), b).when(a == "string", b).when(b == "string", a).when((a == "dateTime") | (b == "dateTime"), F.lit("string"))
        .when((a != "float") & (b != "float"), F.lit("integer")).otherwise(F.lit("float"))
    )


def consensus(types: Column, start: Column | None = None) -> Column:
    """Fold of datatypes in order."""
    return F.aggregate(types, F.lit(None).cast("string") if start is None else start, _merged)


def classes(mentions: DataFrame) -> DataFrame:
    """New classes: (class, superclass) of mention types that are no base classes."""
    found = mentions.select(class_name(F.col("type")).alias("class")).where("class is not null").distinct()
    return found.where(~F.col("class").isin("Entity", *BASE_CLASSES)).withColumn("superclass", F.lit("Entity"))


def object_properties(relations: DataFrame) -> DataFrame:
    return relations.select(F.col("relation").alias("property")).where("property is not null").distinct().where(~F.col("property").isin(*BASE_PROPERTIES))


def datatype_properties(values: DataFrame, field: str = "field", value: str = "value", seq: str = "seq") -> DataFrame:
    """(property, range) from values (field, value as JSON, seq): the fold over all values of a field in order.

    The fold depends on the order, but what a stretch of values does to each of the datatypes before it is a small table, and such tables follow one
    another: stretches are folded where they are, and a field's tables (one for each partition) are then folded in order.
    """
    typed = values.where(F.col(value).isNotNull()).select(F.col(field).alias("f"), F.col(seq).alias("k"), xsd_type(F.col(value)).alias("t"))
    dealt = typed.repartitionByRange("f", "k").sortWithinPartitions("f", "k").withColumn("p", F.spark_partition_id())
    # A datatype changes the result at most twice in a row (the first makes a conflict a string, which yields to the second).
    near = Window.partitionBy("p", "f").orderBy("k")
    runs = dealt.withColumns({"one": F.lag("t", 1).over(near), "two": F.lag("t", 2).over(near)}).where(~(F.col("t").eqNullSafe(F.col("one")) & F.col("t").eqNullSafe(F.col("two"))))
    lists = runs.groupBy("f", "p").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]).alias("ts"))
    starts = F.array(F.lit(None).cast("string"), *[F.lit(t) for t in TYPES])
    tables = lists.select("f", "p", F.transform(starts, lambda s: F.aggregate("ts", s, _merged)).alias("after"))
    place = lambda t: F.when(t.isNull(), F.lit(0)).otherwise(F.array_position(F.array(*[F.lit(x) for x in TYPES]), t)).cast("int")
    folded = tables.groupBy("f").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("p", "after"))), F.lit(None).cast("string"), lambda a, x: F.get(x["after"], place(a))).alias("range"))
    return folded.select(F.concat(F.lit("has"), pascal(F.col("f"))).alias("property"), "range")


def entities_of(docs: DataFrame, column: str = "entities") -> DataFrame:
    """(doc_id, entity) of documents with lists of entities; documents without any are left out."""
    return docs.select("doc_id", F.explode(column).alias("entity"))


def by_source(mentions: DataFrame) -> DataFrame:
    """(source_type, class) for each source and for all of them together as 'combined'."""
    own = mentions.select("source_type", class_name(F.col("type")).alias("class")).distinct()
    return own.unionByName(own.select(F.lit("combined").alias("source_type"), "class").distinct())


def merged(*ontologies: DataFrame) -> DataFrame:
    """The union of ontologies as a set."""
    out = ontologies[0]
    for o in ontologies[1:]:
        out = out.unionByName(o)
    return out.dropDuplicates()


def merge_counts(*ontologies: DataFrame) -> DataFrame:
    """One row: how many rows each ontology has (sizes), and how many their union has (merged)."""
    every = None
    for k, o in enumerate(ontologies):
        o = o.dropDuplicates().withColumn("__k", F.lit(k))
        every = o if every is None else every.unionByName(o)
    columns = [c for c in every.columns if c != "__k"]
    per = every.groupBy(*columns).agg(*[F.max((F.col("__k") == k).cast("int")).alias(f"__{k}") for k in range(len(ontologies))])
    return per.agg(F.array(*[F.sum(f"__{k}") for k in range(len(ontologies))]).alias("sizes"), F.count(F.lit(1)).alias("merged"))


def core_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*BASE_CLASSES.items()], "class string, superclass string")


def core_properties(spark: SparkSession) -> DataFrame:
    """(property, kind, domain, range) of the core ontology."""
    rows = [(p, "ObjectProperty", d, r) for p, d, r in OBJECT_PROPERTIES] + [(p, "DatatypeProperty", d, r) for p, d, r in DATATYPE_PROPERTIES]
    return spark.createDataFrame(rows, "property string, kind string, domain string, range string")


def embedded(spark: SparkSession) -> DataFrame:
    """(s, p, o): the classes and properties that are defined where there is no ontology file."""
    owl, rdf, rdfs = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2000/01/rdf-schema#subClassOf"
    rows = [(KG + c, p, o) for c in EMBEDDED_CLASSES for p, o in ((rdf, owl + "Class"), (rdfs, owl + "Thing"))] + [(KG + p, rdf, owl + "ObjectProperty") for p in EMBEDDED_PROPERTIES]
    return spark.createDataFrame(rows, "s string, p string, o string")


def superclasses(spark: SparkSession) -> DataFrame:
    """Closure of the subclass relation over the base classes."""
    return spark.sql(
        "WITH RECURSIVE up(class, ancestor) AS (SELECT class, superclass FROM {c} UNION ALL SELECT u.class, c.superclass FROM up u JOIN {c} c ON u.ancestor = c.class) SELECT DISTINCT class, ancestor FROM up",
        c=core_classes(spark),
    )


def ontology_triples(class_table: DataFrame) -> DataFrame:
    """(class, superclass) as type and subclass triples."""
    s = F.concat(F.lit(KG), "class")
    t = lambda p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    both = F.array(
        t("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", F.lit("http://www.w3.org/2002/07/owl#Class")),
        t("http://www.w3.org/2000/01/rdf-schema#subClassOf", F.concat(F.lit(KG), "superclass")),
    )
    return class_table.select(F.explode(both).alias("t")).select("t.*").distinct()
