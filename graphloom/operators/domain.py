"""Domain schemas and rule extraction: e-mail, phone, skills, DOI; validation; repair of model replies.

Schemas are data: add rows to SCHEMA_ROWS for a new domain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The registry: domain, entity type, field, type, whether it is required (fixed values).
SCHEMA_ROWS = (
    ("resume", "Person", "name", "string", True),
    ("resume", "Person", "email", "string", False),
    ("resume", "Person", "phone", "string", False),
    ("resume", "Person", "location", "string", False),
    ("resume", "Person", "linkedin", "string", False),
    ("resume", "Person", "github", "string", False),
    ("resume", "Person", "website", "string", False),
    ("resume", "Skill", "name", "string", True),
    ("resume", "Skill", "category", "string", False),
    ("resume", "Skill", "proficiency", "string", False),
    ("resume", "WorkExperience", "company", "string", True),
    ("resume", "WorkExperience", "title", "string", True),
    ("resume", "WorkExperience", "start_date", "date", False),
    ("resume", "WorkExperience", "end_date", "date", False),
    ("resume", "WorkExperience", "location", "string", False),
    ("resume", "WorkExperience", "description", "string", False),
    ("resume", "WorkExperience", "achievements", "list", False),
    ("resume", "Education", "institution", "string", True),
    ("resume", "Education", "degree", "string", True),
    ("resume", "Education", "field", "string", False),
    ("resume", "Education", "start_date", "date", False),
    ("resume", "Education", "end_date", "date", False),
    ("resume", "Education", "gpa", "string", False),
    ("resume", "Education", "honors", "list", False),
    ("resume", "Certification", "name", "string", True),
    ("resume", "Certification", "issuer", "string", False),
    ("resume", "Certification", "issue_date", "date", False),
    ("resume", "Certification", "expiry_date", "date", False),
    ("resume", "Certification", "credential_id", "string", False),
    ("resume", "Project", "name", "string", True),
    ("resume", "Project", "description", "string", False),
    ("resume", "Project", "technologies", "list", False),
    ("resume", "Project", "url", "string", False),
    ("resume", "Project", "start_date", "date", False),
    ("resume", "Project", "end_date", "date", False),
    ("research_paper", "Paper", "title", "string", True),
    ("research_paper", "Paper", "abstract", "string", False),
    ("research_paper", "Paper", "doi", "string", False),
    ("research_paper", "Paper", "publication_date", "date", False),
    ("research_paper", "Paper", "journal", "string", False),
    ("research_paper", "Paper", "keywords", "list", False),
    ("research_paper", "Author", "name", "string", True),
    ("research_paper", "Author", "affiliation", "string", False),
    ("research_paper", "Author", "email", "string", False),
    ("research_paper", "Author", "orcid", "string", False),
    ("research_paper", "Methodology", "name", "string", True),
    ("research_paper", "Methodology", "description", "string", False),
    ("research_paper", "Methodology", "type", "string", False),
    ("research_paper", "Finding", "description", "string", True),
    ("research_paper", "Finding", "significance", "string", False),
    ("research_paper", "Finding", "type", "string", False),
    ("research_paper", "Citation", "title", "string", True),
    ("research_paper", "Citation", "authors", "list", False),
    ("research_paper", "Citation", "year", "string", False),
    ("research_paper", "Citation", "doi", "string", False),
    ("research_paper", "ResearchTopic", "name", "string", True),
    ("research_paper", "ResearchTopic", "field", "string", False),
    ("business_report", "Company", "name", "string", True),
    ("business_report", "Company", "industry", "string", False),
    ("business_report", "Company", "ticker", "string", False),
    ("business_report", "FinancialMetric", "name", "string", True),
    ("business_report", "FinancialMetric", "value", "number", True),
    ("business_report", "FinancialMetric", "unit", "string", False),
    ("business_report", "FinancialMetric", "period", "string", False),
    ("business_report", "FinancialMetric", "change", "string", False),
    ("business_report", "MarketSegment", "name", "string", True),
    ("business_report", "MarketSegment", "size", "string", False),
    ("business_report", "MarketSegment", "growth_rate", "string", False),
    ("business_report", "Recommendation", "description", "string", True),
    ("business_report", "Recommendation", "priority", "string", False),
    ("business_report", "Recommendation", "timeline", "string", False),
    ("technical_documentation", "API", "name", "string", True),
    ("technical_documentation", "API", "version", "string", False),
    ("technical_documentation", "API", "base_url", "string", False),
    ("technical_documentation", "Endpoint", "path", "string", True),
    ("technical_documentation", "Endpoint", "method", "string", True),
    ("technical_documentation", "Endpoint", "description", "string", False),
    ("technical_documentation", "Parameter", "name", "string", True),
    ("technical_documentation", "Parameter", "type", "string", True),
    ("technical_documentation", "Parameter", "required", "string", False),
    ("technical_documentation", "Parameter", "description", "string", False),
    ("legal_document", "Party", "name", "string", True),
    ("legal_document", "Party", "role", "string", False),
    ("legal_document", "Party", "address", "string", False),
    ("legal_document", "Clause", "number", "string", True),
    ("legal_document", "Clause", "title", "string", False),
    ("legal_document", "Clause", "description", "string", True),
    ("legal_document", "Obligation", "description", "string", True),
    ("legal_document", "Obligation", "deadline", "date", False),
    ("medical_document", "Patient", "name", "string", True),
    ("medical_document", "Patient", "age", "number", False),
    ("medical_document", "Patient", "gender", "string", False),
    ("medical_document", "Patient", "mrn", "string", False),
    ("medical_document", "Diagnosis", "condition", "string", True),
    ("medical_document", "Diagnosis", "icd_code", "string", False),
    ("medical_document", "Diagnosis", "severity", "string", False),
    ("medical_document", "Treatment", "name", "string", True),
    ("medical_document", "Treatment", "type", "string", False),
    ("medical_document", "Treatment", "dosage", "string", False),
    ("general", "Entity", "name", "string", True),
    ("general", "Entity", "type", "string", False),
    ("general", "Entity", "description", "string", False),
)
#: The same by domain and entity type: (field, type, required) in order.
SCHEMAS: dict[str, dict[str, list[tuple[str, str, bool]]]] = {}
for _domain, _entity, *_field in SCHEMA_ROWS:
    SCHEMAS.setdefault(_domain, {}).setdefault(_entity, []).append(tuple(_field))
#: Skills looked for in resumes, in order (fixed values).
SKILLS = ("Python", "Java", "JavaScript", "C++", "SQL", "React", "Node.js", "AWS", "Docker", "Kubernetes", "Machine Learning", "Data Science", "Git", "Linux", "REST API", "MongoDB", "PostgreSQL")
#: Patterns of the rule extractors (fixed values).
EMAIL, PHONE, DOI = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"[\+\(]?[1-9][0-9 .\-\(\)]{8,}[0-9]", r"\b10\.\d{4,}/[^\s]+"


def schema_fields(spark: SparkSession) -> DataFrame:
    """The registry as rows: domain, entity_type, field, ftype, required, ord."""
    rows = [(domain, entity, *field, k) for domain, types in SCHEMAS.items() for entity, fields in types.items() for k, field in enumerate(fields)]
    return spark.createDataFrame(rows, "domain string, entity_type string, field string, ftype string, required boolean, ord int")


def first_match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, f"({pattern})", 1), F.lit(""))


def skills(text: Column) -> Column:
    low = F.lower(text)
    found = F.array(*[F.struct(F.lit(f"skill_{k}").alias("id"), F.lit(s).alias("name"), low.contains(s.lower()).alias("hit")) for k, s in enumerate(SKILLS)])
    return F.filter(found, lambda x: x["hit"])


def _entity(kind: str, id_: Column, fields: Column, confidence: float, source: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), id_.alias("id"), fields.alias("fields"), F.lit(confidence).alias("confidence"), source.alias("source_text"))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None) -> DataFrame:
    """(id, domain, schema_version, entities) by the rules of each domain; only resumes and papers have any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    email, phone, doi = first_match(text, EMAIL), first_match(text, PHONE), first_match(text, DOI)
    fields = F.map_filter(F.create_map(F.lit("email"), email, F.lit("phone"), phone), lambda _, v: v.isNotNull())
    none = F.filter(F.array(_entity("Person", F.lit(""), fields, 0.0, email)), lambda x: F.lit(False))
    person = F.when(email.isNotNull(), F.array(_entity("Person", F.lit("person_1"), fields, 0.9, email))).otherwise(none)
    skill = F.transform(skills(text), lambda s: _entity("Skill", s["id"], F.create_map(F.lit("name"), s["name"], F.lit("category"), F.lit("technical")), 0.8, s["name"]))
    paper = F.when(doi.isNotNull(), F.array(_entity("Paper", F.lit("paper_1"), F.create_map(F.lit("doi"), doi), 0.95, doi))).otherwise(none)
    kind = F.coalesce(F.col("domain") if domain is None else domain, F.lit("general"))
    entities = F.when(kind == "resume", F.concat(person, skill)).when(kind == "research_paper", paper).otherwise(none)
    return docs.select(id_col, kind.alias("domain"), F.lit("1.0").alias("schema_version"), entities.alias("entities"))


def extract_with_model(docs: DataFrame, model: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Entities by a model, by rules where its reply cannot be read or for general documents. docs: id, text, domain.

    ``model`` takes (id, prompt) and returns (id, reply), JSON {"entities": [{type, id, fields, confidence, source_text}]}; replies are repaired, and entities that
    lack a required field are left out.
    """
    prompts = None
    for d in SCHEMAS:
        if d != "general":
            part = docs.where(F.col("domain") == d).select(id_col, prompt(d, F.coalesce(F.col(text_col), F.lit(""))).alias("prompt"))
            prompts = part if prompts is None else prompts.unionByName(part)
    shape = "array<struct<type:string,id:string,fields:map<string,string>,confidence:double,source_text:string>>"
    said = model(prompts).select(F.col(id_col).alias("__id"), F.from_json(F.variant_get(repaired_json(F.col("reply")), "$.entities", "string"), shape).alias("said"))
    registry = schema_fields(docs.sparkSession).groupBy("domain").agg(F.map_from_entries(F.collect_set(F.struct("entity_type", F.lit(True)))).alias("known")).withColumnRenamed("domain", "__d")
    needed = schema_fields(docs.sparkSession).where("required").groupBy("domain").agg(F.collect_set(F.concat_ws(".", "entity_type", "field")).alias("need")).withColumnRenamed("domain", "__e")
    rules = extract(docs, id_col, text_col)
    both = rules.join(said, F.col(id_col) == F.col("__id"), "left").join(F.broadcast(registry), F.col("domain") == F.col("__d"), "left").join(F.broadcast(needed), F.col("domain") == F.col("__e"), "left")
    lacks = lambda e: F.exists("need", lambda n: n.startswith(F.concat(e["type"], F.lit("."))) & ~F.array_contains(F.map_keys(e["fields"]), F.substring_index(n, ".", -1)))
    good = F.filter("said", lambda e: F.coalesce(F.try_element_at("known", e["type"]), F.lit(False)) & ~lacks(e))
    return both.select(id_col, "domain", "schema_version", F.coalesce(good, F.col("entities")).alias("entities"))


def validated(entities: DataFrame, domain_col: str = "domain") -> DataFrame:
    """Entities (domain, type, fields map) of a type that the domain knows, with all required fields present."""
    registry = schema_fields(entities.sparkSession)
    needed = registry.groupBy(F.col("domain").alias("__d"), F.col("entity_type").alias("__t")).agg(F.collect_list(F.when(F.col("required"), F.col("field"))).alias("__need"))
    kept = entities.join(F.broadcast(needed), (F.col(domain_col) == F.col("__d")) & (F.col("type") == F.col("__t")))
    return kept.where(F.forall("__need", lambda f: F.array_contains(F.map_keys("fields"), f))).drop("__d", "__t", "__need")


def repaired_json(reply: Column) -> Column:
    """A model's reply as VARIANT: without its fence, else what stands between its outer braces, else that without trailing commas."""
    bare = F.trim(F.regexp_replace(reply, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    braces = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(braces), F.try_parse_json(F.regexp_replace(braces, r",\s*([}\]])", "$1")))


def prompt(domain: str, text: Column) -> Column:
    """An extraction prompt: up to five entity types with required and at most three optional fields, the text cut at 6000 characters."""
    lines = []
    for entity, fields in list(SCHEMAS.get(domain, SCHEMAS["general"]).items())[:5]:
        shown = [n + " (required)" for n, _, required in fields if required] + [n for n, _, required in fields if not required][:3]
        lines.append(f"- {entity}: {', '.join(shown)}")
    return F.concat(F.lit(f"Extract entities of a {domain} document as JSON.\n" + "\n".join(lines) + "\n\nDocument:\n"), F.substring(text, 1, 6000))
