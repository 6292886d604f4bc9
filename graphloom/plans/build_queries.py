"""Queries of the operators that build graphs from documents: parsing, classes, mentions, relations, linking, triples, property graphs, ontologies, index.

Where the tables' own texts have none of what an operator looks for, texts are put together from their columns by SQL that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, coref, domain, html, labelling, linking, ner, ontology, propgraph, relations, retrieval, triples
from ..operators import chunk as chunker
from ..operators.kg_views import DOCUMENT, ENTITY, KG, LABEL, TYPE, TableGraph
from ..sources import files, samples


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _made(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """A query in the common SQL over the tables that it names in braces."""
    names = [n for n in ("customer", "supplier", "nation", "part", "orders", "pages", "documents", "benchmark") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: _t(spark, d, n) for n in names})


def _duck(sql: str) -> str:
    out = sql
    for n in ("customer", "supplier", "nation", "part", "orders", "pages", "documents", "benchmark"):
        out = out.replace("{" + n + "}", n)
    return out


# Pages ---------------------------------------------------------------------------------------------------------------
_HEAD = """SELECT page_id, url, concat('<html><head><meta name="description" content="', 'About ', url, '"><META NAME=''keywords'' x CONTENT=''a', CAST(page_id % 7 AS STRING), ' , b,', CAST(page_id AS STRING), '''>',
  CASE WHEN page_id % 3 = 0 THEN concat('<script type="application/ld+json"> {{"@type": "Article", "id": ', CAST(page_id AS STRING), '}} </script>') ELSE '<script type="application/ld+json">{{broken</script>' END,
  CASE WHEN page_id % 2 = 0 THEN concat('<div itemscope itemtype="t"><b>item ', CAST(page_id AS STRING), '</b></div>') ELSE '' END, html) AS html FROM {pages}"""


def html_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Description, keywords, JSON-LD and microdata of pages that were given such heads."""
    m, s = F.col("metadata"), F.col("structured_data")
    return html.parse(_made(spark, d, _HEAD)).select("doc_id", m["description"].alias("description"), F.array_join(m["keywords"], "|").alias("keywords"), F.array_join(s["json_ld"], "|").alias("json_ld"), F.array_join(s["microdata"], "|").alias("microdata"))


METADATA_SQL = """
SELECT page_id::VARCHAR AS doc_id, 'About ' || url AS description, 'a' || (page_id % 7)::VARCHAR || '|b|' || page_id::VARCHAR AS keywords,
  CASE WHEN page_id % 3 = 0 THEN '{"@type": "Article", "id": ' || page_id::VARCHAR || '}' ELSE '' END AS json_ld,
  CASE WHEN page_id % 2 = 0 THEN '<div itemscope itemtype="t"><b>item ' || page_id::VARCHAR || '</b>' ELSE '' END AS microdata FROM pages
"""


def html_entities(spark: SparkSession, d: str) -> DataFrame:
    """Named and numbered entities, after the text."""
    e = F.concat(F.lit("x &lt;b&gt; &#39;q&#39; &copy;&nbsp;&#x41;&#66; &eacute;&amp;lt; &hellip; "), F.col("page_id").cast("string"))
    return _t(spark, d, "pages").select("page_id", T.decoded(e).alias("decoded"))


ENTITIES_SQL = "SELECT page_id, 'x <b> ''q'' ©' || chr(160) || 'AB é&lt; … ' || page_id::VARCHAR AS decoded FROM pages"


def parse_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Raw documents of several types to parsed ones: HTML through its parser, text as it is, others without text."""
    pages = _t(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("doc_id"), F.lit("html").alias("type"), F.col("html").alias("content"))
    docs = _t(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 5 == 0, "pdf").when(F.col("doc_id") % 5 == 1, F.lit(None)).otherwise("text").alias("type"), F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("content"))
    return files.parsed(pages.unionByName(docs)).select("doc_id", "type", F.md5("content").alias("digest"), F.length("content").cast("long").alias("n"))


def _dispatch_sql() -> str:
    from .text_queries import _clean_sql

    return f"""
SELECT 'p' || page_id::VARCHAR AS doc_id, 'html' AS type, md5(c) AS digest, length(c) AS n FROM (SELECT page_id, {_clean_sql('html')} AS c FROM pages)
UNION ALL SELECT 'd' || doc_id::VARCHAR, CASE WHEN doc_id % 5 = 0 THEN 'pdf' ELSE 'text' END, md5(c), length(c) FROM (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN coalesce(text, '') ELSE '' END AS c FROM documents)"""


def video_key_frames(spark: SparkSession, d: str) -> DataFrame:
    """Key frames of videos whose numbers of frames are prices."""
    made = _t(spark, d, "part").select("p_partkey", F.explode(files.key_frames(F.col("p_partkey").cast("int") * 3, F.lit(25.0))).alias("f"))
    return made.select("p_partkey", F.col("f.frame_number").cast("long").alias("frame_number"), F.round("f.timestamp", 6).alias("timestamp"))


FRAMES_SQL = """
SELECT p_partkey, i AS frame_number, round(i / 25.0::DOUBLE, 6) AS timestamp FROM (
  SELECT p_partkey, unnest(range(0, least(p_partkey * 3, 100), greatest(1, (p_partkey * 3) // 10))) AS i FROM part WHERE p_partkey * 3 > 0)
"""

# Classes of documents ----------------------------------------------------------------------------------------------------
_NAMED = """SELECT doc_id, text, CASE doc_id % 9 WHEN 0 THEN 'my_CV.txt' WHEN 1 THEN 'journal-7.pdf' WHEN 2 THEN 'quarterly_report.txt' WHEN 3 THEN 'user guide.md' WHEN 4 THEN 'Agreement.txt' WHEN 5 THEN 'patient.txt' WHEN 6 THEN 'x.bin' ELSE NULL END AS name FROM (
  SELECT doc_id, concat(text, CASE doc_id % 11 WHEN 0 THEN ' Skills: SQL. Work experience and education, references.' WHEN 1 THEN ' Abstract of this. Methods, results and discussion; references, doi.' WHEN 2 THEN ' Executive summary: revenue and profit in the quarter, budget.'
    WHEN 3 THEN ' The API endpoint has a parameter; usage example, installation.' WHEN 4 THEN ' Whereas the party hereby agrees, section 12 of the agreement.' WHEN 5 THEN ' The patient had symptoms; diagnosis and treatment.' ELSE '' END) AS text FROM {documents}) x"""


def _classified(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return classify.classify(_made(spark, d, _NAMED), mode, name=F.col("name")).select("doc_id", "domain", F.round("confidence", 6).alias("confidence"), "filename_hint")

    run.__name__ = f"domains_{mode}"
    return run


def _scores_sql() -> str:
    """Scores of both methods. Signs beyond ASCII become q (in words) or a blank, so that DuckDB's word bounds are Unicode's."""
    rules = [" + ".join(f"len(regexp_extract_all(low, '{p}'))" for p in x.patterns) for x in classify.DOMAINS]
    words = [" + ".join(f"(contains(lower(text), '{w}'))::INT" for w in x.keywords) for x in classify.DOMAINS]
    hint = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(name), '{p}')" for p in parts) + f" THEN '{x}'" for x, parts in classify.HINTS) + " END"
    low = r"regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}\x00-\x7F]', ' ', 'g'), '[^\x00-\x7F]', 'q', 'g')"
    names = "[" + ", ".join(f"'{x.name}'" for x in classify.DOMAINS) + "]"
    verdict = lambda s: f"CASE WHEN list_sum({s}) = 0 THEN 'general' ELSE {names}[list_position({s}, list_max({s}))] END"
    sure = lambda s: f"CASE WHEN list_sum({s}) = 0 THEN 0.5::DOUBLE ELSE list_max({s})::DOUBLE / list_sum({s}) END"
    return f"""
WITH n AS ({_duck(_NAMED)}), l AS (SELECT doc_id, text, name, {low} AS low FROM n),
s AS (SELECT doc_id, {hint} AS hint, [{', '.join(rules)}] AS r, [{', '.join(words)}] AS k FROM l),
v AS (SELECT doc_id, hint, {verdict('r')} AS rd, {sure('r')} AS rc, {verdict('k')} AS kd, {sure('k')} AS kc FROM s)"""


def _classified_sql(mode: str) -> str:
    pick = {"rule": "rd AS domain, round(rc, 6) AS confidence", "keyword": "kd AS domain, round(kc, 6) AS confidence"}.get(mode) or (
        "CASE WHEN hint IN (rd, kd) THEN hint WHEN rd = kd OR rc >= kc THEN rd ELSE kd END AS domain, "
        "round(CASE WHEN hint IN (rd, kd) THEN 0.85::DOUBLE WHEN rd = kd THEN (rc + kc) / 2 WHEN rc >= kc THEN rc ELSE kc END, 6) AS confidence"
    )
    return f"{_scores_sql()} SELECT doc_id, {pick}, hint AS filename_hint FROM v"


# Schemas and models' replies ------------------------------------------------------------------------------------------------
def domain_registry(spark: SparkSession, d: str) -> DataFrame:
    return domain.schema_fields(spark).groupBy("domain").agg(F.countDistinct("entity_type").alias("types"), F.count(F.lit(1)).alias("fields"), F.count_if("required").alias("required"))


REGISTRY_SQL = """
SELECT * FROM (VALUES ('resume', 6, 35, 8), ('research_paper', 6, 22, 6), ('business_report', 4, 14, 5), ('technical_documentation', 3, 10, 5), ('legal_document', 3, 8, 4), ('medical_document', 3, 10, 3), ('general', 1, 3, 1)) t(domain, types, fields, required)
"""
_REPLIES = """SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 10 = 7 THEN '{{"entities": [oops' ELSE concat(CASE c_custkey % 4 WHEN 0 THEN '```json\n' WHEN 1 THEN 'Here it is: ' ELSE '' END,
  '{{"entities": [{{"type": "Person", "id": "p', CAST(c_custkey AS STRING), '", "fields": {{', CASE WHEN c_custkey % 3 = 0 THEN '"email": "x"' ELSE concat('"name": "', c_name, '"') END, '}}, "confidence": 0.5}}, {{"type": "Nobody", "id": "n", "fields": {{"name": "z"}}}}]', CASE c_custkey % 4 WHEN 2 THEN ',}}' ELSE '}}' END,
  CASE c_custkey % 4 WHEN 0 THEN '\n```' WHEN 1 THEN ' as asked' ELSE '' END) END AS reply FROM {customer}"""


def model_replies(spark: SparkSession, d: str) -> DataFrame:
    """Entities of models' replies (fenced, wrapped, with trailing commas, broken) that their schema allows; rules stand in for those that cannot be read."""
    replies = _made(spark, d, _REPLIES).select(F.col("c_custkey").alias("doc_id"), "reply", F.concat(F.lit("mail c"), F.col("c_custkey").cast("string"), F.lit("@example.org")).alias("text"), F.lit("resume").alias("domain"))
    said = replies.select("doc_id", "reply")
    found = domain.extract_with_model(replies.select("doc_id", "text", "domain"), lambda p: p.join(said, "doc_id").select("doc_id", "reply"))
    each = found.select("doc_id", F.explode_outer("entities").alias("e"))
    return each.select("doc_id", F.col("e.type").alias("type"), F.col("e.id").alias("id"), F.coalesce(F.col("e.fields")["name"], F.col("e.fields")["email"]).alias("value"), F.col("e.confidence").alias("confidence"))


REPLIES_SQL = """
SELECT c_custkey AS doc_id, CASE WHEN bad OR c_custkey % 3 <> 0 THEN 'Person' END AS type, CASE WHEN bad THEN 'person_1' WHEN c_custkey % 3 <> 0 THEN 'p' || c_custkey::VARCHAR END AS id,
  CASE WHEN bad THEN 'c' || c_custkey::VARCHAR || '@example.org' WHEN c_custkey % 3 <> 0 THEN c_name END AS value, CASE WHEN bad THEN 0.9::DOUBLE WHEN c_custkey % 3 <> 0 THEN 0.5::DOUBLE END AS confidence
FROM (SELECT *, c_custkey % 10 = 7 AS bad FROM customer)
"""


def validated_entities(spark: SparkSession, d: str) -> DataFrame:
    made = _t(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "business_report").otherwise("general").alias("domain"), F.when(F.col("p_partkey") % 3 == 0, "FinancialMetric").otherwise("Company").alias("type"),
        F.when(F.col("p_partkey") % 5 == 0, F.create_map(F.lit("name"), F.col("p_name"))).otherwise(F.create_map(F.lit("name"), F.col("p_name"), F.lit("value"), F.lit(None).cast("string"))).alias("fields"))
    return domain.validated(made).select("p_partkey", "type")


VALIDATED_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'FinancialMetric' ELSE 'Company' END AS type FROM part WHERE p_partkey % 2 = 0 AND (p_partkey % 3 <> 0 OR p_partkey % 5 <> 0)"

# Mentions, labels, relations ---------------------------------------------------------------------------------------------------
_FIRST, _LAST = (f"element_at(array({', '.join(repr(n) for n in names)}), CAST(c_custkey % {len(names)} AS INT) + 1)" for names in (ner.FIRST_NAMES, (*ner.SURNAMES, "Kim")))
_STORY = f"""SELECT c_custkey AS doc_id, concat({_FIRST}, ' ', {_LAST}, ' works for ', CASE WHEN c_custkey % 2 = 0 THEN 'TechCorp' ELSE 'MediPharm' END, ' today. Later ', {_LAST}, ' met Maria and ', {_FIRST}, ' in ', n_name, CASE WHEN c_custkey % 3 = 0 THEN ' at Global Bank' ELSE '' END) AS text
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey"""


def ner_rules(spark: SparkSession, d: str) -> DataFrame:
    """Names found by the rules in sentences about customers."""
    return ner.extract(_made(spark, d, _STORY)).select("doc_id", "pos", "text", "type", "start_char", "end_char", F.round("confidence", 6).alias("confidence"))


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _story_sql() -> str:
    return _duck(_STORY.replace("{{", "{").replace("}}", "}")).replace("element_at(array(", "list_extract(list_value(").replace("AS STRING", "AS VARCHAR")


def _ner_sql(docs: str) -> str:
    return f"""
w AS (SELECT doc_id, text AS content, unnest(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> ''), 1) AS k FROM {docs}),
n AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY k) AS after FROM w),
f AS (SELECT doc_id, content, k, CASE WHEN w IN {tuple(ner.FIRST_NAMES)} AND after IN {tuple(ner.SURNAMES)} THEN w || ' ' || after ELSE w END AS m, CASE WHEN w IN {tuple(ner.FIRST_NAMES)} THEN 'PERSON' WHEN w IN {tuple(ner.ORGANISATIONS)} THEN 'ORG' END AS type FROM n),
mentions AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS pos, m AS text, type, (instr(content, m) - 1)::INT AS start_char, (instr(content, m) - 1 + length(m))::INT AS end_char, CASE type WHEN 'PERSON' THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM f WHERE type IS NOT NULL)"""


def _ner_rules_sql() -> str:
    return f"WITH docs AS ({_story_sql()}), {_ner_sql('docs')} SELECT * FROM mentions"


def ner_label_types(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of a model (here: nations by name) with their labels mapped to types."""
    docs = _made(spark, d, _STORY)
    label = F.element_at(F.array(*[F.lit(x) for x in ("PERSON", "ORG", "GPE", "LOC", "EVENT", "WORK_OF_ART", "DATE")]), (F.col("doc_id") % 7 + 1).cast("int"))
    model = lambda df: df.select("doc_id", label.alias("label"), F.regexp_extract("text", "in ([A-Z]+)", 1).alias("text"), (F.instr("text", " in ") + 3).alias("start_char"))
    return ner.extract(docs, model=model).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("start_char").alias("starts"))


def _labels_sql() -> str:
    return f"""WITH docs AS ({_story_sql()}) SELECT ['PERSON', 'ORG', 'PLACE', 'PLACE', 'EVENT', 'CONCEPT', 'CONCEPT'][doc_id % 7 + 1] AS type, count(*) AS n, sum(instr(text, ' in ') + 3)::BIGINT AS starts FROM docs GROUP BY 1"""


_ROLES = ("CEO", "CTO", "analyst")
_REPORT = f"""SELECT c_custkey AS doc_id, concat({_FIRST}, ' ', {_LAST}, CASE WHEN c_custkey % 4 = 0 THEN ', now' ELSE ',' END, ' the ', CASE c_custkey % 4 WHEN 1 THEN 'CEO' WHEN 2 THEN 'analyst' WHEN 3 THEN 'clerk' ELSE 'CTO' END, ' of ', CASE WHEN c_custkey % 2 = 0 THEN 'TechCorp Inc' ELSE 'the old Global Bank' END,
  '. At the product launch in ', n_name, ' it went well.') AS text FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey"""


def _dictionary(spark: SparkSession) -> DataFrame:
    names = [(f"{a} {b}", "PERSON") for a in ner.FIRST_NAMES for b in (*ner.SURNAMES, "Kim")] + [("TechCorp Inc", "ORG"), ("Global Bank", "ORG"), ("NATION_7", "PLACE"), ("product launch", "EVENT")]
    return spark.createDataFrame(names, "name string, type string")


def label_entities(spark: SparkSession, d: str) -> DataFrame:
    return labelling.entities(_made(spark, d, _REPORT), _dictionary(spark))


def label_relations(spark: SparkSession, d: str) -> DataFrame:
    return labelling.relations(_made(spark, d, _REPORT), _dictionary(spark), list(_ROLES))


def _report_sql() -> str:
    names = ", ".join(f"('{a} {b}', 'PERSON')" for a in ner.FIRST_NAMES for b in (*ner.SURNAMES, "Kim"))
    report = _duck(_REPORT.replace("{{", "{").replace("}}", "}")).replace("element_at(array(", "list_extract(list_value(")
    return f"WITH docs AS ({report}), names(name, type) AS (VALUES {names}, ('TechCorp Inc', 'ORG'), ('Global Bank', 'ORG'), ('NATION_7', 'PLACE'), ('product launch', 'EVENT'))"


def _label_entities_sql() -> str:
    return f"{_report_sql()} SELECT doc_id, name AS text, type, (instr(text, name) - 1)::INT AS start_char, (instr(text, name) - 1 + length(name))::INT AS end_char, CASE WHEN type = 'EVENT' THEN 'Product Launch' ELSE name END AS canonical_name FROM docs JOIN names ON contains(text, name)"


def _label_relations_sql() -> str:
    return f"""{_report_sql()}, p AS (SELECT doc_id, name AS subject, substring(text, instr(text, name) + length(name)) AS after FROM docs JOIN names ON type = 'PERSON' AND contains(text, name)),
r AS (SELECT doc_id, subject, regexp_extract(after, '^.{{0,19}}?the (CEO|CTO|analyst) of ([^.]*)\\.', 1) AS role, regexp_extract(after, '^.{{0,19}}?the (CEO|CTO|analyst) of ([^.]*)\\.', 2) AS whom FROM p)
SELECT doc_id, subject, name AS object, unnest(['WORKS_FOR', 'HAS_ROLE']) AS relation, role FROM r JOIN names ON type = 'ORG' AND contains(whom, name) WHERE role <> ''"""


def _story_mentions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _made(spark, d, _STORY)
    m = ner.extract(docs).select("doc_id", "pos", "text", "type", "start_char", "end_char")
    return docs, m.withColumn("role", F.when(F.col("text") == "TechCorp", "employer"))


def rel_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Relations by the patterns in the stories about customers."""
    docs, m = _story_mentions(spark, d)
    return relations.by_patterns(docs, m).select("doc_id", "subject", "object", "relation", F.round("confidence", 6).alias("confidence"), "subject_type", "object_type", "pos1", "pos2")


def _patterns_sql() -> str:
    hits = []
    for k, (kind, p, a, b) in enumerate(relations.PATTERNS):
        p = "(?i)" + p.replace(r"\w", r"[\p{L}\p{N}_]")
        hits.append(f"SELECT doc_id, {k} AS k, '{kind}' AS kind, '{a}' AS ta, '{b}' AS tb, unnest(regexp_extract_all(text, '{p}', 1)) AS a, unnest(regexp_extract_all(text, '{p}', 2)) AS b, generate_subscripts(regexp_extract_all(text, '{p}', 0), 1) AS i FROM docs")
    side = lambda s: f"""(SELECT doc_id, k, i, min(struct_pack(o := (lower(m.text) <> lower(trim(h.{s})))::INT, pos := m.pos, text := m.text, type := m.type)) AS {s}
  FROM h JOIN mentions m USING (doc_id) WHERE (h.t{s} = 'ENTITY' OR h.t{s} = m.type) AND (contains(lower(trim(h.{s})), lower(m.text)) OR contains(lower(m.text), lower(trim(h.{s})))) GROUP BY ALL)"""  # noqa: E731
    swap = "x.kind = 'WORKS_FOR' AND a.a.type = 'ORG' AND b.b.type = 'PERSON'"
    pick = lambda f, p, q: f"CASE WHEN {swap} THEN {q}.{f} ELSE {p}.{f} END"
    return f"""
WITH docs AS ({_story_sql()}), {_ner_sql('docs')}, h AS ({' UNION ALL '.join(hits)})
SELECT x.doc_id, {pick('text', 'a.a', 'b.b')} AS subject, {pick('text', 'b.b', 'a.a')} AS object, x.kind AS relation, 0.8::DOUBLE AS confidence, {pick('type', 'a.a', 'b.b')} AS subject_type, {pick('type', 'b.b', 'a.a')} AS object_type, a.a.pos AS pos1, b.b.pos AS pos2
FROM h x JOIN {side('a')} a ON a.doc_id = x.doc_id AND a.k = x.k AND a.i = x.i JOIN {side('b')} b ON b.doc_id = x.doc_id AND b.k = x.k AND b.i = x.i WHERE a.a.pos <> b.b.pos"""


def rel_extract(spark: SparkSession, d: str) -> DataFrame:
    """The three sources together, with roles; counted by relation and confidence."""
    docs, m = _story_mentions(spark, d)
    found = relations.extract(docs, m)
    return found.groupBy("relation", F.round("confidence", 2).alias("confidence")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def _extract_sql() -> str:
    kind = """CASE WHEN (x.type = 'PERSON' AND y.type = 'ORG') OR (x.type = 'ORG' AND y.type = 'PERSON') THEN 'WORKS_FOR' ELSE 'RELATED_TO' END"""
    swap = "CASE WHEN x.type = 'ORG' AND y.type = 'PERSON' THEN"
    pair = f"{swap} y.text ELSE x.text END AS subject, {swap} x.text ELSE y.text END AS object, {kind} AS relation"
    return f"""{_patterns_sql().replace('SELECT x.doc_id', ', pat AS (SELECT x.doc_id', 1)}),
near AS (SELECT x.doc_id, {pair}, 0.6::DOUBLE - (y.start_char - x.end_char) / 100.0::DOUBLE AS confidence FROM mentions x JOIN mentions y ON x.doc_id = y.doc_id AND y.start_char - x.end_char > 0 AND y.start_char - x.end_char < 50),
s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+')) AS s FROM docs),
sent AS (SELECT x.doc_id, {pair}, 0.5::DOUBLE AS confidence FROM mentions x JOIN s ON s.doc_id = x.doc_id AND contains(s.s, x.text) JOIN mentions y ON y.doc_id = x.doc_id AND contains(s.s, y.text) AND x.pos < y.pos),
every AS (SELECT doc_id, subject, object, relation, confidence FROM pat UNION ALL SELECT * FROM near UNION ALL SELECT * FROM sent),
best AS (SELECT doc_id, subject, object, relation, max(confidence) AS c FROM every GROUP BY ALL HAVING max(confidence) > 0.3)
SELECT relation, round(c, 2) AS confidence, count(*) AS n, count(DISTINCT doc_id) AS docs FROM best GROUP BY 1, 2"""


# Linking, coreference ------------------------------------------------------------------------------------------------------------
def link_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of the stories linked to the seed knowledge base: exact aliases, then partial or fuzzy ones."""
    _, m = _story_mentions(spark, d)
    return linking.link(m.select("doc_id", "pos", "text", "type"), linking.seed_kb(spark)).select("doc_id", "pos", "text", "linked_name", F.round("kb_confidence", 6).alias("kb_confidence"), "match_type", "kb_linked")


def _kb_sql() -> str:
    rows = ", ".join(f"('{c}', '{t}', '{i}', {_list(a)}, {k})" for k, (c, t, i, a) in enumerate(linking.SEEDS))
    return f"""kb(canonical, type, id, aliases, ord) AS (VALUES {rows}),
al AS (SELECT alias, max(struct_pack(ord := ord, k := k, canonical := canonical, type := type, id := id)) AS m FROM (SELECT lower(unnest(list_append(aliases, canonical))) AS alias, generate_subscripts(list_append(aliases, canonical), 1) AS k, * FROM kb) GROUP BY alias)"""


_FUZZY = """(contains(lower(text), lower(canonical)) OR contains(lower(canonical), lower(text)) OR len(list_intersect(list_distinct(string_split(lower(text), ' ')), string_split(lower(canonical), ' '))) >= least(len(string_split(text, ' ')), len(string_split(canonical, ' ')))
  OR (length(text) > 3 AND length(canonical) > 3 AND lower(text)[1:4] = lower(canonical)[1:4]))"""


def _link_sql() -> str:
    return f"""WITH docs AS ({_story_sql()}), {_ner_sql('docs')}, {_kb_sql()},
names AS (SELECT DISTINCT text, type FROM mentions),
exact AS (SELECT n.text, n.type, al.m.canonical AS canonical FROM names n JOIN al ON lower(n.text) = al.alias AND n.type = al.m.type),
part AS (SELECT n.text, n.type, min_by(canonical, ord) AS canonical FROM names n JOIN kb ON n.type = kb.type WHERE {_FUZZY} AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.text = n.text AND e.type = n.type) GROUP BY n.text, n.type)
SELECT doc_id, pos, m.text, coalesce(e.canonical, p.canonical, m.text) AS linked_name, CASE WHEN e.canonical IS NOT NULL THEN 0.95::DOUBLE WHEN p.canonical IS NOT NULL THEN 0.7::DOUBLE ELSE 0::DOUBLE END AS kb_confidence,
  CASE WHEN e.canonical IS NOT NULL THEN 'EXACT_MATCH' WHEN p.canonical IS NOT NULL THEN 'PARTIAL_MATCH' ELSE 'NO_MATCH' END AS match_type, coalesce(e.canonical, p.canonical) IS NOT NULL AS kb_linked
FROM mentions m LEFT JOIN exact e ON e.text = m.text AND e.type = m.type LEFT JOIN part p ON p.text = m.text AND p.type = m.type"""


def kb_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and one known name added to the seed knowledge base."""
    new = _t(spark, d, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_name").alias("canonical"), F.lit("ORG").alias("type"), F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).alias("id"), F.array(F.lower("s_name")).alias("aliases"))
    known = spark.createDataFrame([("London", "PLACE", "place_x", ["Londres"])], "canonical string, type string, id string, aliases array<string>")
    return linking.add_to_kb(linking.seed_kb(spark), new.unionByName(known)).select("canonical", "type", "id", F.array_join("aliases", "|").alias("aliases"))


def _upsert_sql() -> str:
    return f"""WITH {_kb_sql()}, new AS (SELECT s_name AS canonical, 'ORG' AS type, CASE WHEN s_suppkey % 10 = 0 THEN 's' || s_suppkey::VARCHAR END AS id, [lower(s_name)] AS aliases FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT 'London', 'PLACE', 'place_x', ['Londres']),
n AS (SELECT canonical, type, coalesce(id, lower(type) || '_' || (12 + row_number() OVER (ORDER BY canonical))::VARCHAR) AS id, aliases FROM new)
SELECT canonical, type, id, array_to_string(aliases, '|') AS aliases FROM n UNION ALL SELECT canonical, type, id, array_to_string(aliases, '|') FROM kb WHERE canonical NOT IN (SELECT canonical FROM new)"""


def _pair_mentions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Three organisations a document: a supplier, the same with a suffix, and another."""
    sup = _t(spark, d, "supplier")
    docs = sup.select(F.col("s_suppkey").alias("doc_id"), F.concat("s_name", F.lit(" and more")).alias("text"))
    names = F.array(F.col("s_name"), F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, F.lit(" Inc")).otherwise(F.lit(" Ltd"))), F.when(F.col("s_suppkey") % 3 == 0, F.lit("Acme Co")).otherwise(F.lit("Bell")))
    return docs, sup.select(F.col("s_suppkey").alias("doc_id"), F.posexplode(names).alias("pos", "text"), F.lit("ORG").alias("type"))


def coref_organisations(spark: SparkSession, d: str) -> DataFrame:
    docs, m = _pair_mentions(spark, d)
    return coref.chains(coref.clusters(m, docs)).select("doc_id", F.array_join("mentions", "|").alias("mentions"), "canonical_entity", F.round("confidence", 6).alias("confidence"))


COREF_SQL = """
WITH s AS (SELECT s_suppkey AS doc_id, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' Inc' ELSE ' Ltd' END AS long, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'Acme Co' ELSE 'Bell' END AS other FROM supplier)
SELECT doc_id, s_name || '|' || long AS mentions, long AS canonical_entity, 0.8::DOUBLE AS confidence FROM s UNION ALL SELECT doc_id, other, other, 0.3::DOUBLE FROM s
"""


def coref_same_as(spark: SparkSession, d: str) -> DataFrame:
    docs, m = _pair_mentions(spark, d)
    return coref.same_as(coref.chains(coref.clusters(m, docs))).select("doc_id", "entity1", "entity2", F.round("confidence", 6).alias("confidence"), "type")


def coref_resolved(spark: SparkSession, d: str) -> DataFrame:
    docs, m = _pair_mentions(spark, d)
    return coref.resolved(m, coref.chains(coref.clusters(m, docs))).select("doc_id", "pos", "original_text", "resolved_name")


SAME_AS_SQL = "SELECT s_suppkey AS doc_id, s_name AS entity1, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' Inc' ELSE ' Ltd' END AS entity2, 0.8::DOUBLE AS confidence, 'SAME_AS' AS type FROM supplier"
RESOLVED_SQL = """
WITH s AS (SELECT s_suppkey AS doc_id, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' Inc' ELSE ' Ltd' END AS long, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'Acme Co' ELSE 'Bell' END AS other FROM supplier)
SELECT doc_id, 0::INT AS pos, s_name AS original_text, long AS resolved_name FROM s UNION ALL SELECT doc_id, 1, long, long FROM s UNION ALL SELECT doc_id, 2, other, other FROM s
"""


def coref_persons(spark: SparkSession, d: str) -> DataFrame:
    """Full names and surnames: one person where the text has both on a line but in no sentence together, in any case."""
    cust = _t(spark, d, "customer")
    low = F.col("c_custkey") % 3
    text = F.when(low == 0, "Ann Lee came. ann lee and her dog left; LEE slept.").when(low == 1, "Ann Lee met Lee.").otherwise("Ann Lee came.\nLee left.")
    docs = cust.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))
    m = cust.select(F.col("c_custkey").alias("doc_id"), F.posexplode(F.array(F.lit("Ann Lee"), F.when(low == 0, "LEE").otherwise("Lee"))).alias("pos", "text"), F.lit("PERSON").alias("type"))
    return coref.chains(coref.clusters(m, docs)).select("doc_id", F.array_join("mentions", "|").alias("mentions"), F.round("confidence", 6).alias("confidence"))


PERSONS_SQL = """
SELECT c_custkey AS doc_id, 'Ann Lee|LEE' AS mentions, 0.8::DOUBLE AS confidence FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, unnest(['Ann Lee', 'Lee']), 0.3::DOUBLE FROM customer WHERE c_custkey % 3 <> 0
"""

# Triples ---------------------------------------------------------------------------------------------------------------------------
def _graph(spark: SparkSession, d: str) -> DataFrame:
    """Stories, their linked mentions and relations, and entities of a domain, as one set of triples."""
    docs, m = _story_mentions(spark, d)
    full = docs.select("doc_id", "text", F.lit("story").alias("source_type"), F.lit("2024-05-01").alias("created_at"))
    linked = linking.link(m, linking.seed_kb(spark))
    found = relations.by_nearness(m)
    people = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit("Company").alias("type"), F.concat(F.lit("c "), F.col("s_suppkey").cast("string")).alias("id"), F.create_map(F.lit("company"), F.col("s_name"), F.lit("start_date"), F.lit(None).cast("string"), F.lit("growth_rate"), F.lit("7")).alias("fields"), F.lit(0.5).alias("confidence"), F.lit("src").alias("source_text"))
    return triples.graph(triples.document_triples(full), triples.mention_triples(linked), triples.relation_triples(found, linked), triples.domain_triples(people))


def documents_to_graph(spark: SparkSession, d: str) -> DataFrame:
    """How many triples, subjects and objects each predicate has, with a digest of all subjects and objects."""
    t = _graph(spark, d)
    mark = F.conv(F.substring(F.md5(F.concat_ws("|", "s", "o")), 1, 8), 16, 10).cast("long")
    return t.groupBy("p", "o_kind", "o_dtype").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"), F.sum(mark).alias("digest"))


def _graph_sql() -> str:
    xsd = triples.XSD
    iri = lambda t, n: f"'{ENTITY}' || sha256({t} || '|' || lower({n}))[1:32]"
    doc = lambda c: f"'{DOCUMENT}' || {c}::VARCHAR"
    row = lambda s, p, o, k="literal", t="string": f"SELECT {s}, '{p}', {o}, '{k}', {f"'{xsd}{t}'" if k == 'literal' else 'NULL'}"
    linked = _link_sql().replace("SELECT doc_id, pos, m.text,", ", linked AS (SELECT doc_id, pos, m.type, m.text,", 1) + ")"
    kind = "CASE type WHEN 'PERSON' THEN 'Person' ELSE 'Organization' END"
    e, named = iri("type", "linked_name"), "(SELECT doc_id, text, min(" + iri("type", "linked_name") + ") AS iri FROM linked GROUP BY ALL)"
    near = """(SELECT x.doc_id, CASE WHEN x.type = 'ORG' AND y.type = 'PERSON' THEN y.text ELSE x.text END AS subject, CASE WHEN x.type = 'ORG' AND y.type = 'PERSON' THEN x.text ELSE y.text END AS object,
      CASE WHEN x.type <> y.type THEN 'WORKS_FOR' ELSE 'RELATED_TO' END AS relation, 0.6::DOUBLE - (y.start_char - x.end_char) / 100.0::DOUBLE AS c FROM mentions x JOIN mentions y ON x.doc_id = y.doc_id AND y.start_char - x.end_char > 0 AND y.start_char - x.end_char < 50)"""
    rel = f"r AS (SELECT n.*, a.iri AS si, b.iri AS oi, CASE n.relation WHEN 'WORKS_FOR' THEN '{KG}worksFor' ELSE '{KG}relatedTo' END AS p, '{ENTITY}relation/' || sha256(n.doc_id::VARCHAR || '|' || a.iri || '|' || b.iri || '|' || n.relation)[1:32] AS rid FROM {near} n JOIN {named} a ON a.doc_id = n.doc_id AND a.text = n.subject JOIN {named} b ON b.doc_id = n.doc_id AND b.text = n.object)"
    sup = f"'{ENTITY}' || s_suppkey::VARCHAR || '_c%20' || s_suppkey::VARCHAR"
    parts = [
        *(x + " FROM docs" for x in (row(doc("doc_id"), TYPE, f"'{KG}Document'", "iri"), row(doc("doc_id"), LABEL, "'Document ' || doc_id::VARCHAR"), row(doc("doc_id"), KG + "hasText", "text"), row(doc("doc_id"), KG + "sourceType", "'story'"), row(doc("doc_id"), KG + "createdAt", "'2024-05-01'", "literal", "dateTime"))),
        *(x + " FROM linked" for x in (row(e, TYPE, f"'{KG}' || {kind}", "iri"), row(e, LABEL, "linked_name"), row(e, KG + "extractedFrom", doc("doc_id"), "iri"), row(doc("doc_id"), KG + "mentions", e, "iri"))),
        row(e, KG + "hasAlias", "text") + " FROM linked WHERE text <> linked_name",
        row(e, KG + "hasRole", "'employer'") + " FROM linked WHERE text = 'TechCorp'",
        "SELECT si, p, oi, 'iri', NULL FROM r",
        *(x + " FROM r" for x in (row("rid", TYPE, f"'{KG}Relation'", "iri"), row("rid", KG + "relationType", "p", "iri"), row("rid", KG + "hasSubject", "si", "iri"), row("rid", KG + "hasObject", "oi", "iri"), row("rid", KG + "hasRelation", "si", "iri"), row("rid", KG + "relationWith", "oi", "iri"), row("rid", KG + "confidence", "c::VARCHAR", "literal", "float"), row("rid", KG + "evidence", "'proximity'"), row("rid", KG + "extractedFrom", doc("doc_id"), "iri"))),
        *(x + " FROM supplier" for x in (row(sup, TYPE, f"'{KG}Company'", "iri"), row(sup, LABEL, "s_name"), row(sup, KG + "extractedFrom", doc("s_suppkey"), "iri"), row(doc("s_suppkey"), KG + "mentions", sup, "iri"), row(sup, KG + "hasConfidence", "'0.5'", "literal", "float"), row(sup, KG + "hasSourceText", "'src'"), row(sup, KG + "hasCompany", "s_name"), row(sup, KG + "hasGrowthRate", "'7'"))),
    ]
    return f"{linked}, {rel}, t(s, p, o, o_kind, o_dtype) AS ({' UNION '.join(parts)})"


def documents_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return triples.stats(_graph(spark, d))


def ntriples_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the sink, with quotes, tabs and line ends in the texts."""
    made = _t(spark, d, "customer").select(F.concat(F.lit(ENTITY), F.col("c_custkey").cast("string")).alias("s"), F.lit(KG + "hasText").alias("p"), F.concat("c_name", F.lit(' "a\\b"\tc\r\nd')).alias("o"), F.lit("literal").alias("o_kind"), F.when(F.col("c_custkey") % 2 == 0, F.lit(triples.XSD + "dateTime")).otherwise(F.lit(triples.XSD + "string")).alias("o_dtype"))
    return files.ntriples(made)


def _lines_sql() -> str:
    return f"""SELECT '<{ENTITY}' || c_custkey::VARCHAR || '> <{KG}hasText> "' || c_name || ' \\"a\\\\b\\"\\tc\\r\\nd"' || CASE WHEN c_custkey % 2 = 0 THEN '^^<{triples.XSD}dateTime>' ELSE '' END || ' .' AS value FROM customer"""


# Property graph ----------------------------------------------------------------------------------------------------------------------
def _property_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers and nations as nodes, merged twice; edges between them, some of them to nobody."""
    c, n = _t(spark, d, "customer"), _t(spark, d, "nation")
    one = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.array(F.lit("Person")).alias("labels"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("seg"), F.col("c_mktsegment")).alias("properties"), F.lit(1).alias("seq"))
    two = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.array(F.lit("Person")).alias("labels"), F.create_map(F.lit("seg"), F.lit("NEW")).alias("properties"), F.lit(2).alias("seq"))
    place = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.array(F.lit("Nation"), F.lit("Place")).alias("labels"), F.create_map(F.lit("name"), F.col("n_name")).alias("properties"), F.lit(1).alias("seq"))
    nodes = propgraph.upsert_nodes(one.unionByName(two).unionByName(place))
    edge = lambda k, w: c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), (F.col("c_nationkey") + F.when(F.col("c_custkey") % 7 == 0, 100).otherwise(0)).cast("string")).alias("dst"), F.lit("LIVES_IN").alias("type"), F.create_map(F.lit("w"), F.lit(w)).alias("properties"), F.lit(k).alias("seq"))
    return nodes, propgraph.upsert_edges(edge(1, "old").unionByName(edge(2, "new")), nodes)


def pg_merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _property_graph(spark, d)[0].select("id", F.array_join("labels", ",").alias("labels"), F.col("properties")["name"].alias("name"), F.col("properties")["seg"].alias("seg"))


PG_NODES_SQL = """
SELECT 'c' || c_custkey::VARCHAR AS id, 'Person' AS labels, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS seg FROM customer
UNION ALL SELECT 'n' || n_nationkey::VARCHAR, 'Nation,Place', n_name, NULL FROM nation"""


def pg_merge_edges(spark: SparkSession, d: str) -> DataFrame:
    return _property_graph(spark, d)[1].select("src", "dst", "type", F.col("properties")["w"].alias("w"))


PG_EDGES_SQL = "SELECT 'c' || c_custkey::VARCHAR AS src, 'n' || c_nationkey::VARCHAR AS dst, 'LIVES_IN' AS type, 'new' AS w FROM customer WHERE c_custkey % 7 <> 0"


def pg_labels(spark: SparkSession, d: str) -> DataFrame:
    """All labels, and the number of all nodes."""
    nodes, _ = _property_graph(spark, d)
    return propgraph.all_labels(nodes).unionByName(propgraph.node_count(nodes).select(F.concat(F.lit("count "), F.col("n").cast("string")).alias("label")))


PG_LABELS_SQL = "SELECT unnest(['Person', 'Nation', 'Place']) AS label UNION ALL SELECT 'count ' || ((SELECT count(*) FROM customer) + (SELECT count(*) FROM nation))::VARCHAR"


def pg_detach_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left when nations of even number and their edges go: counts of nodes and edges."""
    nodes, edges = propgraph.detach_delete(*_property_graph(spark, d), F.expr("array_contains(labels, 'Place') AND CAST(substring(id, 2) AS INT) % 2 = 0"))
    return nodes.select(F.lit("node").alias("what")).unionAll(edges.select(F.lit("edge"))).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


PG_DELETE_SQL = "SELECT 'node' AS what, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation WHERE n_nationkey % 2 = 1) AS n UNION ALL SELECT 'edge', count(*) FROM customer WHERE c_custkey % 7 <> 0 AND c_nationkey % 2 = 1"


def pg_collected(spark: SparkSession, d: str) -> DataFrame:
    """People by nation whose name holds a 1, as collected lists."""
    nodes, edges = _property_graph(spark, d)
    return propgraph.collected(nodes, edges, "LIVES_IN", F.col("properties")["name"].contains("1")).select("id", F.array_join("names", ",").alias("names"))


PG_COLLECT_SQL = "SELECT 'n' || n_nationkey::VARCHAR AS id, string_agg(c_name, ',' ORDER BY c_name) AS names FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0 AND contains(n_name, '1') GROUP BY 1"


def pg_visualisation(spark: SparkSession, d: str) -> DataFrame:
    """JSON of three nodes of each label with their edges."""
    return propgraph.visualisation(*_property_graph(spark, d), 3).select("label", "id", "json")


PG_VIS_SQL = """
WITH e AS (SELECT 'c' || c_custkey::VARCHAR AS src, 'n' || c_nationkey::VARCHAR AS dst FROM customer WHERE c_custkey % 7 <> 0),
n AS (SELECT 'Person' AS label, 'c' || c_custkey::VARCHAR AS id, '"name":"' || c_name || '","seg":"' || CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END || '"' AS p FROM customer UNION ALL SELECT unnest(['Nation', 'Place']), 'n' || n_nationkey::VARCHAR, '"name":"' || n_name || '"' FROM nation),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM n),
o AS (SELECT src AS id, string_agg('{"type":"LIVES_IN","other":"' || dst || '"}', ',' ORDER BY dst) AS j FROM e GROUP BY 1), i AS (SELECT dst AS id, string_agg('{"type":"LIVES_IN","other":"' || src || '"}', ',' ORDER BY src) AS j FROM e GROUP BY 1)
SELECT label, r.id, '{"id":"' || r.id || '","properties":{' || p || '},"outgoing":[' || coalesce(o.j, '') || '],"incoming":[' || coalesce(i.j, '') || ']}' AS json FROM r LEFT JOIN o ON o.id = r.id LEFT JOIN i ON i.id = r.id WHERE k <= 3
"""


def pg_property_literals(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", propgraph.property_literal(F.create_map(F.lit("name"), F.concat(F.lit('"'), "p_name", F.lit("'s\"")), F.lit("size"), F.col("p_size").cast("string"), F.lit("big"), (F.col("p_size") > 25).cast("string"))).alias("literal"))


PG_LITERAL_SQL = """SELECT p_partkey, '{name: ''' || p_name || chr(92) || '''s'', size: ' || p_size::VARCHAR || ', big: ' || (p_size > 25)::VARCHAR || '}' AS literal FROM part"""

# Ontology and index ------------------------------------------------------------------------------------------------------------------------


def ontology_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Classes of mentions by source and combined; types are market segments and a synonym."""
    c = _t(spark, d, "customer").select(F.concat(F.lit("r"), (F.col("c_nationkey") % 3).cast("string")).alias("source_type"), F.when(F.col("c_custkey") % 4 == 0, "ORG").otherwise(F.lower(F.concat("c_mktsegment", F.lit("_x")))).alias("type"))
    return ontology.by_source(c)


BY_SOURCE_SQL = """
WITH c AS (SELECT DISTINCT 'r' || (c_nationkey % 3)::VARCHAR AS source_type, CASE WHEN c_custkey % 4 = 0 THEN 'Organization' ELSE upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) || 'X' END AS class FROM customer)
SELECT * FROM c UNION ALL SELECT DISTINCT 'combined', class FROM c"""


def ontology_new_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes and relation names beyond the core."""
    c = _t(spark, d, "customer").select(F.when(F.col("c_custkey") % 4 == 0, "work_experience").otherwise(F.lower("c_mktsegment")).alias("type"), F.when(F.col("c_custkey") % 3 == 0, "WORKS_FOR").otherwise(F.concat(F.lit("IN_"), F.col("c_mktsegment"))).alias("relation"))
    return ontology.classes(c).select(F.lit("class").alias("what"), F.col("class").alias("name")).unionByName(ontology.object_properties(c).select(F.lit("property").alias("what"), F.col("property").alias("name")))


NEW_CLASSES_SQL = "SELECT DISTINCT 'class' AS what, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) AS name FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT DISTINCT 'property', 'IN_' || c_mktsegment FROM customer WHERE c_custkey % 3 <> 0"


def ontology_merge(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation")
    a, b = n.where("n_nationkey < 15").select(F.col("n_name").alias("class")), n.where("n_nationkey >= 10").select(F.col("n_name").alias("class"))
    return ontology.merge_counts(a, b).select(F.col("sizes")[0].alias("a"), F.col("sizes")[1].alias("b"), "merged")


MERGE_SQL = "SELECT count(DISTINCT CASE WHEN n_nationkey < 15 THEN n_name END) AS a, count(DISTINCT CASE WHEN n_nationkey >= 10 THEN n_name END) AS b, count(DISTINCT n_name) AS merged FROM nation"


def index_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each document, with documents that have none."""
    docs = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("text")).alias("text"))
    return retrieval.index_metadata(docs, chunker.chunks(docs))


def _metadata_sql() -> str:
    from .text_queries import CHUNK_SQL

    return f"SELECT d.doc_id::VARCHAR AS doc_id, CASE WHEN d.doc_id % 10 = 0 THEN 0 ELSE coalesce(n, 0) END AS chunk_count FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({CHUNK_SQL}) GROUP BY doc_id) c ON c.doc_id = d.doc_id::VARCHAR"


# Samples, choices, core ontology, vectors, answers ------------------------------------------------------------------------------------
def sample_documents(spark: SparkSession, d: str) -> DataFrame:
    """As many made documents as there are customers, and the names that their ground truth lists."""
    made = samples.generated(spark, _t(spark, d, "customer").count())
    return made.select("doc_id", "type", "content", "created_at", F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["name"])), "|").alias("entities"))


def _samples_sql() -> str:
    pick = lambda names, step: f"{_list(names)}[(k // {step}) % {len(names)} + 1]"
    return f"""WITH g AS (SELECT unnest(range(0, (SELECT count(*) FROM customer))) AS k),
v AS (SELECT k, {_list([t for t, _ in samples.TEMPLATES])}[k % {len(samples.TEMPLATES)} + 1] AS type, {_list([x for _, x in samples.TEMPLATES])}[k % {len(samples.TEMPLATES)} + 1] AS x, {pick(samples.PEOPLE, 1)} AS p, {pick(samples.ORGANISATIONS, 3)} AS o, {pick(samples.PLACES, 5)} AS l, {pick(samples.ROLES, 2)} AS r FROM g)
SELECT type || '_' || k::VARCHAR AS doc_id, type, replace(replace(replace(replace(x, '{{p}}', p), '{{o}}', o), '{{l}}', l), '{{r}}', r) AS content, strftime(DATE '2024-01-01' + (k % 365)::INT, '%Y-%m-%d') AS created_at, 'PERSON:' || p || '|ORG:' || o || '|PLACE:' || l AS entities FROM v"""


def entity_choice(spark: SparkSession, d: str) -> DataFrame:
    """Which of three lists of mentions a document's graph is built from, and its mentions one by one."""
    k = F.col("c_custkey")
    some = lambda name, test: F.when(test, F.array(F.concat(F.lit(name), k.cast("string"))))
    rows = _t(spark, d, "customer").select(k.alias("doc_id"), triples.chosen_entities(F.coalesce(some("linked", k % 3 == 0), F.array().cast("array<string>")), some("extracted", k % 2 == 0), some("given", k % 5 != 0)).alias("entities"))
    return ontology.entities_of(rows)


CHOICE_SQL = "SELECT * FROM (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'linked' WHEN c_custkey % 2 = 0 THEN 'extracted' WHEN c_custkey % 5 <> 0 THEN 'given' END || c_custkey::VARCHAR AS entity FROM customer) WHERE entity IS NOT NULL"


def ontology_closure(spark: SparkSession, d: str) -> DataFrame:
    """How many classes of the core ontology are below each class, at any depth."""
    return ontology.superclasses(spark).groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"))


CLOSURE_SQL = "SELECT * FROM (VALUES ('Entity', 37), ('Document', 6), ('Person', 2), ('Organization', 1), ('Concept', 1)) t(ancestor, n)"


def ontology_core(spark: SparkSession, d: str) -> DataFrame:
    return ontology.core_properties(spark).groupBy("kind", "domain").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(">", "property", "range"))), ",").alias("properties")).where("domain in ('Person', 'Document', 'Relation')")


CORE_SQL = """SELECT * FROM (VALUES ('ObjectProperty', 'Person', 'hasCertification>Certification,hasSkill>Skill,participatedIn>Event,studiedAt>Education,workedAt>WorkExperience,worksFor>Organization'), ('DatatypeProperty', 'Person', 'hasRole>string'),
 ('ObjectProperty', 'Document', 'mentions>Entity'), ('DatatypeProperty', 'Document', 'createdAt>dateTime,hasText>string,sourceType>string'), ('ObjectProperty', 'Relation', 'relationWith>Entity'), ('DatatypeProperty', 'Relation', 'confidence>float')) t(kind, domain, properties)"""


def ontology_embedded(spark: SparkSession, d: str) -> DataFrame:
    return ontology.embedded(spark)


EMBEDDED_SQL = f"""WITH c AS (SELECT '{KG}' || unnest(['Person', 'Organization', 'Place', 'Event', 'Concept', 'Document']) AS s)
SELECT s, '{TYPE}' AS p, 'http://www.w3.org/2002/07/owl#Class' AS o FROM c UNION ALL SELECT s, 'http://www.w3.org/2000/01/rdf-schema#subClassOf', 'http://www.w3.org/2002/07/owl#Thing' FROM c
UNION ALL SELECT '{KG}' || unnest(['WORKS_FOR', 'LOCATED_IN', 'PARTICIPATED_IN', 'HAS_ROLE', 'MENTIONS', 'hasText', 'sourceType', 'createdAt', 'hasAlias', 'extractedFrom', 'mentions']), '{TYPE}', 'http://www.w3.org/2002/07/owl#ObjectProperty'"""


def bow_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Sparse vectors of unit length of the benchmark's texts, by their terms and weights."""
    docs = _t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return retrieval.bag_of_words(docs).select("doc_id", "term", F.round("w", 6).alias("w"))


VECTORS_SQL = r"""WITH w AS (SELECT item_id AS doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM benchmark), c AS (SELECT doc_id, term, count(*)::DOUBLE AS n FROM w WHERE term <> '' GROUP BY ALL)
SELECT doc_id, term, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS w FROM c"""


def vector_hits(spark: SparkSession, d: str) -> DataFrame:
    """The nearest benchmark texts to one of them, as hits with their texts."""
    docs = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), "text")
    asked = docs.orderBy("chunk_id").first()["text"]
    return retrieval.vector_hits(retrieval.bow_search(docs, asked, 5, "chunk_id"), docs).select("ord", F.md5("content").alias("digest"), F.round("score", 6).alias("score"), "type", "retriever")


HITS_SQL = r"""WITH q AS (SELECT text FROM benchmark ORDER BY item_id::VARCHAR LIMIT 1), qt AS (SELECT term, count(*)::DOUBLE AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM q) WHERE term <> '' GROUP BY term),
w AS (SELECT item_id::VARCHAR AS id, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM benchmark), c AS (SELECT id, term, count(*)::DOUBLE AS n FROM w WHERE term <> '' GROUP BY ALL),
s AS (SELECT c.id, sum(c.n * coalesce(qt.n, 0)) / (sqrt(sum(c.n * c.n)) * sqrt((SELECT sum(n * n) FROM qt))) AS score FROM c LEFT JOIN qt USING (term) GROUP BY c.id),
t AS (SELECT * FROM s WHERE score > 0 ORDER BY round(score, 9) DESC, id DESC LIMIT 5)
SELECT (row_number() OVER (ORDER BY score DESC, id) - 1)::INT AS ord, md5(text) AS digest, round(score, 6) AS score, 'text_chunk' AS type, 'vector' AS retriever FROM t JOIN benchmark ON item_id::VARCHAR = id"""


def question_answer(spark: SparkSession, d: str) -> DataFrame:
    """The answer to a question about a nation, from the graph's facts."""
    from .. import api

    docs = _t(spark, d, "documents").select("doc_id", "text")
    return api.answer(TableGraph(spark, d), docs, "Where is NATION_3?")


ANSWER_SQL = f"""SELECT 'Where is NATION_3?' AS question, 'NATION_3 locatedIn {ENTITY}region/' || n_regionkey::VARCHAR || '; NATION_3 type {KG}Place; NATION_3 label NATION_3' AS answer, 0.6::DOUBLE AS confidence FROM nation WHERE n_name = 'NATION_3'"""


def graph_ping(spark: SparkSession, d: str) -> DataFrame:
    """The health check, and whether the graph holds a person and a ghost."""
    from .. import api

    g = TableGraph(spark, d)
    return propgraph.ping(spark).select("ok", F.lit(api.ask(g, "ASK { ?x a :Person . }")).alias("person"), F.lit(api.ask(g, "ASK { ?x a :Ghost . }")).alias("ghost"))


QUERIES = (
    html_metadata, html_entities, parse_dispatch, video_key_frames, _classified("rule"), _classified("keyword"), _classified("hybrid"), domain_registry, model_replies, validated_entities, ner_rules, ner_label_types, label_entities,
    label_relations, rel_patterns, rel_extract, link_seeds, kb_upsert, coref_organisations, coref_persons, coref_same_as, coref_resolved, documents_to_graph, documents_graph_stats, ntriples_lines, pg_merge_nodes, pg_merge_edges,
    pg_labels, pg_detach_delete, pg_collected, pg_visualisation, pg_property_literals, ontology_by_source, ontology_new_classes, ontology_merge, index_metadata,
    sample_documents, entity_choice, ontology_closure, ontology_core, ontology_embedded, bow_vectors, vector_hits, question_answer, graph_ping,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    digest = "('0x' || md5(s || '|' || o)[1:8])::BIGINT"
    return {
        "html_metadata": METADATA_SQL, "html_entities": ENTITIES_SQL, "parse_dispatch": _dispatch_sql(), "video_key_frames": FRAMES_SQL, "domains_rule": _classified_sql("rule"), "domains_keyword": _classified_sql("keyword"),
        "domains_hybrid": _classified_sql("hybrid"), "domain_registry": REGISTRY_SQL, "model_replies": REPLIES_SQL, "validated_entities": VALIDATED_SQL, "ner_rules": _ner_rules_sql(), "ner_label_types": _labels_sql(),
        "label_entities": _label_entities_sql(), "label_relations": _label_relations_sql(), "rel_patterns": _patterns_sql(), "rel_extract": _extract_sql(), "link_seeds": _link_sql(), "kb_upsert": _upsert_sql(),
        "coref_organisations": COREF_SQL, "coref_persons": PERSONS_SQL, "coref_same_as": SAME_AS_SQL, "coref_resolved": RESOLVED_SQL,
        "documents_to_graph": f"{_graph_sql()} SELECT p, o_kind, o_dtype, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects, sum({digest})::BIGINT AS digest FROM t GROUP BY p, o_kind, o_dtype",
        "documents_graph_stats": f"{_graph_sql()} SELECT count(*) AS triples, count(*) FILTER (p = '{TYPE}' AND o = '{KG}Document') AS documents, count(*) FILTER (p = '{TYPE}' AND o = '{KG}Relation') AS relations, count(*) FILTER (p = '{TYPE}' AND o NOT IN ('{KG}Document', '{KG}Relation')) AS entities FROM t",
        "ntriples_lines": _lines_sql(), "pg_merge_nodes": PG_NODES_SQL, "pg_merge_edges": PG_EDGES_SQL, "pg_labels": PG_LABELS_SQL, "pg_detach_delete": PG_DELETE_SQL, "pg_collected": PG_COLLECT_SQL, "pg_visualisation": PG_VIS_SQL,
        "pg_property_literals": PG_LITERAL_SQL, "ontology_by_source": BY_SOURCE_SQL, "ontology_new_classes": NEW_CLASSES_SQL, "ontology_merge": MERGE_SQL, "index_metadata": _metadata_sql(),
        "sample_documents": _samples_sql(), "entity_choice": CHOICE_SQL, "ontology_closure": CLOSURE_SQL, "ontology_core": CORE_SQL, "ontology_embedded": EMBEDDED_SQL, "bow_vectors": VECTORS_SQL, "vector_hits": HITS_SQL, "question_answer": ANSWER_SQL,
        "graph_ping": "SELECT 1 AS ok, true AS person, false AS ghost",
    }
