"""Domain classification of documents: by file name, by patterns, by keywords, and a hybrid of them.

A model can be plugged in as a DataFrame function; without one the hybrid stands in for it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Domain:
    name: str
    keywords: tuple[str, ...]
    patterns: tuple[str, ...]


#: Domains in order of precedence with their keywords and patterns (fixed values).
DOMAINS = (
    Domain(
        "resume",
        ("resume", "cv", "curriculum vitae", "work experience", "education", "skills", "professional summary", "references", "accomplishments", "certifications", "languages"),
        (r"\b(?:skills?|technical skills?|core competencies)\b", r"\b(?:work experience|professional experience|employment history)\b", r"\b(?:education|academic background|qualifications)\b", r"\b(?:contact|email|phone|address)\b", r"\b(?:objective|summary|profile)\b"),
    ),
    Domain(
        "research_paper",
        ("abstract", "methodology", "results", "discussion", "conclusion", "references", "bibliography", "hypothesis", "experiment", "data analysis", "literature review", "doi", "citation", "journal"),
        (r"\babstract\b.*?\n", r"\b(?:introduction|background)\b", r"\b(?:methodology|methods?|approach)\b", r"\b(?:results?|findings?)\b", r"\b(?:discussion|analysis)\b", r"\b(?:conclusion|future work)\b", r"\breferences\b|\bbibliography\b"),
    ),
    Domain(
        "business_report",
        ("executive summary", "financial", "revenue", "profit", "market analysis", "stakeholder", "quarter", "fiscal year", "roi", "kpi", "metrics", "forecast", "budget"),
        (r"\b(?:executive summary|overview)\b", r"\b(?:financial|revenue|profit|loss)\b", r"\b(?:market|industry|sector)\b", r"\b(?:quarter|q[1-4]|fiscal year)\b", r"\b(?:recommendation|action items?)\b"),
    ),
    Domain(
        "technical_documentation",
        ("api", "function", "class", "method", "parameter", "return", "example", "usage", "installation", "configuration", "syntax", "command", "endpoint", "documentation"),
        (r"\b(?:api|endpoint|route)\b", r"\b(?:function|method|class)\b", r"\b(?:parameter|argument|return)\b", r"\b(?:example|usage|sample)\b", r"\b(?:install|setup|configuration)\b"),
    ),
    Domain(
        "legal_document",
        ("whereas", "hereby", "pursuant", "aforementioned", "clause", "section", "agreement", "contract", "party", "obligations", "terms", "conditions", "liability"),
        (r"\b(?:whereas|hereby|pursuant)\b", r"\b(?:clause|section|article)\s+\d+", r"\b(?:agreement|contract|terms)\b", r"\b(?:party|parties)\b", r"\b(?:obligations?|liability|indemnification)\b"),
    ),
    Domain(
        "medical_document",
        ("patient", "diagnosis", "treatment", "symptoms", "prescription", "medical history", "vital signs", "prognosis", "clinical", "examination"),
        (r"\b(?:patient|subject)\b", r"\b(?:diagnosis|diagnosed with)\b", r"\b(?:treatment|therapy|medication)\b", r"\b(?:symptoms?|signs?)\b", r"\b(?:clinical|medical|health)\b"),
    ),
)
#: Parts of file names that hint at a domain, in order (fixed values).
HINTS = (
    ("resume", ("resume", "cv")),
    ("research_paper", ("paper", "journal", "article")),
    ("business_report", ("report", "financial", "quarterly")),
    ("technical_documentation", ("api", "doc", "manual", "guide")),
    ("legal_document", ("contract", "agreement", "legal")),
    ("medical_document", ("medical", "patient", "clinical")),
)


def filename_hint(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for domain, parts in reversed(HINTS):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.lower(name).contains(p)
        out = F.when(hit, F.lit(domain)).otherwise(out)
    return out


def _verdict(scores: list[tuple[str, Column]]) -> Column:
    """The best domain (the first of equals) with its share of all scores; general with 0.5 where nothing scores.

    The scores stand in a one-element array, so that each is computed once although the verdict uses it several times.
    """
    names = [d for d, _ in scores]

    def judged(s: Column) -> Column:
        best = F.array_max(s)
        total = F.aggregate(s, F.lit(0), lambda a, x: a + x)
        none = total == 0
        named = F.map_from_arrays(F.array(*[F.lit(d) for d in names]), s)
        return F.struct(
            F.when(none, F.lit("general")).otherwise(F.element_at(F.array(*[F.lit(d) for d in names]), F.array_position(s, best).cast("int"))).alias("domain"),
            F.when(none, F.lit(0.5)).otherwise(best / F.when(none, F.lit(1)).otherwise(total)).alias("confidence"),
            F.map_filter(named, lambda _, v: v > 0).alias("all_scores"),
        )

    return F.element_at(F.transform(F.array(F.array(*[s.cast("int") for _, s in scores])), judged), 1)


def _cues(pattern: str) -> list[str] | None:
    """Texts of which one stands in all that a pattern matches; None where its shape does not tell.

    Known are alternatives that begin with letters, digits or blanks, alone or in a group that may follow a word's bound."""
    group = re.match(r"(?:\\b)?\(\?:([^()]+)\)(?![?*{])", pattern)
    if "|" in pattern[group.end() :] if group else "(" in pattern:
        return None
    out: list[str] = []
    for x in (group[1] if group else pattern).split("|"):
        found = re.match(r"(?:\\b)?((?:[a-z0-9 ](?![?*{]))+)(?:\[(\w)-(\w)\](?![?*{]))?", x)
        if found is None:
            return None
        out += [found[1] + chr(c) for c in range(ord(found[2]), ord(found[3]) + 1)] if found[2] else [found[1]]
    return out


def _lowered(text: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the text in lower case, which is made once a row; expressions beside a lambda would make it for each use."""
    return F.element_at(F.transform(F.array(F.lower(text)), body), 1)


def by_rules(text: Column, domains: tuple[Domain, ...] = DOMAINS) -> Column:
    """Counts of pattern matches. Word bounds are Unicode's in every Java. Where none of a pattern's texts stands, it is not tried."""

    def count(low: Column, p: str) -> Column:
        found, cues = F.regexp_count(low, F.lit("(?U)" + p)), _cues(p)
        if cues is None:
            return found
        hit = low.contains(cues[0])
        for c in cues[1:]:
            hit = hit | low.contains(c)
        return F.when(~hit, F.lit(0)).otherwise(found)

    return _lowered(text, lambda low: _verdict([(d.name, sum((count(low, p) for p in d.patterns[1:]), count(low, d.patterns[0]))) for d in domains]))


def by_keywords(text: Column, domains: tuple[Domain, ...] = DOMAINS) -> Column:
    """Numbers of distinct keywords that occur, also inside words."""
    one = lambda low, w: F.when(low.contains(w), F.lit(1)).otherwise(F.lit(0))
    return _lowered(text, lambda low: _verdict([(d.name, sum((one(low, w) for w in d.keywords[1:]), one(low, d.keywords[0]))) for d in domains]))


def hybrid(rule: Column, keyword: Column, hint: Column) -> Column:
    """A hint that either method confirms: 0.85. Agreement: the mean. Otherwise the more confident one, rules if equal."""
    confirmed = F.coalesce((hint == rule["domain"]) | (hint == keyword["domain"]), F.lit(False))
    same = rule["domain"] == keyword["domain"]
    sure = rule["confidence"] >= keyword["confidence"]
    return F.struct(
        F.when(confirmed, hint).when(same | sure, rule["domain"]).otherwise(keyword["domain"]).alias("domain"),
        F.when(confirmed, F.lit(0.85)).when(same, (rule["confidence"] + keyword["confidence"]) / 2).when(sure, rule["confidence"]).otherwise(keyword["confidence"]).alias("confidence"),
    )


def classify(docs: DataFrame, mode: str = "hybrid", id_col: str = "doc_id", text_col: str = "text", name: Column | None = None, model: Callable[[DataFrame], DataFrame] | None = None, domains: tuple[Domain, ...] = DOMAINS) -> DataFrame:
    """(id, domain, confidence, filename_hint, classification_mode). ``model`` takes (id, text) with texts cut at 3000 characters and returns
    (id, domain, confidence); unknown domains fall back to the hybrid."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hint = filename_hint(F.lit(None).cast("string") if name is None else name)
    rows = docs.select(F.col(id_col), text.alias("__text"), by_rules(text, domains).alias("rule"), by_keywords(text, domains).alias("keyword"), hint.alias("filename_hint"))
    mixed = hybrid(F.col("rule"), F.col("keyword"), F.col("filename_hint"))
    result = {"rule": F.col("rule"), "keyword": F.col("keyword")}.get(mode, mixed)
    if mode == "llm" and model is not None:
        said = model(rows.select(id_col, F.substring("__text", 1, 3000).alias("text"))).select(F.col(id_col).alias("__id"), F.struct("domain", "confidence").alias("said"))
        rows = rows.join(said, F.col(id_col) == F.col("__id"), "left")
        known = F.col("said.domain").isin(*[d.name for d in domains], "general")
        result = F.when(known, F.col("said")).otherwise(mixed)
    return rows.select(id_col, result["domain"].alias("domain"), result["confidence"].alias("confidence"), "filename_hint", F.lit(mode).alias("classification_mode"))
