"""URL filters: given rules by host and path, and association rules mined from labelled URLs.

A URL's tokens are the labels of its host, pairs of neighbouring labels, and the words of its path and query keys, with numbers folded. The labelled URLs are halved by a hash. On one half
Spark's FP-growth mines the token sets that go with a bad label: enough URLs hold them (support), and bad ones are over-represented among those (confidence against the half's share of bad
URLs). Sets of which a kept one is a part go. The other half, which had no part in the choice, decides: a rule stays if its share of bad URLs there is above
that half's with certainty, by a lower bound that allows for the number of rules tried. Support and certainty are shares, the same at every size. Rules
are matched by an inverted index: each is filed under its rarest token, and only the rules under a URL's own tokens are compared with it, row by row.

Given rules are looked up by every suffix of the host; the longest that fits wins and overrides the mined ones.

Labels of texts become labels of URLs by ``labelled_urls``: a page whose text is that of a labelled document has its label.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule, and is allowed. Rows are judged one by one, so
repeated rows and null ids each get a row. Unlabelled URLs and null labels are not mined; a text with several labels is bad if one of them is. An empty table
gives an empty result; without labels nothing is mined. Other columns are not read.
"""

from __future__ import annotations

import json
from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Least share of the labelled URLs that hold a rule's tokens and are bad; least confidence of a rule, as a multiple of the share of bad URLs among all (1 at most); and the chance, for all
#: rules together, that one is kept which is no better than that share.
SUPPORT, LIFT, CHANCE = 0.01, 1.5, 0.05
#: Most rules that go into the plan as an index; more are joined by a shuffle.
INDEXED_RULES = 10_000
BAD = "\x00bad"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + F.lit(3))
    has = F.coalesce(at > 0, F.lit(False))
    lower = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, lower).otherwise(""), F.when(has, path).otherwise("")


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted."""
    host, path = parsed(url)
    labels = F.array_remove(F.split(host, r"\."), "")
    pairs = F.zip_with(labels, F.slice(labels, 2, F.greatest(F.size(labels), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat(F.lit("h:"), a, F.lit("."), b)))
    words = F.transform(F.array_remove(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), ""), lambda w: F.concat(F.lit("p:"), F.regexp_replace(w, r"[0-9]+", "0")))
    query = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda w: F.concat(F.lit("q:"), F.lower(w)))
    parts = F.flatten(F.transform(labels, lambda x: F.array_distinct(F.split(x, "-"))))
    every = F.concat(F.transform(parts, lambda x: F.concat(F.lit("h:"), x)), pairs, words, query)
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (F.length(x) > 2))))


def words_digest(text: Column) -> Column:
    """A hash of a text's words, whatever stands between them."""
    return F.md5(F.array_join(F.array_remove(F.split(text, r"\s+"), ""), " "))


def labelled_urls(pages: DataFrame, docs: DataFrame, labels: DataFrame, bad: Column, url_col: str = "url", html_col: str = "html", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(url, bad) of the pages whose article is the text of a labelled document. Only hashes are joined; each text is one row of labels, so a text
    that a third of all pages share is joined with one row."""
    known = docs.select(F.col(id_col).alias("i"), words_digest(F.col(text_col)).alias("h")).join(labels.select(F.col(id_col).alias("i"), bad.alias("b")), "i")
    verdicts = known.where("h is not null and b is not null").groupBy("h").agg(F.max("b").alias("bad"))
    article = F.regexp_extract(F.col(html_col), r"(?s)<article[^>]*>(?:\s*<h1[^>]*>.*?</h1>)?(.*?)</article>", 1)
    found = pages.select(F.col(url_col).alias("url"), words_digest(F.regexp_replace(article, "<[^>]*>", " ")).alias("h")).where("url is not null and h is not null")
    return found.distinct().join(verdicts, "h").select("url", "bad")


def candidates(items: DataFrame, support: float = SUPPORT, lift: float = LIFT) -> DataFrame:
    """Token sets (tokens, n: bad rows that hold them, confidence) of rows of tokens (items, with BAD in bad ones), without those that have a part which is one too."""
    counts = items.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("items", BAD)).alias("bad")).first()
    if not counts["bad"]:
        return items.sparkSession.createDataFrame([], "tokens array<string>, n long, confidence double")
    sets = written(FPGrowth(itemsCol="items", minSupport=support).fit(items).freqItemsets, "url-sets")
    with_bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("n"))
    every = sets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("held"))
    found = with_bad.join(every, "tokens").withColumn("confidence", F.col("n") / F.col("held"))
    least = min(1.0, lift * counts["bad"] / counts["n"])
    return _needed(written(found.where(F.col("confidence") >= least).select("tokens", "n", "confidence"), "url-rules"))


def held_out(rules: DataFrame, items: DataFrame) -> DataFrame:
    """Rules (tokens) with the rows of tokens that hold them (held), and the bad ones among these (n): each rule is looked up under its rarest token."""
    counts = items.select(F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    each = rules.select("tokens", F.explode("tokens").alias("token")).join(counts, "token")
    filed = each.groupBy("tokens").agg(F.min(F.struct("c", "token")).alias("x"), F.count(F.lit(1)).alias("k")).where(F.col("k") == F.size("tokens")).select("tokens", F.col("x.token").alias("token"))
    rows = items.select(F.col("items"), F.explode("items").alias("token"))
    hits = rows.join(filed, "token").where(F.size(F.array_except("tokens", "items")) == 0)
    return hits.groupBy("tokens").agg(F.count(F.lit(1)).alias("held"), F.count_if(F.array_contains("items", BAD)).alias("n"))


def mine(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", support: float = SUPPORT, lift: float = LIFT, chance: float = CHANCE) -> DataFrame:
    """Rules (tokens array, n: bad URLs of the other half that hold them, confidence there) from labelled URLs (bad: boolean)."""
    rows = labelled.where(F.col(bad_col).isNotNull() & F.col(url_col).isNotNull())
    own = tokens(F.col(url_col))
    half = F.pmod(F.xxhash64(url_col, F.lit(5)), F.lit(2)).cast("int")
    items = written(rows.select(half.alias("half"), F.when(F.col(bad_col), F.concat(own, F.array(F.lit(BAD)))).otherwise(own).alias("items")), "url-items")
    rules = written(candidates(items.where("half = 0").select("items"), support, lift), "url-candidates")
    rest = items.where("half = 1").select("items")
    share = rest.agg(F.avg(F.array_contains("items", BAD).cast("double"))).first()[0]
    tried = rules.count()
    if not tried or not share:
        return rules.where("false")
    z = -NormalDist().inv_cdf(chance / tried)
    c, z2 = F.col("n") / F.col("held"), z * z
    low = (c + z2 / (2 * F.col("held")) - z * F.sqrt(c * (1 - c) / F.col("held") + z2 / (4 * F.col("held") * F.col("held")))) / (1 + z2 / F.col("held"))
    return held_out(rules, rest).where(low > share).select("tokens", "n", c.alias("confidence"))


def _needed(rules: DataFrame) -> DataFrame:
    """Rules of which no other rule has a part of the tokens: what they match, that one matches. Each rule looks up the others under its own tokens."""
    filed = rules.select(F.col("tokens").alias("part"), F.array_min("tokens").alias("token"))
    pairs = rules.withColumn("token", F.explode("tokens")).join(filed, "token").where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0))
    return rules.join(pairs.select("tokens").distinct(), "tokens", "left_anti")


def indexed(rules: DataFrame, labelled: DataFrame, url_col: str = "url") -> DataFrame:
    """(token, needed): rules under that of their tokens that is rarest in the labelled URLs."""
    counts = labelled.select(F.explode(tokens(F.col(url_col))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = rules.select("tokens", F.explode("tokens").alias("token")).join(counts, "token", "left")
    least = each.groupBy("tokens").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    return least.select(F.col("least.token").alias("token"), F.col("tokens").alias("needed"))


def _hit(index: list, url: Column) -> Column:
    """Whether a rule of the index holds for a URL: its tokens look up their rules."""
    by_token: dict[str, list[list[str]]] = {}
    for r in index:
        by_token.setdefault(r["token"], []).append(list(r["needed"]))
    if not by_token:
        return F.lit(False)
    names = sorted(by_token)
    own = F.array_intersect(tokens(url), F.from_json(F.lit(json.dumps(names)), "array<string>"))
    table = F.from_json(F.lit(json.dumps(by_token)), "map<string, array<array<string>>>")
    every = tokens(url)
    return F.exists(own, lambda t: F.exists(F.try_element_at(table, t), lambda needed: F.size(F.array_except(needed, every)) == 0))


def matched(pages: DataFrame, index: DataFrame, url_col: str = "url", id_cols: list[str] | None = None) -> DataFrame:
    """The rows' columns (by default all) and ``hit``: whether a mined rule holds for the URL."""
    keep = id_cols or pages.columns
    few = index.limit(INDEXED_RULES + 1).collect()
    if len(few) <= INDEXED_RULES:
        hit = _hit(few, F.col(url_col))
        return pages.select(*keep, F.coalesce(hit, F.lit(False)).alias("hit"))
    urls = pages.select(F.col(url_col).alias("__url")).where("__url is not null").distinct().withColumn("own", tokens(F.col("__url")))
    hits = urls.withColumn("token", F.explode("own")).join(index, "token").where(F.size(F.array_except("needed", "own")) == 0).select("__url", F.lit(True).alias("__hit")).distinct()
    # Null urls match nothing; they are spread by a hash of the row instead of meeting in one task.
    key = F.coalesce(F.col(url_col), F.concat(F.lit("\x00"), F.xxhash64(*keep).cast("string")))
    return pages.withColumn("__key", key).join(hits, F.col("__key") == F.col("__url"), "left").select(*keep, F.coalesce("__hit", F.lit(False)).alias("hit"))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits, or nulls; rules are (host, path, verdict). For a list that fits a plan."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, index: DataFrame, given: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: the id, host, path, rule (of the given rule that decides, or null), verdict (allow or block), mined (a mined rule fits).

    ``index``: mined rules as ``indexed`` gives them.
    """
    own = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__u"))
    rows = matched(own, index, "__u").select("__id", "hit", *(x.alias(n) for x, n in zip(parsed(F.col("__u")), ("host", "path"))))
    rule, verdict = given_rule(F.col("host"), F.col("path"), given)
    return rows.select(F.col("__id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.col("hit").alias("mined"))


#: Given rules of the registered query: host, path, verdict.
GIVEN = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
