"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bytepair, chosenpath, collocations, licenses, mixing, packing, pii, quality, spellings, substring, urls, warc
from .common import table, written


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return quality.judge(docs, written(model, "quality-model"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pages_replica(pages: DataFrame, rotten: bool) -> DataFrame:
    """Records of all pages; a rotten replica has the first character of some payloads changed, chosen by a hash of the url."""
    html = F.coalesce(F.col("html"), F.lit(""))
    if rotten:
        hit = F.md5(F.coalesce(F.col("url"), F.lit(""))).startswith("0")
        html = F.when(hit, F.concat(F.lit("~"), F.substr(html, F.lit(2)))).otherwise(html)
    return pages.select("page_id", "url", warc.record(F.col("url"), html).alias("record"))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of all pages that was damaged on purpose (about one record in 16)."""
    pages = table(spark, sf_dir, "pages")
    return warc.audit_tables(pages_replica(pages, False), pages_replica(pages, True), ["page_id", "url"])


OP4_SQL = """
WITH both_ AS (
  SELECT page_id, url, coalesce(url, '') AS u, coalesce(html, '') AS a,
         CASE WHEN md5(coalesce(url, '')) LIKE '0%' THEN '~' || substr(coalesce(html, ''), 2) ELSE coalesce(html, '') END AS b FROM pages),
records AS (
  SELECT page_id, url,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(a) || chr(13) || chr(10) || chr(13) || chr(10) || a || chr(13) || chr(10) || chr(13) || chr(10) AS ra,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(b) || chr(13) || chr(10) || chr(13) || chr(10) || b || chr(13) || chr(10) || chr(13) || chr(10) AS rb
  FROM both_),
hashed AS (SELECT page_id, url, sha256(ra) AS digest_a, sha256(rb) AS digest_b, strlen(ra) AS la, strlen(rb) AS lb FROM records),
numbered AS (
  SELECT *, row_number() OVER w - 1 AS number, coalesce(sum(la) OVER p, 0) AS start_a, coalesce(sum(lb) OVER p, 0) AS start_b FROM hashed
  WINDOW w AS (ORDER BY page_id NULLS FIRST, url NULLS FIRST), p AS (ORDER BY page_id NULLS FIRST, url NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT number::BIGINT AS number, page_id, url, start_a::BIGINT AS start_a, (start_a + la)::BIGINT AS end_a, digest_a, 1::BIGINT AS times_a, start_b::BIGINT AS start_b, (start_b + lb)::BIGINT AS end_b, digest_b, 1::BIGINT AS times_b
FROM numbered WHERE digest_a <> digest_b
"""


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if its text is that of a document labelled toxic or of low quality."""
    pages = table(spark, sf_dir, "pages")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labelled = written(urls.labelled_urls(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bad), "url-labels")
    index = written(urls.indexed(urls.mine(labelled), labelled), "url-index")
    return urls.judge(pages, index, urls.GIVEN)


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.draws(docs, mixing.rates(docs)).withColumn("rate", F.round("rate", 9))


def op7_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.classes(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/id; a licence file is one that is a license as a whole."""
    docs = table(spark, sf_dir, "documents")
    idf = licenses.weights(licenses.document_frequencies(docs))
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    files = docs.select(F.struct(F.col("doc_id"), path.alias("path")).alias("file"), "text")
    found = written(licenses.scan(files, idf, "file").select("file.*", "license", "cosine", "piece", "line"), "license-lines")  # inherit reads it three times
    return licenses.inherit(found, "path", F.col("piece") == "file")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.variants(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bytepair.decode(bytepair.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    n = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_quality_rules, op2_substring_dedup, op3_packing, op4_warc_fixity, op5_url_filters,
        op6_poisson_mix, op7_prefix_forest, op8_jaccard_join, op9_pii, op10_license_scan,
        op11_spelling_variants, op12_byte_bpe, op13_collocations,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_fixity": OP4_SQL, "op6_poisson_mix": mixing.draws_sql(), "op11_spelling_variants": spellings.sql(), "op13_collocations": collocations.sql()}
