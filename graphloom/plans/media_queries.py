"""Queries of the rules for PDF, image, audio and video files over the tables: documents stand for files, and decoders are made of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import media


def _files(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.concat(F.lit("/media/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def media_pdf(spark: SparkSession, d: str) -> DataFrame:
    """Pages are lines. The first extractor gives nothing for every third file, and blanks with a backup for every fifth page; the second reads whole files but for every seventh; the rest is rendered."""
    files = _files(spark, d)
    lines = files.select("path", "doc_id", F.split("text", "\n").alias("lines"))
    sized = lambda rows: rows.join(lines, "path").where("doc_id % 3 <> 0").select("path", F.size("lines").alias("pages"))
    of = lambda rows: rows.join(lines, "path").select("path", "dpi", "lines", F.explode(F.sequence("first", "last")).alias("page")).withColumn("line", F.get("lines", F.col("page")))
    first = media.Pages(sized, lambda rows: of(rows).select("path", "page", F.when(F.col("page") % 5 == 4, "  ").otherwise(F.col("line")).alias("text"), F.concat(F.lit("backup "), F.col("page").cast("string")).alias("backup")))
    whole = lambda rows: rows.where("doc_id % 7 <> 0").select("path", F.concat(F.lit("whole "), "text").alias("text"))
    drawn = media.Pages(lambda rows: rows.join(lines, "path").select("path", F.size("lines").alias("pages")), lambda rows: of(rows).select("path", "page", F.concat(F.col("dpi").cast("string"), F.lit(" "), "line").alias("text"), F.lit("").alias("backup")))
    found = media.pdf_texts(files, [first, whole], drawn, max_pages=30, dpi=150)
    return found.select("path", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"), "extractor")


PDF_SQL = r"""
WITH f AS (SELECT '/media/' || doc_id::VARCHAR AS path, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT *, string_split(text, chr(10))[1:30] AS lines FROM f),
t AS (SELECT path, CASE WHEN doc_id % 3 <> 0 THEN array_to_string(list_transform(lines, lambda x, i: CASE WHEN (i - 1) % 5 = 4 OR NOT regexp_matches(x, '[^\s\x{00A0}]') THEN 'backup ' || (i - 1)::VARCHAR ELSE x END), chr(10) || chr(10)) END AS a,
  CASE WHEN doc_id % 7 <> 0 THEN 'whole ' || text END AS b, array_to_string(list_transform(lines, lambda x: '150 ' || x), chr(10) || chr(10)) AS c FROM l)
SELECT path, md5(coalesce(a, b, c)) AS digest, length(coalesce(a, b, c))::BIGINT AS n, CASE WHEN a IS NOT NULL THEN '0' WHEN b IS NOT NULL THEN '1' ELSE 'ocr' END AS extractor FROM t
"""


def media_images(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth image has given content, the first engine fails for every third, the second for every fifth; regions are lines, as sure as they are long."""
    files = _files(spark, d)
    images = files.select("path", F.when(F.col("doc_id") % 4 == 0, F.col("text")).alias("content"))
    region = lambda x: F.struct(x.alias("text"), (F.length(x) % 100 / 100.0).alias("confidence"), F.array().cast("array<double>").alias("bbox"))
    regions = F.transform(F.split("text", "\n"), region)
    one = lambda rows: rows.join(files, "path").where("doc_id % 3 <> 0").select("path", F.lit(None).cast("string").alias("text"), regions.alias("regions"))
    two = lambda rows: rows.join(files, "path").where("doc_id % 5 <> 0").select("path", "text", F.when(F.col("doc_id") % 2 == 0, regions).alias("regions"))
    found = media.image_texts(images, [("one", one), ("two", two)])
    return found.select("path", F.md5("text").alias("digest"), "engine", F.round("confidence", 9).alias("confidence"), F.size("regions").cast("long").alias("n"))


IMAGES_SQL = rf"""
WITH f AS (SELECT '/media/' || doc_id::VARCHAR AS path, doc_id, coalesce(text, '') AS text FROM documents),
r AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\x{{00A0}}]')) AS lines FROM f),
e AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'synthetic' WHEN doc_id % 3 <> 0 THEN 'one' WHEN doc_id % 5 <> 0 THEN 'two' ELSE 'none' END AS engine FROM r),
h AS (SELECT *, CASE WHEN engine = 'one' OR (engine = 'two' AND doc_id % 2 = 0) THEN lines ELSE []::VARCHAR[] END AS held FROM e)
SELECT path, md5(CASE engine WHEN 'one' THEN array_to_string(lines, ' ') WHEN 'none' THEN '{media.NO_OCR}' ELSE text END) AS digest, engine,
  CASE WHEN engine = 'synthetic' THEN 1.0::DOUBLE WHEN len(held) > 0 THEN round(list_sum(list_transform(held, lambda x: (length(x) % 100) / 100.0::DOUBLE)) / len(held), 9) ELSE 0.0::DOUBLE END AS confidence, len(held)::BIGINT AS n FROM h
"""


def media_audio(spark: SparkSession, d: str) -> DataFrame:
    """A file is as long as its text has bytes and is missing for every eleventh; the model fails for every sixth, and only every second has given content."""
    files = _files(spark, d)
    audio = files.select("path", F.when(F.col("doc_id") % 11 != 0, F.octet_length("text")).alias("length"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("content"))
    parts = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.cast("double").alias("start"), (i + 1).cast("double").alias("end"), x.alias("text")))
    model = lambda rows: rows.join(files, "path").where("doc_id % 6 <> 0").select("path", F.concat(F.lit("heard "), "text").alias("text"), parts.alias("segments"))
    return media.transcripts(audio, ("model", model)).select("path", F.md5("content").alias("digest"), "transcription_model", F.size("segments").cast("long").alias("n"))


AUDIO_SQL = f"""
WITH f AS (SELECT '/media/' || doc_id::VARCHAR AS path, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT *, doc_id % 11 <> 0 AND strlen(text) >= {media.LEAST_AUDIO} AND doc_id % 6 <> 0 AS heard FROM f)
SELECT path, md5(CASE WHEN heard THEN 'heard ' || text WHEN doc_id % 2 = 0 THEN text ELSE '{media.NO_SPEECH}' END) AS digest, CASE WHEN heard THEN 'model' ELSE 'fallback' END AS transcription_model, CASE WHEN heard THEN len(string_split(text, chr(10))) ELSE 0 END::BIGINT AS n FROM m
"""


def media_video(spark: SparkSession, d: str) -> DataFrame:
    """Frames are words; every ninth video can't be opened, every fourth has no frame that can be read, every fifth no rate."""
    files = _files(spark, d)
    probe = lambda rows: rows.join(files, "path").where("doc_id % 9 <> 0").select("path", F.size(F.split("text", " ")).alias("frame_count"), F.when(F.col("doc_id") % 5 == 0, 0.0).otherwise(25.0).alias("frame_rate"), F.when(F.col("doc_id") % 4 != 0, 640).alias("width"), F.when(F.col("doc_id") % 4 != 0, 480).alias("height"))
    return media.video_info(files, probe).select("path", F.round("duration", 9).alias("duration"), "resolution", "frame_rate", F.col("frame_count").cast("long").alias("frame_count"), "error")


VIDEO_SQL = """
SELECT '/media/' || doc_id::VARCHAR AS path, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 0.0::DOUBLE ELSE round(n / 25.0::DOUBLE, 9) END AS duration, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'unknown' ELSE '640x480' END AS resolution,
  CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 0.0::DOUBLE ELSE 25.0::DOUBLE END AS frame_rate, CASE WHEN doc_id % 9 <> 0 THEN n END AS frame_count, CASE WHEN doc_id % 9 = 0 THEN 'Could not open video file' END AS error
FROM (SELECT doc_id, len(string_split(coalesce(text, ''), ' '))::BIGINT AS n FROM documents)
"""


def queries() -> dict:
    return {f.__name__: f for f in (media_pdf, media_images, media_audio, media_video)}


def oracle_sql() -> dict[str, str]:
    return {"media_pdf": PDF_SQL, "media_images": IMAGES_SQL, "media_audio": AUDIO_SQL, "media_video": VIDEO_SQL}
