"""PDF, image, audio and video files: which decoder's result counts, in what order, with what confidence; the decoders themselves are plug-ins.

A decoder is a function from DataFrame to DataFrame, so it runs where the files are. Later decoders of a chain see only the files that earlier ones gave nothing for. Files with pages are
decoded by ranges of pages, so that a long file is not one task. A decoder written as a plain function of a path and bytes is wrapped by ``each_file``, which turns
its errors into no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import stem

Plug = Callable[[DataFrame], DataFrame]
#: What stands for results that no engine gave, and for videos that nothing probed (fixed values).
NO_OCR, NO_SPEECH, NO_TRANSCRIPT = "OCR not available for this image", "Audio transcription not available", "Audio content placeholder"
UNPROBED = (300.0, "1920x1080", 30.0, 9000)
#: Audio files of fewer bytes are taken for placeholders; pages of a range; dots an inch of rendered pages.
LEAST_AUDIO, RANGE, DPI = 100, 20, 200
REGIONS = "array<struct<text: string, confidence: double, bbox: array<double>>>"


def each_file(decode: Callable[[str, bytes], str | None]) -> Plug:
    """A decoder of (path, content) to (path, text) from a function of one file; files on which it fails have no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    out.append(decode(path, content.as_py()))
                except Exception:  # a plug-in's own errors, whatever they are, concern its file only
                    out.append(None)
            yield pa.record_batch([batch.column("path"), pa.array(out, pa.string())], names=["path", "text"])

    return lambda files: files.select("path", "content").mapInArrow(run, "path string, text string")


@dataclass
class Pages:
    """A decoder by pages. ``count``: (path) to (path, pages). ``read``: (path, first, last, dpi) to (path, page, text, backup), pages from 0; ``backup`` stands for a blank text."""

    count: Plug
    read: Plug

    def texts(self, files: DataFrame, max_pages: int | None = None, dpi: int = DPI) -> DataFrame:
        """(path, text): texts of up to ``max_pages`` pages (0 or None: all) in order, with a blank line between them."""
        n = F.least(F.col("pages"), F.lit(max_pages)) if max_pages else F.col("pages")
        starts = self.count(files.select("path")).where("pages > 0").withColumn("pages", n).select("path", "pages", F.explode(F.sequence(F.lit(0), F.col("pages") - 1, F.lit(RANGE))).alias("first"))
        ranges = starts.select("path", "first", F.least(F.col("first") + RANGE - 1, F.col("pages") - 1).alias("last"), F.lit(dpi).alias("dpi"))
        # Ranges are dealt by themselves: those of one long file don't stay together.
        read = self.read(ranges.repartition("path", "first"))
        text = F.when(blank(F.col("text")), F.coalesce("backup", F.lit(""))).otherwise(F.col("text"))
        parts = read.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", text.alias("text")))).alias("p"))
        return parts.select("path", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def blank(text: Column) -> Column:
    """Null, or nothing but white space."""
    return text.isNull() | ~text.rlike(r"(?U)\S")


def pdf_texts(files: DataFrame, extractors: list[Pages | Plug], ocr: Pages | None = None, max_pages: int | None = None, dpi: int = DPI) -> DataFrame:
    """(path, text, extractor): the text of the first extractor that gives more than white space, whole files' decoders without regard to ``max_pages``; else of ``ocr``, where it is given
    (that is: enabled); else empty, with extractor null."""
    chain = [*enumerate(extractors), *([("ocr", ocr)] if ocr else [])]
    out, left = None, files
    for name, extract in chain:
        got = extract.texts(left, max_pages, dpi) if isinstance(extract, Pages) else extract(left).select("path", "text")
        got = got.where(~blank(F.col("text"))).select("path", "text", F.lit(str(name)).alias("extractor"))
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select("path"), "path", "left_anti")
    rest = left.select("path", F.lit("").alias("text"), F.lit(None).cast("string").alias("extractor"))
    return rest if out is None else out.unionByName(rest)


def mean_confidence(regions: Column) -> Column:
    """The mean of the regions' confidence; 0 without regions."""
    total = F.aggregate(regions, F.lit(0.0), lambda s, r: s + F.coalesce(r["confidence"], F.lit(0.0)))
    return F.when(F.size(regions) > 0, total / F.size(regions)).otherwise(0.0)


def image_texts(images: DataFrame, engines: list[tuple[str, Plug]]) -> DataFrame:
    """Images (path, and given content or null) to (path, text, engine, confidence, regions).

    Given content is taken as it is. Else the first engine with a row for the image counts, even an empty one: an engine gives (path, text, regions: REGIONS); a null text is its
    regions' texts with blanks between, and regions without text are dropped.
    """
    none = F.array().cast(REGIONS)
    given = images.where("content is not null").select("path", F.col("content").alias("text"), F.lit("synthetic").alias("engine"), F.lit(1.0).alias("confidence"), none.alias("regions"))
    out, left = given, images.where("content is null").select("path")
    for name, engine in engines:
        held = F.filter(F.coalesce(F.col("regions"), none), lambda r: ~blank(r["text"]))
        got = engine(left).select("path", "text", held.alias("regions"))
        text = F.coalesce("text", F.array_join(F.transform("regions", lambda r: r["text"]), " "))
        out = out.unionByName(got.select("path", text.alias("text"), F.lit(name).alias("engine"), mean_confidence(F.col("regions")).alias("confidence"), "regions"))
        left = left.join(got.select("path"), "path", "left_anti")
    return out.unionByName(left.select("path", F.lit(NO_OCR).alias("text"), F.lit("none").alias("engine"), F.lit(0.0).alias("confidence"), none.alias("regions")))


def transcripts(files: DataFrame, model: tuple[str, Plug] | None = None) -> DataFrame:
    """Audio files (path, length or null where there is no file, given content or null) to (path, content, transcription_model, segments).

    Files that are missing or shorter than LEAST_AUDIO bytes, and those that the model has no row for, have their given content. A model gives (path, text, segments: array of struct of start,
    end and text).
    """
    none = F.array().cast("array<struct<start: double, end: double, text: string>>")
    small = F.col("length").isNull() | (F.col("length") < LEAST_AUDIO)
    placed = lambda rows, text: rows.select("path", F.coalesce("content", F.lit(text)).alias("content"), F.lit("fallback").alias("transcription_model"), none.alias("segments"))
    out, large = placed(files.where(small), NO_SPEECH), files.where(~small)
    if model is None:
        return out.unionByName(placed(large, NO_TRANSCRIPT))
    got = model[1](large.select("path")).select("path", F.col("text").alias("content"), F.lit(model[0]).alias("transcription_model"), F.coalesce("segments", none).alias("segments"))
    return out.unionByName(got).unionByName(placed(large.join(got.select("path"), "path", "left_anti"), NO_SPEECH))


def video_info(files: DataFrame, probe: Plug | None = None) -> DataFrame:
    """(path, duration, resolution, frame_rate, frame_count, has_audio, error) of videos (path). A probe gives (path, frame_count, frame_rate, width, height), with null sizes where no frame can
    be read; a video that it has no row for could not be opened. Without a probe all have the same default."""
    if probe is None:
        values = (F.lit(x) for x in UNPROBED)
        return files.select("path", *(v.alias(n) for v, n in zip(values, ("duration", "resolution", "frame_rate", "frame_count"))), F.lit(True).alias("has_audio"), F.lit(None).cast("string").alias("error"))
    got = probe(files.select("path"))
    rate, frames = F.col("frame_rate").cast("double"), F.col("frame_count").cast("int")
    size = F.coalesce(F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")), F.lit("unknown"))
    known = got.select("path", F.when(rate > 0, frames / rate).otherwise(0.0).alias("duration"), size.alias("resolution"), rate.alias("frame_rate"), frames.alias("frame_count"), F.lit(True).alias("has_audio"), F.lit(None).cast("string").alias("error"))
    lost = files.select("path").join(got.select("path"), "path", "left_anti")
    nulls = {n: F.lit(None).cast(t) for n, t in known.dtypes if n not in ("path", "error")}
    return known.unionByName(lost.select("path", *(v.alias(n) for n, v in nulls.items()), F.lit("Could not open video file").alias("error")))


def pdf_folder(spark: SparkSession, base: str) -> str | None:
    """``base``/raw/pdf if it holds a PDF file, else ``base``/pdf if that does."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in (f"{base.rstrip('/')}/raw/pdf", f"{base.rstrip('/')}/pdf"):
        pattern = hadoop.Path(f"{folder}/*.pdf")
        found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        if found is not None and len(found):
            return folder
    return None


def pdf_documents(spark: SparkSession, base: str) -> DataFrame:
    """The PDF files below ``base`` in order: doc_id and title (the file's stem), type, file_path, source, created_at. Their contents are not read."""
    schema = "doc_id string, type string, file_path string, title string, source string, created_at timestamp"
    if (folder := pdf_folder(spark, base)) is None:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path")
    name = stem(F.col("path"))
    return files.select(name.alias("doc_id"), F.lit("pdf_document").alias("type"), F.col("path").alias("file_path"), name.alias("title"), F.lit("existing_dataset").alias("source"), F.current_timestamp().alias("created_at")).orderBy("file_path")
