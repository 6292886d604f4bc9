"""Rules for PDF, image, audio and video files, with decoders of small made files."""

from pyspark.sql import functions as F

from graphloom.sources import media


def test_pdf_chain_on_files(spark, tmp_path):
    """A decoder that fails on a file, one that gives blanks, pages with a backup, and a folder that stands in for another one."""
    assert media.pdf_folder(spark, str(tmp_path)) is None and media.pdf_documents(spark, str(tmp_path)).count() == 0
    (tmp_path / "pdf").mkdir()
    for name, text in (("b", "one\ftwo\f \ffour"), ("a", "bad"), ("c", " ")):
        (tmp_path / "pdf" / f"{name}.pdf").write_text(text)
    (tmp_path / "pdf" / "x.txt").write_text("no")
    docs = media.pdf_documents(spark, str(tmp_path))
    assert [(r.doc_id, r.title, r.type, r.source) for r in docs.collect()] == [(n, n, "pdf_document", "existing_dataset") for n in "abc"]
    files = spark.read.format("binaryFile").load(str(tmp_path / "pdf" / "*.pdf")).select("path", "content")
    text = files.select("path", F.split(F.decode("content", "UTF-8"), "\f").alias("pages_"))
    read = lambda rows: rows.join(text, "path").select("path", F.explode(F.sequence("first", "last")).alias("page"), "pages_").select("path", "page", F.get("pages_", F.col("page")).alias("text"), F.lit("blocks").alias("backup"))
    paged = media.Pages(lambda rows: rows.join(text, "path").select("path", F.size("pages_").alias("pages")).where("path not like '%/c.pdf'"), read)

    def whole(path, content):
        if b"bad" in content:
            raise ValueError(path)
        return content.decode()

    got = lambda *a, **k: {r.path[-5]: (r.text, r.extractor) for r in media.pdf_texts(files, *a, **k).collect()}
    assert got([media.each_file(whole)]) == {"a": ("", None), "b": ("one\ftwo\f \ffour", "0"), "c": ("", None)}
    assert got([media.each_file(whole), paged], max_pages=3)["a"] == ("bad", "1")
    assert got([paged], max_pages=3)["b"] == ("one\n\ntwo\n\nblocks", "0") and got([paged], max_pages=0)["b"][0].endswith("\n\nfour")
    assert got([], ocr=paged)["b"][1] == "ocr" and got([]) == {n: ("", None) for n in "abc"}
    (tmp_path / "raw" / "pdf").mkdir(parents=True)
    assert media.pdf_folder(spark, str(tmp_path)).endswith("/pdf") and "raw" not in media.pdf_folder(spark, str(tmp_path))
    (tmp_path / "raw" / "pdf" / "z.pdf").write_text("z")
    assert [r.doc_id for r in media.pdf_documents(spark, str(tmp_path)).collect()] == ["z"]


def test_engines_and_models(spark):
    images = spark.createDataFrame([("i1", "given"), ("i2", None), ("i3", None), ("i4", None)], "path string, content string")
    regions = F.from_json(F.lit('[{"text": "a", "confidence": 0.5}, {"text": " ", "confidence": 0.1}, {"text": "b", "confidence": 1.0}]'), media.REGIONS)
    one = lambda rows: rows.where("path in ('i2', 'i3')").select("path", F.lit(None).cast("string").alias("text"), F.when(F.col("path") == "i2", regions).alias("regions"))
    got = {r.path: (r.text, r.engine, r.confidence, len(r.regions)) for r in media.image_texts(images, [("one", one)]).collect()}
    assert got == {"i1": ("given", "synthetic", 1.0, 0), "i2": ("a b", "one", 0.75, 2), "i3": ("", "one", 0.0, 0), "i4": (media.NO_OCR, "none", 0.0, 0)}
    audio = spark.createDataFrame([("a1", 99, "g"), ("a2", 100, None), ("a3", None, None), ("a4", 500, "h")], "path string, length long, content string")
    model = lambda rows: rows.where("path = 'a2'").select("path", F.lit("said").alias("text"), F.lit(None).cast("array<struct<start: double, end: double, text: string>>").alias("segments"))
    heard = lambda m: {r.path: (r.content, r.transcription_model) for r in media.transcripts(audio, m).collect()}
    assert heard(("m", model)) == {"a1": ("g", "fallback"), "a2": ("said", "m"), "a3": (media.NO_SPEECH, "fallback"), "a4": ("h", "fallback")}
    assert heard(None)["a2"] == (media.NO_TRANSCRIPT, "fallback")
    video = spark.createDataFrame([("v1",)], "path string")
    assert media.video_info(video).first()[1:5] == media.UNPROBED
