"""The index of chunks with their vectors: only documents that are new or changed are chunked and embedded again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk
from .store import ATTEMPTS
from .versions import Conflict, VersionedTable

#: Takes (chunk_id, text), returns (chunk_id, embedding).
Embed = Callable[[DataFrame], DataFrame]


class ChunkIndex:
    """Rows of chunks by document, in ``buckets`` parts by a hash of the document's id. A document without chunks has one row without a chunk, so that it is known.

    A refresh compares the texts' hashes with those of the index, and writes the buckets anew that changed documents lie in; chunks of others are carried over with their vectors.
    Ids of documents are distinct; of equal ones one is taken.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.table = VersionedTable(spark, path, "doc_id string, digest string, chunk_id string, text string, source_type string, chunk_index int, total_chunks int, embedding array<float>, bucket int", ("bucket",))

    def _bucket(self):
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def chunks(self, version: int | None = None) -> DataFrame:
        return self.table.read(version).where("chunk_id is not null").drop("bucket", "digest")

    def stats(self) -> DataFrame:
        """(doc_id, chunk_count) of all documents, also of those without a chunk."""
        return self.table.read().groupBy("doc_id").agg(F.count("chunk_id").alias("chunk_count"))

    def _made(self, docs: DataFrame, embed: Embed) -> DataFrame:
        """Rows of documents (doc_id, text, source_type, digest, bucket)."""
        c = chunk.chunks(docs, source_col="source_type").select("chunk_id", F.col("doc_id").alias("__d"), F.col("text").alias("chunk"), F.col("metadata.chunk_index").alias("chunk_index"), F.col("metadata.total_chunks").alias("total_chunks"))
        vectors = embed(c.select("chunk_id", F.col("chunk").alias("text"))).select(F.col("chunk_id").alias("__c"), F.col("embedding").cast("array<float>").alias("embedding"))
        held = c.join(vectors, F.col("chunk_id") == F.col("__c"), "left")
        rows = docs.join(held, F.col("doc_id") == F.col("__d"), "left")
        return rows.select("doc_id", "digest", "chunk_id", F.col("chunk").alias("text"), "source_type", "chunk_index", "total_chunks", "embedding", "bucket")

    def refresh(self, docs: DataFrame, embed: Embed, whole: bool = True, rebuild: bool = False, token: str | None = None) -> dict[str, int]:
        """Brings the index up to ``docs`` (doc_id, text and perhaps source_type). With ``whole`` they are all documents, and others leave the index; else they are added or take the place of
        those with the same id. ``rebuild`` makes everything anew. The numbers of documents that were changed, and that were removed."""
        source = F.col("source_type").cast("string") if "source_type" in docs.columns else F.lit(None).cast("string")
        text = F.coalesce(F.col("text"), F.lit(""))
        given = docs.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"), source.alias("source_type"))
        given = given.dropDuplicates(["doc_id"]).withColumn("digest", F.sha2(F.concat_ws("\x00", "text", F.coalesce("source_type", F.lit(""))), 256)).withColumn("bucket", self._bucket())
        for _ in range(ATTEMPTS):
            if self.table.has_token(token):
                return {"changed": 0, "removed": 0}
            base = self.table.version()
            now = self.table.read(base)
            known = now.select(F.col("doc_id").alias("__k"), F.col("digest").alias("__g")).distinct()
            same = (F.col("doc_id") == F.col("__k")) & (F.col("digest") == F.col("__g"))
            changed = given if rebuild else given.join(known, same, "left_anti")
            gone = known.select(F.col("__k").alias("doc_id")).join(given.select("doc_id"), "doc_id", "left_anti").withColumn("bucket", self._bucket())
            touched = changed.select("doc_id", "bucket")
            counts = {"changed": changed.count(), "removed": gone.count() if whole else 0}
            if not any(counts.values()):
                return counts
            if whole:
                touched = touched.unionByName(gone)
            # At most as many buckets as there are.
            cells = [[r["bucket"]] for r in touched.select("bucket").distinct().collect()]
            carried = now.where(F.col("bucket").isin([c[0] for c in cells])).join(touched.select("doc_id"), "doc_id", "left_anti")
            part = self.table.write(carried.select(*self.table.schema.names).unionByName(self._made(changed, embed)))
            try:
                self.table.commit(base, part, cells, token)
                return counts
            except Conflict:
                self.table.discard(part)
        raise Conflict(f"gave up after {ATTEMPTS} attempts")

    def follow(self, docs: DataFrame, embed: Embed, checkpoint: str):
        """Takes up a stream of documents (doc_id, text), batch by batch; a repeated batch does nothing."""

        def batch(rows: DataFrame, number: int) -> None:
            self.refresh(rows, embed, whole=False, token=f"{checkpoint}#{number}")

        return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
