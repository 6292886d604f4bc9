"""A store of triples in a folder: load into named graphs, insert and delete data, read, ask; and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kg_views import StoredGraph
from .files import parse_typed
from .versions import Conflict, VersionedTable

COLUMNS = ("s", "p", "o", "o_kind", "o_dtype")
#: Times that a writer begins anew when another one was faster.
ATTEMPTS = 10


class TripleStore:
    """Triples with their datatypes as a versioned table, partitioned by graph and predicate. A graph is a set. A load adds a part with what is new; a deletion
    writes the predicates that it touches anew. Neither is seen before it is whole, and of two writers at a time one begins anew on what the other has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.table = VersionedTable(spark, path, "s string, o string, o_kind string, o_dtype string, graph string, p string", ("graph", "p"))

    def exists(self) -> bool:
        """Whether anything was loaded: the health check."""
        return self.table.version() > 0

    def triples(self, graph: str | None = None, version: int | None = None) -> DataFrame:
        df = self.table.read(version)
        return df if graph is None else df.where(F.col("graph") == graph)

    def _rows(self, triples: DataFrame, graph: str) -> DataFrame:
        given = triples if "o_dtype" in triples.columns else triples.withColumn("o_dtype", F.lit(None).cast("string"))
        return given.select(*COLUMNS, F.lit(graph).alias("graph"))

    def _without(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        """Rows that the others have not; nulls are equal to nulls."""
        a, b = rows.alias("a"), others.alias("b")
        same = F.lit(True)
        for c in (*COLUMNS, "graph"):
            same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        return a.join(b, same, "left_anti")

    def load(self, triples: DataFrame | str, graph: str = "default", token: str | None = None) -> bool:
        """Adds triples (a table or Turtle text) to a named graph, as a set; whether that was a new version. A load with a token that was loaded already does nothing."""
        if isinstance(triples, str):
            triples = self.spark.createDataFrame(parse_typed(triples), "s string, p string, o string, o_kind string, o_dtype string")
        new = self._rows(triples, graph).dropDuplicates()
        for _ in range(ATTEMPTS):
            if self.table.has_token(token):
                return False
            base = self.table.version()
            old = self.triples(graph, base).select(*COLUMNS, "graph")
            part = self.table.write(self._without(new, old))
            if part is None and token is None and base:
                return False
            try:
                self.table.commit(base, part, token=token)
                return True
            except Conflict:
                self.table.discard(part)
        raise Conflict(f"gave up after {ATTEMPTS} attempts")

    def delete(self, triples: DataFrame, graph: str = "default") -> bool:
        """Deletes triples of a named graph; whether there were any. Without o_dtype those of any datatype go."""
        keys = [c for c in COLUMNS if c in triples.columns]
        gone = triples.select(*keys).distinct()
        for _ in range(ATTEMPTS):
            base = self.table.version()
            a, b = self.triples(graph, base).alias("a"), gone.alias("b")
            same = F.lit(True)
            for c in keys:
                same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
            # Predicates are few: they are columns of a schema.
            cells = [[graph, r["p"]] for r in a.join(b, same, "left_semi").select("p").distinct().collect()]
            if not cells:
                return False
            kept = a.where(F.col("p").isin([c[1] for c in cells])).join(b, same, "left_anti")
            part = self.table.write(kept)
            try:
                self.table.commit(base, part, cells)
                return True
            except Conflict:
                self.table.discard(part)
        raise Conflict(f"gave up after {ATTEMPTS} attempts")

    def graph(self, name: str | None = None) -> StoredGraph:
        return StoredGraph(self.triples(name))


def report(triples: DataFrame, **counts: int) -> DataFrame:
    """One row: the graph's statistics and further counts of a run."""
    from ..operators.triples import stats

    return stats(triples).select("*", *(F.lit(n).cast("long").alias(k) for k, n in counts.items()), F.current_timestamp().alias("created_at"))
