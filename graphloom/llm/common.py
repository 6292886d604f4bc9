"""What the operators share: words, single evaluation inside expressions, tables written once, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"
NONSPACE = r"[^\x20\x09-\x0D]"


#: Applications whose scratch folder is deleted at the end.
_cleared: set[str] = set()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints. Where none is set, one of our own on a single machine; on a cluster that is an error, as executors would not see one
    another's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's folder below the shared one."""
    return f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables that this application wrote with ``written``; to be called when no result is read any more."""
    delete(spark, scratch(spark))


def _clear_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped
        clear_scratch(spark)


#: Rows of a written file, at least, where their number is known.
FILE_ROWS = 40_000


def few(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` in four parts for each core, or more in proportion to its rows (about how many there are at most), if known, and never more parts than it had: small tables of a plan
    with many shuffle partitions are made by few tasks."""
    return df if rows is None else df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts the lineage and outlives lost executors.

    ``rows``: see ``few``.
    The table stays, as later reads need it, until ``clear_scratch`` or the end of the driver's program.
    """
    spark = df.sparkSession
    if (app := spark.sparkContext.applicationId) not in _cleared:
        _cleared.add(app)
        atexit.register(_clear_at_exit, spark)
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    few(df, rows).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def arrow_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds the Arrow batches sent to Python, in rows and bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
