"""Session defaults shared by the command line, the tests and the benchmark."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow. ``master`` None leaves the choice to spark-submit.

    ``partitions`` sets spark.sql.shuffle.partitions; on a cluster leave it None and let AQE coalesce
    from the cluster's own (large) setting.
    """
    # Python workers of a local session find the package wherever the program was started; on a cluster it is installed or sent along (--py-files).
    home, paths = str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
    b = (
        SparkSession.builder.appName("graphloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
