"""Settings of a run: defaults, and what a YAML or JSON file overrides."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    classifier_mode: str = "hybrid"
    chunk_size: int = 500
    top_k: int = 5
    retriever: str = "hybrid"
    min_confidence: float = 0.3


def read(spark: SparkSession, path: str) -> Settings:
    """Settings of a file, read by Spark: names that it lacks keep their defaults, others are ignored. An empty file changes nothing."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    try:
        import yaml
    except ImportError:
        found = json.loads(text or "{}")
    else:
        found = yaml.safe_load(text) or {}
    known = {f.name: f.type for f in fields(Settings)}
    return replace(Settings(), **{k: type(getattr(Settings(), k))(v) for k, v in found.items() if k in known})
