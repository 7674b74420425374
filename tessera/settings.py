"""Settings of the scoring engine: from the session's configuration (tessera.*), else the environment, else their defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tessera.schema import NPROBE


@dataclass(frozen=True)
class Settings:
    """nprobe: clusters a search probes. accuracy_probe, accuracy_sample: what the accuracy run compares. references: labelled vectors."""

    nprobe: int = NPROBE
    accuracy_probe: int = 15
    accuracy_sample: int = 200
    references: str = "data/references.json.gz"


#: The environment's names.
NAMES = {"nprobe": "NPROBE", "accuracy_probe": "ACCURACY_TEST", "accuracy_sample": "ACCURACY_SAMPLE", "references": "REF_PATH"}


def settings(spark: SparkSession) -> Settings:
    """A number that can't be read is its default."""
    out = {}
    for name, kind in Settings.__annotations__.items():
        text = spark.conf.get(f"tessera.{name}", None) or os.environ.get(NAMES[name])
        if text and kind == "str":
            out[name] = text
        elif text and text.isdigit():
            out[name] = int(text)
    return Settings(**out)


def reference_path(spark: SparkSession) -> str:
    """The references' path; where there is nothing, the same path two folders up."""
    path = settings(spark).references
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return path if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else f"../../{path}"
