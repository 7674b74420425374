"""What a session gives all operators: the folder that driver and executors share, and the package on the executors."""

from __future__ import annotations

import hashlib
import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir or setCheckpointDir() names. Only a session on one machine gets a folder of its own where neither does."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder of this name below the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    path = shared_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Gives executors the package, once a session, so that they needn't have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    from pyarrow import fs

    package, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{package.name}/{f.relative_to(package)}"), f.read_bytes())
    folder = f"{shared_root(spark)}/tessera/package-{hashlib.sha256(data.getvalue()).hexdigest()[:16]}"
    system, path = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/tessera.zip", compression=None) as out:
        out.write(data.getvalue())
    sc.addPyFile(f"{folder}/tessera.zip")
    sc._tessera_shipped = True
