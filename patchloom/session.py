"""What a Spark session needs before Python functions of this package run on its executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each Spark context, as `--py-files` would."""
    context = spark.sparkContext
    if not getattr(context, "_patchloom_shipped", False):
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="package-")) / "patchloom.zip"
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(top.rglob("*.py")):
                out.write(file, file.relative_to(top.parent))
        context.addPyFile(str(target))
        context._patchloom_shipped = True
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the one that all executors share (spark.checkpoint.dir), or a temporary one on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
