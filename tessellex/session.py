"""Session construction used by tests, the benchmark and the command line."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .functions.staging import shared_dir


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution; an existing session is returned unchanged."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessellex")
        .config("spark.driver.memory", os.environ.get("TESSELLEX_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Bytes that one Arrow batch to a Python worker holds at most; the session's limit of rows holds too.
ARROW_BATCH = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run, and bound what a batch to them holds.

    The package goes as a zip into the shared folder, from where Spark hands it to every executor, once
    for each Spark context. Rows of long texts would fill a worker's memory at the default of 10,000
    rows a batch, so a session with a larger limit of bytes gets this one.
    """
    context = spark.sparkContext
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(limit).rstrip("bB")) > ARROW_BATCH:
        spark.conf.set(limit, str(ARROW_BATCH))
    if getattr(context, "_tessellex_shipped", False):
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = f"{shared_dir(spark)}/package-{uuid.uuid4().hex}/{root.name}.zip"
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(held.getvalue()))
    out.close()
    context.addPyFile(path)
    context._tessellex_shipped = True
