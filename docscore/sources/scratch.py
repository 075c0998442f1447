"""Folders for what a query writes in order to read it back."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names, removed when the driver's Python ends.

    Where that is unset, a temporary folder of this machine, if all of Spark runs on it;
    on a cluster an error, as executors would not see each other's files.
    """
    top = spark.conf.get(CHECKPOINT_CONF, None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="docscore-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        return f"file://{own}/{label}"
    path = f"{top.rstrip('/')}/docscore/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already
        pass


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file by Spark's own file systems, so that any path Spark reads can be written."""
    write_parts(spark, path, [data])


def write_parts(spark: SparkSession, path: str, parts: Iterable[bytes], chunk: int = 1 << 20) -> None:
    """One file of parts that come one after the other; about ``chunk`` bytes are held at a time."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    held = bytearray()
    try:
        for part in parts:
            held += part
            if len(held) >= chunk:
                out.write(held)
                held = bytearray()
        out.write(held)
    finally:
        out.close()
