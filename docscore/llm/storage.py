"""Written intermediate tables in the shared folder of the cluster.

Operators cut lineage by writing Parquet under ``spark.checkpoint.dir`` and
reading it back, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder of this machine, if all of Spark runs on it;
    on a cluster that is an error, as executors would not see each other's files.
    """
    found = spark.conf.get(CHECKPOINT_CONF, None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="docscore-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set(CHECKPOINT_CONF, found)
    return found.rstrip("/")


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it where the table has such a column (in any case)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Workspace:
    """Tables of one operator call. ``drop`` frees what no later step reads;
    the rest goes when the driver's Python ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/docscore/{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: list[str] = []
        atexit.register(self._quiet_clear)

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        """Write ``frame`` and return the table read back from the folder."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        frame.write.parquet(path)
        again = self.spark.read.schema(frame.schema).parquet(path)
        again._docscore_path = path
        self.paths.append(path)
        return again

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self.paths.remove(frame._docscore_path)
            self._delete(frame._docscore_path)

    def mark(self) -> int:
        """A place in the list of written tables, for ``prune``."""
        return len(self.paths)

    def prune(self, mark: int, *keep: DataFrame) -> None:
        """Drop the tables written since ``mark`` but for ``keep``."""
        kept = [frame._docscore_path for frame in keep]
        for path in self.paths[mark:]:
            if path not in kept:
                self._delete(path)
        self.paths[mark:] = [path for path in self.paths[mark:] if path in kept]

    def free(self) -> None:
        """Let go of the shuffle files of finished steps: Spark's cleaner removes those
        whose plans the driver's JVM has collected, which takes it more than one pass."""
        for _ in range(3):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _quiet_clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended already
            pass
