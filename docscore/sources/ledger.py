"""Manifests that grow by batches, where a batch that runs again adds nothing.

Every batch is a folder ``batch=<number>`` of JSON lines and is written whole: a run
that is repeated writes its own folder anew. Spark's mark of success makes a batch
count; what a run that was cut off left behind is not read, and the next run of the
batch replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscore.operators import seeding


def complete_batches(spark: SparkSession, path: str) -> list[str]:
    """The folders of the batches that count, one name per batch."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        return []
    names = [s.getPath().getName() for s in files.listStatus(top) if s.isDirectory()]
    done = lambda name: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS"))
    return sorted(name for name in names if name.startswith("batch=") and done(name))


def read_batches(spark: SparkSession, path: str, schema: str, without: int | None = None) -> DataFrame:
    """The entries of all batches that count, with their ``batch``; ``without`` leaves one out."""
    names = [n for n in complete_batches(spark, path) if n != f"batch={without}"]
    if not names:
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").option("basePath", path).json([f"{path}/{n}" for n in names])


def append_batch(entries: DataFrame, path: str, batch: int) -> None:
    entries.write.mode("overwrite").json(f"{path}/batch={batch}")


def append_new(found: DataFrame, path: str, batch: int, key: str = "document_id") -> None:
    """Append as a batch those documents that no other batch has; of several with one id all, as they are one batch's.

    What the batch itself wrote before is not looked at, so running it again gives the
    same rows. Documents with a null id are new.
    """
    kind = found.schema[key].dataType.simpleString()
    known = read_batches(found.sparkSession, path, f"{key} {kind}", without=batch).select(key).distinct()
    append_batch(seeding.new_documents(found, known, key=key), path, batch)


def append_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "document_id"):
    """A started query that appends arriving documents by micro-batch; a batch that Spark delivers again after a failure adds nothing."""
    deliver = lambda rows, number: append_new(rows.persist(), path, number, key)
    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
