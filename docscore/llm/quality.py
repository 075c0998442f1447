"""Quality by importance resampling.

Two generative models of hashed word unigrams and bigrams are counted: one of the
target (labelled good) text and one of all text. A document's importance is the
ratio of its probability under the two: its log weight is the sum of the log ratios
of its features. Adding independent Gumbel noise and taking the largest keys samples
documents without replacement in proportion to their importance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscore.llm.storage import Workspace
from docscore.llm.toxicity import held_out

BUCKET_BITS = 15
SHARE = 0.5
TARGET_ROWS = 20_000
SMOOTH = 0.5
CACHE_WORDS = 400_000
SLICE_WORDS = 500_000
MIX = np.uint64(0x9E3779B97F4A7C15)
BINS = 4096


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_HASHES = WordHashes()


def features(text: str | None, bits: int = BUCKET_BITS) -> np.ndarray:
    """Buckets of the lower-cased unigrams and bigrams of a text."""
    words = (text or "").lower().split()
    each = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    pairs = (each[:-1] * MIX) ^ each[1:]
    return ((np.concatenate([each, pairs]) * MIX) >> np.uint64(64 - bits)).astype(np.int64)


def count_features(texts: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """``bucket, raw, target`` counts of ``(text, target boolean)`` rows, a row per bucket seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(features(text.as_py(), bits), minlength=1 << bits)
                raw += found
                if target:
                    good += found
        _HASHES.clear()  # the worker lives on
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(good[seen])], ["bucket", "raw", "target"])

    each = texts.select("text", "target").mapInArrow(run, "bucket long, raw long, target long")
    return each.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(docs: DataFrame, labels: DataFrame, bits: int = BUCKET_BITS, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """Log ratio of target to raw probability for every bucket; as large as the table of buckets.

    All documents make the raw model. The target model is made of at most
    ``target_rows`` documents labelled good outside the held-out fold, those with the
    smallest hash of their id; their ids are broadcast. Rows with a null id or label
    are not target; a document labelled twice is if all its labels say so. Null and
    empty texts count nothing, repeated rows count again; from empty tables all ratios
    are zero. Other columns are never read.
    """
    good = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    good = good.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ids = [(r["doc_id"],) for r in good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).collect()]
    kind = good.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(ids, f"doc_id {kind}").select("doc_id", F.lit(True).alias("target"))
    texts = texts.join(F.broadcast(chosen), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    for r in count_features(texts, bits).collect():  # bounded by the number of buckets
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    size = 1 << bits
    return np.log((target + SMOOTH) / (target.sum() + SMOOTH * size)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * size))


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the key and seed only."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def nth(values: DataFrame, column: str, n: int) -> tuple:
    """``(value, before)``: the n-th smallest value of a column without nulls, and how many rows have a smaller one.

    Rows are counted in bins between the smallest and largest value, then in bins of
    the bin that has the n-th, and so on: no rows are sorted or gathered.
    """
    low, high = values.agg(F.min(column), F.max(column)).first()
    before = 0
    while low < high:
        inside = values.where(F.col(column).between(F.lit(low), F.lit(high)))
        share = (F.col(column).cast("double") - float(low)) / (float(high) - float(low) or 1.0)
        # the ends are always told apart, however near they are
        bin_of = F.when(F.col(column) == F.lit(low), -1).when(F.col(column) == F.lit(high), BINS).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        counts = inside.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in counts.orderBy("bin").collect():  # BINS + 2 rows at most
            if before + r["n"] >= n:
                low, high = r["low"], r["high"]
                break
            before += r["n"]
    return low, before


def largest(keys: DataFrame, k: int) -> Column:
    """Is the row among the ``k`` largest by ``key``, then the smaller ``row``?"""
    cut, above = nth(keys.select((-F.col("key")).alias("back")), "back", k)
    ties = keys.where(F.col("key") == F.lit(-cut))
    last, _ = nth(ties.select("row"), "row", k - above)
    return (F.col("key") > F.lit(-cut)) | ((F.col("key") == F.lit(-cut)) & (F.col("row") <= F.lit(last)))


def resample(docs: DataFrame, ratios: np.ndarray, share: float = SHARE, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, log_weight, mean_log_weight, gumbel_key, selected`` for each input row.

    ``log_weight`` is the log ratio of the whole text, and the key is that plus noise;
    ``mean_log_weight`` is per feature, for comparing texts of different lengths.
    ``share`` of all rows (rounded down, of a table that is not empty at least one) is
    selected, ties broken by input row. Null and empty texts have no features and
    log weight zero. Ids may be of any type. Repeated rows have separate noise only if
    their ids differ, and are separate candidates. An empty table gives no rows.
    """
    bits = int(len(ratios)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            found = [table[features(t.as_py(), bits)] for t in batch.column(2)]
            sums = [float(x.sum()) for x in found]
            means = [s / len(x) if len(x) else 0.0 for s, x in zip(sums, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sums, pa.float64()), pa.array(means, pa.float64())], ["row", "doc_id", "log_weight", "mean_log_weight"]
            )
        _HASHES.clear()

    work = Workspace(docs.sparkSession, "quality")
    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    keys = picked.mapInArrow(run, f"row long, doc_id {kind}, log_weight double, mean_log_weight double").withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
    keys = work.write(keys, "keys")
    total = keys.count()
    chosen = largest(keys, max(1, int(total * share))) if total else F.lit(False)
    return keys.select("row", "doc_id", "log_weight", "mean_log_weight", F.col("key").alias("gumbel_key"), chosen.alias("selected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return resample(docs, log_ratios(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("row")
