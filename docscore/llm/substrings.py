"""Exact substring dedup by Rabin-Karp hashes of every fixed-length word window.

1. Every window of every document is hashed and Spark counts the hashes (map-side
   combined). Windows that occur once anywhere can't be repeated.
2. Hashes counted more than once set two bits each in a bit filter of fixed size. The
   content of the windows that pass it (strong digest of the words) is grouped, with
   the smallest id that holds it. So contents decide, never the hashes: a collision,
   or a filter that fills up as tables grow, lets more windows through and changes
   nothing else.
3. Each content goes back to that first holder alone. A document removes the windows
   that pass the filter and are not its own firsts; removed windows merge into
   maximal intervals.

A passage that a third of all documents share is combined before each shuffle and
goes back to one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscore.llm.storage import Workspace

BASE = np.uint64(0x9E3779B97F4A7C15)
WINDOW = 13
FILTER_BITS = 28
PART_BYTES = 1 << 20
SLICE_BYTES = 1 << 18
# space, and tab to carriage return
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, b in enumerate((BASE, inverse)):
            _POWERS[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b), dtype=np.uint64)])
    return _POWERS


def _spread(h: np.ndarray) -> np.ndarray:
    """Mix so that every bit of the hash depends on all of it."""
    h ^= h >> np.uint64(32)
    h *= BASE
    h ^= h >> np.uint64(29)
    h *= BASE
    h ^= h >> np.uint64(32)
    return h


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, start, end, text number)`` of the words of all texts together."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    edges = np.diff(np.concatenate([[True], SPACE[data], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
    return data, starts, ends, np.searchsorted(begins, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of the bytes of each word, from running sums over slices of the data."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = int(np.searchsorted(starts, first + SLICE_BYTES))
        part = data[first : ends[j - 1]].astype(np.uint64) + np.uint64(1)
        up, down = _powers(len(part) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)], dtype=np.uint64)])
        a, b = starts[i:j] - first, ends[i:j] - first
        out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return _spread(out)


def window_hashes(words: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(first word, hash)`` of every run of ``window`` words inside one text."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, window):
        out *= BASE
        out += words[k : k + n]
    at = np.flatnonzero(owner[:n] == owner[window - 1 :])
    return at, _spread(out[at])


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``PART_BYTES`` of text, a longer text alone, and their texts in UTF-8."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        k = 0
        while k < batch.num_rows:
            done = ends[k - 1] if k else 0
            j = max(k + 1, int(np.searchsorted(ends, done + PART_BYTES, side="right")))
            yield batch.slice(k, j - k), [t or b"" for t in texts.slice(k, j - k).to_pylist()]
            k = j


class Filter:
    """A fixed number of bits, two of them set for each hash of a table.

    Equal hashes pass or fail alike. The bits are the only thing collected: at most
    ``2 ** bits / 8`` bytes at any size of the table.
    """

    def __init__(self, hashes: DataFrame, bits: int):
        self.bits = bits
        high = F.shiftrightunsigned("hash", 64 - bits)
        low = F.shiftrightunsigned("hash", 64 - 2 * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        slots = hashes.select(F.explode(F.array(high, low)).alias("slot"))
        mask = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
        found = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(mask).alias("mask")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
        self.words = words

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        """The places of the hashes that have both bits."""
        some = np.flatnonzero(self._has(hashes >> np.uint64(64 - self.bits)))
        low = (hashes[some] >> np.uint64(64 - 2 * self.bits)) & np.uint64((1 << self.bits) - 1)
        return some[self._has(low)]

    def _has(self, slots: np.ndarray) -> np.ndarray:
        return (self.words[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) != 0


class Candidates:
    """The windows of some texts that pass the filter, with the digests of their words."""

    def __init__(self, texts: list[bytes], window: int, passing: Filter):
        data, starts, ends, self.owner = split_words(texts)
        at, hashes = window_hashes(word_hashes(data, starts, ends), self.owner, window)
        self.at = at[passing.passes(hashes)]
        # words with one space between them: a window is one run of bytes
        self.said = b" ".join(data.tobytes().split())
        self.begins = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts + 1)])
        view, digest = memoryview(self.said), hashlib.blake2b
        a, b = self.begins[self.at].tolist(), (self.begins[self.at + window] - 1).tolist()
        self.digests = [digest(view[x:y], digest_size=16).digest() for x, y in zip(a, b, strict=True)]


def intervals(removed: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed words, ends exclusive."""
    edges = np.diff(np.concatenate([[False], removed, [False]]).astype(np.int8))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Remove every word covered by a window that also starts in a document with a smaller id.

    One row per input row: ``doc_id, n_words, n_removed, kept_sha256, removed``, where
    ``removed`` has the maximal intervals of removed words (ends exclusive). Windows
    are judged on the input, which is read several times and should be a stored table.
    Ids may be of any ordered type. Null text has no words. A null id is larger than any
    other, so its windows remove nothing elsewhere; rows that share an id (null too)
    remove nothing from each other. Texts shorter than a window stay whole. An empty
    table gives no rows; other columns are never read.

    Windows are equal when their words are (128-bit BLAKE2 digests of the words).
    ``filter_bits`` sets the size of the broadcast filter, 32 MiB for 28 bits; results
    do not depend on it. A worker holds a slice of ``PART_BYTES`` of text, or one
    longer text.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "substrings")
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in parts(batches):
            data, starts, ends, owner = split_words(texts)
            found = window_hashes(word_hashes(data, starts, ends), owner, window)[1]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["hash"])

    counted = picked.select("text").mapInArrow(hashes, "hash long").groupBy("hash").agg(F.count("*").alias("n"))
    repeated = work.write(counted.where("n > 1").select("hash"), "repeated")
    work.free()
    passing = spark.sparkContext.broadcast(Filter(repeated, filter_bits))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches):
            found = Candidates(texts, window, passing.value)
            both = _halves(found.digests)
            holder = pa.array(found.owner[found.at])
            others = [batch.column(k).take(holder) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*others, pa.array(both[:, 0]), pa.array(both[:, 1])], [*batch.schema.names[:-1], "a", "b"])

    held = picked.mapInArrow(contents, f"id {kind}, a long, b long")
    firsts = work.write(held.groupBy("a", "b").agg(F.min("id").alias("low")), "firsts")
    work.drop(repeated)
    work.free()

    def remove(stay: bool):
        """Listed digests are those that stay, or else those that go."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in parts(batches):
                yield _removed(batch, texts, Candidates(texts, window, passing.value), window, stay)

        return run

    result = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    listed = F.collect_list(F.struct("a", "b")).alias("listed")
    shared = work.write(picked.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("low")), "shared")
    if shared.isEmpty():
        return _with(picked, firsts.groupBy(F.col("low").alias("key")).agg(listed), F.col("id")).mapInArrow(remove(True), result)
    # the firsts of an id that many rows share are no bounded list: there each row is told what goes
    same = F.col("id").eqNullSafe(F.col("low"))
    alone = picked.join(shared, same, "left_anti")
    known = firsts.join(shared, "low", "left_anti").groupBy(F.col("low").alias("key")).agg(listed)
    one = _with(alone, known, F.col("id")).mapInArrow(remove(True), result)
    several = picked.join(shared, same, "left_semi").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    mine = several.select("id", "digest", "text").mapInArrow(contents, f"id {kind}, digest string, a long, b long")
    gone = mine.join(firsts, ["a", "b"]).where(F.coalesce(F.col("low") < F.col("id"), F.col("id").isNull() & F.col("low").isNotNull()))
    key = F.struct("id", "digest")
    told = gone.select(key.alias("key"), "a", "b").distinct().groupBy("key").agg(listed)
    return one.unionByName(_with(several, told, key).mapInArrow(remove(False), result))


def _with(texts: DataFrame, lists: DataFrame, key) -> DataFrame:
    """``id, listed, text`` of every text, with the list of its key if there is one."""
    return texts.select("id", "text", key.alias("own")).join(lists, F.col("own").eqNullSafe(F.col("key")), "left").select("id", "listed", "text")


def _removed(batch: pa.RecordBatch, texts: list[bytes], found: Candidates, window: int, stay: bool) -> pa.RecordBatch:
    lists = batch.column("listed")
    flat = lists.flatten()
    raw = np.stack([flat.field("a").to_numpy(zero_copy_only=False), flat.field("b").to_numpy(zero_copy_only=False)], axis=1).astype("<i8").tobytes()
    stops = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)) * 16
    holder = found.owner[found.at]
    cuts = np.searchsorted(holder, np.arange(len(texts) + 1)).tolist()
    goes = np.zeros(len(holder), bool)
    for k in np.unique(holder).tolist():
        known = {raw[x : x + 16] for x in range(int(stops[k - 1]) if k else 0, int(stops[k]), 16)}
        goes[cuts[k] : cuts[k + 1]] = [(x in known) != stay for x in found.digests[cuts[k] : cuts[k + 1]]]
    gone = found.at[goes]
    change = np.zeros(len(found.owner) + 1, np.int32)
    change[:-1] += np.bincount(gone, minlength=len(found.owner)).astype(np.int32)
    change -= np.bincount(gone + window, minlength=len(change)).astype(np.int32)
    removed = np.cumsum(change[:-1]) > 0
    ends = np.searchsorted(found.owner, np.arange(len(texts) + 1)).tolist()
    n_removed, digests, spans = [], [], []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        said = found.said[found.begins[a] : found.begins[b] - 1] if b > a else b""
        mask = removed[a:b]
        runs = intervals(mask) if mask.any() else []
        if runs:
            said = b" ".join(compress(said.split(b" "), (~mask).tolist()))
        n_removed.append(int(mask.sum()))
        digests.append(hashlib.sha256(said).hexdigest())
        spans.append([{"start": x, "end": y} for x, y in runs])
    return pa.RecordBatch.from_arrays(
        [batch.column("id"), pa.array(np.diff(ends), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, INTERVALS)],
        ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"],
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed")


ORACLE = """
WITH texts AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
windows AS (
  SELECT doc_id, place, array_to_string(words[place:place + 12], ' ') AS said
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS place FROM texts)),
firsts AS (SELECT said, min(doc_id) AS low FROM windows GROUP BY said),
gone AS (
  SELECT DISTINCT doc_id, place + step AS place
  FROM windows JOIN firsts USING (said) CROSS JOIN (SELECT unnest(range(0, 13)) AS step) WHERE low < doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts),
kept AS (
  SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p.place) AS said
  FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.place = g.place GROUP BY p.doc_id)
SELECT t.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""
