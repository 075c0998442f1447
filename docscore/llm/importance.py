"""Target-distribution importance resampling over an integer word dictionary.

Texts are read once, in packs of a bounded number of words. A pack has its own word
list, its distinct runs of words as tuples of places in that list, and for each piece
of a document which of those runs it has, and how often. Everything after that is
joins: word lists are joined with one dictionary of distinct words and ids, runs become
tuples of ids (a word is the tuple of its own), each distinct tuple is spelled out and
hashed once, the counts of both corpora are summed by bucket, and the gain of a tuple's
bucket is joined back to the packs that hold it. Strings travel once per pack, not once per occurrence, and no table
but the gains, one number per bucket, leaves the executors.

The score is the floored mean gain of a document's features plus Gumbel noise from its
id; the highest scores are drawn, which samples in proportion to importance.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscore.llm.storage import Workspace

ORDER = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
PACK_WORDS = 2_500_000
SPAN = 1 << 20  # more than twice the size of any gain
SLICE_BYTES = 1_000_000
BATCH_ROWS = 1000
WORD_BYTES = [b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80]
SPACED = bytes(b if b in WORD_BYTES else 0x20 for b in range(256))


def words_of(text: str | None, least: int = 1) -> Iterator[list[bytes]]:
    """Words of a text whose A-Z are lower-cased, in lists: runs of digits, a-z and all beyond ASCII, in UTF-8.
    A list comes from about ``SLICE_BYTES`` of the text and has at least ``least`` words, but for the last."""
    spaced = (text or "").encode("utf-8", "replace").lower().translate(SPACED)
    held: list[bytes] = []
    start = 0
    while start < len(spaced):
        end = spaced.find(b" ", start + SLICE_BYTES)
        end = len(spaced) if end < 0 else end
        held += spaced[start:end].split()
        start = end
        if len(held) >= least and start < len(spaced):
            yield held
            held = []
    yield held


class Pack:
    """Documents, or pieces of long ones, read together."""

    def __init__(self, number: int, order: int):
        self.number, self.order = number, order
        self.places: defaultdict[bytes, int] = defaultdict()
        self.places.default_factory = self.places.__len__
        self.sequences: list[np.ndarray] = []
        self.owners: list[tuple] = []
        self.starts: list[int] = []
        self.words = 0

    def add(self, owner: tuple, words: list[bytes], fresh: int) -> None:
        """``words`` of a document; runs begin only at the first ``fresh`` of them."""
        self.sequences.append(np.fromiter(map(self.places.__getitem__, words), np.int32, len(words)))
        self.owners.append(owner)
        self.starts.append(fresh)
        self.words += len(words)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """``(piece, places)`` of every run of 2 to ``order`` words; places after a run's end are -1."""
        pieces, runs = [np.empty(0, np.int64)], [np.empty((0, self.order), np.int32)]
        for piece, (sequence, fresh) in enumerate(zip(self.sequences, self.starts, strict=True)):
            for size in range(2, self.order + 1):
                count = min(fresh, len(sequence) - size + 1)
                if count > 0:
                    found = np.full((count, self.order), -1, np.int32)
                    for k in range(size):
                        found[:, k] = sequence[k : k + count]
                    pieces.append(np.full(count, piece))
                    runs.append(found)
        return np.concatenate(pieces), np.concatenate(runs)

    def rows(self, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The pack's features (``place, times`` with a ``word``, or with a ``run`` of places of words) and its
        pieces (``row, key, words, n, uses, counts``: places of features and how often). A word is a run of one."""
        owner = np.repeat(np.arange(len(self.owners)), self.starts)
        which = np.concatenate([np.empty(0, np.int64), *(s[:fresh] for s, fresh in zip(self.sequences, self.starts, strict=True))])
        every = np.empty((0, self.order), np.int32)
        if self.order > 1:
            pieces, runs = self.runs()
            every, longer = np.unique(runs, axis=0, return_inverse=True)
            owner, which = np.concatenate([owner, pieces]), np.concatenate([which, len(self.places) + longer.ravel()])
        size = max(1, len(self.places) + len(every))
        totals = np.bincount(which, minlength=size)
        pairs, times = np.unique(owner * size + which, return_counts=True)
        owner, uses = np.divmod(pairs, size)
        cuts = np.searchsorted(owner, np.arange(len(self.owners) + 1))
        sums = np.diff(np.r_[0, np.cumsum(times)][cuts])
        kinds = {"pack": pa.int64(), "place": pa.int32(), "word": pa.binary(), "run": pa.list_(pa.int32()), "times": pa.int64(), "row": pa.int64(), "key": key_type}
        kinds |= {"words": pa.int64(), "n": pa.int64(), "uses": pa.list_(pa.int32()), "counts": pa.list_(pa.int32())}

        def batch(rows: int, **columns) -> pa.RecordBatch:
            columns["pack"] = pa.array(np.full(rows, self.number), pa.int64())
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(rows, kind)) for c, kind in kinds.items()], list(kinds))

        def lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(values, pa.int32()))

        words = list(self.places)
        for a in range(0, len(words), BATCH_ROWS):
            b = min(a + BATCH_ROWS, len(words))
            yield batch(b - a, place=pa.array(range(a, b), pa.int32()), times=pa.array(totals[a:b], pa.int64()), word=pa.array(words[a:b], pa.binary()))
        for a in range(0, len(every), BATCH_ROWS):
            part, base = every[a : a + BATCH_ROWS], len(words) + a
            run = lists(np.cumsum(np.r_[0, (part >= 0).sum(axis=1)]), part[part >= 0])
            yield batch(len(part), place=pa.array(range(base, base + len(part)), pa.int32()), times=pa.array(totals[base : base + len(part)], pa.int64()), run=run)
        for a in range(0, len(self.owners), BATCH_ROWS):
            b = min(a + BATCH_ROWS, len(self.owners))
            row, key = zip(*self.owners[a:b], strict=True)
            own = slice(cuts[a], cuts[b])
            yield batch(
                b - a, row=pa.array(row, pa.int64()), key=pa.array(key, key_type), words=pa.array(self.starts[a:b], pa.int64()), n=pa.array(sums[a:b], pa.int64()),
                uses=lists(cuts[a : b + 1], uses[own]), counts=lists(cuts[a : b + 1], times[own]),
            )


def packs(texts: DataFrame, order: int, pack_words: int) -> DataFrame:
    """Rows of ``Pack.rows`` for ``(row, key, text)``. Long texts are cut into pieces, each
    with the words after it that runs beginning in it reach into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kind = TaskContext.get().partitionId() << 33, None
        pack = Pack(number, order)
        for batch in batches:
            kind = batch.schema.field(1).type
            for row, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                lists = words_of(text.as_py(), order)
                part = next(lists)
                while part is not None:
                    following = next(lists, None)
                    pack.add((row, key), part + (following or [])[: order - 1], len(part))
                    part = following
                    if pack.words >= pack_words:
                        yield from pack.rows(kind)
                        number += 1
                        pack = Pack(number, order)
        if pack.owners:
            yield from pack.rows(kind)

    key = texts.schema["key"].dataType.simpleString()
    schema = f"pack long, place int, word binary, run array<int>, times long, row long, key {key}, words long, n long, uses array<int>, counts array<int>"
    return texts.select("row", "key", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def gains_of(own: np.ndarray, target: np.ndarray) -> list[int]:
    """A whole number of thousandths for every bucket: the log ratio of its smoothed shares."""
    size, s, t = len(own), int(own.sum()), int(target.sum())
    return [math.floor(1000 * math.log((int(b) + 1) * (s + size) / ((int(a) + 1) * (t + size)))) for a, b in zip(own, target, strict=True)]


def named_runs(features: DataFrame, dictionary: DataFrame, work: Workspace) -> DataFrame:
    """``side, pack, place, run, times``: runs of two or more words as tuples of dictionary ids, written."""
    ids = features.where("word IS NOT NULL").join(dictionary.hint("merge"), "word").select("side", "pack", F.col("place").alias("at"), "id")
    ids = work.write(ids, "ids")
    each = features.where("run IS NOT NULL").select("side", "pack", "place", "times", F.posexplode("run").alias("k", "at"))
    joined = each.join(ids.hint("merge"), ["side", "pack", "at"]).groupBy("side", "pack", "place", "times")
    return work.write(joined.agg(_in_order("k", "id").alias("run")), "runs")


def _in_order(place: str, column: str) -> Column:
    """The values of a short group in the order of their places."""
    return F.transform(F.array_sort(F.collect_list(F.struct(place, column))), lambda x: x[column])


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    side = lambda k: F.sum(F.when(F.col("side") == k, F.col("times")).otherwise(0))
    return rows.groupBy(*keys).agg(side(0).alias("own"), side(1).alias("target"))


def feature_gains(own: DataFrame, target: DataFrame, order: int, buckets: int, work: Workspace) -> DataFrame:
    """``pack, cell``: the gain of each feature of each pack of ``own``; place and gain share a number, as rows are many and small.

    ``own`` and ``target`` are written tables of packs. All that is collected is the
    counts of the buckets.
    """
    kept = ["pack", "place", "times", "word", "run"]
    features = own.where("place IS NOT NULL").select(F.lit(0).alias("side"), *kept).unionByName(target.where("place IS NOT NULL").select(F.lit(1).alias("side"), *kept))
    bucket = lambda spelled: F.pmod(F.crc32(spelled), F.lit(buckets)).alias("bucket")
    dictionary = _summed(features.where("word IS NOT NULL"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "own", "target", bucket(F.col("word")))
    dictionary = work.write(dictionary, "dictionary")
    counted = dictionary.select("own", "target", "bucket")
    if order > 1:
        runs = named_runs(features, dictionary.select("word", "id"), work)
        distinct = work.write(_summed(runs, "run").withColumn("feature", F.monotonically_increasing_id()), "distinct")
        spelled = distinct.select("feature", F.posexplode("run").alias("k", "id")).join(dictionary.select("id", "word").hint("merge"), "id").groupBy("feature").agg(_in_order("k", "word").alias("words"))
        bytes_of = F.expr("aggregate(slice(words, 2, size(words)), words[0], (a, w) -> a || X'20' || w)")
        tuples = distinct.join(spelled.select("feature", bucket(bytes_of)).hint("merge"), "feature")
        tuples = work.write(tuples.select("run", "own", "target", "bucket"), "tuples")
        counted = counted.unionByName(tuples.select("own", "target", "bucket"))
    own_counts, target_counts = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("own").alias("own"), F.sum("target").alias("target")).collect():  # a row per bucket at most
        own_counts[r["bucket"]], target_counts[r["bucket"]] = r["own"], r["target"]
    table = list(enumerate(gains_of(own_counts, target_counts)))
    gains = F.broadcast(own.sparkSession.createDataFrame(table, "bucket long, gain long"))  # a row per bucket
    # one row per word or tuple on the written side, so Spark splits the rows of a frequent one
    gained = work.write(dictionary.join(gains, "bucket").select("word", "gain"), "gained-words")
    cell = ["pack", (F.col("place").cast("long") * SPAN + F.col("gain") + SPAN // 2).alias("cell")]
    back = features.where("side = 0 AND word IS NOT NULL").join(gained.hint("merge"), "word").select(*cell)
    if order > 1:
        gained = work.write(tuples.join(gains, "bucket").select("run", "gain"), "gained-runs")
        back = back.unionByName(runs.where("side = 0").join(gained.hint("merge"), "run").select(*cell))
    return back


def weigh(pieces: DataFrame, gains: DataFrame) -> DataFrame:
    """``row, doc_id, n, words, total``: the summed gains of every piece; a task holds one pack at a time."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place, gain = np.divmod(right.column("cell").to_numpy(), SPAN)
        table = np.zeros(int(place.max(initial=-1)) + 1, np.int64)
        table[place] = gain - SPAN // 2
        left = left.combine_chunks()
        uses, counts = (left.column(c).combine_chunks() for c in ("uses", "counts"))
        sums = np.r_[0, np.cumsum(table[uses.flatten().to_numpy()] * counts.flatten().to_numpy())]
        ends = np.cumsum(np.r_[0, uses.value_lengths().to_numpy()])
        return left.select(["row", "doc_id", "n", "words"]).append_column("total", pa.array(np.diff(sums[ends]), pa.int64()))

    kind = pieces.schema["doc_id"].dataType.simpleString()
    home = gains.select(F.col("pack").alias("home"), "cell")
    return pieces.groupBy("pack").cogroup(home.groupBy("home")).applyInArrow(run, f"row long, doc_id {kind}, n long, words long, total long")


def noise(key: Column, seed: int) -> Column:
    """Thousandths of standard Gumbel noise, a function of the key alone."""
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, pack_words: int = PACK_WORDS, work: Workspace | None = None,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank``, a row for each input row.

    Features are runs of 1 to ``order`` words with repeats. ``percent`` of the rows with
    at least ``least_words`` words (rounded down) are drawn and ranked from 1 by falling
    score, ties by the smaller id, then by input row; the rank of others is null. Null
    and empty texts have no features and weight zero. A null id is larger than any
    other and takes its noise from an empty key; repeated rows have the same score and
    ranks of their own. With an empty target all buckets share its smoothed mass; an
    empty table gives no rows. Other columns are never read.
    """
    work = work or Workspace(docs.sparkSession, "importance")
    # numbers depend on how files are split, so ids are written with them and read from there
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    own = work.write(packs(numbered, order, pack_words), "packs")
    other = target.select(F.monotonically_increasing_id().alias("row"), F.lit(0).alias("key"), F.col(target_text_col).alias("text"))
    other = work.write(packs(other, order, pack_words), "target")
    gains = feature_gains(own, other, order, buckets, work)
    pieces = own.where("row IS NOT NULL").select("pack", "row", F.col("key").alias("doc_id"), "n", "words", "uses", "counts")
    weighed = weigh(pieces, gains)
    each = weighed.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_features"), F.sum("words").alias("n_words"), F.sum("total").alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    scored = each.withColumn("weight", weight).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("short", F.col("n_words") < least_words)
    # sorted by range, so a row's place is the size of the parts before its own plus its place inside
    ordered = scored.orderBy("short", F.desc("score"), F.asc_nulls_last("doc_id"), "row").withColumn("place", F.monotonically_increasing_id())
    ordered = work.write(ordered, "ordered")
    part = F.shiftright("place", 33)
    sizes = sorted(map(tuple, ordered.groupBy(part.alias("part")).agg(F.count("*"), F.sum((~F.col("short")).cast("long"))).collect()))  # a row per partition
    drawn = sum(s[2] for s in sizes) * percent // 100
    before, offsets = 0, []
    for number, size, _ in sizes:
        offsets.append((number, before))
        before += size
    offsets = F.broadcast(docs.sparkSession.createDataFrame(offsets, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = ordered.withColumn("part", part).join(offsets, "part")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(docs, target).drop("n_words")


# crc32 bit by bit over the bytes of a word; every distinct word once
ORACLE = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM texts
), counted AS (
  SELECT side, id, word, count(*) AS n FROM words GROUP BY ALL
), bytes AS (
  SELECT word, list_transform(range(octet_length(encode(word))), lambda k: ('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::BIGINT) AS each
  FROM (SELECT DISTINCT word FROM counted)
), codes AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS code
  FROM (SELECT unnest(range(256)) AS i)
), bucketed AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], each), lambda c, b: xor(c >> 8, code[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket
  FROM bytes, codes
), features AS (
  SELECT side, id, bucket, n FROM counted JOIN bucketed USING (word)
), buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM features GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM buckets
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM buckets, totals
), weighed AS (
  SELECT id, sum(n) AS n, sum(n * gain) AS total FROM features JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN weighed ON id = doc_id
), ranked AS (
  SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score FROM scored
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS size FROM ranked WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= size THEN place END AS rank
FROM ranked LEFT JOIN drawn USING (doc_id)
"""
