"""Token counts by a two-tier lookup of pre-token lengths on the map side.

The first tier is broadcast: a hash table of the pre-tokens that are most frequent in
a bounded sample of the texts, with their lengths in tokens. The second tier is a
bounded cache in each worker, filled by encoding what the first one lacks. No
pre-token of the texts is shuffled, and the sample changes the speed only.
"""

from __future__ import annotations

import heapq
from collections import Counter as Tally
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscore.llm import bpe

OVER = 512
SAMPLE_ROWS = 2_000
SAMPLE_TASKS = 8
FREQUENT = 60_000


def frequent(docs: DataFrame, tables: bpe.Tables, text_col: str = "text", rows: int = SAMPLE_ROWS, most: int = FREQUENT) -> dict[str, int]:
    """Lengths of the ``most`` most frequent pre-tokens of about ``rows`` rows taken evenly from the table.

    At most ``most`` words of at most ``bpe.CACHE_LETTERS`` letters; empty for an empty table.
    """
    total = docs.count()
    if not total:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts = bpe.worker_encoder(shared), Tally()
        for batch in batches:
            for text in batch.column(0):
                for piece in encoder.pieces(text.as_py() or ""):
                    if not isinstance(piece, int):
                        counts.update(w for w in piece if len(w) <= bpe.CACHE_LETTERS)
        some = heapq.nsmallest(most, counts.items(), key=lambda c: (-c[1], c[0]))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["word", "n"])

    sample = docs.select(F.col(text_col).cast("string").alias("text")).sample(min(1.0, rows / total), 42)
    counts: Tally = Tally()
    # SAMPLE_TASKS * most rows at most
    for r in sample.repartition(SAMPLE_TASKS).mapInArrow(tally, "word string, n long").toLocalIterator():
        counts[r["word"]] += r["n"]
    words = [w for w, _ in heapq.nsmallest(most, counts.items(), key=lambda c: (-c[1], c[0]))]
    return {w: len(ids) for w, ids in tables.encode_words(words).items()} if words else {}


class Counter(bpe.Encoder):
    """An encoder that remembers lengths and no ids."""

    def __init__(self, tables: bpe.Tables, first: dict[str, int], cache_words: int = bpe.CACHE_WORDS):
        super().__init__(tables, cache_words)
        self.first = first
        self.lengths = dict(self.first)
        self.older: dict[str, int] = {}

    def lookup(self, slices: list[list[str]]) -> dict[str, int]:
        for word in self.passing:
            self.lengths.pop(word, None)
        self.passing = []
        need = set().union(*slices)
        unseen = need.difference(self.lengths)
        if unseen:
            if len(self.lengths) + len(unseen) > len(self.first) + self.limit:
                self.older, self.lengths = self.lengths, dict(self.first)
                unseen = need.difference(self.lengths)
            known = unseen.intersection(self.older)
            self.lengths.update(zip(known, map(self.older.__getitem__, known)))
            found = self.tables.encode_words(list(unseen.difference(known)))
            self.lengths.update((w, len(ids)) for w, ids in found.items())
            self.passing = [w for w in found if len(w) > bpe.CACHE_LETTERS]
        return self.lengths

    def forget(self) -> None:
        super().forget()
        self.lengths, self.older = dict(self.first), {}

    def count_many(self, texts: list[str]) -> Iterator[int]:
        """The number of tokens of each text; unknown pre-tokens of short texts are encoded together."""
        waiting, chars = [], 0
        for text in texts:
            if chars + len(text) > bpe.SLICE_CHARS:
                yield from self._sums(waiting)
                waiting, chars = [], 0
            if len(text) > bpe.SLICE_CHARS:
                yield sum(next(self._sums([[piece]])) for piece in self.pieces(text))
            else:
                waiting.append(list(self.pieces(text)))
                chars += len(text)
        yield from self._sums(waiting)

    def _sums(self, waiting: list[list]) -> Iterator[int]:
        length = self.lookup([p for pieces in waiting for p in pieces if not isinstance(p, int)]).__getitem__
        for pieces in waiting:
            yield sum(1 if isinstance(p, int) else sum(map(length, p)) for p in pieces)


_COUNTERS: dict[int, Counter] = {}


def _worker_counter(shared) -> Counter:
    tables, first = shared.value
    if id(tables) not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[id(tables)] = Counter(tables, first)
    return _COUNTERS[id(tables)]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = OVER) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each input row.

    Strings of added tokens inside a text count as one token each, as the tokenizers
    library does by default. Null and empty texts have no bytes and no tokens.
    Repeated rows stay repeated; an empty table gives no rows; other columns are
    never read. Long texts stream through in slices.
    """
    tables = bpe.load_tables(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast((tables, frequent(docs, tables, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker_counter(shared)
        for batch in (b.slice(k, bpe.BATCH_ROWS) for b in batches for k in range(0, b.num_rows, bpe.BATCH_ROWS)):
            counts = list(counter.count_many([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        counter.forget()

    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    picked = picked.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe.default_tokenizer())
