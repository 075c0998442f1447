"""SimHash near-duplicates: fingerprints, tiled exact comparison, components.

Fingerprints at most ``radius`` bits apart agree in at least one of ``radius + 1``
blocks of bits, so every link is found inside a bucket of fingerprints that share a
block. The same holds for the bits that a bucket leaves open, so a large bucket is
split by blocks of those, again and again until its parts are small: distinct
fingerprints that agree in all but a few bits are few. A bucket is cut into tiles
ordered by population count. Pairs of tiles are compared with numpy exclusive-or and
bit counts; pairs whose population counts differ beyond the radius are skipped. Each
task returns a spanning forest of the links it saw, never the links themselves, so
its output is linear in its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscore.llm.components import components
from docscore.llm.storage import Workspace, free_name

LANES = np.uint64(0x0101010101010101)
TILE = 1024
LARGE = 8192
PACK_ROWS = 20_000
SLICE_SHINGLES = 200_000


def _lane_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Set bits for each of 64 positions in each run of hashes beginning at ``starts``.

    Eight byte lanes of a word are counted at once, in pieces of at most 255 hashes.
    """
    sizes = np.diff(np.append(starts, len(hashes)))
    pieces = (sizes + 254) // 255
    owner = np.repeat(np.arange(len(starts)), pieces)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = starts[owner] + 255 * inside
    first = np.searchsorted(owner, np.arange(len(starts)))
    out = np.empty((len(starts), 64), np.int64)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, cuts)
        counts = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[:, shift::8] = np.add.reduceat(counts, first, axis=0)
    return out


def _pack(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    bits = counts * 2 > sizes[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(text: bytes, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a lower-cased text, in slices of bounded size."""
    words = text.split()  # at space and tab to carriage return
    if not words:
        return
    digest = xxhash.xxh64_intdigest
    count = max(len(words) - width + 1, 1)
    for k in range(0, count, SLICE_SHINGLES):
        part = words[k : k + SLICE_SHINGLES + width - 1]
        n = min(SLICE_SHINGLES, count - k)
        if width == 3 and len(words) >= 3:
            joined = map(b"%b %b %b".__mod__, zip(part, part[1:], part[2:]))
        else:
            joined = (b" ".join(part[i : i + width]) for i in range(n))
        yield np.fromiter((digest(x, seed) for x in joined), np.uint64, n)


def fingerprints_of(texts: list[str | None], width: int = 3, seed: int = 42) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text; zero where there are no words."""
    counts, sizes = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    waiting: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        if waiting:
            lengths = np.fromiter(map(len, waiting), np.int64, len(waiting))
            np.add.at(counts, owners, _lane_counts(np.concatenate(waiting), np.cumsum(lengths) - lengths))
            np.add.at(sizes, owners, lengths)
            waiting.clear()
            owners.clear()

    held = 0
    for k, text in enumerate(texts):
        for hashes in shingle_hashes((text or "").encode("utf-8", "replace").lower(), width, seed):
            waiting.append(hashes)
            owners.append(k)
            held += len(hashes)
            if held >= SLICE_SHINGLES:
                flush()
                held = 0
    flush()
    return _pack(counts, sizes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, row_col: str | None = None) -> DataFrame:
    """``row, doc_id, fp``: the fingerprint of every text as a signed long. Null text counts as empty.
    ``row`` is ``row_col`` or else a number given in reading order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = fingerprints_of(part.column(2).to_pylist(), width, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.int64())], ["row", "doc_id", "fp"])

    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    picked = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"row long, doc_id {picked.schema['doc_id'].dataType.simpleString()}, fp long")


class Forest:
    """Links found so far among the values of one bucket."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the trees of a and b; the smallest index is the root."""
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                again = root[root]
                if np.array_equal(again, root):
                    break
                root[:] = again


def compare_tiles(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest ``(value, root value)`` of the links among ``values``."""
    every = np.unique(values)
    weight = np.bitwise_count(every)
    order = np.argsort(weight, kind="stable")
    forest = Forest(len(every))
    for i in range(0, len(order), TILE):
        rows = order[i : i + TILE]
        high = int(weight[rows[-1]])
        for j in range(i, len(order), TILE):
            cols = order[j : j + TILE]
            if int(weight[cols[0]]) > high + radius:
                break  # tiles further on weigh more
            apart = np.bitwise_count(every[rows][:, None] ^ every[cols][None, :])
            a, b = np.nonzero(apart <= radius)
            forest.link(rows[a], cols[b])
    moved = np.flatnonzero(forest.root != np.arange(len(every)))
    return every[moved], every[forest.root[moved]]


def split_mask(mask: int, radius: int) -> list[int]:
    """``mask`` with each of ``radius + 1`` blocks of the bits it leaves open; none where it leaves too few."""
    rest = [b for b in range(64) if not mask >> b & 1]
    if len(rest) <= radius:
        return []
    cuts = [len(rest) * k // (radius + 1) for k in range(radius + 2)]
    return [mask | sum(1 << b for b in rest[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(values: DataFrame, splits: dict[int, list[int]]) -> DataFrame:
    """``fp, mask, value``: each fingerprint of a bucket once for each split of the bucket's mask."""
    if list(splits) == [0]:
        each = values.select("fp", F.explode(F.array(*[F.lit(_signed(part)).cast("long") for part in splits[0]])).alias("mask"))
    else:
        rows = [(_signed(mask), _signed(part)) for mask, parts in splits.items() for part in parts]
        # (radius + 1) ** depth rows at most, whatever the table
        finer = F.broadcast(values.sparkSession.createDataFrame(rows, "mask long, finer long"))
        each = values.join(finer, "mask").select("fp", F.col("finer").alias("mask"))
    return each.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).distinct()


def links(values: DataFrame, radius: int, work: Workspace) -> DataFrame:
    """``u, v``: links between distinct fingerprints (column ``fp``) that connect all that are within ``radius``."""
    masks, large = [0], values.withColumn("mask", F.lit(0).cast("long"))
    small: list[DataFrame] = []
    total = 0
    while True:
        splits = {m: split_mask(m, radius) for m in masks}
        splits = {m: parts for m, parts in splits.items() if parts}
        keyed = _keyed(large, splits)
        sizes = work.write(keyed.groupBy("mask", "value").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        members = work.write(keyed.join(sizes.hint("merge"), ["mask", "value"]), "members")
        masks = sorted({m for parts in splits.values() for m in parts})
        # a bucket that leaves too few bits open to be split is small
        final = [_signed(m) for m in masks if not split_mask(m, radius)]
        fits = (F.col("size") <= LARGE) | F.col("mask").isin(final)
        small.append(members.where(fits))
        total += small[-1].count()
        large = members.where(~fits).select("fp", "mask")
        if large.isEmpty():
            break
    packs = max(1, -(-total // PACK_ROWS))
    every = small[0]
    for more in small[1:]:
        every = every.unionByName(more)
    dealt = every.select(F.pmod(F.xxhash64("mask", "value"), F.lit(packs)).alias("pack"), "mask", "value", "fp")

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        mask, value = table.column("mask").to_numpy(), table.column("value").to_numpy()
        order = np.lexsort((value, mask))
        fp, mask, value = fp[order], mask[order], value[order]
        cuts = np.flatnonzero((np.diff(mask) != 0) | (np.diff(value) != 0)) + 1
        us, vs, start = [], [], 0
        for end in [*cuts.tolist(), len(fp)] if len(fp) else []:
            some = fp[start:end]
            if end - start == 2:
                if int(some[0] ^ some[1]).bit_count() <= radius:
                    us.append(some[:1])
                    vs.append(some[1:])
            else:
                a, b = compare_tiles(some, radius)
                us.append(a)
                vs.append(b)
            start = end
        none = np.empty(0, np.uint64)
        u, v = np.concatenate([none, *us]).view(np.int64), np.concatenate([none, *vs]).view(np.int64)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return dealt.groupBy("pack").applyInArrow(run, "u long, v long").distinct()


def component_labels(marks: DataFrame, radius: int, work: Workspace) -> DataFrame:
    """``fp, root, component_id`` for every fingerprint of ``marks``, a written table."""
    mark = work.mark()
    values = work.write(marks.groupBy("fp").agg(F.min("doc_id").alias("low")), "values")
    roots = components(links(values.select("fp"), radius, work), work)
    named = values.join(roots.hint("merge"), values["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = work.write(named, "named")
    # written, so that Spark splits a component that has a third of all fingerprints
    lowest = work.write(named.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    labels = work.write(named.join(lowest.hint("merge"), "root").select("fp", "root", "component_id"), "labels")
    work.prune(mark, labels)
    return labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, radius: int = 2, work: Workspace | None = None
) -> DataFrame:
    """``doc_id, fingerprint, component_id``, a row for each input row.

    Texts are lower-cased (A-Z), cut into words at white space and shingled;
    fingerprints within ``radius`` bits link, and ``component_id`` is the smallest
    ``doc_id`` reachable, itself included. Texts without words, null among them, have
    fingerprint zero and link like any other. Rows with a null id take part but give
    no component its name, unless all ids in it are null. Repeated rows stay repeated;
    an empty table gives no rows; other columns are never read.
    """
    work = work or Workspace(docs.sparkSession, "simhash")
    marks = work.write(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    labels = component_labels(marks, radius, work)
    return marks.join(labels.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """The input's rows and columns, one row of each component: that with the smallest
    id, of several the first in reading order; a null id is larger than any other.
    Texts without words, null among them, are one component. Columns of any name are
    kept; an empty table gives no rows."""
    work = Workspace(docs.sparkSession, "simhash")
    # numbers depend on how files are split, so the numbered rows are written and never numbered again
    number = free_name(docs, "__row")
    marked = work.write(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    marks = work.write(fingerprints(marked, id_col, text_col, width, seed, number), "fingerprints")
    labels = component_labels(marks, radius, work)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    kept = marks.join(labels.hint("merge"), "fp").groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.row").alias(number))
    return marked.join(kept, number, "left_semi").drop(number)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
