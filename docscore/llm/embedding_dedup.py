"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised, so a cosine of s is a distance of sqrt(2 - 2s). A table hashes
a vector to the floors of several Gaussian projections, shifted and divided by a bucket
width; vectors at a small distance share all of them often, far ones seldom. The number
of projections grows with the logarithm of the number of vectors, so that a bucket
holds few unrelated ones at any size, and there are as many tables as bring the chance
to miss a pair at the very threshold under ``miss``.

Equal vectors are one node with a count. Only nodes that share a bucket are compared:
the cells of a bucket are pairs of tiles, dealt over packs of bounded size, and a
task multiplies the two tiles. A pair is counted in the first table in which its nodes
meet, so that no pair has to be remembered; tasks return a link count and a tree root
for each node, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscore.llm.components import components
from docscore.llm.simhash import Forest
from docscore.llm.storage import Workspace
from docscore.llm.vectors import rows_of, slices, usable, width_of

COSINE = 0.95
WIDTH = 2.0
MISS = 0.01
STRAY = 0.1
TILE = 1024
PACK_ROWS = 20_000
PIECE = 1 << 16


def meeting_chance(distance: float, width: float) -> float:
    """The chance that one quantised Gaussian projection is the same for two vectors at a distance."""
    ratio = width / distance
    tail = math.erfc(ratio / math.sqrt(2))
    return 1 - tail - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def plan(count: int, cosine: float = COSINE, width: float = WIDTH, miss: float = MISS, stray: float = STRAY) -> tuple[int, int]:
    """``(projections, tables)`` for so many vectors.

    With them an uncorrelated vector is in the bucket of another ``stray`` times on
    average, and two vectors at the threshold meet in no table with a chance of ``miss``.
    """
    near = meeting_chance(math.sqrt(2 - 2 * cosine), width)
    far = meeting_chance(math.sqrt(2), width)
    projections = max(4, math.ceil(math.log(max(count, 2) / stray) / -math.log(far)))
    return projections, math.ceil(math.log(miss) / math.log1p(-(near**projections)))


@lru_cache(maxsize=2)
def hash_family(dimensions: int, projections: int, tables: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, shifts and odd multipliers that mix the floors of a table into one number."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((dimensions, projections * tables)) / width
    return directions, rng.random(projections * tables), rng.integers(0, 1 << 63, (tables, projections), np.uint64) * np.uint64(2) + np.uint64(1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their length; first by their largest entry, so that no square over- or underflows."""
    rows = rows.astype(float)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def signatures(rows: np.ndarray, projections: int, tables: int, width: float = WIDTH, seed: int = 42) -> np.ndarray:
    """The bucket of every row in every table, as 32-bit numbers."""
    directions, shifts, mixers = hash_family(rows.shape[1], projections, tables, width, seed)
    cells = np.floor(rows @ directions + shifts).astype(np.int64).view(np.uint64).reshape(len(rows), tables, projections)
    mixed = (cells * mixers).sum(axis=2, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def nodes_of(vectors: DataFrame, work: Workspace) -> DataFrame:
    """``node, vector, low, copies``, a written row for each distinct usable ``vector``."""
    each = vectors.where("usable").groupBy("vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    return work.write(each.withColumn("node", F.monotonically_increasing_id()), "nodes")


def signed(nodes: DataFrame, dimensions: int, projections: int, tables: int, width: float, seed: int) -> DataFrame:
    """``node, vector, copies, marks``: the nodes with their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max(dimensions, 2 * projections * tables)):
                found = signatures(unit(rows_of(part.column(1), dimensions)), projections, tables, width, seed)
                offsets = pa.array(np.arange(len(found) + 1) * tables, pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(found).ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["node", "vector", "copies", "marks"])

    kind = nodes.schema["vector"].dataType.simpleString()
    return nodes.select("node", "vector", "copies").mapInArrow(run, f"node long, vector {kind}, copies long, marks array<int>")


def linked(a: np.ndarray, b: np.ndarray, marks_a: np.ndarray, marks_b: np.ndarray, table: int, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at or above the cosine that no table before ``table`` has in one bucket."""
    near = a @ b.T >= cosine
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    fresh = np.ones(len(i), bool)
    for k in range(0, len(i), PIECE):
        part = slice(k, k + PIECE)
        fresh[part] = ~(marks_a[i[part], :table] == marks_b[j[part], :table]).any(axis=1)
    return i[fresh], j[fresh]


def compare(members: DataFrame, dimensions: int, tables: int, cosine: float, packs: int) -> DataFrame:
    """``node, links, root``: for each node with a link found in a pack, how many vectors
    it links with there, and the root of its tree there."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key = np.stack([table.column(c).to_numpy() for c in ("table", "bucket", "low_tile", "high_tile")]).astype(np.int64)
        order = np.lexsort(key[::-1])
        table, key = table.take(pa.array(order)), key[:, order]
        rows = unit(rows_of(table.column("vector").combine_chunks(), dimensions))
        marks = rows_of(table.column("marks").combine_chunks(), tables)
        tile, copies, node = (table.column(c).to_numpy() for c in ("tile", "copies", "node"))
        every, place = np.unique(node, return_inverse=True)
        counts, forest = np.zeros(len(every), np.int64), Forest(len(every))
        cuts = np.flatnonzero((np.diff(key) != 0).any(axis=0)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(node)], strict=True):
            number, _, low, high = key[:, start] if end > start else (0, 0, 0, 0)
            x = np.arange(start, end)
            y = x
            if low != high:
                x, y = x[tile[x] == low], x[tile[x] == high]
            i, j = linked(rows[x], rows[y], marks[x], marks[y], int(number), cosine, low == high)
            i, j = x[i], y[j]
            np.add.at(counts, place[i], copies[j])
            np.add.at(counts, place[j], copies[i])
            forest.link(place[i], place[j])
        met = counts > 0
        return pa.table({"node": pa.array(every[met]), "links": pa.array(counts[met]), "root": pa.array(every[forest.root[met]])})

    dealt = members.withColumn("pack", F.pmod(F.xxhash64("table", "bucket", "low_tile", "high_tile"), F.lit(packs)))
    return dealt.groupBy("pack").applyInArrow(run, "node long, links long, root long")


def near_links(nodes: DataFrame, work: Workspace, cosine: float = COSINE, width: float = WIDTH, miss: float = MISS, stray: float = STRAY, seed: int = 42) -> DataFrame:
    """``node, links, root`` of ``compare`` for all nodes, written."""
    count, dimensions = nodes.count(), width_of(nodes, "vector")
    projections, tables = plan(count, cosine, width, miss, stray)
    mark = work.mark()
    marked = work.write(signed(nodes, dimensions, projections, tables, width, seed), "marked")
    seats = marked.select("node", F.posexplode("marks").alias("table", "bucket"))
    crowd = F.count("*").alias("size")
    sizes = work.write(seats.groupBy("table", "bucket").agg(crowd).where("size > 1"), "sizes")
    # one row per bucket on the written side, so Spark splits the rows of a crowded bucket
    shared = work.write(seats.join(sizes.hint("merge"), ["table", "bucket"]), "shared")
    tiles = F.ceil(F.col("size") / TILE)
    placed = shared.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node", "table"), F.col("tiles")))
    cells = placed.select("node", "table", "bucket", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    cells = cells.select("node", "table", "bucket", "tile", F.least("tile", "other").alias("low_tile"), F.greatest("tile", "other").alias("high_tile"))
    rows = shared.agg(F.sum(tiles)).first()[0] or 0
    members = cells.join(marked.hint("merge"), "node")
    found = work.write(compare(members, dimensions, tables, cosine, max(1, -(-rows // PACK_ROWS))), "found")
    work.prune(mark, found)
    return found


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", work: Workspace | None = None, **options) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row for each input row.

    ``n_links`` counts the other rows found with a cosine of ``cosine`` or more, equal
    vectors among them; ``component_id`` is the smallest id reachable by links, itself
    included, and ``kept`` tells whether that is the row's own. A pair at the threshold
    is missed with a chance of ``miss``, nearer ones far less often; no pair below it is
    ever linked. Vectors that are null, empty, zero or hold a null or an entry that is
    not finite link with nothing, not even with each other. A null id takes part but
    names no component unless all ids in it are null; repeated rows are vectors of their
    own. An empty table gives no rows; vectors of different lengths are an error; other
    columns are never read.
    """
    work = work or Workspace(vectors.sparkSession, "embeddings")
    picked = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    if picked.schema["vector"].dataType.simpleString() not in ("array<float>", "array<double>"):
        picked = picked.withColumn("vector", F.col("vector").cast("array<double>"))
    picked = picked.withColumn("usable", usable(F.col("vector")) & F.exists("vector", lambda c: c != 0))
    nodes = nodes_of(picked, work)
    found = near_links(nodes, work, **options)
    roots = components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")), work)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    # a node with a link is in a component, so every node of roots has a count
    known = nodes.join(counts.hint("merge"), "node", "left").join(roots.hint("merge"), "node", "left")
    known = work.write(known.select("vector", "low", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "known")
    lowest = work.write(known.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = work.write(known.join(lowest.hint("merge"), "root").select("vector", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"), "named")
    linked_rows = picked.where("usable").join(named.hint("merge"), "vector").select("vec_id", "n_links", "component_id")
    alone = picked.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
