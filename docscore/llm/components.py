"""Connected components of an edge table, without collecting any of it.

Alternates the two star operations: every node first tells its larger neighbours
about the smallest node around it, then its smaller ones. Minima are map-side
combined, written, and joined back from storage, so that Spark splits the edges of a
hub over tasks; nothing is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscore.llm.storage import Workspace


def _smallest(edges: DataFrame, work: Workspace) -> DataFrame:
    return work.write(edges.groupBy("u").agg(F.min("v").alias("low")), "low").hint("merge")


def _large_star(edges: DataFrame, work: Workspace) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest(both, work).withColumn("low", F.least("low", "u"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame, work: Workspace) -> DataFrame:
    low = _smallest(edges, work)  # v < u throughout
    moved = edges.join(low, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(mixed, 24)), F.bit_xor(mixed)).first())


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``node, root`` for every node with an edge other than the smallest of its component.

    ``edges`` has two comparable columns ``u, v``. Repeated edges, loops and either
    direction are allowed; edges with a null end link nothing. No edges: no rows.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    start = work.mark()
    now = work.write(ordered, "edges")
    mark = _mark(now)
    while True:
        before = mark
        wide = work.write(_large_star(now, work), "wide")
        now = work.write(_small_star(wide, work), "edges")
        mark = _mark(now)
        work.prune(start, now)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
