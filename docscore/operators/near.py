"""Joins of tables by nearness: the nearest row, and all rows of an interval.

Positions are looked at in blocks, so no task holds all rows of a key: a document or
customer with a third of all rows is spread over its blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
CELL = 4096


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[f"_{c}"]) for c in names))


def _apart(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names`` with an underscore before them, so that both sides of a join can be told apart."""
    return df.withColumnsRenamed({c: f"_{c}" for c in names})


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, ordinal: str, payload: list[str], block: int = BLOCK) -> DataFrame:
    """The rows of ``left`` with ``near`` (a struct of ``at``, ``ordinal`` and ``payload`` of the nearest row of ``right``) and ``distance``.

    Both tables have the ``keys`` and a number ``at``; rows meet where the keys are
    equal, null equal to null. Of rows of ``right`` as near on both sides the one before
    counts, of several at one place the one with the smallest ``ordinal``. Rows of
    ``left`` without any, or with a null place, have null; rows of ``right`` with a null
    place do not count. Repeated rows stay repeated.

    Both sides are sorted together inside blocks of places, and the last and first row
    of ``right`` known there are carried through; what blocks without one need comes
    from a small table with a row per block.
    """
    places = left.where(F.col(at).isNotNull()).select(*keys, at).distinct()
    known = right.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.min(F.struct(F.col(ordinal), *[F.col(c) for c in payload])).alias("_o"))
    known = known.select(*keys, at, F.struct(F.col(at), "_o.*").alias("_r"))
    both = known.withColumn("_side", F.lit(0)).unionByName(places.withColumn("_r", F.lit(None).cast(known.schema["_r"].dataType)).withColumn("_side", F.lit(1)))
    both = both.withColumn("_block", F.floor(F.col(at) / block))
    inside = Window.partitionBy(*keys, "_block").orderBy(at, "_side")
    cells = both.withColumns({
        "_before": F.last("_r", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "_after": F.first("_r", ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing)),
    }).where("_side = 1")
    blocks = both.groupBy(*keys, "_block").agg(F.max("_r").alias("_last"), F.min("_r").alias("_first"))
    along = Window.partitionBy(*keys).orderBy("_block")  # a row per block
    blocks = blocks.select(
        *keys, "_block", F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_left"), F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_right")
    )
    blocks = _apart(blocks, [*keys, "_block"])
    cells = cells.join(blocks, _same(cells, blocks, [*keys, "_block"]), "left")
    before, after = F.coalesce("_before", "_left"), F.coalesce("_after", "_right")
    here = F.col(at)
    take_before = before.isNotNull() & (after.isNull() | (here - before[at] <= after[at] - here))
    best = cells.select(*keys, at, F.when(take_before, before).otherwise(after).alias("near"))
    best = _apart(best.withColumn("distance", F.abs(F.col(at) - F.col("near")[at])), [*keys, at])
    return left.join(best, _same(left, best, [*keys, at]), "left").select(left["*"], "near", "distance")


def within(left: DataFrame, right: DataFrame, keys: list[str], low: str, high: str, value: str, width: float, cell: int = CELL) -> DataFrame:
    """Pairs of rows with equal keys and the right ``value`` in the left interval from ``low`` to ``high``, both ends included.

    The right columns must have other names than the left ones, but for the keys, which
    come once; nulls meet nothing. The line is cut into bands of ``width``: a right row
    is in one, a left row in all that its interval touches, so pairs are found once and
    nothing is multiplied out. Bands of a key with more than ``cell`` rows on a side are
    cut into parts of about that many by a hash of the rows, and each part meets every
    part of the other side, so no task gets more than ``cell`` by ``cell`` rows of a key.
    """
    band = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    spot = [*keys, "_band"]
    lefts = left.where(F.col(low) <= F.col(high)).withColumn("_band", F.explode(F.sequence(band(low), band(high))))
    rights = right.where(F.col(value).isNotNull()).withColumn("_band", band(value))
    parts = lambda rows, name: rows.groupBy(*spot).agg(F.ceil(F.count("*") / cell).alias(name)).where(F.col(name) > 1)
    crowded = parts(lefts, "_cut_l").join(parts(rights, "_cut_r"), spot, "full")

    def split(rows: DataFrame, own: str, other: str) -> DataFrame:
        one = F.lit(1).cast("long")
        dealt = rows.join(crowded, spot, "left").withColumns({"_cut_l": F.coalesce("_cut_l", one), "_cut_r": F.coalesce("_cut_r", one)})
        mixed = F.xxhash64(*[F.col(c) for c in rows.columns])
        return dealt.withColumn(f"_part_{own}", F.pmod(mixed, F.col(f"_cut_{own}"))).withColumn(f"_part_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_cut_{other}") - 1))).drop("_cut_l", "_cut_r")

    met = split(lefts, "l", "r").join(split(rights, "r", "l"), [*spot, "_part_l", "_part_r"])
    return met.where(F.col(value).between(F.col(low), F.col(high))).drop("_band", "_part_l", "_part_r")
