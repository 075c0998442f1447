import random

import pytest
from pyspark.sql import functions as F

from docscore.operators import near


def brute_nearest(left, right):
    out = []
    for key, at in left:
        some = [(abs(at - p), p > at, o, p, w) for k, p, o, w in right if k == key and p is not None] if at is not None else []
        best = min(some, default=None)
        out.append((key, at, (best[3], best[2], best[4]) if best else None, best[0] if best else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1, 7, 50, 1 << 16])
def test_nearest_is_that_of_all_pairs(spark, block):
    rnd = random.Random(block)
    keys = ["a", "b", None, "only left"]
    left = [(rnd.choice(keys), rnd.choice([None, *range(60)])) for _ in range(150)]
    right = [(rnd.choice([*keys[:3], "only right"]), rnd.choice([None, *range(0, 200)]), rnd.randrange(5), rnd.choice("xyz")) for _ in range(60)]
    right = list({(k, p, o): (k, p, o, w) for k, p, o, w in right}.values())
    got = near.nearest(spark.createDataFrame(left, "k string, at long"), spark.createDataFrame(right, "k string, at long, n int, word string"), ["k"], "at", "n", ["word"], block)
    found = sorted(((r["k"], r["at"], tuple(r["near"]) if r["near"] else None, r["distance"]) for r in got.collect()), key=repr)
    assert found == brute_nearest(left, right)


def test_nearest_is_that_in_the_row(spark):
    from docscore.functions import regex as R

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    row = docs.select("doc_id", F.explode(R.matches("text", "[0-9]+")).alias("m"), R.positions("text", "[.]").alias("p")).select("doc_id", F.col("m.pos").alias("at"), R.nearest(F.col("p"), F.col("m.pos")).alias("d"))
    spots = lambda pattern: docs.select("doc_id", F.posexplode(R.matches("text", pattern)).alias("n", "m")).select("doc_id", "n", F.col("m.pos").alias("at"))
    joined = near.nearest(spots("[0-9]+"), spots("[.]"), ["doc_id"], "at", "n", [], 100)
    assert sorted(map(tuple, row.collect())) == sorted(tuple(r) for r in joined.select("doc_id", "at", F.coalesce("distance", F.lit(1_000_000_000))).collect())


@pytest.mark.parametrize("cell", [1, 3, 4096])
def test_within_is_that_of_all_pairs(spark, cell):
    rnd = random.Random(cell)
    # one key has most rows, in one band
    key = lambda: rnd.choice(["hot"] * 6 + ["b", None])
    left = [(i, key(), x, x + rnd.choice([0, 0.5, 3, -1])) for i in range(80) for x in [rnd.choice([None, -2.5, 0.0, 1.0, rnd.uniform(-5, 5)])] if x is not None] + [(99, "b", None, 1.0)]
    right = [(i, key(), rnd.choice([None, 0.0, 1.0, rnd.uniform(-5, 5)])) for i in range(80)]
    got = near.within(spark.createDataFrame(left, "i int, k string, lo double, hi double"), spark.createDataFrame(right, "j int, k string, v double"), ["k"], "lo", "hi", "v", 0.7, cell)
    want = sorted((i, j) for i, a, lo, hi in left for j, b, v in right if a is not None and a == b and v is not None and lo is not None and lo <= v <= hi)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want
    assert got.columns == ["k", "i", "lo", "hi", "j", "v"]


def test_empty_tables(spark):
    one = spark.createDataFrame([("a", 1)], "k string, at long")
    none = spark.createDataFrame([], "k string, at long, n int")
    assert near.nearest(one, none, ["k"], "at", "n", []).first()["distance"] is None
    assert near.nearest(one.limit(0), none, ["k"], "at", "n", []).count() == 0


def test_hot_band_is_cut(spark):
    """A key with all rows in one band: no group of the join has more than a cell by a cell."""
    left = spark.range(3000).select(F.col("id").alias("i"), F.lit("hot").alias("k"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    right = spark.range(500).select(F.col("id").alias("j"), F.lit("hot").alias("k"), (F.col("id") % 2).cast("double").alias("v"))
    assert near.within(left, right, ["k"], "lo", "hi", "v", 10.0, 100).count() == 3000 * 250
