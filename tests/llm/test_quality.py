import math
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash

from docscore.llm import quality as op


def hashed(text, bits=op.BUCKET_BITS):
    """Buckets of the words and pairs of a text, one by one."""
    mix, whole = int(op.MIX), (1 << 64) - 1
    each = [xxhash.xxh64_intdigest(w) for w in (text or "").lower().split()]
    pairs = [((a * mix) & whole) ^ b for a, b in zip(each, each[1:])]
    return [((x * mix) & whole) >> (64 - bits) for x in each + pairs]


def noise(doc_id, seed=42):
    state = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    state = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), state)
    return -math.log(-math.log(((state >> 11) + 0.5) / (1 << 53)))


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    ratios = op.log_ratios(docs, labels)
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    raw, target = np.zeros(len(ratios)), np.zeros(len(ratios))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for d, t in text.items():
        for b in hashed(t):
            raw[b] += 1
            target[b] += d in good
    smooth = lambda c: np.log((c + 0.5) / (c.sum() + 0.5 * len(c)))
    assert np.allclose(ratios, smooth(target) - smooth(raw))
    rows = op.resample(docs, ratios, share=0.3).collect()
    want = {d: sum(ratios[b] for b in hashed(t)) for d, t in text.items()}
    for r in rows:
        d = r["doc_id"]
        assert abs(r["log_weight"] - want[d]) < 1e-6 and abs(r["gumbel_key"] - want[d] - noise(d)) < 1e-6
        assert abs(r["mean_log_weight"] * max(len(hashed(text[d])), 1) - want[d]) < 1e-6
    ranked = sorted(rows, key=lambda r: (-r["gumbel_key"], r["row"]))
    assert {r["doc_id"] for r in ranked[: int(0.3 * len(rows))]} == {r["doc_id"] for r in rows if r["selected"]}


def test_held_out_separation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    weight = {r["doc_id"]: r["log_weight"] for r in op.resample(docs, op.log_ratios(docs, labels)).collect()}
    held = [(weight[r["doc_id"]], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = [w for w, q in held if q], [w for w, q in held if not q]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.8


@pytest.mark.parametrize("keys", ["ties", "equal", "near", "wide"])
def test_the_cut_is_exact(spark, monkeypatch, keys):
    monkeypatch.setattr(op, "BINS", 4)
    rnd = random.Random(1)
    make = {
        "ties": lambda k: float(k % 9), "equal": lambda k: 2.5, "near": lambda k: 1.0 + (k % 5) * 2.0**-52, "wide": lambda k: rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-300, 300),
    }
    rows = [(k * 7919 % 100, make[keys](k)) for k in range(100)]
    frame = spark.createDataFrame(rows, "row long, key double")
    for n in (1, 7, 50, 100):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:n]
        assert sorted(tuple(r) for r in frame.where(op.largest(frame, n)).collect()) == sorted(want)


def test_long_text_and_other_ids(spark):
    docs = spark.createDataFrame([("a", "good words " * 100_000), ("b", "x" * 300_000), (None, None)], "doc_id string, text string")
    ratios = op.log_ratios(docs, spark.createDataFrame([("a", 1)], "doc_id string, quality int"))
    rows = {r["doc_id"]: r for r in op.resample(docs, ratios, share=0.4).collect()}
    assert len(rows) == 3 and sum(r["selected"] for r in rows.values()) == 1
    assert abs(rows["a"]["log_weight"] - sum(ratios[b] for b in hashed("good words " * 100_000))) < 1e-3


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "a b", 1), (2, "a b", 1)], "doc_id long, text string, selected long")
    ratios = op.log_ratios(docs, spark.createDataFrame([(2, 1), (None, 1), (1, None)], "doc_id long, quality int"))
    assert sum(r["selected"] for r in op.resample(docs, ratios).collect()) == 2
    assert op.resample(docs.limit(0), ratios).count() == 0
