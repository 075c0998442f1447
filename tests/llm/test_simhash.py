import random
import re

import numpy as np
import pytest
import xxhash

from docscore.llm import simhash
from docscore.llm.components import components
from docscore.llm.storage import Workspace


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=2):
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = []
    for i, (d, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, f"{prints[i]:016x}", min(same) if same else None))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, simhash.near_duplicates(docs, **options).collect()), key=repr)


def test_fixture_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == brute_components(rows)


def test_edge_texts(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(7, None), (3, ""), (9, " \t\n"), (1, "one"), (2, "ONE"), (2, "ONE"), (None, "one two"), (None, "one  two"), (5, long), (4, long + " x"), (6, "Éa b c"), (8, "éa b c"), (11, "ſ K b")]
    assert found(spark, rows) == brute_components(rows)


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    docs = spark.createDataFrame([(1, "a b c", 5, "x")], "doc_id long, text string, fp long, root string")
    assert simhash.near_duplicates(docs).count() == 1


@pytest.mark.parametrize("split", [False, True])
def test_tiles_find_every_link(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(simhash, "LARGE", 12)
        monkeypatch.setattr(simhash, "TILE", 8)
    rnd = random.Random(5)
    values = {rnd.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:
        for _ in range(12):
            w = v
            for b in rnd.sample(range(64), rnd.randint(1, 3)):
                w ^= 1 << b
            values.add(w)
    values = sorted(values)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    work = Workspace(spark, "test")
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    label = {r["node"]: r["root"] for r in components(simhash.links(frame, 2, work), work).collect()}
    root = {v: v for v in signed}
    changed = True
    near = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2]
    near = [(int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))) for a, b in near]
    while changed:
        changed = False
        for a, b in near:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert {v: label.get(v, v) for v in signed} == root


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (None, 4), (2000, 2001), (2001, 2000)]
    found = components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "test")).collect()
    assert {r["node"]: r["root"] for r in found} == {i: 0 for i in range(1, 61)} | {k: 1000 for k in range(1001, 1100)} | {2001: 2000}


def test_rows_stay_when_files_are_split_anew(spark, tmp_path):
    rows = [(k, f"text {k % 40} " + " ".join(f"w{(k % 40) * j}" for j in range(9)), "s") for k in range(60)]
    for k in range(6):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect())
    late = simhash.drop_near_duplicates(docs)
    try:
        # as if cores had been lost between the jobs: fewer, larger splits
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert sorted(r["doc_id"] for r in late.collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(want) == 40


def test_masks_cover_every_link():
    """Any two values within the radius agree in one mask at every depth, and the last masks leave few bits open."""
    rnd = random.Random(3)
    for _ in range(200):
        a = rnd.getrandbits(64)
        b = a
        for k in rnd.sample(range(64), 2):
            b ^= 1 << k
        masks = [0]
        while masks:
            alike = [m for m in masks if a & m == b & m]
            assert alike
            masks = [x for m in alike[:1] for x in simhash.split_mask(m, 2)]
    assert simhash.split_mask((1 << 62) - 1, 2) == []


def test_drop_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", 7, 8), (2, "a b c d", 9, 8), (3, None, None, 1)], "doc_id long, text string, __row long, __ROW_ long")
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a b c d", 7, 8), (3, None, None, 1)]


def test_a_component_with_most_fingerprints_is_split(spark):
    """No aggregation in the stage of a join on a key that many rows share: Spark can split such a key."""
    docs = spark.createDataFrame([(k, f"a b c d{k % 3}") for k in range(50)], "doc_id long, text string")
    plan = simhash.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Aggregate" not in plan and "Broadcast" not in plan
