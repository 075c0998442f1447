import hashlib
import re

import pytest

from docscore.llm import exact_dedup as op


def brute(rows):
    norm = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t in rows]
    out = []
    for (d, _), n in zip(rows, norm):
        same = [i for (i, _), m in zip(rows, norm) if m == n]
        known = [i for i in same if i is not None]
        out.append((d, max(known) if known else None, len(same), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (1, None), (2, ""), (3, "Abc"), (4, "aBC"), (5, "abc "), (6, "Éa"), (7, "éa"), (8, "É" * 40), (9, "É" * 40), (10, "É" * 39 + "e"),
    (11, "ab" * 100), (12, "ab" * 100), (13, "ab" * 99 + "ba"), (14, "ab" * 101), (14, "ab" * 101), (None, "abc"), (None, "zz"), (None, "zz"),
    (15, "x" * 8), (16, "x" * 16), (17, "x" * 24), (18, "x" * 24), (19, "x" * 20_000), (20, "X" * 20_000), (21, "\x00"), (22, "\x00\x00"),
]


@pytest.mark.parametrize("bits", [64, 2, 0])
@pytest.mark.parametrize("size", [8, 4096])
def test_matches_brute_force(spark, size, bits):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    work = op.Workspace(spark, "test")
    docs = work.write(docs, "docs")
    rows = op.exact_duplicates(docs, block_bytes=size, route_bits=bits or 1).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows], key=repr) == brute(ROWS)
    kept = {}
    for r in rows:
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_drop_keeps_columns_and_one_row_each(spark):
    docs = spark.createDataFrame([(1, "A", 9, "q"), (2, "a", 8, "r"), (2, "a", 8, "r"), (3, None, None, None)], "doc_id long, text string, row long, name string")
    out = op.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(2, "a", 8, "r"), (3, None, None, None)]


def test_empty_table(spark):
    assert op.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_main_path_runs_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = op.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rows_stay_when_files_are_split_anew(spark, tmp_path):
    rows = [(k, f"text {k % 40} " + " ".join(f"w{(k % 40) * j}" for j in range(9)), "s") for k in range(60)]
    for k in range(6):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = sorted(r["doc_id"] for r in op.drop_duplicates(docs).collect())
    late = op.drop_duplicates(docs)
    try:
        # as if cores had been lost between the jobs: fewer, larger splits
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert sorted(r["doc_id"] for r in late.collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(want) == 40


def test_drop_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "A", 7, 8), (2, "a", 9, 8), (None, None, None, 1)], "doc_id long, text string, __row long, __ROW_ long")
    out = op.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((tuple(r) for r in out.collect()), key=repr) == [(2, "a", 9, 8), (None, None, None, 1)]


def test_a_text_that_most_rows_have_is_split(spark):
    """With thresholds forced down, Spark splits the joins of a text that three quarters of the rows have."""
    set_to = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.files.maxPartitionBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "20",
    }
    old = {k: spark.conf.get(k, None) for k in set_to}
    try:
        for k, v in set_to.items():
            spark.conf.set(k, v)
        rows = [(k, "same text " * 900 if k % 4 else f"text {k} " * 900) for k in range(4000)]
        docs = op.Workspace(spark, "test").write(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), "docs")
        out = op.exact_duplicates(docs)
        groups = out.groupBy("group_size").count().collect()
        assert {(r["group_size"], r["count"]) for r in groups} == {(3000, 3000), (1, 1000)}
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
