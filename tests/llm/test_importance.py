import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from docscore.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs(text, order):
    found = words(text)
    return [" ".join(found[i : i + k]) for k in range(1, order + 1) for i in range(len(found) - k + 1)]


def brute(rows, target, order=1, buckets=10_000, least=20, percent=10, seed=2024):
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    own, other = Counter(bucket(r) for _, t in rows for r in runs(t, order)), Counter(bucket(r) for t in target for r in runs(t, order))
    s, t = sum(own.values()), sum(other.values())
    gain = lambda b: math.floor(1000 * math.log((other[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets))))
    out, pool = [], []
    for k, (i, text) in enumerate(rows):
        each = runs(text, order)
        weight = sum(gain(bucket(r)) for r in each) // len(each) if each else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words(text)), len(each), weight, score, None])
        if out[-1][1] >= least:
            pool.append((-score, i is None, i or 0, k))
    for rank, (*_, k) in enumerate(sorted(pool)[: len(pool) * percent // 100], 1):
        out[k][-1] = rank
    return sorted(map(tuple, out), key=repr)


def found(spark, rows, target, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    return sorted(map(tuple, importance.resample(docs, aim, **options).collect()), key=repr)


def fixture(spark, sf="sf0.001"):
    docs = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    return docs, [r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet").collect()]


@pytest.mark.parametrize("options", [{}, {"order": 3, "buckets": 977, "percent": 35, "least_words": 5}, {"order": 2, "pack_words": 50}])
def test_fixture_matches_brute_force(spark, options):
    rows, target = fixture(spark)
    named = {"least_words": "least"}
    assert found(spark, rows, target, **options) == brute(rows, target, **{named.get(k, k): v for k, v in options.items() if k != "pack_words"})


@pytest.mark.parametrize("order", [1, 3])
def test_odd_rows(spark, order):
    rows = [
        (1, None), (2, ""), (3, " \n--"), (4, "One two"), (4, "one TWO"), (None, "Ünïcode ÄÖ straße 42"), (None, "a b c d e f"), (5, "tie tie tie tie tie"), (5, "tie tie tie tie tie"),
        (6, "x\x00y\x7fz {q} K ſ"), (7, " ".join(f"w{i % 700}" for i in range(30_000))), (8, "z" * 300_000 + " end"),
    ]
    for target in (["one two three", None, ""], []):
        assert found(spark, rows, target, order=order, least_words=2, percent=60, pack_words=1000) == brute(rows, target, order, least=2, percent=60)


@pytest.mark.parametrize("order", [1, 2, 5])
def test_lists_of_a_long_text_join_without_loss(monkeypatch, order):
    monkeypatch.setattr(importance, "SLICE_BYTES", 7)
    text = " ".join(["a", "bb", "ccc" * 9, "d"] * 20) + "  E"
    pack = importance.Pack(0, order)
    lists = list(importance.words_of(text, order))
    assert len(lists) > 5 and all(len(part) >= order for part in lists[:-1])
    for part, following in zip(lists, [*lists[1:], []]):
        pack.add((0, 0), part + following[: order - 1], len(part))
    names = [w.decode() for w in pack.places]
    _, got = pack.runs()
    longer = Counter(run for run in runs(text, order) if " " in run)
    assert Counter(" ".join(names[k] for k in run if k >= 0) for run in got.tolist()) == longer
    assert sum(pack.starts) == len(words(text))


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, [], ["a"]) == []
    docs = spark.createDataFrame([("k", "a b", 1, 2, 3)], "doc_id string, text string, row int, pack int, key int")
    assert importance.resample(docs, docs.limit(0), least_words=1, percent=100).first()["rank"] == 1


def test_oracle_agrees(spark):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    got = importance.query(spark, "/root/testdata/sf0.001")
    want = con.sql(importance.ORACLE)
    assert sorted(got.columns) == sorted(want.columns)
    order = got.columns
    rows = con.sql(f"SELECT {', '.join(order)} FROM ({importance.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
