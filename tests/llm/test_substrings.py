import hashlib
import math
import random
import re

import numpy as np
import pytest

from docscore.llm import substrings as op


def brute(rows, window=13):
    first, cut = {}, []
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        cut.append((d, words))
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, math.inf), math.inf if d is None else d)
    out = []
    for d, words in cut:
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < (math.inf if d is None else d):
                gone.update(range(k, k + window))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((d, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r)[:4] for r in op.repeated_passages(docs, **options).collect()), key=repr)


def made():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["é x", "Ab c"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [text(30) for _ in range(4)]
    rows = []
    for d in rnd.sample(range(10_000), 120):
        parts = [text(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            parts += [rnd.choice(passages), text(rnd.randint(0, 20))]
        rows.append((d, "\n".join(parts)))
    rows += [(20_000 + k, rows[0][1]) for k in range(20)]
    rows += [(5, None), (6, ""), (7, " \n"), (8, text(12)), (8, rows[0][1]), (8, rows[0][1]), (None, rows[0][1]), (None, rows[1][1]), (9, "a " * 3000), (10, "a " * 2000)]
    return rows


@pytest.mark.parametrize("options", [{}, {"filter_bits": 6}, {"window": 1}, {"window": 40, "filter_bits": 12}])
def test_matches_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(op, "PART_BYTES", 3000)
    rows = made()
    assert found(spark, rows, **options) == brute(rows, options.get("window", 13))


def test_fixture(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == brute(rows)


def thue_morse(n):
    return "".join("ab"[k.bit_count() % 2] for k in range(n))


def test_words_with_one_polynomial_hash_are_not_equal(spark):
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    data, starts, ends, _ = op.split_words([one.encode(), other.encode()])
    assert len(set(op.word_hashes(data, starts, ends).tolist())) == 1
    rest = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{other} {rest} more"), (4, f"{rest} {one} {rest}")]
    assert found(spark, rows) == brute(rows)
    assert [r[2] for r in found(spark, rows)] == [0, 0, 13, 13]


def test_ids_that_many_rows_share(spark):
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(9)) for _ in range(n))
    passage = text(40)
    rows = [(rnd.choice([7, None, 3]), f"{text(5)} {passage} {text(9)}") for _ in range(60)] + [(7, passage)] * 30 + [(None, passage)] * 30
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(None, t) for _, t in rows]) == brute([(None, t) for _, t in rows])


def test_ids_of_another_type(spark):
    rows = [("b", "x " * 20), ("a", "x " * 15), (None, "x " * 13), ("é", "y")]
    out = op.repeated_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == {"a": 0, "b": 20, None: 13, "é": 0}


def test_long_text(spark):
    words = [f"w{k % 70_000}" for k in range(150_000)]
    rows = [(1, " ".join(words)), (2, "\t".join(words[1000:90_000])), (3, "z" * 3_000_000)]
    assert found(spark, rows) == brute(rows)


def test_nothing_is_dealt_by_a_count_of_the_driver(spark):
    """The hashes of all windows are counted by Spark, combined before the shuffle."""
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = op.repeated_passages(docs)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "FlatMapGroups" not in plan and "FlatMapCoGroups" not in plan


def test_intervals_merge():
    mask = np.zeros(50, bool)
    mask[0:18] = mask[30:43] = mask[49] = True
    assert op.intervals(mask) == [(0, 18), (30, 43), (49, 50)]


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    monkeypatch.setattr(op, "SLICE_BYTES", 7)
    texts = [b"abc de \x00 \x00\x00", b"", b"  de abc", "é".encode() * 20 + b" de"]
    data, starts, ends, owner = op.split_words(texts)
    words = [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)]
    assert words == [w for t in texts for w in t.split()]
    assert owner.tolist() == [0, 0, 0, 0, 2, 2, 3, 3]
    hashes = op.word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words)) and len({*zip(words, hashes.tolist(), strict=True)}) == len(set(words))


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    docs = spark.createDataFrame([(1, "a b", 2, "z")], "doc_id long, text string, chunk long, rank string")
    assert op.repeated_passages(docs).count() == 1
