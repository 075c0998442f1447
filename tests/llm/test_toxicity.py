import math
import zlib
from collections import Counter

import numpy as np
import pytest

from docscore.llm import toxicity as op


def test_folding():
    assert op.fold("1d10t") == " idiot "
    assert op.fold("ІDIΟТ​!") == op.fold("idioti")
    assert op.fold("ｉｄｉｏｔ, 𝐢𝐝𝐢𝐨𝐭") == " idiot idiot "
    assert op.fold("идіот Éïdiöt ıdıøt ідіοт") != op.fold("idiot")
    assert op.fold("ídïôt 1dıøt іdıοт") == " idiot idiot idiot "
    assert op.fold("з") == op.fold("3") == op.fold("e") == " e "
    for c in map(chr, [*range(0x20, 0x3000), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D800)]):
        assert op.fold(op.fold(c)) == op.fold(c), c
    assert op.fold(None) == op.fold("") == "  "


def test_exceptions_and_length():
    model = op.Model({"trash": 4.0, "tra": 1.0, "scum": 3.0}, exceptions=("trash can",))
    found = model.automaton()
    one = op.weight_in(found, op.fold("you trash"))
    assert one > 0
    assert op.weight_in(found, op.fold("in the Trash-can.")) == 0
    assert op.weight_in(found, op.fold("the trash can is trash")) > 0
    assert op.weight_in(found, op.fold("you tr4sh " + "fine " * 500)) < one
    assert op.weight_in(found, op.fold("ultrash")) == 0
    assert op.weight_in(op.Model().automaton(), "  ") == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r["doc_id"]: r for r in op.score(docs, op.train(docs, labels)).collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in rows.items())
    said = [(r["toxic"], rows[r["doc_id"]]["predicted"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in said) / len(said) > 0.95
    assert sum(a and b for a, b in said) / max(1, sum(a for a, _ in said)) > 0.6


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, None), (None, 1)]])
def test_edge_tables(spark, labels):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (2, "x" * 200_000, 0.5), (2, "y", 0.5), (2, "y", 0.5)], "doc_id long, text string, score double")
    model = op.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [r["predicted"] for r in op.score(docs, model).collect()] == [0] * 5
    assert op.drop_toxic(docs, model).count() == 5
    assert op.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize(("toxic", "of"), [(2, 5), (3, 5), (1, 10)])
def test_any_share_of_toxic_labels(spark, toxic, of):
    def text(d):
        words = [f"w{(d * k + k * k) % 997:03d}x" for k in range(3, 40)]
        return " ".join(words[:20] + (["you", "grobnitz" if d % 7 else "vlarfing"] if d % of < toxic else []) + words[20:])

    docs = spark.createDataFrame([(d, text(d)) for d in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d % of < toxic)) for d in range(1000)], "doc_id long, toxic int")
    model = op.train(docs, labels)
    assert model.weights
    assert {r["doc_id"]: r["predicted"] for r in op.score(docs, model).collect()} == {d: int(d % of < toxic) for d in range(1000)}
    assert op.drop_toxic(docs, model).count() == 1000 - 1000 * toxic // of


def test_no_entry_calls_nothing_toxic(spark):
    docs = spark.createDataFrame([(d, f"plain words number{d}") for d in range(100)], "doc_id long, text string")
    model = op.train(docs, spark.createDataFrame([(d, int(d % 5 < 3)) for d in range(100)], "doc_id long, toxic int"))
    assert not model.weights and op.drop_toxic(docs, model).count() == 100


def naive_weight(folded, weights, exceptions):
    """The weight of a text by looking for every entry and phrase at every place."""
    covered = set()
    for phrase in map(op.fold, exceptions):
        for at in range(len(folded)):
            if folded.startswith(phrase, at):
                covered.update(range(at, at + len(phrase) - 1))
    best = {}
    for at in range(len(folded)):
        here = [(w, e) for e, w in weights.items() if folded.startswith(" " + e, at)]
        if here and at not in covered:
            entry = max(here)[1]
            best[entry] = best.get(entry, 0) + 1
    return sum(weights[e] * (1 + math.log(n)) for e, n in best.items()) / (1 + math.log(1 + folded.count(" "))) if best else 0.0


def test_training_and_scores_match_brute_force(spark):
    """Counts, chosen entries, exceptions and the score of every document of the fixture, computed one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = op.train(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            toxic[r["doc_id"]] = max(toxic.get(r["doc_id"], 0), r["toxic"])
    first = {}
    for d in sorted(d for d in toxic if d in text):
        first.setdefault((op.sketch(text[d]), toxic[d]), d)
    sample = [(text[d], t) for (_, t), d in first.items()]
    bad, clean = Counter(), Counter()
    for said, t in sample:
        words = set(op.fold(said).split())
        (bad if t else clean).update({w[:n] for w in words for n in range(3, 10) if len(w) >= n} | {w for w in words if len(w) > 9})
    counts = [(w, bad[w], clean[w]) for w in bad.keys() | clean.keys() if bad[w] + clean[w] >= op.LEAST_DOCS]
    n = sum(t for _, t in sample)
    want = op.choose_entries(counts, n, len(sample) - n, len(counts))
    assert want and model.weights == want
    x = np.array([naive_weight(op.fold(said), model.weights, model.exceptions) for said, _ in sample])
    y = np.array([t for _, t in sample], float)
    p = 1 / (1 + np.exp(-(model.slope * x + model.offset)))
    assert abs(np.mean(p - y)) < 1e-4 and abs(np.mean((p - y) * x) + 1e-5 * model.slope) < 1e-4
    some = sorted(text)[::5]
    got = {r["doc_id"]: r["score"] for r in op.score(docs, model).collect()}
    for d in some:
        z = model.slope * naive_weight(op.fold(text[d]), model.weights, model.exceptions) + model.offset
        assert abs(got[d] - 1 / (1 + math.exp(-max(-40, min(40, z))))) < 1e-9


def test_exceptions_are_learned(spark):
    fill = lambda d: " ".join(f"w{(d * k + k * k) % 997:03d}x" for k in range(3, 30))

    def text(d):
        if d % 4 == 0:
            return f"{fill(d)} you grobnitz {fill(d + 1)}"
        return f"{fill(d)} the grobnitz valve {fill(d + 1)}" if d % 40 == 1 else fill(d)

    docs = spark.createDataFrame([(d, text(d)) for d in range(1200)] + [(5000, "a grobnitz valve broke"), (5001, "what a grobnitz he is")], "doc_id long, text string")
    model = op.train(docs, spark.createDataFrame([(d, int(d % 4 == 0)) for d in range(1200)], "doc_id long, toxic int"))
    assert model.weights and "grobnitz valve" in model.exceptions
    said = {r["doc_id"]: r["predicted"] for r in op.score(docs, model).collect()}
    assert said == {d: int(d % 4 == 0) for d in range(1200)} | {5000: 0, 5001: 1}


def test_long_words_and_other_ids(spark):
    rows = [(f"d{k}", "fine words here " + ("abcdefghijvile" if k % 3 == 0 else "abcdefghijnice" if k % 3 == 1 else "z" * 100_000)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    model = op.train(docs, spark.createDataFrame([(f"d{k}", int(k % 3 == 0)) for k in range(200)], "doc_id string, toxic int"))
    assert not model.weights or set(model.weights) == {"abcdefghijvile"}
    assert op.Model({"abcdefghijvile": 9.0}).automaton()
    assert len(op._beginnings(" " + "z" * 100_000 + " ")) == 8
