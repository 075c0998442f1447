import json
import random

import pytest
from pyspark.sql import functions as F

from docscore.operators import regions as G

REGION = "document_id string, regions array<struct<page:int,text:string,polygon:array<struct<x:double,y:double>>,granularity:string,confidence:double,reading_order:int>>"


def box(y, h=20.0):
    y = float(y)
    return [(0.0, y), (10.0, y), (10.0, y + h), (0.0, y + h)]


def text(spark, regions, **options):
    rows = spark.createDataFrame([("d", [(p, t, g, "word", None, o) for p, t, g, o in regions] if regions is not None else None)], REGION)
    return G.assemble(rows, **options).first()["assembled_text"]


def test_assembly(spark):
    assert text(spark, [(0, "a", box(0), 0), (0, "b", box(4), 1), (0, "c", box(40), 2), (0, "d", box(44), 3)]) == "a b\nc d"
    assert text(spark, [(1, "z", box(0), 0), (0, "b", box(0), 1), (0, "a", box(0), None)]) == "a b\n\nz"
    # the running mean follows a drifting baseline
    assert text(spark, [(0, str(k), box(8.0 * k), k) for k in range(3)]) == "0 1 2"
    # without heights the gap is 12
    assert text(spark, [(0, "a", [(0.0, 0.0)], 0), (0, "b", [(0.0, 11.0)], 1), (0, "c", [(0.0, 30.0)], 2)]) == "a b\nc"
    assert text(spark, [(0, "a", None, 0), (0, "b", box(100), 1)]) == "a\nb"
    assert text(spark, []) == text(spark, None) == ""


def test_fixed_gap(spark):
    assert text(spark, [(0, "a", box(0), 0), (0, "b", None, 1), (0, "c", box(14), 2), (0, "d", box(40), 3)], gap_pixels=15) == "a b c\nd"


def test_word_rows(spark):
    rows = spark.createDataFrame([("d", 0, 0, 1.0, 2.0, 3.0, 4.0, "96", "x"), ("d", 0, 1, 0.0, 0.0, 0.0, 0.0, "-1", " "), ("d", 0, 2, 0.0, 0.0, 0.0, 0.0, "-1", "y"), ("d", 1, 0, 0.0, 0.0, 0.0, 0.0, "50", "z")],
                                 "document_id string, page int, i int, left double, top double, width double, height double, conf string, text string")
    got = {r["text"]: r for r in G.words_from_tsv(rows).collect()}
    assert {t: (r["page"], r["reading_order"], r["confidence"]) for t, r in got.items()} == {"x": (0, 0, 0.96), "y": (0, 1, None), "z": (1, 0, 0.5)}
    assert [tuple(p) for p in got["x"]["polygon"]] == [(1, 2), (4, 2), (4, 6), (1, 6)]


def test_line_rows(spark):
    rows = spark.createDataFrame([
        ("d", 0, 0, "a", [0.5, None, 1.0], None, ["1", "2", "3", "4"], None), ("d", 0, 1, "b", [], [[0.0, 0.0], [1.0, 1.0]], None, None),
        ("d", 0, 2, "c", None, None, ["1", "x", "3", "4"], [[5.0, 1.0], [2.0, 7.0]]), ("d", 0, 3, "e", None, None, None, None),
    ], "document_id string, page int, i int, text string, confidences array<double>, boundary array<array<double>>, bbox array<string>, cuts array<array<double>>")
    got = {r["text"]: r for r in G.lines_from_recognizer(rows).collect()}
    assert got["a"]["confidence"] == 0.75 and got["b"]["confidence"] is None
    assert [len(got[k]["polygon"] or []) for k in "abce"] == [4, 2, 4, 0]
    assert tuple(got["c"]["polygon"][0]) == (2.0, 1.0)


def test_worker_responses(spark):
    full = {"pages": [{"page_index": 2, "regions": [{"text": "a", "confidence": "1.7", "polygon": [[0, 1], [2, 3]]}, {"confidence": "-1"}]}]}
    rows = [("ok", json.dumps(full)), ("empty", '{"pages": []}'), ("license", '{"pages": [], "error": {"label": "X", "message": "License invalid"}}'), ("other", '{"error": {"label": "X", "message": "boom"}}')]
    got = G.regions_from_worker(spark.createDataFrame(rows, "document_id string, response string")).collect()
    ok = sorted((r["reading_order"], r["text"], r["page"], r["confidence"], r["granularity"]) for r in got if r["document_id"] == "ok")
    assert ok == [(0, "a", 2, 1.0, "word"), (1, "", 2, None, "word")]
    assert {r["document_id"]: r["error_label"] for r in got} == {"ok": None, "empty": "REQUEST_EMPTY", "license": "BLOCKED", "other": "X"}


def test_cloud_responses(spark):
    word = lambda s, **b: {"symbols": [{"text": c} for c in s], "boundingBox": b}
    page = {"blocks": [{"paragraphs": [{"words": [word("ab", vertices=[{"x": 1}]), word("  "), word("c", normalizedVertices=[{"y": 0.5}])]}]}]}
    rows = [("d", json.dumps({"pages": [page, page]}))]
    got = sorted((r["reading_order"], r["page"], r["text"], [tuple(p) for p in r["polygon"]]) for r in G.regions_from_cloud(spark.createDataFrame(rows, "document_id string, response string")).collect())
    assert got == [(0, 0, "ab", [(1.0, 0.0)]), (1, 0, "c", [(0.0, 0.5)]), (2, 1, "ab", [(1.0, 0.0)]), (3, 1, "c", [(0.0, 0.5)])]


def test_small_rules(spark):
    r = spark.range(1).select(
        G.clamp_confidence(F.lit("1.5")).alias("a"), G.clamp_confidence(F.lit("x")).alias("b"), G.percent_confidence(F.lit("96")).alias("c"), G.language_name(F.lit("HEB")).alias("d"),
        G.language_name(F.lit("xx"), strict=True).alias("e"), G.error_code(F.lit("boom"), F.lit(429)).alias("f"), G.engine_id(F.lit(""), "t-%s", F.lit("fast")).alias("g"),
        F.transform(G.words_or_lines(F.array(F.struct(F.lit(" ").alias("text"))), F.array(F.struct(F.lit("l").alias("text")))), lambda x: x["text"]).alias("h"),
    ).first()
    assert tuple(r) == (1.0, None, 0.96, "Hebrew", None, "BLOCKED", "t-fast", ["l"])


def test_dispatch():
    import pytest

    with pytest.raises(ValueError, match="unknown adapter"):
        G.regions_of("nope", None)
    assert G.engine_params({"model": "m.bin", "tessdata_dir": "/abs", "n": "1"}, "/conf") == {"model": "/conf/m.bin", "tessdata_dir": "/abs", "n": "1"}


@pytest.mark.parametrize("gap", [None, 15, 1e9])
def test_folded_rows_are_the_text_of_the_array(spark, gap):
    rnd = random.Random(8)
    rows = []
    for doc in ["a", "b", None]:
        for page in [0, 1, None]:
            for k in range(rnd.randrange(25)):
                y, h = rnd.randrange(120), rnd.choice([0, 10, 20, 21])
                box = None if rnd.random() < 0.2 else [(0.0, float(y)), (5.0, float(y + h))]
                rows.append((doc, page, rnd.choice([f"w{k}", None, "same"]), box, "word", rnd.choice([None, 0.5]), rnd.choice([None, rnd.randrange(6)])))
    df = spark.createDataFrame(rows, "document_id string, page int, text string, polygon array<struct<x double, y double>>, granularity string, confidence double, reading_order int")
    whole = G.assemble(G.collect_regions(df, ["document_id"]), gap_pixels=gap).select("document_id", "assembled_text").collect()
    folded = G.joined_pages(G.assembled_lines(df.repartition(3), ["document_id"], gap), ["document_id"]).select("document_id", "assembled_text").collect()
    assert sorted(map(tuple, folded), key=repr) == sorted(map(tuple, whole), key=repr)
    assert G.assembled_lines(df.limit(0), ["document_id"], gap).count() == 0
