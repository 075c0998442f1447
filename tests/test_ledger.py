import os

import pytest
from docscore.operators import adapters
from docscore.sources import ledger, readers


def entries(spark, ids):
    return spark.createDataFrame([(i, f"{i}.png") for i in ids], "document_id string, source_file string")


def stored(spark, path):
    return sorted((r["batch"], r["document_id"]) for r in ledger.read_batches(spark, path, "document_id string").collect())


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "m")
    assert stored(spark, path) == []
    for _ in range(2):
        ledger.append_new(entries(spark, "ab"), path, 0)
        ledger.append_new(entries(spark, "abc"), path, 1)
    assert stored(spark, path) == [(0, "a"), (0, "b"), (1, "c")]


def test_what_a_run_that_was_cut_off_left_is_not_read(spark, tmp_path):
    path = str(tmp_path / "m")
    ledger.append_new(entries(spark, "ab"), path, 0)
    ledger.append_new(entries(spark, "cd"), path, 1)
    os.remove(tmp_path / "m" / "batch=1" / "_SUCCESS")
    assert stored(spark, path) == [(0, "a"), (0, "b")]
    ledger.append_new(entries(spark, "bcd"), path, 1)
    assert stored(spark, path) == [(0, "a"), (0, "b"), (1, "c"), (1, "d")]


def test_a_stream_appends_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "m")
    entries(spark, "aab").write.json(source)
    read = lambda: spark.readStream.schema("document_id string, source_file string").json(source)
    for k, ids in enumerate(("abc", "cd")):
        ledger.append_stream(read(), path, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        entries(spark, ids).write.mode("append").json(source)
    ledger.append_stream(read(), path, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    before = stored(spark, path)
    assert before == [(0, "a"), (0, "a"), (0, "b"), (1, "c"), (2, "d")]
    ledger.append_new(entries(spark, "aab"), path, 0)
    assert stored(spark, path) == before


def test_adapters_in_sql(spark):
    def parse(text):
        if text == "bad":
            raise ValueError("bad one")
        yield from ({"text": w, "page": 2} for w in text.split())

    adapters.register(spark, "words_of", parse)
    rows = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, None), (4, "")], "id int, response string")
    got = sorted((r["id"], r["page"], r["text"], r["reading_order"], r["error_label"]) for r in adapters.regions_by(spark, "words_of", rows).collect())
    assert got == [(1, 2, "a", 0, None), (1, 2, "b", 1, None), (2, None, None, None, "OCR_FAILURE")]
    adapters.register(spark, "words_of", lambda text: [{"colour": 1}])
    assert "colour" in adapters.regions_by(spark, "words_of", rows.where("id = 1")).first()["error_message"]


def test_lines_of_other_splits_are_not_parsed(spark, tmp_path):
    line = '{"document_id":"%s","source_file":"s","split"%s,"language":"he","pages":[]}'
    lines = [line % ("1", ':"dev"'), line % ("2", ' : "test"'), line % ("3", ':"d\\u0065v"'), '{"split":"test", broken', "# note"]
    path = str(tmp_path / "m.jsonl")
    with open(path, "w") as file:
        file.write("\n".join(lines))
    assert sorted(r["document_id"] for r in readers.read_manifest(spark, path, split="dev").collect()) == ["1", "3"]
    with pytest.raises(Exception, match="m.jsonl:4: invalid JSON"):
        readers.read_manifest(spark, path).collect()
    plan = readers.read_manifest(spark, path, split="dev")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan
    assert [r["document_id"] for r in readers.read_manifest(spark, path, split="d.v").collect()] == []
