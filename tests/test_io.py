import json

import pytest
from pyspark.sql import functions as F

from docscore import schema as S
from docscore.operators import aggregate as A
from docscore.operators import extract as E
from docscore.operators import inspect as I
from docscore.operators import score as C
from docscore.operators import seeding as D
from docscore.operators import validate as V
from docscore.sources import readers, writers
from docscore.streaming import events

TRUTH = {
    "source_file": "a.png", "vendor_name": "V", "business_tax_id": "123456782", "business_tax_id_valid": True, "invoice_number": "7", "invoice_date": "2026-01-01", "amount_before_vat": 100,
    "vat_amount": 18.5, "total_amount": 118.50, "allocation_number": None, "extraction_notes": [],
}
ENTRY = {"document_id": "d1", "source_file": "a.png", "split": "dev", "language": "he", "pages": ["p/a.png", "/abs/b.png"], "ground_truth": TRUTH}


def manifest(tmp_path, *lines):
    path = tmp_path / "manifest.jsonl"
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), encoding="utf-8")
    return str(path)


def test_manifest(spark, tmp_path):
    path = manifest(tmp_path, "# note", "", ENTRY, ENTRY | {"document_id": "d2", "split": "test"})
    rows = readers.read_manifest(spark, path).collect()
    assert [(r["line"], r["document_id"]) for r in rows] == [(3, "d1"), (4, "d2")]
    assert readers.read_manifest(spark, path, split="test").count() == 1
    pages = readers.resolved_pages(readers.read_manifest(spark, path), "/m").first()["pages"]
    assert pages == ["/m/p/a.png", "/abs/b.png"]
    raw = readers.raw_truth(readers.read_manifest(spark, path)).first()["truth"]
    assert raw["amount_before_vat"] == "100" and raw["vat_amount"] == "18.5"  # tokens as written
    for bad in ("{oops", {"document_id": "x"}):
        with pytest.raises(Exception, match=":1: "):
            readers.read_manifest(spark, manifest(tmp_path, bad)).collect()


def test_existing_ids_and_antijoin(spark, tmp_path):
    path = manifest(tmp_path, ENTRY, "{bad", '{"document_id": 5}', "")
    old = readers.existing_ids(spark, path)
    assert [r[0] for r in old.collect()] == ["d1"]
    found = spark.createDataFrame([("d1",), ("d3",), ("d2",)], "document_id string")
    assert [r[0] for r in D.new_documents(found, old, most=1).collect()] == ["d2"]
    assert D.new_documents(found, old, overwrite=True).count() == 3


def test_violations(spark, tmp_path):
    bad = TRUTH | {"vendor_name": 5, "vat_amount": "x", "extraction_notes": None, "extra": 1, "source_file": "b.png"}
    del bad["total_amount"]
    path = manifest(tmp_path, ENTRY, ENTRY | {"document_id": "d2", "ground_truth": bad, "annotation": {"field_presence": {"vat_amount": "MAYBE", "colour": "PRESENT"}}}, "{x", {"document_id": "d4"}, ENTRY | {"ground_truth": 3})
    lines = readers.numbered_lines(spark, path)
    got = {}
    for r in V.manifest_violations(lines).collect():
        got.setdefault(r["line"], []).append(r["message"])
    assert 1 not in got
    text = "\n".join(got[2])
    for part in ("extra keys: ['extra']", "missing keys: ['total_amount']", "string or null, got int", "'vendor_name' must be string", "'vat_amount' must be number", "extraction_notes must be a list", "unknown field 'colour'", "['vat_amount'] must be one of", "('b.png') != manifest source_file ('a.png')"):
        assert part in text, part
    assert got[3] == ["line 3: invalid JSON"] and len(got[4]) == 4 and got[5] == ["d1: ground_truth must be an object"]
    entries = lines.select("line", F.get_json_object("raw", "$.ground_truth").isNotNull().alias("has_truth"))
    totals = V.validation_totals(entries, V.manifest_violations(lines)).first()
    assert (totals["total"], totals["ok"], totals["with_truth"]) == (5, 1, 3)
    here = spark.createDataFrame([("/abs/b.png",)], "path string")
    assert any("page path does not exist: p/a.png" in r["message"] for r in V.manifest_violations(lines, here).collect())
    odd = manifest(tmp_path, ENTRY | {"annotation": 5}, ENTRY | {"annotation": {"field_presence": [1]}}, ENTRY | {"annotation": {}})
    said = {r["line"]: r["message"] for r in V.manifest_violations(readers.numbered_lines(spark, odd)).collect()}
    assert said == {1: "d1: annotation must be an object", 2: "d1: annotation.field_presence must be an object"}


def test_results_config_sidecars(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"document_id":"d","engine_id":"e","prediction":{"total_amount":2542,"vat_amount":228.0},"error":null}\n\n{"document_id":"d","engine_id":"f","error":{"message":"m"}}\n')
    raw = {r["engine_id"]: r for r in readers.raw_results(spark, str(tmp_path / "r.jsonl")).collect()}
    assert raw["e"]["prediction"]["total_amount"] == "2542" and raw["e"]["prediction"]["vat_amount"] == "228.0" and raw["f"]["error_label"] == "ERROR"
    assert readers.read_results(spark, str(tmp_path / "r.jsonl")).where("engine_id = 'e'").first()["prediction"]["total_amount"] == 2542.0
    (tmp_path / "phase.json").write_text(json.dumps({"manifest": "m", "engines": [{"id": "a", "adapter": "kraken", "params": {"n": 1}}]}))
    run, engines = readers.read_config(spark, str(tmp_path / "phase.json"))
    assert run == {"run_id": "phase", "manifest": "m"} and engines.first()["params"] == {"n": "1"}
    for broken in ({"engines": []}, {"engines": [{"adapter": "x"}]}):
        (tmp_path / "b.json").write_text(json.dumps(broken))
        with pytest.raises(ValueError):
            readers.read_config(spark, str(tmp_path / "b.json"))
    side = tmp_path / "ocr"
    side.mkdir()
    (side / "d__e.txt").write_text("line 1\nline 2")
    rows = spark.createDataFrame([("d", "e"), ("d", "f")], "document_id string, engine_id string")
    assert {r["engine_id"]: r["text"] for r in readers.with_sidecar_text(rows, readers.read_sidecars(spark, str(side))).collect()} == {"e": "line 1\nline 2", "f": ""}


def test_files_and_lines(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name in ("x/B.PNG", "a.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"1")
    assert [r["path"].rsplit("/", 1)[1] for r in readers.list_files(spark, str(tmp_path)).collect()] == ["a.pdf", "B.PNG"]
    (tmp_path / "venv").mkdir()
    (tmp_path / "m.py").write_text("def _extract_x(\n    import cv2\ndef to_json\n")
    (tmp_path / "venv" / "n.py").write_text("import cv2\n")
    counts = I.category_counts(I.line_labels(readers.source_lines(spark, str(tmp_path)), I.CATEGORIES), I.CATEGORIES)
    assert {r["category"]: r["hits"] for r in counts.collect()} == dict.fromkeys(I.CATEGORIES, 0) | {"Field extraction (regex)": 1, "OCR engine calls": 1, "Canonical JSON schema": 1}
    assert "| OCR engine calls | 1 |" in writers.module_map(counts, 1, ["test_a.py"])
    names = spark.createDataFrame([("test_a.py",), ("a_test.py",), ("_test.py",), ("x.py",)], "n string")
    assert [r[0] for r in names.select(I.is_test_file(F.col("n"))).collect()] == [True, False, True, False]


def test_env(tmp_path, monkeypatch):
    (tmp_path / "deep").mkdir()
    (tmp_path / ".env").write_text("# c\nA='1'\nexport B=\"x y\"\nbad line\n=3\nC=env\n")
    monkeypatch.setenv("C", "real")
    assert readers.read_env(readers.find_env(str(tmp_path / "deep"))) == {"A": "1", "B": "x y", "C": "real"}


def test_reports(spark, tmp_path):
    from docscore.plans import facts as P

    sf = "/root/testdata/sf0.001"
    scores = P.scores(spark, sf).cache()
    report, pivot, labels = A.engine_report(P.engines(spark), scores), A.field_pivot(scores), A.error_labels(scores)
    text = writers.markdown_report(report, pivot, A.top_labels(labels), "Report", "run", 3, {"blocked": "no engine"})
    assert "NOT RUN" in text and "| 3. Tesseract + tessdata_fast | `truncated` | OK |" in text and "- **`blocked`** — no engine" in text
    flat = writers.csv_report(report, pivot)
    assert flat.count() == 8 and sum(c.startswith(("present_", "absent_")) for c in flat.columns) == 32
    writers.write_csv(flat, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 8
    one = json.loads(writers.aggregate_json(report, A.field_counts(scores), labels).where("engine_id = 'exact'").first()["json"])
    assert one["engine_id"] == "exact" and len(one["per_field"]) == 8
    writers.write_results(writers.per_document(scores), str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == scores.count()
    side = spark.createDataFrame([("d", "e", None, None, "text\n"), ("d 1", "f", "BLOCKED", "no licence", None), ("d+%", "f_2", None, None, None)], "document_id string, engine_id string, error_label string, error_message string, assembled_text string")
    want = {("d", "e"): "text\n", ("d 1", "f"): "[BLOCKED] no licence", ("d+%", "f_2"): "[NO_TEXT] "}
    writers.write_sidecars(side, str(tmp_path / "side"))
    writers.write_packed_sidecars(side, str(tmp_path / "packed"))
    for rows in (readers.read_sidecars(spark, str(tmp_path / "side")), readers.read_packed_sidecars(spark, str(tmp_path / "packed"))):
        assert {(r["document_id"], r["engine_id"]): r["text"] for r in rows.collect()} == want


def test_spreadsheet_and_seeding(spark, tmp_path):
    docs = spark.createDataFrame([("d", "s.png", "dev", "he", ["p"], None, "first\n\nsecond")], "document_id string, source_file string, split string, language string, pages array<string>, tags array<string>, text string")
    extracted = E.format_first(docs)
    writers.write_spreadsheet(spark, extracted, str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbfsource_file,")
    entry = D.seeded_entries(docs.drop("text"), extracted, "engine-a").first()
    assert set(entry["annotation"]["field_presence"].values()) == {"UNREADABLE"} and set(entry["annotation"]["field_presence"]) == set(S.BUSINESS_FIELDS)
    assert entry["annotation"]["adjudication_status"] == "PENDING" and entry["annotation"]["ocr_sample"] == ["first", "second"]


def test_streaming_matches_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (source.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in")))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = events.event_windows(stream, late="1000 days").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["window_start"], r["event_type"], r["n"]) for r in spark.table("windows").collect()}
    assert got == {(r["window_start"], r["event_type"], r["n"]) for r in events.event_windows(batch).collect()}


def test_score_stream(spark, tmp_path):
    from docscore.plans import facts as P

    P.facts(spark, "/root/testdata/sf0.001").limit(50).write.parquet(str(tmp_path / "facts"))
    facts = spark.readStream.schema(spark.read.parquet(str(tmp_path / "facts")).schema).parquet(str(tmp_path / "facts"))
    seen = []
    query = events.score_stream(facts, lambda df, n: seen.extend(r["submitted"] for r in df.collect()), str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == 50


def test_numbered_lines(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 70) for k in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        assert sorted((r["line"], r["raw"]) for r in readers.numbered_lines(spark, str(tmp_path / "a.txt")).collect()) == [(k + 1, x) for k, x in enumerate(lines)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_image_sizes(spark, tmp_path):
    import struct

    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"rest"
    bmp = b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 31, -17) + b"\0" * 20
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"J" * 14 + b"\xff\xff\xc2" + struct.pack(">HBHH", 17, 8, 200, 300) + b"\0" * 20
    tiff = b"II*\0" + struct.pack("<I", 40) + b"\0" * 32 + struct.pack("<HHHIIHHIHH", 2, 256, 3, 1, 77, 257, 4, 1, 99, 0) + b"\0" * 4
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (511).to_bytes(3, "little") + (255).to_bytes(3, "little")
    lossless = b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 4 + b"\x2f" + (99 | 49 << 14).to_bytes(4, "little") + b"\0" * 9
    files = {"a.PNG": png, "b.bmp": bmp, "c.jpeg": jpeg, "d.tif": tiff, "e.webp": webp, "f.webp": lossless, "g.jpg": b"\xff\xd8", "h.png": b"no image", "i.txt": png}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"]) for r in readers.image_sizes(spark, str(tmp_path)).collect()}
    assert got == {"a.PNG": (640, 480), "b.bmp": (31, 17), "c.jpeg": (300, 200), "d.tif": (77, 99), "e.webp": (512, 256), "f.webp": (100, 50), "g.jpg": (None, None), "h.png": (None, None)}


def test_batch_files(spark, tmp_path):
    texts = spark.createDataFrame([("a.pdf", "id 123456782"), ("b.pdf", None), ("c.pdf", "")], "source_file string, text string")
    records = writers.batch_records(E.format_first(texts))
    writers.write_batch(records, str(tmp_path / "out"))
    writers.write_batch_summary(records, str(tmp_path / "out" / "summary.json"))
    rows = {r["pdf"]: r for r in readers.read_batch_summary(spark, str(tmp_path / "out" / "summary.json")).collect()}
    assert {k: (r["hits"], r["business_tax_id"], r["error"]) for k, r in rows.items()} == {"a.pdf": (1, "123456782", None), "b.pdf": (None, None, "text extraction failed"), "c.pdf": (0, None, None)}
    head = json.loads((tmp_path / "out" / "summary.json").read_text())
    assert head["pdf_count"] == 3 and head["field_hit_rate"]["business_tax_id"] == "1/3 (33%)"
    assert {r["pdf"] for r in spark.read.json(str(tmp_path / "out" / "raw")).collect()} == {"a.pdf", "c.pdf"}


def test_results_packed(spark, tmp_path):
    from docscore.sources import readers, writers

    rows = spark.range(50).selectExpr("cast(id as string) document_id", "'e' engine_id", "named_struct('vendor_name', 'same vendor') prediction")
    writers.write_results(rows, f"file://{tmp_path}/r", compression="gzip")
    assert list((tmp_path / "r").glob("*.json.gz"))
    assert readers.read_results(spark, f"file://{tmp_path}/r").count() == 50


def test_lines_of_several_files_are_one_text(spark, tmp_path):
    """numbers go on from file to file, and no line is sorted for them."""
    from docscore.sources import readers

    want, size = [f"line {k}" for k in range(5000)], spark.conf.get("spark.sql.files.maxPartitionBytes")
    for k in range(3):
        (tmp_path / f"part-{k}.txt").write_text("".join(w + "\n" for w in want[k * 1000 : (k + 1) * 1000 if k < 2 else None]))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        lines = readers.numbered_lines(spark, str(tmp_path), one_text=True)
        assert [r["raw"] for r in lines.orderBy("line").collect()] == want and lines.agg({"line": "max"}).first()[0] == len(want)
        assert "row_number" not in lines._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_summary_as_a_table(spark, tmp_path, monkeypatch):
    """the records of a summary are written by executors, the driver sees its head only."""
    from pyspark.sql.classic.dataframe import DataFrame

    from docscore.operators import extract as E
    from docscore.sources import readers, writers

    texts = spark.createDataFrame([("b.pdf", None), ("a.pdf", "ח.פ. 123456782"), ("c.pdf", "nothing")], "source_file string, text string")
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_, **__: pytest.fail("rows went to the driver"))
    writers.write_packed_summary(writers.batch_records(E.format_first(texts)), str(tmp_path / "s"))
    rows = {r["pdf"]: (r["hits"], r["business_tax_id"], r["error"]) for r in readers.read_packed_summary(spark, str(tmp_path / "s")).collect()}
    assert rows == {"a.pdf": (1, "123456782", None), "b.pdf": (None, None, "text extraction failed"), "c.pdf": (0, None, None)}
    assert json.loads((tmp_path / "s" / "head.json").read_text())["pdf_count"] == 3


def test_responses_are_dealt_and_results_made_without_maps(spark):
    """parsing is spread over all cores; a prediction is read from its place, no map is made for each of its fields."""
    from docscore.plans import catalog_io, catalog_records

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan(catalog_records.lateral_regions(spark, "/root/testdata/sf0.001"))
    assert "map_from_entries" not in plan(catalog_io._results(spark, "/root/testdata/sf0.001"))
