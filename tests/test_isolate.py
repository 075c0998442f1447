import pytest
from pyspark.sql import functions as F

from docscore.operators import isolate as Q


def test_each_stage_has_its_label(spark):
    def load(page):
        if page == "lost":
            raise OSError("no such page")
        return page

    def recognize(page):
        if page.startswith("BLOCKED"):
            raise RuntimeError(page)
        return {"": 1 // 0}[page] if page == "crash" else page

    rows = [(1, "1.5"), (2, "lost"), (3, "crash"), (4, "BLOCKED: no licence"), (5, "x1"), (6, None), (7, "2.5"), (7, "2.5")]
    df = spark.createDataFrame(rows, "id int, raw string").withColumn("kept", F.col("id") * 2)
    out = Q.run_documents(df, load, recognize, float, ["raw"], "string", "string", "double")
    got = sorted(((r["id"], r["kept"], r["prediction"], r["error"] and r["error"]["label"], sorted(r["timings_ms"])) for r in out.collect()), key=repr)
    every = ["assembled_text_ms", "page_ms", "prediction_ms"]
    assert got == [
        (1, 2, 1.5, None, every), (2, 4, None, Q.PAGE_LOAD_ERROR, ["page_ms"]), (3, 6, None, Q.OCR_FAILURE, every[:2]), (4, 8, None, Q.BLOCKED, every[:2]),
        (5, 10, None, Q.EXTRACT_FAILURE, every), (6, 12, None, Q.OCR_FAILURE, every[:2]), (7, 14, 2.5, None, every), (7, 14, 2.5, None, every),
    ]
    errors = {r["id"]: r["error"] for r in out.collect()}
    assert errors[2]["message"] == "no such page" and "OSError" in errors[2]["traceback"] and errors[4]["traceback"] is None


def test_a_result_of_another_type_is_an_error_of_its_row(spark):
    out = Q.stage(spark.createDataFrame([(1,), (2,)], "id int"), "v", "X", lambda i: i if i == 1 else "two", ["id"], "int")
    assert sorted((r["id"], r["v"], r["error"] is None) for r in out.collect()) == [(1, 1, True), (2, None, False)]


def test_rows_with_an_error_are_not_run(spark):
    df = spark.createDataFrame([(1, ("BLOCKED", "m", None)), (2, None)], f"id int, error {Q.ERROR}")
    out = Q.stage(df, "v", "X", lambda i: 1 // (i - 1), ["id"], "int")
    assert sorted((r["id"], r["v"], r["error"] and r["error"]["label"]) for r in out.collect()) == [(1, None, "BLOCKED"), (2, 1, None)]


@pytest.mark.parametrize("text, fine", [('{"a": 1, "b": "x"}', True), ('{"a": "no"}', False), ("{oops", False), (None, False), ("[]", False), ("{}", True)])
def test_json_of_a_row(spark, text, fine):
    out = Q.parsed(spark.createDataFrame([(text,)], "t string"), "o", "OCR_FAILURE", "t", "a int, b string").first()
    assert (out["o"] is not None) == fine and (out["error"] is None) == fine


def test_empty_table(spark):
    assert Q.stage(spark.createDataFrame([], "id int"), "v", "X", lambda i: i, ["id"], "array<struct<a int>>").count() == 0
