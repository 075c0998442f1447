import pytest

from docscore.operators import extract as E


def run(spark, how, texts, **options):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.asDict() for r in E.extract(rows, how, **options).orderBy("i").collect()]


NOISY = """לכבוד: חברת הדוגמה
ח.פ. 012345674
עוסק מורשה 123456782
חשבונית מס 04512 מקור
תאריך 05/03/2026
סכום 1.000.00
מע"מ 180.00 ( 18.00 % )
לתשלום 1.180.00
12345678901234567890123456
"""


def test_format_first_golden(spark):
    r = run(spark, "format_first", [NOISY])[0]
    assert (r["amount_before_vat"], r["vat_amount"], r["total_amount"]) == (1000.0, 180.0, 1180.0)
    assert r["business_tax_id"] == "012345674" and r["business_tax_id_valid"] is True  # the addressee wins
    assert r["invoice_date"] == "2026-03-05"
    assert r["invoice_number"] == "04512"
    assert r["allocation_number"] == "12345678901234567890123456"
    assert r["vendor_name"] == "חברת הדוגמה"
    assert r["extraction_notes"] == []


def test_nothing_is_invented(spark):
    for how in E.EXTRACTORS:
        for r in run(spark, how, [None, "", "@@@ ... no fields here ..."]):
            assert {k: r[k] for k in E.FIELDS if k != "extraction_notes"} == dict.fromkeys((k for k in E.FIELDS if k != "extraction_notes"))
            assert r["extraction_notes"] == []


def test_format_first_edges(spark):
    got = run(spark, "format_first", [
        "id 123456789 only", "31.02.2026 and 2026-13-05", "13/25/2020 12/25/2020", "phone 03-1234567 then 98765 end", "a 10.00 b 11.80", "18% 34.78 x 193.22 y 228.00", "חשבונית 12345678",
    ])
    assert (got[0]["business_tax_id"], got[0]["business_tax_id_valid"]) == ("123456789", False) and got[0]["extraction_notes"] == [E.NOTE_ISSUER_INVALID]
    assert got[1]["invoice_date"] == "2026-02-31"  # the calendar is not consulted
    assert got[2]["invoice_date"] == "2020-12-25"
    assert got[3]["invoice_number"] == "98765"
    assert (got[4]["amount_before_vat"], got[4]["vat_amount"], got[4]["total_amount"]) == (10.0, 1.8, 11.8)
    assert (got[5]["amount_before_vat"], got[5]["vat_amount"], got[5]["total_amount"]) == (193.22, 34.78, 228.0)
    assert got[6]["invoice_number"] is None


CLEAN = """חברת הדוגמה בע"מ
עוסק מורשה 123456782
חשבונית מס 5512
תאריך 01/02/2025
סה"כ 100.00
מע"מ 18.00
לתשלום 118.00
מספר הקצאה 123456789
"""


def test_strict_equals_tolerant_on_clean_text(spark):
    plain = {"reverse_tokens": False, "fix_abbreviations": False}
    strict = run(spark, "label_anchored", [CLEAN], **plain)[0]
    tolerant = run(spark, "label_anchored", [CLEAN], tolerant=True, **plain)[0]
    for field in ("business_tax_id", "invoice_number", "invoice_date", "vat_amount", "total_amount", "allocation_number"):
        assert strict[field] == tolerant[field], field
    assert (strict["business_tax_id"], strict["invoice_number"], strict["invoice_date"]) == ("123456782", "5512", "2025-02-01")
    assert (strict["amount_before_vat"], strict["vat_amount"], strict["total_amount"], strict["allocation_number"]) == (100.0, 18.0, 118.0, "123456789")
    assert strict["vendor_name"] == 'חברת הדוגמה בע"מ'


def test_label_anchored_tiers_and_notes(spark):
    plain = {"reverse_tokens": False, "fix_abbreviations": False}
    got = run(spark, "label_anchored", ["עוסק מורשה 123456789", "text 123456782 only", "ח.פ. 123456789", "העברה בנקאית 01/02/2024 תאריך 05/06/2024", "7/8/2023"], **plain)
    assert (got[0]["business_tax_id_valid"], got[0]["extraction_notes"]) == (False, [E.NOTE_ISSUER_INVALID])
    assert (got[1]["business_tax_id"], got[1]["extraction_notes"]) == ("123456782", [E.NOTE_BY_CHECKSUM])
    assert (got[2]["business_tax_id"], got[2]["extraction_notes"]) == ("123456789", [E.NOTE_NO_VALID])
    assert got[3]["invoice_date"] == "2024-02-01"
    assert (got[4]["invoice_date"], got[4]["extraction_notes"]) == ("2023-08-07", [E.NOTE_DATE])


def test_tolerant_fallbacks(spark):
    r = run(spark, "label_anchored", ["1.000.00 x\n180.00 ( 18.00 % )\n1.180.00\n123456789012345678901234"], tolerant=True, reverse_tokens=False, fix_abbreviations=False)[0]
    assert (r["amount_before_vat"], r["vat_amount"], r["total_amount"]) == (1000.0, 180.0, 1180.0)
    assert r["allocation_number"] == "123456789012345678901234"
    assert r["extraction_notes"] == [E.NOTE_VAT, E.NOTE_ARITHMETIC, E.NOTE_ALLOCATION]


@pytest.mark.parametrize("values", [(100.0, 18.0, 150.0)])
def test_mismatch_note(spark, values):
    before, vat, total = values
    text = f'סה"כ {before}\nמע"מ {vat}\nלתשלום {total}'
    r = run(spark, "label_anchored", [text], reverse_tokens=False, fix_abbreviations=False)[0]
    assert r["extraction_notes"] == ["amount check mismatch: 100.0 + 18.0 != 150.0"]


@pytest.mark.parametrize("name", ["extract_format_first", "ranked_candidates"])
def test_made_texts_are_dealt_over_the_cores(spark, name):
    from docscore.plans import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan


def test_places_are_those_of_matches(spark):
    from docscore.functions import regex as R

    texts = ["", None, "לכבוד 123456789 ב-1.2.2024", "𝒳 12 😀345 6", "a\n18 % 2024-01-02 1,000.50", "٣٤٥٦ 12345"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("f", E.looked("t")).orderBy("i")
    got = [r.f.asDict(recursive=True) for r in rows.collect()]
    for name, (pattern, group) in E.LOOKED.items():
        want = rows.select(R.positions("t", pattern) if group is None else R.matches("t", pattern, group)).collect()
        assert [f[name] for f in got] == [[m.asDict() if group is not None else m for m in r[0] or []] for r in want], name


@pytest.mark.parametrize("name", ["extract_format_first", "ranked_candidates"])
def test_a_text_is_searched_once(spark, name):
    from docscore.plans import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [found(") == 1 and "regexp_extract_all" not in plan
