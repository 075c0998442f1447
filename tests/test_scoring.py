import itertools

import pytest
from pyspark.sql import functions as F

from docscore import schema as S
from docscore.operators import aggregate as A
from docscore.operators import rank as K
from docscore.operators import score as C

TRUTH = {
    "vendor_name": "A  B", "business_tax_id": "012345674", "invoice_number": "77", "invoice_date": "2026-01-02", "amount_before_vat": "100", "vat_amount": "18.0", "total_amount": "118.00", "allocation_number": "123456",
}
EQUAL = TRUTH | {"vendor_name": " A B ", "amount_before_vat": "100.0", "total_amount": "118"}
WRONG = {k: ("2020-01-01" if k == "invoice_date" else "9") for k in TRUTH}
FACTS = "document_id string, engine_id string, error_label string, prediction map<string,string>, truth map<string,string>, presence map<string,string>"


def score(spark, rows):
    return C.scored(C.with_fields(spark.createDataFrame(rows, FACTS)))


def test_truth_table(spark):
    rows, want = [], {}
    for field, presence, kind in itertools.product(S.BUSINESS_FIELDS, S.PRESENCE_VALUES, ("null", "equal", "wrong")):
        key = f"{field}-{presence}-{kind}"
        value = {"null": None, "equal": EQUAL[field], "wrong": WRONG[field]}[kind]
        truth = TRUTH | ({field: None} if presence == "ABSENT" else {})
        rows.append((key, "e", None, EQUAL | {field: value}, truth, {field: presence}))
        if presence in ("UNREADABLE", "AMBIGUOUS"):
            want[key] = (False, False, None)
        elif presence == "ABSENT":
            want[key] = (True, value is None, None if value is None else "FIELD_SELECTION_ERROR")
        else:
            label = None if kind == "equal" else "OCR_DETECTION_ERROR" if kind == "null" else "OCR_DIGIT_ERROR" if field in S.AMOUNT_FIELDS + S.ID_FIELDS else "OCR_TEXT_ERROR"
            want[key] = (True, kind == "equal", label)
    got = C.outcomes_long(score(spark, rows)).collect()
    for r in got:
        field = r["document_id"].split("-")[0]
        if r["field"] == field:
            assert (r["scorable"], r["correct"], r["error_label"]) == want[r["document_id"]], r
    assert len(got) == 8 * len(rows)


def test_row_measures(spark):
    rows = [
        ("ok", "e", None, EQUAL, TRUTH, None),
        ("unparsable", "e", None, EQUAL | {"invoice_date": None}, TRUTH | {"invoice_date": "soon"}, None),
        ("blocked", "e", "BLOCKED", None, TRUTH, None),
        ("failed", "e", "OCR_FAILURE", None, TRUTH, None),
        ("untrue", "e", None, EQUAL, None, None),
        ("unscorable", "e", None, EQUAL, TRUTH, {"vendor_name": "UNREADABLE"}),
        ("decomposed", "e", None, EQUAL | {"vendor_name": "é"}, TRUTH | {"vendor_name": "é"}, None),
    ]
    got = {r["document_id"]: r for r in score(spark, rows).collect()}
    assert got["ok"]["all_fields_complete"] and got["ok"]["critical_complete"]
    assert got["ok"]["digit_accuracy"] < 1  # 100 and 100.0 are equal amounts with different digits
    assert got["unparsable"]["all_fields_complete"]  # neither side parses
    assert got["blocked"]["status"] == "BLOCKED" and got["blocked"]["outcomes"] == [] and got["blocked"]["digit_accuracy"] is None
    assert got["untrue"]["status"] == "ok" and got["untrue"]["outcomes"] == [] and got["untrue"]["all_fields_complete"] is None
    assert got["unscorable"]["all_fields_complete"] is None and got["unscorable"]["critical_complete"] is True
    assert got["decomposed"]["all_fields_complete"] is True
    counts = A.engine_counters(score(spark, rows)).collect()[0]
    assert (counts["submitted"], counts["ok"], counts["blocked"], counts["errored"], counts["all_fields_complete_total"]) == (7, 5, 1, 1, 3)
    labels = {r["label"]: r["n"] for r in A.error_labels(score(spark, rows)).collect()}
    assert labels == {"OCR_FAILURE": 1}


def test_same_rendering_gives_full_digit_accuracy(spark):
    r = score(spark, [("d", "e", None, TRUTH, TRUTH, None)]).collect()[0]
    assert r["digit_accuracy"] == 1.0 and r["all_fields_complete"]


def test_latest_truth_wins_and_join(spark):
    truth = spark.createDataFrame([("d", 1, {"a": "1"}, None), ("d", 2, {"a": "2"}, None), ("x", 1, None, None)], "document_id string, line long, truth map<string,string>, presence map<string,string>")
    results = spark.createDataFrame([("d", "e"), ("x", "e")], "document_id string, engine_id string")
    got = {r["document_id"]: r["truth"] for r in C.join_truth(results, truth).collect()}
    assert got == {"d": {"a": "2"}, "x": None}


def test_statuses_and_candidates(spark):
    rows = spark.createDataFrame([(2, 0, 2, 0), (2, 0, 0, 2), (2, 1, 1, 0), (2, 2, 0, 0), (0, 0, 0, 0)], "submitted long, ok long, blocked long, errored long")
    assert [r[0] for r in rows.select(A.engine_status()).collect()] == ["BLOCKED", "ERRORED", "PARTIAL", "OK", "NOT RUN"]
    e = spark.createDataFrame([("tesseract", "x-FAST", None), ("tesseract", "x", "/t/tessdata_fast"), ("tesseract", "x", None), ("kraken", "fast", None), ("zz", "x", None)], "a string, e string, t string")
    assert [r[0]["number"] for r in e.select(A.candidate(F.col("a"), F.col("e"), F.col("t"))).collect()] == [3, 3, 2, 4, 0]


def test_ranking_ties_and_winners(spark):
    totals = spark.createDataFrame([("a", 5, 4, 9, 1), ("b", 5, 5, 9, 0), ("c", 3, 3, 9, 0), ("d", 7, 1, 9, 0), ("z", 0, 0, 0, 2), ("y", 0, 0, 0, 0)], "engine_id string, total_correct long, present_correct long, judged long, blocked long")
    got = {r["engine_id"]: (r["rank"], r["shown_rank"]) for r in K.ranking(totals).collect()}
    assert got == {"d": (1, "1"), "b": (2, "2"), "a": (2, ""), "c": (4, "4"), "z": (None, "—")}
    o = [("1", "a", [(True, True)]), ("1", "b", [(True, True)]), ("2", "a", [(True, False)]), ("2", "b", [(True, False)]), ("3", "a", [(True, True)]), ("3", "b", [(False, True)]), ("3", "c", [])]
    rows = [(*r, "ok" if r[2] else "BLOCKED", True) for r in o]
    w = K.document_winners(spark.createDataFrame(rows, "document_id string, engine_id string, outcomes array<struct<scorable boolean, correct boolean>>, status string, has_truth boolean"))
    assert {r["document_id"]: r["winners"] for r in w.collect()} == {"1": ["a", "b"], "2": ["a", "b"], "3": ["a"]}
    assert {r["engine_id"]: r["docs_won"] for r in K.win_credit(w).collect()} == {"a": 2.0, "b": 1.0}


def test_counts_of_fields_match_the_long_form(spark):
    from docscore.plans import facts as P

    scores = P.scores(spark, "/root/testdata/sf0.001").cache()
    rows = lambda df: sorted(tuple(r[c] for c in ("engine_id", "field", "present_correct", "present_total", "absent_correct", "absent_total", "excluded")) for r in df.collect())
    assert rows(A.field_counts(scores)) == rows(A.field_counters(C.outcomes_long(scores)))


@pytest.mark.parametrize("bins", [1, 4, 1024])
def test_latency_is_exact(spark, bins):
    import random

    import numpy as np

    rnd = random.Random(2)
    values = {"a": [rnd.lognormvariate(0, 2) for _ in range(301)], "b": [7.0] * 50, "c": [1.0], None: [float(rnd.randrange(5)) for _ in range(40)], "d": [1.0, 1e9] + [2.0] * 9}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("b", float("nan")), ("e", None)]
    got = {r["k"]: r for r in A.latency(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", bins).collect()}
    assert set(got) == {*values, "e"} and (got["e"]["n"], got["e"]["p50"]) == (0, None)
    for k, vs in values.items():
        assert got[k]["n"] == len(vs)
        assert got[k]["p50"] == pytest.approx(np.quantile(vs, 0.5)) and got[k]["p95"] == pytest.approx(np.quantile(vs, 0.95))


def test_bootstrap_holds_the_mean(spark):
    pairs = spark.range(400).select("id", (F.col("id") % 2).cast("double").alias("a"), F.lit(0.0).alias("b"))
    r = A.paired_bootstrap(pairs, "a", "b", "id", rounds=100).collect()[0]
    assert r["low"] < 0.5 < r["high"] and abs(r["mean"] - 0.5) < 0.02


def test_grid_and_failed_engines(spark):
    facts = spark.createDataFrame([("1", "a", None, {"x": "1"}), ("1", "b", "OCR_FAILURE", None)], "document_id string, engine_id string, error_label string, prediction map<string,string>")
    engines = spark.createDataFrame([("a",), ("b",), ("c",)], "engine_id string")
    grid = {(r["document_id"], r["engine_id"]): r["status"] for r in C.cross_status(facts, engines, facts).collect()}
    assert grid == {("1", "a"): "ok", ("1", "b"): "OCR_FAILURE", ("1", "c"): "NOT RUN"}
    failed = spark.createDataFrame([("a", "no engine")], "engine_id string, message string")
    got = {r["engine_id"]: (r["error_label"], r["prediction"]) for r in C.block_failed_engines(facts, failed).collect()}
    assert got == {"a": ("BLOCKED", None), "b": ("OCR_FAILURE", None)}


@pytest.mark.parametrize("confidence", [0.95, 0.99, 0.5])
def test_costs(spark, confidence):
    from docscore.functions import numbers as N

    r = spark.range(1).select(*[c.alias(k) for k, c in N.cost_model(F.lit(100_000), F.lit(1), F.lit(0.2330496), F.lit(0.5)).items()], N.correction_cost(F.lit(100_000), F.lit(30), F.lit(10)).alias("c"), N.cost_per_correct(F.lit(335.59), F.lit(1_000_000), F.lit(0.75)).alias("k")).collect()[0]
    assert round(r["elastic_cost"], 2) == 18.50 and round(r["warm_cost"], 2) == 167.80 and round(r["c"], 2) == 8333.33 and round(r["k"], 8) == 0.00044745


def test_character_error(spark):
    pairs = spark.createDataFrame([("y", "abc", "abd"), ("y", "x", None)], "k string, predicted string, expected string")
    assert A.character_error(pairs, ["k"]).first()["cer_micro"] == pytest.approx(1 / 3)


def test_character_error_in_bytes(spark):
    pairs = spark.createDataFrame([("k", "a", "é"), ("k", "bc", "bd")], "k string, predicted string, expected string")
    assert A.character_error(pairs, ["k"]).first()["edits"] == 2
    got = A.character_error(pairs, ["k"], unit="byte").first()
    assert (got["edits"], got["reference_chars"]) == (3, 3)


def test_digit_accuracy_by_band_and_by_length(spark):
    from docscore.functions import numbers as N

    pairs = [("123", "123"), ("1234", "123"), ("", "12"), ("12" * 30, "21" * 30), ("9" * 20 + "1" * 20, "1" * 20), ("5" * 12, "6" * 12)]
    rows = spark.createDataFrame(pairs, "p string, e string")
    got = rows.select(N.edit_distance(F.col("p"), F.col("e")).alias("d"), F.levenshtein("p", "e").alias("want")).collect()
    assert all(r["d"] == r["want"] for r in got)
    assert rows.select(N.digit_accuracy(F.col("p"), F.col("e"), F.lit(True))).collect()[1][0] == pytest.approx(1 - 1 / 3)


def test_lost_and_moved_digits_keep_their_edits(spark):
    """Digits that are only lost are told by their number; where some are lost and others added, by the edit distance."""
    cut = {k: v[:-1] if k in S.ID_FIELDS + S.AMOUNT_FIELDS else v for k, v in TRUTH.items()}
    mixed = cut | {"invoice_number": "771"}
    got = score(spark, [("a", "e", None, cut, TRUTH, {}), ("b", "e", None, mixed, TRUTH, {})])
    digits = {r["document_id"]: r for r in got.collect()}
    n = digits["a"]["reference_digit_count"]
    assert digits["a"]["digit_accuracy"] == pytest.approx(1 - 6 / n)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    joined = lambda v: "".join(c for f in [*S.ID_FIELDS, "invoice_date", *S.AMOUNT_FIELDS] for c in v[f] if c.isdigit())
    assert digits["b"]["digit_accuracy"] == pytest.approx(1 - edits(joined(mixed), joined(TRUTH)) / n)


def test_fields_are_judged_without_lambdas_over_them(spark):
    plan = score(spark, [("a", "e", None, TRUTH, TRUTH, {})])._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(_o" not in plan and "filter(array(" not in plan


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _some_scores(spark):
    cut = {k: v[:-1] if k in S.ID_FIELDS + S.AMOUNT_FIELDS else v for k, v in TRUTH.items()}
    rows = [("a", "x", None, cut, TRUTH, {}), ("b", "x", None, EQUAL | {"invoice_date": None}, TRUTH, {"vendor_name": "UNREADABLE"}), ("c", "x", "OCR_FAILURE", None, TRUTH, {})]
    rows += [("a", "y", "BLOCKED", None, TRUTH, {}), ("b", "z", None, WRONG, TRUTH | {"allocation_number": None}, {}), ("c", "z", None, TRUTH, None, {})]
    return rows, score(spark, rows)


def test_counters_make_no_outcomes(spark):
    """Counters read the verdicts; the texts of outcomes are not made."""
    _, scores = _some_scores(spark)
    for df in (A.engine_counters(scores), A.presence_totals(scores), A.field_counts(scores), A.miss_rates(scores), K.document_winners(scores)):
        assert "FIELD_SELECTION_ERROR" not in _plan(df)
    long = {(r["document_id"], r["engine_id"], r["field"]): r for r in C.outcomes_long(scores).collect()}
    totals = {r["engine_id"]: r for r in A.presence_totals(scores).collect()}
    for e in ("x", "z"):
        mine = [r for k, r in long.items() if k[1] == e]
        assert totals[e]["total_correct"] == sum(r["correct"] for r in mine) and totals[e]["total_scorable"] == sum(r["scorable"] for r in mine)
    assert totals["y"]["judged"] == 0 and totals["y"]["total_correct"] == 0


def test_labels_are_counted_in_one_pass(spark):
    """no row for each field, and the scores are read once."""
    _, scores = _some_scores(spark)
    labels = A.error_labels(scores)
    assert _plan(labels).count("LogicalRDD") == 1
    want = {}
    for r in C.outcomes_long(scores).where("error_label IS NOT NULL").collect():
        want[r["engine_id"], r["error_label"]] = want.get((r["engine_id"], r["error_label"]), 0) + 1
    assert {(r["engine_id"], r["label"]): r["n"] for r in labels.collect()} == want | {("x", "OCR_FAILURE"): 1}


def test_tallies_give_the_tables_of_reports(spark):
    """all tables of a report come from one aggregation."""
    _, scores = _some_scores(spark)
    t = A.tallies(scores).cache()
    for one, other in ((A.counters_of(t), A.engine_counters(scores)), (A.pivot_of(t), A.field_pivot(scores)), (A.field_counts_of(t), A.field_counts(scores)), (A.labels_of(t), A.error_labels(scores))):
        assert sorted(map(str, one.select(*other.columns).collect())) == sorted(map(str, other.collect()))


def test_bootstrap_weights_without_a_call_for_each(monkeypatch):
    """digests of short keys are made together; all are those of hashlib."""
    import hashlib
    from bisect import bisect_right

    keys, real = ["", "7", "é", "12345678", "k" * 60, *map(str, range(30))], hashlib.md5
    want = [[bisect_right(list(A.POISSON), int(real(f"42:{k}:{r}".encode()).hexdigest()[:13], 16) / (1 << 52)) for r in range(1, 121)] for k in keys]
    seen = []
    monkeypatch.setattr(hashlib, "md5", lambda data: seen.append(data) or real(data))
    assert A.bootstrap_weights(keys, 120, 42).tolist() == want
    assert all(len(data) > 55 for data in seen)


def test_digits_of_rows_that_only_lost_some_are_one_pair(spark):
    """such rows are one pair, not one for each field, and the counts are those of all fields apart."""
    from docscore.operators import align as L
    from docscore.functions import numbers as N

    rows, scores = _some_scores(spark)
    pairs = C.digit_pairs(C.with_fields(spark.createDataFrame(rows, FACTS)))
    assert sorted(r["within"] for r in pairs.collect()) == [False] * 14 + [True]
    long = C.outcomes_long(scores).where("presence = 'PRESENT' AND field <> 'vendor_name'")
    apart = L.digit_confusion(long.select(N.digits_of(F.col("predicted")).alias("predicted"), N.digits_of(F.col("expected")).alias("expected")))
    assert sorted(map(str, L.digit_confusion(pairs, within="within").collect())) == sorted(map(str, apart.collect()))


def test_fields_are_compared_inside_their_row(spark):
    rows = [("d", "e", None, WRONG, TRUTH, {}), ("d", "f", "BLOCKED", None, TRUTH, {}), ("x", "e", None, WRONG, None, None)]
    got = {(r.document_id, r.engine_id, r.field): r for r in C.compare_fields(score(spark, rows)).collect()}
    assert set(got) == {("d", engine, field) for engine in "ef" for field in TRUTH}
    for field in TRUTH:
        done, blocked = got["d", "e", field], got["d", "f", field]
        assert (done.expected, done.predicted, done.presence, done.correct) == (TRUTH[field], WRONG[field], "PRESENT", False)
        assert tuple(blocked)[3:] == (TRUTH[field], None, None, None, None)


def test_field_comparison_shuffles_orders_only(spark):
    from docscore.plans import catalog

    plan = catalog.queries()["field_comparison"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(o_orderkey" in plan
