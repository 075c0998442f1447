import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from docscore.functions import numbers as N
from docscore.functions import regex as R
from docscore.functions import text as X


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_amount_parsers(spark):
    cases = {
        "23,291.70": (23291.70, 23291.70), "23.291.70": (23291.70, None), "4.192.51": (4192.51, None), "193,22": (193.22, 19322.0), "947": (947.0, 947.0), "₪ 193.22": (193.22, 193.22),
        "1,117.46": (1117.46, 1117.46), None: (None, None), "": (None, None), "nu": (None, None), "1.234": (1.234, 1.234), "1,234": (1234.0, 1234.0), "1.234,56": (1234.56, None),
        "1.234.567": (1234567.0, None), "1,234,56": (1234.56, 123456.0), "+5": (5.0, 5.0), "NaN": (None, None), "1e400x": (None, None),
    }
    assert apply(spark, N.parse_tolerant, cases) == [c[0] for c in cases.values()]
    strict = apply(spark, N.parse_strict, cases)
    assert strict[:12] == [c[1] for c in cases.values()][:12]


def test_checksum(spark):
    assert apply(spark, N.checksum_valid, ["123456782", "012345674", "123456789", "12345678", None, "12345678a", ""]) == [True, True, False, False, False, False, False]


def test_dates(spark):
    assert apply(spark, N.norm_date, [" 2026-02-31 ", "2026-2-1", None, "x2026-02-01"]) == ["2026-02-31", None, None, None]
    assert apply(spark, N.date_loose, ["on 3/4/21.", "99-99-2020", "none"]) == ["2021-04-03", "2020-99-99", None]


def test_amount_comparison_tokens(spark):
    a = apply(spark, lambda c: N.norm_amount(c).eqNullSafe(F.lit("228").cast("decimal(38,10)")), ["228.0", "228.00", " 228 ", "2,28", None])
    assert a == [True, True, True, False, False]


def test_wilson_bounds(spark):
    rows = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (5, 10)], "k long, n long")
    low, high = N.wilson(F.col("k"), F.col("n"))
    got = rows.select("k", "n", low.alias("low"), high.alias("high")).collect()
    for r in got:
        if r["n"] == 0:
            assert (r["low"], r["high"]) == (0, 0)
            continue
        z, p, n = N.Z_SCORES[0.95], r["k"] / r["n"], r["n"]
        centre, half = p + z * z / (2 * n), z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
        assert r["low"] == pytest.approx(max(0, (centre - half) / (1 + z * z / n)))
        assert r["high"] == pytest.approx(min(1, (centre + half) / (1 + z * z / n)))


def test_text_functions(spark):
    assert apply(spark, X.norm_vendor, ["  a   b c ", "é", "  ", None]) == ["a b c", "é", None, None]
    assert apply(spark, X.strip_bidi_controls, ["a‏b­c"]) == ["abc"]
    assert apply(spark, X.strip_bidi_marks, ["a‏b­c"]) == ["ab­c"]
    assert apply(spark, X.strip_nikud, ["שָׁלוֹם"]) == ["שלום"]
    assert apply(spark, X.fold_sofit, ["ךםןףץ"]) == ["כמנפצ"]
    assert apply(spark, X.reverse_hebrew_lines, ["שלום  עולם abc\nabc def"]) == ["abc עולם שלום\nabc def"]
    assert apply(spark, X.fix_quoted_abbreviations, ['כ"סה']) == ['סה"כ']
    assert apply(spark, X.slug, ["a b/c.pdf", "__", "..x--"]) == ["a_b_c.pdf", "doc", "x"]
    assert apply(spark, X.html_escape, ["<a&b>"]) == ["&lt;a&amp;b&gt;"]
    assert apply(spark, lambda c: X.truncated(c, 3), ["abcdef", "abc"]) == ["abc… (truncated, 3 more chars)", "abc"]
    assert apply(spark, lambda c: X.top_lines(c, 2), ["\n a \r\n\n b c"]) == [["a", "b"]]
    assert apply(spark, lambda c: X.relative_path(c, "/base"), ["/base/a/b", "/other/a", "x\\y"]) == ["a/b", "/other/a", "x/y"]


def test_label_rewriting_is_idempotent(spark):
    mangled = ['חמ"מ 34.78', "סהכ 100", "לתשחם 5", "חספר הקצאה 123456", "מתיר לפני הנחה 10"]
    once = apply(spark, X.rewrite_labels, mangled)
    assert apply(spark, X.rewrite_labels, once) == once
    assert once[0] == 'מע"מ 34.78' and once[1] == 'סה"כ 100'


def test_match_offsets(spark):
    got = apply(spark, lambda c: R.positions("x", r"\d+"), ["ab12cd345e6", "", "٣x4", None])
    assert got == [[2, 6, 10], [], [0, 2], None]
    for raw in ("é" * 3, "éx"):
        assert apply(spark, X.nfc, [raw]) == [unicodedata.normalize("NFC", raw)]


def test_matches_of_a_long_text(spark):
    """Offsets in a text with very many matches are right, and cost about as much as the text is long."""
    import re
    import time

    texts = ["".join(f"{k * 7 % 1013} x" + "é" * (k % 3) for k in range(n)) for n in (0, 1, 63, 64, 65, 4097, 16_000)] + [None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", R.matches("t", r"\d+").alias("m"), R.positions("t", "x").alias("x"))
    got = {r["i"]: (None if r["m"] is None else [tuple(m) for m in r["m"]], r["x"]) for r in rows.collect()}
    for i, t in enumerate(texts):
        want = (None, None) if t is None else ([(m.start(), m[0]) for m in re.finditer(r"\d+", t)], [m.start() for m in re.finditer("x", t)])
        assert got[i] == want
    one = spark.createDataFrame([(texts[-2],)], "t string").select(F.size(R.matches("t", r"\d+")))
    one.collect()
    began = time.perf_counter()
    assert one.collect()[0][0] == 16_000
    assert time.perf_counter() - began < 3
