"""Text to record: candidates are enumerated, ranked and the best is taken, all inside one row.

Two extractors give the same record. The label-anchored one trusts labels and their
order; the format-first one trusts formats and uses labels as hints of position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscore.functions import numbers as N
from docscore.functions import text as X
from docscore.functions.regex import all_groups, first_group, let, lines, matches, nearest, places, rx, strip

VAT_RATE = 0.18
FIELDS = ["vendor_name", "business_tax_id", "business_tax_id_valid", "invoice_number", "invoice_date", "amount_before_vat", "vat_amount", "total_amount", "allocation_number", "extraction_notes"]

# fixed values: number grammars
NUMBER = r"[-+]?\d{1,3}(?:[, ]\d{3})*(?:\.\d+)?|[-+]?\d+(?:\.\d+)?"
NUMBER_TOLERANT = r"\d{1,3}(?:[,. ]\d{3})+(?:[.,]\d{1,2})?|\d+[.,]\d{1,2}|\d+"
AMOUNT = r"(?<![\d.,])(\d{1,3}(?:[,. ]\d{3})+(?:[.,]\d{1,2})?|\d+[.,]\d{1,2})(?![\d])"
DATE_DMY = r"(?<!\d)(\d{1,2})[-/.\s](\d{1,2})[-/.\s](\d{4})(?!\d)"
DATE_YMD = r"(?<!\d)(\d{4})[-/.\s](\d{1,2})[-/.\s](\d{1,2})(?!\d)"
DATE_ANY = r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}"
PERCENT = r"18(?:[.,]\d{1,2})?\s*%|\(\s*18(?:[.,]\d{1,2})?\s*%?\s*\)"

# fixed values: labels of the label-anchored extractor
ISSUER = r"(?:עוסק\s*מורשה|מספר\s*עוסק)"
PARTY = r"(?:ח\.?\s*פ\.?|ע\.?\s*מ\.?|ת\.?\s*ז\.?/ח\.?\s*פ\.?|ח\.?\s*פ\.?\s*/\s*עוסק\s*מורשה)"
INVOICE_LABEL = r"(?:חשבונית(?:\s*מס)?(?:/קבלה)?(?:\[מקור\])?|מספר\s*חשבונית|חש[\"״']?\s*מס)"
PAYMENT = r"(?:העברה\s*בנקאית|תשלום|מזומן|אשראי|שיק)"
DATE_LABEL = "תאריך"
ALLOCATION = r"(?:מספר\s*הקצאה|הקצאה)"
SUM = r"סה[\"״']?\s*כ"
VAT = r"מע[\"״']?\s*מ"
VAT_LABEL = r"מע[\"״׳']?\s*מ"
COMPANY = "([\u0590-\u05ff][\u0590-\u05ff \"'().\\-]{3,80}?בע[\"״']?\\s*מ)"
LABEL_WORDS = [
    "חשבונית", "תאריך", "לכבוד", "מספר", "ת.ז", "ח.פ", "ע.מ", "עוסק", 'סה"כ', 'מע"מ', "לתשלום", "הנחה", "פירוט", "כמות", "מחיר", "ליחידה",
    "פרטי", "אמצעי", "העברה", "בנקאית", "נייד", "אימייל", "עמוד", "טלפון", "חתימה", "דיגיטלית", "מאובטחת", "ממוחשב", "מסמך", "ידי", "הופק",
    "הקצאה", "אסמכתא", "ערך", "כתובת", "איש קשר", "תאור מוצר", "מוצר",
]
LABEL_LINES = ["כתובת", "לכבוד", "חתימה", "מוצר", "כמות", "פירוט", "מספר", "0", "איש קשר", "קשר איש", "תאור מוצר", "מוצר תאור", "מחיר ליחידה", "ליחידה מחיר"]

# fixed values: label forms whose positions the format-first extractor looks at
HINTS = {
    "addressee": r"[לכ][כרבד][בכ][וויי]?[זד]|לכבוד",
    "dealer": r"[עצ/\\.][ווי]?\s*[.9n]?\s*ס[קכ]\s*[חמהנ][וויר]+[רד]?\s*ש[החה]|עוסק\s*מורשה|עוסק|מורשה",
    "party": r"[חת]\.?[פזפ]?\s*[./]\s*[תח]?\.?[זפ]?|ח\.?פ|ת\.?ז|ע\.?מ",
    "invoice": r"[חת]ש\s*[בכ][ווי][נן]+[יי]?[תח]|חשבונית",
    "date": r"[תח][אה][רד][יי][לך]?|תאריך",
    "source": r"\[?\s*[מח][קכ][ווי][רד]\s*\]?|מקור",
    "to_pay": r"[לכ][תפ][שסע][לחל][וויי]?[מם]|לתשלום|תשלום",
    "vat": r"[מחע][מחע][\"״׳'`]?[מם]|מעמ",
}
# fixed values: what the format-first extractor looks at, with the group that it takes
LOOKED = {
    **{name: (pattern, None) for name, pattern in HINTS.items()}, "digits": (r"\d{3,}", 0), "day_first": (DATE_DMY, 0), "year_first": (DATE_YMD, 0), "amount": (AMOUNT, 1), "percent": (PERCENT, 0),
}
ADDRESSEE_WORDS = ["לכבוד", "לכבוז", "לכבוד:"]

# fixed values: notes of the record
NOTE_ISSUER_INVALID = "business_tax_id (עוסק מורשה) has invalid checksum"
NOTE_BY_CHECKSUM = "business_tax_id matched by checksum, not label"
NOTE_NO_VALID = "business_tax_id has invalid checksum (no valid alternative found)"
NOTE_DATE = "invoice_date matched without payment/תאריך anchor"
NOTE_VAT = "vat_amount via positional 18%% fallback"
NOTE_ARITHMETIC = "amount_before_vat / total via 18% arithmetic fallback"
NOTE_ALLOCATION = "allocation_number via long-digit positional fallback"


def looked(text: str) -> Column:
    """All that the format-first extractor looks at in a text, which is what its steps take."""
    return places(F.col(text), LOOKED)


def digit_runs(text: str, least: int, most: int | None = None) -> Column:
    """``array<struct<pos, value>>`` of maximal digit runs with a length in the range."""
    return _of_length(matches(text, r"\d+"), least, most)


def _of_length(runs: Column, least: int, most: int | None = None) -> Column:
    return F.filter(runs, lambda m: (F.length(m["value"]) >= least) & (F.lit(True) if most is None else F.length(m["value"]) <= most))


def _first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def _tolerance(expected: Column, floor: float) -> Column:
    return F.greatest(F.lit(floor), expected * 0.005)


def _closest(values: Column, expected: Column) -> Column:
    """The first of the values nearest to the expected one, within 1 or half a percent."""
    ranked = F.transform(values, lambda v, i: F.struct(F.abs(v - expected).alias("off"), i.alias("i"), v.alias("v")))
    return F.array_min(F.filter(ranked, lambda r: r["off"] <= _tolerance(expected, 1.0)))["v"]


def _mismatch(before: Column, vat: Column, total: Column) -> Column:
    text = F.concat(F.lit("amount check mismatch: "), _shown(before), F.lit(" + "), _shown(vat), F.lit(" != "), _shown(total))
    return F.when(F.abs(before + vat - total) > 1.0, text)


def _shown(x: Column) -> Column:
    """A double as Python shows it: plain digits up to 16 places."""
    plain = F.regexp_replace(F.format_string("%.10f", x), "0+$", "")
    return F.when(F.abs(x) >= 1e7, F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)).otherwise(x.cast("string"))


def _record(df: DataFrame, source: Column | None) -> DataFrame:
    if source is not None:
        df = df.withColumn("source_file", source)
    return df


def label_anchored(df: DataFrame, text_col: str = "text", reverse_tokens: bool = True, fix_abbreviations: bool = True, tolerant: bool = False, vat_rate: float = VAT_RATE) -> DataFrame:
    """Add the record fields read at labels. ``tolerant`` adds label rewriting, both
    number conventions and positional fallbacks, for recognised text. Null text gives an empty record."""
    clean = X.normalize_for_matching(F.coalesce(F.col(text_col), F.lit("")), reverse_tokens, fix_abbreviations)
    df = df.withColumn("_t", X.rewrite_labels(clean) if tolerant else clean)
    t = F.col("_t")

    def labelled(label: str) -> Column:
        return F.concat(all_groups(t, rf"{label}[^\d]{{0,20}}(\d{{9}})"), all_groups(t, rf"(\d{{9}})[^\d]{{0,20}}{label}"))

    valid = lambda ids: _first(F.filter(ids, N.checksum_valid))
    df = df.withColumns({"_issuer": labelled(ISSUER), "_party": labelled(PARTY), "_any": all_groups(t, r"(?<!\d)(\d{9})(?!\d)")})
    df = df.withColumns({
        "_t1": valid(F.col("_issuer")), "_t2": _first(F.col("_issuer")), "_t3": valid(F.col("_party")), "_t4": valid(F.col("_any")), "_t5": _first(F.col("_party")),
    })
    tiers = [F.col(f"_t{k}") for k in range(1, 6)]
    reached = [tiers[k].isNotNull() & F.coalesce(*tiers[:k]).isNull() if k else tiers[0].isNotNull() for k in range(5)]
    df = df.withColumns({"business_tax_id": F.coalesce(*tiers), "_n2": reached[1], "_n4": reached[3], "_n5": reached[4]})
    df = df.withColumn("business_tax_id_valid", F.when(F.col("business_tax_id").isNotNull(), N.checksum_valid(F.col("business_tax_id"))))
    df = df.withColumn("invoice_number", first_group(t, rf"{INVOICE_LABEL}[^\d]{{0,20}}(\d{{3,}})"))

    anchored = F.coalesce(first_group(t, rf"{PAYMENT}[^\d]{{0,10}}({DATE_ANY})"), first_group(t, rf"{DATE_LABEL}[^\d]{{0,20}}({DATE_ANY})"))
    df = df.withColumns({"_d1": anchored, "_d2": first_group(t, rf"({DATE_ANY})")})
    df = df.withColumn("invoice_date", N.date_loose(F.coalesce("_d1", "_d2")))

    number = NUMBER_TOLERANT if tolerant else NUMBER
    total = F.coalesce(
        first_group(t, rf"{SUM}[^\d\n]{{0,10}}({number})[^\n]*לתשלום"),
        first_group(t, rf"(?:לתשלום\s*{SUM}|{SUM}\s*(?:כולל|אחרי)\s*{VAT}|לתשלום)[^\d\-+\n]{{0,15}}({number})"),
        first_group(t, rf"({number})[^\d\-+\n]{{0,5}}{SUM}\s*(?:אחרי|כולל)\s*{VAT}"),
        first_group(t, rf"(?:אחרי\s*{VAT}|{VAT}\s*אחרי)[^\d\n]*({number})[^\d\n]*{SUM}"),
    )
    vat = F.coalesce(
        first_group(t, rf"{VAT_LABEL}[\s₪$]{{0,5}}({number})"),
        first_group(t, rf"({number})[\s₪$]{{0,5}}{VAT_LABEL}(?!\s*לפני)(?!\s*אחרי)"),
    )
    before = F.coalesce(
        first_group(t, rf"{SUM}(?!\s*לתשלום)(?!\s*(?:כולל|אחרי))[^\d\-+\n]{{0,10}}({number})(?![^\n]*לתשלום)"),
        first_group(t, rf"({number})[^\d\-+\n]{{0,5}}{SUM}\s*לפני\s*{VAT}"),
        first_group(t, rf"(?:לפני\s*{VAT}|{VAT}\s*לפני)[^\d\n]*({number})[^\d\n]*{SUM}"),
    )
    df = df.withColumns({"_total": total, "_vat": vat, "_before": before})
    none = F.lit(None).cast("string")
    positional = first_group(t, rf"({number})\s*\(?\s*18(?:[.,]\d{{1,2}})?\s*%\s*\)?") if tolerant else none
    df = df.withColumn("_vat18", F.when(F.col("_vat").isNull(), positional))
    df = df.withColumn("_read", N.parse_each(F.array("_before", F.coalesce("_vat", "_vat18"), "_total"), tolerant))
    df = df.withColumns({c: F.get("_read", F.lit(k)) for k, c in enumerate(("_b", "_v", "_s"))})
    if tolerant:
        values = F.filter(N.parse_each(all_groups(t, f"({number})")), lambda v: (v > 0) & (v < 10_000_000))
        infer = (F.col("_b").isNull() | F.col("_s").isNull()) & (F.col("_v") > 0) & (F.col("_v") < 1_000_000)
        df = df.withColumn("_values", F.when(infer, values))
        df = df.withColumns({"_near_b": _closest(F.col("_values"), F.col("_v") / vat_rate), "_near_s": _closest(F.col("_values"), F.col("_v") / vat_rate + F.col("_v"))})
    else:
        df = df.withColumns({"_near_b": F.lit(None).cast("double"), "_near_s": F.lit(None).cast("double")})
    df = df.withColumns({"amount_before_vat": F.coalesce("_b", "_near_b"), "vat_amount": F.col("_v"), "total_amount": F.coalesce("_s", "_near_s")})

    df = df.withColumn("_alloc", first_group(t, rf"{ALLOCATION}[^\d]{{0,20}}(\d{{6,}})"))
    df = df.withColumn("_long", F.when(F.col("_alloc").isNull(), first_group(t, r"\b(\d{15,})\b")) if tolerant else none)
    df = df.withColumn("allocation_number", F.coalesce("_alloc", "_long"))

    company = first_group(t, COMPANY)
    line_ok = lambda s: (
        ~s.isin("", *LABEL_LINES) & s.rlike(X.HEBREW) & ~s.rlike(rx(r"^[\d\s./,\-:]+\z")) & ~F.exists(F.array(*map(F.lit, LABEL_WORDS)), lambda w: F.contains(s, w))
        & ~F.contains(s, F.lit("@")) & ~F.contains(F.lower(s), F.lit("http")) & (F.length(s) >= 3)
    )
    by_line = _first(F.filter(F.transform(lines(t), strip), line_ok))
    df = df.withColumn("vendor_name", F.coalesce(company, by_line))
    inferred = F.col("_near_b").isNotNull() | F.col("_near_s").isNotNull()
    notes = [
        (F.col("_n2"), NOTE_ISSUER_INVALID), (F.col("_n4"), NOTE_BY_CHECKSUM), (F.col("_n5"), NOTE_NO_VALID), (F.col("_d1").isNull() & F.col("_d2").isNotNull(), NOTE_DATE),
        (F.col("_vat18").isNotNull(), NOTE_VAT), (inferred, NOTE_ARITHMETIC),
    ]
    said = [F.when(when, F.lit(note)) for when, note in notes]
    said.append(_mismatch(F.col("amount_before_vat"), F.col("vat_amount"), F.col("total_amount")))
    said.append(F.when(F.col("_long").isNotNull(), F.lit(NOTE_ALLOCATION)))
    df = df.withColumn("extraction_notes", F.array_compact(F.array(*said)))
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def nearest_id(found: str) -> Column:
    """The nine-digit run that ranks first: valid, near the addressee, near a tax label, early."""
    h = F.col(found)
    tax = F.concat(h["dealer"], h["party"])
    ranked = F.transform(
        _of_length(h["digits"], 9, 9),
        lambda m: F.struct((~N.checksum_valid(m["value"])).alias("invalid"), nearest(h["addressee"], m["pos"]).alias("a"), nearest(tax, m["pos"]).alias("b"), m["pos"].alias("pos"), m["value"].alias("value")),
    )
    return F.array_min(ranked)


def windowed_number(text: str, found: str) -> Column:
    """A run of 3 to 7 digits within 60 characters of an invoice label, else the first not beside a dot, slash or hyphen."""
    by_label = F.transform(F.col(found)["invoice"], lambda p: F.regexp_extract(F.substring(F.col(text), p + 1, F.lit(60)), rx(r"(?<!\d)(\d{3,7})(?!\d)"), 1))
    alone = F.filter(_of_length(F.col(found)["digits"], 3, 7), lambda m: ~F.concat(
        F.substring(F.col(text), F.greatest(m["pos"] - 1, F.lit(1)), F.least(m["pos"], F.lit(2))), F.substring(F.col(text), m["pos"] + F.length(m["value"]) + 1, F.lit(2))
    ).rlike("[./-]"))
    return F.coalesce(_first(F.filter(by_label, lambda v: v != "")), _first(alone)["value"])


def nearest_date(found: str) -> Column:
    """The checked date nearest to a source mark, then to a date label, then the first; day-first forms rank before year-first ones."""
    h = F.col(found)

    def ranked(name: str, kind: int, order: tuple[int, int, int]) -> Column:
        # a date has three runs of digits with one character between two of them
        parts = F.transform(h[name], lambda m: F.struct(m["pos"].alias("pos"), F.split(m["value"], r"(?U)\D", -1).alias("p")))
        return F.transform(
            parts, lambda m: F.struct(nearest(h["source"], m["pos"]).alias("a"), nearest(h["date"], m["pos"]).alias("b"), m["pos"].alias("pos"), F.lit(kind).alias("kind"), N.date_checked(*(m["p"][k] for k in order)).alias("iso")),
        )

    every = F.concat(ranked("day_first", 0, (0, 1, 2)), ranked("year_first", 1, (2, 1, 0)))
    return F.array_min(F.filter(every, lambda r: r["iso"].isNotNull()))["iso"]


def amount_candidates(found: str) -> Column:
    """``array<struct<pos, v>>`` of amounts above 0 and below ten million."""
    amounts = F.col(found)["amount"]
    parsed = F.arrays_zip(F.transform(amounts, lambda m: m["pos"]).alias("pos"), N.parse_each(F.transform(amounts, lambda m: m["value"])).alias("v"))
    return F.filter(parsed, lambda a: (a["v"] > 0) & (a["v"] < 10_000_000))


def vat_pair(amounts: Column, percent_at: Column, vat_rate: float = VAT_RATE) -> Column:
    """The pair (a, b) with b near a with tax added that stands closest together: ``struct<score, i, j, a, b>``."""
    far = lambda p: F.coalesce(F.abs(p - percent_at), F.lit(0))
    pairs = F.flatten(F.transform(amounts, lambda a, i: F.filter(
        F.transform(amounts, lambda b, j: F.when(
            (i != j) & (b["v"] > a["v"]) & (F.abs(b["v"] - a["v"] * (1 + vat_rate)) <= _tolerance(a["v"] * (1 + vat_rate), 0.5)),
            F.struct((F.abs(a["pos"] - b["pos"]) + 0.1 * F.least(far(a["pos"]), far(b["pos"]))).alias("score"), i.alias("i"), j.alias("j"), a["v"].alias("a"), b["v"].alias("b")),
        )), lambda p: p.isNotNull())))
    return F.array_min(pairs)


def format_first(df: DataFrame, text_col: str = "text", vat_rate: float = VAT_RATE) -> DataFrame:
    """Add the record fields found by their formats, with labels as hints. Null text gives an empty record."""
    df = df.withColumn("_t", X.preprocess(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumn("_found", looked("_t"))
    t, found = F.col("_t"), F.col("_found")
    df = df.withColumn("_id", nearest_id("_found"))
    df = df.withColumns({
        "business_tax_id": F.col("_id.value"), "business_tax_id_valid": ~F.col("_id.invalid"), "invoice_number": windowed_number("_t", "_found"),
        "invoice_date": nearest_date("_found"), "allocation_number": _first(_of_length(found["digits"], 15))["value"],
    })

    def phrase(p: Column) -> Column:
        window = F.substring(t, p + 1, F.lit(150))
        window = F.when(F.contains(F.left(window, F.lit(30)), F.lit(":")), F.regexp_replace(window, r"^[^:]*:", "")).otherwise(window)
        stripped = F.transform(F.split(window, r"[\n\r]+", -1), lambda s: F.regexp_replace(s, r"^[ .,;:|\[\]()]+|[ .,;:|\[\]()]+$", ""))
        good = F.filter(stripped, lambda s: (s != "") & ~s.rlike(rx(r"\d")) & s.rlike("[א-ת]{2,}"))
        names = F.transform(good, lambda s: strip(F.regexp_extract(s, rx("([א-ת][א-ת\\s\"'״׳.]*[א-ת])"), 1)))
        return _first(F.filter(names, lambda s: (F.length(s) >= 3) & ~s.isin(*ADDRESSEE_WORDS)))

    df = df.withColumn("vendor_name", _first(F.filter(F.transform(found["addressee"], phrase), lambda s: s.isNotNull())))
    df = df.withColumns({"_amounts": amount_candidates("_found"), "_pct": _first(found["percent"])})
    amounts, start = F.col("_amounts"), F.col("_pct.pos")
    end = start + F.length("_pct.value")
    df = df.withColumn("_pair", vat_pair(amounts, start, vat_rate))

    def near(at: Column, low: int, high: int) -> Column:
        inside = F.filter(amounts, lambda a: a["pos"].between(at - low, at + high) & (a["pos"] >= 0))
        return F.array_min(F.transform(inside, lambda a, i: F.struct(F.abs(a["pos"] - at).alias("d"), i.alias("i"), a["v"].alias("v"))))["v"]

    gap = lambda a: F.least(F.abs(a["pos"] - start), F.abs(a["pos"] - end))
    outside = F.filter(amounts, lambda a: ~((a["pos"] >= start) & (a["pos"] < end)))
    beside = F.array_min(F.transform(outside, lambda a, i: F.struct(gap(a).alias("d"), i.alias("i"), a["v"].alias("v"))))
    by_label = _first(F.filter(F.transform(found["vat"], lambda p: near(p, 30, 30)), lambda v: v.isNotNull()))
    df = df.withColumns({"_beside": F.when(start.isNotNull(), beside), "_labelled": by_label})
    df = df.withColumn("vat_amount", F.when(F.size("_amounts") > 0, F.coalesce(F.round(F.col("_pair.b") - F.col("_pair.a"), 2), F.when(F.col("_beside.d") <= 60, F.col("_beside.v")), F.col("_labelled"))))
    v, values = F.col("vat_amount"), F.transform(amounts, lambda a: a["v"])
    real = (v > 0) & (v < 1_000_000)
    df = df.withColumns({
        "_b": F.coalesce(F.col("_pair.a"), F.when(real, _closest(values, v / vat_rate))),
        "_s": F.coalesce(F.col("_pair.b"), F.when(real, _closest(values, v / vat_rate + v))),
    })
    to_pay = _first(F.filter(F.transform(found["to_pay"], lambda p: near(p, 30, 60)), lambda x: x.isNotNull()))
    df = df.withColumn("total_amount", F.coalesce(F.col("_s"), to_pay))
    rest = F.col("total_amount") - v
    derived = F.when(rest > 0, _first(F.filter(values, lambda x: F.abs(x - rest) <= _tolerance(rest, 1.0))))
    df = df.withColumn("amount_before_vat", F.coalesce(F.col("_b"), derived))
    said = [
        F.when(F.col("business_tax_id").isNotNull() & ~F.col("business_tax_id_valid"), F.lit(NOTE_ISSUER_INVALID)),
        _mismatch(F.col("amount_before_vat"), v, F.col("total_amount")),
    ]
    df = df.withColumn("extraction_notes", F.array_compact(F.array(*said)))
    return df.drop(*[c for c in df.columns if c.startswith("_")])


EXTRACTORS = {"label_anchored": label_anchored, "format_first": format_first}


def extract(df: DataFrame, how: str = "format_first", text_col: str = "text", **options) -> DataFrame:
    """Recognised text goes to the format-first extractor unless told otherwise."""
    return EXTRACTORS[how](df, text_col, **options)
