"""Queries on made records: extraction, validation, adapters, Hebrew text, values and comparisons."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscore import schema as S
from docscore.functions import numbers as N
from docscore.functions import text as X
from docscore.operators import aggregate as A
from docscore.operators import adapters
from docscore.operators import align as L
from docscore.operators import extract as E
from docscore.operators import inspect as I
from docscore.operators import isolate as Q
from docscore.operators import regions as G
from docscore.operators import score as C
from docscore.operators import seeding as D
from docscore.operators import validate as V
from docscore.plans import facts as P
from docscore.plans import invoices as M
from docscore.plans.catalog import _CHECKSUM
from docscore.plans.registry import register
from docscore.sources import scratch

# --- extraction ----------------------------------------------------------------

_VALID = _CHECKSUM.format(x="tax")
_MADE = P.SQL + f""", made AS (SELECT *, {_VALID} AS valid FROM (SELECT *, o_orderkey AS key, lpad(CAST(o_custkey * 7919 AS VARCHAR), 9, '0') AS tax FROM base))
SELECT key, {{vendor}} AS vendor_name, tax AS business_tax_id, valid AS business_tax_id_valid, lpad(CAST(key AS VARCHAR), 7, '0') AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date,
  before / 100.0::DOUBLE AS amount_before_vat, vat / 100.0::DOUBLE AS vat_amount, total / 100.0::DOUBLE AS total_amount,
  CASE WHEN key % 3 <> 0 THEN lpad(CAST(key AS VARCHAR), 12, '0') || lpad(CAST(o_custkey AS VARCHAR), 12, '0') END AS allocation_number, {{notes}} AS extraction_notes FROM made"""
_LABEL_NOTES = f"""concat_ws('; ', CASE WHEN NOT valid AND key % 4 < 2 THEN '{E.NOTE_ISSUER_INVALID}' END, CASE WHEN NOT valid AND key % 4 >= 2 THEN '{E.NOTE_NO_VALID}' END, CASE WHEN key % 3 = 2 THEN '{E.NOTE_DATE}' END)"""


def _extracted(df: DataFrame) -> DataFrame:
    return df.select("key", *E.FIELDS[:-1], F.array_join("extraction_notes", "; ").alias("extraction_notes"))


@register(_MADE.format(vendor=M.VENDOR_SQL, notes=f"CASE WHEN valid THEN '' ELSE '{E.NOTE_ISSUER_INVALID}' END"))
def extract_format_first(spark: SparkSession, sf: str) -> DataFrame:
    """The record of every made invoice, found by formats with labels as hints, against the true one."""
    return _extracted(E.extract(M.texts(spark, sf), "format_first", "format_text"))


@register(_MADE.format(vendor=M.VENDOR_SQL + """ || ' בע"מ'""", notes=_LABEL_NOTES))
def extract_label_anchored(spark: SparkSession, sf: str) -> DataFrame:
    """The record read at labels of recognised text, in three number forms."""
    return _extracted(E.extract(M.texts(spark, sf), "label_anchored", "label_text", tolerant=True, reverse_tokens=False, fix_abbreviations=False))


@register(_MADE.format(vendor=M.VENDOR_SQL + """ || ' בע"מ'""", notes=_LABEL_NOTES))
def extract_text_layer(spark: SparkSession, sf: str) -> DataFrame:
    """The record read at labels of a clean text layer, whose lines come with their words in reverse."""
    t = M.texts(spark, sf).withColumn("layer", X.reverse_hebrew_lines(F.col("strict_text")))
    return _extracted(E.extract(t, "label_anchored", "layer", tolerant=False))


@register(P.SQL + f"""SELECT key, before / 100.0::DOUBLE AS amount_before_vat, vat / 100.0::DOUBLE AS vat_amount, shown / 100.0::DOUBLE AS total_amount,
  concat_ws('; ', CASE WHEN key % 4 = 2 THEN '{E.NOTE_VAT}' END, CASE WHEN key % 4 = 1 THEN '{E.NOTE_ARITHMETIC}' END,
    CASE WHEN key % 4 = 0 THEN 'amount check mismatch: ' || CAST(before / 100.0::DOUBLE AS VARCHAR) || ' + ' || CAST(vat / 100.0::DOUBLE AS VARCHAR) || ' != ' || CAST(shown / 100.0::DOUBLE AS VARCHAR) END) AS extraction_notes
  FROM (SELECT *, o_orderkey AS key, total + CASE WHEN o_orderkey % 4 = 0 THEN 5000 ELSE 0 END AS shown FROM base)""")
def extract_odd_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts that do not add up are reported as they stand, amounts without their label are found by arithmetic or percentage."""
    out = E.extract(M.odd_texts(spark, sf), "label_anchored", "text", tolerant=True, reverse_tokens=False, fix_abbreviations=False)
    return out.select("key", *S.AMOUNT_FIELDS, F.array_join("extraction_notes", "; ").alias("extraction_notes"))


@register(P.SQL + f""", made AS (SELECT o_orderkey AS key, o_custkey, lpad(CAST(o_custkey * 7919 AS VARCHAR), 9, '0') AS tax, strftime(o_orderdate, '%Y-%m-%d') AS day, total, before, vat FROM base)
SELECT key, tax || ':' || CAST({_VALID} AS VARCHAR) AS nearest_id, lpad(CAST(key AS VARCHAR), 7, '0') AS windowed_number, day AS nearest_date, CAST(3 AS BIGINT) + CASE WHEN key % 7 = 0 THEN 0 ELSE 1 END AS n_amounts,
  before / 100.0::DOUBLE AS pair_low, total / 100.0::DOUBLE AS pair_high FROM made""")
def ranked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """What the format-first extractor ranks first among decoys that stand further from the labels."""
    t = P.truths(spark, sf).repartition("key")  # a few bytes a row, and much work
    far = F.lit(" ".join(["x"] * 60))
    text = F.concat_ws(
        "\n", F.lit("01/02/2003"), far, F.concat(F.lit("לכבוד "), "business_tax_id"), F.concat(F.lit("חשבונית "), "invoice_number"), F.concat(F.lit("תאריך "), "invoice_date"),
        F.when(F.col("key") % 7 != 0, F.lit("3.33")), "amount_before_vat", "vat_amount", "total_amount", far, F.lit("123456789 04.05.2006"),
    )
    d = t.select("key", text.alias("t")).withColumn("f", E.looked("t"))
    found = E.nearest_id("f")
    amounts = F.filter(E.amount_candidates("f"), lambda a: (a["v"] != 4.05))
    d = d.withColumns({"i": found, "a": amounts}).withColumn("p", E.vat_pair(F.col("a"), F.lit(None).cast("int")))
    return d.select(
        "key", F.concat("i.value", F.lit(":"), (~F.col("i.invalid")).cast("string")).alias("nearest_id"), E.windowed_number("t", "f").alias("windowed_number"), E.nearest_date("f").alias("nearest_date"),
        F.size("a").cast("long").alias("n_amounts"), F.col("p.a").alias("pair_low"), F.col("p.b").alias("pair_high"),
    )


# --- Hebrew text -----------------------------------------------------------------

_HEBREW = "concat_ws('', chr(8207), 'שָׁלוֹם ', CAST(c_custkey AS VARCHAR), ' כ\"סה ', chr(8206), 'ארץ ', chr(173), 'מ\"בע', chr(10), 'plain line ', c_name, chr(10), '  עסק  חמורש  ')"


@register(rf"""SELECT c_custkey AS custkey, md5(regexp_replace(t, '\p{{Cf}}', '', 'g')) AS no_controls, md5(regexp_replace(t, '[\x{{200e}}\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2066}}-\x{{2069}}]', '', 'g')) AS no_marks,
  md5(regexp_replace(t, '[\x{{0591}}-\x{{05c7}}]', '', 'g')) AS no_nikud, md5(translate(t, '{X.FINAL}', '{X.MEDIAL}')) AS medial, md5(replace(replace(t, 'כ"סה', 'סה"כ'), 'מ"בע', 'בע"מ')) AS abbreviations,
  md5(array_to_string(list_transform(string_split(t, chr(10)), lambda l: CASE WHEN regexp_matches(l, '[\x{{0590}}-\x{{05ff}}]') THEN array_to_string(list_reverse(list_filter(string_split_regex(l, '\s+'), lambda w: w <> '')), ' ') ELSE l END), chr(10))) AS reversed,
  md5(regexp_replace(regexp_replace(nfc_normalize(regexp_replace(regexp_replace(t, '[\x{{200e}}\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2066}}-\x{{2069}}]', '', 'g'), '[\x{{0591}}-\x{{05c7}}]', '', 'g')), '[ \t]+', ' ', 'g'), '', '', 'g')) AS prepared
  FROM (SELECT c_custkey, {_HEBREW} AS t FROM customer)""")
def hebrew_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Every step of the Hebrew normalisation by itself."""
    text = F.expr(_HEBREW.replace("chr(8207)", "'‏'").replace("chr(8206)", "'‎'").replace("chr(173)", "'­'").replace("chr(10)", "'\\n'").replace("VARCHAR", "STRING"))
    t = F.col("t")
    md5 = lambda c: F.md5(F.encode(c, "UTF-8"))
    return P.read(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), text.alias("t")).select(
        "custkey", md5(X.strip_bidi_controls(t)).alias("no_controls"), md5(X.strip_bidi_marks(t)).alias("no_marks"), md5(X.strip_nikud(t)).alias("no_nikud"), md5(X.fold_sofit(t)).alias("medial"),
        md5(X.fix_quoted_abbreviations(t)).alias("abbreviations"), md5(X.reverse_hebrew_lines(t)).alias("reversed"), md5(X.preprocess(t)).alias("prepared"),
    )


_MANGLED = {"pוסק חמורש": None, "/סק מורש": None, "מעמ": None, "לתשלום": "לתשלום", 'מע"מ': 'מע"מ', "סהכ": 'סה"כ', "לתשחום": "לתשלום", "plain": "plain"}
_LABELS = [(k, v) for k, v in _MANGLED.items() if v]


@register("SELECT c_custkey AS custkey, CAST(c_custkey AS VARCHAR) || ' ' || CASE c_custkey % " + str(len(_LABELS)) + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, v) in enumerate(_LABELS)) + " END || ' 12.50' AS rewritten FROM customer")
def label_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """Mangled labels come out in their canonical form; numbers beside them stay."""
    k = F.col("c_custkey")
    raw = F.element_at(F.array(*[F.lit(x) for x, _ in _LABELS]), (k % len(_LABELS) + 1).cast("int"))
    return P.read(spark, sf, "customer").select(k.alias("custkey"), X.rewrite_labels(F.concat_ws(" ", k.cast("string"), raw, F.lit("12.50"))).alias("rewritten"))


@register("""SELECT doc_id, CASE WHEN n % 3 = 0 THEN 'null' WHEN n % 3 = 1 THEN 'true' ELSE '["' || lang || '"]' END AS shown, replace(source, 'e', '""') AS quoted, CAST(n AS VARCHAR) AS safe
  FROM (SELECT doc_id, lang, source, doc_id % 1000 AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)""")
def value_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Values as reports show them: null and booleans by name, lists as JSON, quotes doubled."""
    d = P.read(spark, sf, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    n = F.col("doc_id") % 1000
    text = F.when(n % 3 == 0, X.shown(F.lit(None).cast("string"))).when(n % 3 == 1, X.shown(F.lit(True))).otherwise(X.shown(F.array("lang"), "array<string>"))
    return d.select("doc_id", text.alias("shown"), X.csv_quote(F.replace("source", F.lit("e"), F.lit('"'))).alias("quoted"), X.json_safe(n).alias("safe"))


# --- validation ------------------------------------------------------------------

#: What is wrong with the manifest line of an order, by its key modulo 14.
_GOOD = 4


def _manifest_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``line, raw``: a stored manifest line for every order, most of them broken in a way that depends on the key."""
    t = P.truths(spark, sf)
    k = F.col("key") % 14
    record = {
        "source_file": F.when(k == 12, "other.png").otherwise(F.concat("document_id", F.lit(".png"))), "vendor_name": F.col("vendor_name"), "business_tax_id": F.col("business_tax_id"), "business_tax_id_valid": F.lit(True),
        "invoice_number": F.col("invoice_number"), "invoice_date": F.col("invoice_date"), "amount_before_vat": F.col("amount_before_vat").cast("double"), "vat_amount": F.col("vat_amount").cast("double"),
        "total_amount": F.col("total_amount").cast("double"), "allocation_number": F.col("allocation_number"), "extraction_notes": F.array().cast("array<string>"),
    }
    t = t.withColumn("truth", F.to_json(F.struct(*[v.alias(n) for n, v in record.items()]), {"ignoreNullFields": "false"}))
    truth = F.col("truth")
    swap = lambda at, old, new: F.when(k == at, F.regexp_replace(truth, old, new))
    swapped = F.coalesce(
        swap(4, r"^\{", '{"colour":1,'), swap(5, r',"total_amount":[^,]*', ""), swap(6, r'"vendor_name":"[^"]*"', '"vendor_name":5'), swap(7, r'"vat_amount":[^,]*', '"vat_amount":"x"'),
        swap(8, r'"extraction_notes":\[\]', '"extraction_notes":null'), swap(11, r'"business_tax_id_valid":true', '"business_tax_id_valid":"yes"'), swap(13, r'"extraction_notes":\[\]', '"extraction_notes":[1]'), truth,
    )
    entry = F.concat(
        F.lit('{"document_id":"'), "document_id", F.lit('","source_file":"'), "document_id", F.lit('.png",'), F.when(k == 10, "").otherwise('"split":"dev",'), F.lit('"language":"he","pages":["p.png"],"ground_truth":'), "swapped",
        F.when(k == 9, ',"annotation":{"field_presence":{"vat_amount":"MAYBE","colour":"PRESENT"}}').otherwise(""), F.lit("}"),
    )
    raw = F.when(F.col("key") % 101 == 0, F.lit("# a comment")).when(F.col("key") % 103 == 0, F.lit("  ")).when(F.col("key") % 107 == 0, F.lit("{oops")).otherwise(entry)
    path = scratch.folder(spark, "manifest-lines")
    t.withColumn("swapped", swapped).select(F.col("key").alias("line"), raw.alias("raw")).write.parquet(path)
    return spark.read.schema("line long, raw string").parquet(path)


def _messages_sql() -> str:
    values = ", ".join(f"''{v}''" for v in sorted(S.PRESENCE_VALUES))
    said = {
        4: ["d || ': ground_truth has extra keys: [''colour'']'"], 5: ["d || ': ground_truth missing keys: [''total_amount'']'"], 6: ["d || ': ''vendor_name'' must be string or null, got int'"],
        7: ["d || ': ''vat_amount'' must be number or null, got str'"], 8: ["d || ': extraction_notes must be a list (empty when no notes), not null'"],
        9: ["d || ': annotation.field_presence has unknown field ''colour'''", f"d || ': annotation.field_presence[''vat_amount''] must be one of [{values}]'"],
        10: ["d || ': missing required manifest key ''split'''"], 11: ["d || ': business_tax_id_valid must be bool or null, got str'"],
        12: ["d || ': ground_truth.source_file (''other.png'') != manifest source_file (''' || d || '.png'')'"], 13: ["d || ': extraction_notes must be list[str]'"],
    }
    parts = [f"SELECT key AS line, d AS document_id, {m} AS message FROM lines WHERE kind = 'entry' AND key % 14 = {k}" for k, ms in said.items() for m in ms]
    parts.append("SELECT key, '<line ' || d || '>', 'line ' || d || ': invalid JSON' FROM lines WHERE kind = 'broken'")
    return " UNION ALL ".join(parts)


_LINES = "WITH lines AS (SELECT o_orderkey AS key, CAST(o_orderkey AS VARCHAR) AS d, CASE WHEN o_orderkey % 101 = 0 OR o_orderkey % 103 = 0 THEN 'skipped' WHEN o_orderkey % 107 = 0 THEN 'broken' ELSE 'entry' END AS kind FROM orders) "


@register(_LINES + _messages_sql())
def manifest_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Every violation of the manifest's rules, a row each: required keys, record shape, annotation, matching source."""
    return V.manifest_violations(_manifest_lines(spark, sf))


@register(_LINES + """SELECT key AS line, d AS document_id, d || ': page path does not exist: p/' || d || '.png' AS message FROM lines WHERE kind = 'entry' AND key % 3 = 0""")
def missing_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Entries whose page files are not in the list of files that exist: two of three pages do."""
    lines = _manifest_lines(spark, sf).withColumn("raw", F.replace("raw", F.lit('"pages":["p.png"]'), F.concat(F.lit('"pages":["p/'), F.col("line").cast("string"), F.lit('.png"]'))))
    files = P.read(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.concat(F.lit("p/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("path"))
    return V.manifest_violations(lines, files).where(F.contains("message", F.lit("page path")))


@register(_LINES + f""", bad AS ({_messages_sql()}) SELECT (SELECT count(*) FROM lines WHERE kind <> 'skipped') AS total, (SELECT count(*) FROM lines WHERE kind <> 'skipped' AND key NOT IN (SELECT line FROM bad)) AS ok,
  (SELECT count(*) FROM lines WHERE kind = 'entry') AS with_truth, (SELECT count(*) FROM bad) AS errors""")
def validation_totals(spark: SparkSession, sf: str) -> DataFrame:
    lines = _manifest_lines(spark, sf)
    raw = F.trim("raw")
    entries = lines.where((raw != "") & ~F.startswith(raw, F.lit("#"))).select("line", F.get_json_object("raw", "$.ground_truth").isNotNull().alias("has_truth"))
    return V.validation_totals(entries, V.manifest_violations(lines))


# --- adapters ----------------------------------------------------------------------


@register("""SELECT o_orderkey AS key, CAST(o_orderkey AS VARCHAR) AS text, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 4 END AS corners, CASE o_orderkey % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 5.0::DOUBLE END AS first_x,
  round(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (0.5 + o_orderkey % 4 * 0.125) END, 6)::DOUBLE AS confidence FROM orders""")
def line_adapter(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a recogniser: polygon from boundary, box or cut points; confidence is the mean of its characters."""
    k = F.col("o_orderkey")
    none = lambda t: F.lit(None).cast(t)
    pair = lambda a, b: F.array(F.lit(float(a)), F.lit(float(b)))
    rows = P.read(spark, sf, "orders").select(
        k.cast("string").alias("document_id"), F.lit(0).alias("page"), F.lit(0).alias("i"), k.cast("string").alias("text"),
        F.when(k % 5 == 0, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.25), none("double"), 0.75 + (k % 4) * 0.25)).alias("confidences"),
        F.when(k % 3 == 0, F.array(pair(0, 0), pair(1, 1))).alias("boundary"), F.when(k % 3 == 1, F.array(*map(F.lit, ["1", "2", "3", "4"]))).when(k % 3 == 2, F.array(*map(F.lit, ["1", "x"]))).alias("bbox"),
        F.array(pair(9, 1), pair(5, 7)).alias("cuts"),
    )
    out = G.lines_from_recognizer(rows)
    return out.select(F.col("document_id").cast("long").alias("key"), "text", F.size("polygon").alias("corners"), F.col("polygon")[0]["x"].alias("first_x"), F.round("confidence", 6).alias("confidence"))


@register("""SELECT key, i AS reading_order, CASE WHEN e IS NULL AND i IS NOT NULL AND i <> 1 THEN 'w' || CAST(i AS VARCHAR) ELSE '' END AS text, CASE WHEN e IS NULL AND i IS NOT NULL THEN CASE i WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN NULL ELSE 0.25::DOUBLE END END AS confidence, e AS error_label
  FROM (SELECT o_orderkey AS key, CASE o_orderkey % 5 WHEN 1 THEN 'REQUEST_EMPTY' WHEN 2 THEN 'BLOCKED' WHEN 3 THEN 'TIMEOUT' END AS e, unnest(CASE WHEN o_orderkey % 5 IN (0, 4) THEN [0, 1, 2] ELSE [NULL] END)::INTEGER AS i FROM orders)""")
def worker_adapter(spark: SparkSession, sf: str) -> DataFrame:
    """Worker responses: regions with defaults and clamped confidences, or the label of what went wrong."""
    k = F.col("o_orderkey")
    full = '{"pages":[{"regions":[{"text":"w0","confidence":"1.7","polygon":[[0,1],[2,3]]},{"confidence":"-1"},{"text":"w2","confidence":0.25}]}]}'
    body = F.when(k % 5 == 1, '{"pages":[]}').when(k % 5 == 2, '{"pages":[],"error":{"label":"X","message":"License invalid"}}').when(k % 5 == 3, '{"error":{"label":"TIMEOUT","message":"late"}}').otherwise(full)
    out = G.regions_of("ironocr", P.read(spark, sf, "orders").select(k.cast("string").alias("document_id"), body.alias("response")))
    return out.select(F.col("document_id").cast("long").alias("key"), "reading_order", "text", "confidence", "error_label")


@register("""SELECT key, 'a' || CAST(key AS VARCHAR) AS text, 0 AS reading_order, 0.5::DOUBLE AS confidence, 3.0::DOUBLE AS first_x, 0 AS page FROM (SELECT o_orderkey AS key FROM orders)
  UNION ALL SELECT o_orderkey, 'bc', 1, NULL, 0.0::DOUBLE, 0 FROM orders UNION ALL SELECT o_orderkey, 'z', 2, 1.0::DOUBLE, 0.25::DOUBLE, 1 FROM orders""")
def cloud_adapter(spark: SparkSession, sf: str) -> DataFrame:
    """Nested cloud responses to words: symbols joined, blank words gone, vertices or normalised vertices, one order over all pages."""
    k = F.col("o_orderkey")
    body = F.concat(
        F.lit('{"pages":[{"blocks":[{"paragraphs":[{"words":[{"symbols":[{"text":"a"},{"text":"'), k.cast("string"),
        F.lit('"}],"confidence":0.5,"boundingBox":{"vertices":[{"x":3,"y":4}]}},{"symbols":[{"text":" "}]}]}]},{"paragraphs":[{"words":[{"symbols":[{"text":"b"},{"text":"c"}],"boundingBox":{"vertices":[{"y":1}]}}]}]}]},'
              '{"blocks":[{"paragraphs":[{"words":[{"symbols":[{"text":"z"}],"confidence":1.5,"boundingBox":{"vertices":[],"normalizedVertices":[{"x":0.25}]}}]}]}]}]}'),
    )
    out = G.regions_of("cloud", P.read(spark, sf, "orders").select(k.cast("string").alias("document_id"), body.alias("response")))
    return out.select(F.col("document_id").cast("long").alias("key"), "text", "reading_order", "confidence", F.col("polygon")[0]["x"].alias("first_x"), "page")


def _boxes(response: str):
    """An engine that answers with lines ``left,top,width,height text``."""
    if response.startswith("no licence"):
        raise RuntimeError(f"BLOCKED: {response}")
    for row in response.split("\n"):
        place, _, text = row.partition(" ")
        x, y, w, h = map(float, place.split(","))
        yield {"text": text, "polygon": [(x, y), (x + w, y), (x + w, y + h), (x, y + h)], "granularity": "line"}


@register("""SELECT o_orderkey AS key, i AS reading_order, CASE WHEN e IS NULL THEN CASE i WHEN 0 THEN 'order' ELSE CAST(o_orderkey AS VARCHAR) END END AS text, CASE WHEN e IS NULL THEN i * 10 + 4.5::DOUBLE END AS lower, e AS error_label FROM (
  SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN 'OCR_FAILURE' WHEN 2 THEN 'BLOCKED' END AS e, unnest(CASE WHEN o_orderkey % 7 = 3 THEN [] WHEN o_orderkey % 7 IN (1, 2) THEN [NULL] ELSE [0, 1] END)::INTEGER AS i FROM orders)""")
def lateral_regions(spark: SparkSession, sf: str) -> DataFrame:
    """An adapter of one's own, registered as a table function and used from SQL."""
    adapters.register(spark, "boxes_of", _boxes)
    k = F.col("o_orderkey")
    body = F.when(k % 7 == 1, "1,2 broken").when(k % 7 == 2, "no licence here").when(k % 7 != 3, F.concat(F.lit("0,0,9,4.5 order\n0,10,9,4.5 "), k.cast("string")))
    # a response is a few bytes but parsing it is not: deal responses over all cores
    out = adapters.regions_by(spark, "boxes_of", P.read(spark, sf, "orders").select(k.alias("key"), body.alias("response")).repartition("key"))
    return out.select("key", "reading_order", "text", F.array_max(F.transform("polygon", lambda p: p["y"])).alias("lower"), "error_label")


@register("SELECT c_custkey AS custkey, CASE WHEN c_custkey % 3 = 0 THEN 'L1' ELSE 'w|x' END AS text FROM customer")
def words_or_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Words where any has text, else the lines."""
    k = F.col("c_custkey")
    cell = lambda t: F.struct(F.lit(t).alias("text"))
    words = F.when(k % 3 == 0, F.array(cell(" "), cell(""))).otherwise(F.array(cell("w"), cell("  "), cell("x")))
    kept = G.words_or_lines(words, F.array(cell("L1"), cell(None)))
    return P.read(spark, sf, "customer").select(k.alias("custkey"), F.array_join(F.transform(kept, lambda w: w["text"]), "|").alias("text"))


@register("""SELECT c_custkey AS custkey, CASE WHEN c_custkey % 2 = 0 THEN 'given' ELSE 'tess-heb-psm' || CAST(c_custkey % 5 AS VARCHAR) END AS engine_id, CASE WHEN c_custkey % 4 = 3 THEN 'missing' WHEN c_custkey % 4 = 0 THEN 'empty' ELSE 'populated' END AS state FROM customer""")
def engine_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Engine ids, given or made of parameters, and the state of folders."""
    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, F.lit("given")).when(k % 3 == 0, F.lit(""))
    return P.read(spark, sf, "customer").select(k.alias("custkey"), G.engine_id(name, "tess-%s-psm%d", F.lit("heb"), k % 5).alias("engine_id"), I.population_state(k % 4 != 3, k % 4).alias("state"))


@register("SELECT event_id, value FROM events WHERE value >= 50")
def confident_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return G.confident_boxes(P.read(spark, sf, "events").withColumn("conf", F.col("value"))).select("event_id", "value")


# --- stages ----------------------------------------------------------------------------


def _load_page(page: str) -> str:
    return base64.b64decode(page, validate=True).decode()


def _recognise(page: str) -> str:
    response = json.loads(page)
    if "error" in response:
        raise RuntimeError(response["error"])
    return response["text"]


def _read_total(text: str) -> float:
    return float(text.partition(" ")[2])


@register("""SELECT key, label, CASE WHEN label IS NULL THEN total END AS total, label IS NOT NULL AS has_message, label IN ('PAGE_LOAD_ERROR', 'OCR_FAILURE', 'EXTRACT_FAILURE') AS has_traceback,
  CASE label WHEN 'PAGE_LOAD_ERROR' THEN 1 WHEN 'OCR_FAILURE' THEN 2 WHEN 'BLOCKED' THEN CASE WHEN key % 13 = 0 THEN 0 ELSE 2 END ELSE 3 END AS stages
  FROM (SELECT o_orderkey AS key, o_totalprice AS total, CASE WHEN o_orderkey % 13 = 0 THEN 'BLOCKED' ELSE CASE o_orderkey % 11 WHEN 1 THEN 'PAGE_LOAD_ERROR' WHEN 2 THEN 'PAGE_LOAD_ERROR' WHEN 3 THEN 'OCR_FAILURE' WHEN 4 THEN 'BLOCKED' WHEN 5 THEN 'OCR_FAILURE' WHEN 6 THEN 'EXTRACT_FAILURE' END END AS label FROM orders)""")
def error_isolation(spark: SparkSession, sf: str) -> DataFrame:
    """A run over a page for each order, many of them poison: lost, broken, blocked or without an amount. Each is labelled, the rest goes through."""
    k = F.col("o_orderkey")
    amount = F.when(k % 11 == 6, "none").otherwise(F.col("o_totalprice").cast("string"))
    body = F.when(k % 11 == 3, '{"text": "cut').when(k % 11 == 4, '{"error": "BLOCKED: no licence"}').when(k % 11 == 5, '{"error": "late"}').otherwise(F.concat(F.lit('{"text": "total '), amount, F.lit('"}')))
    page = F.when(k % 11 == 1, None).when(k % 11 == 2, "*not base64*").otherwise(F.base64(F.encode(body, "UTF-8")))
    failed = F.struct(F.lit(Q.BLOCKED).alias("label"), F.lit("no engine").alias("message"), F.lit(None).cast("string").alias("traceback"))
    pages = P.read(spark, sf, "orders").select(k.alias("key"), page.alias("raw"), F.when(k % 13 == 0, failed).alias("error"))
    out = Q.run_documents(pages, _load_page, _recognise, _read_total, ["raw"], "string", "string", "double")
    label = F.col("error.label")
    return out.select(
        "key", label.alias("label"), F.col("prediction").alias("total"), F.col("error.message").isNotNull().alias("has_message"),
        F.when(label.isNotNull(), F.col("error.traceback").isNotNull()).alias("has_traceback"), F.size("timings_ms").alias("stages"),
    )


# --- comparisons ---------------------------------------------------------------------


_SPACES = r"[ \t\n\r\x0b\x0c]+"
_RATES = """SELECT lang, CAST(sum(s) AS BIGINT) AS substitutions, CAST(sum(d) AS BIGINT) AS deletions, CAST(sum(i) AS BIGINT) AS insertions, CAST(sum(s + d + i) AS BIGINT) AS edits, CAST(sum(n + d) AS BIGINT) AS reference,
  round(sum(s + d + i) / nullif(CAST(sum(n + d) AS DOUBLE), 0), 6) AS rate, round(avg((s + d + i) / nullif(CAST(n + d AS DOUBLE), 0)), 6) AS macro FROM ({each}) GROUP BY 1"""


def _rates(pairs: DataFrame, unit: str) -> DataFrame:
    counts = ["substitutions", "deletions", "insertions", "edits", "reference"]
    out = L.error_rates(pairs, ["lang"], unit)
    return out.select("lang", *[F.col(c).cast("long").alias(c) for c in counts], F.round("rate", 6).alias("rate"), F.round("macro", 6).alias("macro"))


# a word that the other side never has costs an edit of its own, so the fewest edits and their kinds are known
@register(_RATES.format(each="""SELECT lang, n, CASE WHEN k = 0 THEN (n + 32) // 40 ELSE 0 END AS s, CASE WHEN k = 1 THEN (n + 48) // 60 ELSE 0 END AS d, CASE WHEN k = 0 THEN 2 ELSE 0 END AS i FROM (
  SELECT lang, doc_id % 3 AS k, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '')) AS n FROM documents)"""))
def wer_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """Word edits of whole texts: of a third of them some words were misread and two added at the end, of a third some were lost."""
    d = P.read(spark, sf, "documents").select("lang", (F.col("doc_id") % 3).alias("k"), F.filter(F.split(F.coalesce("text", F.lit("")), _SPACES), lambda w: w != "").alias("w"))
    misread = F.transform("w", lambda w, i: F.when(i % 40 == 7, "\u0001s").otherwise(w))
    kept = F.transform("w", lambda w, i: F.when(i % 60 == 11, F.concat(w, F.lit(" \u0001x"))).otherwise(w))
    expected = F.array_join(F.when(F.col("k") == 1, kept).otherwise(F.col("w")), " ")
    predicted = F.when(F.col("k") == 0, F.concat(F.array_join(misread, " "), F.lit(" \u0001q \u0001r"))).otherwise(F.array_join("w", " "))
    return _rates(d.select("lang", expected.alias("expected"), predicted.alias("predicted")), "word")


@register(_RATES.format(each="""SELECT lang, n, CASE WHEN k = 0 THEN n // 100 ELSE 0 END AS s, CASE WHEN k = 1 THEN n // 150 ELSE 0 END AS d, CASE WHEN k = 0 THEN 3 ELSE 0 END AS i FROM (
  SELECT lang, doc_id % 3 AS k, length(coalesce(text, '')) AS n FROM documents)"""))
def cer_of_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Character edits of whole texts: of a third of them every hundredth character was misread and three added at the end, of a third some were lost."""
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 3
    expected = F.when(k == 1, F.regexp_replace(text, "(?s)(.{150})", "$1\u0003")).otherwise(text)
    predicted = F.when(k == 0, F.concat(F.regexp_replace(text, "(?s)(.{99}).", "$1\u0001"), F.lit("\u0002\u0002\u0002"))).otherwise(text)
    return _rates(P.read(spark, sf, "documents").select("lang", expected.alias("expected"), predicted.alias("predicted")), "character")


@register(P.SQL + """SELECT r.document_id, r.engine_id, f.field, f.v AS expected, o.predicted, o.presence, o.correct, o.error_label FROM (SELECT * FROM rows_ WHERE engine_id IN ('truncated', 'blocked')) r JOIN fields f ON f.key = r.key
  LEFT JOIN outcomes o ON o.document_id = r.document_id AND o.engine_id = r.engine_id AND o.field = f.field""")
def field_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Truth, prediction and judgement of every field side by side, for two engines."""
    return C.compare_fields(C.scored(P.facts(spark, sf).where(F.col("engine_id").isin("truncated", "blocked"))))


@register(P.SQL + """, f AS (SELECT engine_id, submitted FROM (SELECT engine_id, count(*) AS submitted FROM scores GROUP BY 1)) SELECT engine_id, round(3.0::DOUBLE / submitted, 9) AS upper_bound FROM f""")
def zero_error_bound(spark: SparkSession, sf: str) -> DataFrame:
    counts = A.engine_counters(P.scores(spark, sf))
    return counts.select("engine_id", F.round(N.zero_error_bound(F.col("submitted")), 9).alias("upper_bound"))


@register(P.SQL + """SELECT document_id, e.engine_id, coalesce(s.status, 'NOT RUN') AS status, CAST(d.key AS BIGINT) AS document_ordinal, CASE e.engine_id """ + " ".join(f"WHEN '{e[0]}' THEN {k}" for k, e in enumerate(P.ENGINES)) + """ END AS engine_ordinal
  FROM (SELECT DISTINCT key, document_id FROM rows_) d CROSS JOIN eng e LEFT JOIN (SELECT document_id AS sd, engine_id AS se, status FROM scores) s ON sd = d.document_id AND se = e.engine_id""")
def ordered_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with every engine, in the order of documents and engines."""
    facts = P.facts(spark, sf).select("document_id", "engine_id", "error_label")
    documents = P.truths(spark, sf).select("document_id", F.col("key").alias("ordinal"))
    place = F.array_position(F.array(*[F.lit(e[0]) for e in P.ENGINES]), F.col("engine_id")).cast("int") - 1
    return C.ordered_grid(documents, P.engines(spark).withColumn("ordinal", place), facts)


@register("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id LIMIT 7")
def new_documents_limited(spark: SparkSession, sf: str) -> DataFrame:
    """The limit on new documents: the first seven by id that the manifest lacks."""
    return D.new_documents(P.read(spark, sf, "documents").select("doc_id", "source"), P.read(spark, sf, "labels"), most=7, key="doc_id")


@register(P.SQL + """SELECT document_id, CAST(count(v) AS INTEGER) AS hits, 'PENDING' AS status, 8 AS unreadable FROM (SELECT CAST(key AS VARCHAR) AS document_id, v FROM fields) GROUP BY 1""")
def seeded_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Proposed manifest entries: the extracted record, every field marked unreadable until someone looks."""
    t = P.truths(spark, sf)
    documents = t.select("document_id", F.concat("document_id", F.lit(".png")).alias("source_file"), "split", "language", F.array(F.lit("p.png")).alias("pages"), F.lit(None).cast("array<string>").alias("tags"))
    notes = F.array().cast("array<string>").alias("extraction_notes")
    typed = t.withColumns({f: F.col(f).cast("double") for f in S.AMOUNT_FIELDS}).select("*", F.lit(None).cast("boolean").alias("business_tax_id_valid"), F.lit("x").alias("source_file"), F.lit("a\nb").alias("text"), notes)
    entries = D.seeded_entries(documents, typed, "made")
    hits = N.field_hits(*[F.col(f"ground_truth.{f}") for f in S.BUSINESS_FIELDS])
    marked = F.size(F.filter(F.map_values("annotation.field_presence"), lambda v: v == "UNREADABLE"))
    return entries.select("document_id", hits.alias("hits"), F.col("annotation.adjudication_status").alias("status"), marked.alias("unreadable"))
