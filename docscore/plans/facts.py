"""A fact table of invoices made from orders: typed truth, presence annotations and eight engines.

Documents of the driver's tables carry no invoices, so each order stands for one. Every
engine has a fixed way of being wrong, which exercises all scoring rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscore import schema as S
from docscore.operators import score

ENGINES = [
    ("exact", "tesseract", "/data/tessdata_best"), ("truncated", "tesseract", "/data/tessdata_fast"), ("appended", "kraken", None), ("dropped", "ironocr", None),
    ("padded", "abbyy", None), ("blocked", "paddleocr-hebrew", None), ("flaky", "custom", None), ("unrun", "tesseract", None),
]
NUMERIC = S.ID_FIELDS + S.AMOUNT_FIELDS


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(*[F.lit(x).cast("string").alias(n) if x is None else F.lit(x).alias(n) for x, n in zip(row, names, strict=True)]) for row in rows])
    return spark.range(1).select(F.explode(cells).alias("r")).select("r.*")


def engines(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ENGINES, ["engine_id", "adapter", "tessdata"])


def _money(cents: Column) -> Column:
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def truths(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """``key, document_id, split, language``, the true value of every field and ``custkey``, one row per order.

    ``dealt`` spreads orders over all cores before the values are made, which are several times as wide.
    """
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    df = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    if dealt:
        df = df.repartition("o_orderkey")
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    total = F.round(F.col("o_totalprice") * 100).cast("long")
    df = df.withColumn("total", total).withColumn("before", F.expr("total * 100 div 118")).withColumn("vat", F.col("total") - F.col("before"))
    values = {
        "vendor_name": F.col("c_name"),
        "business_tax_id": F.lpad((F.col("o_custkey") * 7919).cast("string"), 9, "0"),
        "invoice_number": F.lpad(key.cast("string"), 7, "0"),
        "invoice_date": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "amount_before_vat": _money(F.col("before")),
        "vat_amount": _money(F.col("vat")),
        "total_amount": _money(F.col("total")),
        "allocation_number": F.when(key % 3 != 0, F.concat(F.lpad(key.cast("string"), 12, "0"), F.lpad(cust, 12, "0"))),
    }
    return df.select(
        key.alias("key"), key.cast("string").alias("document_id"), F.col("o_orderpriority").alias("split"), F.col("c_mktsegment").alias("language"),
        *[v.alias(f) for f, v in values.items()], cust.alias("custkey"),
    )


def _noted(field: str) -> Column:
    key, none = F.col("key"), F.lit(None).cast("string")
    return {"vendor_name": F.when(key % 10 == 0, "UNREADABLE"), "invoice_date": F.when(key % 10 == 1, "AMBIGUOUS")}.get(field, none)


def _predicted(field: str, at: int) -> Column:
    v, e, key = F.col(field), F.col("engine_id"), F.col("key")
    numeric, amount = field in NUMERIC, field in S.AMOUNT_FIELDS
    return (
        F.when(e == "truncated", F.left(v, F.length(v) - 1) if numeric else v)
        .when(e == "appended", F.concat(F.coalesce(v, F.lit("99999")), F.lit("1")) if numeric else v)
        .when((e == "dropped") & ((key + at) % 4 == 0), None)
        .when(e == "padded", F.concat(v, F.lit("0")) if amount else F.concat(F.lit("  "), v, F.lit(" ")))
        .otherwise(v)
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the seven engines that ran, with truth; all values are ASCII and so composed already."""
    ran = engines(spark).where("engine_id <> 'unrun'").select("engine_id")
    # an order is a few bytes but scoring it against every engine is not: deal orders over all cores first
    df = truths(spark, sf_dir, dealt=True).crossJoin(F.broadcast(ran))
    turn = F.col("key") % 5
    error = F.when(F.col("engine_id") == "blocked", "BLOCKED").when(
        F.col("engine_id") == "flaky", F.when(turn == 2, "OCR_FAILURE").when(turn == 3, "PAGE_LOAD_ERROR").when(turn == 4, "BLOCKED")
    )
    cell = lambda k, f: F.struct(F.lit(f).alias("field"), _predicted(f, k).alias("predicted"), F.col(f).alias("expected"), _noted(f).alias("noted"))
    df = df.withColumn("error_label", error).withColumn("fields", F.array(*[cell(k, f) for k, f in enumerate(S.BUSINESS_FIELDS)]))
    return df.select("key", "document_id", "engine_id", "split", "language", "error_label", "fields")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.scored(facts(spark, sf_dir))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.outcomes_long(scores(spark, sf_dir))


_VALUES = {
    "vendor_name": "c_name",
    "business_tax_id": "lpad(CAST(o_custkey * 7919 AS VARCHAR), 9, '0')",
    "invoice_number": "lpad(CAST(o_orderkey AS VARCHAR), 7, '0')",
    "invoice_date": "strftime(o_orderdate, '%Y-%m-%d')",
    "amount_before_vat": "CAST(before // 100 AS VARCHAR) || '.' || lpad(CAST(before % 100 AS VARCHAR), 2, '0')",
    "vat_amount": "CAST(vat // 100 AS VARCHAR) || '.' || lpad(CAST(vat % 100 AS VARCHAR), 2, '0')",
    "total_amount": "CAST(total // 100 AS VARCHAR) || '.' || lpad(CAST(total % 100 AS VARCHAR), 2, '0')",
    "allocation_number": "CASE WHEN o_orderkey % 3 <> 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || lpad(CAST(o_custkey AS VARCHAR), 12, '0') END",
}


def _sql_list(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _sql_unpivot() -> str:
    parts = []
    for k, (field, value) in enumerate(_VALUES.items()):
        parts.append(f"SELECT o_orderkey AS key, o_orderpriority AS split, c_mktsegment AS language, {k} AS at, '{field}' AS field, {value} AS v FROM base")
    return " UNION ALL ".join(parts)


#: Common table expressions for the oracles: base, eng, rows_, outcomes, scores.
SQL = f"""WITH base0 AS (
  SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS total FROM orders JOIN customer ON o_custkey = c_custkey),
base AS (SELECT *, total * 100 // 118 AS before, total - total * 100 // 118 AS vat FROM base0),
eng(engine_id, adapter, tessdata) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in e) + ")" for e in ENGINES)}),
fields AS ({_sql_unpivot()}),
rows_ AS (
  SELECT o_orderkey AS key, CAST(o_orderkey AS VARCHAR) AS document_id, engine_id, o_orderpriority AS split, c_mktsegment AS language,
    CASE WHEN engine_id = 'blocked' THEN 'BLOCKED'
         WHEN engine_id = 'flaky' THEN CASE o_orderkey % 5 WHEN 2 THEN 'OCR_FAILURE' WHEN 3 THEN 'PAGE_LOAD_ERROR' WHEN 4 THEN 'BLOCKED' END END AS error_label
  FROM base, eng WHERE engine_id <> 'unrun'),
pred AS (
  SELECT r.key, r.document_id, r.engine_id, r.split, r.language, f.field, f.at, f.v,
    CASE WHEN f.field = 'vendor_name' AND r.key % 10 = 0 THEN 'UNREADABLE' WHEN f.field = 'invoice_date' AND r.key % 10 = 1 THEN 'AMBIGUOUS'
         WHEN f.v IS NULL THEN 'ABSENT' ELSE 'PRESENT' END AS presence,
    CASE WHEN r.engine_id = 'truncated' AND f.field IN ({_sql_list(NUMERIC)}) THEN left(f.v, length(f.v) - 1)
         WHEN r.engine_id = 'appended' AND f.field IN ({_sql_list(NUMERIC)}) THEN coalesce(f.v, '99999') || '1'
         WHEN r.engine_id = 'dropped' AND (r.key + f.at) % 4 = 0 THEN NULL
         WHEN r.engine_id = 'padded' AND f.field IN ({_sql_list(S.AMOUNT_FIELDS)}) THEN f.v || '0'
         WHEN r.engine_id = 'padded' THEN '  ' || f.v || ' '
         ELSE f.v END AS predicted
  FROM rows_ r JOIN fields f ON r.key = f.key WHERE r.error_label IS NULL),
judged AS (
  SELECT *, presence NOT IN ('UNREADABLE', 'AMBIGUOUS') AS scorable,
    CASE WHEN presence IN ('UNREADABLE', 'AMBIGUOUS') THEN false
         WHEN presence = 'ABSENT' THEN predicted IS NULL
         WHEN field = 'vendor_name' THEN nullif(regexp_replace(trim(predicted), '\\s+', ' ', 'g'), '') IS NOT DISTINCT FROM nullif(regexp_replace(trim(v), '\\s+', ' ', 'g'), '')
         WHEN field IN ({_sql_list(S.AMOUNT_FIELDS)}) THEN TRY_CAST(predicted AS DECIMAL(38,10)) IS NOT DISTINCT FROM TRY_CAST(v AS DECIMAL(38,10))
         ELSE nullif(trim(predicted), '') IS NOT DISTINCT FROM nullif(trim(v), '') END AS correct
  FROM pred),
outcomes AS (
  SELECT key, document_id, engine_id, split, language, field, presence, scorable, predicted, CASE WHEN presence <> 'ABSENT' THEN v END AS expected, correct,
    CASE WHEN NOT scorable OR correct THEN NULL WHEN presence = 'ABSENT' THEN 'FIELD_SELECTION_ERROR' WHEN predicted IS NULL THEN 'OCR_DETECTION_ERROR'
         WHEN field IN ({_sql_list(NUMERIC)}) THEN 'OCR_DIGIT_ERROR' ELSE 'OCR_TEXT_ERROR' END AS error_label,
    CASE field {" ".join(f"WHEN '{f}' THEN {k}" for k, f in enumerate([*S.ID_FIELDS, "invoice_date", *S.AMOUNT_FIELDS]))} END AS place
  FROM judged),
digits AS (
  SELECT document_id, engine_id,
    coalesce(string_agg(regexp_replace(coalesce(predicted, ''), '[^0-9]', '', 'g'), '' ORDER BY place) FILTER (WHERE presence = 'PRESENT' AND place IS NOT NULL), '') AS p,
    coalesce(string_agg(regexp_replace(expected, '[^0-9]', '', 'g'), '' ORDER BY place) FILTER (WHERE presence = 'PRESENT' AND place IS NOT NULL), '') AS e,
    CASE WHEN bool_and(scorable) FILTER (WHERE field IN ({_sql_list(S.CRITICAL_FIELDS)})) THEN bool_and(correct) FILTER (WHERE field IN ({_sql_list(S.CRITICAL_FIELDS)})) END AS critical_complete,
    CASE WHEN bool_and(scorable) THEN bool_and(correct) END AS all_fields_complete
  FROM outcomes GROUP BY ALL),
scores AS (
  SELECT r.*, coalesce(r.error_label, 'ok') AS status, critical_complete, all_fields_complete,
    CASE WHEN length(e) > 0 THEN greatest(0.0e0, 1 - levenshtein(p, e) / CAST(length(e) AS DOUBLE)) END AS digit_accuracy, coalesce(length(e), 0) AS reference_digit_count
  FROM rows_ r LEFT JOIN digits d ON r.document_id = d.document_id AND r.engine_id = d.engine_id)
"""
