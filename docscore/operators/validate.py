"""Constraint checks that collect violations and never fail the job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscore import schema as S
from docscore.functions.regex import let


def key_differences(keys: Column, wanted: list[str]) -> tuple[Column, Column]:
    """Keys beyond the wanted ones, and wanted ones that are missing, both sorted."""
    want = F.array(*map(F.lit, wanted))
    return F.array_sort(F.array_except(keys, want)), F.array_sort(F.array_except(want, keys))


def _kinds(json: Column) -> Column:
    """The types of an object's values in JSON text by key: str, int, float, bool, list, dict or null; null if it is no object."""
    name = lambda t: (
        F.when(t == "VOID", "null").when(t == "STRING", "str").when(t == "BOOLEAN", "bool").when(t == "BIGINT", "int")
        .when(F.startswith(t, F.lit("ARRAY")), "list").when(F.startswith(t, F.lit("OBJECT")), "dict").otherwise("float")
    )
    values = F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")
    return F.transform_values(F.transform_values(values, lambda _, v: F.schema_of_variant(v)), lambda _, t: name(t))


def _of(kinds: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(kinds, F.lit(key)), F.lit("missing"))


def _quoted(names: Column) -> Column:
    """A list of names as ``['a', 'b']``."""
    return F.concat(F.lit("["), F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]"))


def canonical_violations(record: Column, document: Column) -> Column:
    """Messages of a record in JSON text that does not have exactly the canonical keys and types."""
    return let(F.struct(record.alias("json"), _kinds(record).alias("kinds"), document.alias("document")), _shape_messages)


def _shape_messages(r: Column) -> Column:
    record, kinds, document = r["json"], r["kinds"], r["document"]
    extra, missing = key_differences(F.map_keys(kinds), S.CANONICAL_KEYS)
    say = lambda when, *parts: F.when(when, F.concat(document, *[F.lit(p) if isinstance(p, str) else p for p in parts]))
    out = [
        say(F.size(extra) > 0, ": ground_truth has extra keys: ", _quoted(extra)),
        say(F.size(missing) > 0, ": ground_truth missing keys: ", _quoted(missing)),
    ]
    for f in S.STRING_FIELDS:
        kind = _of(kinds, f)
        out.append(say(~kind.isin("str", "null", "missing"), f": '{f}' must be string or null, got ", kind))
    for f in S.AMOUNT_FIELDS:
        kind = _of(kinds, f)
        out.append(say(~kind.isin("int", "float", "null", "missing"), f": '{f}' must be number or null, got ", kind))
        value = F.get_json_object(record, f"$.{f}").try_cast("double")
        out.append(say(kind.isin("int", "float") & (F.isnan(value) | (F.abs(value) == float("inf"))), f": '{f}' must be a finite number"))
    kind = _of(kinds, "business_tax_id_valid")
    out.append(say(~kind.isin("bool", "null", "missing"), ": business_tax_id_valid must be bool or null, got ", kind))
    notes = _of(kinds, "extraction_notes")
    bad = F.exists(F.coalesce(F.from_json(F.get_json_object(record, "$.extraction_notes"), "array<variant>"), F.expr("cast(array() as array<variant>)")), lambda v: F.schema_of_variant(v) != "STRING")
    out.append(say(notes.isin("null", "missing"), ": extraction_notes must be a list (empty when no notes), not null"))
    out.append(say(~notes.isin("null", "missing") & ((notes != "list") | bad), ": extraction_notes must be list[str]"))
    return F.array_compact(F.array(*out))


def annotation_violations(presence: Column, document: Column) -> Column:
    """Messages for unknown fields and unknown values of a presence map."""
    known, values = F.array(*map(F.lit, S.BUSINESS_FIELDS)), F.array(*map(F.lit, sorted(S.PRESENCE_VALUES)))
    entries = F.map_entries(presence)
    unknown = F.transform(F.filter(entries, lambda e: ~F.array_contains(known, e["key"])), lambda e: F.concat(document, F.lit(": annotation.field_presence has unknown field '"), e["key"], F.lit("'")))
    wrong = F.transform(
        F.filter(entries, lambda e: e["value"].isNull() | ~F.array_contains(values, e["value"])),
        lambda e: F.concat(document, F.lit(": annotation.field_presence['"), e["key"], F.lit("'] must be one of "), _quoted(values)),
    )
    return F.coalesce(F.concat(unknown, wrong), F.expr("cast(array() as array<string>)"))


def manifest_violations(lines: DataFrame, pages_exist: DataFrame | None = None) -> DataFrame:
    """``line, document_id, message`` for every violation of manifest lines (``line``, ``raw``).

    Blank lines and comments are no entries. ``pages_exist`` (``path``) turns on the
    check that page paths exist.
    """
    raw = F.trim("raw")
    rows = lines.where((raw != "") & ~F.startswith(raw, F.lit("#"))).withColumn("raw", raw)
    rows = rows.withColumn("v", F.try_parse_json("raw"))
    get = lambda path: F.get_json_object("raw", path)
    document = F.coalesce(F.nullif(get("$.document_id"), F.lit("")), F.concat(F.lit("<line "), F.col("line").cast("string"), F.lit(">")))
    rows = rows.withColumns({"document_id": document, "truth": get("$.ground_truth"), "own": get("$.source_file"), "annotation": get("$.annotation"), "noted": get("$.annotation.field_presence")})
    none = F.expr("cast(array() as array<string>)")
    said = F.col("document_id")

    def entry_messages(kinds: Column) -> Column:
        needed = [F.when(F.col("v").isNotNull() & (_of(kinds, k) == "missing"), F.concat(said, F.lit(f": missing required manifest key '{k}'"))) for k in S.MANIFEST_KEYS]
        is_object, annotated = _of(kinds, "ground_truth") == "dict", _of(kinds, "annotation")
        presence = F.when(annotated == "dict", _of(_kinds(F.col("annotation")), "field_presence")).otherwise("missing")
        source = F.get_json_object("truth", "$.source_file")
        return F.concat(
            F.array_compact(F.array(
                F.when(F.col("v").isNull(), F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": invalid JSON"))),
                *needed,
                F.when(F.col("truth").isNotNull() & ~is_object, F.concat(said, F.lit(": ground_truth must be an object"))),
                F.when(~annotated.isin("dict", "null", "missing"), F.concat(said, F.lit(": annotation must be an object"))),
                F.when(~presence.isin("dict", "null", "missing"), F.concat(said, F.lit(": annotation.field_presence must be an object"))),
                F.when(is_object & (source != F.col("own")), F.concat(said, F.lit(": ground_truth.source_file ('"), source, F.lit("') != manifest source_file ('"), F.col("own"), F.lit("')"))),
            )),
            F.when(is_object, canonical_violations(F.col("truth"), said)).otherwise(none),
            F.when(presence == "dict", annotation_violations(F.from_json(F.col("noted"), "map<string,string>"), said)).otherwise(none),
        )

    messages = let(_kinds(F.col("raw")), entry_messages)
    found = rows.select("line", "document_id", F.explode(messages).alias("message"))
    if pages_exist is not None:
        pages = rows.select("line", "document_id", F.explode(F.from_json(get("$.pages"), "array<string>")).alias("path"))
        gone = pages.join(pages_exist.select("path"), "path", "left_anti")
        found = found.unionByName(gone.select("line", "document_id", F.concat("document_id", F.lit(": page path does not exist: "), "path").alias("message")))
    return found


def validation_totals(entries: DataFrame, violations: DataFrame) -> DataFrame:
    """Entries, those without violation, those with truth, and the number of errors."""
    bad = violations.groupBy("line").agg(F.count("*").alias("n"))
    joined = entries.join(bad, "line", "left")
    return joined.agg(F.count("*").alias("total"), F.count_if(F.col("n").isNull()).alias("ok"), F.count_if(F.col("has_truth")).alias("with_truth"), F.coalesce(F.sum("n"), F.lit(0)).alias("errors"))


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """``key..., rule`` for each rule a row breaks; a rule that is null counts as kept."""
    broken = [F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.select(*key, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
