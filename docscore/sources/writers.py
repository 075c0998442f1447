"""Sinks: JSON lines, sidecars, CSV and Markdown reports.

Facts are written by the executors. Reports are written by the driver from tables
with one row per engine, a small and fixed set.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscore import schema as S
from docscore.functions import numbers as N
from docscore.functions import text as X
from docscore.operators.aggregate import hit_rate
from docscore.sources import pdf, scratch

# fixed values: columns of the spreadsheet export
SPREADSHEET = ["source_file", "vendor_name", "business_tax_id", "business_tax_id_valid", "invoice_number", "invoice_date", "amount_before_vat", "vat_amount", "total_amount", "allocation_number", "extraction_notes"]


def write_results(rows: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """Rows as JSON lines, with ``compression`` (gzip, say) packed: names and values repeat on every line."""
    rows.write.mode(mode).json(path, compression=compression)


def append_manifest(entries: DataFrame, path: str, overwrite: bool = False) -> None:
    entries.write.mode("overwrite" if overwrite else "append").json(path)


def sidecar_text() -> Column:
    """The assembled text, or the label and message of the error in its place."""
    message = F.coalesce("error_message", F.lit(""))
    failed = F.concat(F.lit("["), F.coalesce("error_label", F.lit("NO_TEXT")), F.lit("] "), message)
    return F.coalesce(F.when(F.col("error_label").isNull(), F.col("assembled_text")), failed)


def write_packed_sidecars(rows: DataFrame, path: str) -> None:
    """``document_id, engine_id, text`` as a table: for any number of documents."""
    rows.select("document_id", "engine_id", sidecar_text().alias("text")).write.mode("overwrite").parquet(path)


def write_sidecars(rows: DataFrame, path: str) -> None:
    """A file ``<document>__<engine>.txt`` for each row, written by the driver a row at a time.

    For people to read, so for small runs; ``write_packed_sidecars`` takes any number.
    """
    spark = rows.sparkSession
    for r in rows.select("document_id", "engine_id", sidecar_text().alias("text")).toLocalIterator():
        scratch.write_bytes(spark, f"{path.rstrip('/')}/{r['document_id']}__{r['engine_id']}.txt", r["text"].encode())


def per_document(scores: DataFrame) -> DataFrame:
    """A row per document and engine with the prediction apart from its scoring."""
    scoring = F.struct("status", "critical_complete", "all_fields_complete", "digit_accuracy", "reference_digit_count", F.col("outcomes").alias("fields"))
    prediction = F.map_from_entries(F.transform("outcomes", lambda o: F.struct(o["field"], o["predicted"])))
    return scores.select("document_id", "engine_id", prediction.alias("prediction"), scoring.alias("scoring"))


def aggregate_json(report: DataFrame, fields: DataFrame, labels: DataFrame) -> DataFrame:
    """One JSON text per engine: counts, completeness with bounds, per-field counters and error labels."""
    low, high = N.wilson(F.col("present_correct"), F.col("present_total"))
    cell = F.struct("field", "present_correct", "present_total", low.alias("low"), high.alias("high"), "absent_correct", "absent_total", "excluded")
    per_field = fields.groupBy("engine_id").agg(F.array_sort(F.collect_list(cell)).alias("per_field"))
    per_label = labels.groupBy("engine_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("error_labels"))
    df = report.join(per_field, "engine_id", "left").join(per_label, "engine_id", "left")
    return df.select("engine_id", F.to_json(F.struct(*df.columns)).alias("json"))


def csv_report(report: DataFrame, pivot: DataFrame) -> DataFrame:
    """The flat report: counters and rates of each engine, then four counters for every field."""
    return report.join(pivot, "engine_id", "left").orderBy("candidate_number", "engine_id")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_spreadsheet(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """CSV for spreadsheets: UTF-8 with a byte order mark, notes joined with bars.

    Written by the driver a row at a time, as no Spark writer makes the mark; for
    tables that a spreadsheet can hold.
    """

    def parts() -> Iterator[bytes]:
        line = io.StringIO(newline="")
        writer = csv.DictWriter(line, SPREADSHEET, extrasaction="ignore")
        writer.writeheader()
        yield codecs.BOM_UTF8 + line.getvalue().encode()
        for r in rows.toLocalIterator():
            row = r.asDict()
            line.seek(line.truncate(0))
            writer.writerow(row | {"extraction_notes": " | ".join(row.get("extraction_notes") or [])})
            yield line.getvalue().encode()

    scratch.write_parts(spark, path, parts())


def markdown_report(report: DataFrame, pivot: DataFrame, labels: DataFrame, title: str, run_id: str, documents: int, load_errors: dict[str, str] | None = None) -> str:
    """The comparison table, the status summary and the list of blocked engines."""
    cells = [N.percent_text(F.col(f"{x}_ok"), F.col(f"{x}_total")).alias(x) for x in ("critical_complete", "all_fields_complete")]
    fields = [N.percent_text(F.coalesce(f"present_{f}_correct", F.lit(0)), F.coalesce(f"present_{f}_total", F.lit(0))).alias(f"cell_{f}") for f in S.BUSINESS_FIELDS]
    mean = F.col("digit_accuracy_mean")
    digit = F.when(mean.isNotNull(), F.format_string("%5.1f%%", mean * 100)).otherwise("n/a").alias("digits")
    df = csv_report(report, pivot).join(labels, "engine_id", "left")
    rows = df.select("candidate_number", "candidate_name", "engine_id", "status", "submitted", "ok", "blocked", "errored", "labels", *cells, digit, *fields).orderBy("candidate_number", "engine_id").collect()
    head = ["Candidate", "Engine config", "Status", "Critical Complete", "All Fields Complete", "Digit Acc", *S.BUSINESS_FIELDS]
    out = [f"# {title}", "", f"- Run id: `{run_id}`", f"- Documents scored: {documents}", f"- Engines executed: {len(rows)}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for r in rows:
        ran = r["status"] != "NOT RUN"
        values = [r["critical_complete"], r["all_fields_complete"], r["digits"], *[r[f"cell_{f}"] for f in S.BUSINESS_FIELDS]]
        out.append(f"| {r['candidate_number']}. {r['candidate_name']} | `{r['engine_id']}` | {r['status']} | " + " | ".join(v if ran else "—" for v in values) + " |")
    out += ["", "## Status summary", "", "| Engine | Submitted | OK | BLOCKED | Errored | Dominant error labels |", "|---|---:|---:|---:|---:|---|"]
    out += [f"| `{r['engine_id']}` | {r['submitted']} | {r['ok']} | {r['blocked']} | {r['errored']} | {r['labels'] or '—'} |" for r in rows if r["status"] != "NOT RUN"]
    out += ["", "## Blocked engines", ""]
    out += [f"- **`{e}`** — {m}" for e, m in (load_errors or {}).items()] or ["_None in this run._"]
    return "\n".join(out) + "\n"


def batch_records(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Extracted documents of a batch: ``pdf, raw, normalized, parsed, hits``, ``parsed`` being the record.

    ``hits`` counts the business fields that hold something. Null text is a failed
    extraction: no record, no hits, and an error.
    """
    record = F.struct(*[F.col(c) for c in S.CANONICAL_KEYS])
    hits = N.field_hits(*[F.col(f) for f in S.BUSINESS_FIELDS])
    known = F.col(text_col).isNotNull()
    return df.select(
        F.col("source_file").alias("pdf"), F.col(text_col).alias("raw"), X.normalize_for_matching(F.col(text_col)).alias("normalized"), F.when(known, record).alias("parsed"),
        F.when(known, hits).alias("hits"), F.when(~known, F.lit("text extraction failed")).alias("error"),
    )


def write_batch(records: DataFrame, path: str) -> None:
    """The batch as tables: ``raw``, ``normalized`` and ``parsed`` with a row per document, for any number of documents."""
    for part in ("raw", "normalized", "parsed"):
        records.where(F.col("raw").isNotNull()).select("pdf", part).write.mode("overwrite").json(f"{path}/{part}")


def _summary_head(records: DataFrame) -> dict:
    """The number of documents and the hit rate of each field."""
    wide = records.select(*[F.col(f"parsed.{f}").alias(f) for f in S.BUSINESS_FIELDS])
    rates = {r["field"]: (r["n"], r["rate"]) for r in hit_rate(wide, S.BUSINESS_FIELDS).collect()}
    return {"pdf_count": max((n for n, _ in rates.values()), default=0), "field_hit_rate": {f: rates[f][1] for f in S.BUSINESS_FIELDS if f in rates}}


def write_batch_summary(records: DataFrame, path: str) -> None:
    """One JSON file with the number of documents, the hit rate of each field and a record per document, by document.

    Written by the driver a row at a time, as readers of the summary expect one file:
    for people, so for small batches; ``write_packed_summary`` takes any number.
    """
    spark = records.sparkSession
    cell = F.to_json(F.struct("pdf", "hits", "error", "parsed"), {"ignoreNullFields": "false"})
    head = _summary_head(records)

    def parts() -> Iterator[bytes]:
        yield (json.dumps(head, ensure_ascii=False)[:-1] + ', "per_pdf": [').encode()
        for k, r in enumerate(records.orderBy("pdf").select(cell.alias("j")).toLocalIterator()):
            yield ((",\n" if k else "") + r["j"]).encode()
        yield b"]}"

    scratch.write_parts(spark, path, parts())


def write_packed_summary(records: DataFrame, path: str) -> None:
    """The summary as a folder: ``head.json`` has the number of documents and the hit rates,
    ``per_pdf`` is a table of JSON lines with a record per document, by document. Executors
    write the records; the driver sees the head only."""
    scratch.write_bytes(records.sparkSession, f"{path}/head.json", json.dumps(_summary_head(records), ensure_ascii=False).encode())
    records.orderBy("pdf").select("pdf", "hits", "error", "parsed").write.mode("overwrite").json(f"{path}/per_pdf", ignoreNullFields=False)


def word_rows(regions: DataFrame) -> DataFrame:
    """Recognised words with their boxes as flat columns, for a CSV file: the least corner, width and height."""
    xs, ys = F.transform("polygon", lambda p: p["x"]), F.transform("polygon", lambda p: p["y"])
    return regions.select(
        "document_id", "page", "reading_order", "text", "confidence", F.array_min(xs).alias("left"), F.array_min(ys).alias("top"),
        (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"),
    )


def write_ranking_pdf(spark: SparkSession, ranked: DataFrame, path: str, title: str = "Ranking") -> None:
    """The ranking (a row per engine) as a PDF of text: place, engine, correct of all, of present and of absent fields.

    A blank stands before every cell, however wide its numbers are.
    """
    cells = ["rank", "shown_rank", "engine_id", "status", "total_correct", "total_scorable", "present_correct", "present_scorable", "absent_correct", "absent_scorable"]
    rows = ranked.select(*cells).orderBy(F.col("rank").asc_nulls_last(), F.desc("present_correct"), "engine_id").collect()
    part = lambda r, side: f"{r[side + '_correct']}/{r[side + '_scorable']}" if r["rank"] is not None else r["status"]
    line = lambda place, engine, *cells: f"{place:<5} {engine:<30}" + "".join(f" {c:>15}" for c in cells)
    lines = [title, "", line("place", "engine", "all", "present", "absent")]
    lines += [line(r["shown_rank"] or "=", r["engine_id"], *(part(r, side) for side in ("total", "present", "absent"))) for r in rows]
    scratch.write_bytes(spark, path, pdf.text_pdf(lines))


def write_detail_pdf(spark: SparkSession, comparison: DataFrame, path: str, title: str = "Details") -> None:
    """Truth, prediction and judgement of every field as a PDF of text, by document and engine; for the documents someone wants to read."""
    lines, at = [title], None
    for r in comparison.orderBy("document_id", "engine_id", "field").toLocalIterator():
        if (r["document_id"], r["engine_id"]) != at:
            at = (r["document_id"], r["engine_id"])
            lines += ["", f"{at[0]} | {at[1]}"]
        mark = {None: "-", True: "ok"}.get(r["correct"], r["error_label"] or "not scored")
        lines.append(f"  {r['field']}: {r['expected'] if r['expected'] is not None else 'null'} | {r['predicted'] if r['predicted'] is not None else 'null'} | {mark}")
    scratch.write_bytes(spark, path, pdf.text_pdf(lines))


def module_map(counts: DataFrame, files: int, tests: list[str]) -> str:
    """Hits by category and the test files, as Markdown."""
    rows = [f"| {r['category']} | {r['hits']} |" for r in counts.orderBy("category").collect()]
    return "\n".join(["# Module map", "", f"{files} files", "", "| Category | Hits |", "|---|---:|", *rows, "", "## Tests", "", *[f"- `{t}`" for t in sorted(tests)], ""])


def write_run_manifest(spark: SparkSession, path: str, run: dict, engines: DataFrame, load_errors: dict[str, str], load_ms: dict[str, float]) -> None:
    """The settings, engines (a small, fixed set) and load results of a run, as one JSON object."""
    spec = [r.asDict() for r in engines.orderBy("ordinal").collect()]
    scratch.write_bytes(spark, path, json.dumps(run | {"engines": spec, "load_errors": load_errors, "load_ms": load_ms}, ensure_ascii=False, indent=2).encode())
