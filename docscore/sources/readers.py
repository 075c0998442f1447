"""Readers of manifests, results, configurations, sidecars and folders."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docscore import schema as S
from docscore.functions import text as X

IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
HEADER_BYTES = 256 << 10
SKIP_FOLDERS = (".git", ".venv", "venv", "__pycache__", "node_modules")


def numbered_lines(spark: SparkSession, path: str, one_text: bool = False) -> DataFrame:
    """``line, raw`` of a text file, numbered from 1 in file order; of several files each from 1,
    with ``one_text`` through all of them in the order of their names.

    Spark's id of a row counts the rows of its partition, so the place of a line in its
    split is what its id is above the least of the split. Splits are counted, a row each,
    and what the splits before hold is added: no line is sorted or leaves its partition.
    """
    rows = spark.read.text(path).select(
        F.col("value").alias("raw"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")
    )
    counts = rows.groupBy("f", "b").agg(F.count("*").alias("k"), F.min("i").alias("least"))
    through = Window.orderBy("f", "b") if one_text else Window.partitionBy("f").orderBy("b")  # a row per split
    before = counts.select(F.col("f").alias("f2"), F.col("b").alias("b2"), (F.sum("k").over(through) - F.col("k") - F.col("least")).alias("before"))
    same = (F.col("f") == F.col("f2")) & (F.col("b") == F.col("b2"))
    return rows.join(F.broadcast(before), same).select((F.col("before") + F.col("i") + 1).cast("long").alias("line"), "raw")


def _entries(lines: DataFrame) -> DataFrame:
    raw = F.trim("raw")
    return lines.where((raw != "") & ~F.startswith(raw, F.lit("#")))


def _may_be_of(split: str) -> Column:
    """False for lines that name other splits only. Lines with escapes, or without a split, may be of any."""
    said = F.col("raw").rlike(r'"split"\s*:\s*"')
    named = F.col("raw").rlike(rf'"split"\s*:\s*"\Q{split}\E"')
    return ~said | named | F.contains("raw", F.lit("\\"))


def read_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Manifest entries with their line. Blank lines and comments are skipped; a line that is no
    object or lacks a required key fails the read with its place; optional keys default to null.
    With ``split``, lines that name another one are passed over before anything is parsed, so what
    is wrong with them is not seen."""
    rows = _entries(numbered_lines(spark, path))
    if split is not None:
        rows = rows.where(_may_be_of(split))
    keys = F.json_object_keys("raw")
    where = F.concat(F.lit(f"{path}:"), F.col("line").cast("string"))
    missing = F.array_except(F.array(*map(F.lit, S.MANIFEST_KEYS)), keys)
    checked = (
        F.when(F.try_parse_json("raw").isNull() | keys.isNull(), F.raise_error(F.concat(where, F.lit(": invalid JSON"))))
        .when(F.size(missing) > 0, F.raise_error(F.concat(where, F.lit(": missing required key "), missing[0])))
        .otherwise(F.col("raw"))
    )
    out = rows.select("line", "raw", F.from_json(checked, S.MANIFEST).alias("e")).select("line", "raw", "e.*")
    return out.where(F.col("split") == split) if split is not None else out


def raw_truth(manifest: DataFrame) -> DataFrame:
    """``document_id, line, truth, presence`` with the raw tokens of the truth, as written."""
    token = lambda f: F.get_json_object("raw", f"$.ground_truth.{f}")
    has = F.get_json_object("raw", "$.ground_truth").isNotNull()
    truth = F.when(has, F.create_map(*[x for f in S.BUSINESS_FIELDS for x in (F.lit(f), token(f))]))
    return manifest.select("document_id", "line", truth.alias("truth"), F.col("annotation.field_presence").alias("presence"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of a run; blank lines are skipped."""
    return spark.read.schema(S.RESULT).json(path)


def raw_results(spark: SparkSession, path: str) -> DataFrame:
    """``document_id, engine_id, error_label, prediction`` with the raw tokens of predictions."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    get = lambda p: F.get_json_object("value", p)
    label = F.when(get("$.error").isNotNull(), F.coalesce(get("$.error.label"), F.lit("ERROR")))
    prediction = F.when(get("$.prediction").isNotNull(), F.create_map(*[x for f in S.BUSINESS_FIELDS for x in (F.lit(f), get(f"$.prediction.{f}"))]))
    return raw.select(get("$.document_id").alias("document_id"), get("$.engine_id").alias("engine_id"), label.alias("error_label"), prediction.alias("prediction"))


def read_run_manifest(spark: SparkSession, path: str) -> dict:
    """The one JSON object of a run."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_config(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """Run settings and the table of engines ``id, adapter, params, ordinal`` of a YAML or JSON file."""
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        import yaml

        spec = yaml.safe_load(text)
    except ImportError:
        spec = json.loads(text)
    engines = spec.get("engines") or []
    if not engines:
        raise ValueError(f"{path}: no engines")
    if any("id" not in e or "adapter" not in e for e in engines):
        raise ValueError(f"{path}: an engine lacks id or adapter")
    stem = os.path.splitext(os.path.basename(path))[0]
    run = {"run_id": spec.get("run_id", stem), "manifest": spec.get("manifest")}
    rows = [(e["id"], e["adapter"], {k: str(v) for k, v in (e.get("params") or {}).items()}, i) for i, e in enumerate(engines)]
    return run, spark.createDataFrame(rows, "id string, adapter string, params map<string,string>, ordinal int")


def existing_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a manifest that may have bad lines: what is no object with a string id is ignored."""
    raw = spark.read.text(path)
    v = F.try_parse_json("value")
    found = F.try_variant_get(v, "$.document_id", "variant")
    return raw.where(F.schema_of_variant(found) == "STRING").select(F.get_json_object("value", "$.document_id").alias("document_id")).distinct()


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (*IMAGES, ".pdf")) -> DataFrame:
    """``path, length`` of files below a folder with one of the suffixes in either case, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return files.where(suffix.isin(*suffixes)).orderBy("path")


def _size_of(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of an image; null if there is none that says."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26]) if data[14:18] != b"\x0c\0\0\0" else struct.unpack("<HH", data[18:22])
        return width, abs(height)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        width, height = struct.unpack("<HH", data[26:30])
        return width & 0x3FFF, height & 0x3FFF
    if data[:2] == b"\xff\xd8":
        return _jpeg_size(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return _tiff_size(data)
    return None


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if mark == 0xFF or 0xD0 <= mark <= 0xD8 or mark == 0x01:  # filling, or a mark alone
            at += 1 if mark == 0xFF else 2
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def _tiff_size(data: bytes) -> tuple[int, int] | None:
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(order + "I", data[4:8])[0]
    if at + 2 > len(data):
        return None
    found = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(data):
            return None
        tag, kind = struct.unpack_from(order + "HH", data, entry)
        if tag in (256, 257) and kind in (3, 4):
            found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, entry + 8)[0]
    return (found[256], found[257]) if len(found) == 2 else None


def image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """``path, width, height`` of the images below a folder, read from their headers; null where a header does not say.

    The first ``HEADER_BYTES`` are looked at, of TIFF the whole file, whose directory may be at its end.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    head = F.when(suffix.isin(".tif", ".tiff"), F.col("content")).otherwise(F.substring("content", 1, HEADER_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [_size_of(x.as_py() or b"") or (None, None) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([s[k] for s in sizes], pa.int32()) for k in (0, 1))], ["path", "width", "height"])

    return files.where(suffix.isin(*IMAGES)).select("path", head.alias("head")).mapInArrow(run, "path string, width int, height int")


def source_lines(spark: SparkSession, folder: str, suffix: str = ".py", skip: tuple[str, ...] = SKIP_FOLDERS) -> DataFrame:
    """``path, line`` of source files outside the skipped folders; order inside a file is not kept."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(folder)
    path = F.input_file_name()
    inside = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, skip)))
    return rows.where(~inside).select(path.alias("path"), F.col("value").alias("line"))


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """``document_id, engine_id, text`` of files named ``<document>__<engine>.txt``."""
    rows = spark.read.option("pathGlobFilter", "*__*.txt").text(folder, wholetext=True)
    name = F.regexp_extract(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), r"([^/]*)\.txt$", 1)
    return rows.select(F.regexp_extract(name, r"^(.*)__", 1).alias("document_id"), F.regexp_extract(name, r"__([^_]*(?:_[^_]+)*)$", 1).alias("engine_id"), F.col("value").alias("text"))


def read_packed_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """``document_id, engine_id, text`` of the sidecars that were written as a table."""
    return spark.read.schema("document_id string, engine_id string, text string").parquet(path)


def with_sidecar_text(rows: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Rows with the text of their sidecar, empty where there is none."""
    return rows.join(sidecars, ["document_id", "engine_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def read_batch_summary(spark: SparkSession, path: str) -> DataFrame:
    """``pdf, hits, error`` and the record of every document of a batch summary (``per_pdf`` array)."""
    rows = spark.read.option("multiLine", True).schema(f"per_pdf array<struct<pdf string, hits int, error string, parsed struct<{S.INVOICE}>>>").json(path)
    return rows.select(F.explode("per_pdf").alias("r")).select("r.pdf", "r.hits", "r.error", "r.parsed.*")


def read_packed_summary(spark: SparkSession, path: str) -> DataFrame:
    """``read_batch_summary`` of a summary that was written as a table."""
    rows = spark.read.schema(f"pdf string, hits int, error string, parsed struct<{S.INVOICE}>").json(f"{path}/per_pdf")
    return rows.select("pdf", "hits", "error", "parsed.*")


def resolved_pages(manifest: DataFrame, folder: str) -> DataFrame:
    """Manifest entries with absolute page paths."""
    return manifest.withColumn("pages", F.transform("pages", lambda p: X.resolve_path(p, folder)))


def read_env(path: str) -> dict[str, str]:
    """``KEY=VALUE`` lines of a settings file on the driver. Quotes around values go, bad lines are skipped, the real environment wins."""
    found = {}
    with open(path, encoding="utf-8") as file:
        for line in map(str.strip, file):
            key, sign, value = line.removeprefix("export ").partition("=")
            key, value = key.strip(), value.strip()
            if not line or line.startswith("#") or not sign or not key.isidentifier():
                continue
            if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            found[key] = os.environ.get(key, value)
    return found


def find_env(start: str, most: int = 6) -> str | None:
    """The nearest ``.env`` in a folder or above it."""
    folder = os.path.abspath(start)
    for _ in range(most):
        if os.path.isfile(path := os.path.join(folder, ".env")):
            return path
        folder = os.path.dirname(folder)
    return None
