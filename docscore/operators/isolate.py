"""Stages that fail for a row, not for the job.

A row that a stage cannot handle keeps its other columns, gets null for the result and
an error that names the stage; later stages pass it over. All other rows go on.
"""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# fixed values: labels of failures by stage, and the beginning of a message that makes one a blocked engine
PAGE_LOAD_ERROR, OCR_FAILURE, EXTRACT_FAILURE, BLOCKED = "PAGE_LOAD_ERROR", "OCR_FAILURE", "EXTRACT_FAILURE", "BLOCKED"
BLOCKED_MARK = "BLOCKED:"

ERROR = "struct<label string, message string, traceback string>"
_ERROR = pa.struct([("label", pa.string()), ("message", pa.string()), ("traceback", pa.string())])


def with_error(df: DataFrame) -> DataFrame:
    """``df`` with the columns ``error`` and ``timings_ms`` that stages fill, where it has none."""
    fresh = {"error": F.lit(None).cast(ERROR), "timings_ms": F.create_map().cast("map<string,double>")}
    return df.withColumns({name: value for name, value in fresh.items() if name not in df.columns})


def error_of(exc: BaseException, label: str, blockable: bool) -> dict[str, str | None]:
    message = str(exc)
    if blockable and message.startswith(BLOCKED_MARK):
        return {"label": BLOCKED, "message": message, "traceback": None}
    return {"label": label, "message": message, "traceback": "".join(traceback.format_exception(exc, limit=3))}


def stage(df: DataFrame, name: str, label: str, run: Callable[..., Any], inputs: list[str | Column], kind: str, blockable: bool = False) -> DataFrame:
    """Add ``name``, the result of ``run`` for each row, as type ``kind``.

    Any exception of ``run``, or a result that is not of the type, gives null and
    ``error`` with the label, the message and the end of the traceback; with
    ``blockable`` a message that begins with ``BLOCKED:`` is a blocked engine instead. Rows
    that have an error already are not run. ``timings_ms`` gets the milliseconds of rows
    that were run, failed ones too. A worker that dies is retried by Spark like any task.
    """
    arrow = to_arrow_type(T.StructType.fromDDL(f"value {kind}")["value"].dataType)
    result = pa.struct([("value", arrow), ("error", _ERROR), ("ms", pa.float64())])

    @F.arrow_udf(f"struct<value {kind}, error {ERROR}, ms double>")
    def isolated(skip: pa.Array, *columns: pa.Array) -> pa.Array:
        out = []
        for done, *cells in zip(skip, *columns, strict=True):
            if done.as_py():
                out.append(None)
                continue
            began, value, error = time.perf_counter(), None, None
            try:
                value = pa.scalar(run(*(c.as_py() for c in cells)), arrow).as_py()
            except Exception as exc:
                error = error_of(exc, label, blockable)
            out.append({"value": value, "error": error, "ms": (time.perf_counter() - began) * 1000})
        return pa.array(out, result)

    df = with_error(df)
    df = df.withColumn("_r", isolated(F.col("error").isNotNull(), *[F.col(c) if isinstance(c, str) else c for c in inputs]))
    return df.withColumns({
        name: F.col("_r.value"), "error": F.coalesce("error", "_r.error"),
        "timings_ms": F.when(F.col("_r").isNull(), F.col("timings_ms")).otherwise(F.map_concat("timings_ms", F.create_map(F.lit(f"{name}_ms"), F.col("_r.ms")))),
    }).drop("_r")


def parsed(df: DataFrame, name: str, label: str, text: str, schema: str) -> DataFrame:
    """Add ``name``, the JSON object of column ``text``, in the JVM; text that is no such object is an error, as is null."""
    df = with_error(df)
    got = F.from_json(F.col(text), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = df.withColumn("_r", F.when(F.col("error").isNull(), got))
    bad = F.col("error").isNull() & (F.col("_r").isNull() | F.col("_r._bad").isNotNull())
    said = F.concat(F.lit("no such object: "), F.coalesce(F.left(F.col(text), F.lit(200)), F.lit("null")))
    error = F.struct(F.lit(label).alias("label"), said.alias("message"), F.lit(None).cast("string").alias("traceback"))
    fields = [f.name for f in T.StructType.fromDDL(schema)]
    value = F.struct(*[F.col(f"_r.{c}").alias(c) for c in fields])
    return df.withColumns({name: F.when(F.col("_r").isNotNull() & ~bad, value), "error": F.when(bad, error).otherwise(F.col("error"))}).drop("_r")


def run_documents(
    df: DataFrame, load: Callable, recognize: Callable, extract: Callable, pages: list[str | Column], page_kind: str, text_kind: str, record_kind: str
) -> DataFrame:
    """The three stages of a run over documents: ``page``, ``assembled_text``, ``prediction``, with ``error`` and ``timings_ms``.

    Rows with an ``error`` from the start, of engines that did not load, are passed over.
    """
    df = stage(df, "page", PAGE_LOAD_ERROR, load, pages, page_kind)
    df = stage(df, "assembled_text", OCR_FAILURE, recognize, ["page"], text_kind, blockable=True)
    return stage(df, "prediction", EXTRACT_FAILURE, extract, ["assembled_text"], record_kind).drop("page")
