"""Recognised regions: engine outputs to rows of regions, and regions to text.

Recognition itself is an external model call. What comes back from it, in any of
five shapes, becomes ``array<struct>`` or rows of the one region type.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docscore import schema as S
from docscore.functions import numbers as N
from docscore.functions.regex import strip

# fixed values: language names by engine code, and text of licence and setup failures
LANGUAGES = {"heb": "Hebrew", "he": "Hebrew", "hebrew": "Hebrew", "ara": "Arabic", "ar": "Arabic", "arabic": "Arabic", "eng": "English", "en": "English", "english": "English"}
LICENSE_WORDS = ["license", "trial"]
SETUP_WORDS = ["billing", "permission_denied", "api key", "disabled", "quota"]
SETUP_CODES = [401, 403, 429]

POINTS = "array<struct<x:double,y:double>>"


def rectangle(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The four corners of a box, clockwise from the upper left."""
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(corner(x, y), corner(x + width, y), corner(x + width, y + height), corner(x, y + height))


def bbox_polygon(box: Column) -> Column:
    """``[x0, y0, x1, y1]`` of strings or numbers to corners; null unless four numbers."""
    v = [F.try_element_at(box, F.lit(k + 1)).try_cast("double") for k in range(4)]
    return F.when((F.size(box) == 4) & ~sum((x.isNull().cast("int") for x in v), F.lit(0)).cast("boolean"), rectangle(v[0], v[1], v[2] - v[0], v[3] - v[1]))


def line_polygon(boundary: Column, bbox: Column, cuts: Column) -> Column:
    """The boundary, else the box, else the hull of the cut points (arrays of ``[x, y]``); never invented."""
    points = lambda c: F.transform(c, lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y")))
    xs, ys = F.transform(cuts, lambda p: p[0].cast("double")), F.transform(cuts, lambda p: p[1].cast("double"))
    x0, y0, x1, y1 = F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
    return F.coalesce(F.when(F.size(boundary) > 0, points(boundary)), bbox_polygon(bbox), F.when(F.size(cuts) > 0, rectangle(x0, y0, x1 - x0, y1 - y0)))


def clamp_confidence(value: Column) -> Column:
    """Null for null, text and negative values; at most 1."""
    c = value.try_cast("double")
    return F.when(c >= 0, F.least(c, F.lit(1.0)))


def percent_confidence(value: Column) -> Column:
    c = value.try_cast("double")
    return F.when(c > 1, c / 100).otherwise(c)


def language_name(code: Column, strict: bool = False) -> Column:
    """Engine name of a language; an unknown code passes through, or is null if ``strict``."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    known = F.try_element_at(table, F.lower(code))
    return known if strict else F.coalesce(known, code)


def engine_id(name: Column, template: str, *parts: Column) -> Column:
    """The given id, or one made of its parameters."""
    return F.coalesce(F.nullif(name, F.lit("")), F.format_string(template, *parts))


def error_code(message: Column, code: Column | None = None, label: Column | None = None) -> Column:
    """BLOCKED for licence and setup failures, else the label given, else OCR_FAILURE; null without a message."""
    low = F.lower(message)
    blocked = F.startswith(message, F.lit("BLOCKED:"))
    for word in LICENSE_WORDS + SETUP_WORDS:
        blocked = blocked | F.contains(low, F.lit(word))
    if code is not None:
        blocked = blocked | F.coalesce(code.isin(*SETUP_CODES), F.lit(False))
    given = label if label is not None else F.lit(None).cast("string")
    return F.when(message.isNull(), None).when(blocked | F.coalesce(given == "BLOCKED", F.lit(False)), "BLOCKED").otherwise(F.coalesce(given, F.lit("OCR_FAILURE")))


def words_from_tsv(rows: DataFrame) -> DataFrame:
    """Word rows ``document_id, page, i, left, top, width, height, conf, text`` to regions.

    Blank words go; a negative confidence is null, others are percent; reading order
    counts the kept words of a page in row order, from 0.
    """
    kept = rows.where(F.coalesce(strip(F.col("text")), F.lit("")) != "")
    order = F.row_number().over(Window.partitionBy("document_id", "page").orderBy("i")) - 1
    conf = F.col("conf").try_cast("double")
    return kept.select(
        "document_id", "page", "text", rectangle(F.col("left"), F.col("top"), F.col("width"), F.col("height")).alias("polygon"), F.lit("word").alias("granularity"),
        F.when(conf >= 0, conf / 100).alias("confidence"), order.alias("reading_order"),
    )


def lines_from_recognizer(rows: DataFrame) -> DataFrame:
    """Line rows ``document_id, page, i, text, confidences, boundary, bbox, cuts`` to regions; the confidence is the mean."""
    return rows.select(
        "document_id", "page", "text", line_polygon(F.col("boundary"), F.col("bbox"), F.col("cuts")).alias("polygon"), F.lit("line").alias("granularity"),
        N.mean_of(F.col("confidences")).alias("confidence"), F.col("i").cast("int").alias("reading_order"),
    )


def words_or_lines(words: Column, lines: Column) -> Column:
    """The words, unless none of them has text; then the lines."""
    some = F.filter(words, lambda w: F.coalesce(strip(w["text"]), F.lit("")) != "")
    return F.when(F.size(some) > 0, some).otherwise(F.filter(lines, lambda w: F.coalesce(strip(w["text"]), F.lit("")) != ""))


def regions_from_worker(df: DataFrame, json_col: str = "response") -> DataFrame:
    """Worker responses (JSON text) to rows of regions, with defaults for what is missing.

    ``document_id`` and the error label stay; a response without pages is ``REQUEST_EMPTY``.
    """
    r = F.from_json(json_col, S.WORKER)
    parsed = df.select("document_id", r.alias("r"))
    label = F.when(F.col("r.error").isNotNull(), error_code(F.col("r.error.message"), label=F.col("r.error.label"))).when(F.coalesce(F.size("r.pages"), F.lit(0)) <= 0, "REQUEST_EMPTY")
    pages = parsed.select("document_id", label.alias("error_label"), F.explode_outer("r.pages").alias("p"))
    each = pages.select("document_id", "error_label", "p.page_index", F.posexplode_outer("p.regions").alias("i", "g"))
    points = F.transform(F.col("g.polygon"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return each.select(
        "document_id", "error_label", F.coalesce("page_index", F.lit(0)).alias("page"), F.coalesce("g.text", F.lit("")).alias("text"), points.alias("polygon"),
        F.coalesce("g.granularity", F.lit("word")).alias("granularity"), clamp_confidence(F.col("g.confidence")).alias("confidence"),
        F.coalesce("g.reading_order", "i").alias("reading_order"),
    )


def regions_from_cloud(df: DataFrame, json_col: str = "response") -> DataFrame:
    """Nested cloud responses to word regions; reading order runs through all pages of a document."""
    tree = df.select("document_id", F.posexplode(F.from_json(json_col, S.CLOUD)["pages"]).alias("page", "p"))
    tree = tree.select("document_id", "page", F.posexplode("p.blocks").alias("b", "block")).select("document_id", "page", "b", F.posexplode("block.paragraphs").alias("g", "para"))
    tree = tree.select("document_id", "page", "b", "g", F.posexplode("para.words").alias("w", "word"))
    text = F.array_join(F.transform("word.symbols", lambda s: F.coalesce(s["text"], F.lit(""))), "")
    box = F.col("word.boundingBox")
    corner = lambda p: F.struct(F.coalesce(p["x"], F.lit(0.0)).alias("x"), F.coalesce(p["y"], F.lit(0.0)).alias("y"))
    corners = F.transform(F.coalesce(F.when(F.size(box["vertices"]) > 0, box["vertices"]), box["normalizedVertices"]), corner)
    kept = tree.withColumn("text", text).where(strip(F.col("text")) != "")
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "b", "g", "w")) - 1
    return kept.select("document_id", "page", "text", corners.alias("polygon"), F.lit("word").alias("granularity"), clamp_confidence(F.col("word.confidence")).alias("confidence"), order.alias("reading_order"))


def collect_regions(regions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with its regions in an array; bounded by what one document holds."""
    cells = ["page", "text", "polygon", "granularity", "confidence", "reading_order"]
    return regions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page", "reading_order", "text", "polygon", "granularity", "confidence"))).alias("r")).select(
        *keys, F.transform("r", lambda r: F.struct(*[r[c].alias(c) for c in cells])).alias("regions")
    )


def _fold_lines(ordered: Column, gap: Column, join_null: bool) -> Column:
    """Words of one page in order to lines: a word within the gap of the running height joins the line.

    The running height is the mean of itself and each word that joins.
    """
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("y"), F.lit(False).alias("begun"))

    def step(acc: Column, r: Column) -> Column:
        free = ~r["placed"] & F.lit(join_null)
        joins = acc["y"].isNull() | free | (F.abs(r["y"] - acc["y"]) <= gap)
        height = F.when(free, acc["y"]).when(acc["y"].isNotNull() & (F.abs(r["y"] - acc["y"]) <= gap), (acc["y"] + r["y"]) / 2).otherwise(r["y"])
        border = F.when(~acc["begun"], "").when(joins, " ").otherwise("\n")
        return F.struct(F.concat(acc["text"], border, F.coalesce(r["text"], F.lit(""))).alias("text"), height.alias("y"), F.lit(True).alias("begun"))

    return F.aggregate(ordered, start, step, lambda acc: acc["text"])


def assemble(df: DataFrame, regions: str = "regions", gap_pixels: float | None = None, into: str = "assembled_text") -> DataFrame:
    """Add the text of an array of regions: words to lines, lines to pages, an empty line between pages.

    Within a page regions go by reading order (null is 0), equal ones as they stand.
    The gap is 0.6 of the upper median height (20 if no region has height), or
    ``gap_pixels``; with that, a region without polygon joins the current line. Null
    and empty arrays give the empty text.
    """
    placed = F.transform(F.col(regions), lambda r, i: F.struct(
        r["page"].alias("page"), F.coalesce(r["reading_order"], F.lit(0)).alias("o"), i.alias("i"), r["text"].alias("text"),
        N.center_y(r["polygon"]).alias("y"), N.extent_y(r["polygon"]).alias("h"), r["polygon"].isNotNull().alias("placed"),
    ))
    df = df.withColumn("_r", F.array_sort(placed))
    df = df.withColumn("_pages", F.transform(F.array_distinct(F.transform("_r", lambda r: r["page"])), lambda p: F.filter("_r", lambda r: r["page"].eqNullSafe(p))))

    def page_text(mine: Column) -> Column:
        heights = F.filter(F.transform(mine, lambda r: r["h"]), lambda h: h > 0)
        gap = F.lit(float(gap_pixels)) if gap_pixels is not None else 0.6 * F.coalesce(N.upper_median(heights), F.lit(20.0))
        pair = F.struct(mine.alias("m"), gap.alias("gap"))
        return F.transform(F.array(pair), lambda x: _fold_lines(x["m"], x["gap"], gap_pixels is not None))[0]

    text = F.array_join(F.transform("_pages", page_text), "\n\n")
    return df.withColumn(into, F.coalesce(text, F.lit(""))).drop("_r", "_pages")


def assembled_lines(regions: DataFrame, keys: list[str], gap_pixels: float | None = None) -> DataFrame:
    """``keys..., page, line, text``: the lines of each page, from rows of regions (see ``assemble`` for the rules).

    No document and no page is ever an array: rows are dealt by page, sorted inside
    their partitions and read one after the other with the line at hand carried along.
    The height that sets the gap is a percentile of the page, found by an aggregation.
    Regions of one place in the reading order go by text, polygon, granularity and
    confidence. Null keys and pages are groups like any other.
    """
    rows = regions.withColumns({"_o": F.coalesce("reading_order", F.lit(0)), "_y": N.center_y(F.col("polygon")), "_h": N.extent_y(F.col("polygon")), "_placed": F.col("polygon").isNotNull()})
    spot = [*keys, "page"]
    if gap_pixels is None:
        # of two middle heights the larger
        middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY IF(_h > 0, _h, NULL) DESC)")
        pages = rows.groupBy(*spot).agg((0.6 * F.coalesce(middle, F.lit(20.0))).alias("_gap")).withColumnsRenamed({c: f"_{c}" for c in spot})
        rows = rows.join(pages, reduce(lambda a, b: a & b, (rows[c].eqNullSafe(pages[f"_{c}"]) for c in spot)))
    else:
        rows = rows.withColumn("_gap", F.lit(float(gap_pixels)))
    tail = ["reading_order", "text", "polygon", "granularity", "confidence"]
    ordered = rows.repartition(*spot).sortWithinPartitions(*[F.asc_nulls_first(c) for c in [*spot, "_o", *tail]]).select(*spot, "text", "_y", "_gap", "_placed")
    width, free_joins = len(spot), gap_pixels is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words, height, line, names = None, [], None, 0, None

        def flush(done: list[tuple]) -> None:
            if words:
                done.append((*at, line, " ".join(words)))

        def made(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, names.types, strict=True)], names.names)

        for batch in batches:
            names = names or pa.schema([*(batch.schema.field(k) for k in range(width)), ("line", pa.int64()), ("text", pa.string())])
            done: list[tuple] = []
            for *spot_now, text, y, gap, placed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = tuple(spot_now)
                free = free_joins and not placed
                if now != at:
                    flush(done)
                    at, words, height, line = now, [], None, 0
                joins = height is None or free or abs(y - height) <= gap
                if words and not joins:
                    flush(done)
                    words, line = [], line + 1
                words.append(text or "")
                if not free:
                    height = (height + y) / 2 if height is not None and abs(y - height) <= gap else y
            yield made(done)
        if names is not None:
            done = []
            flush(done)
            yield made(done)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields[:width])
    return ordered.mapInArrow(run, f"{types}, line long, text string")


def joined_pages(lines: DataFrame, keys: list[str], into: str = "assembled_text") -> DataFrame:
    """One row per key with its lines as one text, an empty line between pages: the text of a document is one value."""
    each = F.array_sort(F.collect_list(F.struct("page", "line", "text")))
    border = lambda r, i: F.when(i == 0, "").when(r["line"] == 0, "\n\n").otherwise("\n")
    whole = F.array_join(F.transform("_l", lambda r, i: F.concat(border(r, i), r["text"])), "")
    return lines.groupBy(*keys).agg(each.alias("_l")).withColumn(into, whole).drop("_l")


def confident_words(regions: DataFrame, k: int = 15, by: list[str] | None = None) -> DataFrame:
    """The ``k`` words with the highest confidence, ties in the order of ``by``; those without one do not count."""
    return regions.where("confidence IS NOT NULL").orderBy(F.desc("confidence"), *(by or ["text"])).limit(k)


def bag_union(tables: dict[str, DataFrame], origin: str = "origin") -> DataFrame:
    """All rows of several tables with the name of their table; a column that a table lacks is null there."""
    named = [df.select(F.lit(name).alias(origin), *df.columns) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def confident_boxes(regions: DataFrame, least: float = 50.0) -> DataFrame:
    return regions.where(F.col("conf") >= least)


ADAPTERS = {"tesseract": words_from_tsv, "kraken": lines_from_recognizer, "ironocr": regions_from_worker, "abbyy": regions_from_worker, "cloud": regions_from_cloud}


def regions_of(adapter: str, rows: DataFrame) -> DataFrame:
    """Regions of the rows that an engine's adapter returned; an unknown adapter is an error."""
    if adapter not in ADAPTERS:
        raise ValueError(f"unknown adapter {adapter!r}; known: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[adapter](rows)


def engine_params(params: dict[str, str], folder: str) -> dict[str, str]:
    """Parameters with ``~`` and relative paths of ``*_path``, ``*_dir`` and ``model*`` keys expanded from the configuration's folder."""
    out = {}
    for key, value in params.items():
        if key.endswith(("_path", "_dir")) or key.startswith("model"):
            value = os.path.expanduser(value)
            value = value if os.path.isabs(value) else os.path.join(folder, value)
        out[key] = value
    return out
