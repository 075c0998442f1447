"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so a question asked again with
other parameters has the same template. Windows of template words are hashed, and
the windows of documents are joined to those of benchmark items. What the slots of
matched windows hold is then compared: on one alignment of an item with a document
every slot value must stand for one value throughout and no two for the same, or the
window does not count.

To reach a coverage an item must share at least one of its rarest windows, enough of
them that the others alone fall short. Only these are joined to find which items may
be in a document, so a phrase that many items and many documents have meets nothing
by itself.

An item is looked for in three ways: with capitalised words inside sentences as
names, with those that begin a sentence as names too unless they are ordinary
words, and word for word in lower case.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docscore.llm.storage import Workspace, free_name

WIDTH = 5
LEAST_COVERAGE = 0.8
LEAST_LITERAL = 2
BROADCAST_WINDOWS = 1_000_000
CACHE_WORDS = 150_000
FILTER_BITS = 22
BASE = np.uint64(0xD6E8FEB86659FD93)

# fixed values: units that follow a number
UNITS = frozenset(
    "mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years pa kpa bar atm j kj cal kcal w kw mw kwh v kv a ma hz khz mhz ghz k c f n mph kmh kph mb gb tb kb bit bits byte "
    "bytes px percent degree degrees dollar dollars euro euros cent cents usd eur gbp meter meters metre metres kilometer kilometers gram grams "
    "kilogram kilograms liter liters litre litres mile miles foot feet inch inches pound pounds".split()
)

# fixed values: numbers in words ("one" is more often none)
NUMBER_WORDS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty "
    "fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)

# fixed values: words that begin sentences without being names
ORDINARY = frozenset(
    "a about above according across after again all almost along already also although always among an and another any anyone anything are as ask "
    "assume assuming at because before begin below beside besides between both but by calculate can choose compare complete compute consider "
    "convert could count decide define derive describe determine did do does draw during each either else estimate evaluate even eventually every "
    "everyone everything except explain express factor few final finally find first for former four from further give given gives had half has have "
    "he hence her here hers his how however i if imagine in initially inside instead into is it its itself just know last later latter least less "
    "let like list look many maybe meanwhile more moreover most much must my name near neither never next no nobody none nor not nothing now of off "
    "often on once one only or other others our out outside over per perhaps please prove put read right round say second select several she should "
    "show simplify since six so solve some someone something sometimes soon state still such suppose take tell than that the their them then there "
    "therefore these they third this those three through throughout thus to today together tomorrow too two under unless until up upon use using "
    "usually very was we were what whatever when whenever where whether which while who whoever whom whose why with within without would write "
    "yesterday yet you your".split()
)

NUMBER = re.compile(r"[+\-−]?[$€£]?\d[\d.,:/]*(?:[%°]|[A-Za-zµ²³]{1,4})?[€£$]?", re.ASCII)
EDGES = re.compile(r"^[^\w$€£+\-−]+|[^\w%°€£$²³]+$")
LITERAL, CAPITAL, ENDS, IS_NUMBER, IS_UNIT, EMPTY, IS_ORDINARY = 0, 1, 2, 4, 8, 16, 32
FLAGS = 64
# the ways of looking for an item, and what sets windows of the last apart
INSIDE, STARTS, VERBATIM = 0, 1, 2
VERBATIM_MARK = np.uint64(xxhash.xxh64_intdigest("\x00verbatim"))
NUMBER_HASH, UNIT_HASH, NAME_HASH = (np.uint64(xxhash.xxh64_intdigest(x) // FLAGS * FLAGS) for x in ("\x00number", "\x00unit", "\x00name"))


def core(word: str) -> str:
    return EDGES.sub("", word)


class Words(dict):
    """Hash of the lower-cased word with its properties in the low bits, remembered within a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        inner = core(word)
        low = inner.lower()
        flags = EMPTY if not inner else 0
        if word.rstrip("\"')]»”’")[-1:] in ".!?:":
            flags |= ENDS
        if NUMBER.fullmatch(inner) or low in NUMBER_WORDS:
            flags |= IS_NUMBER
        elif low in UNITS:
            flags |= IS_UNIT
        if inner[:1].isupper() and not inner.isupper():  # words all in capitals are no names
            flags |= CAPITAL | (IS_ORDINARY if low in ORDINARY else 0)
        found = self[word] = xxhash.xxh64_intdigest(low) // FLAGS * FLAGS | flags
        return found


_WORDS = Words()


def templates(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of a text, and for each way a row of their canonical hashes and of which are slots.

    A number is a slot, in digits or in a word; a unit is one after a number; a capitalised word is a name
    unless it is all in capitals or begins the text or a sentence, and by ``STARTS``
    there too unless it is an ordinary word. By ``VERBATIM`` nothing is a slot. Words
    without a letter or digit go.
    """
    words = (text or "").split()
    each = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    flags = (each & np.uint64(FLAGS - 1)).astype(np.uint8)
    empty = (flags & EMPTY) != 0
    if empty.any():
        ends = np.flatnonzero(empty & ((flags & ENDS) != 0))
        flags[ends[ends > 0] - 1] |= ENDS
        keep = ~empty
        words, each, flags = [w for w, k in zip(words, keep, strict=True) if k], each[keep], flags[keep]
    number = (flags & IS_NUMBER) != 0
    after_number, inside = np.zeros(len(flags), bool), np.zeros(len(flags), bool)
    after_number[1:] = number[:-1]
    inside[1:] = (flags[:-1] & ENDS) == 0
    unit = ((flags & IS_UNIT) != 0) & after_number
    capital = ((flags & CAPITAL) != 0) & ~number & ~unit
    hashes = np.empty((3, len(flags)), np.uint64)
    hashes[:] = each & ~np.uint64(FLAGS - 1)
    slots = np.zeros((3, len(flags)), bool)
    hashes[:VERBATIM, number], hashes[:VERBATIM, unit] = NUMBER_HASH, UNIT_HASH
    for way, name in ((INSIDE, capital & inside), (STARTS, capital & (inside | ((flags & IS_ORDINARY) == 0)))):
        hashes[way, name] = NAME_HASH
        slots[way] = number | unit | name
    return words, hashes, slots


def template(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of a text, their canonical hashes, and which of them are slots; names inside sentences only."""
    words, hashes, slots = templates(text)
    return words, hashes[INSIDE], slots[INSIDE]


def windows(hashes: np.ndarray, slots: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """By way, the hash of each window of ``width`` words, and whether it has enough literal words."""
    n = hashes.shape[1] - width + 1
    if n <= 0:
        return np.empty((3, 0), np.uint64), np.empty((3, 0), bool)
    out = hashes[:, :n].copy()
    for k in range(1, width):
        out *= BASE
        out += hashes[:, k : k + n]
    out ^= out >> np.uint64(31)
    out *= BASE
    out ^= out >> np.uint64(29)
    out[VERBATIM] ^= VERBATIM_MARK
    literal = np.zeros((3, hashes.shape[1] + 1), np.int64)
    np.cumsum(~slots, axis=1, out=literal[:, 1:])
    good = literal[:, width:] - literal[:, :-width] >= LEAST_LITERAL
    # one word says something only where it is the whole text
    good[VERBATIM] = width > 1 or hashes.shape[1] == 1
    return out, good


class Kept:
    """Windows found so far, by column."""

    NAMES = ["row", "id", "text_sha256", "pos", "way", "width", "slots"]

    def __init__(self, kind: pa.DataType):
        self.kind, self.hashes = kind, []
        self.columns: list[list] = [[] for _ in self.NAMES]

    def __len__(self) -> int:
        return len(self.columns[0])

    def add(self, *cells) -> None:
        for column, cell in zip(self.columns, cells, strict=True):
            column.append(cell)

    def batch(self) -> pa.RecordBatch:
        types = [pa.int64(), self.kind, pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())]
        *arrays, slots = (pa.array(c, t) for c, t in zip(self.columns, types, strict=True))
        flat = np.concatenate([np.empty(0, np.uint64), *self.hashes]).view(np.int64)
        return pa.RecordBatch.from_arrays([*arrays, pa.array(flat, pa.int64()), slots], [*self.NAMES[:-1], "window", "slots"])


def window_rows(table: DataFrame, id_col: str, text_col: str, widths: list[int], wanted=None, items: bool = False) -> DataFrame:
    """``row, id, text_sha256, pos, way, width, window, slots``: windows of the template words and the lower-cased contents of their slots.

    With ``wanted`` (a broadcast sorted array of hashes) only those windows. ``items``
    have windows of the first width in each way, shorter ones one of all their words.
    Elsewhere a window that is the same in both ways of names comes once.
    """
    picked = table.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        some = None if wanted is None else wanted.value
        if some is not None:
            near = np.zeros(1 << FILTER_BITS, bool)
            near[some >> np.uint64(64 - FILTER_BITS)] = True
        for batch in batches:
            kept = Kept(batch.schema.field("id").type)
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                row += 1
                text, digest = text.as_py(), None
                words, hashes, is_slot = templates(text)
                for width in [min(widths[0], max(1, len(words)))] if items else widths:
                    each, good = windows(hashes, is_slot, width)
                    if not items:
                        good[STARTS] &= each[STARTS] != each[INSIDE]
                    if some is not None:
                        way, at = np.nonzero(near[each >> np.uint64(64 - FILTER_BITS)] & good)
                        if len(at):
                            place = np.minimum(np.searchsorted(some, each[way, at]), len(some) - 1)
                            hit = some[place] == each[way, at]
                            way, at = way[hit], at[hit]
                    else:
                        way, at = np.nonzero(good)
                    if len(at) and digest is None:
                        digest = hashlib.sha256((text or "").encode("utf-8", "replace")).hexdigest()
                    for w, p in zip(way.tolist(), at.tolist(), strict=True):
                        slots = [core(words[p + k]).lower() for k in range(width) if is_slot[w, p + k]]
                        kept.add(row, key.as_py(), digest, p, w, width, slots)
                    kept.hashes.append(each[way, at])
                if len(kept) > 50_000:
                    yield kept.batch()
                    kept = Kept(kept.kind)
            yield kept.batch()
        _WORDS.clear()  # the worker lives on

    return picked.mapInArrow(run, f"row long, id {kind}, text_sha256 string, pos long, way int, width int, window long, slots array<string>")


def sized(asked: DataFrame, least: float) -> DataFrame:
    """``asked`` with ``n_windows``, how many distinct windows the item has that way, and
    ``key``: is the window among the rarest, one of which a document must have to reach ``least``?"""
    each = asked.select("item", "way", "window").distinct()
    spread = each.groupBy("window").agg(F.countDistinct("item").alias("n_items"))
    whole = Window.partitionBy("item", "way")
    each = each.join(spread, "window").select(
        "item", "way", "window", F.count("*").over(whole).alias("n_windows"), F.row_number().over(whole.orderBy("n_items", "window")).alias("place")
    )
    needed = F.greatest(F.ceil(F.col("n_windows") * least - 1e-6), F.lit(1))
    each = each.select("item", "way", "window", "n_windows", (F.col("place") <= F.col("n_windows") - needed + 1).alias("key"))
    return asked.join(each, ["item", "way", "window"])


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    least: float = LEAST_COVERAGE,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Pairs of documents and the benchmark items they contain, as asked or with other parameters.

    Columns ``row, doc_id, text_sha256, item_id, coverage, n_windows, n_slots, n_changed,
    reparameterised``: the share of an item's distinct template windows that the
    document has with consistent slots, at least ``least``; how many distinct windows
    the item has; its slot values, and how many hold another value in the document.
    Of the three ways the first that reaches ``least`` counts; word for word, nothing
    is a slot. A window of either way of names is met by one of either.
    ``row`` numbers the input rows, so repeated rows and null ids are told apart.

    Null and empty texts contain nothing. Items with fewer than ``width`` words are one
    window of all their words, one of a single word is found where it is the whole text.
    Items without a window of two literal words are found word for word only. Items that
    repeat are separate items. Ids may be of any type. Empty tables give no rows; other
    columns are never read.

    The hashes of up to ``broadcast_windows`` windows of the benchmark (8 bytes each) are
    broadcast to skip the other windows of documents; beyond that all of these are joined.
    """
    items = benchmark.select(F.monotonically_increasing_id().alias("copy"), F.col("item_id").alias("item_id"), F.col("text").alias("text"))
    asked = window_rows(items, "item_id", "text", [width], items=True).select(
        F.col("row").alias("item"), F.col("id").alias("item_id"), "way", "width", F.col("pos").alias("item_pos"), "window", F.col("slots").alias("item_slots")
    )
    spark = docs.sparkSession
    work = Workspace(spark, "decontam")
    asked = work.write(asked, "asked")
    widths = [width, *sorted(r[0] for r in asked.where(F.col("width") < width).select("width").distinct().collect())]
    asked = work.write(sized(asked.drop("width"), least), "sized")
    hashes = [r[0] for r in asked.select("window").distinct().limit(broadcast_windows + 1).collect()]
    if len(hashes) <= broadcast_windows:
        wanted = spark.sparkContext.broadcast(np.sort(np.array(hashes, np.int64).view(np.uint64)))
        found = window_rows(docs if hashes else docs.limit(0), id_col, text_col, widths, wanted)
    else:
        known = work.write(asked.select("window").distinct(), "windows")
        found = window_rows(docs, id_col, text_col, widths).join(known, "window", "left_semi")
    # documents are read once: what they share with any item is written
    found = work.write(found.drop("way", "width"), "found")
    # written, so that Spark splits a window that a third of all documents have
    keys = work.write(asked.where("key").select("item", "way", "window").distinct(), "keys")
    maybe = found.select("row", "window").join(keys, "window")
    maybe = work.write(maybe.select("row", "item", "way").distinct(), "maybe")
    hits = maybe.join(asked.drop("key"), ["item", "way"]).join(found, ["row", "window"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    hits = work.write(hits, "hits")
    one = ["row", "id", "text_sha256", "item", "item_id", "way", "n_windows"]
    plain = hits.where(F.size("slots") == 0).select(*one, "window", F.lit(0).alias("n"), F.lit(0).alias("wrong"))
    pairs = hits.where(F.size("slots") > 0).select(
        *one, "window", "shift", "pos", F.explode(F.arrays_zip(F.col("item_slots").alias("asked"), F.col("slots").alias("said"))).alias("pair")
    ).select(*one, "window", "shift", "pos", "pair.asked", "pair.said")
    # an alignment has no more pairs than its item has slots
    align = ["row", "item", "way", "shift"]
    pairs = pairs.repartition(*align).withColumn("votes", F.count("*").over(Window.partitionBy(*align, "asked", "said")))
    pairs = pairs.withColumn("rule", F.max_by("said", F.struct("votes", "said")).over(Window.partitionBy(*align, "asked")))
    pairs = pairs.withColumn("back", F.max_by("asked", F.struct("votes", "asked")).over(Window.partitionBy(*align, "said")))
    wrong = F.count_if((F.col("said") != F.col("rule")) | (F.col("asked") != F.col("back")))
    judged = pairs.groupBy(*one, "window", "shift", "pos").agg(F.count("*").alias("n"), wrong.alias("wrong"))
    kept = plain.unionByName(judged.select(plain.columns)).where("wrong = 0")
    covered = kept.groupBy(*one).agg(F.countDistinct("window").alias("found"))
    covered = covered.withColumn("coverage", F.col("found") / F.col("n_windows")).where(F.col("coverage") >= least)
    covered = covered.groupBy(*one[:5]).agg(F.min_by(F.struct("way", "n_windows", "coverage"), "way").alias("best"))
    covered = covered.select(*one[:5], "best.*")
    changes = pairs.groupBy("row", "item", "way", "asked").agg(F.max((F.col("asked") == F.col("rule")).cast("int")).alias("same"))
    changes = changes.groupBy("row", "item", "way").agg(F.count("*").alias("n_slots"), F.count_if(F.col("same") == 0).alias("n_changed"))
    return covered.join(changes, ["row", "item", "way"], "left").select(
        "row",
        F.col("id").alias("doc_id"),
        "text_sha256",
        "item_id",
        F.round("coverage", 6).alias("coverage"),
        "n_windows",
        F.coalesce("n_slots", F.lit(0)).alias("n_slots"),
        F.coalesce("n_changed", F.lit(0)).alias("n_changed"),
        (F.coalesce("n_changed", F.lit(0)) > 0).alias("reparameterised"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, without those whose text contains a benchmark item.

    Texts decide, not ids: rows with a null id or one that others share stay unless
    their own text is contaminated. Null and empty texts stay. An empty table gives no
    rows, an empty benchmark drops none; columns of any name are kept.
    """
    name = free_name(docs, "__text")
    bad = contaminated(docs, benchmark, id_col, text_col).select(F.col("text_sha256").alias(name)).distinct()
    bad = Workspace(docs.sparkSession, "decontam").write(bad, "bad")
    said = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    return docs.withColumn(name, said).join(bad, name, "left_anti").drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row", "text_sha256")
