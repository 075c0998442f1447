"""Toxicity by a weighted lexicon matched with Aho-Corasick on folded text.

Folding maps homoglyphs, accents and digit substitutions to plain letters and
punctuation to spaces. Lexicon entries are word beginnings and whole words with
weights learned from labels. Exception phrases, a matched word with its neighbour,
are learned from the labels too: those whose documents are clean although the word
is mostly toxic. One automaton finds the entries and the exception phrases; a match
inside an exception phrase does not count. The summed weight is normalised by length
and mapped to a score by a fitted logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscore.llm.storage import Workspace

# fixed values: what stands for a letter
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
CYRILLIC = dict(zip("абвгеѕзіјкмнорстухћԁԛԝ", "abbresziikmhopctyxhdqw", strict=True)) | {"з": "3", "ј": "j", "ԍ": "g", "һ": "h", "ӏ": "l", "ь": "b"}
GREEK = dict(zip("αβγεζηικνορτυχω", "abyeznikvoptuxw", strict=True))
LATIN = {"ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ƒ": "f", "æ": "ae", "œ": "oe", "ß": "ss"}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

TRAIN_ROWS = 20_000
COUNTED_AT_ONCE = 100_000
SHORTEST, LONGEST = 3, 9
LEAST_DOCS = 3
LEAST_ODDS = 2.0
SHINGLE = 5
HELD_OUT_OF = 5


def _fold_table() -> dict[int, str | None]:
    """Code point to folded text; built from the letters above, decompositions and compatibility forms.

    What a code point becomes is folded again, so text that is folded stays as it is.
    """
    letters = CYRILLIC | GREEK | LATIN
    table: dict[int, str | None] = {ord(c): " " for c in "\t\n\x0b\x0c\r\"#%&'()*+,-./:;<=>?[\\]^_`{|}~¡¿«»‘’“”„…–—·"}
    blocks = ((0xA0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0x2100, 0x2150), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x2500))
    for code in [*(c for a, b in blocks for c in range(a, b)), *map(ord, letters)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if not unicodedata.combining(c))
        plain = "".join(letters.get(c, c) for c in plain)
        plain = "".join(DIGITS.get(c, c) for c in plain)
        if plain != chr(code) and plain.isalnum():
            table[code] = plain
    table.update({ord(c): letter for c, letter in DIGITS.items()})
    table.update(dict.fromkeys([*map(ord, INVISIBLE), *range(0x300, 0x370)]))
    return table


FOLD = _fold_table()
SPACES = re.compile("  +")


def fold(text: str | None) -> str:
    """Folded text between single spaces."""
    plain = SPACES.sub(" ", (text or "").lower().translate(FOLD))
    return f" {plain.strip(' ')} "


@dataclass
class Model:
    """Entries with their weights, exception phrases and the curve from weight to score; as large as the labelled sample allows."""

    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = -4.0
    exceptions: tuple[str, ...] = ()

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            made.add_word(" " + entry, (1 + len(entry), weight))
        for phrase in self.exceptions:
            made.add_word(fold(phrase), (len(fold(phrase)), None))
        made.add_word("\x00", (1, 0.0))  # never empty
        made.make_automaton()
        return made


def weight_in(automaton: ahocorasick.Automaton, folded: str) -> float:
    """Summed weight of the matches outside exception phrases, by length.

    Of entries that begin at the same place only the heaviest counts, and repeats of
    one entry count by the logarithm of their number. The sum is divided by the logarithm of the number of words, so a long text needs more.
    """
    best: dict[int, tuple[float, str]] = {}
    excepted: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            excepted.append((start, end))
        elif weight > best.get(start, (0.0, ""))[0]:
            best[start] = (weight, folded[start : end + 1])
    if not best:
        return 0.0
    counts = Counter(hit for at, hit in best.items() if not any(a <= at < b for a, b in excepted))
    total = sum(weight * (1 + math.log(n)) for (weight, _), n in counts.items())
    return total / (1.0 + math.log(1 + folded.count(" ")))


def held_out(id_col: Column, of: int = HELD_OUT_OF) -> Column:
    """Is the row kept from training? A null id counts as the empty text, so it is."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % of == 0


def _beginnings(folded: str) -> set[str]:
    """The beginnings of the words up to ``LONGEST`` letters, and longer words as a whole."""
    found = set()
    for word in set(folded.split(" ")):
        for size in range(SHORTEST, min(LONGEST, len(word)) + 1):
            found.add(word[:size])
        if len(word) > LONGEST:
            found.add(word)
    return found


def _phrases(folded: str, weights: dict[str, float]) -> dict[str, str]:
    """Each word that has an entry together with the word before and the word after it, and the entry."""
    words = folded.split()
    found = {}
    for k, word in enumerate(words):
        heads = (word[:size] for size in range(SHORTEST, min(LONGEST, len(word)) + 1))
        entry = next((h for h in heads if h in weights), word if word in weights else None)
        if entry:
            found |= {" ".join(words[a : a + 2]): entry for a in (k - 1, k) if 0 <= a < len(words) - 1}
    return found


def sketch(text: str | None) -> int:
    """The smallest hash of the word shingles of a text; copies mostly share it."""
    words = fold(text).split()
    joined = (" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1)))
    return min(map(xxhash.xxh64_intdigest, joined)) >> 1


def _by_chance(t: int, n: int, share: float) -> float:
    """Bound of the log probability that at least ``t`` of ``n`` documents are toxic when ``share`` of all are."""
    found = t / n
    if found <= share:
        return 0.0
    rest = (1 - found) * math.log((1 - found) / (1 - share)) if found < 1 else 0.0
    return -n * (found * math.log(found / share) + rest)


def _passing(counts: DataFrame, toxic: int, clean: int, tested: int) -> DataFrame:
    """The beginnings ``choose_entries`` accepts, but for a margin of rounding, in its order."""
    t, c, share = F.col("bad"), F.col("clean"), toxic / max(1, toxic + clean)
    odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    passed = counts.where((t >= LEAST_DOCS) & (odds >= LEAST_ODDS - 1e-6))
    if 0 < share < 1:
        found = t / (t + c)
        rest = F.when(c > 0, (1 - found) * F.log((1 - found) / (1 - share))).otherwise(0.0)
        chance = F.when(found <= share, 0.0).otherwise(-(t + c) * (found * F.log(found / share) + rest))
        passed = passed.where(chance < -math.log(max(tested, 1)) + 1e-6)
    return passed.orderBy(F.desc(odds - 2 * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))), F.length("entry").desc(), "entry")


def choose_entries(counts: list[tuple[str, int, int]], toxic: int, clean: int, tested: int) -> dict[str, float]:
    """Entries and weights from ``(beginning, toxic documents, clean documents)``.

    An entry must be so unlikely by chance that of ``tested`` beginnings less than one
    would pass. They are ranked by a lower bound of the log odds; a beginning is left
    out where an accepted shorter or longer one explains it.
    """
    ranked = []
    share = toxic / max(1, toxic + clean)
    for entry, t, c in counts:
        odds = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        if t >= LEAST_DOCS and odds >= LEAST_ODDS and _by_chance(t, t + c, share) < -math.log(max(tested, 1)):
            ranked.append((odds - 2 * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)), -len(entry), entry, odds))
    chosen: dict[str, float] = {}
    heads: set[str] = set()  # beginnings of accepted entries
    for _, _, entry, odds in sorted(ranked, key=lambda r: (-r[0], r[1], r[2])):
        sizes = range(SHORTEST, min(len(entry), LONGEST + 1))
        if entry in heads or any(entry[:k] in chosen for k in sizes):
            continue
        chosen[entry] = odds
        heads.update(entry[:k] for k in sizes)
    return chosen


def choose_exceptions(counts: list[tuple[str, str, int, int]], entries: dict[str, tuple[int, int]]) -> tuple[str, ...]:
    """Phrases from ``(phrase, entry, toxic documents, clean documents)``, given the entries' ``(toxic, clean)`` documents.

    At the entry's toxic share, so few toxic documents among those of the phrase must
    be so unlikely by chance that less than one of all phrases would pass.
    """
    chosen = []
    for phrase, entry, t, c in counts:
        bad, clean = entries[entry]
        share = clean / max(1, bad + clean)
        if t <= c and c >= LEAST_DOCS and share < 1 and _by_chance(c, t + c, share) < -math.log(len(counts)):
            chosen.append(phrase)
    return tuple(sorted(chosen))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small ridge.

    Where most rows are toxic they weigh as much as the clean ones together: such
    labels were picked, and a text without entries must not be toxic by their share.
    """
    if not len(y) or y.min() == y.max():
        return Model.slope, Model.offset
    weight = np.where(y > 0, min(1.0, (len(y) - y.sum()) / y.sum()), 1.0)
    a = np.column_stack([x, np.ones(len(x))])
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        grad = a.T @ (weight * (p - y)) / len(y) + ridge * theta * (1, 0)
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a / len(y) + np.diag([ridge, 1e-12])
        step = np.linalg.solve(hess, grad)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = ()) -> Model:
    """Learn entries, weights, exception phrases and the curve from at most ``train_rows`` labelled documents.

    The sample is the labelled rows outside the held-out fold with the smallest hash
    of their id, so it does not depend on partitions. ``exceptions`` are phrases of the
    caller's besides the learned ones. Rows with a null id or label are not used; a
    document labelled twice is toxic if either label says so; ids may be of any ordered
    type. Null and empty texts have no words; of repeated rows and copies one of each
    label counts. Without labelled documents, or where nothing tells toxic ones apart,
    the model calls nothing toxic.
    """
    marked = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    spark = docs.sparkSession
    rows = [(r["doc_id"], r["toxic"]) for r in sample.collect()]  # bounded by train_rows
    if not rows:
        return Model(exceptions=exceptions)
    kind = marked.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    labelled = F.broadcast(spark.createDataFrame(rows, f"doc_id {kind}, toxic int"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [sketch(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.int64())], ["doc_id", "toxic", "mark"])

    marks = texts.join(labelled, "doc_id").select("doc_id", "toxic", "text").mapInArrow(mark, f"doc_id {kind}, toxic int, mark long")
    first: dict[tuple[int, int], object] = {}
    for r in marks.collect():  # bounded by train_rows
        at = (r["mark"], r["toxic"])
        first[at] = min(first.get(at, r["doc_id"]), r["doc_id"])
    rows = sorted((d, t) for (_, t), d in first.items())
    toxic = sum(t for _, t in rows)
    if not rows:
        return Model(exceptions=exceptions)
    # copies of one text would make its every word look significant: one of each stays
    sample = F.broadcast(spark.createDataFrame(rows, f"doc_id {kind}, toxic int"))
    texts = texts.join(sample, "doc_id").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found[t].update(_beginnings(fold(text.as_py())))
                if len(found[0]) + len(found[1]) > COUNTED_AT_ONCE:
                    yield _counted(found)
                    found = (Counter(), Counter())
        yield _counted(found)

    def _counted(found: tuple[Counter, Counter]) -> pa.RecordBatch:
        clean, bad = found
        words = list(bad.keys() | clean.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([bad[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())],
            ["entry", "bad", "clean"],
        )

    work = Workspace(spark, "toxicity")
    counts = texts.mapInArrow(count, "entry string, bad long, clean long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"))
    counts = work.write(counts.where(F.col("bad") + F.col("clean") >= LEAST_DOCS), "counts")
    tested = counts.count()
    best = _passing(counts, toxic, len(rows) - toxic, tested).collect()  # words of train_rows texts at most
    work.drop(counts)
    chosen = choose_entries([(r["entry"], r["bad"], r["clean"]) for r in best], toxic, len(rows) - toxic, tested)
    model = Model(chosen, exceptions=exceptions)
    if not model.weights:
        return model  # nothing to tell texts apart by, so none is called toxic
    entries = spark.sparkContext.broadcast(chosen)

    def phrase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            found = [(p, e, t) for t, text in each for p, e in _phrases(fold(text.as_py()), entries.value).items()]
            columns = list(zip(*found, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32()), strict=True)], ["phrase", "entry", "toxic"])

    phrases = texts.mapInArrow(phrase, "phrase string, entry string, toxic int").groupBy("phrase", "entry")
    phrases = phrases.agg(F.sum("toxic").cast("long").alias("bad"), F.count_if(F.col("toxic") == 0).alias("clean")).where(F.col("clean") >= LEAST_DOCS)
    held = {r["entry"]: (r["bad"], r["clean"]) for r in best}
    learned = choose_exceptions([tuple(r) for r in phrases.collect()], held)  # words of train_rows texts at most
    model.exceptions = tuple(sorted({*exceptions, *learned}))
    shared = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            x = [weight_in(automaton, fold(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], ["toxic", "x"])

    points = texts.mapInArrow(weigh, "toxic int, x double").collect()  # bounded by train_rows
    order = sorted((r["x"], r["toxic"]) for r in points)
    model.slope, model.offset = fit_curve(np.array([x for x, _ in order]), np.array([t for _, t in order], float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each input row.

    Null and empty texts get the score of a text without matches. Repeated rows stay
    repeated; an empty table gives no rows; other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        slope, offset = shared.value.slope, shared.value.offset
        for batch in batches:
            scores = []
            for text in batch.column(1):
                z = slope * weight_in(automaton, fold(text.as_py())) + offset
                scores.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    scored = picked.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's rows and columns, without rows whose text scores 0.5 or more.

    Null and empty texts have no matches. Repeated rows go or stay together; columns of
    any name are kept; an empty table gives no rows.
    """
    schema, at = docs.schema, docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        slope, offset = shared.value.slope, shared.value.offset
        for batch in batches:
            keep = [slope * weight_in(automaton, fold(t.as_py())) + offset < 0 for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
