"""Edit alignment of predicted to expected sequences: digits, characters or words.

Counts of edits come from furthest-reaching diagonals: for each number of edits the
furthest place reached on every diagonal of the table, matches being slid over in
blocks. The cost is near the length of the texts plus the square of their distance, so
near-equal texts are near-linear whatever their length, and no band has to be guessed.
Which digit stands for which comes from the whole table of short strings, for all
pairs of a batch at once, walked back together; long strings are halved first.

Of several alignments with the fewest edits one is taken: a substitution before a
deletion before an insertion, seen from the end of the digits, and likewise on every
diagonal of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscore.functions import numbers as N

PARTS = "struct<substitutions bigint, deletions bigint, insertions bigint>"
NONE = 10  # the digit code where one side has none
SHORT = 48
BATCH_CELLS = 4_000_000


# --- counts of edits -------------------------------------------------------------


def _slide(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far ``a`` and ``b`` are equal from places ``i`` and ``j`` on."""
    far = i.copy()
    shift = j - i
    limit = np.minimum(len(a), len(b) - shift)
    active, block = np.flatnonzero(far < limit), 8
    while len(active):
        at = far[active, None] + np.arange(block)
        inside = at < limit[active, None]
        same = inside & (a[np.where(inside, at, 0)] == b[np.where(inside, at + shift[active, None], 0)])
        run = np.where(same.all(axis=1), block, same.argmin(axis=1))
        far[active] += run
        active = active[(run == block) & (far[active] < limit[active])]
        block = min(block * 4, max(8, (1 << 20) // max(1, len(active))))
    return far


def edit_parts(expected: np.ndarray, predicted: np.ndarray) -> tuple[int, int, int]:
    """``(substitutions, deletions, insertions)`` of one alignment with the fewest edits.

    On diagonal k the place in ``predicted`` is k further than in ``expected``, so
    insertions less deletions are known at the end, and only substitutions are carried.
    """
    a, b = expected, predicted
    shared = min(len(a), len(b))
    apart = np.flatnonzero(a[:shared] != b[:shared])
    head = int(apart[0]) if len(apart) else shared
    a, b = a[head:], b[head:]
    shared = min(len(a), len(b))
    apart = np.flatnonzero(a[len(a) - shared :][::-1] != b[len(b) - shared :][::-1])
    tail = int(apart[0]) if len(apart) else shared
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return 0, n, m
    goal = m - n
    # diagonals low - 1 to high + 1; -2 is a place that nothing reaches
    low = high = 0
    far, subs = np.array([-2, 0, -2]), np.zeros(3, np.int64)
    far[1:2] = _slide(a, b, far[1:2], far[1:2])
    edits = 0
    while not (low <= goal <= high and far[goal - low + 1] >= n):
        edits += 1
        wide, carried = np.full(len(far) + 2, -2), np.zeros(len(far) + 2, np.int64)
        wide[1:-1], carried[1:-1] = far, subs
        low, high = low - 1, high + 1
        k = np.arange(low, high + 1)
        put, cut, add = wide[1:-1] + 1, wide[2:] + 1, wide[:-2]
        best = np.maximum(np.maximum(put, cut), add)
        count = np.where(put == best, carried[1:-1] + 1, np.where(cut == best, carried[2:], carried[:-2]))
        best = np.minimum(best, np.minimum(n, m - k))
        fine = (best >= 0) & (best + k >= 0)
        keep = np.flatnonzero(fine & (k >= -n) & (k <= m))
        first, last = keep[0], keep[-1] + 1
        k, best, count, fine = k[first:last], best[first:last], count[first:last], fine[first:last]
        best = np.where(fine, best, -2)
        alive = np.flatnonzero(fine)
        best[alive] = _slide(a, b, best[alive], best[alive] + k[alive])
        low, high = int(k[0]), int(k[-1])
        far, subs = np.concatenate([[-2], best, [-2]]), np.concatenate([[0], count, [0]])
    substitutions = int(subs[goal - low + 1])
    rest = edits - substitutions
    return substitutions, (rest - goal) // 2, (rest + goal) // 2


def tokens(expected: str | None, predicted: str | None, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Both texts as numbers: code points, or words (runs without ASCII white space) numbered in order of appearance."""
    if unit == "character":
        return tuple(np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in (expected, predicted))
    number: dict[bytes, int] = {}
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in (expected, predicted)]
    return tuple(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found)) for found in words)


def parts_between(expected: Column, predicted: Column, unit: str) -> Column:
    """``struct<substitutions, deletions, insertions>`` of two texts; null text is empty. Equal texts never reach Python."""

    @F.arrow_udf(PARTS)
    def parts(expected: pa.Array, predicted: pa.Array) -> pa.Array:
        found = [edit_parts(*tokens(e.as_py(), p.as_py(), unit)) for e, p in zip(expected, predicted, strict=True)]
        return pa.array([dict(zip(("substitutions", "deletions", "insertions"), f, strict=True)) for f in found], pa.struct([(c, pa.int64()) for c in ("substitutions", "deletions", "insertions")]))

    differ = ~predicted.eqNullSafe(expected)
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("substitutions", "deletions", "insertions")])
    return F.when(differ, parts(F.when(differ, expected), F.when(differ, predicted))).otherwise(none)


def size_of(text: Column, unit: str) -> Column:
    """Characters, or words between ASCII white space; zero for null."""
    if unit == "character":
        return F.coalesce(F.length(text), F.lit(0))
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def error_rates(pairs: DataFrame, by: list[str], unit: str = "word") -> DataFrame:
    """Substitutions, deletions and insertions of ``predicted`` against ``expected``, pooled by group.

    ``edits`` is their sum, ``reference`` the size of the expected texts, ``rate`` the
    quotient (null without reference), ``macro`` the mean over rows that have a
    reference. Null texts are empty; texts of any length are compared whole. Only sums
    are shuffled. An empty table gives no rows.
    """
    each = pairs.select(*by, parts_between(F.col("expected"), F.col("predicted"), unit).alias("p"), size_of(F.col("expected"), unit).cast("long").alias("n"))
    edits = F.col("p.substitutions") + F.col("p.deletions") + F.col("p.insertions")
    out = each.withColumn("edits", edits).groupBy(*by).agg(
        F.sum("p.substitutions").alias("substitutions"), F.sum("p.deletions").alias("deletions"), F.sum("p.insertions").alias("insertions"),
        F.sum("edits").alias("edits"), F.sum("n").alias("reference"), F.avg(N.ratio(F.col("edits"), F.col("n"))).alias("macro"),
    )
    return out.withColumn("rate", N.ratio(F.col("edits"), F.col("reference")))


# --- which digit stands for which ---------------------------------------------------


def _tables(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance of all prefixes, for a batch of padded rows: ``[i, row, j]``."""
    rows, m = b.shape
    place = np.arange(m + 1, dtype=np.int32)
    out = np.empty((a.shape[1] + 1, rows, m + 1), np.int32)
    out[0] = place
    for i in range(1, a.shape[1] + 1):
        out[i, :, 0] = i
        out[i, :, 1:] = np.minimum(out[i - 1, :, 1:] + 1, out[i - 1, :, :-1] + (b != a[:, i - 1 : i]))
        # insertions: the smallest of all to the left plus the way to here
        out[i] = np.minimum.accumulate(out[i] - place, axis=1) + place
    return out


def _confused(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Counts of ``[expected, predicted]`` digit codes over a batch of padded rows of ``n`` and ``m`` digits."""
    table, row = _tables(a, b), np.arange(len(a))
    i, j = n.copy(), m.copy()
    counts = np.zeros((NONE + 1) ** 2, np.int64)
    while True:
        left = np.flatnonzero((i > 0) | (j > 0))
        if not len(left):
            return counts.reshape(NONE + 1, NONE + 1)
        r, x, y = row[left], i[left], j[left]
        now = table[x, r, y]
        e, p = a[r, np.maximum(x - 1, 0)], b[r, np.maximum(y - 1, 0)]
        both = (x > 0) & (y > 0)
        put = both & (table[np.maximum(x - 1, 0), r, np.maximum(y - 1, 0)] + (e != p) == now)
        cut = ~put & (x > 0) & (table[np.maximum(x - 1, 0), r, y] + 1 == now)
        code = np.where(put, e * (NONE + 1) + p, np.where(cut, e * (NONE + 1) + NONE, NONE * (NONE + 1) + p))
        counts += np.bincount(code, minlength=len(counts))
        i[left] -= put | cut
        j[left] -= ~cut


def _halves(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of a long pair whose best alignments make up one of the whole."""
    if len(a) <= 1 or len(b) <= 1 or max(len(a), len(b)) <= SHORT:
        yield a, b
        return
    half = len(a) // 2

    def last_row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        place = np.arange(len(y) + 1)
        now = place.copy()
        for k, digit in enumerate(x, 1):
            least = np.minimum(now[1:] + 1, now[:-1] + (y != digit))
            now = np.minimum.accumulate(np.concatenate([[k], least]) - place) + place
        return now

    cut = int((last_row(a[:half], b) + last_row(a[half:][::-1], b[::-1])[::-1]).argmin())
    yield from _halves(a[:half], b[:cut])
    yield from _halves(a[half:], b[cut:])


def confusion(pairs: list[tuple[str | None, str | None]]) -> np.ndarray:
    """Counts of ``[expected, predicted]`` digit codes over pairs of digit strings; code ten is no digit."""
    total = np.zeros((NONE + 1, NONE + 1), np.int64)
    codes = lambda t: np.frombuffer((t or "").encode("ascii"), np.uint8).astype(np.int64) - 48
    pieces = [piece for e, p in pairs for piece in _halves(codes(e), codes(p))]
    pieces.sort(key=lambda piece: (len(piece[0]), len(piece[1])))
    start = 0
    while start < len(pieces):
        width = max(1, len(pieces[start][0]))
        end = start
        deep = 0
        while end < len(pieces) and len(pieces[end][0]) == len(pieces[start][0]):
            deep = max(deep, len(pieces[end][1]))
            if end > start and (end - start + 1) * (width + 1) * (deep + 1) > BATCH_CELLS:
                break
            end += 1
        some = pieces[start:end]
        a, b = np.full((len(some), width), -1), np.full((len(some), max(1, *(len(y) for _, y in some), 1)), -2)
        for k, (x, y) in enumerate(some):
            a[k, : len(x)], b[k, : len(y)] = x, y
        total += _confused(a, b, np.array([len(x) for x, _ in some]), np.array([len(y) for _, y in some]))
        start = end
    return total


def _histogram(texts: pa.Array) -> np.ndarray:
    """How often each digit is in an array of texts: its bytes are counted as they lie in memory."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(NONE, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    found = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.bincount(found, minlength=256)[48 : 48 + NONE].astype(np.int64)


def digit_confusion(pairs: DataFrame, predicted: str = "predicted", expected: str = "expected", within: str | None = None) -> DataFrame:
    """``expected_digit, predicted_digit, n`` over the digits 0 to 9 of pairs of texts.

    An empty expected digit is an insertion, an empty predicted one a deletion, so every
    digit of either side is counted once. Null is the empty string; pairs may differ in
    length and be of any length. Where one text is a beginning of the other, or the
    column ``within`` says that it has the other's digits and more between them, every
    best alignment has the digits of the shorter as they are and lacks the rest, so the
    digits of both sides are counted without alignment. All become at most 120 counts a
    task, in one pass. No pairs give no rows.
    """
    e, p = F.coalesce(F.col(expected), F.lit("")), F.coalesce(F.col(predicted), F.lit(""))
    told = F.coalesce(F.col(within), F.lit(False)) if within else F.lit(False)
    sides = pairs.select(e.alias("e"), p.alias("p"), told.alias("told"))
    sides = sides.select(*[F.when(F.col("told") | (F.col("e") == F.col("p")), F.col(c)).otherwise(N.digits_of(F.col(c))).alias(c) for c in ("e", "p")], "told")
    sides = sides.select("e", "p", (F.col("told") | F.startswith("e", "p") | F.startswith("p", "e")).alias("told"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((NONE + 1, NONE + 1), np.int64)
        digits = np.arange(NONE)
        for batch in batches:
            e, p, told = batch.columns
            longer = pc.greater_equal(pc.binary_length(e), pc.binary_length(p))
            for lost in (True, False):
                some = pc.and_(told, longer if lost else pc.invert(longer))
                whole, part = (_histogram(side.filter(some)) for side in ((e, p) if lost else (p, e)))
                total[digits, digits] += part
                rest = whole - part
                if lost:
                    total[:NONE, NONE] += rest
                else:
                    total[NONE, :NONE] += rest
            other = pc.invert(told)
            if pc.any(other).as_py():
                total += confusion(list(zip(e.filter(other).to_pylist(), p.filter(other).to_pylist(), strict=True)))
        i, j = np.nonzero(total)
        name = [*map(str, range(NONE)), ""]
        yield pa.RecordBatch.from_arrays([pa.array([name[k] for k in i], pa.string()), pa.array([name[k] for k in j], pa.string()), pa.array(total[i, j])], ["expected_digit", "predicted_digit", "n"])

    return sides.mapInArrow(run, "expected_digit string, predicted_digit string, n long").groupBy("expected_digit", "predicted_digit").agg(F.sum("n").alias("n"))
