"""Per-engine accuracy: counters, rates with confidence intervals, statuses, confusion and costs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docscore import schema as S
from docscore.functions import numbers as N
from docscore.operators import score as C
from docscore.operators.score import judged

# fixed values: candidate number and name of each adapter
CANDIDATES = {
    "paddleocr-hebrew": (1, "RivoksLab/paddleocr-hebrew"), "tesseract": (2, "Tesseract + tessdata_best"), "kraken": (4, "Kraken"), "ironocr": (5, "IronOCR"), "abbyy": (6, "ABBYY FineReader Engine"),
}
FAST = (3, "Tesseract + tessdata_fast")


def engine_counters(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Submissions by status, completeness and digit accuracy of each engine, in one partial aggregation.

    Errored and blocked rows leave the denominators of the accuracies; ``strict_yield``
    keeps them, as all-fields complete rows by all submissions.
    """
    ok = F.col("status") == "ok"
    return scores.groupBy(*(by or ["engine_id"])).agg(
        F.count("*").alias("submitted"),
        F.count_if(ok).alias("ok"),
        F.count_if(F.col("status") == "BLOCKED").alias("blocked"),
        F.count_if(~ok & (F.col("status") != "BLOCKED")).alias("errored"),
        F.count_if(F.col("critical_complete")).alias("critical_complete_ok"),
        F.count("critical_complete").alias("critical_complete_total"),
        F.count_if(F.col("all_fields_complete")).alias("all_fields_complete_ok"),
        F.count("all_fields_complete").alias("all_fields_complete_total"),
        F.avg("digit_accuracy").alias("digit_accuracy_mean"),
        F.count("digit_accuracy").alias("digit_accuracy_samples"),
        (F.count_if(F.col("all_fields_complete")) / F.count("*")).alias("strict_yield"),
    )


def field_counters(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Correct and total of PRESENT and ABSENT fields, and excluded ones, by engine and field."""
    present, absent = F.col("scorable") & (F.col("presence") == "PRESENT"), F.col("scorable") & (F.col("presence") != "PRESENT")
    return outcomes.groupBy(*(by or ["engine_id", "field"])).agg(
        F.count_if(present & F.col("correct")).alias("present_correct"),
        F.count_if(present).alias("present_total"),
        F.count_if(absent & F.col("correct")).alias("absent_correct"),
        F.count_if(absent).alias("absent_total"),
        F.count_if(~F.col("scorable")).alias("excluded"),
    )


def _counts_of(k: int) -> dict[str, Column]:
    """The five counters of one field over rows that have ``verdicts``; rows without any do not count."""
    has = lambda bit: C.has(k, bit)
    return {
        "present_correct": F.count_if(has(C.PRESENT) & has(C.CORRECT)), "present_total": F.count_if(has(C.PRESENT)), "absent_correct": F.count_if(has(C.OTHER) & has(C.CORRECT)),
        "absent_total": F.count_if(has(C.OTHER)), "excluded": F.count_if(C.marks(k, C.PRESENT | C.OTHER) == 0),
    }


def field_pivot(scores: DataFrame) -> DataFrame:
    """One row per engine with ``present_<field>_correct`` and so on for every field, in one aggregation of the score rows."""
    made = []
    for k, f in enumerate(S.BUSINESS_FIELDS):
        for name, value in _counts_of(k).items():
            side, what = name.partition("_")[::2]
            made += [value.alias(f"{side}_{f}_{what}")] if what else []
    return judged(scores).groupBy("engine_id").agg(*made)


def field_counts(scores: DataFrame) -> DataFrame:
    """``field_counters`` by engine and field, in one aggregation of the score rows: no row per field is shuffled."""
    names = ["present_correct", "present_total", "absent_correct", "absent_total", "excluded"]
    cells = [F.struct(F.lit(f).alias("field"), *[v.alias(n) for n, v in _counts_of(k).items()]).alias(f) for k, f in enumerate(S.BUSINESS_FIELDS)]
    wide = judged(scores).groupBy("engine_id").agg(*cells)
    return wide.select("engine_id", F.explode(F.array(*S.BUSINESS_FIELDS)).alias("c")).select("engine_id", "c.field", *[f"c.{n}" for n in names])


LABELS = ["FIELD_SELECTION_ERROR", "OCR_DETECTION_ERROR", "OCR_DIGIT_ERROR", "OCR_TEXT_ERROR"]


def _label_counts() -> list[Column]:
    """How often each label is among the fields of rows, counted inside the rows."""
    found = [C.error_label(k) for k in range(len(S.BUSINESS_FIELDS))]
    return [F.sum(reduce(lambda a, b: a + b, (F.when(x == label, 1).otherwise(0) for x in found))).alias(label) for label in LABELS]


def _labels_of(counts: DataFrame) -> DataFrame:
    """``engine_id, label, n`` from ``rows`` and the count of each label by engine and status."""
    cells = [F.struct(F.when(~F.col("status").isin("ok", "BLOCKED"), F.col("status")).alias("label"), F.col("rows").alias("n")), *[F.struct(F.lit(label).alias("label"), F.col(label).alias("n")) for label in LABELS]]
    each = counts.select("engine_id", F.explode(F.array(*cells)).alias("c")).where("c.label IS NOT NULL AND c.n > 0")
    return each.groupBy("engine_id", "c.label").agg(F.sum("c.n").alias("n"))


def error_labels(scores: DataFrame) -> DataFrame:
    """``engine_id, label, n``: failures of rows (BLOCKED aside) and of fields together.

    One aggregation by engine and status: fields are counted inside their rows.
    """
    return _labels_of(scores.groupBy("engine_id", "status").agg(F.count("*").alias("rows"), *_label_counts()))


def tallies(scores: DataFrame) -> DataFrame:
    """All that reports count, by engine and status, in one pass over the scores.

    A row per engine and status; written once, the tables of a report are made from it
    (``counters_of``, ``pivot_of``, ``field_counts_of``, ``labels_of``), so that no
    report scores its rows several times.
    """
    measures = [
        F.count_if(F.col("critical_complete")).alias("critical_complete_ok"), F.count("critical_complete").alias("critical_complete_total"),
        F.count_if(F.col("all_fields_complete")).alias("all_fields_complete_ok"), F.count("all_fields_complete").alias("all_fields_complete_total"),
        F.sum("digit_accuracy").alias("digit_accuracy_sum"), F.count("digit_accuracy").alias("digit_accuracy_samples"), F.count("verdicts").alias("judged"),
    ]
    fields = [v.alias(f"{f}__{n}") for k, f in enumerate(S.BUSINESS_FIELDS) for n, v in _counts_of(k).items()]
    return scores.groupBy("engine_id", "status").agg(F.count("*").alias("rows"), *measures, *_label_counts(), *fields)


def counters_of(tallies: DataFrame) -> DataFrame:
    """``engine_counters`` from tallies."""
    ok, blocked, n = F.col("status") == "ok", F.col("status") == "BLOCKED", F.sum("rows")
    rows = lambda which: F.sum(F.when(which, F.col("rows")).otherwise(0))
    sums = ["critical_complete_ok", "critical_complete_total", "all_fields_complete_ok", "all_fields_complete_total"]
    return tallies.groupBy("engine_id").agg(
        n.alias("submitted"), rows(ok).alias("ok"), rows(blocked).alias("blocked"), rows(~ok & ~blocked).alias("errored"), *[F.sum(c).alias(c) for c in sums],
        N.ratio(F.sum("digit_accuracy_sum"), F.sum("digit_accuracy_samples")).alias("digit_accuracy_mean"), F.sum("digit_accuracy_samples").alias("digit_accuracy_samples"),
        (F.sum("all_fields_complete_ok") / n).alias("strict_yield"),
    )


_FIELD_COUNTERS = ["present_correct", "present_total", "absent_correct", "absent_total", "excluded"]


def pivot_of(tallies: DataFrame) -> DataFrame:
    """``field_pivot`` from tallies."""
    made = [F.sum(f"{f}__{n}").alias("{0}_{2}_{1}".format(*n.split("_"), f)) for f in S.BUSINESS_FIELDS for n in _FIELD_COUNTERS if n != "excluded"]
    return tallies.where("judged > 0").groupBy("engine_id").agg(*made)


def field_counts_of(tallies: DataFrame) -> DataFrame:
    """``field_counts`` from tallies."""
    cells = [F.struct(F.lit(f).alias("field"), *[F.col(f"{f}__{n}").alias(n) for n in _FIELD_COUNTERS]) for f in S.BUSINESS_FIELDS]
    each = tallies.where("judged > 0").select("engine_id", F.explode(F.array(*cells)).alias("c"))
    return each.groupBy("engine_id", "c.field").agg(*[F.sum(f"c.{n}").alias(n) for n in _FIELD_COUNTERS])


def labels_of(tallies: DataFrame) -> DataFrame:
    """``error_labels`` from tallies."""
    return _labels_of(tallies)


def top_labels(labels: DataFrame, k: int = 3) -> DataFrame:
    """The most frequent labels of each engine as ``label×n``; ties go by label."""
    order = Window.partitionBy("engine_id").orderBy(F.desc("n"), "label")
    best = labels.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    text = F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("label", F.lit("×"), F.col("n").cast("string")).alias("t")))), lambda s: s["t"])
    return best.groupBy("engine_id").agg(F.array_join(text, ", ").alias("labels"))


def engine_status() -> Column:
    """BLOCKED, ERRORED, PARTIAL, OK or NOT RUN, in this order, from the counters."""
    blocked, submitted, ok, errored = (F.col(c) for c in ("blocked", "submitted", "ok", "errored"))
    return (
        F.when((blocked == submitted) & (submitted > 0), "BLOCKED").when((ok == 0) & (errored > 0), "ERRORED").when((blocked > 0) & (ok > 0), "PARTIAL").when(ok > 0, "OK").otherwise("NOT RUN")
    )


def with_wilson(df: DataFrame, ok: str, total: str, name: str) -> DataFrame:
    low, high = N.wilson(F.col(ok), F.col(total))
    return df.withColumns({f"{name}_rate": N.ratio(F.col(ok), F.col(total)), f"{name}_low": low, f"{name}_high": high})


def candidate(adapter: Column, engine_id: Column, tessdata: Column) -> Column:
    """``struct<number, name>`` of an adapter; a fast configuration is a candidate of its own, an unknown adapter is 0."""
    fast = (adapter == "tesseract") & (F.contains(F.lower(engine_id), F.lit("fast")) | F.contains(F.lower(F.coalesce(tessdata, F.lit(""))), F.lit("fast")))
    made = lambda n, name: F.struct(F.lit(n).alias("number"), F.lit(name).alias("name"))
    out = F.when(fast, made(*FAST))
    for key, (n, name) in CANDIDATES.items():
        out = out.when(adapter == key, made(n, name))
    return out.otherwise(F.struct(F.lit(0).alias("number"), adapter.alias("name")))


def engine_report(engines: DataFrame, scores: DataFrame | None = None, counters: DataFrame | None = None) -> DataFrame:
    """A row per configured engine (``engine_id, adapter, tessdata``): candidate, status, counters, rates with bounds.

    Counters are those given, else made from the scores. Engines without rows are NOT RUN with zero counts.
    """
    counts = ["submitted", "ok", "blocked", "errored", "critical_complete_ok", "critical_complete_total", "all_fields_complete_ok", "all_fields_complete_total", "digit_accuracy_samples"]
    df = engines.join(engine_counters(scores) if counters is None else counters, "engine_id", "left").na.fill(0, counts)
    df = df.withColumn("status", engine_status()).withColumn("c", candidate(F.col("adapter"), F.col("engine_id"), F.col("tessdata")))
    df = with_wilson(df, "critical_complete_ok", "critical_complete_total", "critical")
    df = with_wilson(df, "all_fields_complete_ok", "all_fields_complete_total", "all_fields")
    return df.withColumns({"candidate_number": F.col("c.number"), "candidate_name": F.col("c.name")}).drop("c")


def candidate_groups(engines: DataFrame) -> DataFrame:
    """Engine ids of each candidate number, sorted."""
    c = candidate(F.col("adapter"), F.col("engine_id"), F.col("tessdata"))
    return engines.select(c["number"].alias("candidate_number"), "engine_id").groupBy("candidate_number").agg(F.array_join(F.array_sort(F.collect_list("engine_id")), ",").alias("engine_ids"))


def presence_totals(scores: DataFrame) -> DataFrame:
    """Scorable and correct fields of each engine (all, PRESENT only, ABSENT only), and its judged and blocked rows, in one aggregation."""
    total = lambda *bits: F.coalesce(F.sum(C.how_many(*bits)), F.lit(0).cast("long"))
    return scores.groupBy("engine_id").agg(
        (total(C.PRESENT) + total(C.OTHER)).alias("total_scorable"), total(C.CORRECT).alias("total_correct"),
        total(C.PRESENT).alias("present_scorable"), total(C.PRESENT, C.CORRECT).alias("present_correct"),
        total(C.OTHER).alias("absent_scorable"), total(C.OTHER, C.CORRECT).alias("absent_correct"),
        F.count_if((F.col("status") == "ok") & F.col("has_truth")).alias("judged"), F.count_if(F.col("status") == "BLOCKED").alias("blocked"),
    )


def character_error(pairs: DataFrame, by: list[str], unit: str = "character") -> DataFrame:
    """Edits by reference length, pooled (micro) and as a mean of rows (macro).

    With ``unit="byte"`` the edits are those of UTF-8 bytes, as some databases count them;
    the length is that in characters either way.
    """
    # a character for each byte
    side = (lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")) if unit == "byte" else F.col
    d, n = F.levenshtein(side("predicted"), side("expected")), F.length("expected")
    return pairs.where(n > 0).groupBy(*by).agg(F.sum(d).alias("edits"), F.sum(n).alias("reference_chars"), (F.sum(d) / F.sum(n)).alias("cer_micro"), F.avg(d / n).alias("cer_macro"))


def slice_rollup(df: DataFrame, dims: list[str], correct: str) -> DataFrame:
    """Accuracy for every prefix of the dimensions; ``(all)`` where one is rolled up."""
    cube = df.rollup(*dims).agg(F.count("*").alias("total"), F.sum(correct).alias("correct"), F.grouping_id().alias("level"))
    for k, d in enumerate(dims):
        cube = cube.withColumn(d, F.when(F.shiftright("level", len(dims) - 1 - k).bitwiseAND(F.lit(1)) == 1, "(all)").otherwise(F.coalesce(F.col(d), F.lit("(null)"))))
    return cube.withColumn("accuracy", F.col("correct") / F.col("total")).drop("level")


def latency(df: DataFrame, by: list[str], value: str, bins: int = 1024) -> DataFrame:
    """Exact median and 95th percentile (interpolated) of each group, and how many values it has.

    Values are counted in bins between the smallest and largest of their group; only the
    bins that hold a wanted rank are looked into, and there distinct values are counted
    before they are put in order. No task holds the values of a group. Null and NaN
    values do not count; a group without any has none.
    """
    keys = [F.col(c) for c in by]
    rows = df.select(*keys, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("__v"))
    ends = rows.groupBy(*by).agg(F.count("__v").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    known = rows.where("__v IS NOT NULL").join(_renamed(ends, by), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).drop(*[f"_{c}" for c in by])
    share = (F.col("__v") - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0))
    placed = known.withColumn("__bin", F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0)))
    ranks = F.array(*[f(F.col("__n") - 1, p) for p in (0.5, 0.95) for f in (lambda n, p: F.floor(n * p), lambda n, p: F.ceil(n * p))])
    inner = Window.partitionBy(*by).orderBy("__bin")
    # at most ``bins`` rows per group
    counts = placed.groupBy(*by, "__bin").agg(F.count("*").alias("__k"), F.max("__n").alias("__n"))
    counts = counts.withColumn("__before", F.sum("__k").over(inner) - F.col("__k")).withColumn("__ranks", ranks)
    wanted = counts.where(F.exists("__ranks", lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__k"))))
    wanted = _renamed(wanted.select(*by, "__bin", "__before", "__ranks"), [*by, "__bin"])
    inside = placed.join(wanted, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "__bin"]]).groupBy(*by, "__bin", "__v").agg(F.count("*").alias("__k"), F.max("__before").alias("__before"), F.max("__ranks").alias("__ranks"))
    ordered = Window.partitionBy(*by, "__bin").orderBy("__v")
    inside = inside.withColumn("__first", F.col("__before") + F.sum("__k").over(ordered) - F.col("__k"))
    at = lambda k: F.max(F.when((F.col("__ranks")[k] >= F.col("__first")) & (F.col("__ranks")[k] < F.col("__first") + F.col("__k")), F.col("__v")))
    found = inside.groupBy(*by).agg(*[at(k).alias(f"__r{k}") for k in range(4)])
    out = ends.join(_renamed(found, by), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left")
    between = lambda p, a, b: F.col(a) + (F.col(b) - F.col(a)) * ((F.col("__n") - 1) * p - F.floor((F.col("__n") - 1) * p))
    return out.select(*by, F.col("__n").alias("n"), between(0.5, "__r0", "__r1").alias("p50"), between(0.95, "__r2", "__r3").alias("p95"))


def _renamed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_{c}" for c in names})


def auto_accept(df: DataFrame, by: list[str], accepted: Column, correct: Column) -> DataFrame:
    """Coverage, precision of what is accepted without review, and how much of it is false."""
    n, a, good = F.count("*"), F.count_if(accepted), F.count_if(accepted & correct)
    return df.groupBy(*by).agg(n.alias("n"), a.alias("accepted"), (a / n).alias("coverage"), N.ratio(good, a).alias("precision"), N.ratio(a - good, n).alias("false_accept_rate"))


def miss_rates(scores: DataFrame) -> DataFrame:
    """Missing rate of PRESENT fields and false-positive rate of ABSENT ones, by engine; fields are counted inside their rows."""
    total = lambda *bits: F.sum(C.how_many(*bits))
    return judged(scores).groupBy("engine_id").agg(
        N.ratio(total(C.PRESENT) - total(C.PRESENT, C.PREDICTED), total(C.PRESENT)).alias("missing_rate"),
        N.ratio(total(C.ABSENT, C.PREDICTED), total(C.ABSENT)).alias("false_positive_rate"),
    )


POISSON = np.array([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183])


# fixed values of MD5 (RFC 1321)
_SHIFTS = [s for group in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in group * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_STATE = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
_CUTS = [math.ceil(c * (1 << 52)) for c in POISSON.tolist()]
_ROUNDS_AT_ONCE, _KEYS_AT_ONCE = 16, 4000


def _md5_heads(blocks: list[np.ndarray]) -> np.ndarray:
    """The first 52 bits of the MD5 of messages of one block each; a block is sixteen arrays of words, of any shapes that fit each other."""
    a, b, c, d = (np.uint32(x) for x in _STATE)
    with np.errstate(over="ignore"):
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            # words that are one number for all messages are added to the sine before
            f = f + (blocks[g] + np.uint32(_SINES[i]))
            f = f + a
            a, d, c, b = d, c, b, b + ((f << np.uint32(_SHIFTS[i])) | (f >> np.uint32(32 - _SHIFTS[i])))
        a, b = a + np.uint32(_STATE[0]), b + np.uint32(_STATE[1])
    return (a.byteswap().astype(np.uint64) << np.uint64(20)) | (b.byteswap() >> np.uint32(12)).astype(np.uint64)


def _first_bits(heads: list[bytes], ends: list[bytes]) -> np.ndarray:
    """The first 52 bits of the MD5 of every head (rows) with every end (columns) behind it.

    Heads of one length and ends of one length make blocks that differ in few words, so
    all of them go through the rounds of MD5 together; texts of more than one block go
    through ``hashlib``.
    """
    out = np.empty((len(heads), len(ends)), np.uint64)
    sizes, tails = np.array([len(h) for h in heads]), np.array([len(e) for e in ends])
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        for tail in np.unique(tails).tolist():
            all_columns = np.flatnonzero(tails == tail)
            if size + tail > 55:
                for r in rows:
                    out[r, all_columns] = [int.from_bytes(hashlib.md5(heads[r] + ends[k]).digest()[:8], "big") >> 12 for k in all_columns]
                continue
            raw = np.zeros((len(rows), 64), np.uint8)
            raw[:, :size] = np.frombuffer(b"".join(heads[r] for r in rows), np.uint8).reshape(len(rows), size)
            words = raw.view("<u4")
            for start in range(0, len(all_columns), _ROUNDS_AT_ONCE):
                columns = all_columns[start : start + _ROUNDS_AT_ONCE]
                rest = np.zeros((len(columns), 64), np.uint8)
                rest[:, size : size + tail] = np.frombuffer(b"".join(ends[k] for k in columns), np.uint8).reshape(len(columns), tail)
                rest[:, size + tail] = 0x80
                rest[:, 56:] = np.frombuffer((8 * (size + tail)).to_bytes(8, "little"), np.uint8)
                added = rest.view("<u4")
                blocks = []
                for k in range(16):
                    one, two = k * 4 < size, k * 4 + 4 > size and k * 4 <= size + tail
                    mine = np.ascontiguousarray(words[:, k])[None, :] if one else np.uint32(0)
                    blocks.append(mine | np.ascontiguousarray(added[:, k])[:, None] if two else mine if one else added[0, k])
                out[np.ix_(rows, columns)] = np.broadcast_to(_md5_heads(blocks), (len(columns), len(rows))).T
    return out


def bootstrap_weights(keys: list[str], rounds: int, seed: int) -> np.ndarray:
    """Poisson weights of keys (rows) in rounds 1, 2, ... (columns), up to 6.

    From the first 13 hexadecimal digits of the MD5 of seed, key and round, which other
    systems can compute too.
    """
    first = _first_bits([f"{seed}:{key}".encode() for key in keys], [f":{r}".encode() for r in range(1, rounds + 1)])
    weights = np.zeros(first.shape, np.uint8)
    for cut in _CUTS:
        weights += first >= np.uint64(cut)
    return weights


def paired_bootstrap(pairs: DataFrame, a: str, b: str, key: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """Interval of the mean difference of two engines on the same documents.

    Each document has a Poisson weight per round that depends on its key, the round and
    the seed only, so rounds need no resampled copies: a task adds up a vector of sums
    per round, and only these are shuffled. Documents without both values do not count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights = np.zeros(rounds), np.zeros(rounds)
        for batch in batches:
            for k in range(0, batch.num_rows, _KEYS_AT_ONCE):
                part = batch.slice(k, _KEYS_AT_ONCE)
                drawn = bootstrap_weights(part.column(0).to_pylist(), rounds, seed)
                sums += part.column(1).to_numpy() @ drawn
                weights += drawn.sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(1, rounds + 1), pa.int32()), pa.array(sums), pa.array(weights)], ["round", "sums", "weights"])

    known = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    each = known.select(F.coalesce(F.col(key).cast("string"), F.lit("")), (F.col(a) - F.col(b)).cast("double")).mapInArrow(run, "round int, sums double, weights double")
    means = each.groupBy("round").agg((F.sum("sums") / F.nullif(F.sum("weights"), F.lit(0.0))).alias("m"))
    # one row per round
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.count("m").alias("rounds"))


def hit_rate(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field, hits, n, rate`` with the rate as ``k/n (p%)`` for each field."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "")).alias(f) for f in fields])
    long = counts.select("n", F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", "hits"))
    return long.withColumn("rate", F.format_string("%d/%d (%.0f%%)", "hits", "n", F.col("hits") * 100.0 / F.nullif("n", F.lit(0))))


def status_counters(rows: DataFrame) -> DataFrame:
    """How many rows went well, were blocked and failed."""
    s = F.col("status")
    return rows.agg(F.count("*").alias("rows"), F.count_if(s == "ok").alias("ok"), F.count_if(s == "BLOCKED").alias("blocked"), F.count_if(~s.isin("ok", "BLOCKED")).alias("failed"), F.countDistinct(F.when(s == "ok", F.col("document_id"))).alias("documents_ok"))
