"""Exact-match scoring of records against adjudicated truth, field by field.

A fact row has ``document_id, engine_id, error_label`` and ``fields``, an array with
the raw tokens of every business field: what was predicted, what is true and what the
annotation says of its presence. Raw tokens keep how numbers were written, which digit
accuracy depends on. Fields are judged inside their row, so scoring shuffles nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscore import schema as S
from docscore.functions import numbers as N
from docscore.functions import text as X
from docscore.functions.regex import let

OUTCOME = "array<struct<field string, presence string, scorable boolean, predicted string, expected string, correct boolean, error_label string>>"

MEASURES = ["status", "has_truth", "outcomes", "verdicts", "critical_complete", "all_fields_complete", "digit_accuracy", "reference_digit_count"]

# fixed values: the bits that ``verdicts`` has for each field
PRESENT, OTHER, CORRECT, ABSENT, PREDICTED = (1 << k for k in range(5))
WIDTH = 5


def fields_of(prediction: Column, truth: Column, presence: Column) -> Column:
    """The ``fields`` array from maps of raw tokens by field name; null where there is no truth."""
    names = F.array(*map(F.lit, S.BUSINESS_FIELDS))
    each = F.transform(names, lambda f: F.struct(f.alias("field"), prediction[f].alias("predicted"), truth[f].alias("expected"), presence[f].alias("noted")))
    return F.when(truth.isNotNull(), each)


def with_fields(results: DataFrame, compose: bool = True) -> DataFrame:
    """Add ``fields`` to rows with ``prediction``, ``truth`` and ``presence`` maps; ``compose`` brings values to NFC."""
    side = (lambda c: X.nfc_values(F.col(c))) if compose else F.col
    return results.withColumns({"prediction": side("prediction"), "truth": side("truth")}).withColumn("fields", fields_of(F.col("prediction"), F.col("truth"), F.col("presence")))


#: How values of a field are made comparable.
NORMS = {
    **{f: N.norm_amount for f in S.AMOUNT_FIELDS}, "invoice_date": N.norm_date, "vendor_name": lambda c: X.norm_vendor(c, compose=False), **{f: (lambda c: X.norm_string(c, compose=False)) for f in S.ID_FIELDS},
}


def field_matches(field: str, predicted: Column, expected: Column) -> Column:
    """Null-safe equality after the normalisation of the field's kind; two values that do not parse are equal."""
    norm = NORMS[field]
    return norm(predicted).eqNullSafe(norm(expected))


def presence_of(noted: Column, expected: Column) -> Column:
    """The annotation, else PRESENT or ABSENT by the value."""
    return F.coalesce(noted, F.when(expected.isNull(), "ABSENT").otherwise("PRESENT"))


def _scorable(presence: Column) -> Column:
    return ~presence.isin("UNREADABLE", "AMBIGUOUS")


def _bit(value: Column, bit: int) -> Column:
    return F.when(value, bit).otherwise(0)


def _verdict(field: str, predicted: Column, expected: Column, noted: Column) -> Column:
    """The bits of one field: ``PRESENT`` or ``OTHER`` if it is scorable (``ABSENT`` too if it should be), ``CORRECT``, ``PREDICTED``.

    Tokens that differ in blanks around them only are equal under any normalisation, so few are normalised.
    """
    scorable = F.coalesce(_scorable(noted), F.lit(True))
    present, absent = (F.when(noted.isNull(), known).otherwise(noted == name) for known, name in ((expected.isNotNull(), "PRESENT"), (expected.isNull(), "ABSENT")))
    same = F.when(F.trim(predicted).eqNullSafe(F.trim(expected)), True).otherwise(field_matches(field, predicted, expected))
    kind = F.when(present, F.lit(PRESENT)).when(absent, F.lit(OTHER | ABSENT)).otherwise(F.lit(OTHER))
    right = F.when(absent, predicted.isNull()).otherwise(same)
    return F.when(scorable, kind + _bit(right, CORRECT)).otherwise(0) + _bit(predicted.isNotNull(), PREDICTED)


def marks(field: int | None, bit: int) -> Column:
    """``verdicts`` with nothing but one bit of a field (of all fields: null)."""
    places = range(len(S.BUSINESS_FIELDS)) if field is None else [field]
    return F.col("verdicts").bitwiseAND(F.lit(sum(bit << (WIDTH * k) for k in places)).cast("long"))


def has(field: int, bit: int) -> Column:
    return marks(field, bit) != 0


def how_many(bit: int, other: int | None = None) -> Column:
    """How many fields of a row have a bit, or two of them."""
    if other is None:
        return F.bit_count(marks(None, bit))
    apart = other.bit_length() - bit.bit_length()
    moved = F.shiftright(marks(None, other), apart) if apart > 0 else F.shiftleft(marks(None, other), -apart)
    return F.bit_count(marks(None, bit).bitwiseAND(moved))


def correct_fields() -> Column:
    return how_many(CORRECT)


def _wrong(field: str) -> str:
    return "OCR_DIGIT_ERROR" if field in S.AMOUNT_FIELDS + S.ID_FIELDS else "OCR_TEXT_ERROR"


def error_label(field: int) -> Column:
    """What went wrong with a field; null if nothing did or it is not scorable."""
    fine = F.col("verdicts").isNull() | (marks(field, PRESENT | OTHER) == 0) | has(field, CORRECT)
    return F.when(fine, None).when(has(field, ABSENT), "FIELD_SELECTION_ERROR").when(~has(field, PREDICTED), "OCR_DETECTION_ERROR").otherwise(_wrong(S.BUSINESS_FIELDS[field]))


def _outcome(k: int, predicted: Column, expected: Column, noted: Column) -> Column:
    presence = presence_of(noted, expected)
    made = {
        "field": F.lit(S.BUSINESS_FIELDS[k]), "presence": presence, "scorable": marks(k, PRESENT | OTHER) != 0, "predicted": predicted,
        "expected": F.when(presence != "ABSENT", expected), "correct": has(k, CORRECT), "error_label": error_label(k),
    }
    return F.struct(*[v.alias(n) for n, v in made.items()])


def status_of(error_label: Column, has_error: Column | None = None) -> Column:
    """``ok`` without an error, else its label (ERROR if it has none)."""
    if has_error is None:
        return F.coalesce(error_label, F.lit("ok"))
    return F.when(has_error, F.coalesce(error_label, F.lit("ERROR"))).otherwise("ok")


def _step(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """The columns in a projection of their own.

    Compiled into one method with the steps around it they are too much code for the JVM,
    which then interprets all of it, many times slower. A lambda, here one that does
    nothing, sets a projection apart from its neighbours.
    """
    return df.withColumns({**made, "_known": let(F.col("_known"), lambda x: x)})


def _digit_texts(p: list[Column], e: list[Column], said: list[Column]) -> dict[str, Column]:
    """What is predicted and true of the PRESENT fields with digits, joined, and whether digits were only lost or only added.

    The digits of values in a row are those of the values joined; nulls have none. Where
    every value is a beginning of its counterpart, digits were only lost; where every
    counterpart is one of it, they were only added.
    """
    order = [S.BUSINESS_FIELDS.index(f) for f in [*S.ID_FIELDS, "invoice_date", *S.AMOUNT_FIELDS]]
    counted = [e[k].isNotNull() & F.coalesce(said[k] == "PRESENT", F.lit(True)) for k in range(len(e))]
    joined = lambda side: F.concat(*[F.coalesce(F.when(counted[k], side[k]), F.lit("")) for k in order])
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    begins = lambda whole, start: reduce(lambda a, b: a & b, (~counted[k] | F.startswith(text(whole[k]), text(start[k])) for k in order))
    return {"_pd": joined(p), "_ed": joined(e), "_lost": begins(e, p), "_added": begins(p, e)}


def _cells(of: str) -> list[list[Column]]:
    """Columns of what is predicted, true and noted, for each field of an array in the fixed order."""
    return [[F.get(of, F.lit(k))[side] for k in range(len(S.BUSINESS_FIELDS))] for side in ("predicted", "expected", "noted")]


def digit_pairs(facts: DataFrame) -> DataFrame:
    """``expected, predicted, within`` of all PRESENT fields with digits, as written.

    A row whose fields all lost digits, or all got some, is one pair of joined texts
    (``within``: one side has the digits of the other and more between them); of other
    rows every field is a pair.
    """
    p, e, said = _cells("fields")
    df = facts.where(F.col("error_label").isNull() & F.col("fields").isNotNull()).withColumn("_known", F.lit(True))
    made = _digit_texts(p, e, said)
    pair = lambda x, y, within: F.struct(x.alias("expected"), y.alias("predicted"), F.lit(within).alias("within"))
    numeric = [k for k, f in enumerate(S.BUSINESS_FIELDS) if f != "vendor_name"]
    apart = F.array(*[pair(F.when(presence_of(said[k], e[k]) == "PRESENT", e[k]), F.when(presence_of(said[k], e[k]) == "PRESENT", p[k]), False) for k in numeric])
    df = _step(df, {**made, "_apart": F.when(~(made["_lost"] | made["_added"]), apart)})
    whole = F.array(pair(F.col("_ed"), F.col("_pd"), True))
    return df.select(F.explode(F.coalesce("_apart", whole)).alias("o")).select("o.*")


def scored(facts: DataFrame, critical: list[str] | None = None) -> DataFrame:
    """Facts with ``status, has_truth, outcomes, verdicts, critical_complete, all_fields_complete, digit_accuracy, reference_digit_count``.

    ``fields`` has the business fields in their fixed order. ``verdicts`` is what the
    outcomes say in ``WIDTH`` bits for each field, which is all that counters need: texts are
    copied from step to step where outcomes are asked for, and nowhere else. Each step is a
    projection, so that what several later ones need is made once; there are no lambdas over
    the fields, as these are not compiled. Rows with an error or without truth have no
    outcomes and null measures.
    """
    critical = critical or S.CRITICAL_FIELDS
    df = facts.withColumns({"status": status_of(F.col("error_label")), "has_truth": F.col("fields").isNotNull()})
    df = df.withColumn("_known", (F.col("status") == "ok") & F.col("has_truth"))
    df = df.withColumn("_f", F.when(F.col("_known"), F.col("fields")))
    known, each, place = F.col("_known"), list(enumerate(S.BUSINESS_FIELDS)), S.BUSINESS_FIELDS.index
    p, e, said = _cells("_f")
    digits = _digit_texts(p, e, said)
    df = _step(df, {
        **{f"_v{k}": _verdict(f, p[k], e[k], said[k]) for k, f in each},
        **digits,
    })
    packed = reduce(lambda a, b: a + b, (F.shiftleft(F.col(f"_v{k}").cast("long"), WIDTH * k) for k, _ in each))
    df = df.withColumn("verdicts", F.when(known, packed))
    df = _step(df, {
        "_ed": F.when(known, N.digits_of(F.col("_ed"))), "_pd": F.when(known & (F.col("_pd") != F.col("_ed")), N.digits_of(F.col("_pd"))), "_nested": F.col("_lost") | F.col("_added"),
        "outcomes": F.coalesce(F.when(known, F.array(*[_outcome(k, p[k], e[k], said[k]) for k, _ in each])), F.array().cast(OUTCOME)),
    })

    def complete(fields: list[str]) -> Column:
        all_ = lambda bits: reduce(lambda a, b: a & b, (bits(place(f)) for f in fields))
        return F.when(all_(lambda k: marks(k, PRESENT | OTHER) != 0), all_(lambda k: has(k, CORRECT)))

    df = df.withColumns({
        "critical_complete": F.when(known, complete(critical)), "all_fields_complete": F.when(known, complete(S.BUSINESS_FIELDS)),
        "digit_accuracy": F.when(known, N.digit_accuracy(F.coalesce("_pd", "_ed"), F.col("_ed"), F.col("_nested"))), "reference_digit_count": F.coalesce(F.length("_ed"), F.lit(0)),
    })
    return df.select(*[c for c in facts.columns if c not in MEASURES], *MEASURES)


def judged(scores: DataFrame) -> DataFrame:
    """The rows that have outcomes, told by their status: a condition on the outcomes
    themselves would be pushed below them and judge every field once more."""
    return scores.where((F.col("status") == "ok") & F.col("has_truth"))


def each_place(scores: DataFrame) -> DataFrame:
    """A row for each place ``_k`` of the business fields."""
    return scores.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in range(len(S.BUSINESS_FIELDS))])))


def each_outcome(scores: DataFrame) -> DataFrame:
    """A row for each judged field: the columns of ``scores`` and ``o``, the outcome."""
    return each_place(judged(scores)).withColumn("o", F.get("outcomes", F.col("_k"))).drop("_k")


def outcomes_long(scores: DataFrame) -> DataFrame:
    return each_outcome(scores).select("document_id", "engine_id", "o.*")


def latest_truth(truth: DataFrame, key: str = "document_id", order: str = "line") -> DataFrame:
    """One truth per document: the last line wins. Entries with neither truth nor annotation do not count."""
    rows = truth.where(F.col("truth").isNotNull() | F.col("presence").isNotNull())
    return rows.groupBy(key).agg(F.max_by(F.struct("truth", "presence"), order).alias("last")).select(key, "last.*")


def join_truth(results: DataFrame, truth: DataFrame, order: str = "line") -> DataFrame:
    """Results with the truth of their document, null where there is none."""
    return results.join(latest_truth(truth, order=order), "document_id", "left")


def cross_status(documents: DataFrame, engines: DataFrame, facts: DataFrame) -> DataFrame:
    """Every document with every engine (a small, fixed set): the status of its row, NOT RUN without one."""
    grid = documents.select("document_id").distinct().crossJoin(F.broadcast(engines.select("engine_id").distinct()))
    have = facts.select("document_id", "engine_id", status_of(F.col("error_label")).alias("status"))
    return grid.join(have, ["document_id", "engine_id"], "left").withColumn("status", F.coalesce("status", F.lit("NOT RUN")))


def ordered_grid(documents: DataFrame, engines: DataFrame, facts: DataFrame) -> DataFrame:
    """``cross_status`` in the order of documents (``ordinal``, then id) and of engines (``ordinal``, then id), both kept as columns."""
    first = documents.groupBy("document_id").agg(F.min("ordinal").alias("document_ordinal"))
    place = engines.groupBy("engine_id").agg(F.min("ordinal").alias("engine_ordinal"))
    grid = cross_status(documents, engines, facts).join(first, "document_id").join(F.broadcast(place), "engine_id")
    return grid.select("document_id", "engine_id", "status", "document_ordinal", "engine_ordinal").orderBy("document_ordinal", "document_id", "engine_ordinal", "engine_id")


def block_failed_engines(facts: DataFrame, load_errors: DataFrame) -> DataFrame:
    """Rows of engines that did not load are BLOCKED, with no prediction."""
    failed = load_errors.select("engine_id", F.lit(True).alias("_failed")).distinct()
    df = facts.join(failed, "engine_id", "left")
    return df.withColumns({
        "error_label": F.when(F.col("_failed"), "BLOCKED").otherwise(F.col("error_label")),
        "prediction": F.when(F.col("_failed").isNull(), F.col("prediction")),
    }).drop("_failed")


def compare_fields(scores: DataFrame) -> DataFrame:
    """Truth, prediction and scoring side by side, a row per document, engine and field of the truth.

    Scored rows hold all three, so nothing is joined. Rows with an error have neither prediction nor scoring.
    """
    df = each_place(scores.where("has_truth")).select("document_id", "engine_id", "error_label", F.get("fields", F.col("_k")).alias("f"), F.get("outcomes", F.col("_k")).alias("o"))
    predicted = F.when(F.col("error_label").isNull(), F.col("f.predicted"))
    return df.select("document_id", "engine_id", "f.field", "f.expected", predicted.alias("predicted"), "o.presence", "o.correct", "o.error_label")
