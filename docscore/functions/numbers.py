"""Parsing, validation and arithmetic as Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from docscore.functions.regex import rx, strip

Z_SCORES = {0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def checksum_valid(digits: Column) -> Column:
    """Nine digits weighted 1, 2, 1, ...; two-digit products count by their digit sum; the total ends in 0."""

    def weighed(i: Column) -> Column:
        product = F.substring(digits, i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 1).otherwise(2)
        return F.when(product > 9, product - 9).otherwise(product)

    total = F.aggregate(F.sequence(F.lit(0), F.lit(8)), F.lit(0), lambda acc, i: acc + weighed(i))
    return F.when(F.coalesce(digits, F.lit("")).rlike("^[0-9]{9}$"), total % 10 == 0).otherwise(False)


def _decimal_text(text: Column) -> Column:
    """The text if it is a plain decimal number, else null."""
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text)


def to_double(text: Column) -> Column:
    return _decimal_text(text).try_cast("double")


def parse_strict(text: Column) -> Column:
    """Spaces, commas and the currency sign go; what is no number then is null."""
    return to_double(strip(F.translate(text, " \u00a0,₪", "")))


def parse_tolerant(text: Column) -> Column:
    """Amounts with either separator convention.

    With both separators the last one is the decimal point. Of several equal ones the
    last is the decimal point if one or two digits follow, else all group thousands. A
    single dot is always the decimal point, a single comma if one or two digits follow.
    """
    return to_double(_by_separators(_bare(text)))


def parse_each(values: Column, tolerant: bool = True) -> Column:
    """The numbers of an array of texts. Each step is a lambda of its own, as a lambda computes what it uses twice anew."""
    return F.transform(F.transform(F.transform(values, _bare), _by_separators), to_double) if tolerant else F.transform(values, parse_strict)


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.translate(strip(text), " \u00a0₪$€", ""), r"^\++", "")


def _by_separators(s: Column) -> Column:
    """The number with a dot for its decimal point and without other separators."""
    dots, commas = F.split(s, r"\.", -1), F.split(s, ",", -1)

    def joined(parts: Column) -> Column:
        head, last = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
        tail = F.when(F.length(last).between(1, 2), F.concat(F.lit("."), last)).otherwise(last)
        return F.concat(F.array_join(head, ""), tail)

    has_dot, has_comma = F.contains(s, F.lit(".")), F.contains(s, F.lit(","))
    dot_last = F.instr(F.reverse(s), ".") < F.instr(F.reverse(s), ",")
    first_comma = F.regexp_replace(F.regexp_replace(s, r"\.", ""), "^([^,]*),", "$1.")
    return (
        F.when(has_comma & has_dot & dot_last, F.regexp_replace(s, ",", ""))
        .when(has_comma & has_dot, F.regexp_replace(first_comma, ",", ""))
        .when(has_dot & (F.size(dots) > 2), joined(dots))
        .when(has_comma, joined(commas))
        .otherwise(s)
    )


def norm_amount(raw: Column) -> Column:
    """Decimal of a raw token for comparison; no grouping is understood; true and false are 1 and 0."""
    s = strip(raw)
    # plain numbers, most of them, need no stripping
    return F.when(raw.rlike(r"^[0-9]+(\.[0-9]+)?\z"), raw).when(s == "true", F.lit("1")).when(s == "false", F.lit("0")).otherwise(_decimal_text(s)).try_cast("decimal(38,10)")


def norm_date(raw: Column) -> Column:
    s = strip(raw)
    return F.when(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), raw).when(s.rlike(rx(r"^\d{4}-\d{2}-\d{2}\z")), s)


def date_loose(text: Column) -> Column:
    """First day-month-year in the text as ISO; two-digit years are 20xx; nothing is range-checked."""
    pattern = r"(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})"
    day, month, year = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.when(day != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def date_checked(day: Column, month: Column, year: Column) -> Column:
    """ISO date of strings or null; day and month are swapped once if only that fits. The calendar is not consulted."""
    d, m, y = day.cast("int"), month.cast("int"), year.cast("int")
    y = F.when(y < 100, y + 2000).otherwise(y)
    fits = m.between(1, 12) & d.between(1, 31) & y.between(1900, 2100)
    swapped = d.between(1, 12) & m.between(1, 31)
    iso = lambda a, b: F.format_string("%04d-%02d-%02d", y, a, b)
    return F.when(fits, iso(m, d)).when(swapped, iso(d, m))


def digits_of(text: Column) -> Column:
    """The digits of a text. Only texts with letters beyond ASCII need the Unicode classes, which are slow."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.coalesce(F.when(ascii_only, F.regexp_replace(text, "[^0-9]+", "")).otherwise(F.regexp_replace(text, rx(r"\D"), "")), F.lit(""))


_FEW = 8


def edit_distance(a: Column, b: Column) -> Column:
    """Exact edit distance. Up to a few edits are found in a narrow band of the table; the whole table is for the others."""
    few = F.get(F.array(*[F.lit(k) for k in range(_FEW + 1)]), F.levenshtein(a, b, _FEW))  # null where there are more
    return F.when(a == b, 0).otherwise(F.coalesce(few, F.levenshtein(a, b)))


def digit_accuracy(predicted: Column, expected: Column, nested: Column | None = None) -> Column:
    """One minus edit distance by reference length, at least 0; null without reference digits.

    ``nested`` is true where one side is known to be the other with letters left out.
    """
    n = F.length(expected)
    edits = edit_distance(predicted, expected)
    if nested is not None:
        edits = F.when(nested, F.abs(n - F.length(predicted))).otherwise(edits)
    return F.when(n > 0, F.greatest(F.lit(0.0), 1 - edits / n))


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def wilson(successes: Column, total: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; zeros where nothing was counted."""
    z = Z_SCORES.get(confidence, Z_SCORES[0.95])
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n)
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(total > 0, low).otherwise(0.0), F.when(total > 0, high).otherwise(0.0)


def percent_text(num: Column, den: Column) -> Column:
    """``rate [low, high] (num/den)`` or n/a."""
    low, high = wilson(num, den)
    text = F.format_string("%5.1f%%  [%4.1f%%, %4.1f%%]  (%d/%d)", num / F.nullif(den, F.lit(0)) * 100, low * 100, high * 100, num, den)
    return F.when(den > 0, text).otherwise("n/a")


def zero_error_bound(total: Column) -> Column:
    """Upper bound of the error rate where none was seen, by the rule of three."""
    return F.when(total > 0, F.lit(3.0) / total)


def mean_of(values: Column) -> Column:
    """Mean of the values that are not null; null without any."""
    some = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, v: a + v) / F.size(some))


def upper_median(values: Column) -> Column:
    """The middle value, of two the larger; null without any."""
    ordered = F.array_sort(values)
    return F.when(F.size(values) > 0, F.element_at(ordered, (F.floor(F.size(values) / 2) + 1).cast("int")))


def center_y(polygon: Column) -> Column:
    ys = F.transform(polygon, lambda p: p["y"])
    return F.when(F.size(polygon) > 0, F.aggregate(ys, F.lit(0.0), lambda a, y: a + y) / F.size(polygon)).otherwise(0.0)


def extent_y(polygon: Column) -> Column:
    ys = F.transform(polygon, lambda p: p["y"])
    return F.when(F.size(polygon) > 0, F.array_max(ys) - F.array_min(ys)).otherwise(0.0)


def field_hits(*fields: Column) -> Column:
    """How many of the fields hold something."""
    return sum((F.when(f.isNotNull() & (f.cast("string") != ""), 1).otherwise(0) for f in fields), F.lit(0))


def cost_model(docs: Column, pages: Column, rate: Column, speed: Column, efficiency: float = 0.7, hours: float = 720.0) -> dict[str, Column]:
    """Monthly compute of elastic and always-warm workers, and elastic cost per thousand documents."""
    total = docs * pages
    busy = total / (speed * 3600 * efficiency)
    warm = F.ceil(total / (speed * 3600 * efficiency * hours))
    elastic = busy * rate
    return {"worker_hours": busy, "elastic_cost": elastic, "warm_workers": warm, "warm_cost": warm * hours * rate, "cost_per_1000": elastic / docs * 1000}


def cost_per_correct(cost: Column, docs: Column, accuracy: Column) -> Column:
    """Infinite where nothing is correct, null where accuracy was not measured."""
    return F.when(accuracy == 0, F.lit(math.inf)).when(accuracy > 0, cost / (docs * accuracy))


def correction_cost(reviewed: Column, seconds: Column, wage: Column) -> Column:
    return reviewed * seconds / 3600 * wage
