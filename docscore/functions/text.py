"""Normalisation of text as Column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docscore.functions.regex import SPACE, lines, replace, strip, strip_of

# fixed values: Hebrew ranges, final letters, and abbreviations that text layers emit reversed
HEBREW = r"[\u0590-\u05ff]"
NIKUD = r"[\u0591-\u05c7]"
FINAL, MEDIAL = "ךםןףץ", "כמנפצ"
ABBREVIATIONS = [
    ('כ"סה', 'סה"כ'), ('מ"מע', 'מע"מ'), ('ח"ש', 'ש"ח'), ('מ"בע', 'בע"מ'),
    ("כ״סה", "סה״כ"), ("מ״מע", "מע״מ"), ("ח״ש", "ש״ח"), ("מ״בע", "בע״מ"),
]
# fixed values: mangled labels and their canonical forms, in order
LABEL_REWRITES = [
    (r"[עצ/\\p][ווי]?\s*ס[קכ]\s*[חמה][וויר]+[רד]?\s*ש[החה]", "עוסק מורשה"),
    (r"[מחע][מחע][\"״׳'`][מם]", 'מע"מ'),
    (r"[סש][החה][\"״׳'`]?[בכ](?![א-ת])", 'סה"כ'),
    (r"[לכ][תפ]ש[חל][וויי]?[מם]", "לתשלום"),
    (r"[מח][חתז][זיי][רד]\s*לפני\s*[החה]נ[חה][החה]", "מחיר לפני הנחה"),
    (r"[מח]ס[פפ]\s*[רד]?\s*[החה][קכ][צך][אה][חה]", "מספר הקצאה"),
    (r"[חת]ש\s*[בכ][וויי][נן]+[יוי]?[תחה]\s*[מם][סש]?", "חשבונית מס"),
]


@F.arrow_udf(T.StringType())
def _nfc(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def nfc(text: Column) -> Column:
    """Canonical composition.

    Text whose letters all come before the combining marks (ASCII and Latin) is composed
    already and stays in the JVM: the Python function sees null in its place.
    """
    marked = text.rlike("[^\\x{0}-\\x{2ff}]")
    return F.coalesce(_nfc(F.when(marked, text)), text)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _nfc_values(values: pd.Series) -> pd.Series:
    compose = lambda v: None if v is None else unicodedata.normalize("NFC", v)
    return values.map(lambda m: None if m is None else {k: compose(v) for k, v in dict(m).items()})


def nfc_values(values: Column) -> Column:
    """Canonical composition of all values of a map of strings."""
    return _nfc_values(values)


def norm_string(text: Column, compose: bool = True, space: str = SPACE) -> Column:
    """Composed and stripped of ``space``; null if nothing is left. Printable ASCII without blanks is both already."""
    stripped = F.nullif(strip_of(nfc(text) if compose else text, space), F.lit(""))
    return stripped if compose else F.when(text.rlike(r"^[!-~]+\z"), text).otherwise(stripped)


def norm_vendor(text: Column, compose: bool = True, space: str = SPACE) -> Column:
    joined = replace(norm_string(text, compose, space), f"{space}+", " ")
    return joined if compose else F.when(text.rlike(r"^[!-~]+\z"), text).otherwise(joined)


def strip_bidi_controls(text: Column) -> Column:
    """Drop every format character."""
    return replace(text, r"\p{Cf}")


def strip_bidi_marks(text: Column) -> Column:
    """Drop direction marks, embeddings and isolates only."""
    return replace(text, r"[\u200e\u200f\u202a-\u202e\u2066-\u2069]")


def strip_nikud(text: Column) -> Column:
    return replace(text, NIKUD)


def fold_sofit(text: Column) -> Column:
    return F.translate(text, FINAL, MEDIAL)


def fix_quoted_abbreviations(text: Column) -> Column:
    for wrong, right in ABBREVIATIONS:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def reverse_hebrew_lines(text: Column) -> Column:
    """Reverse the words of every line with a Hebrew letter; other lines stay."""

    def turned(line: Column) -> Column:
        words = F.filter(F.split(line, rf"(?U){SPACE}+", -1), lambda w: w != "")
        return F.when(line.rlike(HEBREW), F.array_join(F.reverse(words), " ")).otherwise(line)

    return F.array_join(F.transform(lines(text), turned), "\n")


def normalize_for_matching(text: Column, reverse_tokens: bool = True, fix_abbreviations: bool = True) -> Column:
    text = strip_bidi_controls(text)
    if fix_abbreviations:
        text = fix_quoted_abbreviations(text)
    if reverse_tokens:
        text = reverse_hebrew_lines(text)
    return strip_nikud(text)


def preprocess(text: Column) -> Column:
    """Cleaning for noisy text: marks, vowel points, composition, runs of blanks."""
    return F.regexp_replace(nfc(strip_nikud(strip_bidi_marks(text))), "[ \t]+", " ")


def rewrite_labels(text: Column) -> Column:
    """Canonical forms of labels that recognition mangles; numbers and names stay. Applying it twice changes nothing more."""
    for pattern, label in LABEL_REWRITES:
        text = replace(text, pattern, label)
    return text


def slug(text: Column) -> Column:
    """An id of letters, digits, dot, underscore and hyphen; ``doc`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", ""), F.lit("")), F.lit("doc"))


def safe_stem(text: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), 1, most)


def relative_path(path: Column, base: str) -> Column:
    """The path below ``base`` with forward slashes; absolute if it is elsewhere."""
    posix = F.replace(path, F.lit("\\"), F.lit("/"))
    head = base.rstrip("/") + "/"
    return F.when(F.startswith(posix, F.lit(head)), F.substring(posix, len(head) + 1, 1 << 30)).otherwise(posix)


def resolve_path(path: Column, base: str) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def truncated(text: Column, most: int) -> Column:
    note = F.concat(F.left(text, F.lit(most)), F.lit("… (truncated, "), (F.length(text) - most).cast("string"), F.lit(" more chars)"))
    return F.when(F.length(text) > most, note).otherwise(text)


def html_escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def csv_quote(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('""'))


def top_lines(text: Column, k: int) -> Column:
    """The first ``k`` lines that are not blank, stripped."""
    return F.slice(F.filter(F.transform(lines(text), strip), lambda line: line != ""), 1, k)


def shown(value: Column, kind: str = "string") -> Column:
    """A value for a report: null, true and false by name, lists as JSON."""
    if kind.startswith("array"):
        value = F.to_json(value)
    return F.coalesce(value.cast("string"), F.lit("null"))


def json_safe(value: Column) -> Column:
    return value.cast("string")
