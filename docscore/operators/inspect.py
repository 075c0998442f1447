"""Labelling of source lines by patterns; a line may have several labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: categories and their patterns
CATEGORIES = {
    "OCR engine calls": r"^\s*(?:import\s+(?:pytesseract|cv2|paddleocr|kraken)\b|from\s+(?:pytesseract|cv2|paddleocr|kraken)\b)",
    "Hebrew/Arabic normalization": r"\bdef\s+(?:strip_bidi\w*|strip_nikud\w*|fold_sofit\w*|fix_quoted_abbrev\w*|reverse_tokens\w*|normalize_for_matching\w*|strip_tatweel\w*|normalize_arabic\w*)",
    "Field extraction (regex)": r"\bdef\s+_extract_[a-z_]+\s*\(",
    "Israeli ID checksum": r"\bdef\s+validate_israeli_id\b|\bdef\s+\w*israeli_\w*id\w*\b|\bdef\s+\w*checksum\w*\b",
    "Canonical JSON schema": r"\bclass\s+IsraeliInvoice\b|\bdef\s+to_json\b|\bdef\s+extract_from_(?:text|pdf)\b",
}
# fixed value: what the name of a test file looks like
TEST_FILE = r"^test_.+\.py$|^_test\.py$"


def line_labels(lines: DataFrame, categories: dict[str, str], line_col: str = "line") -> DataFrame:
    """A row per line and category it matches: the input's columns and ``category``."""
    hits = F.array(*[F.when(F.col(line_col).rlike(p), F.lit(name)) for name, p in categories.items()])
    return lines.withColumn("category", F.explode(F.array_compact(hits)))


def category_counts(labelled: DataFrame, categories: dict[str, str]) -> DataFrame:
    """Hits of every category, zero for those without any."""
    names = labelled.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, categories))).alias("category"))
    return names.join(labelled.groupBy("category").agg(F.count("*").alias("hits")), "category", "left").na.fill(0, ["hits"])


def is_test_file(name: Column) -> Column:
    return name.rlike(TEST_FILE)


def population_state(exists: Column, n_files: Column) -> Column:
    return F.when(~exists, "missing").when(n_files > 0, "populated").otherwise("empty")
